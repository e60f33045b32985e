"""Vectorised text kernels shared by the Arrow-batch operators.

A batch of texts is handled as one flat byte array with document offsets.
Words, word hashes, shingle and window hashes then come from a handful of
numpy passes, without a Python object per word. Batches are cut into slices
of about ``SLICE_BYTES`` of text so that a worker's memory does not follow the
batch, only its longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(n: int, base=_BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; grown and kept per process."""
    have = _POWERS.get(int(base))
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[int(base)] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def small(batches, rows: int = 128):
    """Arrow batches cut into pieces of so many rows, so that copies of a column stay small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """(first, last) document ranges of at most ``most`` bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, off: np.ndarray, sep: np.ndarray = _SPACE):
    """Byte start and end of every word, and the index of each document's first word.

    Words are runs of bytes outside ``sep`` that don't cross documents. The
    last array has one entry more than there are documents.
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    is_sep = sep[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    start = ~is_sep
    end = start.copy()
    start[1:] &= is_sep[:-1] | edge[1:-1]
    end[:-1] &= is_sep[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, by differences of one polynomial prefix sum."""
    if not len(s):
        return np.zeros(0, np.uint64)
    p = powers(len(raw))
    acc = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1 + seed)) * p[:-1], out=acc[1:])
    inv = powers(len(raw), _BASE_INV)
    return mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def windows(h: np.ndarray, first: np.ndarray, k: int):
    """Hash of every k consecutive words of one document, with the word index of each window's start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if k <= 8:
        acc = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            acc = acc * _BASE + h[j : j + n]
    else:
        p = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * powers(len(h))[:-1], out=p[1:])
        acc = (p[k:] - p[:-k]) * powers(len(h), _BASE_INV)[:n]
    count = np.diff(first)
    last = np.repeat(first[1:], count)
    ok = np.arange(n) + k <= last[:n]
    return mix(acc[ok] + _U(k)), np.flatnonzero(ok)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; fewer words make one shingle, none an empty set."""
    raw = _LOWER[raw]
    s, e, first = word_spans(raw, off)
    h = span_hashes(raw, s, e)
    w, at = windows(h, first, k)
    lo = np.searchsorted(at, first)
    out = []
    for d in range(len(off) - 1):
        a, b = lo[d], lo[d + 1]
        if b > a:
            out.append(np.unique(w[a:b]))
        elif first[d + 1] > first[d]:
            acc = _U(0)
            with np.errstate(over="ignore"):
                for x in h[first[d] : first[d + 1]]:
                    acc = acc * _BASE + x
            out.append(mix(np.array([acc + _U(1000 + first[d + 1] - first[d])], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fold(values: np.ndarray, seed: int) -> int:
    """Order-free signed 64-bit digest of a set of hashes."""
    x = mix(np.append(mix(values + _U(seed)), _U(len(values) + seed)))
    return int(np.sum(x, dtype=np.uint64, keepdims=True).view(np.int64)[0])


def bitmaps(owner: np.ndarray, h: np.ndarray, n: np.ndarray, bits: int = 2) -> list[bytes]:
    """For each owner of ``n`` distinct hashes: n (four bytes), then a bitmap of ``bits`` a hash or more, with a bit set where an odd number of them fall.

    Two bitmaps differ in no more places than the sets do. One of twice as
    many bits, folded, is one of half as many.
    """
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(bits * n, 1))).astype(np.int64))
    begin = np.cumsum(width) - width
    at = begin[owner] + (h & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [k.to_bytes(4, "little") + packed[a // 8 : (a + w) // 8] for k, a, w in zip(n.tolist(), begin.tolist(), width.tolist(), strict=True)]


def folded(bitmap: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bitmap = (bitmap >> width) ^ (bitmap & (1 << width) - 1)
    return bitmap


def may_be_alike(batches):
    """Pairs (a, b, bitmaps of both) that the bitmaps don't rule out at 0.8: there, sets differ in a ninth of their sizes' sum at most."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            n, to = int.from_bytes(x[:4], "little") + int.from_bytes(y[:4], "little"), 8 * (min(len(x), len(y)) - 4)
            x, y = (folded(int.from_bytes(v[4:], "little"), 8 * (len(v) - 4), to) for v in (x, y))
            keep.append(9 * (x ^ y).bit_count() <= n)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
