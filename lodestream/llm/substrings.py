"""Substring dedup: words in windows that an earlier document holds too are removed.

A window is ``size`` consecutive words of one document; a document is earlier
by a smaller id. Two passes find the windows to remove:

1. Count-min prefilter. The smallest hash among a window's short word runs
   names the window coarsely: equal windows have equal names, and neighbours
   share one, so there are about twenty times fewer names than windows. Every
   partition counts its names in a sparse count-min sketch of fixed width;
   the merged counts overestimate, so a window whose name is counted once in
   some row occurs once. What repeats becomes a bitmap of bounded size.
2. Exact grouping of the windows estimated repeated. Within a partition, only
   the earliest document of a window goes on, the others are settled there, so
   a window that a third of all documents hold moves once for each partition.
   The rest are dealt by window hash and sorted.

A saturated sketch lets more windows through to the second pass; it loses
none. Windows are compared by 80 bits of hash. What a task collects comes in
parts whose number follows the input's size, and it holds one part at a time.
The places that it settles go to a quarter as many buckets of documents, packed
into one row a bucket, so their rows are bounded by the parts whatever the
number of tasks.

Defined cases: null and word-free texts have no words; a null id is neither
earlier nor later than any; rows that repeat an id are neither earlier nor
later than each other, and each loses the windows of its own text (texts of
one id are told apart by 32 bits of hash).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cut, estimated, row_key, tasks_for

#: Cells of each of the sketch's rows; as a bitmap each takes an eighth of this in bytes.
WIDTH = 1 << 25
ROWS = 2
GRAM = 8
#: Text (bytes) whose windows one task collects.
TEXT_A_TASK = 256 << 20
#: Parts of the windows: so many a core, or one for so much of the documents' estimated size if that is more.
PARTS, PART_BYTES = 4, 8 << 20


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    if len(x) < n:
        return x[:0]
    m, have = x, 1
    while 2 * have <= n:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - have : n - have + len(x) - n + 1]) if have < n else m


def _windows(raw: np.ndarray, off: np.ndarray, size: int):
    """Per window: document index, word place, hash, second hash and name."""
    s, e, first = K.word_spans(raw, off)
    h = K.span_hashes(raw, s, e)
    w, at = K.windows(h, first, size)
    gram = min(GRAM, size)
    if not len(w):
        z = np.zeros(0, np.int64)
        return z, z, w, w, w
    acc = np.zeros(len(h) - gram + 1, dtype=np.uint64)
    for j in range(gram):
        acc = acc * K._BASE + h[j : j + len(acc)]
    name = _sliding_min(K.mix(acc), size - gram + 1)[at]
    d = np.searchsorted(first, at, "right") - 1
    p = np.zeros(len(h) + 1, dtype=np.uint64)
    base = np.uint64(0xD1342543DE82EF95)
    inv = np.uint64(pow(int(base), -1, 1 << 64))
    np.cumsum(K.mix(h + np.uint64(5)) * K.powers(len(h), base)[:-1], out=p[1:])
    second = K.mix((p[at + size] - p[at]) * K.powers(len(h), inv)[at]) >> np.uint64(48)
    return d, at - first[d], w, second, name


def _cells(name: np.ndarray) -> list[np.ndarray]:
    return [(K.mix(name + np.uint64(77 + r)) % np.uint64(WIDTH)).astype(np.int64) + r * WIDTH for r in range(ROWS)]


def _sketch(size: int):
    def run(batches):
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in K.small(batches):
            raw, off = K.flat(b.column(0))
            found = []
            for i, j in K.slices(off):
                d, _, _, _, name = _windows(raw[off[i] : off[j]], off[i : j + 1] - off[i], size)
                if len(d):
                    new = np.r_[True, (name[1:] != name[:-1]) | (d[1:] != d[:-1])]
                    found += _cells(name[new])
            if found:
                c, at = np.unique(np.concatenate([cells, *found]), return_inverse=True)
                weight = np.ones(len(at), np.int64)
                weight[: len(cells)] = counts
                cells, counts = c, np.bincount(at, weights=weight).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], names=["cell", "n"])

    return run


def repeated_names(docs: DataFrame, size: int) -> np.ndarray:
    """Bitmap of the merged sketch's cells that count two or more; its size doesn't depend on the data."""
    merged = docs.select("text").mapInArrow(_sketch(size), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    words = merged.groupBy(F.expr("cell >> 6").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(WIDTH * ROWS // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _held(bitmap: np.ndarray, name: np.ndarray) -> np.ndarray:
    ok = np.ones(len(name), bool)
    for c in _cells(name):
        ok &= (bitmap[c >> 6] >> (c & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _settle(h, h2, doc, row, at):
    """Sorted by window and document: whether a place is of its window's earliest document."""
    o = np.lexsort((at, doc, h2, h))
    h, h2, doc, row, at = h[o], h2[o], doc[o], row[o], at[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return h, h2, doc, row, at, doc == doc[lead]


_PLACES = ["bucket", "ids", "rows", "places"]


def _packed(doc: np.ndarray, row: np.ndarray, at: np.ndarray, parts: int):
    """(bucket of documents, packed ids, row tags and places): a few rows for each task, however many documents."""
    bucket = (K.mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    o = np.lexsort((at, row, doc, bucket))
    doc, row, at = doc[o].astype(np.int64), row[o].astype(np.uint32), at[o].astype(np.int32)
    cuts = np.searchsorted(bucket[o], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), *(x[cuts[p] : cuts[p + 1]].tobytes() for x in (doc, row, at))


def _by_part(batches, kinds):
    """The arrays of each part (first column) of rows that are sorted by it, one part at a time."""
    part, held = None, []
    for b in batches:
        for p, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part and held:
                yield [np.concatenate(v) for v in zip(*held, strict=True)]
                held = []
            part = p
            held.append([np.frombuffer(v, t) for v, t in zip(x, kinds, strict=True)])
    if held:
        yield [np.concatenate(v) for v in zip(*held, strict=True)]


def _gathered(batches):
    """(doc_id, tag, places) with one row a document."""
    for doc, row, at in _by_part(batches, (np.int64, np.uint32, np.int32)):
        o = np.lexsort((at, row, doc))
        doc, row, at = doc[o], row[o], at[o]
        cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(doc[cuts]), pa.array(row[cuts].astype(np.int64)), pa.array([x.tobytes() for x in np.split(at, cuts[1:])], pa.binary())], names=["doc_id", "tag", "places"])


_MOVED = ["part", "doc_id", "tag", "h", "h2", "at"]


def _candidates(size: int, bitmap, parts: int, buckets: int):
    def run(batches):
        rows = []
        for b in K.small(batches):
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw, off = K.flat(b.column(2))
            for i, j in K.slices(off):
                d, at, w, second, name = _windows(raw[off[i] : off[j]], off[i : j + 1] - off[i], size)
                keep = _held(bitmap.value, name)
                d = d[keep]
                rows.append((w[keep], second[keep].astype(np.uint16), ids[i:j][d], tags[i:j][d].astype(np.uint32), at[keep].astype(np.int32)))
        if not rows:
            return
        h, h2, doc, row, at, first = _settle(*(np.concatenate(x) for x in zip(*rows, strict=True)))
        rows.clear()
        none = [pa.array([b""], pa.binary())] * 2
        for p, *x in _packed(doc[~first], row[~first], at[~first], buckets):
            ids_, tags, places = (pa.array([v], pa.binary()) for v in x)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - p], pa.int32()), ids_, tags, *none, places], names=_MOVED)
        h, h2, doc, row, at = h[first], h2[first], doc[first], row[first], at[first]
        part = (h % np.uint64(parts)).astype(np.int64)
        o = np.argsort(part, kind="stable")
        part, h, h2, doc, row, at = (x[o] for x in (part, h, h2, doc, row, at))
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, z = cuts[p], cuts[p + 1]
            x = (doc[a:z].astype(np.int64), row[a:z], h[a:z], h2[a:z], at[a:z])
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in x)], names=_MOVED)

    return run


def _late(buckets: int):
    def run(batches):
        """Places whose window an earlier document holds, by bucket."""
        for doc, row, h, h2, at in _by_part(batches, (np.int64, np.uint32, np.uint64, np.uint16, np.int32)):
            _, _, doc, row, at, first = _settle(h, h2, doc, row, at)
            for p, *x in _packed(doc[~first], row[~first], at[~first], buckets):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([v], pa.binary()) for v in x)], names=_PLACES)

    return run


def _kept(size: int):
    def run(batches):
        for b in K.small(batches):
            n, removed, text = [], [], []
            for t, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (t or "").encode().split()  # at 0x20 and 0x09-0x0D
                n.append(len(words))
                if places:
                    edge = np.zeros(len(words) + 1, np.int64)
                    p = np.frombuffer(places, np.int32)
                    p = p[p + size <= len(words)]
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + size, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                text.append(b" ".join(words))
            digest = [hashlib.sha256(x).hexdigest() for x in text]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array([x.decode() for x in text])], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def parts_for(docs: DataFrame) -> int:
    """Parts of the windows of docs: they follow its size, and not how many tasks a shuffle has."""
    size = max(estimated(docs), PART_BYTES * PARTS * docs.sparkSession.sparkContext.defaultParallelism)
    return -(-size // PART_BYTES)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row; kept words are joined by one space."""
    spark = docs.sparkSession
    tag = row_key(id_col, text_col).bitwiseAND((1 << 32) - 1)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"), F.col(text_col).cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    bitmap = spark.sparkContext.broadcast(repeated_names(known, size))
    tasks, parts = tasks_for(docs, TEXT_A_TASK), parts_for(docs)
    buckets = -(-parts // 4)
    moved = cut(known.mapInArrow(_candidates(size, bitmap, parts, buckets), "part int, doc_id binary, tag binary, h binary, h2 binary, at binary"))
    here = moved.where("part < 0").select((-1 - F.col("part")).alias("bucket"), F.col("doc_id").alias("ids"), F.col("tag").alias("rows"), F.col("at").alias("places"))
    there = moved.where("part >= 0").repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_late(buckets), "bucket int, ids binary, rows binary, places binary")
    gone = here.union(there).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_gathered, "doc_id long, tag long, places binary")
    out = docs.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "places")
    return out.mapInArrow(_kept(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
