"""Line dedup: of lines alike by character shingles, across all documents, one stays.

Equal lines are one class (64-bit hash). A class's signature has one minimum
of its 5-character (code point) shingle hashes in each of ``BANDS * PER_BAND`` bins, empty
bins filled from the next; classes that agree in a whole band are candidates
(at similarity 0.8 a pair is missed with probability 0.014, at 0.85 with 0.0013,
above 0.9 with under 1e-4; unlike lines agree in a band with 14 times the sixth
power of their similarity, so that few do in a large table). Candidates are verified by the exact Jaccard similarity of their
shingle sets where the sizes of the sets allow the threshold, and union-find
over the links gives components. The first line of each component, by document
id, hash of the text and line number, stays.

Candidates of one band value are linked as ``graph.link_lists`` describes.
What the leaders leave apart meets in groups of bounded size, with the lines
themselves: a bound on the difference of two sets from bitmaps of one bit a
shingle hash rules pairs out, the nearest of what is left are compared
exactly first, and pairs that are connected by then are not compared. Only
links leave a group, never its pairs.

Defined cases: lines without a word are never removed nor counted; a line of
fewer than 5 characters is its own shingle; null texts stay null; a null id
takes no part. Rows that repeat an id are documents of their own where their
texts differ; rows equal in id and text are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import LISTED, components, dealt, group_runs, groups, link_lists
from .jaccard_join import verified
from .shared import bounded, cut, release, row_key, tasks_for

#: Code points. One changed character in the middle links lines of 49 characters or more at 0.8; with 8 it took 79.
GRAM = 5
BANDS, PER_BAND = 14, 6
THRESHOLD = 0.8
#: Members of a band value that one task sends together; of more, a task's members are dealt as a list of their own.
HOT = 64
#: Members of a list outside its largest component from which on its heads come first.
MANY = 1024
#: Bits of the filter of wanted lines, and so the bound of what is broadcast (8 MB); it only lets extra lines through.
FILTER_BITS = 1 << 26
#: Text (bytes) that one task's share of the lists stands for: their parts follow the input's size.
TEXT_A_TASK = 256 << 20


def _lines(raw: np.ndarray, off: np.ndarray):
    """Start, end, document and line number of every line with a word."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none, none, none
    breaks = np.flatnonzero(raw == 10)
    s = np.unique(np.r_[off[:-1], breaks + 1])
    s = s[s < len(raw)]
    filled = np.logical_or.reduceat(~K._SPACE[raw], s)
    s = s[filled]
    doc = np.searchsorted(off, s, "right") - 1
    e = np.minimum(np.r_[breaks, len(raw)][np.searchsorted(breaks, s)], off[doc + 1])
    return s, e, doc, np.searchsorted(breaks, s) - np.searchsorted(breaks, off[doc])


def _occurrences(batches):
    for b in K.small(batches):
        ids, own = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        raw, off = K.flat(b.column(2))
        for i, j in K.slices(off):
            r, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e, doc, line = _lines(r, o)
            yield pa.RecordBatch.from_arrays([pa.array(K.span_hashes(r, s, e).view(np.int64)), pa.array(ids[i:j][doc], pa.int64()), pa.array(own[i:j][doc], pa.int64()), pa.array(line.astype(np.int32))], names=["node", "doc_id", "row", "line"])


def gram_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of every shingle; lines are byte spans in order, apart from each other."""
    ascii_only = not (raw & 0x80).any()
    if ascii_only:
        points, cs, ce = raw, s, e
    else:
        points = np.frombuffer(raw.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
        before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        cs, ce = before[s], before[e]
    n = ce - cs
    wide = np.zeros(len(points) + 2 * GRAM, np.uint64)
    np.add(points, 1, out=wide[: len(points)], dtype=np.uint64)
    h = wide[: len(points) + GRAM].copy()
    for i in range(1, GRAM):
        h *= K._BASE
        h += wide[i : i + len(h)]
    for i in np.flatnonzero(n < GRAM):  # a short line is one shingle
        x = 0
        for c in wide[cs[i] : ce[i]].tolist():
            x = x * int(K._BASE) + c
        h[cs[i]] = x % (1 << 64)
    count = np.maximum(n - GRAM + 1, 1)
    edge = np.zeros(len(h) + 1, np.int8)
    edge[cs] = 1
    edge[cs + count] -= 1
    h = h[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return np.repeat(np.arange(len(s)), count), h


def signatures(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One row of bin minima for each line."""
    bins = BANDS * PER_BAND
    line, h = gram_hashes(raw, s, e)
    none = np.iinfo(np.uint64).max
    out = np.full(len(s) * bins, none, np.uint64)
    np.minimum.at(out, line * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), h)
    out = out.reshape(len(s), bins)
    low = np.flatnonzero((out == none).any(1))
    part = out[low]
    # the next filled bin at or behind each, counting round
    next_ = np.where(part == none, 4 * bins, np.arange(bins)).astype(np.int16)
    next_ = np.minimum.accumulate(np.concatenate([next_, next_ + np.int16(bins)], 1)[:, ::-1], 1)[:, ::-1][:, :bins]
    far = (next_ - np.arange(bins, dtype=np.int16)).astype(np.uint64)
    out[low] = np.take_along_axis(part, (next_ % bins).astype(np.int64), 1) + far * np.uint64(0x9E3779B97F4A7C15)
    return out


_PACKED = ["part", "token", "node", "away"]


def _part(token: np.ndarray, parts: int) -> np.ndarray:
    return (token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _dealt(token: np.ndarray, node: np.ndarray, parts: int, task: int):
    """Rows of entries packed by part. A token with over HOT members in this task is a list of its own (marked
    away), dealt by token and task; its first member also goes where the token's other members go."""
    o = np.argsort(token)
    token, node = token[o], node[o]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    n = np.diff(np.r_[start, len(token)])
    part, away = _part(token, parts), np.zeros(len(token), np.int8)
    if n.max() > HOT:
        hot, first = np.repeat(n > HOT, n), start[n > HOT]
        part = np.r_[np.where(hot, _part(K.mix(token + np.uint64(2 * task + 1)), parts), part), part[first]]
        away = np.r_[hot, np.ones(len(first), bool)].astype(np.int8)
        token, node = np.r_[token, token[first]], np.r_[node, node[first]]
        o = np.argsort(part, kind="stable")
        part, token, node, away = part[o], token[o], node[o], away[o]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        a, z = cuts[p], cuts[p + 1]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x[a:z].tobytes()], pa.binary()) for x in (token, node, away))], names=_PACKED)


def _tokens(parts: int):
    def run(batches):
        nodes, tokens = [], []
        seen = np.zeros(0, np.uint64)
        task = TaskContext.get().partitionId()
        for b in K.small(batches):
            raw, off = K.flat(b.column(0))
            for i, j in K.slices(off):
                r, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, _, _ = _lines(r, o)
                node, pick = np.unique(K.span_hashes(r, s, e), return_index=True)
                fresh = ~np.isin(node, seen, assume_unique=True)
                node, pick = node[fresh], pick[fresh]
                seen = np.union1d(seen, node)
                o = np.argsort(pick)
                node, pick = node[o], pick[o]
                sig = signatures(r, s[pick], e[pick])
                for k in range(BANDS):
                    acc = np.full(len(node), k + 1, np.uint64)
                    for x in range(k * PER_BAND, (k + 1) * PER_BAND):
                        acc = acc * K._BASE + sig[:, x]
                    nodes.append(node)
                    tokens.append(K.mix(acc))
        if tokens:
            token = np.concatenate(tokens)
            if len(token):
                yield from _dealt(token, np.concatenate(nodes), parts, task)

    return run


def _lists(token: np.ndarray, node: np.ndarray, away: np.ndarray) -> pa.RecordBatch:
    """Rows of the lists of two or more of one part, as graph.shared_lists makes them; one that has members elsewhere counts as longer."""
    o = np.argsort(token)
    token = token[o]
    next_ = np.r_[False, token[1:] == token[:-1]]
    both = next_ | np.r_[next_[1:], False]
    token, node, away = token[both], node[o][both], away[o][both]
    o = np.lexsort((node, token))
    token, node, away = token[o], node[o], away[o] > 0
    same = np.r_[False, (token[1:] == token[:-1]) & (node[1:] == node[:-1])][: len(token)]
    new = np.r_[True, token[1:] != token[:-1]][: len(token)]
    open_ = np.repeat(np.logical_or.reduceat(away, np.flatnonzero(new)), np.diff(np.r_[np.flatnonzero(new), len(token)])) if len(token) else away
    token, node, new, open_ = token[~same].view(np.int64), node[~same].view(np.int64), new[~same], open_[~same]
    start = np.flatnonzero(new)
    n = np.diff(np.r_[start, len(token)])
    lead, length = np.repeat(start, n), np.repeat(n, n)
    more = (length > 2) | open_
    i = np.flatnonzero((more & (length > 1)) | ((length == 2) & ~new))
    none = np.zeros(len(i), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (token[i], node[i], none, node[lead[i]], none, more[i])], names=["token", "node", "size", "leader", "leader_size", "more"])


def _unpacked(batches):
    """Lists of each part; a part's rows come together, and one part is held at a time."""
    part, held = None, []
    for b in batches:
        for p, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part and held:
                yield _lists(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held = []
            part = p
            held.append([np.frombuffer(v, t) for v, t in zip(x, (np.uint64, np.uint64, np.int8), strict=True)])
    if held:
        yield _lists(*(np.concatenate(v) for v in zip(*held, strict=True)))


def band_lists(docs: DataFrame) -> DataFrame:
    """The lists of lines that agree in a band, as graph.shared_lists makes them."""
    tasks = tasks_for(docs, TEXT_A_TASK)
    packed = docs.select("text").mapInArrow(_tokens(4 * tasks), "part int, token binary, node binary, away binary")
    return packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_unpacked, LISTED)


def _wanted(bits: np.ndarray, node: np.ndarray) -> np.ndarray:
    bit = node % np.uint64(FILTER_BITS)
    return np.flatnonzero((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))


def _bitmaps(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[bytes]:
    """Bitmap of each line's distinct shingles."""
    line, h = gram_hashes(raw, s, e)
    bits = np.uint64(64 - len(s).bit_length())
    key = np.sort((line.astype(np.uint64) << bits) | (h >> (np.uint64(64) - bits)))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    line = (key >> bits).astype(np.int64)
    # the top 32 bits of a hash, however many the keys have room for
    top = (key & ((np.uint64(1) << bits) - np.uint64(1))) >> (bits - np.uint64(32))
    return K.bitmaps(line, top, np.bincount(line, minlength=len(s)))


def _texts(wanted):
    def run(batches):
        for b in K.small(batches):
            raw, off = K.flat(b.column(0))
            for i, j in K.slices(off):
                r, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, _, _ = _lines(r, o)
                node, pick = np.unique(K.span_hashes(r, s, e), return_index=True)
                hit = _wanted(wanted.value, node)
                pick = pick[hit]
                o = np.argsort(pick)
                pick, node = pick[o], node[hit][o]
                text = [r[s[x] : e[x]].tobytes() for x in pick]
                joined = np.frombuffer(b"".join(text), np.uint8)
                stop = np.cumsum([len(x) for x in text], dtype=np.int64)
                begin = stop - np.array([len(x) for x in text], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(text, pa.binary()), pa.array(_bitmaps(joined, begin, stop) if len(text) else [], pa.binary())], names=["node", "items", "bitmap"])

    return run


def shingles(line: bytes) -> set[str]:
    text = line.decode(errors="surrogateescape")
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} or {text}


def similar(x: set[str], y: set[str]) -> bool:
    o = len(x & y)
    return o >= THRESHOLD * (len(x) + len(y) - o) - 1e-9


def _alike(batches):
    for b in batches:
        keep, last, left = [], None, set()
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if x != last:  # a hub's pairs come one after another
                last, left = x, shingles(x)
            keep.append(similar(left, shingles(y)))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _alive(batches):
    """Of sorted groups with bitmaps, the rows that may be alike with a row across components."""

    def sides(b, width):
        lines = [x[4:] for x in b.column(7).to_pylist()]
        rows = np.zeros((len(lines), width // 64), np.uint64)
        for i, x in enumerate(lines):
            if 8 * len(x) >= width:
                rows[i] = np.frombuffer(K.folded(int.from_bytes(x, "little"), 8 * len(x), width).to_bytes(width // 8, "little"), np.uint64)
        size = np.array([int.from_bytes(x[:4], "little") if 8 * (len(x) - 4) >= width else 0 for x in b.column(7).to_pylist()], np.int64)
        return rows, size, b.column(6).to_numpy(zero_copy_only=False)

    def near(x, y):
        gap = np.zeros((len(x[1]), len(y[1])), np.int32)
        for w in range(x[0].shape[1]):
            gap += np.bitwise_count(x[0][:, w, None] ^ y[0][None, :, w])
        low, high = np.minimum(x[1][:, None], y[1][None]), np.maximum(x[1][:, None], y[1][None])
        return (x[2][:, None] != y[2][None]) & (9 * gap <= low + high) & (low >= THRESHOLD * high - 1e-9)

    held: list = []  # (batch, side, alive) of the group's block
    width = 64

    def told():
        for b, _, alive in held:
            if alive.any():
                yield b.select(range(7)).filter(pa.array(alive))

    for begins, chunk, role, b in group_runs(batches):
        if begins:
            yield from told()
            held = []
            # a member with less than half the bits is under half the size of the smallest that is held
            width = max(64, 4 * (len(b.column(7)[0].as_py()) - 4))
        for k in range(0, b.num_rows, 1024):
            rows = b.slice(k, 1024)
            side = sides(rows, width)
            alive = np.zeros(rows.num_rows, bool)
            if role == 0:
                held.append((rows, side, alive))
                if chunk:
                    continue
            for _, other, there in held:
                ok = near(other, side)
                there |= ok.any(1)
                alive |= ok.any(0)
            if role and alive.any():
                yield rows.select(range(7)).filter(pa.array(alive))
    yield from told()


class _Members:
    """Lines of one group: node, component, size, shingles and bitmap."""

    def __init__(self, words: int):
        self.words = words
        self.node, self.comp, self.size = (np.zeros(0, np.int64) for _ in range(3))
        self.bits, self.sets = np.zeros((0, words), np.uint64), []

    def add(self, node, comp, lines) -> None:
        sets = [shingles(x) for x in lines]
        bits = np.zeros((len(sets), self.words), np.uint64)
        for i, x in enumerate(sets):
            at = np.fromiter(map(hash, x), np.int64, len(x)) & (64 * self.words - 1)
            bits[i] = np.packbits((np.bincount(at, minlength=64 * self.words) & 1).astype(np.uint8)).view(np.uint64)
        self.sets += sets
        self.bits = np.concatenate([self.bits, bits])
        self.node, self.comp = np.r_[self.node, node], np.r_[self.comp, comp]
        self.size = np.r_[self.size, np.array([len(x) for x in sets], np.int64)]


def _joined(x: _Members, y: _Members, begin: int):
    """Links (node, node) between members of x and, from place ``begin``, of y, in different components; y may be x.

    The two bitmaps have a bit where an odd number of shingles fall, so they
    differ in no more places than the sets do.
    """
    gap = np.zeros((len(x.node), len(y.node) - begin), np.int32)
    for w in range(x.words):
        gap += np.bitwise_count(x.bits[:, w, None] ^ y.bits[None, begin:, w])
    both = x.size[:, None] + y.size[None, begin:]
    ok = (9 * gap <= both) & (np.minimum(x.size[:, None], y.size[None, begin:]) >= THRESHOLD * np.maximum(x.size[:, None], y.size[None, begin:]) - 1e-9)
    ok &= x.comp[:, None] != y.comp[None, begin:]
    if x is y:
        ok &= np.arange(len(x.node))[:, None] < np.arange(begin, len(y.node))[None]
    far = np.iinfo(np.int32).max
    rows = np.flatnonzero(ok.any(1))
    gap[~ok] = far
    while len(rows):
        near = gap[rows].argmin(1)
        for i, j in zip(rows.tolist(), near.tolist(), strict=True):
            a, b = x.comp[i], y.comp[begin + j]
            if gap[i, j] == far or a == b:
                continue
            gap[i, j] = far
            if similar(x.sets[i], y.sets[begin + j]):
                yield x.node[i], y.node[begin + j]
                low, high = min(a, b), max(a, b)
                for side in (x, y):
                    side.comp[side.comp == high] = low
        gap[x.comp[:, None] == y.comp[None, begin:]] = far
        rows = rows[(gap[rows] != far).any(1)]


def _links_within(batches):
    """Sorted groups, with their lines, to the links (a, b) that join components of a group."""
    held = None
    for begins, chunk, role, b in group_runs(batches):
        if begins:
            held = _Members(b.column(5)[0].as_py() // 64)
        found = []
        for k in range(0, b.num_rows, 1024):
            node, comp = (b.column(i).slice(k, 1024).to_numpy(zero_copy_only=False) for i in (4, 6))
            lines = b.column(7).slice(k, 1024).to_pylist()
            if role == 0:
                at = len(held.node)
                held.add(node, comp, lines)
                found += _joined(held, held, at) if chunk == 0 else []
            else:
                other = _Members(held.words)
                other.add(node, comp, lines)
                found += _joined(held, other, 0)
        if found:
            a, z = (np.array(v, np.int64) for v in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])


def wanted_bits(nodes: DataFrame) -> np.ndarray:
    """Bitmap over hashed nodes, combined by the executors; its size doesn't depend on the data."""
    # node modulo FILTER_BITS as unsigned: the low bits
    bit = F.col("node").bitwiseAND(FILTER_BITS - 1)
    words = nodes.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(node & {FILTER_BITS - 1} & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def redundant_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, gone): numbers of the lines to remove, from 0, for each document that has some; row is row_key() of it."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).where("doc_id is not null")
    lists = cut(band_lists(docs))
    nodes = lists.select(F.explode(F.array("node", "leader")).alias("node")).distinct()
    nodes = cut(nodes)
    wanted = spark.sparkContext.broadcast(wanted_bits(nodes))
    texts = docs.select("text").mapInArrow(_texts(wanted), "node long, items binary, bitmap binary").join(bounded(nodes), "node", "left_semi")
    held = cut(texts.groupBy("node").agg(F.min(F.struct("items", "bitmap")).alias("x")).select("node", "x.*"))
    bitmaps = held.select("node", F.col("bitmap").alias("items"))
    bits = 8 * (F.octet_length("bitmap") - 4)

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs if pairs.isEmpty() else verified(cut(verified(pairs, bitmaps, K.may_be_alike)), held.drop("bitmap"), _alike)

    def rest(part: DataFrame) -> DataFrame:
        # in groups, size is the bits of a line's bitmap: members come in this order
        members = groups(part.drop("size").join(held.select("node", "bitmap", bits.cast("long").alias("size")), "node"), "bitmap")
        alive = cut(members.mapInArrow(_alive, "token long, block long, chunk long, role int, node long, size long, comp long"))
        return dealt(alive.join(held.drop("bitmap"), "node").select(*alive.columns, "items")).mapInArrow(_links_within, "a long, b long")

    comp = components(link_lists(lists, F.lit(True), verify, rest, MANY))
    del lists, nodes, texts, held, bitmaps, verify, rest
    release(spark)
    occ = cut(docs.mapInArrow(_occurrences, "node long, doc_id long, row long, line int"))
    occ = occ.join(bounded(comp), "node", "left").select(F.coalesce("comp", "node").alias("comp"), F.struct("doc_id", "row", "line").alias("at"))
    stay = occ.groupBy("comp").agg(F.min("at").alias("stay"), F.count(F.lit(1)).alias("n")).where("n > 1").select("comp", "stay")
    gone = occ.join(stay, "comp").where("at <> stay")
    return gone.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.row").alias("row")).agg(F.collect_set("at.line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_removed") -> DataFrame:
    """docs with text_col less the redundant lines, and ``count_col``, the lines removed (a column of that name is replaced)."""
    gone = redundant_lines(docs, id_col, text_col).toDF("_line_doc", "_line_row", "_line_gone")
    out = docs.join(gone, (F.col(id_col).cast("long") == F.col("_line_doc")) & (row_key(id_col, text_col) == F.col("_line_row")), "left")
    text = F.col(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("_line_gone"), i)), "\n")
    out = out.withColumn(text_col, F.when(F.col("_line_gone").isNull() | text.isNull(), text).otherwise(kept))
    return out.withColumn(count_col, F.when(F.col("_line_gone").isNull(), 0).otherwise(F.size("_line_gone")).cast("long")).drop("_line_gone", "_line_doc", "_line_row")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: lines removed, lines with a word that stay, digest of the text that stays."""
    out = dedup_lines(docs.select("doc_id", "text"))
    left = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))).cast("long")
    return out.select("doc_id", "n_removed", left.alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
