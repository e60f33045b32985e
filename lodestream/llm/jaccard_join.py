"""N-gram Jaccard join by a size-aware heavy-light split, exact at the threshold.

Every document becomes its set of distinct k-word shingles. Equal sets are one
class; the join runs between class representatives, so copies are never
expanded into pairs.

* Light (small) sets enumerate their subsets of every fixed size that an
  intersection at the threshold can have. Two light sets link exactly if they
  share such a subset of size t with t >= 0.8 (|a| + |b| - t).
* Heavy (large) sets, and the light ones near enough in size, go to inverted
  lists over a prefix of the set in one global order (frequent shingles last,
  then by hash). Sets at the threshold share a prefix shingle. Lists are
  scanned as ``graph.link_lists`` describes. Pairs are first held against an
  upper bound from small bitmaps of the sets, then verified exactly on the
  whole sets, before which wider bitmaps rule out most pairs just under the
  threshold at a quarter of the bytes.
* The boundary is the size that minimises the estimated cost over the
  histogram of all set sizes, with the mean length of all small sets' lists.

The frequent shingles come from a pass over all documents; which shingles they
are affects only the length of the lists, never the result.

Defined cases: null or word-free text gives an empty set, linked with nothing;
with fewer than k words the whole sequence is the one shingle; a null id is
returned with a null component and takes no part. Rows are linked by their own
text: rows that repeat an id get one row each, and with different texts may be
in different components. Shingles and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components, link_lists, pairs_within, shared_lists
from .shared import bounded, cut, release, row_key

#: Light sets are never larger than this: the subset count explodes beyond.
LIGHT_MOST = 14
#: Members of a list outside its largest component that are paired at once; with more, its heads come first.
MANY = 16
#: Frequent shingles kept for the global order: a bounded table of 16 bytes each.
FREQUENT_MOST = 1 << 16
#: Mean bytes of the sets in question from which wider bitmaps come before them; smaller sets cost no more than such a pass.
WIDE_FROM = 2048
#: Sizes in lists carry the token's place in its set; places beyond count as the last one.
PLACES = 1 << 24


def need(n: int) -> int:
    """Smallest overlap that a set of n can have with a partner at 0.8."""
    return (4 * n + 4) // 5


def _frequent(k: int):
    def run(batches):
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in K.small(batches):
            raw, off = K.flat(b.column(0))
            for i, j in K.slices(off):
                sets = K.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                t, c = np.unique(np.concatenate(sets), return_counts=True)
                keep = c >= max(3, (j - i) // 100)
                t, at = np.unique(np.r_[tokens, t[keep]], return_inverse=True)
                counts = np.bincount(at, weights=np.r_[counts, c[keep]], minlength=len(t)).astype(np.int64)
                tokens = t
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    return run


def frequent_shingles(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """The most frequent shingles over all documents (all from a power of two on), sorted by hash, with their counts."""
    seen = cut(docs.select(text).mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    power = F.floor(F.log2("n")).cast("int")
    least, total = 63, 0
    for p, count in sorted(seen.groupBy(power.alias("p")).count().collect(), reverse=True):
        total += count
        if total > FREQUENT_MOST:
            break
        least = p
    rows = seen.where(power >= least).toArrow()
    t = rows["token"].to_numpy().view(np.uint64)
    order = np.argsort(t)
    return np.stack([t[order], rows["n"].to_numpy().astype(np.uint64)[order]]) if len(t) else np.zeros((2, 0), np.uint64)


def _ordered(s: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    if not freq.shape[1]:
        return s
    at = np.minimum(np.searchsorted(freq[0], s), freq.shape[1] - 1)
    n = np.where(freq[0][at] == s, freq[1][at], np.uint64(0))
    return s[np.lexsort((s, n))] if n.any() else s


def _profile(k: int, freq: np.ndarray):
    def run(batches):
        for b in K.small(batches):
            raw, off = K.flat(b.column(1))
            for i, j in K.slices(off):
                sizes, nodes, keys = [], [], []
                sets = K.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                for s in sets:
                    n = len(s)
                    sizes.append(n)
                    nodes.append(K.fold(s, 1))
                    keys.append(_ordered(s, freq)[: n if n <= LIGHT_MOST else n - need(n) + 1].tobytes())
                n = np.array(sizes, np.int64)
                outline = K.bitmaps(np.repeat(np.arange(len(n)), n), np.concatenate(sets), n)
                own, kept = b.column(0).slice(i, j - i).cast(pa.int64()), [c.slice(i, j - i) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([own, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary()), pa.array(outline, pa.binary()), *kept], names=["doc_id", "n_shingles", "node", "keys", "outline", *b.schema.names[2:]])

    return run


def boundary(histogram: dict[int, int], list_length: float) -> int:
    """Largest light size: compares enumerating subsets with scanning lists and verifying, over all sets."""
    best, total, at = 0.0, 0.0, 4
    for n in range(5, LIGHT_MOST + 1):
        enumerate_ = sum(comb(n, d) for d in range(n - need(n) + 1))
        scan = (n - need(n) + 1) * (1 + list_length) + n
        total += histogram.get(n, 0) * (enumerate_ - scan)
        if total <= best:
            best, at = total, n
    return at


_ENTRY = "token long, node long, size long"


def _first_rows(batches):
    """Batches (node, size, keys) less the rows whose node this task has seen: a copy's entries are sent once a task."""
    seen: set[int] = set()
    for b in batches:
        own = b.column(0).to_pylist()
        fresh = [not (x in seen or seen.add(x)) for x in own]
        yield b.filter(pa.array(fresh, pa.bool_()))


def _subsets(batches):
    for b in _first_rows(batches):
        tok, node, size = [], [], []
        for d, n, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            s = np.sort(np.frombuffer(x, np.uint64))
            for t in range(need(n), n + 1):
                for c in combinations(range(n), t):
                    tok.append(K.fold(s[list(c)], 100 + t))
                    node.append(d)
                    size.append(n * 64 + t)
        yield pa.RecordBatch.from_arrays([pa.array(tok, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int64())], names=["token", "node", "size"])


def _postings(batches):
    for b in _first_rows(K.small(batches)):
        node, size = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        keys = [np.frombuffer(x, np.uint64)[: n - need(n) + 1] for x, n in zip(b.column(2).to_pylist(), size.tolist(), strict=True)]
        count = [len(x) for x in keys]
        tok = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        place = np.minimum(np.concatenate([np.arange(c) for c in count]) if count else np.zeros(0, np.int64), PLACES - 1)
        yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(np.repeat(node, count), pa.int64()), pa.array(np.repeat(size.astype(np.int64), count) * PLACES + place, pa.int64())], names=["token", "node", "size"])


def _close(x, y, floor, ceil, least, most):
    """Whether sets that share a token, given size and place of the token in the global order, can be alike by it.

    With overlap o >= 4 (|x| + |y|) / 9 the sets share a token among the first
    |x| - o + 1 of the one and |y| - o + 1 of the other, and neither is under
    0.8 of the other's size.
    """
    nx, ny = floor(x / PLACES), floor(y / PLACES)
    px, py = x - nx * PLACES, y - ny * PLACES
    o = ceil((nx + ny) * 4 / 9 - 1e-9)
    return (5 * least(nx, ny) >= 4 * most(nx, ny)) & (px <= nx - o) & (py <= ny - o)


def _close_arrays(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _close(x, y, np.floor, np.ceil, np.minimum, np.maximum)


def _sets(k: int):
    def run(batches):
        for b in K.small(batches):
            raw, off = K.flat(b.column(0))
            for i, j in K.slices(off):
                sets = [s for s in K.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([K.fold(s, 1) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])

    return run


def _wide(batches):
    """Sets to bitmaps of 16 to 32 bits a shingle, which rule out nearly all pairs that are not alike."""
    for b in K.small(batches):
        sets = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(K.bitmaps(np.repeat(np.arange(len(n)), n), np.concatenate(sets), n, 16), pa.binary())], names=["node", "items"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _alike(batches):
    """Pairs whose sets have 5 * overlap >= 4 * union."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            o = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(o > 0 and 100 * o >= 80 * (len(x) + len(y) - o))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _beside(rows: DataFrame, pairs: DataFrame, key: str, other: str, items: DataFrame, as_: str, per_salt: int) -> DataFrame:
    """rows of pairs with the items of ``key``; a key in over ``per_salt`` pairs is dealt to several tasks, its items to each."""
    items = items.select(F.col("node").alias(key), F.col("items").alias(as_))
    hot = cut(pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / per_salt).alias("salts")).where("salts > 1"))
    if hot.isEmpty():
        return rows.join(items, key)
    hot, salts = bounded(hot), F.coalesce("salts", F.lit(1).cast("long"))
    rows = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts)).drop("salts")
    items = items.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return rows.join(items, [key, "salt"]).drop("salt")


def verified(pairs: DataFrame, items: DataFrame, test=_alike, per_salt: int = 1000) -> DataFrame:
    """Pairs (a, b), distinct and with lineage cut, that pass ``test`` on both sides' items; items (node, items) has a node once."""
    both = _beside(pairs, pairs, "a", "b", items, "x", per_salt)
    both = _beside(both, pairs, "b", "a", items, "y", per_salt)
    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def needed(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of docs whose key is among the ids of a column of that name."""
    return docs.join(bounded(cut(ids.select(key).distinct())), key, "left_semi")


def linked_rows(docs: DataFrame, id_col: str, text_col: str, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, the columns in ``keep``; and of rows that can link the
    smallest id with the same set (first_id), the component (comp) and the smallest id in it (lowest)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    freq = frequent_shingles(docs, "text", k)
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    prof = cut(docs.select("doc_id", "text", *keep).mapInArrow(_profile(k, freq), f"doc_id long, n_shingles long, node long, keys binary, outline binary{kept}"))
    same = prof.where("n_shingles > 0 and doc_id is not null")
    classes = cut(same.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles")))
    sized = same.select("node", F.col("n_shingles").cast("int").alias("size"), "keys")
    stats = {r[0]: r[1] for r in classes.where(f"n_shingles <= {LIGHT_MOST}").groupBy("n_shingles").count().collect()}
    entries, tokens = sized.where(F.col("size") <= LIGHT_MOST).mapInArrow(_postings, _ENTRY).agg(F.count(F.lit(1)), F.approx_count_distinct("token")).first()
    light = boundary(stats, entries / max(1, tokens))

    subsets = sized.where(F.col("size") <= light).mapInArrow(_subsets, _ENTRY)
    t, own, lead = F.pmod("size", F.lit(64)), F.floor(F.col("size") / 64), F.floor(F.col("leader_size") / 64)
    small = shared_lists(subsets, smallest_first=True).where((F.col("node") != F.col("leader")) & (5 * t >= 4 * (own + lead - t)))
    small = cut(small.select(F.col("leader").alias("a"), F.col("node").alias("b")))

    postings = sized.where(F.col("size") >= need(light + 1)).mapInArrow(_postings, _ENTRY)
    outlines = cut(same.groupBy("node").agg(F.min("outline").alias("items")))
    lists = cut(shared_lists(postings, close=_close_arrays))
    # the keys and the lists' shuffles are as large as the rest together, and not needed any more
    prof = cut(prof.drop("keys", "outline"))
    del same, sized, subsets, postings
    release(docs.sparkSession)

    def verify(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        pairs = cut(verified(pairs, outlines, K.may_be_alike))
        ids = classes.select("node", F.col("first_id").alias("doc_id")).join(bounded(cut(_ends(pairs))), "node", "left_semi")
        items = needed(docs, "doc_id", ids).select("text").mapInArrow(_sets(k), "node long, items binary")
        items = cut(items.groupBy("node").agg(F.min("items").alias("items")))
        release(docs.sparkSession)
        if (items.agg(F.avg(F.octet_length("items"))).first()[0] or 0) >= WIDE_FROM:
            pairs = cut(verified(pairs, cut(items.mapInArrow(_wide, "node long, items binary")), K.may_be_alike))
            items = items.join(bounded(cut(_ends(pairs))), "node", "left_semi")
        found = cut(verified(pairs, items))
        del items, ids, pairs
        release(docs.sparkSession)
        return found

    close = _close(F.col("size"), F.col("leader_size"), F.floor, F.ceil, F.least, F.greatest)
    comp = components(link_lists(lists, close, verify, lambda part: verify(cut(pairs_within(part, _close_arrays))), MANY).union(small))
    own = classes.select("node", "first_id")
    linked = own.join(bounded(comp), "node")
    lowest = linked.groupBy("comp").agg(F.min("first_id").alias("lowest"))
    label = own.join(linked.join(lowest, "comp").select("node", "comp", "lowest"), "node", "left")
    label = label.select("node", "first_id", F.coalesce("comp", "node").alias("comp"), F.coalesce("lowest", "first_id").alias("lowest"))
    can = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("node"))
    rows = prof.select("doc_id", "n_shingles", can.alias("own"), *keep)
    return rows.join(label, F.col("own") == F.col("node"), "left").drop("own", "node")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, class_id (smallest id with the same set)."""
    rows = linked_rows(docs, id_col, text_col, k)
    return rows.select("doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id"), F.coalesce("first_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """docs with one row of each component: the smallest id's (of rows that repeat it, the one with the smallest row key).

    Rows equal in id and text are one. Rows with a null id stay, and without
    words those that differ in id or text.
    """
    named = docs.where(F.col(id_col).isNotNull()).withColumn("_near_row", row_key(id_col, text_col))
    rows = cut(linked_rows(named, id_col, text_col, k, ("_near_row",)).select(F.col("doc_id").alias("_near_id"), "_near_row", "comp"))
    at = F.struct("_near_id", "_near_row")
    stay = rows.where("comp is not null").groupBy("comp").agg(F.min(at).alias("stay"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = rows.join(stay, "comp").where(at != F.col("stay")).select("_near_id", "_near_row").distinct()
    same = (F.col(id_col).cast("long") == F.col("_near_id")) & (named["_near_row"] == F.col("_twin_row"))
    as_twin = lambda d: bounded(cut(d.select("_near_id", F.col("_near_row").alias("_twin_row"))))
    out = named.join(as_twin(gone), same, "left_anti")
    twins = as_twin(rows.groupBy("_near_id", "_near_row").count().where("count > 1"))
    if not twins.isEmpty():
        out = out.join(twins, same, "left_anti").unionByName(out.join(twins, same, "left_semi").dropDuplicates([id_col, "_near_row"]))
    return out.drop("_near_row").unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)
