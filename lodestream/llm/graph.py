"""Connected components and link discovery over inverted lists, both distributed."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut

#: Edges (16 bytes each) that one task may join; beyond, alternating stars do it over all tasks.
EDGES_A_TASK = 4_000_000
#: Members outside a list's largest component that one group holds, and others that it is held against.
BLOCK, CHUNK = 1024, 8192
#: Rounds of heads at most; they end when a round joins less than half of what was outside.
ROUNDS = 8


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of every node of the edges, sorted by node."""
    node, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y, p = at[: len(a)], at[len(a) :], np.arange(len(node))
    while True:
        low, high = np.minimum(p[x], p[y]), np.maximum(p[x], p[y])
        apart = low != high
        if not apart.any():
            return node, node[p]
        x, y = x[apart], y[apart]
        np.minimum.at(p, high[apart], low[apart])
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q


def _joined(whole: bool):
    """Edges to (a, b): each node of the task's edges with its root; folded as they come, so a task holds nodes and not edges."""

    def run(batches):
        a, b, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            more.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in more) > 1 << 20:
                a, b = roots(*(np.concatenate(v) for v in zip((a, b), *more, strict=True)))
                more = []
        a, b = roots(*(np.concatenate(v) for v in zip((a, b), *more, strict=True)))
        keep = slice(None) if whole else a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b) that has another neighbour; comp is the smallest node reachable.

    Every task first reduces its own edges to a forest. Up to ``EDGES_A_TASK``
    edges of these are joined in one task. More go through alternating large
    and small stars, with minima combined before shuffling and every step
    checkpointed to the shared folder. Self loops and repeated edges are
    harmless; an empty table gives an empty table.
    """
    kind = "a long, b long"
    e = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_joined(False), kind))
    if e.count() <= EDGES_A_TASK:
        return cut(e.coalesce(1).mapInArrow(_joined(True), kind).toDF("node", "comp"))
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


_LISTED = ["token", "node", "size", "leader", "leader_size", "more"]
LISTED = "token long, node long, size long, leader long, leader_size long, more boolean"


def _listed(token: np.ndarray, node: np.ndarray, size: np.ndarray, new: np.ndarray, close, first_more: bool, last_open: bool) -> pa.RecordBatch:
    """Rows of sorted entries, new where a list begins. A list of two is its second member's row, which is all its
    links need; so is a longer one in which ``close`` rules out every pair without the leader."""
    start = np.flatnonzero(new)
    n = np.diff(np.r_[start, len(token)])
    longer = n > 2
    for k in np.flatnonzero(longer & (n <= BLOCK)) if close else ():
        x = size[start[k] + 1 : start[k] + n[k]]
        longer[k] = (np.triu(close(x[:, None], x[None]), 1)).any()
    if first_more:
        longer[0] = True
    if last_open:
        longer[-1] = True
    lead, more = np.repeat(start, n), np.repeat(longer, n)
    i = np.flatnonzero(more | ~new)
    return pa.RecordBatch.from_arrays([pa.array(x[j]) for x, j in ((token, i), (node, i), (size, i), (node, lead[i]), (size, lead[i]), (more, i))], names=_LISTED)


def _runs(close, batches):
    """Sorted (token, node, size): each list of two or more, with its first member as leader, in one streaming pass."""
    held, sent = [np.zeros(0, np.int64)] * 3, False  # the open list: its first rows, or only the leader if that has been sent
    for b in batches:
        if not b.num_rows:
            continue
        token, node, size = (np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, b.columns, strict=True))
        once = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        token, node, size = token[once], node[once], size[once]
        new = np.r_[True, token[1:] != token[:-1]]
        last = np.flatnonzero(new)[-1]
        whole = sent if last == 0 else False  # whether the list that stays open has been sent from
        stop = len(token) if len(token) - last > 2 or whole else last
        if stop:
            out = _listed(token[:stop], node[:stop], size[:stop], new[:stop], close, sent, stop > last)
            yield out.slice(1) if sent else out
        sent = stop == len(token)
        held = [x[last : last + 1] if sent else x[last:] for x in (token, node, size)]
    if len(held[0]) == 2 and not sent:
        yield _listed(*held, np.array([True, False]), None, False, False)


def shared_lists(entries: DataFrame, smallest_first: bool = False, close=None) -> DataFrame:
    """Members of the inverted lists with at least two, and each list's leader: one shuffle, constant memory a list.

    The leader is the member with the smallest node, or of the smallest size.
    ``more`` is true in lists of three or more, unless ``close`` (of two arrays
    of sizes) rules out every pair without the leader; in others the leader has
    no row. Repeated entries are harmless.
    """
    e = entries.select(F.col("token").cast("long"), F.col("node").cast("long"), F.col("size").cast("long"))
    by = ["token", "size", "node"] if smallest_first else ["token", "node", "size"]
    return e.repartition("token").sortWithinPartitions(*by).mapInArrow(partial(_runs, close), LISTED)


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def labelled(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the lists that span several components: with own and largest component, the list's length, and how many are outside the largest."""
    comp = bounded(components(found))
    lab = cut(lists.select("token", "node", "size").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    per = lab.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return cut(lab.join(bounded(cut(main.select("token", F.col("m.comp").alias("main"), "total", (F.col("total") - F.col("m.n")).alias("out")))), "token"))


def groups(part: DataFrame, *more: str) -> DataFrame:
    """Rows of labelled() dealt to groups of bounded size in which every pair across components, one outside the largest, meets.

    A list's outside members are cut into blocks, its others into chunks; a
    group is a block (role 0) with a chunk, and later blocks count among the
    others. An ordinary list is one group, with each member once.
    """
    blocks, chunks = F.ceil(F.col("out") / BLOCK), F.ceil(F.col("total") / CHUNK)
    outside = F.col("comp") != F.col("main")
    own = F.pmod(F.xxhash64("node"), blocks)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.when(outside, own).otherwise(blocks - 1))).alias("block")
    rows = part.select("token", "node", "size", "comp", *more, outside.alias("outside"), own.alias("own"), chunks.alias("chunks"), block)
    held = F.col("outside") & (F.col("own") == F.col("block"))
    chunk = F.when(held, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))))
    rows = rows.select("token", "block", F.explode(chunk).alias("chunk"), F.when(held, 0).otherwise(1).alias("role"), "node", "size", "comp", *more)
    return dealt(rows)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of groups, each group together in one task, its block first."""
    return rows.repartition("token", "block", "chunk").sortWithinPartitions("token", "block", "chunk", "role", "size", "node")


def group_runs(batches):
    """(whether a group begins, chunk, role, batch) of each run of rows alike in these, of sorted groups()."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        cuts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, b.num_rows]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(key[:3, i].tolist())
            yield now != last, now[2], int(key[3, i]), b.slice(i, j - i)
            last = now


def _pairs_within(close):
    """Sorted groups to the pairs (a, b) across components that ``close`` (of two arrays of sizes) lets through."""

    def run(batches):
        held: list[np.ndarray] = []
        for begins, chunk, role, b in group_runs(batches):
            if begins:
                held = [np.zeros(0, np.int64)] * 3
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6)]
            for k in range(0, len(rows[0]), 1024):
                node, size, comp = (x[k : k + 1024] for x in rows)
                sides = [held]
                if role == 0:
                    held = [np.r_[x, y] for x, y in zip(held, (node, size, comp), strict=True)]
                    sides = [held] if chunk == 0 else []
                for on, os, oc in sides:
                    ok = (oc[:, None] != comp[None]) & close(os[:, None], size[None])
                    if role == 0:  # those that were held before, and in the new ones each pair once
                        new = len(on) - len(node)
                        ok[new:] &= np.tri(len(node), k=-1, dtype=bool).T
                    i, j = np.nonzero(ok)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(on[i], node[j])), pa.array(np.maximum(on[i], node[j]))], names=["a", "b"])

    return run


def pairs_within(part: DataFrame, close) -> DataFrame:
    """Distinct pairs (a, b) of members of one list in different components that ``close`` lets through."""
    return groups(part).mapInArrow(_pairs_within(close), "a long, b long").distinct()


def link_lists(lists: DataFrame, close: Column, verify, rest, many: int, tries: int = 4) -> DataFrame:
    """Links (a, b) within lists (of shared_lists or packed_lists, with lineage cut) that give the same components as all links between members of a list.

    First every member is held against its list's leader, which joins a large
    group of alike members in as many pairs as it has members. In lists that
    still have over ``many`` members outside the largest component, each of
    these is held against ``tries`` of its members, chosen by hash, in rounds that end
    when they join less than half. What still
    spans several components goes to ``rest``, which returns the links that
    are left between components of a list. A pair that is left out is thus
    already connected. ``close`` may rule out a member (size) and its leader
    (leader_size); ``verify`` maps distinct (a, b) to those linked.
    """
    star = cut(lists.where((F.col("node") != F.col("leader")) & close).select(*_pair("leader", "node")).distinct())
    found = cut(verify(star))
    longer = lists.where("more")
    part = labelled(longer, found)
    before = None
    for round_ in range(ROUNDS):
        large = cut(part.where(F.col("out") > many))
        outside = large.where("comp <> main").count()
        if not outside or (before is not None and 2 * outside > before):
            break
        before = outside
        seeds = range(round_ * tries, (round_ + 1) * tries)
        ask = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node")).alias(f"r{i}") for i in seeds]
        heads = large.where("comp = main").groupBy("token").agg(*ask).select("token", F.explode(F.array_distinct(F.array(*[f"r{i}.node" for i in seeds]))).alias("head"))
        some = large.where("comp <> main").select("token", "node").join(bounded(cut(heads)), "token")
        some = cut(some.select(*_pair("node", "head")).distinct().join(star, ["a", "b"], "left_anti"))
        found = cut(found.union(verify(some)))
        part = labelled(longer, found)
    return found.union(rest(part))
