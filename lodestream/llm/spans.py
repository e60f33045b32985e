"""Match spans with code point positions, from built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import let

EMPTY = "array<struct<s:int,e:int,v:string>>"
#: Arrays up to this length are folded or compared plainly; in longer ones work stays in proportion to the length.
FEW = 64


def running(values: Column, zero: Column, op) -> Column:
    """What op makes of zero and all values before each one, in order; two levels, so that no fold grows a long array."""
    blocks = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FEW).cast("int")))
    totals = F.coalesce(F.transform(blocks, lambda b: F.aggregate(F.slice(values, b * FEW + 1, F.lit(FEW)), zero, op)), F.array().cast("array<int>"))
    before = F.aggregate(totals, F.array(zero), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))

    def each(before: Column) -> Column:
        block = lambda i: F.floor(i / FEW).cast("int")
        return F.transform(values, lambda v, i: F.aggregate(F.slice(values, block(i) * FEW + 1, i % FEW), F.get(before, block(i)), op))

    return let(before, each)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,v>> of the leftmost non-overlapping matches of a pattern that never matches empty.

    Starts are running sums over the pieces between matches; texts without a
    match stop after the one search.
    """

    def place(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        reach = F.zip_with(gaps, hits, lambda gap, v: F.length(gap) + F.length(v))
        before = let(reach, lambda r: running(r, F.lit(0), lambda a, x: a + x))
        return F.transform(F.arrays_zip(before.alias("b"), gaps.alias("g"), hits.alias("v")), lambda x: F.struct((x["b"] + F.length(x["g"])).alias("s"), (x["b"] + F.length(x["g"]) + F.length(x["v"])).alias("e"), x["v"].alias("v")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, F.array().cast(EMPTY)).otherwise(place(hits)))


def every_match(text: Column, pattern: str) -> Column:
    """array<struct<s,e,v>> of the match at every start, so overlapping ones too, of a pattern without groups that never matches empty."""

    def place(hits: Column) -> Column:
        # A cut before each start; none is made before the first character.
        pieces = F.split(text, f"(?={pattern})", -1)
        ends = let(pieces, lambda p: F.struct(let(F.transform(p, lambda x: F.length(x)), lambda n: F.concat(running(n, F.lit(0), lambda a, x: a + x))).alias("at"), (F.size(p) - F.size(hits)).alias("skip")))
        starts = let(ends, lambda x: F.slice(x["at"], x["skip"] + 1, F.size(hits)))
        return F.zip_with(starts, hits, lambda s, v: F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v")))

    return let(F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)), lambda hits: F.when(F.size(hits) == 0, F.array().cast(EMPTY)).otherwise(place(hits)))


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def apart(x: Column, others: Column) -> Column:
    """True where span x overlaps none of the others."""
    return ~F.exists(others, lambda o: (o["s"] < x["e"]) & (x["s"] < o["e"]))


def clear_of(found: Column, others: Column) -> Column:
    """Spans of ``found`` that overlap none of the others, in their order."""

    def sorted_(both: Column) -> Column:
        # of others that begin at or before a span, the furthest end; of those that begin behind it, the nearest start
        ends = F.transform(both, lambda x: F.when(x["own"] == 0, x["e"]).otherwise(-1))
        starts = F.transform(F.reverse(both), lambda x: F.when(x["own"] == 0, x["s"]).otherwise(LAST))
        furthest = let(ends, lambda a: running(a, F.lit(-1), lambda p, q: F.greatest(p, q)))
        nearest = F.reverse(let(starts, lambda a: running(a, F.lit(LAST), lambda p, q: F.least(p, q))))
        rows = F.arrays_zip(both.alias("x"), furthest.alias("f"), nearest.alias("n"))
        kept = F.filter(rows, lambda r: (r["x"]["own"] == 1) & (r["f"] <= r["x"]["s"]) & (r["n"] >= r["x"]["e"]))
        # back in the order of found, which may be another one than by start and end
        return F.transform(F.sort_array(F.transform(kept, lambda r: r["x"]["i"])), lambda i: F.get(found, i))

    def tagged(spans: Column) -> Column:
        return F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x["e"].alias("e"), i.alias("i")))

    none = F.filter(found, lambda x: F.lit(False))
    stand_in = F.transform(others, lambda o: F.struct(o["s"].alias("s"), F.lit(0).alias("own"), o["e"].alias("e"), F.lit(-1).alias("i")))
    many = let(F.sort_array(F.concat(stand_in, tagged(found))), sorted_)
    return F.when(F.size(found) == 0, none).when(F.size(others) <= FEW, F.filter(found, lambda x: apart(x, others))).otherwise(many)


#: Behind every place of a text.
LAST = (1 << 31) - 1


def overlapping_runs(found: Column) -> Column:
    """Spans sorted by start, as an array of arrays in which spans of different arrays don't overlap."""

    def cut(spans: Column) -> Column:
        ends = F.transform(spans, lambda x: x["e"])
        furthest = let(ends, lambda a: running(a, F.lit(0), lambda p, q: F.greatest(p, q)))
        begins = let(furthest, lambda f: F.filter(F.transform(spans, lambda x, i: F.when((i == 0) | (F.get(f, i) <= x["s"]), i)), lambda i: i.isNotNull()))
        return let(begins, lambda b: F.transform(b, lambda i, k: F.slice(spans, i + 1, F.coalesce(F.get(b, k + 1), F.size(spans)) - i)))

    return F.when(F.size(found) <= 1, F.transform(found, lambda x: F.array(x))).otherwise(let(found, cut))
