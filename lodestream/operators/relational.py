"""Composable operators: each takes a DataFrame and returns one, for use with DataFrame.transform.

They declare the logical step and leave join strategy, pushdown and pruning to
the optimizer. SQL semantics hold throughout, nulls included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count_star": lambda c: F.count(F.lit(1)),
    "count": F.count,
    "count_distinct": F.countDistinct,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "any": F.any_value,
    "approx_distinct": F.approx_count_distinct,
}
#: Rows of a block of join_greater; a block's rows lie in one array.
BLOCK = 512
JOINS = {"inner": "inner", "leftsemi": "left_semi", "leftouter": "left_outer", "leftanti": "left_anti", "rightouter": "right_outer", "fullouter": "full_outer"}


def selection(predicate: Column | str) -> Step:
    return lambda df: df.where(predicate)


def computed(name: str, expression: Column, kind: str | None = None) -> Step:
    """Append a column, cast to a declared type."""
    return lambda df: df.withColumn(name, expression.cast(kind) if kind else expression)


def project(*columns: Column | str) -> Step:
    return lambda df: df.select(*columns)


def rename(names: dict[str, str]) -> Step:
    return lambda df: df.withColumnsRenamed(names)


def join(right: DataFrame, on: Column | Sequence[str], kind: str = "inner") -> Step:
    """Equi or general join; ``rightsemi`` and ``rightanti`` return the right side's rows."""
    if kind in ("rightsemi", "rightanti"):
        return lambda df: right.join(df, on, JOINS["left" + kind[5:]])
    return lambda df: df.join(right, on, JOINS[kind])


def _blocks(df: DataFrame, keys: Sequence[str], value: Column, side: str) -> DataFrame:
    """The rows of each key in the order of a value, in arrays of at most BLOCK, with the number, size and bounds of each."""
    row = [F.struct(value.alias("v"), F.struct("*").alias("row")).alias("e")]
    at = [f"{side}_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, at, strict=True)], *row).where("e.v is not null")
    # The whole row breaks ties, so that a task that runs again makes the same blocks.
    number = F.floor((F.row_number().over(Window.partitionBy(*at).orderBy("e")) - 1) / BLOCK).alias(f"{side}_no")
    block = {"size": F.count(F.lit(1)), "low": F.min("e.v"), "high": F.max("e.v"), "rows": F.collect_list("e")}
    return rows.select("*", number).groupBy(*at, f"{side}_no").agg(*[made.alias(f"{side}_{name}") for name, made in block.items()])


def join_greater(right: DataFrame, equal: Sequence[tuple[str, str]], value: Column, bound: Column) -> Step:
    """Inner join on equal columns (left, right) and the left's value > the right's bound, for few keys of many rows.

    Blocks of a key meet only where some value can exceed some bound, so the work follows the rows in
    and out, not all pairs of a key. A first job counts the pairs to try; the tasks that try them grow
    with its root, as the input does. Columns must have an order; value and bound are both numbers or of one type.
    """

    def step(left: DataFrame) -> DataFrame:
        a, b = _blocks(left, [l for l, _ in equal], value, "l"), _blocks(right, [r for _, r in equal], bound, "r")
        same = [F.col(f"l_k{i}") == F.col(f"r_k{i}") for i in range(len(equal))]
        met = a.join(b, [*same, F.col("l_high") > F.col("r_low")])
        tries = met.agg(F.sum(F.col("l_size").cast("double") * F.col("r_size"))).first()[0] or 0
        parts = max(1, ceil(sqrt(tries) / 128))
        dealt = met.repartition(parts, *[f"l_k{i}" for i in range(len(equal))], "l_no", "r_no")
        pairs = dealt.select(F.explode("l_rows").alias("l"), "r_rows").select("l", F.explode("r_rows").alias("r"))
        return pairs.where("l.v > r.v").select("l.row.*", "r.row.*")

    return step


def with_scalar(single: DataFrame) -> Step:
    """Append the columns of a one-row aggregate to every row; more than one row fails the query."""
    named = [F.first(c).alias(c) for c in single.columns]
    checked = single.agg(*named, F.assert_true(F.count(F.lit(1)) <= 1, F.lit("scalar subquery has several rows")).alias("_ok"))
    return lambda df: df.join(F.broadcast(checked.where(F.col("_ok").isNull()).drop("_ok")))


def aggregate(keys: Sequence[Column | str], **columns: tuple[str, Column | None]) -> Step:
    """Group by keys (none: one row over everything); columns are name=(aggregate, input)."""
    made = [AGGREGATES[f](c).alias(name) for name, (f, c) in columns.items()]
    return lambda df: df.groupBy(*keys).agg(*made) if keys else df.agg(*made)


def distinct(*columns: str) -> Step:
    return lambda df: df.select(*columns).distinct() if columns else df.distinct()


def _order(column: str, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """A sort key; where nulls go is Spark's default (first ascending, last descending) unless said."""
    c = F.col(column)
    if nulls_first is None:
        return c.desc() if descending else c.asc()
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def sort(*keys: tuple) -> Step:
    """keys are (column, descending) or (column, descending, nulls first)."""
    return lambda df: df.orderBy(*[_order(*k) for k in keys])


def limit(k: int, offset: int = 0) -> Step:
    """k rows after the first ``offset``, in the order that the input has."""
    return lambda df: df.offset(offset).limit(k) if offset else df.limit(k)


def top_k(k: int, *keys: tuple, offset: int = 0) -> Step:
    """First k rows of the order, after ``offset``; runs as a bounded heap in each task."""
    return lambda df: df.transform(sort(*keys)).transform(limit(k, offset))
