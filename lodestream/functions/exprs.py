"""Column helpers where a plain expression is not one line."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_tuples(columns: Sequence[Column], rows: Sequence[Sequence]) -> Column:
    """(c1, c2, ...) in ((v1, v2, ...), ...) with SQL's null rules; false for no rows."""
    if not rows:
        return F.lit(False)
    each = (reduce(lambda a, b: a & b, (c == F.lit(v) for c, v in zip(columns, row, strict=True))) for row in rows)
    return reduce(lambda a, b: a | b, each)


def money(c: Column) -> Column:
    """A double amount as an exact decimal."""
    return c.cast("decimal(15,2)")


def exact_sum(c: Column) -> Column:
    """Sum of a decimal expression as a double: exact until the last step, so independent of order."""
    return F.sum(c).cast("double")


def exact_avg(c: Column) -> Column:
    return F.sum(c).cast("double") / F.count(c)


def case(branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Searched CASE."""
    out = reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def simple_case(value: Column, branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    return case([(value == k, v) for k, v in branches], otherwise)
