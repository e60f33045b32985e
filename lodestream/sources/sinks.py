"""Result sinks: a printer, and an assertion against expected rows."""

from __future__ import annotations

import datetime
import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame


def format_value(v) -> str:
    """Doubles with four decimals, dates as Y - M - D without padding, booleans as 0 or 1."""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.4f}"
    if isinstance(v, datetime.date):
        return f"{v.year} - {v.month} - {v.day}"
    return "" if v is None else str(v)


def print_rows(df: DataFrame, out=print) -> int:
    """Every row, two spaces between values; returns the row count. Rows stream to the driver a partition at a time."""
    n = 0
    for row in df.toLocalIterator():
        out("  ".join(map(format_value, row)))
        n += 1
    return n


def _same(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and b is not None:
        b = float(b)
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return a == b or math.isclose(a, b, rel_tol=tolerance, abs_tol=0.0)
    if isinstance(a, datetime.date) and isinstance(b, str):
        b = type(a).fromisoformat(b)
    return str(a) == str(b) if isinstance(b, str) else a == b


def assert_result(df: DataFrame, expected: dict[str, Sequence], tolerance: float = 0.01, ordered: bool = True) -> None:
    """Compare with columns of expected values; doubles within a relative tolerance, all else exactly."""
    names = list(expected)
    rows = [tuple(r) for r in df.select(*names).limit(len(next(iter(expected.values()), ())) + 1).collect()]
    want = list(zip(*expected.values(), strict=True))
    if len(rows) != len(want):
        raise AssertionError(f"expected {len(want)} rows, got {len(rows)} or more")
    if not ordered:
        rows, want = (sorted(x, key=lambda r: tuple(map(format_value, r))) for x in (rows, want))
    for i, (r, w) in enumerate(zip(rows, want, strict=True)):
        for name, a, b in zip(names, r, w, strict=True):
            if not _same(a, b, tolerance):
                raise AssertionError(f"row {i}, {name}: expected {b!r}, got {a!r}")


def golden(df: DataFrame) -> str:
    """The result as expected values for assert_result: JSON of column names with their values as text, in row order."""
    rows = df.collect()
    return json.dumps({c: [None if r[i] is None else str(r[i]) for r in rows] for i, c in enumerate(df.columns)}, indent=1)


def expected(text: str, df: DataFrame) -> dict[str, list]:
    """Values of golden() text, doubles as numbers by the types of df."""
    kinds = dict(df.dtypes)
    return {c: [float(v) if v is not None and kinds[c] in ("double", "float") else v for v in values] for c, values in json.loads(text).items()}
