"""JSON logical plans to DataFrames.

A plan is {"plan": operator, "output": [{"name", "iu": expression}]}, or what an
optimizer reports: {"optimizersteps": [...]} with that under "plan" of the step
``STEP``. An attribute instance (iu) is declared as {"iu": name, "type": {"type"}}
where an operator makes it, and referred to by {"expression": "iuref", "iu": name}.
Each has its own name, so two scans of one table never clash; names are made
safe for Spark by mapping other characters to underscores.

Operators: tablescan, select, map, join, groupby, sort (with limit),
earlyexecution. What isn't known raises ``PlanError`` with its name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import case, in_tuples, simple_case
from ..operators.relational import AGGREGATES, JOINS
from ..sources.catalog import EPOCH_JULIAN_DAY

#: Step of an optimizer's report that holds the physical order of operators.
STEP = 6


class PlanError(ValueError):
    """The plan has something that can't be translated."""


def safe(iu: str | dict) -> str:
    """Column name of an attribute instance, given as declared or by its name."""
    return re.sub(r"[^A-Za-z0-9_]", "_", iu["iu"] if isinstance(iu, dict) else iu)


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b,
}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
#: Names of the plan's types and what they are in Spark.
TYPES = {"integer": "int", "bigint": "bigint", "double": "double", "date": "date", "text": "string", "varchar": "string", "char": "string", "char1": "string", "bool": "boolean"}
AGGREGATE_OPS = {"countstar": "count_star", "count": "count", "sum": "sum", "min": "min", "max": "max", "avg": "avg", "any": "any"}


def spark_type(t: dict) -> str:
    """Spark's name of a type {"type", "precision", "scale"}."""
    kind = t["type"].lower()
    if kind in ("numeric", "bignumeric"):
        return f"decimal({t.get('precision', 38)},{t.get('scale', 0)})"
    if kind not in TYPES:
        raise PlanError(f"type {kind}")
    return TYPES[kind]


def constant(value: dict) -> Column:
    """A literal {"type", "value"}; numerics are value / 10**scale as exact decimals, dates Julian day numbers, char1 a code."""
    v, kind = value["value"], value["type"]["type"].lower()
    if v is None:
        return F.lit(None).cast(spark_type(value["type"]))
    if kind in ("numeric", "bignumeric"):
        return F.lit(Decimal(str(v)).scaleb(-value["type"].get("scale", 0)))
    if kind == "date" and isinstance(v, int):
        return F.date_add(F.lit("1970-01-01").cast("date"), F.lit(v - EPOCH_JULIAN_DAY))
    if kind == "char1" and isinstance(v, int):
        return F.lit(chr(v))
    return F.lit(v).cast(spark_type(value["type"]))


def _text(node: dict) -> str:
    if node["expression"] != "const":
        raise PlanError("a pattern must be constant")
    return node["value"]["value"]


def _in(node: dict) -> Column:
    """input: the columns of a tuple; values: constants, as many for each tuple as there are columns."""
    columns, values = [expression(x) for x in node["input"]], [constant(x) for x in node["values"]]
    if not values:
        return in_tuples(columns, [])
    rows = [values[i : i + len(columns)] for i in range(0, len(values), len(columns))]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [c == v for c, v in zip(columns, r, strict=True)]) for r in rows])


def _case(node: dict) -> Column:
    other = expression(node["else"]) if node.get("else") else None
    if node["expression"] == "searchedcase":
        return case([(expression(c["condition"]), expression(c["result"])) for c in node["cases"]], other)
    return simple_case(expression(node["input"]), [(expression(c["value"]), expression(c["result"])) for c in node["cases"]], other)


def _compare(node: dict) -> Column:
    if node["direction"] not in COMPARE:
        raise PlanError(f"comparison {node['direction']}")
    return COMPARE[node["direction"]](expression(node["left"]), expression(node["right"]))


EXPRESSIONS: dict[str, Callable[[dict], Column]] = {
    "iuref": lambda n: F.col(safe(n["iu"])),
    "const": lambda n: constant(n["value"]),
    "cast": lambda n: expression(n["input"]).cast(spark_type(n["type"])),
    "compare": _compare,
    "and": lambda n: reduce(lambda a, b: a & b, map(expression, n["input"])),
    "or": lambda n: reduce(lambda a, b: a | b, map(expression, n["input"])),
    "not": lambda n: ~expression(n["input"]),
    "isnull": lambda n: expression(n["input"]).isNull(),
    "between": lambda n: expression(n["input"][0]).between(expression(n["input"][1]), expression(n["input"][2])),
    "in": _in,
    "like": lambda n: expression(n["input"][0]).like(_text(n["input"][1])),
    "contains": lambda n: expression(n["input"][0]).contains(_text(n["input"][1])),
    "startswith": lambda n: expression(n["input"][0]).startswith(_text(n["input"][1])),
    "searchedcase": _case,
    "simplecase": _case,
    "extractyear": lambda n: F.year(expression(n["input"])),
}


def expression(node: dict) -> Column:
    kind = node["expression"]
    if kind in ARITHMETIC:
        return ARITHMETIC[kind](expression(node["left"]), expression(node["right"]))
    if kind not in EXPRESSIONS:
        raise PlanError(f"expression {kind}")
    return EXPRESSIONS[kind](node)


class Translator:
    """tables maps a table name to its DataFrame."""

    OPERATORS = ("tablescan", "select", "map", "join", "groupby", "sort", "earlyexecution")

    def __init__(self, tables: Callable[[str], DataFrame]):
        self.tables = tables

    def plan(self, root: dict) -> DataFrame:
        root = root["optimizersteps"][STEP]["plan"] if "optimizersteps" in root else root
        df = self.operator(root["plan"])
        return df.select(*[expression(o["iu"]).alias(o["name"]) for o in root["output"]])

    def operator(self, node: dict) -> DataFrame:
        if node["operator"] not in self.OPERATORS:
            raise PlanError(f"operator {node['operator']}")
        return getattr(self, "_" + node["operator"])(node)

    def _tablescan(self, n: dict) -> DataFrame:
        """Columns by their instance names; restrictions name an attribute by its place, residuals are expressions."""
        df = self.tables(n["tablename"]).select(*[F.col(a["name"]).alias(safe(a["iu"])) for a in n["attributes"]])
        for r in n.get("restrictions", []):
            mode, value = r["mode"], expression(r["value"])
            if mode == "expression":
                df = df.where(value)
                continue
            column = F.col(safe(n["attributes"][r["attribute"]]["iu"]))
            if mode == "[]":
                df = df.where((column >= value) & (column <= expression(r["upper"])))
            elif mode in COMPARE:
                df = df.where(COMPARE[mode](column, value))
            else:
                raise PlanError(f"restriction {mode}")
        return reduce(lambda d, e: d.where(expression(e)), n.get("residuals", []), df)

    def _select(self, n: dict) -> DataFrame:
        return self.operator(n["input"]).where(expression(n["condition"]))

    def _map(self, n: dict) -> DataFrame:
        return self.operator(n["input"]).withColumns({safe(v["iu"]): expression(v["exp"]) for v in n["values"]})

    def _earlyexecution(self, n: dict) -> DataFrame:
        return self.operator(n["input"]).withColumns({safe(m["value"]): F.col(safe(m["key"])) for m in n["mapping"]["mapping"]})

    def _join(self, n: dict) -> DataFrame:
        left, right = self.operator(n["left"]), self.operator(n["right"])
        on, kind = expression(n["condition"]), n["type"]
        if kind in ("rightsemi", "rightanti"):
            left, right, kind = right, left, "left" + kind[5:]
        kind = "leftouter" if kind == "singleton" else kind
        if kind not in JOINS:
            raise PlanError(f"join {kind}")
        return left.join(right, on, JOINS[kind])

    def _groupby(self, n: dict) -> DataFrame:
        df, values, made = self.operator(n["input"]), [expression(v) for v in n["values"]], []
        for a in n["aggregates"]:
            if a["op"] not in AGGREGATE_OPS:
                raise PlanError(f"aggregate {a['op']}")
            name = "count_distinct" if a["op"] == "count" and a.get("distinct") else AGGREGATE_OPS[a["op"]]
            made.append(AGGREGATES[name](values[a["arg"]] if "arg" in a else None).alias(safe(a["iu"])))
        keys = [values[k["arg"]].alias(safe(k["iu"])) for k in n["key"]]
        if not keys:
            return df.agg(*made)
        return df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()

    def _sort(self, n: dict) -> DataFrame:
        df = self.operator(n["input"])
        down = [o.get("descending", False) is not False for o in n["order"]]
        keys = [expression(o["value"]) for o in n["order"]]
        df = df.orderBy(*[k.desc() if d else k.asc() for k, d in zip(keys, down, strict=True)]) if keys else df
        return df.limit(n["limit"]) if n.get("limit") is not None else df
