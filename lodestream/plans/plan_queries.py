"""Queries given as JSON logical plans, against the SQL of the same queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import EPOCH_JULIAN_DAY, register
from . import tpch
from .planfront import Translator

MONEY = {"type": "numeric", "precision": 15, "scale": 2}


def ref(iu: str) -> dict:
    return {"expression": "iuref", "iu": iu}


def iu(name: str, kind: str = "double") -> dict:
    return {"iu": name, "type": {"type": kind}}


def const(kind: str, value, **more) -> dict:
    return {"expression": "const", "value": {"type": {"type": kind, **more}, "value": value}}


def day(days: int) -> dict:
    """A date by its days since 1970."""
    return const("date", days + EPOCH_JULIAN_DAY)


def binary(op: str, left: dict, right: dict) -> dict:
    return {"expression": op, "left": left, "right": right}


def compare(direction: str, left: dict, right: dict) -> dict:
    return {"expression": "compare", "direction": direction, "left": left, "right": right}


def both(*conditions: dict) -> dict:
    return {"expression": "and", "input": list(conditions)}


def money(name: str) -> dict:
    return {"expression": "cast", "input": ref(name), "type": MONEY}


def double(value: dict) -> dict:
    return {"expression": "cast", "input": value, "type": {"type": "double"}}


def scan(table: str, columns: dict[str, str], restrictions=(), residuals=(), prefix: str = "") -> dict:
    attributes = [{"name": c, "iu": iu(prefix + c, kind)} for c, kind in columns.items()]
    return {"operator": "tablescan", "tablename": table, "attributes": attributes, "restrictions": list(restrictions), "residuals": list(residuals), "cardinality": 1}


def join(left: dict, right: dict, *conditions: dict, kind: str = "inner") -> dict:
    return {"operator": "join", "type": kind, "left": left, "right": right, "condition": both(*conditions) if len(conditions) > 1 else conditions[0]}


def equal(a: str, b: str) -> dict:
    return compare("=", ref(a), ref(b))


def q06() -> dict:
    columns = {"l_shipdate": "date", "l_discount": "double", "l_quantity": "double", "l_extendedprice": "double"}
    restrictions = [
        {"mode": ">=", "attribute": 0, "value": day(9496)},
        {"mode": "<", "attribute": 0, "value": day(9862)},
        {"mode": "<", "attribute": 2, "value": const("numeric", 2400, precision=4, scale=2)},
        {"mode": "expression", "value": {"expression": "between", "input": [money("l.l_discount"), const("numeric", 5, precision=2, scale=2), const("numeric", 7, precision=2, scale=2)]}},
    ]
    rows = scan("lineitem", columns, restrictions, prefix="l.")
    rows = {"operator": "map", "input": rows, "values": [{"iu": iu("map.amount", "numeric"), "exp": binary("mul", money("l.l_extendedprice"), money("l.l_discount"))}]}
    total = {"operator": "groupby", "input": rows, "key": [], "values": [ref("map.amount")], "aggregates": [{"op": "sum", "arg": 0, "iu": iu("gb.revenue", "numeric")}]}
    return {"plan": total, "output": [{"name": "revenue", "iu": double(ref("gb.revenue"))}]}


def q09() -> dict:
    part = scan("part", {"p_partkey": "bigint", "p_name": "text"}, residuals=[{"expression": "contains", "input": [ref("p_name"), const("text", "ring")]}])
    rows = join(part, scan("lineitem", dict.fromkeys(("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount"), "double")), equal("p_partkey", "l_partkey"))
    rows = join(rows, scan("supplier", {"s_suppkey": "bigint", "s_nationkey": "integer"}), equal("s_suppkey", "l_suppkey"))
    rows = join(rows, scan("partsupp", {"ps_partkey": "bigint", "ps_suppkey": "bigint", "ps_supplycost": "numeric"}), equal("ps_partkey", "l_partkey"), equal("ps_suppkey", "l_suppkey"))
    rows = join(rows, scan("orders", {"o_orderkey": "bigint", "o_orderdate": "date"}), equal("o_orderkey", "l_orderkey"))
    rows = join(rows, scan("nation", {"n_nationkey": "integer", "n_name": "text"}), equal("n_nationkey", "s_nationkey"))
    price = binary("mul", money("l_extendedprice"), binary("sub", const("integer", 1), money("l_discount")))
    amount = binary("sub", price, binary("mul", ref("ps_supplycost"), money("l_quantity")))
    year = {"expression": "extractyear", "input": ref("o_orderdate")}
    profit = {
        "operator": "groupby",
        "input": rows,
        "values": [ref("n_name"), year, amount],
        "key": [{"iu": iu("gb.nation", "text"), "arg": 0}, {"iu": iu("gb.year", "integer"), "arg": 1}],
        "aggregates": [{"op": "sum", "arg": 2, "iu": iu("gb.sum", "numeric")}],
    }
    ordered = {"operator": "sort", "input": profit, "order": [{"value": ref("gb.nation")}, {"value": ref("gb.year"), "descending": True}]}
    return {"plan": ordered, "output": [{"name": "nation", "iu": ref("gb.nation")}, {"name": "o_year", "iu": ref("gb.year")}, {"name": "sum_profit", "iu": double(ref("gb.sum"))}]}


def q12() -> dict:
    columns = {"l_orderkey": "bigint", "l_shipmode": "text", "l_commitdate": "date", "l_receiptdate": "date", "l_shipdate": "date"}
    modes = {"expression": "in", "input": [ref("l_shipmode")], "values": [const("text", x)["value"] for x in ("MAIL", "SHIP")]}
    restrictions = [{"mode": "[]", "attribute": 3, "value": day(9496), "upper": day(9861)}, {"mode": "expression", "value": modes}]
    late = [compare("<", ref("l_commitdate"), ref("l_receiptdate")), compare("<", ref("l_shipdate"), ref("l_commitdate"))]
    rows = join(scan("orders", {"o_orderkey": "bigint", "o_orderpriority": "text"}), scan("lineitem", columns, restrictions, late), equal("o_orderkey", "l_orderkey"))
    high = {"expression": "or", "input": [compare("=", ref("o_orderpriority"), const("text", x)) for x in ("1-URGENT", "2-HIGH")]}
    one, none = const("integer", 1), const("integer", 0)
    counted = [{"expression": "searchedcase", "cases": [{"condition": c, "result": one}], "else": none} for c in (high, {"expression": "not", "input": high})]
    rows = {"operator": "earlyexecution", "input": rows, "mapping": {"mapping": [{"key": "l_shipmode", "value": "early.mode"}]}}
    lines = {
        "operator": "groupby",
        "input": rows,
        "values": [ref("early.mode"), *counted],
        "key": [{"iu": iu("gb.mode", "text"), "arg": 0}],
        "aggregates": [{"op": "sum", "arg": i, "iu": iu(f"gb.n{i}", "bigint")} for i in (1, 2)],
    }
    ordered = {"operator": "sort", "input": lines, "order": [{"value": ref("gb.mode")}]}
    return {"plan": ordered, "output": [{"name": "l_shipmode", "iu": ref("gb.mode")}, {"name": "high_line_count", "iu": ref("gb.n1")}, {"name": "low_line_count", "iu": ref("gb.n2")}]}


def q04() -> dict:
    """A semi join, and a simple case in place of the priority's name."""
    late = [compare("<", ref("l_commitdate"), ref("l_receiptdate"))]
    lines = scan("lineitem", {"l_orderkey": "bigint", "l_commitdate": "date", "l_receiptdate": "date"}, residuals=late)
    orders = scan("orders", {"o_orderkey": "bigint", "o_orderdate": "date", "o_orderpriority": "text"})
    period = both(compare(">=", ref("o_orderdate"), day(9678)), compare("<", ref("o_orderdate"), day(9770)))
    rows = join({"operator": "select", "input": orders, "condition": period}, lines, equal("o_orderkey", "l_orderkey"), kind="leftsemi")
    count = {"operator": "groupby", "input": rows, "values": [ref("o_orderpriority")], "key": [{"iu": iu("gb.priority", "text"), "arg": 0}], "aggregates": [{"op": "countstar", "iu": iu("gb.n", "bigint")}]}
    ordered = {"operator": "sort", "input": count, "order": [{"value": ref("gb.priority")}], "limit": 5}
    return {"plan": ordered, "output": [{"name": "o_orderpriority", "iu": ref("gb.priority")}, {"name": "order_count", "iu": ref("gb.n")}]}


#: Tables that need the stand-in columns of the TPC-H suite, and its names for them.
STAND_INS = {"lineitem": "li", "part": "pt", "customer": "cu", "orders": "od", "supplier": "su", "partsupp": "partsupp"}


def _run(make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return Translator(lambda t: spark.sql(tpch.SPARK[STAND_INS[t]]) if t in STAND_INS else spark.table(t)).plan(make())

    return query


QUERIES = {f"plan_{f.__name__}": _run(f) for f in (q04, q06, q09, q12)}
ORACLE_SQL = {f"plan_{n}": tpch.ORACLE_SQL[f"tpch_{n}"] for n in ("q04", "q06", "q09", "q12")}
