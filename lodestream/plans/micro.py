"""One small query for each operator, by the DataFrame operators, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import case, exact_sum, in_tuples, money, simple_case
from ..operators import relational as R
from ..sources.catalog import table
from ..sources.ingest import chunk_metadata

QUERIES: dict = {}
ORACLE_SQL: dict = {}
c = F.col


def _q(tables: str, sql: str | None):
    """Register a function of the named tables under its own name."""

    def wrap(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, f"{sf_dir}/{t}.parquet") for t in tables.split()])

        QUERIES[f.__name__] = query
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


@_q("nation", "select n_name, n_nationkey from nation")
def scan_project(t):
    return t.transform(R.project("n_name", "n_nationkey"))


@_q("orders", "select o_orderkey, o_totalprice from orders where o_totalprice >= 100000 and o_orderstatus = 'F'")
def filter_compare(t):
    return t.transform(R.selection((c("o_totalprice") >= 100000) & (c("o_orderstatus") == "F"))).transform(R.project("o_orderkey", "o_totalprice"))


@_q("orders", "select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F'")
def filter_neq(t):
    return t.transform(R.selection(c("o_orderstatus") != "F")).select("o_orderkey", "o_orderstatus")


@_q("part", "select p_partkey, p_type from part where p_type < 'MEDIUM' or p_type >= 'SMALL'")
def string_compare(t):
    return t.transform(R.selection((c("p_type") < "MEDIUM") | (c("p_type") >= "SMALL"))).select("p_partkey", "p_type")


@_q("lineitem", "select l_orderkey, l_linenumber, l_partkey from lineitem where (l_returnflag = 'A' or l_linestatus = 'O') and not (l_quantity < 10)")
def bool_and_or_not(t):
    return t.transform(R.selection(((c("l_returnflag") == "A") | (c("l_linestatus") == "O")) & ~(c("l_quantity") < 10))).select("l_orderkey", "l_linenumber", "l_partkey")


@_q("part", "select p_partkey, p_size from part where p_size between 10 and 20")
def between(t):
    return t.transform(R.selection(c("p_size").between(10, 20))).select("p_partkey", "p_size")


@_q("part", "select p_partkey from part where p_size in (1, 7, 19)")
def in_list(t):
    return t.transform(R.selection(c("p_size").isin(1, 7, 19))).select("p_partkey")


@_q("orders", "select o_orderkey from orders where (o_orderstatus, o_orderpriority) in (('F', '1-URGENT'), ('O', '5-LOW'))")
def in_tuple_list(t):
    return t.transform(R.selection(in_tuples([c("o_orderstatus"), c("o_orderpriority")], [("F", "1-URGENT"), ("O", "5-LOW")]))).select("o_orderkey")


@_q("part", "select p_partkey, p_name from part where p_name like 'red%'")
def like_prefix(t):
    return t.transform(R.selection(c("p_name").like("red%"))).select("p_partkey", "p_name")


@_q("part", "select p_partkey, p_name from part where p_name like '%ring'")
def like_suffix(t):
    return t.transform(R.selection(c("p_name").like("%ring"))).select("p_partkey", "p_name")


@_q("part", "select p_partkey, p_name from part where p_name like '%e%g%' and p_name not like '_e%'")
def like_general(t):
    return t.transform(R.selection(c("p_name").like("%e%g%") & ~c("p_name").like("_e%"))).select("p_partkey", "p_name")


@_q("part", "select p_partkey from part where contains(p_name, 'in') and starts_with(p_name, 's')")
def contains_startswith(t):
    return t.transform(R.selection(c("p_name").contains("in") & c("p_name").startswith("s"))).select("p_partkey")


@_q("lineitem", "select l_orderkey, l_linenumber, l_partkey, l_quantity * 2 + 1 as a, l_extendedprice / 4 as b, l_linenumber - 3 as d from lineitem")
def map_arith(t):
    t = t.transform(R.computed("a", c("l_quantity") * 2 + 1)).transform(R.computed("b", c("l_extendedprice") / 4)).transform(R.computed("d", c("l_linenumber") - 3, "int"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "a", "b", "d")


@_q("lineitem", "select l_orderkey, l_partkey, cast(l_linenumber + l_suppkey as bigint) as wide, l_linenumber * l_tax as mixed, cast(l_quantity as int) as whole from lineitem")
def implicit_cast(t):
    return t.select("l_orderkey", "l_partkey", (c("l_linenumber") + c("l_suppkey")).alias("wide"), (c("l_linenumber") * c("l_tax")).alias("mixed"), c("l_quantity").cast("int").alias("whole"))


@_q("part", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as class from part")
def case_searched(t):
    return t.select("p_partkey", case([(c("p_size") < 10, F.lit("small")), (c("p_size") < 30, F.lit("medium"))], F.lit("large")).alias("class"))


@_q("orders", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as code from orders")
def case_simple(t):
    return t.select("o_orderkey", simple_case(c("o_orderstatus"), [(F.lit("F"), F.lit(1)), (F.lit("O"), F.lit(2))], F.lit(0)).alias("code"))


@_q("orders", "select o_orderkey, cast(extract(year from o_orderdate) as int) as y from orders")
def extract_year(t):
    return t.select("o_orderkey", F.year("o_orderdate").alias("y"))


@_q("orders", "select o_orderkey from orders where cast(o_orderdate as date) >= date '1996-01-01' and cast(o_orderdate as date) < date '1996-01-01' + interval 3 month")
def date_interval(t):
    day = F.lit("1996-01-01").cast("date")
    return t.transform(R.selection((c("o_orderdate").cast("date") >= day) & (c("o_orderdate").cast("date") < F.add_months(day, 3)))).select("o_orderkey")


@_q("nation region", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def join_inner(n, r):
    return n.transform(R.join(r, n.n_regionkey == r.r_regionkey)).select("n_name", "r_name")


@_q("customer supplier", "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and c_custkey = s_suppkey")
def join_two_keys(a, b):
    return a.transform(R.join(b, (a.c_nationkey == b.s_nationkey) & (a.c_custkey == b.s_suppkey))).select("c_custkey", "s_suppkey")


@_q("customer supplier", "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and c_acctbal > s_acctbal + 9000")
def join_residual(a, b):
    a, b = a.select("c_custkey", "c_nationkey", "c_acctbal"), b.select("s_suppkey", "s_nationkey", "s_acctbal")
    return a.transform(R.join_greater(b, [("c_nationkey", "s_nationkey")], c("c_acctbal"), c("s_acctbal") + 9000)).select("c_custkey", "s_suppkey")


@_q("customer orders", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def join_semi(a, o):
    return a.transform(R.join(o.where("o_totalprice > 400000"), a.c_custkey == o.o_custkey, "leftsemi")).select("c_custkey")


@_q("customer orders", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_anti(a, o):
    return a.transform(R.join(o.where("o_totalprice > 300000"), a.c_custkey == o.o_custkey, "leftanti")).select("c_custkey")


@_q("customer orders", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 450000")
def join_left_outer(a, o):
    return a.transform(R.join(o.where("o_totalprice > 450000"), a.c_custkey == o.o_custkey, "leftouter")).select("c_custkey", "o_orderkey")


@_q("supplier nation", "select n_name from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 5000)")
def join_right_anti(s, n):
    return s.where("s_acctbal > 5000").transform(R.join(n, s.s_nationkey == n.n_nationkey, "rightanti")).select("n_name")


@_q("customer", "select c_custkey from customer where c_acctbal > (select max(c_acctbal) * 0.99e0 from customer)")
def scalar_subquery(t):
    top = t.transform(R.aggregate([], m=("max", c("c_acctbal"))))
    return t.transform(R.with_scalar(top)).where(c("c_acctbal") > c("m") * 0.99).select("c_custkey")


@_q("lineitem", "select l_returnflag, count(*) as n, cast(sum(l_linenumber) as bigint) as s, min(l_shipdate) as lo, max(l_quantity) as hi, avg(l_linenumber) as mean from lineitem group by l_returnflag")
def agg_basic(t):
    return t.transform(R.aggregate(["l_returnflag"], n=("count_star", None), s=("sum", c("l_linenumber")), lo=("min", c("l_shipdate")), hi=("max", c("l_quantity")), mean=("avg", c("l_linenumber"))))


@_q("nation", "select n_nationkey, any_value(n_name) as name from nation group by n_nationkey")
def agg_any(t):
    return t.transform(R.aggregate(["n_nationkey"], name=("any", c("n_name"))))


@_q("lineitem", "select count(*) as n, cast(sum(cast(l_extendedprice as decimal(15,2))) as double) as total from lineitem")
def agg_global(t):
    return t.agg(F.count(F.lit(1)).alias("n"), exact_sum(money(c("l_extendedprice"))).alias("total"))


@_q("lineitem", "select count(*) as n, sum(l_quantity) as total from lineitem where l_quantity < 0")
def agg_global_empty(t):
    return t.where("l_quantity < 0").transform(R.aggregate([], n=("count_star", None), total=("sum", c("l_quantity"))))


@_q("orders", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15")
def having(t):
    return t.transform(R.aggregate(["o_custkey"], n=("count_star", None))).transform(R.selection("n > 15"))


@_q("orders", "select cast(extract(year from o_orderdate) as int) as y, count(*) as n from orders group by 1")
def group_expression(t):
    return t.transform(R.aggregate([F.year("o_orderdate").alias("y")], n=("count_star", None)))


@_q("lineitem", "select distinct l_returnflag, l_linestatus from lineitem")
def distinct(t):
    return t.transform(R.distinct("l_returnflag", "l_linestatus"))


@_q("lineitem", "select l_returnflag, count(distinct l_suppkey) as n, count(l_suppkey) as m from lineitem group by l_returnflag")
def count_distinct(t):
    return t.transform(R.aggregate(["l_returnflag"], n=("count_distinct", c("l_suppkey")), m=("count", c("l_suppkey"))))


@_q("supplier", "select s_nationkey, s_suppkey, s_acctbal from supplier order by s_nationkey, s_acctbal desc, s_suppkey")
def sort_multi(t):
    return t.transform(R.sort(("s_nationkey", False), ("s_acctbal", True), ("s_suppkey", False))).select("s_nationkey", "s_suppkey", "s_acctbal")


@_q("orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(t):
    return t.transform(R.top_k(25, ("o_totalprice", True), ("o_orderkey", False))).select("o_orderkey", "o_totalprice")


@_q("nation", "select n_name as name, n_regionkey as region from nation")
def rename(t):
    return t.transform(R.rename({"n_name": "name", "n_regionkey": "region"})).select("name", "region")


@_q("lineitem", "select l_returnflag, true as within from lineitem group by l_returnflag")
def approx_distinct(t):
    """The estimate is within a tenth of the exact count (its standard error is a twentieth)."""
    both = t.transform(R.aggregate(["l_returnflag"], n=("approx_distinct", c("l_orderkey")), exact=("count_distinct", c("l_orderkey"))))
    return both.select("l_returnflag", (F.abs(c("n") - c("exact")) <= 0.1 * c("exact")).alias("within"))


@_q("orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 30")
def limit_offset(t):
    return t.transform(R.top_k(10, ("o_totalprice", True), ("o_orderkey", False), offset=30)).select("o_orderkey", "o_totalprice")


@_q("part", "select p_partkey, case when p_size > 25 then p_size end as big from part order by big asc nulls last, p_partkey limit 40")
def nulls_last(t):
    return t.select("p_partkey", F.when(c("p_size") > 25, c("p_size")).alias("big")).transform(R.top_k(40, ("big", False, False), ("p_partkey", False)))


@_q("part", "select p_partkey, case when p_size > 2 then p_size end as big from part order by big desc nulls first, p_partkey desc limit 40")
def nulls_first(t):
    return t.select("p_partkey", F.when(c("p_size") > 2, c("p_size")).alias("big")).transform(R.top_k(40, ("big", True, True), ("p_partkey", True)))


@_q("supplier customer", "select s_suppkey, c_custkey from supplier right join customer on c_custkey = s_suppkey and s_acctbal > 0")
def join_right_outer(s, cu):
    return s.transform(R.join(cu, (cu.c_custkey == s.s_suppkey) & (s.s_acctbal > 0), "rightouter")).select("s_suppkey", "c_custkey")


@_q("supplier customer", "select s_suppkey, c_custkey from supplier full join customer on c_custkey = s_suppkey + 5 and c_acctbal > s_acctbal")
def join_full_outer(s, cu):
    return s.transform(R.join(cu, (cu.c_custkey == s.s_suppkey + 5) & (cu.c_acctbal > s.s_acctbal), "fullouter")).select("s_suppkey", "c_custkey")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file of a table by its footer."""
    return chunk_metadata(spark, f"{sf_dir}/orders.parquet").select("object_key", "num_rows")


QUERIES["chunk_rows"] = chunk_rows
ORACLE_SQL["chunk_rows"] = "select 'orders.parquet' as object_key, count(*) as num_rows from orders"
