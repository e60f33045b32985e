"""TPC-H queries as SQL over the catalog's views.

The driver's tables lack some TPC-H columns; the CTEs add deterministic
stand-ins by the same rule in both engines. The query bodies are fixed by the
benchmark's specification. Sums run over exact decimals and
become doubles at the end, so that results don't depend on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import TABLES, register


def money(c: str, digits: int = 15) -> str:
    return f"cast({c} as decimal({digits},2))"


# Prices under 10**9 and rates under 10: so many digits that products stay within 64 bits; larger values fail the query.
REVENUE = f"{money('l_extendedprice', 11)} * (1 - {money('l_discount', 3)})"


def _cte(add_days) -> dict[str, str]:
    ship = "cast(l_shipdate as date)"
    return {
        "li": f"""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, {ship} as l_shipdate,
  {add_days(ship, "(l_orderkey * 7 + l_linenumber) % 61 - 20")} as l_commitdate, {add_days(ship, "1 + (l_orderkey + l_partkey) % 30")} as l_receiptdate,
  case (l_orderkey + l_linenumber) % 7 when 0 then 'AIR' when 1 then 'AIR REG' when 2 then 'MAIL' when 3 then 'SHIP' when 4 then 'TRUCK' when 5 then 'RAIL' else 'FOB' end as l_shipmode,
  case l_linenumber % 4 when 0 then 'DELIVER IN PERSON' when 1 then 'COLLECT COD' when 2 then 'NONE' else 'TAKE BACK RETURN' end as l_shipinstruct from lineitem""",
        "pt": "select *, case p_partkey % 4 when 0 then 'SM CASE' when 1 then 'MED BOX' when 2 then 'LG BOX' else 'SM PKG' end as p_container from part",
        "cu": "select *, concat(cast(10 + c_nationkey as varchar(2)), '-', cast(c_custkey as varchar(20))) as c_phone from customer",
        "od": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) as o_orderdate, o_orderpriority, 0 as o_shippriority, case when o_orderkey % 10 = 0 then 'special packages requests' else 'regular deposits' end as o_comment from orders",
        "su": "select *, case when s_suppkey % 10 = 0 then 'Customer slow Complaints' else 'fine' end as s_comment from supplier",
        "partsupp": "select ps_partkey, ps_suppkey, (ps_partkey * 31 + ps_suppkey * 17) % 9999 + 1 as ps_availqty, cast(cast((ps_partkey * 13 + ps_suppkey * 7) % 100000 as decimal(9,0)) * cast(0.01 as decimal(3,2)) as decimal(15,2)) as ps_supplycost from (select distinct l_partkey as ps_partkey, l_suppkey as ps_suppkey from lineitem) d",
    }


SPARK = _cte(lambda d, n: f"date_add({d}, cast({n} as int))")
DUCK = _cte(lambda d, n: f"{d} + cast({n} as int)")

BODIES = {
    "q01": f"""select l_returnflag, l_linestatus, cast(sum({money("l_quantity")}) as double) as sum_qty, cast(sum({money("l_extendedprice")}) as double) as sum_base_price,
  cast(sum({REVENUE}) as double) as sum_disc_price, cast(sum({REVENUE} * (1 + {money("l_tax")})) as double) as sum_charge,
  cast(sum({money("l_quantity")}) as double) / count(*) as avg_qty, cast(sum({money("l_extendedprice")}) as double) / count(*) as avg_price, cast(sum({money("l_discount")}) as double) / count(*) as avg_disc, count(*) as count_order
from li where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
    "q02": """select s_acctbal, s_name, n_name, p_partkey, p_brand from pt, su, partsupp, nation, region
where p_partkey = ps_partkey and s_suppkey = ps_suppkey and p_size = 15 and p_type like '%ARD' and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'EUROPE'
  and ps_supplycost = (select min(ps_supplycost) from partsupp, su, nation, region where p_partkey = ps_partkey and s_suppkey = ps_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'EUROPE')
order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
    "q03": f"""select l_orderkey, cast(sum({REVENUE}) as double) as revenue, o_orderdate, o_shippriority from cu, od, li
where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1996-03-15' and l_shipdate > date '1996-03-15'
group by l_orderkey, o_orderdate, o_shippriority order by revenue desc, o_orderdate, l_orderkey limit 10""",
    "q04": """select o_orderpriority, count(*) as order_count from od where o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-10-01'
  and exists (select * from li where l_orderkey = o_orderkey and l_commitdate < l_receiptdate) group by o_orderpriority order by o_orderpriority""",
    "q05": f"""select n_name, cast(sum({REVENUE}) as double) as revenue from cu, od, li, su, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'
  and o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01' group by n_name order by revenue desc""",
    "q06": f"""select cast(sum({money("l_extendedprice")} * {money("l_discount")}) as double) as revenue from li
where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and {money("l_discount")} between 0.05 and 0.07 and l_quantity < 24""",
    "q07": f"""select supp_nation, cust_nation, l_year, cast(sum(volume) as double) as revenue from (
  select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as int) as l_year, {REVENUE} as volume from su, li, od, cu, nation n1, nation n2
  where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
    and ((n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2') or (n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1')) and l_shipdate between date '1995-01-01' and date '1996-12-31') shipping
group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year""",
    "q08": f"""select o_year, cast(sum(case when nation = 'NATION_1' then volume else 0 end) as double) / cast(sum(volume) as double) as mkt_share from (
  select cast(extract(year from o_orderdate) as int) as o_year, {REVENUE} as volume, n2.n_name as nation from pt, su, li, od, cu, nation n1, nation n2, region
  where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'AMERICA'
    and s_nationkey = n2.n_nationkey and o_orderdate between date '1995-01-01' and date '1996-12-31' and p_type = 'ECONOMY') all_nations
group by o_year order by o_year""",
    "q09": f"""select nation, o_year, cast(sum(amount) as double) as sum_profit from (
  select n_name as nation, cast(extract(year from o_orderdate) as int) as o_year, {REVENUE} - ps_supplycost * {money("l_quantity")} as amount from pt, su, li, (select * from partsupp where ps_partkey in (select p_partkey from part where p_name like '%ring%')) ps, od, nation
  where s_suppkey = l_suppkey and ps_suppkey = l_suppkey and ps_partkey = l_partkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%ring%') profit
group by nation, o_year order by nation, o_year desc""",
    "q10": f"""select c_custkey, c_name, cast(sum({REVENUE}) as double) as revenue, c_acctbal, n_name from cu, od, li, nation
where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01' and l_returnflag = 'R' and c_nationkey = n_nationkey
group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
    "q11": """select ps_partkey, cast(sum(ps_supplycost * ps_availqty) as double) as value from partsupp, su, nation where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_7'
group by ps_partkey having cast(sum(ps_supplycost * ps_availqty) as double) > (select cast(sum(ps_supplycost * ps_availqty) as double) * cast(0.001 as double) from partsupp, su, nation where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_7')
order by value desc, ps_partkey""",
    "q12": """select l_shipmode, cast(sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as bigint) as high_line_count,
  cast(sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as bigint) as low_line_count from od, li
where o_orderkey = l_orderkey and l_shipmode in ('MAIL', 'SHIP') and l_commitdate < l_receiptdate and l_shipdate < l_commitdate and l_receiptdate >= date '1996-01-01' and l_receiptdate < date '1997-01-01'
group by l_shipmode order by l_shipmode""",
    "q13": """select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from cu left outer join od on c_custkey = o_custkey and o_comment not like '%special%requests%' group by c_custkey) c_orders
group by c_count order by custdist desc, c_count desc""",
    "q14": f"""select cast(100 as double) * cast(sum(case when p_type like 'PROMO%' then {REVENUE} else 0 end) as double) / cast(sum({REVENUE}) as double) as promo_revenue from li, pt
where l_partkey = p_partkey and l_shipdate >= date '1996-09-01' and l_shipdate < date '1996-10-01'""",
    "q15": f"""select s_suppkey, s_name, cast(total_revenue as double) as total_revenue from su, (select l_suppkey as supplier_no, sum({REVENUE}) as total_revenue from li where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01' group by l_suppkey) r
where s_suppkey = supplier_no and total_revenue = (select max(t) from (select sum({REVENUE}) as t from li where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01' group by l_suppkey) x) order by s_suppkey""",
    "q16": """select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from partsupp, pt where p_partkey = ps_partkey and p_brand <> 'Brand#5' and p_type not like 'MED%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
  and not exists (select * from su where s_suppkey = ps_suppkey and s_comment like '%Customer%Complaints%') group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size""",
    "q17": f"""select cast(sum({money("l_extendedprice")}) as double) / cast(7 as double) as avg_yearly from li, pt where p_partkey = l_partkey and p_brand = 'Brand#23' and p_container = 'MED BOX'
  and l_quantity < (select cast(0.2 as double) * (cast(sum({money("l_quantity")}) as double) / count(*)) from li where l_partkey = p_partkey)""",
    "q18": f"""select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, cast(sum({money("l_quantity")}) as double) as sum_qty from cu, od, li
where o_orderkey in (select l_orderkey from li group by l_orderkey having sum({money("l_quantity")}) > 250) and c_custkey = o_custkey and o_orderkey = l_orderkey
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "q19": f"""select cast(sum({REVENUE}) as double) as revenue from li, pt
where (p_partkey = l_partkey and p_brand = 'Brand#12' and p_container in ('SM CASE', 'SM PKG') and l_quantity >= 1 and l_quantity <= 11 and p_size between 1 and 15 and l_shipmode in ('AIR', 'AIR REG') and l_shipinstruct = 'DELIVER IN PERSON')
   or (p_partkey = l_partkey and p_brand = 'Brand#23' and p_container in ('MED BOX') and l_quantity >= 10 and l_quantity <= 40 and p_size between 1 and 30 and l_shipmode in ('AIR', 'AIR REG', 'SHIP') and l_shipinstruct <> 'NONE')""",
    "q20": f"""select s_name, s_nationkey from su, nation where s_suppkey in (select ps_suppkey from partsupp where ps_partkey in (select p_partkey from pt where p_name like 'red%')
    and ps_availqty > (select cast(0.5 as double) * cast(sum({money("l_quantity")}) as double) from li where l_partkey = ps_partkey and l_suppkey = ps_suppkey and l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01'))
  and s_nationkey = n_nationkey and n_name = 'NATION_3' order by s_name""",
    "q21": """select s_name, count(*) as numwait from su, li l1, od, nation where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_receiptdate > l1.l_commitdate
  and exists (select * from li l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
  and not exists (select * from li l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_receiptdate > l3.l_commitdate)
  and s_nationkey = n_nationkey and n_name = 'NATION_1' group by s_name order by numwait desc, s_name limit 100""",
    "q22": f"""select cntrycode, count(*) as numcust, cast(sum({money("c_acctbal")}) as double) as totacctbal from (select substring(c_phone, 1, 2) as cntrycode, c_acctbal, c_custkey from cu
  where substring(c_phone, 1, 2) in ('13', '31', '23', '29', '30', '18', '17') and c_acctbal > (select cast(sum({money("c_acctbal")}) as double) / count(*) from cu where c_acctbal > 0.00 and substring(c_phone, 1, 2) in ('13', '31', '23', '29', '30', '18', '17'))
    and not exists (select * from od where o_custkey = c_custkey and o_orderdate < date '1995-06-01')) custsale group by cntrycode order by cntrycode""",
}


def _sql(name: str, cte: dict[str, str]) -> str:
    body = BODIES[name]
    used = [f"{k} as ({v})" for k, v in cte.items() if re.search(rf"\b{k}\b", body)]
    return ("with " + ", ".join(used) + " " if used else "") + body


def run(name: str):
    text = _sql(name, SPARK)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, used)
        return spark.sql(text)

    return query


QUERIES = {f"tpch_{n}": run(n) for n in BODIES}
ORACLE_SQL = {f"tpch_{n}": _sql(n, DUCK) for n in BODIES}
