"""Query suite: SQL, DataFrame and JSON-plan forms with the oracle's SQL."""

from . import micro, plan_queries, tpch

QUERIES: dict = tpch.QUERIES | micro.QUERIES | plan_queries.QUERIES
ORACLE_SQL: dict = tpch.ORACLE_SQL | micro.ORACLE_SQL | plan_queries.ORACLE_SQL
