"""Typed table registry: schemas as JSON or StructType, and temp views over Parquet."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: Names of the schema file's types and what they are in Spark.
TYPES = {
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "CHAR": T.StringType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "BOOL": T.BooleanType(),
}
#: Julian day number of 1970-01-01.
EPOCH_JULIAN_DAY = 2440588


def read_schemas(text: str) -> dict[str, T.StructType]:
    """Schemas from {"tables": [{"name", "columns": [{"name", "type"}]}]}."""
    return {t["name"]: T.StructType([T.StructField(c["name"], TYPES[c["type"].upper()]) for c in t["columns"]]) for t in json.loads(text)["tables"]}


def write_schemas(schemas: dict[str, T.StructType]) -> str:
    name = {v: k for k, v in reversed(TYPES.items())}
    return json.dumps({"tables": [{"name": t, "columns": [{"name": f.name, "type": name.get(f.dataType, "STRING")} for f in s]} for t, s in schemas.items()]}, indent=1)


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table. Unreadable files fail the query; nothing is skipped."""
    reader = spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
    return (reader.schema(schema) if schema else reader).parquet(path)


def register(spark: SparkSession, sf_dir: str, tables: Iterable[str] = TABLES) -> None:
    """A temp view for each table of a folder; only the footer is read until a query runs."""
    for t in tables:
        table(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def julian_to_date(days: Column) -> Column:
    """Date of a Julian day number, also of one that was stored as days since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int") - EPOCH_JULIAN_DAY)


def fix_julian(date: Column) -> Column:
    """A date column whose stored day count is a Julian day number."""
    return F.date_add(date, -EPOCH_JULIAN_DAY)


def byte_to_char(code: Column) -> Column:
    """One-character string of a byte code."""
    return F.chr(code.cast("long"))


def read_metadata(text: str) -> tuple[str, list[dict]]:
    """(table name, chunks) of a metadata file {"table_name", "row_groups": [{"id", "object_key", "compressed_size", "uncompressed_size", "num_rows"}]}.

    Older files name the table under "object_key". A chunk that lacks a value is an error.
    """
    found = json.loads(text)
    if "row_groups" not in found:
        raise ValueError("metadata has no row_groups")
    for group in found["row_groups"]:
        if missing := {"id", "object_key", "compressed_size", "uncompressed_size", "num_rows"} - set(group):
            raise ValueError(f"a chunk lacks {', '.join(sorted(missing))}")
    return found.get("table_name", found.get("object_key", "")), found["row_groups"]


def table_by_metadata(spark: SparkSession, home: str, metadata_path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table whose chunks a metadata file names, each under home; only they are read."""
    name, chunks = read_metadata(_whole(spark, metadata_path))
    if not chunks and schema is None:
        raise ValueError(f"{name} has no chunks and no schema is given")
    if not chunks:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
    return (reader.schema(schema) if schema else reader).parquet(*[f"{home.rstrip('/')}/{c['object_key']}" for c in chunks])


def _whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def total_rows(spark: SparkSession, metadata_path: str) -> int:
    """Row count by a table's metadata file."""
    return sum(c["num_rows"] for c in read_metadata(_whole(spark, metadata_path))[1])
