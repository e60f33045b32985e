"""Delimited text to Parquet chunks with a metadata file, and object-store settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import write_schemas

CODECS = ("snappy", "zstd", "gzip", "lz4", "none")


def read_tbl(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Rows of |-delimited lines that end in a delimiter; a subset of columns if asked. Bad values fail the query."""
    wide = T.StructType([*schema, T.StructField("_end", T.StringType())])
    df = spark.read.csv(path, sep="|", schema=wide, mode="FAILFAST", quote="").drop("_end")
    return df.select(*columns) if columns else df


def write_chunks(df: DataFrame, path: str, rows: int, codec: str = "zstd") -> None:
    """Parquet files of at most ``rows`` rows each."""
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r} is none of {CODECS}")
    df.write.option("maxRecordsPerFile", rows).option("compression", codec).mode("overwrite").parquet(path)


_FOOTER = "object_key string, compressed_size long, uncompressed_size long, num_rows long"


def _footers(batches):
    """Paths of Parquet files to what their footers say; only footers are read."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    for b in batches:
        rows = []
        for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, name = FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                meta = pq.ParquetFile(f).metadata
            size = sum(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups))
            rows.append({"object_key": path.rpartition("/")[2], "compressed_size": length, "uncompressed_size": size, "num_rows": meta.num_rows})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("object_key", pa.string()), ("compressed_size", pa.int64()), ("uncompressed_size", pa.int64()), ("num_rows", pa.int64())]))


def chunk_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(object_key, compressed_size, uncompressed_size, num_rows) of each file of a table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "length").mapInArrow(_footers, _FOOTER)


def metadata_json(chunks: DataFrame, table_name: str) -> str:
    """The metadata file's text; one entry a file, so its size follows the number of files."""
    rows = chunks.orderBy("object_key").collect()
    return json.dumps({"table_name": table_name, "row_groups": [{"id": i, **r.asDict()} for i, r in enumerate(rows)]}, indent=2)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file on any file system that Spark writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_table(df: DataFrame, home: str, name: str, rows: int, codec: str = "zstd") -> None:
    """Chunks under home/name, home/name_metadata.json and home/name_schema.json."""
    write_chunks(df, f"{home}/{name}", rows, codec)
    put_text(df.sparkSession, f"{home}/{name}_metadata.json", metadata_json(chunk_metadata(df.sparkSession, f"{home}/{name}"), name))
    put_text(df.sparkSession, f"{home}/{name}_schema.json", write_schemas({name: df.schema}))


def object_store(endpoint: str, access_key: str, secret_key: str, ssl: bool = True) -> dict[str, str]:
    """Spark settings for s3a:// paths of an S3-compatible store. Never log them."""
    at = "spark.hadoop.fs.s3a."
    return {at + "endpoint": endpoint, at + "access.key": access_key, at + "secret.key": secret_key, at + "connection.ssl.enabled": str(ssl).lower(), at + "path.style.access": "true"}
