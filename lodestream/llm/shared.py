"""Helpers the operators share: cutting lineage, bounded broadcasts, let-binding.

Arrow batches are bounded by bytes, by the session's own default (64 MB).
"""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a few longs that are broadcast; beyond that the same join is shuffled.
BROADCAST_ROWS = 200_000
#: Spark's estimate for a plan of unknown size lies far above.
UNKNOWN = 1 << 55


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and the master is local, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(spark, "_lodestream_dir", None)
        if named is None:
            named = spark._lodestream_dir = "file://" + tempfile.mkdtemp(prefix="lodestream-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder, so later stages neither repeat the work nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and checkpoints that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, by Hadoop's file system for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame) -> DataFrame:
    """df (with lineage cut), marked for broadcast if it has at most BROADCAST_ROWS rows; beyond, joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def estimated(docs: DataFrame) -> int:
    """Bytes of docs as Spark estimates them, 0 if it can't."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN else 0


def tasks_for(docs: DataFrame, bytes_a_task: int) -> int:
    """Tasks for work over the whole of docs: the session's shuffle partitions, or more where its estimated size asks for more."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimated(docs) // bytes_a_task)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows that repeat an id apart by their text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
