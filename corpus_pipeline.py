"""Corpus pipeline: five stages over documents, each one operator of lodestream.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All but the last return
the columns of documents.

* quality: documents that a rule rejects go.
* lines: of lines alike one stays; documents that lose every line go.
* near_duplicates: of each group of documents alike, the smallest id stays.
* decontaminate: documents that hold a test item go.
* tokens: texts become token ids, with the bytes they decode to.

All stages: an empty table gives an empty table with the same columns; extra
columns are carried along, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import byte_bpe, decontaminate, jaccard_join, lines, quality
from lodestream.llm.shared import delete, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that no rule rejects. Null, empty and word-free texts are rejected as short; rows are
    judged each by its own text, so repeated rows and null ids are kept or go alike."""
    return quality.judge(docs, to="_quality_rejected_by").where("_quality_rejected_by is null").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes redundant lines; a document goes only if it loses its last line with a word. n_chars follows the text.

    Rows with a null id or text stay as they are; rows that repeat an id with
    another text are documents of their own; rows equal in id and text keep and
    lose the same lines.
    """
    gone = F.col("_lines_removed")
    out = lines.dedup_lines(docs, count_col="_lines_removed")
    out = out.where((gone == 0) | F.col("text").rlike(r"[^ \t-\r]")).withColumn("n_chars", F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the smallest id's; rows with a null id stay.

    Rows that repeat an id are judged each by its own text, so a row does not go
    for another's; rows equal in id and text are one. Texts without words stay.
    """
    return jaccard_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds an item, whatever their id; texts are told apart by 64-bit hashes. Null and
    empty texts hold nothing and stay; null and empty items are found nowhere."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("_leak_key", F.xxhash64("text"))
    found = decontaminate.leaks(keyed, items, id_col="_leak_key").select(F.col("doc_id").alias("_leak_key")).distinct()
    return keyed.join(found, "_leak_key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row, whatever its id; null and empty texts have no ids."""
    vocabulary = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = byte_bpe.encode(docs.select("doc_id", "text"), vocabulary, keep_text=False, decode_to="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", encode),
]

#: SQL can't express the stages; tests/llm holds each of them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's folder is removed when the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            delete(spark, f"{home}/{k - 1}")
    return docs
