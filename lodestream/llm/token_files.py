"""Token counts from flat, unindexed token files by a separator scan.

A token file is a run of little-endian 16-bit ids in which a separator id ends
every document; nothing says where documents are. Files are scanned in blocks,
each a byte range that a task of its own reads: a block yields its separator
places in one vectorised comparison, and a prefix scan over the blocks of a
file (documents so far, start of the document that is open) stitches documents
that cross block boundaries. The scan sees a summary row of each block only.

Files are written by Spark's own text writer, with the separator's two bytes
as its line separator, so they land on any file system Spark writes to. Blocks
are read by Arrow's file systems; a store that only Spark reads is read a file
at a time (files of up to 2 GB there).

Defined cases: an empty or null document has 0 tokens and its separator; an
empty file holds no document; tokens after the last separator of a file are a
document that is not ended (``ended`` false); an odd last byte of a file is
no token. Rows that repeat an id are counted each; a null id stays null.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import Vocabulary
from .shared import cut, delete, shared_dir

SEPARATOR = 50256
BLOCK_TOKENS = 1 << 20
DOCS_A_FILE = 4096
#: Schemes that Arrow opens on executors; others are read through Spark.
RANGED = ("file", "s3")
#: A key is written as digits of 15 bits, which no separator equals; a missing key has all bits set.
KEY_DIGITS, DIGIT_BITS = 5, 15


def _token_bytes(ranks: dict, pattern: str, keyed: bool):
    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        shifts = [DIGIT_BITS * i for i in range(KEY_DIGITS)]
        for b in batches:
            for rows in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                out = []
                for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    n = -1 if key is None else key & (1 << 64) - 1
                    head = [n >> s & (1 << DIGIT_BITS) - 1 for s in shifts] if keyed else []
                    out.append(np.array(head + (coder.encode_ordinary(text) if text else []), "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: Vocabulary, text_col: str = "text", separator: int = SEPARATOR, key_col: str | None = None) -> None:
    """One or more flat files for each partition of docs.

    With ``key_col`` every document begins with its key (a long) as
    ``KEY_DIGITS`` tokens, written in the same pass as the document.
    """
    if vocabulary.size > separator or separator >= 1 << 16 or separator < 1 << DIGIT_BITS:
        raise ValueError("the separator must be a free 16-bit id above the vocabulary and the digits")
    key = F.col(key_col).cast("long") if key_col else F.lit(None).cast("long")
    ids = docs.select(key, F.col(text_col).cast("string")).mapInArrow(_token_bytes(vocabulary.ranks, vocabulary.pattern, key_col is not None), "ids binary")
    mark = separator.to_bytes(2, "little").decode("latin-1")
    ids.select(F.col("ids").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", mark).option("maxRecordsPerFile", DOCS_A_FILE).text(path)


_BLOCK = "path string, block long, stop long, at array<long>, heads array<array<int>>, open struct<start:long,head:array<int>>"
_HEAD = pa.list_(pa.int32())
_OPEN = pa.struct([("start", pa.int64()), ("head", _HEAD)])


def _row(path: str, block: int, first: int, ids: np.ndarray, count: int, separator: int, head: int) -> pa.RecordBatch:
    """One block's row.

    ``ids`` are the block's ``count`` tokens from place ``first`` of the file
    and up to ``head`` behind them. heads has the first tokens of the document
    that ends at each separator, null where it began in an earlier block; open
    is the document that begins here last, if it doesn't end here.
    """
    at = np.flatnonzero(ids[:count] == separator)
    starts = np.r_[[0] if first == 0 else [], at + 1].astype(np.int64)
    heads = [ids[s : s + head].tolist() for s in starts.tolist()]
    left = {"start": int(starts[-1]) + first, "head": heads[-1]} if len(starts) else None
    ended = heads[: len(at)] if first == 0 else [None, *heads][: len(at)]
    columns = [pa.array([path]), pa.array([block], pa.int64()), pa.array([first + count], pa.int64()), pa.array([(at + first).tolist()], pa.list_(pa.int64())), pa.array([ended], pa.list_(_HEAD)), pa.array([left], _OPEN)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "block", "stop", "at", "heads", "open"])


def _ranges(separator: int, head: int, block_tokens: int):
    """Rows (path, length, block) to blocks: each reads its own bytes, and a head's more."""

    def run(batches):
        from pyarrow.fs import FileSystem

        for b in batches:
            for path, length, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = FileSystem.from_uri(path)
                first, tokens = block * block_tokens, length // 2
                count = min(block_tokens, tokens - first)
                with fs.open_input_file(name) as f:
                    f.seek(2 * first)
                    ids = np.frombuffer(f.read(2 * min(count + head, tokens - first)), "<u2")
                if len(ids) < count:
                    raise OSError(f"{path} is shorter than it was")
                yield _row(path, block, first, ids, count, separator, head)

    return run


def _whole(separator: int, head: int, block_tokens: int):
    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2", len(content.as_buffer()) // 2)
                for k in range(-(-len(ids) // block_tokens)):
                    first = k * block_tokens
                    yield _row(path, k, first, ids[first : first + block_tokens + head], min(block_tokens, len(ids) - first), separator, head)

    return run


def blocks(spark: SparkSession, path: str, separator: int, head: int, block_tokens: int) -> DataFrame:
    """A row for each block of the files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if path.partition("://")[0] not in RANGED and "://" in path:
        return files.select("path", "content").mapInArrow(_whole(separator, head, block_tokens), _BLOCK)
    tokens = F.floor(F.col("length") / 2)
    ranges = files.where("length > 1").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((tokens - 1) / block_tokens))).alias("block"))
    return ranges.repartition("path", "block").mapInArrow(_ranges(separator, head, block_tokens), _BLOCK)


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, head: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, place, start, n_tokens, ended, head) of every document of the files under path.

    place counts from 0 in each file; head has the first ``head`` tokens of the document and its separator.
    """
    found = cut(blocks(spark, path, separator, head, block_tokens))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "block", "stop", "open", F.size("at").alias("n"))
    scan = summary.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("so_far"),
        F.last("open", ignorenulls=True).over(before).alias("carried"),
        (F.max("stop").over(Window.partitionBy("path")) == F.col("stop")).alias("final"),
    )
    both = found.join(scan, ["path", "block"])
    began = F.transform("at", lambda x, i: F.when((i == 0) & F.get("heads", i).isNull(), F.col("carried.start")).otherwise(F.coalesce(F.get("at", i - 1) + 1, F.lit(0))))
    heads = F.transform("heads", lambda x, i: F.coalesce(x, F.col("carried.head")))
    ends = F.arrays_zip(began.alias("start"), F.col("at").alias("stop"), heads.alias("head"))
    ends = F.transform(ends, lambda x, i: F.struct((F.col("so_far") + i).alias("place"), x["start"].alias("start"), x["stop"].alias("stop"), x["head"].alias("head"), F.lit(True).alias("ended")))
    left = F.coalesce("open", "carried")
    tail = F.array(F.struct((F.col("so_far") + F.size("at")).alias("place"), left["start"].alias("start"), F.col("stop").alias("stop"), left["head"].alias("head"), F.lit(False).alias("ended")))
    out = both.select("path", F.explode(F.when(F.col("final") & (left["start"] < F.col("stop")), F.concat(ends, tail)).otherwise(ends)).alias("d"))
    return out.select("path", F.col("d.place").cast("long").alias("place"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.col("d.ended").alias("ended"), F.col("d.head").alias("head"))


def _key(head: Column) -> Column:
    """The key that a document begins with; null if it has none."""
    digits = [F.get(head, F.lit(i)).cast("long") for i in range(KEY_DIGITS)]
    top = 64 - DIGIT_BITS * (KEY_DIGITS - 1)
    low = sum((F.shiftleft(d, DIGIT_BITS * i) for i, d in enumerate(digits[:-1])), F.lit(0).cast("long"))
    return F.when(digits[-1] < (1 << top), low.bitwiseOR(F.shiftleft(digits[-1], DIGIT_BITS * (KEY_DIGITS - 1))))


def document_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row, by writing flat token files to the shared folder and scanning them back.

    Ids stand in the files, in front of the tokens they belong to. The folder
    is removed in any case; a document that is not ended fails the query.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    try:
        write_tokens(docs, path, vocabulary, text_col, key_col=id_col)
        found = count_tokens(spark, path, head=KEY_DIGITS)
        whole = F.when(F.col("ended") & (F.col("n_tokens") >= KEY_DIGITS), F.col("n_tokens") - KEY_DIGITS)
        return found.select(_key(F.col("head")).alias("doc_id"), F.coalesce(whole, F.raise_error(F.lit("a token file is not ended")).cast("long")).alias("n_tokens"))
    finally:
        delete(spark, path)
