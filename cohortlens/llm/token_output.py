"""Token-id output: Parquet list columns, dictionary or delta encoded, in document order.

``write_tokens`` sorts the documents by id into ranges (the text is what is
shuffled, it is smaller than its ids), encodes each range with the tokenizers
library and writes it with Spark's Parquet writer: one row per document,

    part int, pos long      file range and place in it, together the document order
    doc_id long, n_tokens long
    ids array<int>          the document's ids, the end id last

Row groups and pages have set sizes, and Parquet's page index (column and
offset index) lets a reader fetch single documents or the metadata columns
alone. ``read_tokens`` reads ids back, ``read_index`` only metadata.

Nulls and edges: a null or empty text holds the end id alone; a null doc_id
comes first; rows with one doc_id stand next to each other in the order of
their text's hash; identical rows are all written; an empty table gives an
empty file set; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

from .common import arrow_map, texts
from .word_memo import tokenizer_path, worker_memo

END_ID = 2
SCHEMA = "part int, pos long, doc_id long, n_tokens long, ids array<int>"


def _encoder(path: str, end_id: int):
    def make():
        from pyspark import TaskContext

        memo, end, part = worker_memo(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        done = 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal done
            packed = [p + end for p in memo.packed_batch(texts(batch.column("text")))]
            lengths = np.array([len(p) // 4 for p in packed], "i8")
            n = len(packed)
            flat = np.frombuffer(b"".join(packed), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("i4")), pa.array(flat))
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, "i4")), pa.array(np.arange(done, done + n, dtype="i8")),
                 batch.column("doc_id").cast(pa.int64()), pa.array(lengths), ids],
                names=["part", "pos", "doc_id", "n_tokens", "ids"])
            done += n
            return out

        return step

    return make


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID,
                 encoding: str = "dictionary", row_group_mb: int = 16, page_kb: int = 256) -> str:
    """Encode ``docs`` (doc_id, text) and write them to ``folder`` in document order.

    ``encoding``: "dictionary" (a page of distinct ids per row group, then
    bit-packed references) or "delta" (DELTA_BINARY_PACKED of Parquet's second
    page format).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h")
               .sortWithinPartitions("doc_id", "_h").drop("_h"))
    out = arrow_map(ordered, _encoder(tokenizer or tokenizer_path(), end_id), SCHEMA)
    (out.write.mode("overwrite")
     .option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.dictionary.page.size", str(1 << 20))
     .option("parquet.block.size", str(row_group_mb << 20))
     .option("parquet.page.size", str(page_kb << 10))
     .option("parquet.page.row.count.limit", "2000")
     .parquet(folder))
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Document metadata without the ids, with each document's start in the whole id stream."""
    return with_starts(read_tokens(spark, folder).select("part", "pos", "doc_id", "n_tokens"))


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before. Sums run inside each file range and over one total per range."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_t"))
    before = totals.select("part", (F.sum("_t").over(Window.orderBy("part")) - F.col("_t")).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return (index.withColumn("_inside", inside).join(before, "part")
            .withColumn("start", F.col("_inside") + F.col("_before")).drop("_inside", "_before"))


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column("ids")
    offsets = ids.offsets.to_numpy()
    flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
    crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.RecordBatch.from_arrays(
        [batch.column("part"), batch.column("pos"), batch.column("doc_id"),
         pa.array(np.diff(offsets).astype("i8")), pa.array(crc, pa.int64())],
        names=["part", "pos", "doc_id", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """Per document, from ids read back: their number and the crc32 of their little-endian 32-bit form."""
    return arrow_map(tokens.select("part", "pos", "doc_id", "ids"), lambda: _digest,
                     "part int, pos long, doc_id long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex[:12]}"
