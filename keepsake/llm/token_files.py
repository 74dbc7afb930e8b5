"""Token ids as Parquet list columns, ordered by document.

A file holds a run of documents in ascending order, so row-group statistics and page indexes let a reader fetch a
range of documents, or only the counts, without touching other ids. Ids are dictionary encoded (a vocabulary's ids
take 16 bits or fewer each); ascending numbers are delta encoded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.chunks import library_encoder
from keepsake.llm.common import arrow_pass, passed, text_bytes, worker_state

SCHEMA = "doc_id long, part int, place long, n_tokens long, ids array<int>"
#: Bytes of a row group and of a page before compression, and rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 1000


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group: int = ROW_GROUP) -> None:
    """Encode ``text`` of every document, append ``end_id``, and write files in ascending doc_id order.

    Null texts count as empty; null ids come first; rows of one id are ordered by a hash of their text. Extra columns
    are ignored. ``place`` counts the ids before a document in its file, ``part`` numbers the files in order.
    Documents are range partitioned before they are encoded, so that each is encoded once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )

    def encode(batches):
        encoder = worker_state(("library", tokenizer), lambda: library_encoder(tokenizer))
        place = 0
        for b in batches:
            ids, count = encoder(*text_bytes(b.column("text")))
            ends = np.cumsum(count)
            ids = np.insert(ids.astype(np.int32), ends, end_id)
            count = count + 1
            before = place + np.cumsum(count) - count
            place += int(count.sum())
            offsets = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(before), pa.array(count),
                 pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "part", "place", "n_tokens", "ids"])

    (
        arrow_pass(ordered, encode, SCHEMA).write
        .option("parquet.block.size", str(row_group)).option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS)).option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.enable.dictionary#part", "true").option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None,
                ids: bool = True) -> DataFrame:
    """Documents of a folder, or those from ``first`` to ``last``; ``ids=False`` reads no ids at all.

    ``start`` counts the ids of all documents before. The files' totals are one row a file.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(earlier, F.lit(0)).alias("_base"))
    if not ids:
        rows = rows.drop("ids")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("_base") + F.col("place")).drop(
        "part", "place", "_base")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (counted from the ids) and the crc32 of the ids as little-endian 32-bit numbers."""
    def crc(t: pa.Table) -> pa.Table:
        lists = t.column("ids").combine_chunks()
        offsets = lists.offsets.to_numpy()
        raw = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
        sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.table({"doc_id": t.column("doc_id"), "start": t.column("start"),
                         "n_tokens": pa.array(np.diff(offsets).astype(np.int64)),
                         "ids_crc32": pa.array(sums, pa.int64())})

    return passed(tokens.select("doc_id", "start", "ids"), crc,
                  "doc_id long, start long, n_tokens long, ids_crc32 long")
