"""Token ids as Parquet: a list column in delta encoding, small row groups and pages with page indexes.

Documents are dealt out by ranges of doc_id and sorted, so files are in ascending order and a lookup by doc_id reads few row groups and pages;
lengths and positions are columns of their own and are read without the ids. Each file's rows know their position within the file (at);
the file's own start follows from the lengths of the files before it, one number a file. There is a file for every FILE_BYTES of text, and at least one a shuffle partition.

A null text is an empty document: its end id alone. Null doc_ids come first. Repeated doc_ids are each written, ordered by hash of the
text, then text, so that very many of them are not one range. Other columns are not read. An empty table gives no rows.

frugal: for executors whose memory other work has taken. Batches and the memory of pieces are smaller and each batch's memory is given back; the ids are the same, for more CPU.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.spark import bounded_batches, give_back, tidy
from nearfield.llm.tokens import DEFAULT_FILE, balanced, encoder_for

SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
#: Text of a file, about.
FILE_BYTES = 128 << 20
#: Up to so many files their starts (16 bytes each) are broadcast; beyond, they are joined like any table.
MOST_BROADCAST_FILES = 100_000
#: Where frugal: text of a batch, and remembered pieces beyond which the memory of them starts anew.
FRUGAL_BYTES, FRUGAL_PIECES = 1 << 20, 100_000


def _encode(file: str, end_id: int, frugal: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = encoder_for(file, FRUGAL_PIECES if frugal else None), 0, TaskContext.get().partitionId()
        for batch in balanced(batches, FRUGAL_BYTES if frugal else None):
            flat, counts = encoder.ids(batch.column("text"))
            full = np.insert(flat, np.cumsum(counts), end_id).astype(np.int32)
            counts += 1
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(full))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at + ends - counts), pa.array(counts), lists], names=["doc_id", "part", "at", "n_tokens", "ids"])
            at += int(ends[-1])
            if frugal:
                del batch, flat, full, counts, ends, lists
                give_back()

    return run


def write_tokens(docs: DataFrame, path: str, file: str = DEFAULT_FILE, end_id: int = 2, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, frugal: bool = False) -> None:
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_hash"))
    ordered = rows.repartitionByRange(files, "doc_id", "row_hash").sortWithinPartitions("doc_id", "row_hash", "text").drop("row_hash")
    (
        ordered.mapInArrow(tidy(_encode(file, end_id, frugal)), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in the files before each file. One row a file meets in the window."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, where=None) -> DataFrame:
    """(doc_id, start, n_tokens, ids). where: a condition on doc_id, n_tokens or part, which reaches the row groups and pages; columns not selected later are not read."""
    rows = spark.read.parquet(path)
    if where is not None:
        rows = rows.where(where)
    bases = starts(spark, path)
    if bases.count() <= MOST_BROADCAST_FILES:
        bases = F.broadcast(bases)
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat = lists.flatten().to_numpy().astype("<u4", copy=False)
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        crc = [zlib.crc32(flat[e - n : e].data) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the written files."""
    bounded_batches(spark)
    return read_tokens(spark, path).select("doc_id", "start", "ids").mapInArrow(tidy(_check), "doc_id long, start long, n_tokens long, ids_crc32 long")
