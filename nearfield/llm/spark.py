"""Session helpers: bounded Arrow batches, and tables in the folder that all executors share.

Nulls and empty tables are stored as they are. Join keys of spread_join and nodes of components must not be null; null keys join with nothing.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 16 << 20
#: A key with more than one in so many of all rows is joined in parts.
HOT_GROUPS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches hold few rows and few bytes, whatever the size of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def give_back() -> None:
    """What this Python worker has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # GNU C library only
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same Arrow function; what a task has freed goes back to the system at its end, as workers stay for later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on a cluster it is an error, as executors share no local folder."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/nearfield/{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that this session's operators have stored. Frames that were made before cannot be read afterwards."""
    _remove(spark, _own_folder(spark))


def stored(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read back: lineage ends there and lost executors cost no more than their tasks."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove stored tables that no later plan reads."""
    for frame in frames:
        if path := getattr(frame, "_stored_at", None):
            _remove(frame.sparkSession, path)


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], spread_by: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of stored rows with groups, one row a key, whose column n tells how many rows have the key; n is dropped.

    A key with more than 1 / HOT_GROUPS of the rows is dealt out in parts by the columns spread_by, so that no task reads it all. Such
    keys are found in sizes (groups, unless they are costly to read twice). As sizes add up to the rows, fewer than HOT_GROUPS keys
    are hot, which bounds what is broadcast. Groups meet rows in a merge join at every size.
    """
    most = max(1, rows.count() // HOT_GROUPS)
    parts = F.ceil(F.col("n") / most).cast("int")
    hot = (groups if sizes is None else sizes).where(F.col("n") > most).select(*on, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    each = groups.withColumn("_part", F.explode(F.when(F.col("n") > most, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.join(each.hint("merge"), [*on, "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge (u, v), by alternating large and small stars.

    Rounds grow with the logarithm of a component's diameter. Each round is aggregated and joined on nodes, with minima taken
    before rows move and the links of large hubs joined in parts, and is stored; nothing but two numbers reaches the driver.
    """
    proper = F.col("u") != F.col("v")
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(proper).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark.n:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = spread_join(both, low, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(proper).distinct()
        large = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, low, ["u"], ["v"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = stored(small.where(proper).distinct())
        discard(now, large)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
