"""From raw documents to token files: quality, near-duplicates, benchmark passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of docs, save the last.
Quality, near-dedup and decontamination judge each row by itself, whatever its id. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, mixing, near_dedup, quality, token_output
from nearfield.llm.spark import shared_folder, stored

NEAR_PERCENT = 80

ORACLE_SQL = None  # a fitted classifier and rounding have no SQL form; tests/llm/test_pipeline.py has a brute-force version


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def _numbered(docs: DataFrame) -> DataFrame:
    """Stored, with a number of its own for each row, so that neither null nor repeated ids name other rows, and a hash of the text."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_hash", F.xxhash64("text")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id (null last; ties by text hash)."""
    rows = _numbered(docs)
    found = near_dedup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR_PERCENT).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_hash").alias("h"), "_row"))
    kept = found.join(rows.select("_row", "doc_id", "_hash").hint("merge"), "_row").groupBy("component_id").agg(first.alias("f")).select("f._row")
    return rows.join(kept, "_row", "left_semi").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a test item go."""
    rows = _numbered(docs)
    bad = decontaminate.contained_items(rows.select(F.col("_row").alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(bad, "_row", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for, from 0 to 3."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    taken = mixing.mixed(rows, keep=("row",)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the token files."""
    path = shared_folder(spark)
    token_output.write_tokens(docs, path, frugal=True)  # the executors' memory is taken by the stages before
    return token_output.read_tokens(spark, path)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token-ID output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
