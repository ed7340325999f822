"""Top-k by dot product: exact, in a hash bucket, or in a caller's subset.

Vectors: (vec_id BIGINT, embedding ARRAY<FLOAT>), optionally sig BIGINT. Queries: (qid BIGINT, q ARRAY<DOUBLE>).
Results: (qid, rnk, vec_id, score), ranked by score descending and then vec_id ascending, so that ties are settled.

Scale: a search is one pass over the vectors, where they lie, for each block of queries. A block is bounded in bytes and in rows it can keep (BLOCK_BYTES, KEPT_ROWS), and the driver
holds one at a time: it goes to the tasks, each task keeps k rows per query, so only tasks x queries x k rows are shuffled, never the vectors or all scores, and with more than one block each
block's result is stored before the next one is fetched. Bucket search is the same pass, in which a row meets the queries of its own bucket only: a hot bucket is worked on by all tasks that hold its rows.
Rows with a null vector or id match nothing, nor does a row whose score is not a number. Empty inputs and k = 0 give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.plans.store import stored

RESULT = "qid long, rnk int, vec_id long, score double"
PARTIAL = "qid long, vec_id long, ord long, score double"
#: Queries go to the tasks in blocks of up to this many bytes, fewer where a task could keep more than KEPT_ROWS rows for them.
BLOCK_BYTES, KEPT_ROWS = 8 << 20, 4 << 20
#: Scores of a block are taken for up to this many rows at once.
TILE_CELLS = 4 << 20


def queries_frame(spark: SparkSession, queries: dict[int, np.ndarray] | list) -> DataFrame:
    pairs = queries.items() if isinstance(queries, dict) else enumerate(queries)
    return spark.createDataFrame([(int(i), [float(x) for x in q]) for i, q in pairs], "qid long, q array<double>")


class Block:
    """Queries that go to the tasks together: ids, a matrix, and the buckets they ask for (none: all rows)."""

    def __init__(self, rows: list[Row], in_buckets: bool):
        self.ids = np.array([r.qid for r in rows], dtype=np.int64)
        self.matrix = np.stack([np.asarray(r.q, dtype=np.float64) for r in rows])
        self.sigs = np.array([r.sig for r in rows], dtype=np.int64) if in_buckets else None

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, rows) that belong together, as positions."""
        if self.sigs is None:
            yield np.arange(len(self.ids)), np.arange(batch.num_rows)
            return
        sigs = batch.column("sig").fill_null(-1).to_numpy()  # no signature is negative
        by = np.argsort(sigs, kind="stable")
        edges = np.flatnonzero(np.diff(sigs[by])) + 1
        for rows in np.split(by, edges):
            asked = np.flatnonzero(self.sigs == sigs[rows[0]])
            if len(asked):
                yield asked, rows


def query_blocks(queries: DataFrame, k: int, in_buckets: bool = False) -> Iterator[Block]:
    """Bounded blocks of a query table, fetched one partition at a time."""
    rows, held = [], 0
    columns = ["qid", "q", "sig"] if in_buckets else ["qid", "q"]
    for r in queries.dropna(subset=columns).select(columns).toLocalIterator():
        rows.append(r)
        held += 8 * len(r.q)
        if held >= BLOCK_BYTES or len(rows) * k >= KEPT_ROWS:
            yield Block(rows, in_buckets)
            rows, held = [], 0
    if rows:
        yield Block(rows, in_buckets)


def _keep_best(qi, vid, order, score, k):
    """The k best rows of each query among flat candidate arrays."""
    by = np.lexsort((order, vid, -score, qi))
    qi, vid, order, score = qi[by], vid[by], order[by], score[by]
    start = np.r_[True, qi[1:] != qi[:-1]]
    rank = np.arange(len(qi)) - np.maximum.accumulate(np.where(start, np.arange(len(qi)), 0))
    return tuple(x[rank < k] for x in (qi, vid, order, score))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def _near_best(rough: np.ndarray, k: int) -> np.ndarray:
    """Which scores could be among the k best of their row; not those that are no numbers."""
    number = ~np.isnan(rough)
    if rough.shape[1] <= k:
        return number
    sunk = np.where(number, rough, -np.inf)
    cut = np.partition(sunk, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
    slack = np.where(np.isfinite(cut), 1e-9 * (1 + np.abs(cut)), 0)
    return number & (sunk >= (cut - slack)[:, None])


def _local_topk(block: Block, k: int):
    """mapInArrow function: a task's k best rows for each query. The product of matrices only preselects; kept scores are summed row by row, so equal rows get equal scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            every, vid, order = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(), batch.column("ord").to_numpy()
            if every.shape[1] != block.matrix.shape[1]:
                raise ValueError(f"query has {block.matrix.shape[1]} dimensions, vectors have {every.shape[1]}")
            for asked, rows in block.parts(batch):
                matrix, step = block.matrix[asked], max(1, TILE_CELLS // len(asked))
                for at in range(0, len(rows), step):
                    tile = rows[at : at + step]
                    part = every[tile]
                    qi, ri = np.nonzero(_near_best(matrix @ part.T, k))
                    score = (matrix[qi] * part[ri]).sum(axis=1)
                    there = ~np.isnan(score)
                    got = (asked[qi][there], vid[tile[ri]][there], order[tile[ri]][there], score[there])
                    best = _keep_best(*(np.concatenate(x) for x in zip(best, got, strict=True)), k)
        qi, vid, order, score = best
        if len(qi):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[qi]), pa.array(vid), pa.array(order), pa.array(score)], names=["qid", "vec_id", "ord", "score"])

    return run


def _rank(partial: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "ord")
    return partial.withColumn("rnk", F.row_number().over(by)).where(F.col("rnk") <= k).select("qid", "rnk", "vec_id", "score")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT)


def topk_exact(vectors: DataFrame, queries: DataFrame, k: int, ordinal: str | None = None) -> DataFrame:
    """k best rows for each query over all rows. ordinal: a column that settles ties between rows of one id."""
    if k < 0:
        raise ValueError("k must not be negative")
    spark = vectors.sparkSession
    return _search(vectors, queries, k, F.col(ordinal).cast("long") if ordinal else F.lit(0).cast("long"))


def _search(vectors: DataFrame, queries: DataFrame, k: int, order: Column, in_buckets: bool = False) -> DataFrame:
    columns = [F.col("vec_id").cast("long").alias("vec_id"), order.alias("ord"), "embedding", *(["sig"] if in_buckets else [])]
    there = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(columns)
    if k > KEPT_ROWS // 1000:
        k = min(k, there.count())
    blocks, found = query_blocks(queries, k, in_buckets) if k else iter(()), []
    block = next(blocks, None)
    while block:
        rows = _rank(there.mapInArrow(_local_topk(block, k), PARTIAL), k)
        block = next(blocks, None)
        found.append(stored(rows) if block or found else rows)
    return reduce(DataFrame.unionByName, found) if found else _empty(vectors.sparkSession)


def normalized_queries(queries: DataFrame, strict: bool = True) -> DataFrame:
    """Unit queries. Strict: a norm up to 2**-23 is an error when the plan runs; else a zero query stays zero."""
    if not strict:
        return queries.withColumn("q", V.normalize_lenient("q"))
    bad = F.raise_error(F.concat(F.lit("query without length: "), F.col("qid").cast("string"))).cast("array<double>")
    return queries.withColumn("q", F.when(V.norm("q") <= V.STRICT_EPS, bad).otherwise(V.normalize_lenient("q")))


def topk_similar(vectors: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """k best rows for stored rows taken as queries, as they are; each finds itself too. ids: (vec_id)."""
    picked = vectors.join(ids.select("vec_id").distinct(), "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))
    return topk_exact(vectors, picked, k)


def topk_subset(vectors: DataFrame, subset: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k best among the rows of subset (vec_id): repeated ids are repeated results, unknown ids are dropped. Signatures are never used here."""
    if "ord" not in subset.columns:
        subset = subset.withColumn("ord", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.lit(0))))
    return topk_exact(subset.select("vec_id", "ord").join(vectors.select("vec_id", "embedding"), "vec_id"), queries, k, "ord")


def topk_candidates(vectors: DataFrame, kept: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k best for each query among its own candidates kept (qid, vec_id); a repeated candidate counts once."""
    there = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    rows = kept.select("qid", "vec_id").distinct().join(there, "vec_id").join(queries.where("q IS NOT NULL").select("qid", "q"), "qid")
    return _rank(rows.select("qid", "vec_id", F.lit(0).cast("long").alias("ord"), V.dot("q", "embedding").alias("score")), k)


def candidates(signed: DataFrame, signed_queries: DataFrame) -> DataFrame:
    """(qid, q, vec_id, embedding) of rows whose signature is a query's: an equi-join, whose kind Spark picks."""
    return signed_queries.select("qid", "q", "sig").join(signed.select("vec_id", "embedding", "sig"), "sig")


def topk_bucket(signed: DataFrame, signed_queries: DataFrame, k: int) -> DataFrame:
    """k best in the query's own bucket; fewer, or none, if the bucket has no more. Vectors are not moved."""
    return _search(signed, signed_queries, k, F.lit(0).cast("long"), in_buckets=True)


def split_by_bucket(signed: DataFrame, signed_queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Queries whose bucket has k rows or more, and the others. Bucket sizes are counted before any join, so a hot bucket is one row."""
    sizes = signed.join(signed_queries.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.count(F.lit(1)).alias("n_cand"))
    counted = signed_queries.join(sizes, "sig", "left").withColumn("n_cand", F.coalesce("n_cand", F.lit(0)))
    return counted.where(F.col("n_cand") >= k), counted.where(F.col("n_cand") < k)


def topk_ann(signed: DataFrame, signed_queries: DataFrame, k: int) -> DataFrame:
    """Bucket search, and exact search for queries whose bucket has fewer than k rows; used_fallback tells which."""
    enough, few = split_by_bucket(signed, signed_queries, k)
    near = topk_bucket(signed, enough, k).withColumn("used_fallback", F.lit(False))
    return near.unionByName(topk_exact(signed, few, k).withColumn("used_fallback", F.lit(True)))
