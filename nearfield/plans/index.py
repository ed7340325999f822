"""A vector index: a Parquet table (vec_id, embedding, sig) sorted by vec_id, and a one-row metadata table.

The metadata hold the parameters and a fingerprint of the content, so an index is reused only for the data it was built from. Each build writes a folder of its own, its metadata last:
a build that was interrupted has none and is never read. Older builds go when a newer one is complete.
"""

from __future__ import annotations

import logging
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import lsh
from nearfield.functions import vectors as V
from nearfield.operators import search as S
from nearfield.plans import store

log = logging.getLogger("nearfield")


class DimensionError(ValueError, RuntimeError):
    """A query's length is not the index's."""


def inspect(vectors: DataFrame, least: int = 1, most: int | None = None) -> tuple[int, int, str]:
    """(rows, dims, fingerprint) in one aggregation. The fingerprint is a sum of row hashes: independent of the order of rows, no shuffle of vectors.

    Nulls, NaN, infinities and differing lengths are errors that name the first bad vec_id; so are no rows and a length that is not from least to most."""
    width = F.size("embedding")
    odd = F.col("vec_id").isNull() | F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    got = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(width).alias("lo"),
        F.max(width).alias("hi"),
        F.min_by("vec_id", F.when(odd, F.coalesce("vec_id", F.lit(-1)))).alias("bad"),
        F.max(odd).alias("any_bad"),
        F.sum(F.xxhash64("vec_id", "embedding").cast("decimal(38,0)")).alias("content"),
    ).first()
    if not got.n:
        raise ValueError("at least one vector is needed")
    if got.any_bad:
        raise ValueError(f"null, NaN or infinite values, first at vec_id {got.bad}")
    if got.lo != got.hi:
        first = vectors.where(width != got.hi).agg(F.min("vec_id")).first()[0]
        raise ValueError(f"vectors differ in length: vec_id {first} has not {got.hi} values")
    if got.lo < least or most is not None and got.lo > most:
        raise ValueError(f"vectors have {got.lo} values; from {least}{f' to {most}' if most else ''} are allowed")
    return got.n, got.lo, str(got.content)


def validate(vectors: DataFrame) -> tuple[int, int]:
    """(rows, dims); see inspect."""
    return inspect(vectors)[:2]


class VectorIndex:
    """A handle over an index's table."""

    def __init__(self, vectors: DataFrame, rows: int, dims: int, planes: np.ndarray | None, level: str = "f32"):
        self.vectors, self._rows, self._dims, self.planes, self.level = vectors, rows, dims, planes, level

    def rows(self) -> int:
        return self._rows

    def dims(self) -> int:
        return self._dims

    def get_vector(self, vec_id: int) -> list[float]:
        found = self.vectors.where(F.col("vec_id") == int(vec_id)).select("embedding").first()
        if found is None:
            raise ValueError("Index out of limits")
        return list(found[0])

    def _frame(self, query) -> DataFrame:
        if isinstance(query, DataFrame):
            return query
        query = np.asarray(query, dtype=np.float64)
        if query.shape != (self._dims,):
            raise DimensionError(f"the query has {query.size} values, the index {self._dims} dimensions")
        return S.queries_frame(self.vectors.sparkSession, [query])

    def unit_query(self, query, strict: bool = True) -> DataFrame:
        if isinstance(query, DataFrame):
            return S.normalized_queries(query, strict)
        return self._frame(V.normalize_query(query, "strict" if strict else "lenient"))

    def search(self, query, k: int, normalize: bool = True, method: str = "simd", use_ann: bool | None = None) -> DataFrame:
        """One vector, or a frame (qid, q) of many. Uses the signatures if the index has them, unless told not to."""
        V.check_method(method)
        queries = self.unit_query(query) if normalize else self._frame(query)
        if self.planes is None or use_ann is False:
            return S.topk_exact(self.vectors, queries, k)
        signed = queries.withColumn("sig", lsh.signature("q", self.planes))
        return S.topk_ann(self.vectors, signed, k).drop("used_fallback")

    def similar(self, vec_id: int, k: int, method: str = "simd") -> DataFrame:
        """Neighbours of a stored row, itself included; the row is not normalised."""
        try:
            row = self.get_vector(vec_id)
        except ValueError:
            raise ValueError("Invalid index") from None
        return self.search(row, k, normalize=False, method=method).withColumn("qid", F.lit(int(vec_id)).cast("long"))

    def search_subset(self, query, subset: DataFrame | list[int], k: int, normalize: bool = True, method: str = "simd") -> DataFrame:
        V.check_method(method)
        if not isinstance(subset, DataFrame):
            subset = self.vectors.sparkSession.createDataFrame([(int(i),) for i in subset], "vec_id long")
        queries = self.unit_query(query, strict=False) if normalize else self._frame(query)
        return S.topk_subset(self.vectors, subset, queries, k)


def _complete(spark: SparkSession, path: str) -> list[str]:
    """Complete builds under an index's path, oldest first."""
    return [f"{path}/{name}" for name in sorted(store.folders(spark, path)) if store.exists(spark, f"{path}/{name}/meta/_SUCCESS")]


def build_index(vectors: DataFrame, path: str, level: str = "f32", use_ann: bool = True, normalize: bool = False, seed: int = lsh.DEFAULT_SEED, bits: int = lsh.DEFAULT_BITS, reuse: bool = False, least_dims: int = 1, most_dims: int | None = None) -> VectorIndex:
    """Check, optionally normalise, sign and write. reuse: keep an index there that has the same content and parameters, else it is replaced."""
    V.check_level(level)
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows, dims, content = inspect(vectors, least_dims, most_dims)
    made = {"rows": rows, "dims": dims, "level": level, "use_ann": use_ann, "normalized": normalize, "seed": seed, "bits": bits, "content": content}
    before = _complete(spark, path)
    if reuse and before:
        there = spark.read.parquet(f"{before[-1]}/meta").first().asDict()
        if all(there.get(k) == v for k, v in made.items()):
            return open_index(spark, path)
        log.info("index at %s holds other data: rebuilt", path)
    if normalize:
        vectors = vectors.withColumn("embedding", V.normalize_clamped("embedding").cast("array<float>"))
    out = vectors.withColumn("embedding", V.quantize("embedding", level))
    planes = lsh.hyperplanes(bits, dims, seed) if use_ann else None
    out = out.withColumn("sig", lsh.signature("embedding", planes) if use_ann else F.lit(None).cast("long"))
    new = f"{path}/build-{max(time.time_ns(), 1 + int(before[-1].rsplit('-', 1)[1]) if before else 0):020}"
    out.repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.parquet(f"{new}/vectors")
    if use_ann:
        spark.createDataFrame([(j, [float(x) for x in h]) for j, h in enumerate(planes)], "bit int, h array<double>").coalesce(1).write.parquet(f"{new}/planes")
    spark.createDataFrame([made], "rows long, dims int, level string, use_ann boolean, normalized boolean, seed int, bits int, content string").coalesce(1).write.parquet(f"{new}/meta")
    for old in before:
        store.remove(spark, old)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str, use_ann: bool = True) -> VectorIndex:
    there = _complete(spark, path)
    if not there:
        raise FileNotFoundError(f"no complete index at {path}")
    path = there[-1]
    meta = spark.read.parquet(f"{path}/meta").first()
    planes = None
    if use_ann and meta.use_ann:
        planes = np.array([r.h for r in spark.read.parquet(f"{path}/planes").orderBy("bit").collect()])  # bits rows, 62 at most
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), meta.rows, meta.dims, planes, meta.level)
