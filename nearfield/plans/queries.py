"""The engine's operators as queries over a data folder, and the same in SQL.

Searches take as queries all rows whose vec_id is divisible by 50, against all rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.api import VectorSearch
from nearfield.functions import lsh
from nearfield.functions import vectors as V
from nearfield.operators import search as S
from nearfield.operators.cascade import Cascade
from nearfield.plans import store
from nearfield.plans.index import VectorIndex, build_index
from nearfield.sources import files
from nearfield.streaming.score import score_stream

K = 5
#: Few bits, so that buckets of the small tables hold both more and fewer rows than K.
BITS = 4
DIMS = 64
SUBSET_SQL = "SELECT vec_id, 0::BIGINT AS ord FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, 1::BIGINT FROM embeddings WHERE label = 1 UNION ALL SELECT -1::BIGINT, 0::BIGINT"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))


def _unit(vectors: DataFrame) -> DataFrame:
    return S.normalized_queries(_queries(vectors))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6) + F.lit(0.0))


def _cells(vectors: DataFrame, values) -> DataFrame:
    return vectors.select("vec_id", F.posexplode(values)).select("vec_id", "pos", F.round(F.col("col").cast("double"), 6).alias("value"))


def _holed(vectors: DataFrame) -> DataFrame:
    """Every seventh row as a zero vector."""
    return vectors.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))


def _signed(frame: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    return frame.withColumn("sig", lsh.signature(column, lsh.hyperplanes(bits, DIMS)))


def _scaled(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: (x.cast("double") * (1 + F.col("vec_id") % 7)).cast("float")))


def _shape(spark, d):
    width = F.size("embedding")
    return _vectors(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max(width).cast("long").alias("dims"), F.min(width).cast("long").alias("min_len"))


def _subset(spark, d):
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    ids = table.where("label < 3").select("vec_id", F.lit(0).cast("long").alias("ord")).unionByName(table.where("label = 1").select("vec_id", F.lit(1).cast("long").alias("ord")))
    ids = ids.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("ord")))
    v = _vectors(spark, d)
    return _rounded(S.topk_subset(v, ids, _unit(v), K))


def _ann(fallback: bool, bits: int = BITS):
    def run(spark, d):
        v = _vectors(spark, d)
        find = S.topk_ann if fallback else S.topk_bucket
        return _rounded(find(_signed(v, "embedding", bits), _signed(_unit(v), "q", bits), K if not fallback else 30))

    return run


def _cascade(spark, d):
    """One query, and all rows that the last level keeps for it."""
    v = _vectors(spark, d)
    rows, dims = v.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    level = VectorIndex(v, rows, dims, None)
    query = v.where("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))
    return _rounded(Cascade({"f8": level, "f16": level, "f32": level}).search(query, ["f16", "f8", "f32"], rows))


def _cascade_ann(spark, d):
    """All queries at once, and a first level that uses the buckets where they have enough rows."""
    v = _signed(_vectors(spark, d), "embedding")
    rows, dims = v.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    level = VectorIndex(v, rows, dims, lsh.hyperplanes(BITS, DIMS))
    return _rounded(Cascade({"f8": level, "f16": level, "f32": level}).search(_queries(v), ["f16", "f8", "f32"], 10))


def _levels(spark, d):
    v = _vectors(spark, d)
    levels = spark.createDataFrame([(x,) for x in V.LEVELS], "level string")
    return _cells(v, V.quantize("embedding", "f16")).join(F.broadcast(levels))  # four rows


def _folder(spark: SparkSession) -> str:
    """A new folder for single files, as the driver and the executors see it."""
    path = store.shared_folder(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def _matrix(vectors: DataFrame) -> np.ndarray:
    """In the driver's memory, as the sources that start there ask for it."""
    return np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], dtype=np.float32)


def _index(spark: SparkSession, d: str, **kwargs) -> VectorIndex:
    return build_index(_vectors(spark, d), store.shared_folder(spark), bits=BITS, **kwargs)


def _embedding_cells(vectors: DataFrame) -> DataFrame:
    return _cells(vectors, F.col("embedding"))


def _index_roundtrip(spark, d):
    return _embedding_cells(_index(spark, d).vectors)


def _index_reuse(spark, d):
    path = store.shared_folder(spark)
    for _ in range(2):
        index = build_index(_vectors(spark, d), path, use_ann=False, reuse=True)
    return _embedding_cells(index.vectors).withColumn("builds", F.lit(len(store.folders(spark, path))).cast("long"))


def _csv(strict: bool):
    def run(spark, d):
        path = store.shared_folder(spark)
        line = F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string")))
        if not strict:
            line = F.when(F.col("vec_id") % 9 == 0, F.concat(F.lit("# note\n\n"), line, F.lit(" # more"))).otherwise(line)
        _vectors(spark, d).repartitionByRange("vec_id").sortWithinPartitions("vec_id").select(line).write.text(path)
        return _embedding_cells(files.read_csv(spark, path, strict))

    return run


def _npy(spark, d):
    path = f"{_folder(spark)}/m.npy"
    np.save(path, _matrix(_vectors(spark, d)))
    return _embedding_cells(files.read_npy(spark, path))


def _bin(spark, d):
    return _embedding_cells(files.read_bin(spark, files.write_bin(_vectors(spark, d), f"{_folder(spark)}/m.bin")))


def _csv_to_bin(spark, d):
    """CSV to a normalised .bin file, by one call."""
    path = f"{_folder(spark)}/m.csv"
    np.savetxt(path, _matrix(_holed(_vectors(spark, d))), delimiter=",", fmt="%.9g")
    return _embedding_cells(files.read_bin(spark, files.build_from_csv(spark, path, normalize=True)))


def _ann_file(spark, d):
    planes = files.read_ann(files.write_ann(lsh.hyperplanes(BITS, DIMS), f"{_folder(spark)}/p.ann"))
    return _vectors(spark, d).select("vec_id", lsh.signature("embedding", planes).alias("sig"))


def _get_vector(spark, d):
    row = _index(spark, d, use_ann=False).get_vector(7)
    return _embedding_cells(spark.createDataFrame([(7, row)], "vec_id long, embedding array<double>"))


def _facade(spark, d):
    found = VectorSearch.from_embeddings(_vectors(spark, d), base_dir=store.shared_folder(spark), use_ann=False, level="f16", spark=spark)
    row = found.index.get_vector(50)
    return _rounded(spark.createDataFrame([(r["idx"], r["score"]) for r in found.query(row, K)], "vec_id long, score double"))


def _methods(spark, d):
    index = _index(spark, d, use_ann=False)
    queries = _queries(index.vectors)
    each = [index.search(queries, K, method=m).withColumn("method", F.lit(m)) for m in V.METHODS]
    return _rounded(reduce(DataFrame.unionByName, each))


def _similar_row(spark, d):
    return _rounded(_index(spark, d, use_ann=False).similar(50, K))


def _index_subset(spark, d):
    index = _index(spark, d)
    return _rounded(index.search_subset(_queries(index.vectors), index.vectors.where("vec_id % 3 = 0").select("vec_id"), K))


def _index_search(spark, d):
    index = _index(spark, d)
    return _rounded(index.search(_queries(index.vectors), 30))


def _cascade_sizes(spark, d):
    v = _vectors(spark, d)
    rows, dims = v.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    cascade = Cascade({level: VectorIndex(v, rows, dims, None, level) for level in ("f8", "f32")})
    return spark.createDataFrame([(level, cascade.dims()[level], n) for level, n in cascade.rows().items()], "level string, dims long, n long")


def _cascade_two(spark, d):
    v = _vectors(spark, d)
    rows, dims = v.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    level = VectorIndex(v, rows, dims, None)
    return _rounded(Cascade({"f16": level, "f32": level}).search(_queries(v), ["f16", "f32"], 20))


def _sql_functions(spark, d):
    V.register_sql_functions(spark)
    v = _vectors(spark, d)
    pairs = v.join(v.select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("head")), F.expr("vec_id - vec_id % 50 = head_id"))
    return pairs.select("vec_id", "head_id", F.expr("round(nf_dot(embedding, head), 6) + 0D").alias("dot"), F.expr("round(nf_norm(embedding), 6)").alias("norm"), F.expr("round(nf_normalize(embedding)[0], 6) + 0D").alias("first"))


def _dots(spark, d):
    """Each row with the row whose id is the next lower one divisible by 50."""
    v = _vectors(spark, d)
    pairs = v.join(v.select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("head")), F.expr("vec_id - vec_id % 50 = head_id"))
    return pairs.select("vec_id", "head_id", (F.round(V.dot("embedding", "head"), 6) + F.lit(0.0)).alias("dot"))


def _stream(spark, d):
    v, path = _vectors(spark, d), store.shared_folder(spark)
    _queries(v).write.parquet(f"{path}/in")
    rows, dims = v.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    stream = spark.readStream.schema("qid long, q array<double>").parquet(f"{path}/in")
    score_stream(stream, VectorIndex(v, rows, dims, None), K, f"{path}/out", f"{path}/log").awaitTermination()
    return _rounded(spark.read.parquet(f"{path}/out").drop("batch_id"))


def _sql_topk(score: str = "dot(q.u, v.e)", k: int = K, where: str = "", vectors: str = "v", extra: str = "") -> str:
    return f"""SELECT qid, rnk::INT AS rnk, vec_id, round(score, 6) + 0.0::DOUBLE AS score{extra} FROM (
  SELECT q.vec_id AS qid, v.vec_id, {score} AS score{', n_cand' if extra else ''}, row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, v.vec_id{', v.ord' if vectors != 'v' else ''}) AS rnk
  FROM q, {vectors} v {where}) WHERE rnk <= {k}"""


def _planes_sql(planes: np.ndarray) -> str:
    return "VALUES " + ", ".join(f"({j}, [{', '.join(repr(float(x)) + '::DOUBLE' for x in h)}])" for j, h in enumerate(planes))


WITH = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT vec_id, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v WHERE vec_id % 50 = 0)"""


def _sql(body: str, more: str = "") -> str:
    return re.sub(r"(?<![a-z_])dot\(", "list_dot_product(", f"{WITH}{more}\n{body}")


def _signed_sql(bits: int = BITS, planes: np.ndarray | None = None) -> str:
    return f""", h(bit, plane) AS ({_planes_sql(lsh.hyperplanes(bits, DIMS) if planes is None else planes)}),
s AS (SELECT vec_id, sum(CASE WHEN dot(e, plane) >= 0 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS sig FROM v, h GROUP BY vec_id),
c AS (SELECT sig, count(*) AS n_cand FROM s GROUP BY sig)"""


def _sql_cells(value: str) -> str:
    z = "(SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(e, lambda x: 0.0::DOUBLE) ELSE e END AS e FROM v)"
    return f"SELECT vec_id, (unnest(range(len(e))))::INT AS pos, round(unnest({value}), 6) AS value FROM {z}"


PLAIN_CELLS = "SELECT vec_id, unnest(range(len(e)))::INT AS pos, round(unnest(e), 6) AS value FROM v"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def exact(k, unit=True, vectors=lambda v: v):
        def run(spark, d):
            v = _vectors(spark, d)
            return _rounded(S.topk_exact(vectors(v), _unit(v) if unit else _queries(v), k))

        return run

    def pairs(spark, d):
        v = _vectors(spark, d)
        return _rounded(S.topk_exact(v, _queries(v), v.count()))

    return {
        "vector_norms": lambda s, d: _vectors(s, d).select("vec_id", F.round(V.norm("embedding"), 6).alias("norm")),
        "normalize_lenient": lambda s, d: _cells(_holed(_vectors(s, d)), V.normalize_lenient("embedding")),
        "normalize_clamped": lambda s, d: _cells(_holed(_vectors(s, d)), V.normalize_clamped("embedding")),
        "dot_pairs": pairs,
        "collection_shape": _shape,
        "point_lookup": lambda s, d: _cells(_vectors(s, d).where("vec_id = 7"), F.col("embedding")),
        "topk_exact": exact(K),
        "topk_unnormalized_rows": exact(K, vectors=_scaled),
        "topk_raw_query": exact(K, unit=False),
        "topk_similar": lambda s, d: _rounded(S.topk_similar(_vectors(s, d), _vectors(s, d).where("vec_id % 50 = 0"), K)),
        "topk_subset": _subset,
        "topk_over_ask": exact(1_000_000),
        "topk_zero": exact(0),
        "lsh_signature": lambda s, d: _signed(_vectors(s, d), "embedding").select("vec_id", "sig"),
        "lsh_bucket_sizes": lambda s, d: lsh.buckets(_signed(_vectors(s, d), "embedding")),
        "lsh_candidates": lambda s, d: S.candidates(_signed(_vectors(s, d), "embedding"), _signed(_unit(_vectors(s, d)), "q")).select("qid", "vec_id"),
        "topk_ann_bucket_only": _ann(False),
        "topk_ann_fallback": _ann(True),
        "topk_ann_fallback_default_bits": _ann(True, lsh.DEFAULT_BITS),
        "cascade_f16_f8_f32": _cascade,
        "cascade_ann_all_queries": _cascade_ann,
        "level_identity": _levels,
        "index_roundtrip": _index_roundtrip,
        "index_reuse": _index_reuse,
        "index_search": _index_search,
        "index_subset": _index_subset,
        "index_get_vector": _get_vector,
        "index_similar_row": _similar_row,
        "search_methods": _methods,
        "source_memory": lambda s, d: _embedding_cells(files.from_matrix(s, _matrix(_vectors(s, d)))),
        "source_npy": _npy,
        "source_csv_lenient": _csv(False),
        "source_csv_strict": _csv(True),
        "bin_roundtrip": _bin,
        "csv_to_bin": _csv_to_bin,
        "ann_file_signature": _ann_file,
        "facade_query": _facade,
        "lsh_bucket_members": lambda s, d: lsh.members(_signed(_vectors(s, d), "embedding")),
        "cascade_sizes": _cascade_sizes,
        "cascade_f16_f32_all_queries": _cascade_two,
        "dot_products": _dots,
        "sql_functions": _sql_functions,
        "stream_topk": _stream,
    }


def oracle_sql() -> dict[str, str]:
    unit = "CASE WHEN dot(e, e) > 0 THEN list_transform(e, lambda x: x / sqrt(dot(e, e))) ELSE e END"
    clamp = "list_transform(e, lambda x: x / greatest(sqrt(dot(e, e)), 1e-12))"
    scaled = "(SELECT vec_id, list_transform(e, lambda x: (x * (1 + vec_id % 7))::FLOAT::DOUBLE) AS e FROM v)"
    subset = f"(SELECT x.vec_id, x.ord, v.e FROM ({SUBSET_SQL}) x JOIN v ON v.vec_id = x.vec_id)"
    in_bucket = "JOIN s sv ON sv.vec_id = v.vec_id JOIN s sq ON sq.vec_id = q.vec_id"
    fallback_from = _sql_topk(k=30, extra=", n_cand < 30 AS used_fallback", where="JOIN s sv ON sv.vec_id = v.vec_id JOIN s sq ON TRUE JOIN c ON c.sig = sq.sig WHERE sq.vec_id = q.vec_id AND (sq.sig = sv.sig OR n_cand < 30)")
    stage = "SELECT vec_id, sc FROM (SELECT *, row_number() OVER (ORDER BY sc DESC, vec_id) AS r FROM {src}) WHERE r <= {k}"
    n = "(SELECT count(*) FROM v)"
    first = f"greatest(1, {n} // 10)"
    cascade = f""", a AS (SELECT v.vec_id, dot(q.u, v.e) AS sc FROM q, v WHERE q.vec_id = 0),
b AS ({stage.format(src='a', k=first)}), c AS ({stage.format(src='b', k=f'greatest(1, ({first}) // 100)')})"""
    each = "SELECT qid, vec_id, sc FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, vec_id) AS r FROM {src}) WHERE r <= {k}"
    second = f"greatest(1, ({first}) // 100)"
    cascade_ann = f""", a1 AS (SELECT q.vec_id AS qid, v.vec_id, dot(q.u, v.e) AS sc FROM q, v JOIN s sv ON sv.vec_id = v.vec_id JOIN s sq ON TRUE JOIN c ON c.sig = sq.sig
  WHERE sq.vec_id = q.vec_id AND (sq.sig = sv.sig OR n_cand < {first})),
b1 AS ({each.format(src='a1', k=first)}), c1 AS ({each.format(src='b1', k=second)})"""
    return {
        "vector_norms": _sql("SELECT vec_id, round(sqrt(dot(e, e)), 6) AS norm FROM v"),
        "normalize_lenient": _sql(_sql_cells(unit)),
        "normalize_clamped": _sql(_sql_cells(clamp)),
        "dot_pairs": _sql(_sql_topk("dot(q.e, v.e)", 1_000_000)),
        "collection_shape": _sql("SELECT count(*) AS n, max(len(e))::BIGINT AS dims, min(len(e))::BIGINT AS min_len FROM v"),
        "point_lookup": _sql(f"SELECT * FROM ({PLAIN_CELLS}) WHERE vec_id = 7"),
        "topk_exact": _sql(_sql_topk()),
        "topk_unnormalized_rows": _sql(_sql_topk(vectors=scaled).replace(", v.ord", "")),
        "topk_raw_query": _sql(_sql_topk("dot(q.e, v.e)")),
        "topk_similar": _sql(_sql_topk("dot(q.e, v.e)")),
        "topk_subset": _sql(_sql_topk(vectors=subset)),
        "topk_over_ask": _sql(_sql_topk(k=1_000_000)),
        "topk_zero": _sql(_sql_topk(k=0)),
        "lsh_signature": _sql("SELECT vec_id, sig FROM s", _signed_sql()),
        "lsh_bucket_sizes": _sql("SELECT sig, count(*) AS n, min(vec_id) AS first_vec_id FROM s GROUP BY sig", _signed_sql()),
        "lsh_candidates": _sql("SELECT a.vec_id AS qid, b.vec_id FROM s a JOIN s b ON a.sig = b.sig WHERE a.vec_id % 50 = 0", _signed_sql()),
        "topk_ann_bucket_only": _sql(_sql_topk(where=in_bucket.replace("JOIN s sq ON sq.vec_id = q.vec_id", "JOIN s sq ON sq.sig = sv.sig") + " WHERE sq.vec_id = q.vec_id"), _signed_sql()),
        "topk_ann_fallback": _sql(fallback_from, _signed_sql()),
        "topk_ann_fallback_default_bits": _sql(fallback_from, _signed_sql(lsh.DEFAULT_BITS)),
        "cascade_f16_f8_f32": _sql("SELECT 0::BIGINT AS qid, row_number() OVER (ORDER BY sc DESC, vec_id)::INT AS rnk, vec_id, round(sc, 6) + 0.0::DOUBLE AS score FROM c", cascade),
        "cascade_ann_all_queries": _sql("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, vec_id)::INT AS rnk, vec_id, round(sc, 6) + 0.0::DOUBLE AS score FROM c1 QUALIFY rnk <= 10", _signed_sql() + cascade_ann),
        "level_identity": _sql(f"SELECT vec_id, pos, value, level FROM ({PLAIN_CELLS}), (VALUES ('f8'), ('f16'), ('f32'), ('f64')) l(level)"),
        "index_roundtrip": _sql(PLAIN_CELLS),
        "index_reuse": _sql(f"SELECT *, 1::BIGINT AS builds FROM ({PLAIN_CELLS})"),
        "index_search": _sql(fallback_from.replace(", n_cand < 30 AS used_fallback", ""), _signed_sql()),
        "index_subset": _sql(_sql_topk(vectors="(SELECT vec_id, e, 0 AS ord FROM v WHERE vec_id % 3 = 0)")),
        "index_get_vector": _sql(f"SELECT * FROM ({PLAIN_CELLS}) WHERE vec_id = 7"),
        "index_similar_row": _sql(f"SELECT * FROM ({_sql_topk('dot(q.e, v.e)')}) WHERE qid = 50"),
        "search_methods": _sql(f"SELECT * FROM ({_sql_topk()}), (VALUES ('scalar'), ('simd'), ('auto')) m(method)"),
        "source_memory": _sql(PLAIN_CELLS),
        "source_npy": _sql(PLAIN_CELLS),
        "source_csv_lenient": _sql(PLAIN_CELLS),
        "source_csv_strict": _sql(PLAIN_CELLS),
        "bin_roundtrip": _sql(PLAIN_CELLS),
        "csv_to_bin": _sql(_sql_cells(f"list_transform({unit}, lambda x: x::FLOAT::DOUBLE)")),
        "ann_file_signature": _sql("SELECT vec_id, sig FROM s", _signed_sql(planes=lsh.hyperplanes(BITS, DIMS).astype(np.float32))),
        "facade_query": _sql(f"SELECT vec_id, score FROM ({_sql_topk()}) WHERE qid = 50"),
        "lsh_bucket_members": _sql("SELECT sig, vec_id FROM s", _signed_sql()),
        "cascade_sizes": "SELECT level, max(len(embedding))::BIGINT AS dims, count(*) AS n FROM embeddings, (VALUES ('f8'), ('f32')) l(level) GROUP BY level",
        "cascade_f16_f32_all_queries": _sql(f"SELECT * FROM ({_sql_topk(k=20)}) WHERE rnk <= {first}"),
        "dot_products": _sql("SELECT a.vec_id, b.vec_id AS head_id, round(dot(a.e, b.e), 6) + 0.0::DOUBLE AS dot FROM v a JOIN v b ON a.vec_id - a.vec_id % 50 = b.vec_id"),
        "sql_functions": _sql("SELECT a.vec_id, b.vec_id AS head_id, round(dot(a.e, b.e), 6) + 0.0::DOUBLE AS dot, round(sqrt(dot(a.e, a.e)), 6) AS norm, round(a.e[1] / sqrt(dot(a.e, a.e)), 6) + 0.0::DOUBLE AS first FROM v a JOIN v b ON a.vec_id - a.vec_id % 50 = b.vec_id"),
        "stream_topk": _sql(_sql_topk()),
    }
