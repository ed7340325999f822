import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import VectorSearch, build_index, open_index
from nearfield.functions import lsh
from nearfield.functions import vectors as V
from nearfield.operators import search as S
from nearfield.operators.cascade import Cascade
from nearfield.plans.index import VectorIndex
from nearfield.sources import files
from nearfield.streaming.score import score_stream


def brute(matrix, q, k, ids=None):
    ids = list(range(len(matrix))) if ids is None else ids
    scored = sorted(((-float(np.dot(matrix[i].astype(float), q)), i) for i in ids))
    return [i for _, i in scored[:k]]


@pytest.fixture(scope="module")
def matrix():
    m = np.random.default_rng(0).standard_normal((300, 16)).astype(np.float32) * np.linspace(0.5, 3, 300)[:, None].astype(np.float32)
    m[5] = 0
    m[40:45] = m[39]
    return m


@pytest.fixture(scope="module")
def frame(spark, matrix):
    return files.from_matrix(spark, matrix).repartition(4).cache()


def got(found):
    return [r.vec_id for r in found.orderBy("qid", "rnk").collect()]


@pytest.mark.parametrize("k", [0, 1, 7, 300, 400])
def test_exact_matches_brute_force(spark, frame, matrix, k):
    q = matrix[39].astype(float)
    assert got(S.topk_exact(frame, S.queries_frame(spark, [q]), k)) == brute(matrix, q, k)


def test_similar_includes_itself_and_ties_go_by_id(spark, frame, matrix):
    found = got(S.topk_similar(frame, spark.createDataFrame([(41,)], "vec_id long"), 300))
    at = found.index(39)
    assert found[at : at + 6] == list(range(39, 45))
    assert set(found[: at + 6]) == set(brute(matrix, matrix[41].astype(float), at + 6))


def test_subset_repeats_and_drops(spark, frame, matrix):
    index = VectorIndex(frame, 300, 16, None)
    found = [r.vec_id for r in index.search_subset(matrix[3], [3, 3, 9, 999], 10).orderBy("rnk").collect()]
    assert sorted(found) == [3, 3, 9] and found[:2] == [3, 3]
    assert index.search_subset(matrix[3], [], 10).count() == 0
    assert {r.score for r in index.search_subset(np.zeros(16), [1, 2], 5).collect()} == {0.0}


def test_fallback_boundary(spark, frame, matrix):
    planes = lsh.hyperplanes(3, 16)
    signed = frame.withColumn("sig", lsh.signature("embedding", planes))
    q = S.queries_frame(spark, [matrix[7]]).withColumn("sig", lsh.signature("q", planes))
    n = signed.where(F.col("sig") == q.first().sig).count()
    for k, fell in ((n, False), (n + 1, True)):
        found = S.topk_ann(signed, q, k)
        assert {r.used_fallback for r in found.collect()} == {fell}
        assert found.count() == k


def test_zero_policies(spark, frame):
    with pytest.raises(ValueError):
        V.normalize_query(np.zeros(8), "facade")
    with pytest.raises(ValueError):
        V.normalize_query(np.full(8, 1e-9), "strict")
    assert V.normalize_query(np.full(8, 1e-9), "facade") @ np.ones(8) == pytest.approx(8**0.5)
    assert not V.normalize_query(np.zeros(8), "lenient").any()
    with pytest.raises(Exception, match="query without length"):
        S.normalized_queries(S.queries_frame(spark, [np.zeros(8)])).collect()


def test_zero_vector_signature_is_all_ones(spark):
    one = files.from_matrix(spark, np.zeros((1, 8)))
    assert one.select(lsh.signature("embedding", lsh.hyperplanes(5, 8))).first()[0] == 31


def test_index_roundtrip_and_reuse(spark, frame, matrix, tmp_path):
    path = str(tmp_path / "i")
    a = build_index(frame, path, bits=4)
    assert (a.rows(), a.dims()) == (300, 16)
    assert np.allclose(a.get_vector(17), matrix[17])
    with pytest.raises(ValueError, match="Index out of limits"):
        a.get_vector(300)
    with pytest.raises(ValueError, match="Invalid index"):
        a.similar(-1, 3)
    b = build_index(frame.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), path, bits=4, reuse=True)
    assert np.allclose(b.get_vector(17), matrix[17] * 2)
    assert got(open_index(spark, path).search(matrix[0], 5, use_ann=False)) == brute(matrix, matrix[0].astype(float), 5)
    a = open_index(spark, path)
    for method in V.METHODS:
        assert a.search(matrix[2], 3, method=method).count() == 3
    with pytest.raises(ValueError):
        a.search(matrix[2], 3, method="gpu")
    with pytest.raises(ValueError):
        a.search(matrix[2][:5], 3)


@pytest.mark.parametrize(("rows", "words"), [([(0, [1.0, None])], "null"), ([(3, [float("nan"), 1.0])], "vec_id 3"), ([(0, [1.0]), (1, [1.0, 2.0])], "vec_id 0"), ([], "at least one"), ([(0, None)], "null")])
def test_bad_rows_are_refused(spark, tmp_path, rows, words):
    with pytest.raises(ValueError, match=words):
        build_index(spark.createDataFrame(rows, files.SCHEMA), str(tmp_path / "x"))


def test_nulls_and_extra_columns_in_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 9, "a"), (2, None, 9, "b"), (None, [1.0, 1.0], 9, "c")], "vec_id long, embedding array<float>, rnk int, ord string")
    q = spark.createDataFrame([(0, [1.0, 0.0], 5.0), (1, None, 1.0)], "qid long, q array<double>, score double")
    assert [tuple(r) for r in S.topk_exact(v, q, 3).collect()] == [(0, 1, 1, 1.0)]
    assert S.topk_exact(v.limit(0), q, 3).count() == 0


def test_facade(spark, matrix, tmp_path):
    e = VectorSearch.from_embeddings(matrix, base_dir=str(tmp_path), use_ann=False, level="f16")
    q = matrix[9].copy()
    found = e.query(q, 4)
    assert [r["idx"] for r in found] == brute(matrix, q.astype(float), 4)
    assert np.array_equal(q, matrix[9])
    for bad, kind in ((np.zeros(16), ValueError), ("x", TypeError), (np.zeros((2, 2)), ValueError), (np.ones(3), RuntimeError)):
        with pytest.raises(kind):
            e.query(bad)
    for args, kind in (({"similarity": "l2"}, ValueError), ({"level": "f4"}, ValueError)):
        with pytest.raises(kind):
            VectorSearch.from_embeddings(matrix, base_dir=str(tmp_path), **args)
    for bad, kind in ((np.zeros((2, 7)), ValueError), (np.zeros((2, 4097)), ValueError), (np.zeros((0, 8)), ValueError), ("a.txt", ValueError), (5, TypeError), (np.zeros(8), ValueError)):
        with pytest.raises(kind):
            VectorSearch.from_embeddings(bad, base_dir=str(tmp_path))


def test_binary_and_npy(spark, frame, matrix, tmp_path):
    path = files.write_bin(frame, str(tmp_path / "d" / "m.bin"))
    back = {r.vec_id: r.embedding for r in files.read_bin(spark, path).collect()}
    assert all(np.array_equal(np.float32(back[i]), matrix[i]) for i in range(300))
    raw = open(path, "rb").read()
    assert struct.unpack("<II", raw[:8]) == (16, 300)
    (tmp_path / "t.bin").write_bytes(raw[:-1])
    (tmp_path / "u.bin").write_bytes(raw[:5])
    for x in ("t", "u"):
        with pytest.raises(ValueError):
            files.read_bin(spark, str(tmp_path / f"{x}.bin"))
    np.save(tmp_path / "m.npy", matrix.astype(np.float64))
    assert files.read_npy(spark, str(tmp_path / "m.npy")).orderBy("vec_id").first().embedding == [float(x) for x in matrix[0]]
    planes = lsh.hyperplanes(4, 16)
    assert np.allclose(files.read_ann(files.write_ann(planes, str(tmp_path / "p.ann"))), planes, atol=1e-6)


def test_csv_flavours(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n\n# note\n3, 4 # more\n")
    assert [(r.vec_id, r.embedding) for r in files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("vec_id").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    with pytest.raises(Exception, match="line 2"):
        files.read_csv(spark, str(tmp_path / "a.csv"), strict=True).collect()
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.read_csv(spark, str(tmp_path / "e.csv"), strict=True)
    (tmp_path / "b.csv").write_text("3,4\n0,0\n")
    out = files.build_from_csv(spark, str(tmp_path / "b.csv"), normalize=True)
    assert out.endswith("b_f32.bin")
    assert [r.embedding for r in files.read_bin(spark, out).orderBy("vec_id").collect()] == [[0.6000000238418579, 0.800000011920929], [0.0, 0.0]]


def test_cascade_keeps_fractions(spark, frame, matrix):
    level = VectorIndex(frame, 300, 16, None)
    cascade = Cascade({"f8": level, "f16": level, "f32": level, "other": level}, disable_ann=True)
    assert got(cascade.search(matrix[8])) == brute(matrix, matrix[8].astype(float), 1)
    assert got(cascade.search(matrix[8], ["f16", "f32"], 10)) == brute(matrix, matrix[8].astype(float), 10)
    with pytest.raises(ValueError):
        Cascade({"other": level})
    assert (cascade.rows(), cascade.dims()) == ({'f8': 300, 'f16': 300, 'f32': 300}, {'f8': 16, 'f16': 16, 'f32': 16}) and "ann=False" in repr(cascade)


def test_cascade_keeps_candidates_of_each_query(spark, frame, matrix):
    planes = lsh.hyperplanes(2, 16)
    for level in (VectorIndex(frame, 300, 16, None), VectorIndex(frame.withColumn("sig", lsh.signature("embedding", planes)), 300, 16, planes)):
        cascade = Cascade({"f8": level, "f16": level, "f32": level})
        found = cascade.search(S.queries_frame(spark, {i: matrix[i] for i in (8, 9, 39, 100)}), ["f16", "f32"], 30)
        for i in (8, 9, 39, 100):
            rows = sorted((r.rnk, r.vec_id) for r in found.where(f"qid = {i}").collect())
            assert rows == sorted((r.rnk, r.vec_id) for r in level.search(matrix[i], 30).collect()) and len(rows) == 30


def test_sql_functions(spark):
    V.register_sql_functions(spark)
    r = spark.sql("SELECT nf_dot(array(1f, 2f), array(3f, 4f)), nf_norm(array(3f, 4f)), nf_normalize(array(3f, 4f))").first()
    assert list(r) == [11.0, 5.0, [0.6, 0.8]]


def test_stream(spark, frame, matrix, tmp_path):
    S.queries_frame(spark, [matrix[1], matrix[2]]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, q array<double>").parquet(str(tmp_path / "in"))
    index = VectorIndex(frame, 300, 16, None)
    score_stream(stream, index, 3, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert got(found.where("qid = 1")) == brute(matrix, matrix[2].astype(float), 3)


def test_many_blocks_and_large_k(spark, frame, matrix, monkeypatch):
    queries = {i: matrix[i].astype(float) for i in (3, 39, 77, 200)}
    one = sorted(map(tuple, S.topk_exact(frame, S.queries_frame(spark, queries), 7).collect()))
    monkeypatch.setattr(S, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, S.topk_exact(frame, S.queries_frame(spark, queries), 7).collect())) == one
    monkeypatch.setattr(S, "KEPT_ROWS", 400)
    found = S.topk_exact(frame, S.queries_frame(spark, queries), 10**9)
    assert found.count() == 1200
    for i, q in queries.items():
        assert got(found.where(f"qid = {i}")) == brute(matrix, q, 300)


@pytest.mark.parametrize("k", [1, 3, 25])
def test_scores_that_are_no_numbers_match_nothing(spark, k):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(20, [float("nan"), 1.0]), (21, [float("inf"), 0.0]), (22, [float("-inf"), 0.0])]
    v = spark.createDataFrame(rows, files.SCHEMA).coalesce(1)
    found = [(r.vec_id, r.score) for r in S.topk_exact(v, S.queries_frame(spark, [[1.0, 1.0]]), k).orderBy("rnk").collect()]
    assert found == ([(21, float("inf"))] + [(i, i + 1.0) for i in reversed(range(20))] + [(22, float("-inf"))])[:k]


def test_hot_bucket_is_not_moved(spark, matrix):
    signed = files.from_matrix(spark, matrix).repartition(6).withColumn("sig", F.when(F.col("vec_id") % 10 == 0, F.col("vec_id")).when(F.col("vec_id") % 11 > 0, 1))
    q = spark.createDataFrame([(i, [float(x) for x in matrix[i]], s) for i, s in ((1, 1), (2, 1), (10, 10), (4, 999), (5, None))], "qid long, q array<double>, sig long")
    found = S.topk_bucket(signed, q, 4)
    hot = [i for i in range(300) if i % 10 and i % 11]
    for i in (1, 2):
        assert got(found.where(f"qid = {i}")) == brute(matrix, matrix[i].astype(float), 4, hot)
    assert got(found.where("qid = 10")) == [10] and found.where("qid IN (4, 5)").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(sig" not in plan


def test_interrupted_build_is_never_read(spark, frame, tmp_path, monkeypatch):
    path, other = str(tmp_path / "i"), frame.withColumn("embedding", F.transform("embedding", lambda x: x + 1))
    first = build_index(frame, path, bits=4).get_vector(17)
    real = spark.createDataFrame

    def fails(data, schema=None, *args, **kwargs):
        if "content" in str(schema):
            raise OSError("interrupted")
        return real(data, schema, *args, **kwargs)

    monkeypatch.setattr(spark, "createDataFrame", fails)
    with pytest.raises(OSError):
        build_index(other, path, bits=4)
    monkeypatch.undo()
    assert open_index(spark, path).get_vector(17) == first == build_index(frame, path, bits=4, reuse=True).get_vector(17)
    assert build_index(other, path, bits=4, reuse=True).get_vector(17) != first
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))


def test_facade_reads_files(spark, matrix, tmp_path):
    np.save(tmp_path / "m.npy", matrix)
    np.savetxt(tmp_path / "m.csv", matrix, delimiter=",", fmt="%.9g")
    for name in ("m.npy", "m.csv"):
        e = VectorSearch.from_embeddings(str(tmp_path / name), base_dir=str(tmp_path / name[2:]), use_ann=False)
        assert [r["idx"] for r in e.query(matrix[9], 4)] == brute(matrix, matrix[9].astype(float), 4)
    np.save(tmp_path / "flat.npy", matrix[0])
    with pytest.raises(ValueError, match="two dimensions"):
        VectorSearch.from_embeddings(str(tmp_path / "flat.npy"), base_dir=str(tmp_path))


def test_csv_of_many_splits(spark, tmp_path):
    lines = [f"{i},{i / 7!r}" + (" # note" if i % 5 == 0 else "") for i in range(4000)]
    for part in range(2):
        (tmp_path / f"p{part}.csv").write_text("\n\n".join(lines[2000 * part : 2000 * part + 2000]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = files.read_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 4000 and all(r.embedding[0] == r.vec_id for r in found)


def test_logging_follows_its_variable(monkeypatch):
    import logging

    from nearfield import logs

    for value, level in (("info", logging.INFO), ("off", logging.CRITICAL + 1), ("nonsense", logging.CRITICAL + 1), (None, logging.CRITICAL + 1)):
        monkeypatch.setenv("NEARFIELD_LOG", value) if value else monkeypatch.delenv("NEARFIELD_LOG", raising=False)
        logs.setup()
        assert logging.getLogger("nearfield").level == level
