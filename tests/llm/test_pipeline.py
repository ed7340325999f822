import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from nearfield.llm import mixing, quality
from tests.llm.test_pairs import brute_components, brute_contained
from tests.oracle import DATA


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_stages_match_brute_force(spark, tmp_path, scale):
    d = f"{DATA}/{scale}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{i}")
        seen.append((docs, docs := spark.read.parquet(f"{tmp_path}/{i}")))
        assert i == len(P.STAGES) - 1 or docs.columns == columns
    labels = spark.read.parquet(f"{d}/labels.parquet")
    good = {r.doc_id for r in quality.scored(seen[0][0], labels).where("predicted = 1").collect()}
    assert {r[0] for r in rows_of(seen[0][1])} == good
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    there = {r[0] for r in rows_of(seen[0][0])}
    assert len(clean & good) > 0.97 * len(clean & there)
    before = [r[:2] for r in rows_of(seen[1][0])]
    assert sorted(r[0] for r in rows_of(seen[1][1])) == sorted(i for i, (_, root) in brute_components(before, 80).items() if i == root)
    before, items = [r[:2] for r in rows_of(seen[2][0])], [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {x[0] for x in brute_contained(before, items)}
    assert leaked and sorted(r[0] for r in rows_of(seen[2][1])) == sorted(i for i, _ in before if i not in leaked)
    want = sorted(r.doc_id for r in mixing.mixed(seen[3][0]).collect() for _ in range(r.copies))
    assert sorted(r[0] for r in rows_of(seen[3][1])) == want
    library, at, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc_id, text, _ in sorted(rows_of(seen[4][0])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in seen[4][1].collect())
    assert got == out
    if scale == "sf0.001":
        assert sorted((r.doc_id, r.start, r.n_tokens) for r in P.run(spark, d).collect()) == [o[:3] for o in out]


def test_odd_rows_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, kept string"
    rows = [(1, None, None, None, None, 1, "a"), (1, None, None, None, None, 1, "a"), (None, "no id", "en", "s", 5, 1, "a"), (2, "", "en", "s", 0, None, None), (3, "word " * 30000, "en", "s", 9, 1, "b")]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, f"{DATA}/sf0.001")
            assert out.columns == docs.columns
            assert out.count() <= 3 * len(some)
        assert P.STAGES[-1][1](spark, docs, f"{DATA}/sf0.001").count() == len(some)


def test_rows_are_judged_by_themselves(spark):
    d = f"{DATA}/sf0.001"
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    item = spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d")), (3, text("d")), (7, text("a")), (8, None)]
    kept = lambda stage, some: sorted(((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame(some, "doc_id long, text string"), d).collect()), key=repr)
    assert kept(P.drop_near_duplicates, rows) == sorted([(None, text("b")), (5, text("c")), (3, text("d")), (7, text("a")), (8, None)], key=repr)
    rows = [(None, item), (1, item), (1, text("a")), (None, text("b"))]
    assert kept(P.drop_benchmark, rows) == sorted(rows[2:], key=repr)


def test_quality_is_judged_by_row(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    by_label = {r.predicted: r.doc_id for r in quality.scored(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    good, bad = (docs.where(f"doc_id = {by_label[p]}").first().text for p in (1, 0))
    more = [(10**9, good), (10**9, bad), (None, bad), (None, good), (10**9 + 1, bad)]
    got = P.keep_quality(spark, docs.union(spark.createDataFrame(more, docs.schema)), d).where("doc_id IS NULL OR doc_id >= 1000000000").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(10**9, good), (None, good)], key=repr)
    clash = docs.withColumn("_statistics0", F.lit(1)).withColumn("upper", F.lit("x"))
    assert P.keep_quality(spark, clash, d).columns == clash.columns
