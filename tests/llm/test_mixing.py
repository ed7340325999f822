import math

import pytest
from pyspark.sql import functions as F

from nearfield.llm import mixing
from tests.oracle import DATA


def filled(sizes, weights=(5, 2, 1), most=3):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(w[k] for k in open_)
        over = {k for k in open_ if w[k] * level > most * sizes[k]}
        if not over:
            return out | {k: w[k] * level for k in open_}
        out |= {k: float(most * sizes[k]) for k in over}
        open_ -= over
    return out


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_targets_and_taken(spark, scale):
    docs = spark.read.parquet(f"{DATA}/{scale}/documents.parquet")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size > 0
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
    want = filled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert taken[s] == pytest.approx(want[s], rel=0.02)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.rate, r.copies) for r in again) == sorted((r.doc_id, r.rate, r.copies) for r in rows)


def test_rates_are_exponential_tilts(spark):
    rows = mixing.mixed(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).where("size > 0").collect()
    by = {}
    for r in rows:
        if r.rate < 3:
            by.setdefault(r.source, []).append(math.log(r.rate) / r.size)
    assert len(by) > 5
    for found in by.values():
        assert max(found) - min(found) < 1e-9
    for s in by:
        own = [r for r in rows if r.source == s]
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target, rel=1e-6)


def test_edges(spark):
    schema = "doc_id long, text string, source string, target string, copies int"
    rows = [(1, None, "a", "x", 1), (2, "", None, "x", 1), (3, "one two", None, "x", 1), (3, "one two", None, "x", 1), (4, "w " * 1000, "b", None, 1), (None, "q", "a", None, 1)]
    got = mixing.mixed(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in got)
    assert {r.source for r in got} == {"a", "b", None}
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    only = mixing.mixed(spark.createDataFrame([(1, None, "a", "", 0)], schema)).collect()
    assert [(r.size, r.taken, r.target) for r in only] == [(0, 0, 0.0)]


def test_hot_source_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 50)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "z").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    rows = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("a")).collect()
    for r in rows:
        assert r.t == pytest.approx(r.a, rel=0.02)


def test_many_sources_are_joined(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source")))
    rows = lambda: sorted(map(repr, mixing.mixed(docs, keep=("lang",)).collect()))
    small = rows()
    monkeypatch.setattr(mixing, "MOST_BROADCAST_SOURCES", 0)
    assert rows() == small and len(small) == docs.count()


def test_unfinished_tilts_and_clashing_columns_are_errors(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    with pytest.raises(ValueError, match="size"):
        mixing.mixed(docs.withColumn("size", F.lit(1)), keep=("size", "lang"))
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(ArithmeticError):
        mixing.mixed(docs)
