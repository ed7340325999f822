import pytest
from pyspark.sql import functions as F

from nearfield.operators import search as S
from nearfield.plans import queries as Q
from tests.oracle import DATA, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.01")


@pytest.mark.parametrize("name", list(Q.queries()))
def test_same_as_sql(spark, con, name):
    compare(Q.queries()[name](spark, f"{DATA}/sf0.01"), con, Q.oracle_sql()[name])


def test_recall_of_default_bits(spark):
    d = f"{DATA}/sf0.1"
    v = Q._vectors(spark, d)
    exact = {(r.qid, r.vec_id) for r in S.topk_exact(v, Q._unit(v), 30).collect()}
    recall = {name: len({(r.qid, r.vec_id) for r in Q.queries()[name](spark, d).collect()} & exact) / len(exact) for name in ("topk_ann_fallback", "topk_ann_fallback_default_bits")}
    assert recall["topk_ann_fallback_default_bits"] >= 0.9


def test_cascade_returns_all_that_its_last_level_keeps(spark, tmp_path):
    d, table = str(tmp_path), spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    copies = table.crossJoin(spark.range(24).withColumnRenamed("id", "copy"))  # 12,000 rows: the levels keep 1,200 and then 12
    copies.withColumn("vec_id", F.expr("vec_id + 500 * copy")).drop("copy").write.parquet(f"{d}/embeddings.parquet")
    found = Q.queries()["cascade_f16_f8_f32"](spark, d)
    assert found.count() == 12
    compare(found, connect(d), Q.oracle_sql()["cascade_f16_f8_f32"])
