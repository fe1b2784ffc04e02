from pyspark.sql import functions as F

from bandloom import bounded
from bandloom.bounded import join_groups, split_by_ids


def test_members_are_never_missed(spark, monkeypatch):
    ids = spark.range(0, 20000, 7).selectExpr("id AS k").union(spark.createDataFrame([(None,)], "k bigint"))
    rows = spark.range(20000).selectExpr("id AS doc_id", "id AS block", "'x' AS mask").union(spark.createDataFrame([(None, 1, "x")], "doc_id bigint, block bigint, mask string"))
    for most in (bounded.MOST_IDS, 100):
        monkeypatch.setattr(bounded, "MOST_IDS", most)
        out, maybe = split_by_ids(rows, ids)
        assert out.columns == maybe.columns == rows.columns
        out, maybe = out.collect(), maybe.collect()
        assert len(out) + len(maybe) == 20001 and all(r.doc_id is None or r.doc_id % 7 for r in out)
        assert {r.doc_id for r in maybe} >= set(range(0, 20000, 7)) and all(r.doc_id is not None for r in maybe)
        assert most == 100 or len(maybe) < 4000


def test_no_ids(spark):
    out, maybe = split_by_ids(spark.range(5).withColumnRenamed("id", "doc_id"), spark.createDataFrame([], "k bigint"))
    assert out.count() == 5 and maybe.count() == 0


def test_hot_groups_join_like_others(spark):
    rows = spark.range(9000).selectExpr("CASE WHEN id < 3000 THEN 'hot' WHEN id < 8999 THEN 'k' || id END AS k", "id")
    groups = rows.where("k is not null").groupBy("k").agg(F.min("id").alias("first"), F.count("id").alias("n"))
    got = join_groups(rows, groups, ["k"], "n").collect()
    assert len(got) == 8999 and all(r["first"] == (0 if r.k == "hot" else r.id) and r.n == (3000 if r.k == "hot" else 1) for r in got)
