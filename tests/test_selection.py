"""Exact percentiles of groups by selection against numpy."""

import numpy as np
from pyspark.sql import functions as F

from bandloom.operators import stats, symbology


def test_groups_of_all_kinds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(0, 1, 3000), "ties": np.repeat([1.0, 2.0, 7.5], [10, 2000, 3]), "one": np.array([4.25]), "two": np.array([-1.0, 3.0]), None: rng.integers(-5, 5, 900).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 500) * rng.choice([-1, 1], 500)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("normal", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    fractions = [0.0, 0.02, 0.5, 0.731, 0.98, 1.0]
    for ranges in (256, 4, 1):
        got = {r.g: r for r in stats.group_percentiles(df, ["g"], F.col("v"), fractions, ranges).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert got[g].n == len(vs) and np.allclose(got[g].p, np.percentile(vs, [100 * f for f in fractions]), rtol=1e-12, atol=1e-12)
    small = {r.g: tuple(r) for r in stats.value_stats(df, "v", by=["g"]).collect()}
    monkeypatch.setattr(stats, "SMALL_BYTES", 0)
    large = {r.g: tuple(r) for r in stats.value_stats(df, "v", by=["g"]).collect()}
    assert set(small) == set(large) and all(np.allclose(small[g][1:], large[g][1:], rtol=1e-12) for g in small)
    assert large["none"][1:] == (0.0, 1.0, 0.0, 1.0)


def test_ranges_of_maps_without_one_buffer(spark, monkeypatch):
    df = spark.range(1000).selectExpr("cast(id as int) row", "0 col", "sqrt(id) v")
    want = symbology.range_row(df, "v", "percentile", None).first()
    assert np.allclose(tuple(want), np.percentile(np.sqrt(np.arange(1000)), [2, 98]))
    monkeypatch.setattr(symbology.percentile_row, "__defaults__", (0,))
    assert np.allclose(tuple(symbology.range_row(df, "v", "percentile", None).first()), tuple(want))
    assert tuple(symbology.range_row(df.where("false"), "v", "percentile", None).first()) == (0.0, 1.0)
    assert tuple(symbology.range_row(df, "v", "fixed", (2.0, 3.0)).first()) == (2.0, 3.0)


def test_small_groups_have_one_aggregate_and_large_ones_are_selected(spark):
    rng = np.random.default_rng(6)
    sizes = {k: 40 for k in range(300)} | {None: 700, 1000: 900}
    groups = {g: rng.normal(0, 1, n) for g, n in sizes.items()}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g int, v double").repartition(3)
    for few in (0, 100, 10_000):
        got = {r.g: r for r in stats.group_percentiles(df, ["g"], F.col("v"), [0.02, 0.5, 0.98], few=few).collect()}
        assert set(got) == set(groups)
        assert all(got[g].n == len(vs) and np.allclose(got[g].p, np.percentile(vs, [2, 50, 98]), rtol=1e-12, atol=1e-12) for g, vs in groups.items())
    plan = lambda few: stats.group_percentiles(df, ["g"], F.col("v"), [0.5], few=few)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile-cuts" not in plan(10_000) and plan(10_000).count("Join") == 0


def test_a_percentile_of_a_large_table_takes_three_passes(spark):
    """One sketch, one count and one look between for all names, instead of a sort for each."""
    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as double) as a", "sqrt(id) as b")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("three-passes", "")
    try:
        row = stats.percentile_row(df, {"a": F.col("a"), "b": F.col("b")}, [0.01, 0.5, 0.99], small=-1).first()
        jobs = len(tracker.getJobIdsForGroup("three-passes"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = df.collect()
    for n in "ab":
        assert np.allclose(row[n], np.percentile([r[n] for r in rows], [1, 50, 99]), rtol=1e-13)
    assert jobs <= 10


def test_scores_of_single_indices_take_every_row(spark, sf_dir, monkeypatch):
    import duckdb

    from bandloom.operators import training
    from bandloom.plans.catalog import ORACLES, QUERIES

    monkeypatch.setattr(training.balanced_sample, "__defaults__", ("label", 20))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf_dir}/orders.parquet'")
    want = con.execute(f"SELECT name, place, iou, f1, suggested_threshold, normalized FROM ({ORACLES['index_scores']}) ORDER BY place").fetchall()
    assert [tuple(r) for r in QUERIES["index_scores"](spark, sf_dir).orderBy("place").collect()] == want


def test_newton_steps_settle_far_from_the_start(spark):
    """Well separated classes and wide features: as few passes as it takes, and the gradient is zero."""
    from bandloom.operators import training

    rng = np.random.default_rng(9)
    x = rng.normal(0, 300, 400)
    y = (x > 20).astype(int)
    (w,), b = training.fit_logistic(spark.createDataFrame([(float(a), int(c)) for a, c in zip(x, y, strict=True)], "a double, label int"), ["a"])
    k = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum()))
    off = k * (1 / (1 + np.exp(-(w * x + b))) - y)
    assert abs(w + (off * x).sum()) < 1e-4 and abs(b + off.sum()) < 1e-4


def test_precomputed_maps_are_those_of_every_pixel(spark, sf_dir, monkeypatch):
    from bandloom.plans import engine
    from bandloom.plans.catalog import QUERIES

    monkeypatch.setattr(engine, "PREVIEW_SIDE", 8)
    got = QUERIES["precompute_indices"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
