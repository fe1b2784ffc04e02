"""SQL of the logistic models: Newton steps on the penalised likelihood, written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.operators import training
from bandloom.plans.raster_queries import INDEX_SQL, REFL, _training_maps, query

_STEPS = 25


def _fit_sql(rows: str, name: str) -> str:
    """CTEs ending in ``name``(w0, w1, w2): two features x0, x1 and a constant, from a CTE ``rows``(x0, x1, y)."""
    z = "(w0 * x0 + w1 * x1 + w2)"
    p = f"(1 / (1 + exp(-{z})))"
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    x = ["x0", "x1", "1"]
    grad = ", ".join(f"sum(k * ({p} - y) * {x[i]}) + any_value(w{i}) AS g{i}" for i in range(3))
    hess = ", ".join(f"sum(k * {p} * (1 - {p}) * {x[i]} * {x[j]}){' + 1' if i == j else ''} AS h{i}{j}" for i, j in pairs)
    minors = {"m00": "h11 * h22 - h12 * h12", "m01": "h02 * h12 - h01 * h22", "m02": "h01 * h12 - h02 * h11", "m11": "h00 * h22 - h02 * h02", "m12": "h01 * h02 - h00 * h12", "m22": "h00 * h11 - h01 * h01"}
    inverse = ", ".join(f"{v} AS {k}" for k, v in minors.items())
    step = lambda i: "(" + " + ".join(f"m{min(i, j)}{max(i, j)} * g{j}" for j in range(3)) + ") / (h00 * m00 + h01 * m01 + h02 * m02)"
    return (
        f"{name}_n AS (SELECT count(*) AS n, sum(y) AS ones FROM {rows}), "
        f"{name}_d AS MATERIALIZED (SELECT x0, x1, y, CASE WHEN y = 1 THEN n / (2.0 * ones) ELSE n / (2.0 * (n - ones)) END AS k FROM {rows}, {name}_n), "
        f"{name}_w AS (SELECT 0 AS turn, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2 UNION ALL "
        f"SELECT turn + 1, w0 - {step(0)}, w1 - {step(1)}, w2 - {step(2)} FROM (SELECT *, {inverse} FROM (SELECT any_value(turn) AS turn, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, {grad}, {hess} FROM {name}_w, {name}_d WHERE turn < {_STEPS} HAVING count(*) > 0))), "
        f"{name} AS MATERIALIZED (SELECT w0, w1, w2 FROM {name}_w WHERE turn = {_STEPS})"
    )


_LIMIT = lambda v, f: f"quantile_cont({v}, {f})"
_MAPS = f"{REFL}, maps AS MATERIALIZED (SELECT row, col, {INDEX_SQL['ndvi']} AS x0, {INDEX_SQL['gli']} AS x1, CASE WHEN nir + green > red + blue THEN 1 ELSE 0 END AS y FROM refl WHERE nir IS NOT NULL)"
_CLIPPED = (
    f"q AS (SELECT {', '.join(f'{_LIMIT(c, 0.01)} AS lo{c}, {_LIMIT(c, 0.99)} AS hi{c}' for c in ('x0', 'x1'))} FROM maps), "
    f"clipped AS MATERIALIZED (SELECT row, col, y, {', '.join(f'least(greatest({c}, lo{c}), hi{c}) AS {c}' for c in ('x0', 'x1'))} FROM maps, q), "
    f"s AS (SELECT {', '.join(f'{_LIMIT(c, 0.5)} AS m{c}, {_LIMIT(c, 0.75)} - {_LIMIT(c, 0.25)} AS r{c}' for c in ('x0', 'x1'))} FROM clipped), "
    f"scaled AS MATERIALIZED (SELECT row, col, y, {', '.join(f'({c} - m{c}) / CASE WHEN r{c} = 0 THEN 1 ELSE r{c} END AS {c}' for c in ('x0', 'x1'))} FROM clipped, s)"
)
_BEST = (
    "p AS MATERIALIZED (SELECT y, 1 / (1 + exp(-(w2 + x0 * w0 + x1 * w1))) AS p FROM scaled, fit), "
    "t AS (SELECT k, 0.1 + k * (CAST(0.9 AS DOUBLE) - 0.1) / 16 AS t FROM range(17) r(k)), "
    "c AS (SELECT k, any_value(t) AS t, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn FROM p, t GROUP BY k), "
    "best AS (SELECT t, tp / (tp + fp + fn) AS iou, 2.0 * tp / (2.0 * tp + fp + fn) AS f1 FROM c ORDER BY iou DESC, k LIMIT 1)"
)


@query(
    f"WITH RECURSIVE {_MAPS}, {_CLIPPED}, {_fit_sql('scaled', 'fit')}, {_BEST} "
    "SELECT round(w0, 4) AS coef_ndvi, round(w1, 4) AS coef_gli, round(w2, 4) AS intercept, round(t, 4) AS threshold, round(iou, 4) AS train_iou, round(f1, 4) AS train_f1 FROM fit, best"
)
def logistic_model(spark, sf_dir):
    """The coefficients of ``train_logistic``, its best threshold and scores."""
    data = _training_maps(spark, sf_dir).where("nir is not null").withColumn("label", F.col("mask"))
    fit = training.train_logistic(data, ["ndvi", "gli"])
    row = [*fit["coef"], fit["intercept"], fit["threshold"], fit["train_iou"], fit["train_f1"]]
    names = ["coef_ndvi", "coef_gli", "intercept", "threshold", "train_iou", "train_f1"]
    return spark.createDataFrame([tuple(float(v) for v in row)], ", ".join(f"{n} double" for n in names)).select(*[F.round(n, 4).alias(n) for n in names])


_SAMPLE = "sample AS MATERIALIZED (SELECT *, (r - 1) % 2 AS fold FROM (SELECT row, col, x0, x1, y, row_number() OVER (PARTITION BY y ORDER BY ((row * 100 + col) * 7919 + 42) % 1000003, row * 100 + col) AS r FROM maps) WHERE r <= 500)"


def _fold_sql(f: int) -> str:
    """One fold: limits, scaling and model of the others' rows, and the best threshold on its own."""
    both = ("x0", "x1")
    return (
        f"q{f} AS (SELECT {', '.join(f'{_LIMIT(c, 0.01)} AS lo{c}, {_LIMIT(c, 0.99)} AS hi{c}' for c in both)} FROM sample WHERE fold <> {f}), "
        f"clip{f} AS MATERIALIZED (SELECT fold, y, {', '.join(f'least(greatest({c}, lo{c}), hi{c}) AS {c}' for c in both)} FROM sample, q{f}), "
        f"s{f} AS (SELECT {', '.join(f'{_LIMIT(c, 0.5)} AS m{c}, {_LIMIT(c, 0.75)} - {_LIMIT(c, 0.25)} AS r{c}' for c in both)} FROM clip{f} WHERE fold <> {f}), "
        f"scaled{f} AS MATERIALIZED (SELECT fold, y, {', '.join(f'({c} - m{c}) / CASE WHEN r{c} = 0 THEN 1 ELSE r{c} END AS {c}' for c in both)} FROM clip{f}, s{f}), "
        f"train{f} AS MATERIALIZED (SELECT x0, x1, y FROM scaled{f} WHERE fold <> {f}), {_fit_sql(f'train{f}', f'fit{f}')}, "
        f"p{f} AS MATERIALIZED (SELECT y, 1 / (1 + exp(-(w2 + x0 * w0 + x1 * w1))) AS p FROM scaled{f}, fit{f} WHERE fold = {f}), "
        f"c{f} AS (SELECT k, any_value(t) AS t, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn FROM p{f}, t GROUP BY k), "
        f"best{f} AS (SELECT t, tp / (tp + fp + fn) AS iou, 2.0 * tp / (2.0 * tp + fp + fn) AS f1 FROM c{f} ORDER BY iou DESC, k LIMIT 1)"
    )


_GRID = "t AS (SELECT k, 0.1 + k * (CAST(0.9 AS DOUBLE) - 0.1) / 16 AS t FROM range(17) r(k))"


@query(
    f"WITH RECURSIVE {_MAPS}, {_SAMPLE}, {_GRID}, {_fold_sql(0)}, {_fold_sql(1)} "
    "SELECT round((a.iou + b.iou) / 2, 4) AS mean_iou, round((a.f1 + b.f1) / 2, 4) AS mean_f1, round((a.t + b.t) / 2, 4) AS mean_threshold, 2 AS n_splits FROM best0 a, best1 b"
)
def kfold_scores(spark, sf_dir):
    """Cross-validated scores of two indices on a balanced sample."""
    pid = (F.col("row") * 100 + F.col("col")).cast("bigint")
    data = _training_maps(spark, sf_dir).where("nir is not null").withColumn("label", F.col("mask"))
    found = training.kfold_iou(training.balanced_sample(data, pid, per_class=500), ["ndvi", "gli"], pid, k=2)
    names = ["mean_iou", "mean_f1", "mean_threshold"]
    row = spark.createDataFrame([(*[float(found[n]) for n in names], found["n_splits"])], ", ".join(f"{n} double" for n in names) + ", n_splits int")
    return row.select(*[F.round(n, 4).alias(n) for n in names], "n_splits")


_RANKED = ["ndvi", "gndvi", "gli"]


def _single_sql(n: str) -> str:
    """One index by itself: its model, best threshold, and that threshold in its own units and normalised."""
    return (
        f"rows_{n} AS MATERIALIZED (SELECT ({n} - m_{n}) / CASE WHEN r_{n} = 0 THEN 1 ELSE r_{n} END AS x0, CAST(0 AS DOUBLE) AS x1, y FROM kept, span), {_fit_sql(f'rows_{n}', f'fit_{n}')}, "
        f"p_{n} AS MATERIALIZED (SELECT y, 1 / (1 + exp(-(w2 + x0 * w0))) AS p FROM rows_{n}, fit_{n}), "
        f"c_{n} AS (SELECT k, any_value(t) AS t, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn FROM p_{n}, t GROUP BY k), "
        f"b_{n} AS (SELECT t, tp / (tp + fp + fn) AS iou, 2.0 * tp / (2.0 * tp + fp + fn) AS f1 FROM c_{n} ORDER BY iou DESC, k LIMIT 1), "
        f"o_{n} AS (SELECT '{n}' AS name, iou, f1, ((ln(t / (1 - t)) - w2) / w0) * CASE WHEN r_{n} = 0 THEN 1 ELSE r_{n} END + m_{n} AS own, lo_{n} AS lo, hi_{n} AS hi FROM b_{n}, fit_{n}, span)"
    )


_KEPT = f"{REFL}, kept AS MATERIALIZED (SELECT {', '.join(f'{INDEX_SQL[n]} AS {n}' for n in _RANKED)}, CASE WHEN nir + green > red + blue THEN 1 ELSE 0 END AS y FROM refl WHERE nir IS NOT NULL)"
_SPAN = "span AS MATERIALIZED (SELECT " + ", ".join(f"{_LIMIT(n, 0.5)} AS m_{n}, {_LIMIT(n, 0.75)} - {_LIMIT(n, 0.25)} AS r_{n}, min({n}) AS lo_{n}, max({n}) AS hi_{n}" for n in _RANKED) + " FROM kept)"


@query(
    f"WITH RECURSIVE {_KEPT}, {_SPAN}, {_GRID}, {', '.join(_single_sql(n) for n in _RANKED)}, o AS ({' UNION ALL '.join(f'SELECT * FROM o_{n}' for n in _RANKED)}) "
    "SELECT name, CAST(row_number() OVER (ORDER BY iou DESC, name) AS INTEGER) AS place, round(iou, 4) AS iou, round(f1, 4) AS f1, round(own, 4) AS suggested_threshold, round((own - lo) / (hi - lo), 4) AS normalized FROM o"
)
def index_scores(spark, sf_dir):
    """Each index by itself: scores, suggested thresholds and its place in the ranking."""
    result = {"per_index_scores": training.score_indices(_training_maps(spark, sf_dir), _RANKED, "mask")}
    rows = [(r["name"], k, r["iou"], r["f1"], r["suggested_threshold"], r["suggested_threshold_normalized"]) for k, r in enumerate(training.ranking(spark, result).collect(), 1)]
    out = spark.createDataFrame(rows, "name string, place int, iou double, f1 double, suggested_threshold double, normalized double")
    return out.select("name", "place", *[F.round(c, 4).alias(c) for c in ("iou", "f1", "suggested_threshold", "normalized")])
