"""Learning which indices separate a mask: robust scaling, logistic models, thresholds, ranking.

``learn_formula`` draws samples by a hash of the pixel, at most ``per_class`` of each class, so its
fits have a fixed size; ``train_logistic`` and ``score_indices`` take all rows.  Fits, scores and
thresholds are aggregates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandloom.functions.arith import clip, finite
from bandloom.operators.stats import overlap_scores, percentile_row, roc_auc
from bandloom.storage import materialise

THRESHOLDS = [float(t) for t in np.linspace(0.1, 0.9, 17)]
PER_CLASS = 25_000
QUARTILES = [0.25, 0.5, 0.75]


def mix_key(pid: Column) -> Column:
    """A scattered order of pixels that other engines can compute too."""
    return (pid * 7919 + 42) % 1000003


def balanced_sample(df: DataFrame, pid: Column, label: str = "label", per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` rows of each class, the first by ``mix_key`` and pid.

    The cut is found on the keys' counts in 1024 ranges, so that only rows up to the range with the
    last wanted row are ranked.
    """
    keyed = df.withColumn("_id", pid).withColumn("_k", mix_key(F.col("_id"))).withColumn("_g", F.floor(F.col("_k") / 977).cast("int"))
    counts = keyed.groupBy(label, "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("_before", before).where(F.col("_before") < per_class).select(label, "_g", "_before")
    inside = Window.partitionBy(label, "_g").orderBy("_k", "_id")
    near = keyed.join(F.broadcast(wanted), [label, "_g"])
    return near.withColumn("_r", F.row_number().over(inside) + F.col("_before")).where(F.col("_r") <= per_class).drop("_id", "_k", "_g", "_r", "_before")


def robust_parameters(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """(median, quartile range) of each feature; a range of 0 counts as 1."""
    row = percentile_row(df, {f: F.col(f) for f in features}, QUARTILES).first()
    return {f: (row[f][1], (row[f][2] - row[f][0]) or 1.0) for f in features}


def robust_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """(x - median) / (q75 - q25) as columns, with the scalars joined as one row."""
    out = df.crossJoin(F.broadcast(percentile_row(df, {f"_p_{f}": F.col(f) for f in features}, QUARTILES)))
    span = lambda f: F.coalesce(F.nullif(F.get(f"_p_{f}", 2) - F.get(f"_p_{f}", 0), F.lit(0.0)), F.lit(1.0))
    return out.withColumns({f: (F.col(f) - F.get(f"_p_{f}", 1)) / span(f) for f in features}).drop(*[f"_p_{f}" for f in features])


def clip_and_impute(train: DataFrame, other: DataFrame, features: list[str], low: float = 1.0, high: float = 99.0) -> tuple[DataFrame, DataFrame]:
    """Both clipped to percentiles of ``train``, missing values set to its median after clipping."""
    cut = percentile_row(train, {f: finite(F.col(f)) for f in features}, [low / 100, high / 100]).first()
    limit = lambda f: clip(finite(F.col(f)), *cut[f]) if cut[f] else F.col(f)
    train, other = (d.withColumns({f: limit(f) for f in features}) for d in (train, other))
    middle = percentile_row(train, {f: F.col(f) for f in features}, [0.5]).first()
    fill = {f: F.coalesce(F.col(f), F.lit(middle[f][0] if middle[f] else None)) for f in features}
    return train.withColumns(fill), other.withColumns(fill)


def fit_logistic(df: DataFrame, features: list[str], label: str = "label", iterations: int = 500, c: float = 1.0) -> tuple[list[float], float]:
    """(coefficients, intercept) of 0.5 |w|^2 + C * sum of balanced weights * log loss, the intercept penalised too.

    Newton steps: each is one aggregate row over the data (loss, gradient and the upper half of
    the Hessian), and a handful of steps settle, however many rows there are.  A step that does not
    lower the loss is halved.
    """
    n = _classes(df, label)
    if not n.get(0) or not n.get(1):
        raise ValueError("two classes are needed")
    total = sum(n.values())
    x = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    size = len(x)
    one = F.col(label) == 1
    weight = F.when(one, F.lit(c * total / (2.0 * n[1]))).otherwise(F.lit(c * total / (2.0 * n[0])))
    base = df.select(*[v.alias(f"_x{i}") for i, v in enumerate(x)], F.when(one, 1.0).otherwise(0.0).alias("_y"), weight.alias("_w"))

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((F.col(f"_x{i}") * F.lit(float(v)) for i, v in enumerate(w)), F.lit(0.0))
        # log(1 + exp(z)) without overflow
        rows = base.withColumn("_z", z).withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))))
        loss = F.col("_w") * (F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col("_y") * F.col("_z"))
        off, bend = F.col("_w") * (F.col("_p") - F.col("_y")), F.col("_w") * F.col("_p") * (F.lit(1.0) - F.col("_p"))
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        sums = [F.sum(loss), *[F.sum(off * F.col(f"_x{i}")) for i in range(size)], *[F.sum(bend * F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs]]
        found = [float(v) for v in rows.agg(*[v.alias(f"s{k}") for k, v in enumerate(sums)]).first()]
        hess = np.eye(size)
        for (i, j), v in zip(pairs, found[1 + size :], strict=True):
            hess[i, j] += v
            if i != j:
                hess[j, i] += v
        return found[0] + 0.5 * float(w @ w), np.array(found[1 : 1 + size]) + w, hess

    w = np.zeros(size)
    loss, grad, hess = look(w)
    for _ in range(iterations):
        step = np.linalg.solve(hess, grad)
        if grad @ step <= 1e-11 * (1.0 + abs(loss)):  # the last step: what it leaves is the square of its error
            return [float(v) for v in (w - step)[:-1]], float((w - step)[-1])
        share = 1.0
        while True:
            then = look(w - share * step)
            if then[0] < loss or share < 1e-6:
                break
            share /= 2
        w, (loss, grad, hess) = w - share * step, then
    return [float(v) for v in w[:-1]], float(w[-1])


def probability(features: list[str], coef: list[float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for f, w in zip(features, coef, strict=True):
        z = z + F.col(f) * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def threshold_scores(scored: DataFrame, prob: str, label: str = "label") -> DataFrame:
    """(k, threshold, tp, fp, fn, iou, f1) for 17 thresholds; rows without a score or a label don't count.

    Scores are counted by the number of thresholds that they reach, so what meets the
    thresholds are at most 18 rows of counts for each class.
    """
    reached = sum((F.when(F.col(prob) >= t, 1).otherwise(0) for t in THRESHOLDS), F.lit(0))
    one = F.when(F.col(label) == 1, True).otherwise(False)
    counts = scored.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(reached.alias("reached"), one.alias("one")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(THRESHOLDS)]))
    return overlap_scores(counts.select("reached", "one", "n", grid.alias("g")).select("reached", "one", "n", "g.*"), F.col("reached") > F.col("k"), F.col("one"), ["k", "threshold"], weight=F.col("n"))


def best_threshold(scored: DataFrame, prob: str, label: str = "label") -> tuple[float, float, float]:
    """(threshold, iou, f1) of greatest iou, the first of equals."""
    best = threshold_scores(scored, prob, label).orderBy(F.desc("iou"), "k").first()
    return best["threshold"], best["iou"], best["f1"]


def _classes(df: DataFrame, label: str) -> dict[int, int]:
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def folds(df: DataFrame, pid: Column, k: int, label: str = "label") -> DataFrame:
    """Adds fold: stratified by class, in the order of ``mix_key``.  For samples of fixed size."""
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(mix_key(pid), pid)) - 1) % k)


def kfold_iou(df: DataFrame, features: list[str], pid: Column, label: str = "label", k: int = 5) -> dict:
    """Cross-validated iou, f1 and threshold; zeros and a warning with one class or too few rows of one."""
    n = _classes(df, label)
    splits = min(k, min(n.values(), default=0))
    if len(n) < 2 or splits < 2:
        return {"mean_iou": 0.0, "fold_ious": [], "mean_f1": 0.0, "fold_f1": [], "mean_threshold": 0.5, "fold_thresholds": [], "n_splits": 0, "warning": "two classes with two rows each are needed"}
    data, found = materialise(folds(df, pid, splits, label), "folds"), []
    for fold in range(splits):
        train, test = clip_and_impute(data.where(F.col("fold") != fold), data.where(F.col("fold") == fold), features)
        scale = robust_parameters(train, features)
        put = {f: (F.col(f) - m) / s for f, (m, s) in scale.items()}
        train, test = train.withColumns(put), test.withColumns(put)
        coef, intercept = fit_logistic(train, features, label)
        found.append(best_threshold(test.withColumn("_p", probability(features, coef, intercept)), "_p", label))
    t, iou, f1 = (list(x) for x in zip(*found, strict=True))
    mean = lambda x: sum(x) / len(x)
    return {"mean_iou": mean(iou), "fold_ious": iou, "mean_f1": mean(f1), "fold_f1": f1, "mean_threshold": mean(t), "fold_thresholds": t, "n_splits": splits}


def train_logistic(df: DataFrame, features: list[str], label: str = "label") -> dict:
    """A model of all rows, its best threshold and scores, and the scaling."""
    train, _ = clip_and_impute(df, df, features)
    scale = robust_parameters(train, features)
    train = materialise(train.withColumns({f: (F.col(f) - m) / s for f, (m, s) in scale.items()}), "train")
    coef, intercept = fit_logistic(train, features, label, 1000)
    t, iou, f1 = best_threshold(train.withColumn("_p", probability(features, coef, intercept)), "_p", label)
    return {"coef": coef, "intercept": intercept, "classes": sorted(_classes(df, label)), "threshold": t, "train_iou": iou, "train_f1": f1, "center": [scale[f][0] for f in features], "scale": [scale[f][1] for f in features]}


def importance(coef: list[float]) -> list[float]:
    total = sum(map(abs, coef)) + 1e-8
    return [abs(c) / total for c in coef]


def single_scores(scaled: DataFrame, names: list[str], scale: dict[str, tuple[float, float]], span: dict[str, tuple[float, float]]) -> list[dict]:
    """How well each index alone tells the labels of ``scaled`` (label, names), and its threshold in its own units."""
    scores = []
    for m in names:
        try:
            (w,), b = fit_logistic(scaled, [m])
            t, iou, f1 = best_threshold(scaled.withColumn("_p", probability([m], [w], b)), "_p")
            at = ((math.log(t / (1 - t)) - b) / w) * scale[m][1] + scale[m][0] if w and 0 < t < 1 else None
            wide = span[m][1] - span[m][0]
            scores.append({"name": m, "iou": iou, "f1": f1, "suggested_threshold": at, "suggested_threshold_normalized": (at - span[m][0]) / wide if at is not None and wide else None})
        except (ArithmeticError, ValueError, IllegalArgumentException) as e:  # one index that cannot be fitted leaves the others' scores
            scores.append({"name": m, "iou": 0.0, "f1": 0.0, "suggested_threshold": None, "suggested_threshold_normalized": None, "error": str(e)[:200]})
    return scores


def score_indices(maps: DataFrame, names: list[str], label: str) -> list[dict]:
    """``single_scores`` over all rows of ``maps`` that have a finite value of every index; nothing is drawn."""
    clean = maps.select(F.when(F.col(label) > 0, 1).otherwise(0).alias("label"), *[finite(F.col(n).cast("double")).alias(n) for n in names])
    rows = materialise(clean.dropna(subset=names), "scoring")
    if len(_classes(rows, "label")) < 2:
        return []
    scale = robust_parameters(rows, names)
    span = rows.agg(*[x for m in names for x in (F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"))]).first()
    scaled = materialise(rows.select("label", *[((F.col(f) - m) / s).alias(f) for f, (m, s) in scale.items()]), "scoring-scaled")
    return single_scores(scaled, names, scale, {m: (span[f"lo_{m}"], span[f"hi_{m}"]) for m in names})


def learn_formula(maps: DataFrame, names: list[str], label: str, pid: Column, k_folds: int = 5) -> dict:
    """Rank indices by how well each alone, and all together, tell label > 0 from 0.

    Indices without a finite value are left out, rows with a missing one too.  Fewer than 100
    rows, or one class, give a warning instead of scores.  mean_cv_iou (kept under this name, and
    as mean_cv_auc) is the cross-validated area under the ROC curve.
    """
    clean = maps.select(pid.alias("_pid"), F.when(F.col(label) > 0, 1).otherwise(0).alias("label"), *[finite(F.col(n).cast("double")).alias(n) for n in names])
    have = clean.agg(*[F.count(n).alias(n) for n in names]).first()
    names = [n for n in names if have[n]]
    empty = {"best_index": None, "best_single_iou": 0.0, "combined_iou": 0.0, "mean_cv_f1": 0.0, "mean_cv_iou": 0.0, "mean_cv_auc": 0.0, "coef": [], "intercept": 0.0, "index_names": names, "importance": [], "total_pixels": 0, "road_pixels": 0, "per_index_scores": []}
    rows = materialise(balanced_sample(clean.dropna(subset=names) if names else clean.limit(0), F.col("_pid")), "training")
    n = _classes(rows, "label")
    total = sum(n.values())
    empty |= {"total_pixels": total, "road_pixels": n.get(1, 0)}
    if not names or total < 100:
        return empty | {"warning": "fewer than 100 usable pixels"}
    if len(n) < 2:
        return empty | {"warning": "all pixels are of one class: move the seeds or the threshold"}
    scale = robust_parameters(rows, names)
    scaled = materialise(rows.withColumns({f: (F.col(f) - m) / s for f, (m, s) in scale.items()}), "training-scaled")
    coef, intercept = fit_logistic(scaled, names)
    aucs, f1s = [0.5], [0.0]
    splits = min(k_folds, n[1], n[0])
    if splits >= 2:
        data, aucs, f1s = materialise(folds(scaled, F.col("_pid"), splits), "folds"), [], []
        for fold in range(splits):
            w, b = fit_logistic(data.where(F.col("fold") != fold), names)
            test = data.where(F.col("fold") == fold).withColumn("_p", probability(names, w, b))
            aucs.append(roc_auc(test, "_p", "label").first()["auc"] or 0.5)
            f1s.append(overlap_scores(test, F.col("_p") >= 0.5, F.col("label") == 1).first()["f1"])
    combined = overlap_scores(scaled.withColumn("_p", probability(names, coef, intercept)), F.col("_p") >= 0.5, F.col("label") == 1, epsilon=1e-8).first()["iou"]
    span = rows.agg(*[x for m in names for x in (F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"))]).first()
    scores = single_scores(scaled, names, scale, {m: (span[f"lo_{m}"], span[f"hi_{m}"]) for m in names})
    # of equal scores the first one's
    best = max(scores, key=lambda x: x["iou"])
    best, best_iou = (best["name"], best["iou"]) if best["iou"] > 0 else (None, 0.0)
    mean = lambda x: sum(x) / len(x)
    return empty | {"best_index": best, "best_single_iou": best_iou, "combined_iou": combined, "mean_cv_f1": mean(f1s), "mean_cv_iou": mean(aucs), "mean_cv_auc": mean(aucs), "coef": coef, "intercept": intercept, "importance": importance(coef), "per_index_scores": scores}


def ranking(spark, result: dict, key: str = "iou", ascending: bool = False) -> DataFrame:
    """The scores as a table in order; missing values count as the least."""
    rows = [(s["name"], s["iou"], s["f1"], s["suggested_threshold"], s["suggested_threshold_normalized"]) for s in result["per_index_scores"]]
    df = spark.createDataFrame(rows, "name string, iou double, f1 double, suggested_threshold double, suggested_threshold_normalized double")
    return df.orderBy(F.col(key).asc_nulls_first() if ascending else F.col(key).desc_nulls_last(), "name")


def slider_value(threshold: Column) -> Column:
    """A suggested threshold within the slider's [-1, 1]."""
    return clip(threshold, -1.0, 1.0)
