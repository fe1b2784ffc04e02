"""Aggregations: zonal statistics, percentiles, stretches, scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from bandloom.functions.arith import finite
from bandloom.storage import materialise, plan_bytes


#: A table of at most this many bytes may have its percentiles in one aggregate buffer.
SMALL_BYTES = 64 << 20
#: Accuracy of the sketches that say where a rank lies: they are off by one row in so many.
SKETCH = 10_000


def percentile_row(df: DataFrame, values: dict[str, Column], fractions: list[float], small: int = SMALL_BYTES) -> DataFrame:
    """One row with an array of exact, linearly interpolated percentiles for each name; null without values.

    Of large tables a sketch of bounded size says between which values each wanted rank lies; one
    pass for all names counts the rows below and between, and only what lies between is put in
    order.  A rank that lies elsewhere after all is looked for among all values.
    """
    if plan_bytes(df) <= small:
        return df.agg(*[F.percentile(v, F.array(*[F.lit(f) for f in fractions])).alias(n) for n, v in values.items()])
    names = list(values)
    base = df.select(*[v.cast("double").alias(f"v{k}") for k, v in enumerate(values.values())])
    ends = [x for f in fractions for x in (max(0.0, f - 2.0 / SKETCH), min(1.0, f + 2.0 / SKETCH))]
    sketch = base.agg(*[x for k in range(len(names)) for x in (F.count(f"v{k}").alias(f"n{k}"), F.percentile_approx(f"v{k}", F.array(*[F.lit(e) for e in ends]), SKETCH).alias(f"q{k}"))]).first()
    wanted = {}  # (column, fraction) -> low, high
    for k in range(len(names)):
        if sketch[f"n{k}"]:
            wanted |= {(k, j): tuple(sketch[f"q{k}"][2 * j : 2 * j + 2]) for j in range(len(fractions))}
    ranks = {(k, j): ((sketch[f"n{k}"] - 1) * fractions[j]) for k, j in wanted}
    found = _at_ranks(base, wanted, ranks)
    missed = {x: None for x in wanted if x not in found}
    if missed:
        found |= _at_ranks(base, missed, ranks)

    def mixed(x: tuple[int, int]) -> float:
        p, (a, b) = ranks[x], found[x]
        return a if math.floor(p) == math.ceil(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b

    row = tuple([mixed((k, j)) for j in range(len(fractions))] if sketch[f"n{k}"] else None for k in range(len(names)))
    return df.sparkSession.createDataFrame([row], StructType([StructField(n, ArrayType(DoubleType())) for n in names]))


def _at_ranks(base: DataFrame, wanted: dict, ranks: dict) -> dict:
    """The two values around each rank, as far as they lie within its (low, high); None stands for all values."""
    slots = list(wanted)
    if not slots:
        return {}

    def place(x) -> tuple[Column, Column]:
        v = F.col(f"v{x[0]}")
        if wanted[x] is None:
            return F.lit(False), v.isNotNull()
        low, high = (F.lit(float(e)) for e in wanted[x])
        return v < low, (v >= low) & (v <= high)

    below = base.agg(*[F.count_if(place(x)[0]).alias(f"b{i}") for i, x in enumerate(slots)]).first()
    near = F.array_compact(F.array(*[F.when(place(x)[1], F.struct(F.lit(i).alias("slot"), F.col(f"v{x[0]}").alias("v"))) for i, x in enumerate(slots)]))
    counts = base.select(F.explode(near).alias("e")).groupBy("e.slot", "e.v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("slot").orderBy("v")
    counts = counts.withColumn("to", F.sum("n").over(order)).withColumn("from", F.col("to") - F.col("n"))
    least = lambda r: [math.floor(r), math.ceil(r)]
    targets = base.sparkSession.createDataFrame([(i, e, r - below[f"b{i}"]) for i, x in enumerate(slots) for e, r in enumerate(least(ranks[x]))], "slot int, side int, rank bigint")
    hit = counts.join(F.broadcast(targets), "slot").where("rank >= from and rank < to").select("slot", "side", "v").collect()
    at = {(r["slot"], r["side"]): r["v"] for r in hit}
    return {x: (at[i, 0], at[i, 1]) for i, x in enumerate(slots) if (i, 0) in at and (i, 1) in at}


#: Ranges that a group's values are cut into, and the accuracy of the cuts.
RANGES, ACCURACY = 256, 4096


#: Every so many cuts are looked at first.
STEP = 16


def coarse_cuts(cuts: Column) -> Column:
    return F.filter(cuts, lambda c, k: k % STEP == STEP - 1)


def range_of(value: Column, cuts: Column, coarse: Column) -> Column:
    """How many of the sorted ``cuts`` are less than the value, found by its place among every ``STEP``-th of them."""
    lead = F.size(F.filter(coarse, lambda c: c < value)) * STEP
    return lead + F.size(F.filter(F.slice(cuts, lead + 1, STEP), lambda c: c < value))


#: Values of a group that may have their percentiles in one aggregate buffer.
FEW = 100_000


def group_percentiles(df: DataFrame, by: list[str], value: Column, fractions: list[float], ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """(by, n, p): the number of values and their exact, linearly interpolated percentiles, for each group with values.

    Groups of at most ``few`` values are one aggregate; larger ones, of which there are at most the
    number of rows by ``few``, go by selection (see ``_by_selection``).
    """
    keys = [f"_k{k}" for k in range(len(by))]
    base = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], value.cast("double").alias("_v")).where("_v is not null")
    named = [F.col(k).alias(b) for k, b in zip(keys, by, strict=True)]
    large = materialise(base.groupBy(*keys).count().where(F.col("count") > few).select(*keys), "percentile-groups")
    exact = F.percentile("_v", F.array(*[F.lit(f) for f in fractions]))
    some = large.count()
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
    split = lambda how: base.alias("a").join(F.broadcast(large.alias("b")) if some < 100_000 else large.alias("b"), same, how)
    small = (split("left_anti") if some else base).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), exact.alias("p")).select(*named, "n", "p")
    return small.union(_by_selection(split("left_semi"), keys, fractions, ranges).select(*named, "n", "p")) if some else small


def _by_selection(base: DataFrame, keys: list[str], fractions: list[float], ranges: int) -> DataFrame:
    """(keys, n, p) of (keys, _v): sketches of bounded size cut each group's values into ranges of about equal
    counts; the counts of the ranges say in which of them a rank lies; and only the values of those
    ranges, counted by value, are put in order.  So a group of any size takes no buffer of its size
    and no task of its own, and most values are never sorted.
    """
    ranges = max(2, ranges)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    cuts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), ACCURACY).alias("_cuts"))
    cuts = materialise(cuts.withColumn("_coarse", coarse_cuts(F.col("_cuts"))), "percentile-cuts")
    ranged = base.alias("a").join(cuts.alias("b"), same("a", "b")).select("a.*", range_of(F.col("a._v"), F.col("b._cuts"), F.col("b._coarse")).alias("_range"))
    sums = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_in"))
    order = Window.partitionBy(*keys).orderBy("_range")  # at most ``ranges`` rows for a group
    sums = sums.withColumn("_lead", F.sum("_in").over(order) - F.col("_in"))
    place = [(F.col("_n") - 1) * F.lit(f) for f in fractions]
    wanted = F.explode(F.array_distinct(F.array(*[x.cast("bigint") for p in place for x in (F.floor(p), F.ceil(p))])))
    ranks = cuts.select(*keys, wanted.alias("_rank"))
    found = ranks.alias("a").join(sums.alias("b"), same("a", "b") & (F.col("a._rank") >= F.col("b._lead")) & (F.col("a._rank") < F.col("b._lead") + F.col("b._in"))).select("a.*", "b._range", "b._lead")
    found = materialise(found, "percentile-ranks")
    few = found.select(*keys, "_range", "_lead").distinct()
    near = ranged.alias("a").join(few.alias("b"), same("a", "b") & (F.col("a._range") == F.col("b._range"))).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a._range").alias("_range"), "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("b._lead").alias("_lead"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_v")
    near = near.withColumn("_to", F.col("_lead") + F.sum("_c").over(inside)).withColumn("_from", F.col("_to") - F.col("_c"))
    exact = found.alias("a").join(near.alias("b"), same("a", "b") & (F.col("a._range") == F.col("b._range")) & (F.col("a._rank") >= F.col("b._from")) & (F.col("a._rank") < F.col("b._to"))).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a._rank").alias("_rank"), "b._v")
    at = exact.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    get = lambda r: F.element_at("_at", r.cast("bigint"))
    mixed = [F.when(F.floor(p) == F.ceil(p), get(F.floor(p))).otherwise((F.ceil(p) - p) * get(F.floor(p)) + (p - F.floor(p)) * get(F.ceil(p))) for p in place]
    out = cuts.drop("_coarse").alias("a").join(at.alias("b"), same("a", "b")).select("a.*", "b._at")
    return out.select(*keys, F.col("_n").alias("n"), F.array(*mixed).alias("p"))


def value_stats(pixels: DataFrame, value: str, low: float = 2.0, high: float = 98.0, by: list[str] = ()) -> DataFrame:
    """min, max, p_low, p_high over finite values (exact, linear); 0, 1, 0, 1 if there is none."""
    v = finite(F.col(value).cast("double"))
    fractions = [low / 100.0, high / 100.0]
    if by and plan_bytes(pixels) > SMALL_BYTES:
        keys = [f"_by{k}" for k in range(len(by))]
        pct = group_percentiles(pixels, list(by), v, fractions).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col("p").alias("_p"))
        same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)])
        out = pixels.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max")).join(pct, same, "left")
    elif by:
        out = pixels.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.array(*[F.lit(f) for f in fractions])).alias("_p"))
    elif plan_bytes(pixels) <= SMALL_BYTES:
        out = pixels.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.array(*[F.lit(f) for f in fractions])).alias("_p"))
    else:
        out = pixels.agg(F.min(v).alias("min"), F.max(v).alias("max")).crossJoin(F.broadcast(percentile_row(pixels, {"_p": v}, fractions)))
    return out.select(*by, *[F.coalesce(c, F.lit(d)).alias(n) for n, c, d in (("min", F.col("min"), 0.0), ("max", F.col("max"), 1.0), ("p_low", F.get(F.col("_p"), 0), 0.0), ("p_high", F.get(F.col("_p"), 1), 1.0))])


def zonal_stats(labelled: DataFrame, bands: list[str]) -> DataFrame:
    """count, and mean and population deviation of each band, for each label over 0."""
    each = [x for b in bands for x in (F.avg(b).alias(f"mean_{b}"), F.stddev_pop(b).alias(f"std_{b}"))]
    return labelled.where("label > 0").groupBy("label").agg(F.count(F.lit(1)).alias("count"), *each)


def stretch(pixels: DataFrame, bands: list[str], low: float = 2.0, high: float = 98.0) -> DataFrame:
    """Bands as 0..255: linear between the percentiles of the values over 0; truncated.

    Where the percentiles coincide the raw value is clipped to 0..255.
    """
    pct = {f"_p_{b}": F.when(F.col(b) > 0, F.col(b).cast("double")) for b in bands}
    out = pixels.crossJoin(F.broadcast(percentile_row(pixels, pct, [low / 100.0, high / 100.0])))

    def level(b: str) -> Column:
        v, a, z = F.col(b).cast("double"), F.get(F.col(f"_p_{b}"), 0), F.get(F.col(f"_p_{b}"), 1)
        linear = F.when(z > a, (v - a) / (z - a) * 255.0).otherwise(v)
        return F.when(v.isNotNull(), F.least(F.greatest(linear, F.lit(0.0)), F.lit(255.0)).cast("int")).otherwise(F.lit(0))

    return out.select(*[c for c in pixels.columns if c not in bands], *[level(b).alias(b) for b in bands])


def overlap_scores(pairs: DataFrame, pred: Column, truth: Column, by: list[str] = (), epsilon: float = 0.0, weight: Column | None = None) -> DataFrame:
    """iou and f1 of two boolean columns, of rows that stand for ``weight`` rows each; 0 where undefined."""
    each = F.lit(1).cast("bigint") if weight is None else weight
    one = lambda c: F.sum(F.when(c, each).otherwise(0))
    out = pairs.groupBy(*by).agg(one(pred & truth).alias("tp"), one(pred & ~truth).alias("fp"), one(~pred & truth).alias("fn"))
    union = F.col("tp") + F.col("fp") + F.col("fn")
    iou = F.when(union > 0, F.col("tp") / (union + F.lit(epsilon))).otherwise(0.0)
    f1 = F.when(union > 0, F.col("tp") * 2.0 / (F.col("tp") * 2.0 + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return out.select(*by, "tp", "fp", "fn", iou.cast("double").alias("iou"), f1.cast("double").alias("f1"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at half: one row, NULL with one class.

    Scores are counted by value first; the running sum needs these counts in order, so ties
    and repeated scores are cheap, and the sum is cut into ranges (see ``running_sum``).
    """
    by = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    below = running_sum(by, "s", "n", "before")
    total = below.agg(F.sum(F.col("p") * (F.col("before") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def running_sum(df: DataFrame, order: str, value: str, name: str, parts: int = 256) -> DataFrame:
    """The sum of ``value`` over all rows with a smaller ``order``, without one task for all rows.

    Rows are put in ``parts`` ranges by approximate quantiles of the order; sums of ranges are
    a table of at most ``parts`` + 1 rows.
    """
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10000).alias("q"))
    cuts = cuts.withColumn("_coarse", coarse_cuts(F.col("q")))
    ranged = df.crossJoin(F.broadcast(cuts)).withColumn("_range", range_of(F.col(order), F.col("q"), F.col("_coarse"))).drop("q", "_coarse")
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    lead = sums.withColumn("_lead", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(lead), "_range").withColumn(name, F.col("_lead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_lead")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
