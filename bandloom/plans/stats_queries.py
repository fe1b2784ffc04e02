"""Queries of the selection that large groups take."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.operators import stats
from bandloom.plans.raster_queries import NDVI, index_map, query


@query(f"WITH {NDVI} SELECT CAST(row // 10 AS INTEGER) AS strip, count(v) AS n, round(quantile_cont(v, 0.02), 6) AS p02, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.98), 6) AS p98 FROM ndvi GROUP BY 1 HAVING count(v) > 0")
def group_percentiles(spark, sf_dir):
    """Exact percentiles of strips, by selection."""
    strips = index_map(spark, sf_dir, "ndvi").withColumn("strip", F.expr("cast(row div 10 as int)"))
    out = stats.group_percentiles(strips, ["strip"], F.col("ndvi"), [0.02, 0.5, 0.98])
    return out.select("strip", "n", *[F.round(F.get("p", F.lit(k)), 6).alias(n) for k, n in enumerate(("p02", "p50", "p98"))])
