"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014).

Each round is two aggregations by node and two joins back; nothing is collected.  A graph
of at most ``SMALL`` links, counted first, is done by one task with a union-find.
Aggregations combine before the shuffle, and the joins are ordinary equi-joins, so
adaptive skew handling applies to nodes with very many links.  They are never broadcasts: each
would send its side through the driver, round by round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.storage import materialise

SMALL = 50_000


def join_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index of each index's component, for links u-v among 0..n-1."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if np.array_equal(low, high):
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(label, nearer := label[label]):
            label = nearer


def _in_one_task(table: pa.Table) -> pa.Table:
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = join_labels(len(ids), place[: len(a)], place[len(a) :])
    return pa.table({"id": ids, "component": ids[label]})


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """``edges`` has two BIGINT columns a and b; returns (id, component) for ids with a link.

    component is the smallest id that can be reached.  Self links, nulls and repeated
    links are dropped.  An empty input gives an empty result.
    """
    work = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    work = materialise(work, "links")
    before = _fingerprint(work)
    if before[0] <= small:
        return work.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_in_one_task, "id bigint, component bigint")
    for _ in range(max_rounds):
        if not before[0]:
            break
        work = materialise(_small_star(_large_star(work)), "links")
        now = _fingerprint(work)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = work.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return work.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
