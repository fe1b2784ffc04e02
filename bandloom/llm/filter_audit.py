"""What a chain of filters removes in every order of the filters.

Spark reduces the documents to cells: for each part of the corpus and each set of filters
that a document fails (a mask) how many documents there are, how many of them are good and
how many toxic.  A part has at most two to the power of the number of filters such cells.
The orders are then visited by single swaps of neighbours (Steinhaus, Johnson, Trotter); a
swap changes two steps only, and only these are summed again from the cells.  What every
filter removes over all orders, its Shapley sum, accumulates along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.textarrays import tidy
from bandloom.storage import materialise

MOST_FILTERS = 7
PARTS = 128
WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters on a text by itself, as conditions of failing; ``text`` must not be null."""
    bare = F.btrim(text, F.lit(WHITE))
    words = F.split(bare, SPLIT)
    empty = bare == ""
    n = F.when(empty, 0).otherwise(F.size(words)).cast("bigint")
    distinct = F.when(empty, 0).otherwise(F.size(F.array_distinct(words))).cast("bigint")
    capitals = (F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))).cast("bigint")
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.char_length(text).cast("bigint"), "D": text.rlike(r"[#$%&*|]")}


def masks(docs: DataFrame, failures: dict[str, Column], text: Column) -> DataFrame:
    """(doc_id, part, mask, digest) of each row, stored; bit k of the mask is the k-th failure."""
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures.values())), F.lit(0))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return materialise(rows, "filter-masks")


def cells(rows: DataFrame, labels: DataFrame, copy_bit: int | None) -> DataFrame:
    """(part, cells ARRAY<STRUCT<mask, n, good, toxic>>): at most one cell for each mask.

    ``copy_bit`` is set in the mask of a row whose digest also belongs to a smaller doc_id.  The first
    rows are found by the least doc_id of each digest and meet the rows on both columns, so that a
    digest of very many rows is dealt out by their ids.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic")).where("good or toxic")
    named = rows.where("doc_id is not null")
    full = named.join(known, "doc_id", "left")
    if copy_bit is not None:
        firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        full = full.join(firsts, ["doc_id", "digest"], "left").withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(1 << copy_bit))))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("bigint")
    full = full.select("part", "mask", flag("good").alias("good"), flag("toxic").alias("toxic"))
    loose = rows.where("doc_id is null").select("part", "mask", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
    sums = full.unionByName(loose).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """The places i whose swap with i + 1 leads through all orders of n things, each order once."""
    place, step = list(range(n)), [-1] * n  # where each thing is and which way it looks
    order = list(range(n))
    while True:
        for thing in range(n - 1, 0, -1):
            to = place[thing] + step[thing]
            if 0 <= to < n and order[to] < thing:
                break
            step[thing] = -step[thing]
        else:
            return
        at, other = place[thing], order[to]
        order[at], order[to], place[thing], place[other] = other, thing, to, at
        yield min(at, to)


def walk(table: np.ndarray, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(orders, steps[order, step, what, part], shapley[filter, part]) for table[what, part, mask] of n, good, toxic.

    what: kept, removed, redundant, unique_fails, good_lost, toxic_lost, the filter.
    """
    n, parts = len(names), table.shape[1]
    mask = np.arange(1 << n)
    total = table[0].sum(axis=1)
    fails = [table[0][:, mask >> f & 1 == 1].sum(axis=1) for f in range(n)]
    alone = [table[0][:, 1 << f] for f in range(n)]
    order = list(range(n))
    now = np.zeros((n, 7, parts), np.int64)

    def fill(step: int, before: int) -> None:
        f = order[step]
        removed, good, toxic = table[:, :, (mask >> f & 1 == 1) & (mask & before == 0)].sum(axis=2)
        held = now[step - 1, 0] if step else total
        now[step] = held - removed, removed, fails[f] - removed, alone[f], good, toxic, np.full(parts, f)

    def prefix(step: int) -> int:
        return sum(1 << f for f in order[:step])

    for step in range(n):
        fill(step, prefix(step))
    shapley = np.zeros((n, parts), np.int64)
    orders, seen = [], []

    def visit() -> None:
        orders.append("".join(names[f] for f in order))
        seen.append(now.copy())
        shapley[order] += now[:, 1]

    visit()
    for at in swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        before = prefix(at)
        fill(at, before)
        fill(at + 1, before | 1 << order[at])
        visit()
    return orders, np.stack(seen), shapley


def interactions(parts: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step.  ``parts`` is what ``cells`` returns."""
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                part = batch.slice(lo, PARTS)
                table = np.zeros((3, part.num_rows, 1 << n), np.int64)
                lists = part.column(1)
                owner, flat = lists.value_parent_indices().to_numpy(), lists.flatten()
                for k, name in enumerate(("n", "good", "toxic")):
                    table[k, owner, flat.field("mask").to_numpy()] = flat.field(name).to_numpy()
                orders, steps, shapley = walk(table, names)
                # rows: order, then step, then part
                column = lambda k, steps=steps: pa.array(steps[:, :, k].reshape(-1))
                times = len(orders) * n
                yield pa.record_batch(
                    {
                        "part": part.column(0).take(pa.array(np.tile(np.arange(part.num_rows), times))),
                        "filter_order": pa.array(np.repeat(np.array(orders), n * part.num_rows).tolist(), pa.string()),
                        "step": pa.array(np.tile(np.repeat(np.arange(1, n + 1, dtype=np.int32), part.num_rows), len(orders))),
                        **{name: column(k) for k, name in enumerate(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
                        "shapley": pa.array(shapley[steps[:, :, 6].reshape(-1), np.tile(np.arange(part.num_rows), times)]),
                    }
                )

    return parts.select("part", "cells").mapInArrow(tidy(run), "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, copies: str | None = "E") -> DataFrame:
    """Every order of the filters over ``docs`` (doc_id, text, lang), with what each step keeps and removes.

    ``failures`` names conditions on columns of ``docs`` (by default the four of ``text_failures``);
    ``copies`` names one more filter, for texts that are identical to one of a smaller doc_id, or is None.
    A null text counts as empty, a null lang as the part of the empty string.  A row with a null doc_id
    is no copy, makes no other row one and has no label.  Rows of one doc_id and text count each, and
    none is a copy of the other; of several labels of a doc_id any that says 1 counts.  Texts are judged
    whole, whatever their length.  Other columns are not read; an empty table gives no rows, and a part
    without failures gives rows of zeros.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    failures = text_failures(text) if failures is None else failures
    names = [*failures, *([copies] if copies else [])]
    rows = masks(docs, failures, text)
    return interactions(cells(rows, labels, len(failures) if copies else None), names)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, good, toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * len(w.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w JOIN f ON w.t = f.t LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
x(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS f, coalesce(list_sum(bits[1:k-1]), 0)::INT AS before FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step::INT AS step, f,
    coalesce(sum(n) FILTER (mask & (before | f) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & f <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & f <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & f <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & f <> 0), 0)::BIGINT AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
