"""The audit against filters applied one after another, and the walk against all permutations."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.llm import filter_audit
from bandloom.llm.filter_audit import op13_filter_audit

SCHEMA = "doc_id bigint, text string, lang string"


def brute(docs, labels):
    """Every order, every document, filter by filter."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        own = [x for x in labels if d is not None and x[0] == d]
        rows.append((lang or "", {k for k, v in bad.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {(*key, *values, shapley[key[0], key[1][key[2] - 1]]) for key, values in out.items()}


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for at in filter_audit.swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_walk_updates_equal_whole_sums():
    table = np.random.default_rng(3).integers(0, 50, (3, 4, 32))
    orders, steps, shapley = filter_audit.walk(table, list("ABCDE"))
    for order, got in zip(orders, steps, strict=True):
        before = 0
        for k, f in enumerate("ABCDE".index(x) for x in order):
            cells = [m for m in range(32) if m & before == 0 and m >> f & 1]
            assert np.array_equal(got[k, [1, 4, 5]], table[:, :, cells].sum(axis=2))
            before |= 1 << f
            assert np.array_equal(got[k, 0], table[0][:, [m for m in range(32) if m & before == 0]].sum(axis=1))
    assert np.array_equal(shapley.sum(axis=0), (table[0].sum(axis=1) - table[0][:, 0]) * 120)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(120))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "de"), (3, None, None), (4, "", ""), (5, " \t\x0b ", "en"), (None, long, "en"), (None, "ABC", "xx"), (6, "same " * 200_000, "en"), (7, long + " $", "de"), (8, "É" * 9 + "A", "de"), (9, " ".join(["a"] * 150), "en"), (9, "other", "en")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, None, 1), (None, 1, 1), (9, 1, None)]
    df = spark.createDataFrame([(*r, "x") for r in docs], SCHEMA + ", part string").repartition(4)
    lab = spark.createDataFrame([(*r, 1) for r in labels], "doc_id bigint, quality int, toxic int, mask int")
    got = filter_audit.audit(df, lab).collect()
    assert {tuple(r) for r in got} == brute(docs, labels) and len(got) == 600 * len({r[2] or "" for r in docs})
    assert filter_audit.audit(df.where("false"), lab).count() == 0
    assert filter_audit.audit(df, lab.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_other_filters(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, "b", "x"), (3, "abc", "x")], SCHEMA)
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(df, lab, {"P": F.col("text").contains("a"), "Q": F.col("text").contains("c")}, copies=None)
    assert {(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in got.collect()} == {("PQ", 1, 1, 2, 0, 3), ("PQ", 2, 1, 0, 1, 1), ("QP", 1, 2, 1, 0, 1), ("QP", 2, 1, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.interactions(df, list("ABCDEFGH"))


def test_many_copies_over_many_parts(spark):
    docs = [(k, "the same text" if k % 3 == 0 else f"text {k}", f"l{k % 300}") for k in range(3000)]
    got = filter_audit.audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id bigint, quality int, toxic int"))
    first = {(r.part, r.removed) for r in got.where("filter_order = 'EABCD' and step = 1").collect()}
    assert first == {(f"l{p}", sum(k % 3 == 0 and k > 0 for k in range(p, 3000, 300))) for p in range(300)}


def test_op13_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    got = op13_filter_audit(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == brute(docs, labels)
