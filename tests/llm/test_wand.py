"""Ranked search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import pytest

from bandloom.llm import wand
from bandloom.llm.wand import op12_wand_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, best=10):
    """docs: (doc_id, text), items: (item_id, text)."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scores = []
        for d, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n // length
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scores)[:best], 1)]
    return Counter(out)


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(9)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "çà", "A1", "a1"]
    text = lambda n: " ".join(words[int(len(words) * draw.random() ** 3)] for _ in range(n))
    docs = [(k * 7 % 1009, text(draw.randint(0, 60))) for k in range(1009)]
    docs += [(5000 + k, docs[k][1]) for k in range(300)]  # ties
    docs += [(6000, None), (6001, ""), (None, "w200 w201"), (None, docs[3][1]), (17, "w0 w1 w299"), (17, "w0 w1 w299"), (7000, "w299 w298 w5\x00w6," * 60_000), (7001, "x" * 1_100_000)]
    items = [(k, text(draw.randint(1, 40))) for k in range(30)] + [(100, None), (101, "zzz unseen"), (102, ""), (103, "w299"), (103, "w298"), (None, "w299 w0"), (104, " ".join(words))]
    return docs, items


def test_against_every_score(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string").repartition(5)
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id bigint, text string, rank int")
    assert rows(wand.search(d, i)) == brute(docs, items)


def test_small_shards_blocks_and_arrays(spark, corpus, monkeypatch):
    """Many shards, blocks of queries and groups of lanes, and an index of all terms, change nothing."""
    for name, value in {"POSTINGS": 500, "MOST_TERMS": 3, "MOST_PAIRS": 200, "CURSORS": 64}.items():
        monkeypatch.setattr(wand, name, value)
    docs, items = corpus
    d = spark.createDataFrame(docs[:600] + docs[-8:], "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(wand.search(d, i, best=3)) == brute(docs[:600] + docs[-8:], items, 3)


def test_documents_are_skipped(spark, corpus, monkeypatch):
    import numpy as np
    import pyarrow as pa

    shard = wand._Shard()
    texts = [" ".join(["common", *(["rare"] if k % 50 == 0 else [])]) for k in range(4000)]
    shard.add(pa.array(range(4000), pa.int64()), pa.array(texts), None)
    index = wand._Index(shard.close(), 4000, 4080)
    steps = []
    place = wand._Index.place
    monkeypatch.setattr(wand._Index, "place", lambda self, t, d: steps.append(1) or place(self, t, d))
    term = np.argsort(-(index.end - index.start))
    _, doc, score = wand._search(index, term, np.array([1, 3000]), np.array([0, 2]), 5)
    assert doc.tolist() == [0, 50, 100, 150, 200] and len(set(score.tolist())) == 1
    assert len(steps) <= 80  # of 4000 documents only those with the rare term are pivots


def test_empty_tables(spark, corpus):
    docs, items = corpus
    d, i = spark.createDataFrame(docs[:5], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for a, b in ((d.where("false"), i), (d, i.where("false")), (d, i.where("item_id in (100, 101, 102)"))):
        assert wand.search(a, b).collect() == []


def test_op12_on_the_table(spark, sf_dir):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    assert rows(op12_wand_search(spark, sf_dir)) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
