import itertools
import random
import re

import numpy as np
import pytest

from bandloom.graph import connected_components
from bandloom.llm import jaccard_join
from bandloom.llm.jaccard_join import components, link_tile, linked, pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {(i, len(s), root(i)) for i, s in sets.items()}


def corpus(seed, near=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(3))
    rows, bases = [], [[word() for _ in range(n)] for n in (3, 8, 25, 60, 140, 141)]
    passage = [word() for _ in range(30)]
    for _ in range(near):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [word()], [word(), word()], [w[k].upper()]])
        rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(rng.randint(0, 20))]) for _ in range(20)]
    rows += [None, "", " \n", "One", "one", "one two", "ONE\ttwo", "one two three", "x " * 300, "x " * 20, "É", "é"]
    rng.shuffle(rows)
    return [(k * 7 % 1009, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "num", "den", "cell"), [(3, 90, 100, 1_000_000), (3, 90, 100, 150), (5, 8, 10, 400)])
def test_against_brute_force(spark, monkeypatch, width, num, den, cell):
    """The last case also takes the rounds of a large graph."""
    if width == 5:
        monkeypatch.setattr(jaccard_join, "connected_components", lambda e: connected_components(e, small=-1))
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rows = corpus(width + cell)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n bigint").repartition(6)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in components(df, width, num, den).collect()}
    assert got == brute(rows, width, num, den)


@pytest.mark.parametrize(("docs", "level"), [(5, 1)])
def test_few_documents_in_a_cell_and_levels_of_buckets(spark, monkeypatch, docs, level):
    monkeypatch.setattr(jaccard_join, "CELL_DOCS", docs)
    monkeypatch.setattr(jaccard_join, "LEVEL", level)
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 800)
    rows = corpus(docs, near=60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in components(df, 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_structured_words_do_not_collide(spark):
    rows = []
    for n in (1024, 4096):
        a, b = ("".join(x[k.bit_count() % 2] for k in range(n)) for x in ("ab", "ba"))
        tail = " ".join(f"w{n}x{k}" for k in range(8))
        rows += [(n + k, t) for k, t in enumerate((f"{a} {tail} {a}", f"{b} {tail} {b}", a, b, a.upper()))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100) and len({c for _, _, c in got}) == 8


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op1_ngram_jaccard_join(spark, sf_dir).collect()} == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("cell", [1_000_000, 150])
def test_every_link_is_counted_and_listed(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rows = corpus(4, near=120)
    sets = {i: shingles(t, 3) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r.n_links for r in linked(df, 3, 90, 100).collect()}
    assert got == {i: sum(i in p for p in want) for i in sets} and sum(got.values()) > 4 * len(sets)
    links, members = (x.collect() for x in pairs(df, 3, 90, 100))
    rep = {r.doc_id: r.rep for r in members}
    assert rep == {i: min(j for j in sets if sets[j] == s) for i, s in sets.items() if s}
    assert sorted(tuple(r) for r in links) == sorted((a, b, len(sets[a] & sets[b])) for a, b in want if rep[a] == a and rep[b] == b and sets[a] != sets[b])


def test_nulls_repeats_and_empty(spark):
    assert components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (7, None)], "doc_id bigint, text string")
    got = sorted((tuple(r) for r in components(df).collect() if r.doc_id is not None))
    assert got == [(4, 3, 4, 3), (4, 3, 4, 3), (7, 0, 7, 1), (9, 3, 4, 3)]


def test_tile_links_equal_exact_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base[:200], 190, replace=False), rng.choice(base, int(rng.integers(0, 30)))])) for _ in range(60)]
    ids, sizes = np.arange(60), np.array([len(s) for s in sets])
    links = link_tile(ids, sizes, ids * 0, sets, 9, 10, False)
    up = list(range(60))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        up[root(a)] = root(b)
    for a, b in itertools.combinations(range(60), 2):
        i = len(np.intersect1d(sets[a], sets[b]))
        if 10 * i >= 9 * (sizes[a] + sizes[b] - i):
            assert root(a) == root(b)


def test_flags_are_spread_over_the_buckets(spark):
    """Two n-grams that all documents have: their places go to the documents' buckets."""
    rows = [(k, f"one common start of it own{k} a{k} b{k} c{k} d{k}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    size = {}
    for r in df.mapInArrow(jaccard_join._runs(3, 4), "bucket int, run binary, flags binary").collect():
        for data in (r.run, r.flags):
            size[r.bucket] = size.get(r.bucket, 0) + (len(jaccard_join.unpack(data)[0]) if data else 0)
    ordered = sorted(size.values())
    assert len(size) == 16 and ordered[-1] <= 1.5 * ordered[8]


def test_a_common_header_makes_no_cluster(spark):
    """2,000 texts of two copies each, unlike but for twelve words: only prefixes of rare n-grams meet, so nothing is compared."""
    header = "permission is hereby granted free of charge to any person obtaining this"
    rows = [(2 * k + c, f"{header} " + " ".join(f"w{k}x{j}" for j in range(30 + k % 40))) for k in range(2000) for c in (0, 1)]
    rows += [(9000 + c, f"{header} " + " ".join(f"near{j}" for j in range(60)) + f" end{c}") for c in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, _, tiles = jaccard_join._candidate_tiles(df, 5, 8, 10)
    assert {r.rep for r in tiles.select("rep").collect()} == {9000, 9001, 9002}
    got = {r.doc_id: (r.component_id, r.n_links) for r in linked(df).collect()}
    assert got == {i: (9000, 2) if i >= 9000 else (i - i % 2, 1) for i, _ in rows}


@pytest.mark.parametrize("counters", [12, 13])
def test_any_order_of_n_grams_gives_the_same_links(spark, monkeypatch, counters):
    """Few counters: frequencies are sums over many n-grams."""
    monkeypatch.setattr(jaccard_join, "COUNTERS", counters)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in components(df, 3, 90, 100).collect()} == brute(rows, 3, 90, 100)
