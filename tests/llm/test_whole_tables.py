"""Registered queries on whole small tables, and operators on very long texts, against plain code."""

import hashlib
import re
from collections import Counter

import numpy as np
from test_substring_dedup import brute as brute_repeats

from bandloom.llm import decontaminate, jaccard_join, language_id, line_dedup, media, secrets_scan, shard_balance, substring_dedup
from bandloom.llm.decontaminate import common_subsequence, least, op5_benchmark_decontamination
from bandloom.llm.media import op8_media_columns, pad
from bandloom.llm.secrets_scan import KINDS, op2_secret_scan

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_op2_on_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_secret_scan(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    for r in got:
        t = texts[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 16]
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_op5_on_the_table(spark, sf_dir):
    """Every document against every item, window by window."""
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    docs = {r.doc_id: split(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for k, item in items.items():
        m = len(item)
        assert 13 <= m <= 96
        bits, span, tail, own = {}, -(-3 * m // 2), item[-max(3, -(-m // 5)) :], set(item)
        for j, t in enumerate(item):
            bits[t] = bits.get(t, 0) | 1 << j
        for d, words in docs.items():
            if len(own.intersection(words)) + m - len(own) < least(m, True):
                continue
            for at, t in enumerate(words):
                part = words[at : at + span]
                if t in bits and len(own.intersection(part)) + m - len(own) >= least(m, True):
                    n = common_subsequence(np.arange(m), bits, part)
                    if n >= least(m, False) or n >= least(m, True) and any(part[j : j + len(tail)] == tail for j in range(len(part))):
                        want.add((d, k))
                        break
    got = {(r.doc_id, r.item_id) for r in op5_benchmark_decontamination(spark, sf_dir).collect()}
    assert want and got <= want and len(got) >= 0.98 * len(want)


def test_op8_on_the_table(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op8_media_columns(spark, sf_dir).collect():
        payload = pad(texts.pop(r.doc_id))
        movie = media.write_movie(payload)
        assert (r.payload_bytes, r.payload_sha256, r.media_bytes, r.media_sha256) == (len(payload), hashlib.sha256(payload).hexdigest(), len(movie), hashlib.sha256(movie).hexdigest())
        assert r.feature.startswith("codec=raw;seconds=") and movie.find(payload) > 0
    assert not texts


def test_very_long_texts(spark):
    """Texts of over a million bytes: one word, many words, many lines; copies and almost copies."""
    words = " ".join(f"w{k * 7919 % 100003}" for k in range(180_000))
    lines = "\n".join(f"line number {k} of the long text" for k in range(36_000))
    rows = [(1, words), (2, words), (3, words.replace("w7919 ", "other ", 1)), (4, "x" * 1_200_000), (5, lines), (6, lines + "\nend of the text is here now"), (7, "short one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    near = {r.doc_id: r.component_id for r in jaccard_join.components(df).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert {tuple(r) for r in substring_dedup.remove_repeats(df, batches=1).collect()} == brute_repeats(rows)
    cut = {r.doc_id: (r._lines, r._removed) for r in line_dedup.deduplicate(df, words=5).collect()}
    assert cut == {1: (1, 0), 2: (1, 1), 3: (1, 0), 4: (1, 0), 5: (36_000, 0), 6: (36_001, 36_000), 7: (1, 0)}
    assert sorted(r.shard for r in shard_balance.shard(df).collect()) == list(range(7))
    scorer = secrets_scan.train([], [f"word{k}" for k in range(100)])
    assert len(secrets_scan.scan(df, scorer).collect()) == 7
    item = words.split()[1000:1040]
    found = decontaminate.leaks(df, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in found} == {1, 2, 3}
    models = language_id.train(spark.createDataFrame([(k, "the text is long and here it ends now", "en") for k in range(9)], "doc_id bigint, text string, lang string"))
    assert len(language_id.identify(df, models).collect()) == 7
    assert {r.n_bytes for r in media.store_texts(df).collect()} == {len(t.encode()) for _, t in rows}


def test_sql_of_the_queries(spark, sf_dir):
    import duckdb

    from bandloom.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert set(ORACLES) >= {"op1_ngram_jaccard_join", "op9_line_dedup", "op10_substring_dedup"}
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf_dir).toPandas()
        columns = sorted(got.columns)
        want = con.sql(sql).df()
        rows = lambda df: Counter(map(tuple, df[columns].to_numpy().tolist()))
        assert sorted(want.columns) == columns and rows(got) == rows(want)
