import hashlib
import random

import pytest

from bandloom.llm import substring_dedup
from bandloom.llm.substring_dedup import FingerprintIndex, op10_substring_dedup, remove_repeats


def brute(rows, window=13):
    first = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = set()
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.add((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(3))
    passages = [" ".join(word() for _ in range(n)) for n in (13, 14, 40, 12)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i * 3, rng.choice([" ", "\n", "\t\x0b"]).join(parts)))
    return [*rows, (1000, None), (1001, ""), (1002, "a " * 500), (1003, "a " * 40), (1004, rows[0][1])]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, pos string").repartition(5)
    got = {tuple(r) for r in remove_repeats(df).collect()}
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_number_of_batches_does_not_matter(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all({tuple(r) for r in remove_repeats(df, batches=s).collect()} == brute(rows) for s in (1, 5))


def test_index_batches_and_compaction(spark, tmp_path):
    rows = corpus(3)
    index = FingerprintIndex(spark, f"file://{tmp_path}/index", bits=2)
    flagged = set()
    for k in range(0, len(rows), 16):
        part = spark.createDataFrame(rows[k : k + 16], "doc_id bigint, text string")
        flagged |= {r["doc_id"] for r in index.merge_batch(part).collect()}
    assert len(index.runs()) <= 3
    assert flagged == {r[0] for r in brute(rows) if r[2]}


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert remove_repeats(empty).collect() == []
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id bigint, text string")
    got = sorted(tuple(r)[:3] for r in remove_repeats(df).collect() if r["doc_id"] is not None)
    assert got == [(1, 20, 0), (1, 20, 0), (2, 20, 20)]


def thue_morse(n, letters="ab"):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_structured_words_do_not_collide(spark):
    rows = []
    for n in (1024, 4096):
        tail = " ".join(f"w{n}x{k}" for k in range(12))
        rows += [(n + 1, f"{thue_morse(n)} {tail}"), (n + 2, f"{thue_morse(n, 'ba')} {tail}"), (n + 3, f"{thue_morse(n)} {tail} more")]
    got = {tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), batches=1).collect()}
    assert got == brute(rows) and [r[2] for r in sorted(got)] == [0, 0, 13] * 2


@pytest.mark.parametrize("batches", [1, 3])
def test_colliding_hashes_are_found_out(spark, tmp_path, batches):
    """Hashes of 10 bits: nearly every document has windows that meet others' hashes."""
    rows = corpus(5)
    index = FingerprintIndex(spark, f"file://{tmp_path}/index", bits=3, hash_bits=10)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {tuple(r) for r in remove_repeats(df, index=index, batches=batches).collect()} == brute(rows)


def test_levels_of_buckets_and_history(spark, tmp_path, monkeypatch):
    """2**5 buckets in steps of 2**2, and an index of earlier documents."""
    monkeypatch.setattr(substring_dedup, "LEVEL", 2)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    old, new = df.where("doc_id < 90"), df.where("doc_id >= 90")
    index = FingerprintIndex(spark, f"file://{tmp_path}/index", bits=5)
    index.merge_batch(old)
    got = {tuple(r) for r in remove_repeats(new, index=index, history=old, batches=1).collect()}
    assert got == {r for r in brute(rows) if r[0] >= 90}


def test_an_index_opened_again_keeps_its_shape(spark, tmp_path):
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    old, new = df.where("doc_id < 90"), df.where("doc_id >= 90")
    path = f"file://{tmp_path}/it's an index"
    FingerprintIndex(spark, path, bits=5).merge_batch(old)
    for other in ({"bits": 7}, {"window": 12}, {"hash_bits": 32}):
        with pytest.raises(ValueError, match="the index in"):
            FingerprintIndex(spark, path, **other)
    again = FingerprintIndex(spark.newSession(), path)
    got = {tuple(r) for r in remove_repeats(new, index=again, history=old, batches=1).collect()}
    assert got == {r for r in brute(rows) if r[0] >= 90} and sum(r[2] for r in got)


def test_flags_are_spread_over_the_buckets(spark):
    """Near copies in few tasks: their reports are dealt out like the windows."""
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*words[:40], f"own{k}", *words[40:]])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    size = {}
    for r in substring_dedup.window_runs(df, 13, 4).collect():
        for data in (r.run, r.flags):
            size[r.bucket] = size.get(r.bucket, 0) + (len(substring_dedup.unpack(data)[0]) if data else 0)
    ordered = sorted(size.values())
    assert len(size) == 16 and ordered[-1] <= 2 * ordered[8]


def test_merge_join_without_shuffle(spark, tmp_path):
    index = FingerprintIndex(spark, f"file://{tmp_path}/index", bits=4)
    df = spark.createDataFrame(corpus(7), "doc_id bigint, text string")
    index.merge_batch(df.where("doc_id < 60"))
    a = index._table(index.runs()[0])
    joined = a.groupBy("bucket").cogroup(a.groupBy("bucket")).applyInArrow(substring_dedup._compact, substring_dedup.RUN_SCHEMA)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op10_substring_dedup(spark, sf_dir).collect()} == brute(rows)
