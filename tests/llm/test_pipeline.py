import hashlib
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_jaccard_join import brute  # noqa: E402
from test_shards_lines_tokens import brute_lines_and_single  # noqa: E402


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on its own input: language rejection is checked by its rule, the rest by plain code."""
    import tiktoken

    from bandloom.llm import language_id
    from bandloom.llm.byte_bpe import coder, default_vocabulary
    from bandloom.storage import materialise

    docs, steps = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(function(spark, docs, sf_dir), f"test-{name}")
        steps[name] = before.collect(), docs.collect()

    before, after = steps["language_id"]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models, half = language_id.train_folds(table), dict(table.select("doc_id", language_id.fold(table["doc_id"])).collect())
    kept = [r.doc_id for r in before if not models[half[r.doc_id]].predict([r.text or ""])[2][0]]
    assert Counter(r.doc_id for r in after) == Counter(kept) and len(kept) >= 0.98 * len(before)

    before, after = steps["line_dedup"]
    cut = brute_lines_and_single([(r.doc_id, r.text) for r in before], 2, 5)
    whole = {r.doc_id: r.text for r in before}
    want = {(i, t) for i, t in cut if t or not whole[i]}
    got = {(r.doc_id, r.text) for r in after}
    assert got - want == set() and all(t == "" or set(t) == {"\n"} for _, t in want - got)
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = steps["ngram_jaccard_join"]
    classes = brute([(r.doc_id, r.text) for r in before], 5, 8, 10)
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in classes if i == c)

    before, after = steps["benchmark_decontamination"]
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    verbatim = {r.doc_id for r in before if any(x in words(r.text) for x in items)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert verbatim <= gone and len(gone) <= len(verbatim) + 2

    before, after = steps["byte_bpe"]
    ranks, pattern = coder(*default_vocabulary()).ranks, default_vocabulary()[1]
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(before) == len(after) and all(r.round_trip and r.ids == reference.encode_ordinary(texts[r.doc_id]) for r in after)


def test_digests_of_all_texts(spark, sf_dir):
    import tiktoken

    from bandloom.llm.byte_bpe import coder, default_vocabulary, digests

    rank_file, pattern = default_vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder(rank_file, pattern).ranks, special_tokens={})
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "a" * 5000 + " \n\t " * 90), (9003, "日本語 🎉 don't  x\r\n\x1c ٣"), (None, "null id"), (9003, "again")]
    got = Counter(tuple(r) for r in digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), sha(b"".join(k.to_bytes(4, "little") for k in ids)), sha((t or "").encode())] += 1
    assert got == want


def test_labelled_junk_is_rejected(spark, sf_dir):
    """Junk and foreign scripts that carry a language's label go; almost all others stay."""
    import random

    rng = random.Random(4)
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    junk = [(10_000 + k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)), "en", "s", 0) for k in range(20)]
    junk += [(10_100 + k, "".join(chr(rng.randrange(0x3B1, 0x3C9)) if rng.random() < 0.8 else " " for _ in range(300)), "fr", "s", 0) for k in range(10)]
    docs = table.union(spark.createDataFrame(junk, table.schema))
    left = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    assert sum(i in left for i, *_ in junk) <= 2
    assert sum(i < 10_000 for i in left) >= 0.99 * table.count()


def test_odd_tables_through_all_stages(spark, tmp_path):
    """Nulls everywhere, empty and long texts, repeated rows, clashing columns, and empty tables."""
    from bandloom import storage

    passage = " ".join(f"word{k % 37}x{k}" for k in range(70))
    rows = [(1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 1), (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 1), (2, None, None, None, None), (None, passage, "en", None, None), (3, "", "en", "s", 0), (4, passage, None, None, 2), (5, passage, "en", "s", 2), (None, None, None, None, None), (6, "der hund und die katze " * 60_000, "de", "s", None)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    items = [(1, passage), (None, "x"), (2, None), (3, "")]
    for name, some, bench in (("odd", rows, items), ("empty", [], items), ("no-items", rows, [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(*r, 7, "x") for r in some], kinds + ", block int, row string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (stage, function) in enumerate(corpus_pipeline.STAGES):
            docs = storage.materialise(function(spark, docs, folder), f"odd-{stage}")
            assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
        got = docs.collect()
        assert all(r.round_trip for r in got) and (some or not got)
        if name == "odd":
            assert {r.doc_id for r in got} <= {1, 6, None} and sum(r.doc_id == 1 for r in got) <= 1
