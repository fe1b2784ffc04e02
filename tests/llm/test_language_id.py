import zlib

import numpy as np

from bandloom.llm.language_id import LEAST_MARGIN, SPREAD, KneserNey, _fit, codes, count_grams, fold, grams_of, held_out, identify, op4_language_id, summed, train, train_folds

EN = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun near the river"
DE = "der schnelle braune fuchs springt über den faulen hund und schläft dann in der warmen sonne am fluss"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")


def rows():
    out = []
    for k in range(40):
        w = (EN if k % 2 else DE).split()
        out.append((k, " ".join(w[k % 5 :] + w[: k % 7]), "en" if k % 2 else "de", 0))
    return out


def test_probabilities_sum_to_one():
    keys, _ = grams_of([EN, DE, EN + DE])
    found, counts = np.unique(keys, return_counts=True)
    letters = np.unique(found & np.uint64(0xFFFF))
    model = KneserNey.fit(*summed(found, counts), len(letters))
    for context in (found[3] >> np.uint64(16), found[-1] >> np.uint64(16), np.uint64(ord("t") << 16 | ord("h"))):
        total = np.exp(model.log_p(context << np.uint64(16) | letters)).sum()
        assert 0.97 < total < 1.0001


def test_codes():
    assert codes("1 2 !").size == 0
    assert codes("A  b,c").tolist() == [0, 0, 0, 97, 0, 98, 0, 99]


def test_whole_languages_and_rejection(spark):
    models = train(frame(spark, rows()))
    test = [(1, "the fox sleeps near the warm river", None, 1), (2, "der hund schläft am warmen fluss", None, 1), (3, None, "en", 1), (4, "12 !!", "en", 1), (5, "zxqj vkkw qqzx jjvx wqzz kxvj zzqq xkcd vvbq", "en", 1), (6, "", None, 1), (None, EN, None, 1), (6, "", None, 1)]
    got = [tuple(r) for r in identify(frame(spark, test), models, carry=["score"]).select("doc_id", "lang_pred", "rejected").collect()]
    assert got == [(1, "en", False), (2, "de", False), (3, "und", True), (4, "und", True), (5, got[4][1], True), (6, "und", True), (None, "en", False), (6, "und", True)]


def test_models_are_fitted_on_all_four_grams(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 10_000))) for _ in range(45)]
    want = len(np.unique(grams_of(texts)[0]))
    from bandloom.llm.runs import unpack

    found = [unpack(bytes(r["run"])) for r in count_grams(frame(spark, [(k, t, "zh", 0) for k, t in enumerate(texts)])).collect()]
    assert want > 400_000 and sum(len(k) for k, _ in found) == want and sum(int(c.sum()) for _, c in found) == 450_000


def test_labelled_garbage_does_not_lift_the_margin(spark):
    rng = np.random.default_rng(4)
    junk = lambda: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60))
    clean = train(frame(spark, rows()))
    models = train(frame(spark, [*rows(), (900, junk(), "en", 0)]))
    assert models.margin <= clean.margin + 5
    test = [(k, junk(), None, 0) for k in range(20)] + [(k, "καλημέρα σας τι κάνετε σήμερα το πρωί", None, 0) for k in range(20, 22)] + rows()
    _, _, rejected = models.predict([r[1] for r in test])
    assert rejected[:22].all() and not rejected[22:].any()


def test_no_training_rows(spark):
    models = train(frame(spark, []))
    assert [r["lang_pred"] for r in identify(frame(spark, rows()[:2]), models).collect()] == ["und", "und"]


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op4_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_of_null(spark):
    assert spark.createDataFrame([(None,)], "d bigint").select(held_out(__import__("pyspark").sql.functions.col("d"))).first()[0] is False


def test_every_labelled_text_calibrates(spark):
    rng = np.random.default_rng(6)
    words = {x: [w + chr(97 + k) for w in t.split() for k in range(3)] for x, t in (("de", DE), ("en", EN))}
    table = [(k, " ".join(rng.choice(words[x], 3 + k % 9)), x, 0) for k in range(4600) for x in [("de", "en")[k % 2]]]
    table += [(k, " ".join(rng.choice(words["en"], 4000)), "en", 0) for k in range(4600, 4604)]  # over 20,000 characters
    df = frame(spark, table)

    def fitted(rows):
        return _fit({x: summed(*(lambda keys: (keys, np.ones(len(keys), np.int64)))(grams_of([r[1] for r in rows if r[2] == x])[0])) for x in ("de", "en")})

    def limits(judged):
        h, sizes = (np.concatenate(c) for c in zip(*judged, strict=True))
        usual = np.median(h[:, -1])
        return usual, max(LEAST_MARGIN, SPREAD * np.quantile((h[:, -1] - usual) * np.sqrt(np.clip(sizes, 1, 400)), 0.9))

    def judge(half):
        return [fitted([r for r in table if half[r[0]] != k]).entropies([r[1] for r in table if half[r[0]] == k]) for k in (0, 1)]

    models = train(df)
    assert np.allclose((models.usual, models.margin), limits(judge({r[0]: zlib.crc32(str(r[0]).encode()) >> 8 & 1 for r in table})), rtol=1e-9)
    judged = judge(dict(df.select("doc_id", fold(df["doc_id"])).collect()))
    for k, own in enumerate(train_folds(df)):
        assert np.allclose((own.usual, own.margin), limits(judged[k : k + 1]), rtol=1e-9)
