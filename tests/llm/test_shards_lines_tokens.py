import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bandloom.llm.line_dedup import deduplicate, fingerprints, matches
from bandloom.llm import shard_balance
from bandloom.llm.shard_balance import cut_links, one_round, op3_sharding, shard, start_labels
from bandloom.llm.token_rollup import TokenLedger, op6_token_counts


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_shards_are_even_and_groups_stay_together(spark):
    rows = [(k, f"text {k % 40}" if k < 300 else f"own {k}") for k in range(600)] + [(k, "hot") for k in range(600, 1000)] + [(2000, None), (2001, None), (None, "x"), (5, "text 5"), (3000, "")]
    got = shard(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    hot = zlib.crc32(b"hot")
    assert sum(len(h) > 1 for c, h in homes.items() if c != hot) <= 7
    whole = sorted(Counter(r.shard for r in got if r.text_crc32 == hot).values(), reverse=True)
    assert whole[0] >= 100  # a group of 400 for shards of 125
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    assert all(r.size == len((t or "").encode()) + 1 for r, t in [(r, dict(rows)[r.doc_id]) for r in got])


def test_rounds_lower_the_cut(spark):
    """Random overlapping groups and one group of a third of all rows; no round breaks the quota."""
    import random

    rng = random.Random(3)
    rows = [(k, f"own {k}" if k >= 1000 else "hot") for k in range(3000)]
    links = [(k, f"g{rng.randrange(150)}") for k in range(1000, 1700) for _ in range(rng.choice([1, 1, 2]))]
    nodes = docs(spark, rows).select(F.col("doc_id").alias("uid"), "doc_id", F.xxhash64("text").alias("grp"))
    member = shard_balance.memberships(nodes, spark.createDataFrame(links, "doc_id bigint, grp string"))
    labels = start_labels(member)
    cuts = [cut_links(member, labels)]
    for _ in range(4):
        before = labels
        labels, moved = one_round(member, labels, 3000 // 8)
        cuts.append(cut_links(member, labels))
        held = Counter(r.label for r in labels.collect())
        assert max(held.values()) <= 375 and labels.count() == before.count()
    assert cuts[0] > cuts[1] > cuts[2] >= cuts[3] >= cuts[4] and cuts[-1] < 0.94 * cuts[0], cuts
    everything = {r.doc_id: r.shard for r in shard(docs(spark, rows), links=spark.createDataFrame(links, "doc_id bigint, grp string")).collect()}
    random_start = {r.doc_id: r.shard for r in shard(docs(spark, rows), rounds=0).collect()}
    groups = defaultdict(list)
    for k, g in links:
        groups[g].append(k)
    apart = lambda home: sum(home[a] != home[b] for m in groups.values() for a in m for b in m)
    assert everything != random_start and apart(everything) < 0.6 * apart(random_start)
    counts = Counter(everything.values())
    assert max(counts.values()) - min(counts.values()) <= 1


def test_full_shards_exchange(spark):
    """All rows linked, in groups of four: no free room, yet most groups come together and quotas hold."""
    nodes = spark.range(20_000).select(F.col("id").alias("uid"), F.col("id").alias("doc_id"), F.xxhash64(F.col("id") % 5000).alias("grp"))
    member = shard_balance.memberships(nodes)
    labels = start_labels(member)
    start = cut = cut_links(member, labels)
    for _ in range(3):
        labels, moved = one_round(member, labels, 2500)
        now = cut_links(member, labels)
        held = Counter(r.label for r in labels.collect())
        assert now <= cut and max(held.values()) <= 2501 and sum(held.values()) == 20_000
        cut = now
    assert cut < start / 8
    got = shard(nodes.select("doc_id", (F.col("doc_id") % 5000).cast("string").alias("text"))).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.doc_id % 5000].add(r.shard)
    assert sum(len(h) == 1 for h in homes.values()) >= 4000
    assert set(Counter(r.shard for r in got).values()) == {2500}


def test_exchanges_keep_counts():
    import random

    rng = random.Random(4)
    for _ in range(50):
        n = rng.choice([2, 3, 8])
        wish = [[0 if s == t else rng.randrange(40) for t in range(n)] for s in range(n)]
        room = [rng.choice([0, 0, 5]) for _ in range(n)]
        go = shard_balance.exchanges(wish, room)
        assert all(0 <= go[s][t] <= wish[s][t] for s in range(n) for t in range(n))
        for t in range(n):
            assert sum(go[s][t] for s in range(n)) - sum(go[t]) <= room[t]
    assert shard_balance.exchanges([[0, 3], [5, 0]], [0, 0]) == [[0, 3], [3, 0]]


def test_op3_by_plain_code(spark, sf_dir):
    """Sizes, checksums, counts and slots of the query, computed again from the texts."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op3_sharding(spark, sf_dir).collect()
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {(i, len(t) + 1, zlib.crc32(t), "rows", None) for i, t in texts.items()}
    assert Counter((r.shard, r.slot) for r in got) == Counter((s, k) for s in range(8) for k in range(len(texts) // 8 + (s < len(texts) % 8)))


def test_sharding_of_the_whole_table(spark, sf_dir):
    got = op3_sharding(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    slots = defaultdict(list)
    homes = defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} == {25}
    assert all(len(h) == 1 for h in homes.values())


def test_shards_of_small_tables(spark):
    assert shard(docs(spark, [])).collect() == []
    got = shard(docs(spark, [(1, "a"), (2, "a"), (3, None)])).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and len({(r.shard, r.slot) for r in got}) == 3


def brute_lines(rows, run):
    seen, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        for p in range(len(lines) - run + 1):
            seen.setdefault(tuple(lines[p : p + run]), (i, p))
    for i, t in rows:
        if t is None or i is None:
            out.append((i, t))
            continue
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - run + 1):
            if seen[tuple(lines[p : p + run])] != (i, p):
                gone.update(range(p, p + run))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("run", [2, 3])
def test_lines_against_brute_force(spark, run):
    import random

    rng = random.Random(run)
    blocks = [["a", "b", "c"], ["l1", "l2"], ["x", "x", "x", "x"], ["", "", "q"], ["é", "ü"]]
    rows = []
    for k in range(50):
        lines = [f"own {k} {j}" for j in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(blocks)
        rows.append((k * 3, "\n".join(lines)))
    rows += [(500, None), (501, ""), (None, "a\nb\nc"), (502, "z\n" * 200), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id bigint, text string, pos string").repartition(4)
    out = deduplicate(df, run)
    assert out.columns == ["doc_id", "text", "pos", "_lines", "_removed"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute_lines(rows, run)
    assert deduplicate(df.limit(0), run).collect() == []


def brute_single_lines(rows, words):
    """Positions by document of later long lines and of later documents of one line."""
    lines, whole, gone = set(), set(), defaultdict(set)
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for p, x in enumerate(t.split("\n")):
            if len(x.split()) >= words:
                if x in lines:
                    gone[i].add(p)
                lines.add(x)
        if t and "\n" not in t:
            if t in whole:
                gone[i].add(0)
            whole.add(t)
    return gone


def test_single_lines_by_length(spark):
    licence = "this text may be used by anyone for any purpose"
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"own {k}\n{licence}\nmore {k}") for k in range(5)]
    rows += [(10, passage), (11, f"x 11\n{passage}"), (12, passage), (13, "short"), (14, "short"), (15, "short\nown 15"), (16, "y 16\nshort"), (17, ""), (18, ""), (19, None), (None, passage)]
    rows += [(20, f"{licence}\n{licence}\na 20"), (21, "k 21\ntwo words\nl 21"), (22, "m 22\ntwo words\nn 22")]
    got = {(r.doc_id, r.text, r._removed) for r in deduplicate(docs(spark, rows), words=5).collect()}
    gone = brute_single_lines(rows, 5)
    want = set()
    for i, t in rows:
        drop = gone[i] if i is not None else set()
        want.add((i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop), len(drop)))
    assert got == want and {i for i, _, n in got if n} == {1, 2, 3, 4, 11, 12, 14, 20}


def brute_lines_and_single(rows, run, words):
    """Both rules on the same input: Counter of (doc_id, text)."""
    gone = brute_single_lines(rows, words)
    seen = {}
    known = sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0])
    for i, t in known:
        lines = t.split("\n")
        for p in range(len(lines) - run + 1):
            if seen.setdefault(tuple(lines[p : p + run]), (i, p)) != (i, p):
                gone[i].update(range(p, p + run))
    return Counter((i, t if t is None or i is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])) for i, t in rows)


@pytest.mark.parametrize("run", [2, 4])
def test_both_rules_in_many_contexts(spark, run):
    """Short and long lines in few orders: a fingerprint's first place often stands in another context."""
    import random

    rng = random.Random(run + 7)
    pool = ["a", "b", "", "c d", "one two three four five", "six seven eight nine ten", "v w x y z"]
    rows = [(k * 5 % 211, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for k in range(150)]
    rows += [(300 + k, f"own {k}\n" + "\n".join(pool)) for k in range(3)] + [(None, "a\nb"), (400, None)]
    df = docs(spark, rows).repartition(4)
    assert Counter((r.doc_id, r.text) for r in deduplicate(df, run, 5).collect()) == brute_lines_and_single(rows, run, 5)


def test_matches_are_extended_to_both_sides(spark):
    """Ten equal lines between others: the matches are of the ten, none goes beyond, and nothing is left to windows but the edges."""
    block = [f"line {k}" for k in range(10)]
    rows = [(d, "\n".join([f"p {d}", f"q {d}", *block, f"r {d}", f"s {d}"])) for d in range(4)]
    got = matches(docs(spark, rows), 4).collect()
    runs = [(r.doc_id, p) for r in got if r["size"] for p in range(r.pos, r.pos + r["size"])]
    assert set(runs) == {(d, p) for d in (1, 2, 3) for p in range(2, 12)} and all(r["size"] in (0, 4, 5, 6, 7) for r in got)
    assert all(w.pos in (0, 1, 9, 10) for r in got for w in r.rest)


def test_windows_of_long_lines_need_no_fingerprint(spark):
    """A fingerprint for each long line, and of windows only where a short line stands."""
    rows = [(1, "\n".join(f"line of five words {k}" for k in range(50))), (2, "\n".join(f"short {k}" for k in range(50)))]
    got = fingerprints(docs(spark, rows), 2, 5).collect()
    assert all(not r.around for r in got if r.doc_id == 1) and sum(r.doc_id == 1 for r in got) == 50
    assert 25 <= sum(r.doc_id == 2 for r in got) < 40 and sum(len(r.around) for r in got) == 49


def test_clashing_columns(spark):
    rows = [(1, "a\nb", 1, 2, 3, 4, 5), (2, "a\nb\nc", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _pos int, _block int, row int, _removed int, n int")
    out = deduplicate(df)
    assert out.columns == ["doc_id", "text", "_pos", "_block", "row", "n", "_lines", "_removed"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a\nb", 1, 2, 3, 5, 2, 0), (2, "c", 1, 2, 3, 5, 3, 2)]


def test_fingerprints_are_fewer_than_lines(spark):
    """Winnowed: about two of three lines for runs of two, two of six for runs of five."""
    import random

    rng = random.Random(1)
    df = docs(spark, [(k, "\n".join(str(rng.random()) for _ in range(300))) for k in range(10)])
    for run, most in ((2, 0.72), (5, 0.38)):
        rows = fingerprints(df, run).collect()
        assert len(rows) < most * 3000
        assert Counter((r.doc_id, w.pos) for r in rows for w in r.around) == Counter((d, p) for d in range(10) for p in range(300 - run + 1))


def test_ledger(spark, tmp_path):
    schema = "kind string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().collect() == []
    one = spark.createDataFrame([("insert", "s", "en", "t1", 10, None), ("insert", "s", None, "t1", 4, None), ("insert", "s", "en", "t1", None, None)], schema)
    two = spark.createDataFrame([("delete", "s", "en", "t1", 10, None), ("revise", "s", None, "t1", 7, 4), ("insert", None, "en", "t2", 1, 0)], schema)
    assert ledger.commit("1", one) and not ledger.commit("1", one)
    ledger.refresh()
    assert ledger.commit("2", two) and not ledger.commit("2", two)
    want = {("s", "en", "t1", 1, 0), ("s", None, "t1", 1, 7), (None, "en", "t2", 1, 1)}
    assert {tuple(r) for r in ledger.totals().collect()} == want
    ledger.refresh()
    assert {tuple(r) for r in ledger.totals().collect()} == want
    assert ledger.commit("3", one.limit(0)) and {tuple(r) for r in ledger.totals().collect()} == want
    with pytest.raises(Exception, match="no such kind"):
        ledger.commit("4", one.withColumn("kind", F.lit("upsert")))
    assert "4" not in ledger.batches()


CHANGES = "kind string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"


def test_a_commit_during_a_refresh_counts_once(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    insert = spark.createDataFrame([("insert", "s", "en", "t", 10, None)], CHANGES)
    ledger.commit("1", insert)
    plain = ledger._batches

    def slow():
        found = plain()
        ledger._batches = plain
        ledger.commit("2", insert)  # after the ids are fixed, before the sums are written
        return found

    ledger._batches = slow
    ledger.refresh()
    assert [tuple(r)[3:] for r in ledger.totals().collect()] == [(2, 20)]
    ledger.refresh()
    assert [tuple(r)[3:] for r in ledger.totals().collect()] == [(2, 20)]


def test_another_process_between_any_two_listings(spark, tmp_path, monkeypatch):
    """At every listing of a refresh or a read another ledger commits and refreshes; each batch counts once."""
    from bandloom.llm import token_rollup

    insert = spark.createDataFrame([("insert", "s", "en", "t", 10, None)], CHANGES)
    plain = token_rollup.list_dirs
    for call in ("refresh", "totals"):
        for at in range(1, 7):
            path = f"file://{tmp_path}/ledger-{call}-{at}"
            ledger, other = TokenLedger(spark, path), TokenLedger(spark, path)
            ledger.commit("1", insert)
            ledger.refresh()
            calls = []

            def list_dirs(*args, at=at, calls=calls, other=other):
                calls.append(1)
                if len(calls) == at:
                    other.commit("2", insert)
                    other.refresh()
                return plain(*args)

            monkeypatch.setattr(token_rollup, "list_dirs", list_dirs)
            seen = [tuple(r)[3:] for r in getattr(ledger, call)().collect()] if call == "totals" else []
            monkeypatch.setattr(token_rollup, "list_dirs", plain)
            assert set(seen) <= {(1, 10), (2, 20)}
            want = [(2, 20)] if len(calls) >= at else [(1, 10)]
            assert [tuple(r)[3:] for r in ledger.totals().collect()] == want
            ledger.refresh()
            assert [tuple(r)[3:] for r in ledger.totals().collect()] == want
            numbers = [d.split("-")[0] for d in ledger._versions()]
            assert len(numbers) == len(set(numbers))
            if len(calls) < at:
                break


def test_one_batch_sent_twice_at_once(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    insert = spark.createDataFrame([("insert", "s", "en", "t", 10, None)], CHANGES)
    ledger.commit("1", insert)
    ledger.batches = lambda: []  # the second sender saw no batch
    assert ledger.commit("1", insert)
    del ledger.batches
    assert ledger.batches() == ["1"] and [tuple(r)[3:] for r in ledger.totals().collect()] == [(1, 10)]
    ledger.refresh()
    assert [tuple(r)[3:] for r in ledger.totals().collect()] == [(1, 10)]


def test_token_counts_against_tiktoken(spark, tmp_path, sf_dir):
    import tiktoken

    from bandloom.llm.byte_bpe import coder, default_vocabulary

    rank_file, pattern = default_vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder(rank_file, pattern).ranks, special_tokens={})
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(9000, None, None, "en"), (9001, "", "s", None), (9002, "", "s", None), (None, rows[3][1], "s", "en"), (9003, rows[5][1], None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(f"file://{tmp_path}/t/documents.parquet")
    first, want = {}, defaultdict(lambda: [0, 0])
    for i, t, _, _ in rows:
        if i is not None and t is not None:
            first[t] = min(first.get(t, i), i)
    for i, t, s, lang in rows:
        if i is None or t is None or first[t] == i:
            for name, n in (("byte_bpe_multi_50k", len(reference.encode_ordinary(t or "")) + 1), ("utf8_bytes", len((t or "").encode()))):
                want[s, lang, name][0] += 1
                want[s, lang, name][1] += n
        else:
            want[s, lang, "byte_bpe_multi_50k"], want[s, lang, "utf8_bytes"]
    assert {tuple(r)[:3]: list(r)[3:] for r in op6_token_counts(spark, f"file://{tmp_path}/t").collect()} == dict(want)


def test_line_dedup_plan_is_that_of_large_tables(spark):
    docs = spark.createDataFrame([(k, "the same line of five words\nline %d" % k) for k in range(20)], "doc_id bigint, text string")
    from bandloom.llm.line_dedup import deduplicate

    plan = deduplicate(docs, words=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
