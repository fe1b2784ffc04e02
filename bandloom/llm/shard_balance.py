"""Sharding by balanced label propagation, with DataFrame functions only.

Documents are linked through groups: equal texts, and further groups if given.  Labels
start even and at random.  Every round joins memberships with labels, counts each group's
documents by shard, and sums the counts of a document's groups; a document wants to the
shard with most of its neighbours, ties being broken alike for a whole group, so that it
moves as one.  Shards exchange documents: for each ordered pair of shards a histogram of
gains says how many want to go; as many go each way, in pairs and in rings of three, and
free room takes more.  Those who gain most go first.  So linked documents never fill a shard
beyond its quota, all rows / shards, and full shards still trade.  The labels of the last
round stand.  Documents without links fill what is left: of a shard that holds too many rows
only the surplus moves, documents without links first, so that counts are at most one apart.

Groups are only ever counted.  The counts of a group with more than ``HOT_SHARE`` of all
memberships come by a broadcast of fewer than 4096 rows; ranks come from a histogram of
bounded size and a row number within each small bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandloom.storage import materialise

SHARDS = 8
ROUNDS = 8
HOT_SHARE = 1 / 4096
#: Buckets of a pair of shards and a class of gains, in which moves are accepted as a whole; and the classes, by powers of two.
MOVES, GAINS = 1024, 16
#: Buckets of documents that are dealt out evenly at the start.
STARTS = 4096
#: Rows in a bucket of the last ranking, about, and the greatest number of buckets of a class.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 1 << 14
#: The order in which a shard keeps its rows.
HOT, LINKED, ALONE = 0, 1, 2


def _start(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("start"), "uid"), F.lit(shards)).cast("int")


def _met(memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """Memberships (uid, grp, hot) with the columns of their group; hot groups don't meet in one task."""
    hot = memberships.where("hot").join(F.broadcast(groups.where("hot").drop("hot")), "grp")
    return hot.unionByName(memberships.where("not hot").join(groups.where("not hot").drop("hot"), "grp"))


def memberships(nodes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(uid, grp, hot) of documents in groups of two or more: those of ``nodes`` (uid, doc_id, grp), and of ``links`` (doc_id, grp)."""
    every = nodes.select("uid", "grp")
    if links is not None:
        more = links.where("doc_id is not null and grp is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.lit("link"), "grp").alias("grp")).distinct()
        every = every.union(nodes.select("uid", "doc_id").join(more, "doc_id").select("uid", "grp"))
    totals = materialise(every.groupBy("grp").agg(F.count(F.lit(1)).alias("total")).where("total > 1"), "shard-groups")
    rows = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    is_hot = F.col("total") > rows * HOT_SHARE
    marked = every.join(F.broadcast(totals.where(is_hot).select("grp", F.lit(True).alias("hot"))), "grp", "left")
    cold = marked.where("hot is null").select("uid", "grp").join(totals.where(~is_hot).select("grp"), "grp")
    return materialise(marked.where("hot").select("uid", "grp", "hot").union(cold.select("uid", "grp", F.lit(False).alias("hot"))), "shard-links")


def group_counts(member: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """(grp, hot, c0, c1, ...): each group's documents by shard."""
    return member.join(labels.select("uid", "label"), "uid").groupBy("grp", "hot").agg(*[F.count_if(F.col("label") == s).alias(f"c{s}") for s in range(shards)])


def cut_links(member: DataFrame, labels: DataFrame, shards: int = SHARDS) -> int:
    """Pairs of documents of one group in different shards."""
    n = sum((F.col(f"c{s}") for s in range(shards)), F.lit(0))
    pairs = lambda c: c * (c - 1) / 2
    cut = pairs(n) - sum((pairs(F.col(f"c{s}")) for s in range(shards)), F.lit(0))
    return int(group_counts(member, labels, shards).agg(F.sum(cut)).first()[0] or 0)


def start_labels(member: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(uid, g, hot, label) of the linked documents: an even random label, and the group that they move with."""
    own = materialise(member.groupBy("uid").agg(F.min("grp").alias("g"), F.max("hot").alias("hot")), "shard-linked")
    part = F.pmod(F.xxhash64(F.lit("start"), "uid"), F.lit(STARTS)).cast("int")
    held, home = [0] * shards, []
    sizes = own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most STARTS rows
    for r in sorted(sizes, key=lambda r: (-r["n"], r["part"])):
        s = held.index(min(held))
        held[s] += r["n"]
        home.append((r["part"], s))
    dealt = own.sparkSession.createDataFrame(home, "part int, label int")
    return materialise(own.withColumn("part", part).join(F.broadcast(dealt), "part").select("uid", "g", "hot", "label"), "shard-labels")


def exchanges(wish: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the ``wish[s][t]`` documents that want from s to t may go: pairs, rings of three, then free room."""
    shards = range(len(room))
    left, go, room = [row[:] for row in wish], [[0] * len(room) for _ in shards], room[:]

    def take(steps: list[tuple[int, int]], k: int) -> None:
        for s, t in steps:
            left[s][t] -= k
            go[s][t] += k

    for s in shards:
        for t in range(s):
            take([(s, t), (t, s)], min(left[s][t], left[t][s]))
    for a in shards:
        for b in shards:
            for c in shards:
                if len({a, b, c}) == 3:
                    take([(a, b), (b, c), (c, a)], min(left[a][b], left[b][c], left[c][a]))
    moving = True
    while moving:  # whoever leaves makes room
        moving = False
        for t in shards:
            for s in shards:
                k = min(room[t], left[s][t])
                if k > 0:
                    take([(s, t)], k)
                    room[t] -= k
                    room[s] += k
                    moving = True
    return go


def one_round(member: DataFrame, labels: DataFrame, quota: int, shards: int = SHARDS) -> tuple[DataFrame, int]:
    """(labels after a round, number of moves).  No shard gets beyond ``quota`` linked documents, or beyond what it had."""
    held = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = [max(0, quota - held.get(s, 0)) for s in range(shards)]
    counts = materialise(group_counts(member, labels, shards), "shard-counts")
    near = _met(member, counts).groupBy("uid").agg(*[F.sum(f"c{s}").alias(f"c{s}") for s in range(shards)])
    met = near.join(labels, "uid")
    turn = lambda s: F.pmod(F.xxhash64("g") + s, F.lit(shards))  # noqa: E731  # ties go the same way for a whole group
    best = F.greatest(*[F.struct(F.col(f"c{s}").alias("c"), turn(s).alias("t"), F.lit(s).alias("s")) for s in range(shards)])
    part = F.pmod(F.xxhash64("g", F.when(F.col("hot"), F.col("uid"))), F.lit(MOVES)).cast("int")
    gain = best["c"] - sum((F.when(F.col("label") == s, F.col(f"c{s}")).otherwise(0) for s in range(shards)), F.lit(0))
    rank = GAINS - 1 - F.least(F.lit(GAINS - 1), F.floor(F.log2(gain + 1.0))).cast("int")
    wanted = materialise(met.select("uid", "g", "hot", "label", best["s"].alias("target"), (rank * MOVES + part).alias("turn")), "shard-moves")
    pair = ["label", "target"]
    # at most shards**2 * GAINS * MOVES rows
    come = materialise(wanted.where("target <> label").groupBy(*pair, "turn").agg(F.count(F.lit(1)).alias("n")), "shard-wishes")
    wish = [[0] * shards for _ in range(shards)]
    for r in come.groupBy(*pair).agg(F.sum("n").alias("n")).collect():
        wish[r["label"]][r["target"]] = r["n"]
    go = exchanges(wish, room)
    moved = sum(map(sum, go))
    if not moved:
        return labels, 0
    caps = labels.sparkSession.createDataFrame([(s, t, go[s][t]) for s in range(shards) for t in range(shards) if go[s][t]], "label int, target int, cap bigint")
    upto = come.withColumn("upto", F.sum("n").over(Window.partitionBy(*pair).orderBy("turn")))
    # the first bucket of each pair that doesn't go as a whole; none where all go
    edge = upto.join(F.broadcast(caps), pair).where("upto > cap").groupBy(*pair).agg(F.min_by(F.struct("turn", (F.col("cap") - F.col("upto") + F.col("n")).alias("rest")), "turn").alias("e"))
    limits = materialise(caps.join(edge, pair, "left").select(*pair, F.col("e.turn").alias("last"), F.col("e.rest").alias("rest")), "shard-limits")
    met = wanted.join(F.broadcast(limits.withColumn("some", F.lit(True))), pair, "left")
    split = F.coalesce(F.col("turn") == F.col("last"), F.lit(False))
    goes = F.coalesce(F.col("some"), F.lit(False)) & (F.col("last").isNull() | (F.col("turn") < F.col("last")))
    whole = met.where(~split).select("uid", "g", "hot", F.when(goes, F.col("target")).otherwise(F.col("label")).alias("label"))
    place = F.row_number().over(Window.partitionBy(*pair).orderBy("g", "uid"))
    parted = met.where(split).withColumn("place", place).select("uid", "g", "hot", F.when(F.col("place") <= F.col("rest"), F.col("target")).otherwise(F.col("label")).alias("label"))
    return materialise(whole.unionByName(parted), "shard-labels"), moved


def propagate(member: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(uid, g, hot, label) of linked documents after at most ``rounds`` rounds, fewer if nothing moves."""
    labels = start_labels(member, shards)
    for _ in range(rounds):
        labels, moved = one_round(member, labels, rows // shards, shards)
        if not moved:
            break
    return labels


def settle(nodes: DataFrame, labels: DataFrame, rows: int, shards: int = SHARDS) -> DataFrame:
    """``nodes`` (uid, ...) with shard and slot: every shard keeps its quota of rows, the surplus fills the others."""
    buckets = min(MOST_BUCKETS, max(16, 1 << (rows // (shards * BUCKET_ROWS)).bit_length()))
    met = nodes.join(labels, "uid", "left").withColumn("label", F.coalesce("label", _start(shards)))
    kind = F.when(F.col("g").isNull(), ALONE).when(F.col("hot"), HOT).otherwise(LINKED)
    part = F.pmod(F.when(kind == LINKED, F.xxhash64("g")).otherwise(F.xxhash64("uid")), F.lit(buckets)).cast("int")
    met = materialise(met.select(*nodes.columns, "label", "g", kind.alias("kind"), part.alias("part")), "shard-ranks")
    keys = ["label", "kind", "part"]
    # at most shards * 3 * MOST_BUCKETS rows
    sizes = materialise(met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "shard-sizes")
    before = sizes.select(*keys, (F.sum("n").over(Window.partitionBy("label").orderBy("kind", "part")) - F.col("n")).alias("before"))
    held = {r["label"]: r["n"] for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    ranked = met.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("g", "uid"))).join(F.broadcast(before), keys)
    rank = F.col("before") + F.col("row") - 1
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    lead, start, home, first = 0, [], F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for s in range(shards):  # where each shard's surplus begins in the order of all surplus rows
        start.append(lead)
        lead += max(0, held.get(s, 0) - quota[s])
    lead = 0
    places = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, start[s] - quota[s])])
    index = rank + places[F.col("label")]
    for s in range(shards):
        empty = max(0, quota[s] - held.get(s, 0))
        inside = (index >= lead) & (index < lead + empty)
        home = F.when(inside, s).otherwise(home)
        first = F.when(inside, index - lead + held.get(s, 0)).otherwise(first)
        lead += empty
    stays = rank < F.create_map(*[F.lit(x) for s in range(shards) for x in (s, quota[s])])[F.col("label")]
    return ranked.select(*nodes.columns, F.when(stays, F.col("label")).otherwise(home).alias("shard"), F.when(stays, rank).otherwise(first).alias("slot"))


def shard(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, links: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; the law is ``rows``.

    Equal texts are one group; null texts are a group too (no bytes: size 1, text_crc32 0), and
    ``links`` (doc_id, grp) may add others.  A null doc_id is a document like others.  Repeated
    rows count each; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    raw = F.col("text").cast("string").cast("binary")
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint") + 1
    nodes = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("text_crc32"), F.xxhash64(F.col("text"), F.crc32(raw), size).alias("grp"))
    nodes = materialise(nodes, "shard-nodes")  # numbers of rows stay what they are from here on
    rows = nodes.count()
    labels = propagate(memberships(nodes, links), rows, shards, rounds)
    placed = settle(nodes.drop("grp"), labels, rows, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
