"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

1. Lines get two independent 64-bit hashes.  Of every window of ``run`` lines the least first
   hash is selected (the rightmost of equal ones), so that any repeated run of that many lines
   has a selected fingerprint in common.  A line that is a run by its length is a fingerprint
   itself, and windows of nothing but such lines need no other.
2. Positions of fingerprints meet by hash; those of hashes that stand at one place are put
   aside, by a filter of bounded size.  Each position left joins the first place, in
   (doc_id, line) order, of its fingerprint.
3. The match is extended line by line to both sides, up to the reach of the fingerprint's
   windows; what lies beyond is reached from the next fingerprint, so long matches join up.
4. Windows of a fingerprint that the match with its first place does not cover stand there in
   another context.  They alone meet once more, each with the first place of that window.
5. The lines of later runs are deleted.

With ``words`` a single line of that many words is a run of its own, and so is a document of
one line, whatever its length, among such documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.bounded import join_groups, split_by_ids
from bandloom.storage import materialise

RUN = 2
#: Words of a line that counts as a run by itself, in the query and the pipeline.
WORDS = 5
#: Kinds of fingerprints.
LINE, SINGLE, WHOLE = 0, 1, 2
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _second(x: Column) -> Column:
    """A hash that doesn't depend on ``xxhash64`` of the same value: the salt comes first and seeds it."""
    return F.xxhash64(F.lit("second"), x)


def fingerprints(documents: DataFrame, run: int = RUN, words: int | None = None, context: bool = True) -> DataFrame:
    """(doc_id, pos, kind, fp, check): the selected lines of each document, told by two hashes.

    kind is ``LINE``, ``SINGLE`` for a line that is a run by its length (the two meet), or
    ``WHOLE`` for a short line that is its document (these meet each other).  With ``context``
    also around, the first lines of the windows of which the line is the minimum, and before and
    after, the hashes of the ``run`` - 1 lines to both sides, the nearest first.
    """
    h, n = F.col("h"), F.size("h")
    lines = _lines(F.col("text"))
    rows = documents.where("doc_id is not null and text is not null")
    if words is None:
        rows = rows.where(F.size(lines) >= run)
    long = lambda x: F.regexp_count(x, F.lit(WORD)) >= words if words is not None else F.lit(False)
    rows = rows.select("doc_id", F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), F.transform(lines, _second).alias("g"), F.transform(lines, long).alias("long"), (F.col("text") != "").alias("filled"))
    none = F.array().cast("array<int>")

    def lowest(start: Column) -> Column:
        part = F.slice(h, start + 1, run)
        short = F.exists(F.slice("long", start + 1, run), lambda x: ~x)
        return F.when(short, start + run - F.array_position(F.reverse(part), F.array_min(part))).otherwise(-1).cast("int")

    starts = F.when(n >= run, F.sequence(F.lit(0), n - run)).otherwise(none)
    rows = rows.withColumn("low", F.transform(starts, lowest))
    picked = F.filter("low", lambda i: i >= 0)
    if words is not None:
        alone = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("long"), i) | (n == 1) & F.col("filled"))
        picked = F.concat(picked, alone)
    rows = rows.withColumn("picked", F.array_distinct(picked))

    def side(first: Column, size: Column) -> Column:
        return F.arrays_zip(F.slice(h, first, size).alias("h"), F.slice("g", first, size).alias("g"))

    def mark(i: Column) -> Column:
        kind = F.when(F.get(F.col("long"), i), SINGLE).when(n == 1, WHOLE).otherwise(LINE)
        parts = [i.alias("pos"), kind.alias("kind"), F.get(h, i).alias("fp"), F.get(F.col("g"), i).alias("check")]
        if context:
            first, last = F.greatest(F.lit(0), i - run + 1), F.least(i, n - run)
            own = F.when(last >= first, F.filter(F.sequence(first, last), lambda s: F.get(F.col("low"), s) == i)).otherwise(none)
            parts += [F.transform(own, lambda s: F.struct(s.alias("pos"))).alias("around"), F.reverse(side(first + 1, i - first)).alias("before"), side(i + 2, F.lit(run - 1)).alias("after")]
        return F.struct(*parts)

    return rows.select("doc_id", F.explode(F.transform("picked", mark)).alias("e")).select("doc_id", "e.*")


def _in_common(a: Column, b: Column) -> Column:
    """How many entries two arrays share from their start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def matches(documents: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, pos, size, rest): each later fingerprint's match with the first place of it, extended to both sides.

    size is 0 where the match is no run; rest holds (pos, k1, k2), first line and 128 bits, of the
    fingerprint's windows that the match does not cover.
    """
    ids = ["apart", "fp", "check"]
    apart = (F.col("kind") == WHOLE).alias("apart")
    places = fingerprints(documents, run, words, context=False).groupBy(apart, "fp", "check")
    places = places.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("doc_id", "pos")])
    several = materialise(places.where("min_doc_id <> max_doc_id or min_pos <> max_pos").select("fp"), "line-fingerprints")
    _, met = split_by_ids(fingerprints(documents, run, words), several, "fp")
    met = materialise(met.withColumn("apart", apart), "line-positions")
    first = met.groupBy(*ids).agg(F.min(F.struct("doc_id", "pos", "before", "after")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = join_groups(met, materialise(first, "line-first-places"), ids, "n").where(F.struct("doc_id", "pos") != F.struct("first.doc_id", "first.pos"))
    pos, left, right = F.col("pos"), F.col("left"), F.col("right")
    later = later.withColumn("left", _in_common(F.col("before"), F.col("first.before"))).withColumn("right", _in_common(F.col("after"), F.col("first.after")))
    long_enough = left + right + 1 >= run
    start = F.when(long_enough, pos - left).otherwise(pos)
    size = F.when(long_enough, left + right + 1).when(F.col("kind") != LINE, 1).otherwise(0)

    def window(s: Column) -> Column:
        own = F.array(F.struct(F.col("fp").alias("h"), F.col("check").alias("g")))
        held = F.concat(F.reverse(F.slice("before", 1, pos - s)), own, F.slice("after", 1, s + run - 1 - pos))
        return F.struct(s.alias("pos"), F.xxhash64(F.transform(held, lambda x: x["h"])).alias("k1"), _second(F.transform(held, lambda x: x["g"])).alias("k2"))

    beyond = F.filter("around", lambda w: (w["pos"] < pos - left) | (w["pos"] + run - 1 > pos + right))
    # a name of its own: in a lambda an alias of the same select would go before the column
    later = later.select("doc_id", start.alias("start"), size.alias("size"), F.transform(beyond, lambda w: window(w["pos"])).alias("rest"))
    return later.withColumnRenamed("start", "pos")


def repeated_windows(documents: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, pos, size) of the runs of lines that occur earlier in (doc_id, pos) order."""
    place, keys = F.struct("doc_id", "pos"), ["k1", "k2"]
    found = materialise(matches(documents, run, words), "line-matches")
    rest = found.select("doc_id", F.explode("rest").alias("w")).select("doc_id", "w.*")
    first = rest.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = join_groups(rest, materialise(first, "line-first-windows"), keys, "n").where(place != F.col("first"))
    return found.where("size > 0").select("doc_id", "pos", "size").union(later.select("doc_id", "pos", F.lit(run)))


def deduplicate(documents: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """The columns of ``documents`` (doc_id, text, ...) with later repeated runs of lines cut from text.

    Adds _lines and _removed, numbers of lines (columns of these names are replaced).  A line is
    what stands between line feeds; an empty text is one empty line, a null text none, and stays
    null.  Rows with a null doc_id are kept whole and are no source.  Repeated rows are one
    document: they lose the same lines.  Texts with fewer than ``run`` lines lose none.  An empty
    table gives no rows.

    With ``words``, later copies of a single line of at least that many words go too, and
    later copies of a document of one line that is not empty.
    """
    base = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flagged = repeated_windows(base, run, words)
    places = materialise(flagged.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "size")).alias("at")), "line-repeats")
    plain = [c for c in documents.columns if c not in ("_lines", "_removed")]
    whole, cut = split_by_ids(documents.select(*plain), places.select("doc_id"))
    count = lambda text: F.when(text.isNull(), 0).otherwise(F.coalesce(F.size(_lines(text)), F.lit(0)))
    whole = whole.withColumn("_lines", count(F.col("text"))).withColumn("_removed", F.lit(0))
    places = places.select(F.col("doc_id").alias("id"), "at")
    # never a broadcast, however small: its plan is that of large tables, whose places no task could hold
    met = cut.select(F.struct("*").alias("row")).join(places.hint("merge"), F.col("row.doc_id").cast("bigint") == F.col("id"), "left")
    text = F.col("row.text").cast("string")
    gone = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p["pos"], p["pos"] + p["size"] - 1))))
    met = met.select("row", count(text).alias("n"), gone.alias("gone"), _lines(text).alias("all"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("all"), i)), "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    met = met.select(*[left.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in plain], F.col("n").alias("_lines"), removed.alias("_removed"))
    return whole.unionByName(met)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicate(documents, words=WORDS)
    return out.select("doc_id", F.col("_lines").cast("bigint").alias("n_lines"), F.col("_removed").cast("bigint").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, a, unnest(range(0, len(a) - 1)) AS pos FROM l WHERE len(a) >= 2
), x AS (
  SELECT doc_id, len(a) AS n, unnest(a) AS line, unnest(range(0, len(a))) AS pos FROM l
), k AS (
  SELECT doc_id, pos, 2 AS size, 'run' AS kind, md5(a[pos + 1] || chr(10) || a[pos + 2]) AS key FROM w
  UNION ALL
  SELECT doc_id, pos, 1, 'single', md5(line) FROM x WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5
  UNION ALL
  SELECT doc_id, pos, 1, 'whole', md5(line) FROM x WHERE n = 1 AND line <> ''
), f AS (
  SELECT doc_id, pos, size, row_number() OVER (PARTITION BY kind, key ORDER BY doc_id, pos) AS nth FROM k
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM f WHERE nth > 1
), s AS (
  SELECT x.doc_id, any_value(x.n) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN x.line END, chr(10) ORDER BY x.pos), '') AS kept
  FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
