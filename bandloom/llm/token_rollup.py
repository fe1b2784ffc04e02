"""Token counts as rollups kept up to date by signed changes.

A batch of changes (inserts, deletes, revised counts) is summed to a delta for each
(source, lang, tokenizer).  Its folder gets its place by one rename, under a name of its own
below the batch's id; a reader takes one folder for each id, so a batch that is sent again,
or twice at the same time, counts once.  Totals are a version of the sums together with the
ids that it holds; the next version adds the deltas of batches that the last one lacks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.bounded import join_groups
from bandloom.llm.byte_bpe import token_counts
from bandloom.storage import create_new, list_dirs, make_dirs, materialise, new_path, rename

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class TokenLedger:
    """Folders ``batch-<id>/<attempt>`` with deltas, and ``totals-<number>-<attempt>`` with sums and the ids in them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _batches(self) -> dict[str, str]:
        """Batch id -> the folder that counts for it: of several attempts the first by name."""
        found = {}
        for name in list_dirs(self.spark, self.path):
            if name.startswith("batch-"):
                tries = list_dirs(self.spark, f"{self.path}/{name}")
                if tries:
                    found[name[6:]] = f"{self.path}/{name}/{tries[0]}"
        return found

    def batches(self) -> list[str]:
        return list(self._batches())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of rows (kind, source, lang, tokenizer, tokens, old_tokens) once.

        kind: insert adds tokens, delete takes them away, revise puts tokens in the place of
        old_tokens.  Null tokens count as 0; other kinds, or none, are an error when the batch
        is summed.  Null source, lang or tokenizer is a key of its own.  False: the id was
        there, and nothing happened.  An id names one content: of two different ones sent under
        it at the same time, one counts.
        """
        if batch_id in self.batches():
            return False
        kind, tokens, old = F.col("kind"), F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
        wrong = F.raise_error(F.concat(F.lit("no such kind of change: "), F.coalesce(kind, F.lit("null")))).cast("bigint")
        signed = F.when(kind == "insert", tokens).when(kind == "delete", -tokens).when(kind == "revise", tokens - old).otherwise(wrong)
        docs = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
        delta = changes.groupBy(*KEYS).agg(F.sum(docs).cast("bigint").alias("n_docs"), F.sum(signed).cast("bigint").alias("n_tokens"))
        draft = new_path(self.spark, f"draft-{batch_id}")
        delta.write.parquet(draft)
        self._place(draft, f"batch-{batch_id}", uuid.uuid4().hex)
        return True

    def _place(self, draft: str, folder: str, name: str) -> None:
        make_dirs(self.spark, f"{self.path}/{folder}")
        if not rename(self.spark, draft, f"{self.path}/{folder}/{name}"):
            raise RuntimeError(f"{draft} could not be put in place")

    def totals(self) -> DataFrame:
        """The sums of all committed batches; those the last version lacks are added on the fly."""
        return self._sums(self._batches(), *self._last())

    def _sums(self, batches: dict[str, str], done: set[str], sums: list[DataFrame]) -> DataFrame:
        """What a version holds, and the deltas of the batches that it lacks."""
        fresh = [folder for b, folder in batches.items() if b not in done]
        parts = [*sums, *([self.spark.read.schema(SUMS).parquet(*fresh)] if fresh else [])]
        if not parts:
            return self.spark.createDataFrame([], SUMS)
        rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def _versions(self) -> list[str]:
        """Folder names of the versions, the last one first."""
        return sorted(list_dirs(self.spark, f"{self.path}/totals"), key=lambda d: (-int(d.split("-")[0]), d))

    def _last(self) -> tuple[set[str], list[DataFrame]]:
        """(ids, sums) of the last version: both of one folder, found by one listing."""
        versions = self._versions()
        if not versions:
            return set(), []
        top = f"{self.path}/totals/{versions[0]}"
        done = {r["batch_id"] for r in self.spark.read.schema("batch_id string").parquet(f"{top}/ids").collect()}
        return done, [self.spark.read.schema(SUMS).parquet(f"{top}/sums")]

    def _number(self) -> int:
        """A version number above all others, claimed by a file that only one caller can make."""
        number = 1 + max([0, *(int(d.split("-")[0]) for d in self._versions())])
        make_dirs(self.spark, f"{self.path}/claims")
        while not create_new(self.spark, f"{self.path}/claims/{number:09d}"):
            number += 1
        return number

    def refresh(self) -> None:
        """Write the next version of the totals: of the batches that are there now, and of no later one.

        The last version is read once; its ids and its sums go on together.  Versions that are written
        at the same time have numbers of their own, and each holds the sums of just its ids, so that it
        makes no difference which one later readers start from.
        """
        done, sums = self._last()
        batches = self._batches()
        draft = new_path(self.spark, "draft-totals")
        self._sums(batches, done, sums).write.parquet(f"{draft}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(done | set(batches))], "batch_id string").coalesce(1).write.parquet(f"{draft}/ids")
        self._place(draft, "totals", f"{self._number():09d}-{uuid.uuid4().hex}")


def counts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, lang, grp, utf8, n_tokens) of each row; a null text has no tokens and no bytes."""
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", "text", "source", "lang", F.sha2(text, 256).alias("grp"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("utf8"))
    return token_counts(rows, carry=["source", "lang", "grp", "utf8"])


def changes(rows: DataFrame, kind: str, tokenizers: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows for ``TokenLedger.commit``: for each tokenizer its new and its old count."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), new.alias("tokens"), old.alias("old_tokens")) for t, (new, old) in tokenizers.items()]))
    return rows.select("source", "lang", each.alias("e")).select(F.lit(kind).alias("kind"), "source", "lang", "e.tokenizer", "e.tokens", "e.old_tokens")


BPE, BYTES = "byte_bpe_multi_50k", "utf8_bytes"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens after four commits of changes.

    All documents are inserted with their byte-level BPE tokens and their bytes; BPE counts are
    revised by the end-of-text token of each document; later copies of a text are deleted; and
    the second batch is sent again, without effect.  Of rows with equal texts the one with the
    least doc_id stays, and all that share it; a copy with a null doc_id stays too.  Null texts
    are no copies and count no bytes and one token; null source and lang are keys of their own.
    An empty table gives no rows.
    """
    rows = materialise(counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-counts")
    ledger = TokenLedger(spark, new_path(spark, "token-ledger"))
    none = F.lit(0).cast("bigint")
    tokens, utf8 = F.col("n_tokens"), F.col("utf8")
    ledger.commit("0001-load", changes(rows, "insert", {BPE: (tokens, none), BYTES: (utf8, none)}))
    ledger.refresh()
    revision = changes(rows, "revise", {BPE: (tokens + 1, tokens)})
    ledger.commit("0002-end-of-text", revision)
    first = rows.where("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = join_groups(rows, materialise(first, "token-groups"), ["grp"], "n").where("doc_id > first")
    ledger.commit("0003-copies", changes(copies, "delete", {BPE: (tokens + 1, none), BYTES: (utf8, none)}))
    ledger.refresh()
    ledger.commit("0002-end-of-text", revision)
    return ledger.totals()
