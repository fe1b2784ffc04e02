"""Substring deduplication with a log-structured fingerprint index.

The index holds sorted immutable runs: for a range of 64-bit window hashes (a bucket) the
sorted hashes with the least document and place where each window starts.  A run is a
table bucketed by that range, so that runs are merge-joined without a shuffle.

1. Tasks sort the window hashes of a batch and deal them out by bucket; what repeats within
   a task is settled there: the first place goes to the window's bucket, and reports of the
   others go, as rows of their own, to the bucket of their document.
2. A bucket's parts become the batch's run; windows whose hash is in the run under a smaller
   document are reported, and each older run is merge-joined with the new one.
3. Reported windows of a document become ranges (place, windows, source, place there).
   Ranges are verified: digests of the words themselves, cut at every ``BLOCK`` words of the
   source, are compared with those of the source's text.  Where one differs two windows had
   one hash, and the documents concerned are decided anew by their windows' words.
4. Runs of one level are compacted to one of the next level, as in a binary counter.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.bounded import split_by_ids
from bandloom.llm.runs import pack, unpack
from bandloom.llm.textarrays import Words, flat, gram_places, grams, mix, slices, tidy
from bandloom.storage import create_new, exists, list_dirs, make_dirs, materialise, new_path, read_bytes, release, remove, text_bytes, write_bytes

WINDOW = 13
FLUSH = 700_000
#: Bytes of text for a bucket at most; so a bucket has a million windows, whatever the size of the input.
BUCKET_BYTES = 6 << 20
#: Parquet's writer holds a row group, so that it should be small.
BLOCK_BYTES = 16 << 20
#: A task deals windows out to at most 2**LEVEL buckets; finer ones are reached in more steps.
LEVEL = 14
#: Words in a verified piece of a source.
BLOCK = 64
#: Batches of a table that comes as a whole: two runs of level 0 are compacted, the third stays.
BATCHES = 3
#: What an index is like unless it is told otherwise.
SHAPE = {"window": WINDOW, "bits": 5, "hash_bits": 64}
RUN_SCHEMA = "bucket int, run binary, flags binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _joined(parts: list, dtypes: tuple) -> list[np.ndarray]:
    """The columns of packed parts, one after the other."""
    columns = [unpack(p) for p in parts if p is not None]
    return [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [np.zeros(0, t) for t in dtypes]


_RUN = (np.uint64, np.int64, np.int32)
_FLAG = (np.int64, np.int32, np.int64, np.int32)


def _in_order(keys: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The columns by (key, doc, pos), and where each entry's key starts."""
    if np.any(docs[1:] < docs[:-1]) or np.any((docs[1:] == docs[:-1]) & (pos[1:] < pos[:-1])):
        order = np.lexsort((pos, docs))
        keys, docs, pos = keys[order], docs[order], pos[order]
    order = np.argsort(keys, kind="stable")
    keys, docs, pos = keys[order], docs[order], pos[order]
    fresh = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return keys, docs, pos, np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))


def _by_bucket(keys: np.ndarray, docs: np.ndarray, pos: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, run, no flags) of sorted columns."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for group in itertools.batched((b for b in range(1 << bits) if edges[b] < edges[b + 1]), 64):
        cuts = [slice(edges[b], edges[b + 1]) for b in group]
        yield pa.record_batch({"bucket": pa.array(group, pa.int32()), "run": pa.array([pack([keys[s], docs[s], pos[s]]) for s in cuts], pa.binary()), "flags": pa.nulls(len(group), pa.binary())})


def _home(docs: np.ndarray, bits: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)


def _by_document(flags: list[np.ndarray], bits: int) -> tuple[np.ndarray, list[bytes]]:
    """(homes, packed flags): flags dealt out evenly by a hash of their document, those of a home in order."""
    home = _home(flags[0], bits)
    order = np.lexsort((flags[1], flags[0], home))
    home, flags = home[order], [f[order] for f in flags]
    full, start = np.unique(home, return_index=True)
    ends = np.append(start, len(home))
    return full, [pack([f[a:b] for f in flags]) for a, b in itertools.pairwise(ends.tolist())]


def _flag_rows(flags: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, no run, flags), the bucket by document."""
    if len(flags[0]):
        full, packed = _by_document(flags, bits)
        yield pa.record_batch({"bucket": pa.array(full, pa.int32()), "run": pa.nulls(len(full), pa.binary()), "flags": pa.array(packed, pa.binary())})


def _settle(keys: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(run, flags): entries of the least document of each hash in order, and the rest as (doc, pos, source, place there)."""
    keys, docs, pos, start = _in_order(keys, docs, pos)
    later = docs > docs[start]
    return [keys[~later], docs[~later], pos[~later]], [docs[later], pos[later], docs[start][later], pos[start][later]]


def window_hashes(text: pa.Array, window: int, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, place in the text) of every window; only the first ``hash_bits`` of a hash are set."""
    w = Words(*flat(text))
    owner, at = gram_places(w.first, window)
    key = grams(w.hashes(), window)[at] if len(at) else np.zeros(0, np.uint64)
    return key >> np.uint64(64 - hash_bits) << np.uint64(64 - hash_bits), owner, (at - w.first[:-1][owner]).astype(np.int32)


def _sorted_by_doc(flags: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(flags[0], kind="stable")
    return [f[order] for f in flags]


def window_runs(documents: DataFrame, window: int, bits: int, hash_bits: int = 64) -> DataFrame:
    """(bucket, run, flags): sorted runs of all windows of the documents, by bucket."""
    near = min(bits, LEVEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def seal():
            kept, flags = _settle(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield from _by_bucket(*kept, near)
            yield from _flag_rows(flags, near)

        for batch in batches:
            for part in slices(batch, "text"):
                key, owner, pos = window_hashes(part.column(1), window, hash_bits)
                if len(key):
                    parts.append((key, part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[owner], pos))
                    held += len(key)
                if held >= FLUSH:
                    yield from seal()
                    parts, held = [], 0
        if parts:
            yield from seal()

    def finer(have: int):
        def run_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs, flags, held = [], [], 0

            def deal():
                yield from _by_bucket(*_in_order(*_joined(runs, _RUN))[:3], have)
                yield from _flag_rows(_joined(flags, _FLAG), have)

            for batch in batches:
                for r, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    runs.append(r)
                    flags.append(f)
                    held += len(r or f) // 8
                    if held >= FLUSH:
                        yield from deal()
                        runs, flags, held = [], [], 0
            yield from deal()

        return run_finer

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), RUN_SCHEMA)
    while near < bits:
        coarse, near = near, min(bits, near + LEVEL)
        rows = rows.repartition(1 << coarse, "bucket").mapInArrow(tidy(finer(near)), RUN_SCHEMA)
    return rows


def _merge_batch(table: pa.Table) -> pa.Table:
    """A bucket's parts as one run, with the flags that the parts had and those that show now."""
    run, flags = _settle(*_joined(table.column("run").to_pylist(), _RUN))
    before = _joined(table.column("flags").to_pylist(), _FLAG)
    flags = _sorted_by_doc([np.concatenate(c) for c in zip(flags, before, strict=True)])
    return pa.table({"bucket": table.column("bucket")[:1], "run": pa.array([pack(run) if len(run[0]) else None], pa.binary()), "flags": pa.array([pack(flags) if len(flags[0]) else None], pa.binary())})


def _merge_join(new: pa.Table, old: pa.Table) -> pa.Table:
    """Flags of a new run's windows that an older run has under a smaller document."""
    packed = None
    if new.num_rows and old.num_rows:
        keys, docs, pos = _joined(new.column("run").to_pylist(), _RUN)
        old_keys, old_docs, old_pos = _joined(old.column("run").to_pylist(), _RUN)
        at = np.minimum(np.searchsorted(old_keys, keys), max(0, len(old_keys) - 1))
        hit = (old_keys[at] == keys) & (old_docs[at] < docs) if len(old_keys) else np.zeros(len(keys), bool)
        if hit.any():
            packed = pack(_sorted_by_doc([docs[hit], pos[hit], old_docs[at][hit], old_pos[at][hit]]))
    return pa.table({"flags": pa.array([packed], pa.binary())})


def _compact(a: pa.Table, b: pa.Table) -> pa.Table:
    """Two runs as one, with the first place of each window."""
    parts = [r for t in (a, b) for r in t.column("run").to_pylist()]
    keys, docs, pos, start = _in_order(*_joined(parts, _RUN))
    lead = np.flatnonzero(start == np.arange(len(start)))
    bucket = (a if a.num_rows else b).column("bucket")[:1]
    return pa.table({"bucket": bucket, "run": pa.array([pack([keys[lead], docs[lead], pos[lead]])], pa.binary()), "flags": pa.nulls(1, pa.binary())})


def _homes(bits: int):
    """Rows (home, flags): flags dealt out by a hash of their document."""
    bits = min(bits, LEVEL)

    def deal(flags: list[np.ndarray]) -> pa.RecordBatch:
        full, packed = _by_document(flags, bits)
        return pa.record_batch({"home": pa.array(full, pa.int32()), "flags": pa.array(packed, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(unpack(packed))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield deal([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, size = [], 0
        if held:
            yield deal([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _to_ranges(table: pa.Table) -> pa.Table:
    """(doc_id, ranges) of one home: windows next to each other whose sources are so too."""
    docs, pos, src, at = _joined(table.column("flags").to_pylist(), _FLAG)
    order = np.lexsort((at, src, pos, docs))
    docs, pos, src, at = docs[order], pos[order], src[order], at[order]
    new = np.append(True, (docs[1:] != docs[:-1]) | (pos[1:] != pos[:-1]))  # the least source of a place
    docs, pos, src, at = docs[new], pos[new], src[new], at[new]
    cut = np.append(True, (docs[1:] != docs[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (at[1:] != at[:-1] + 1))
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(docs))).astype(np.int32)
    ids, first = np.unique(docs[start], return_index=True)
    ends = np.append(first, len(start))
    ranges = [pack([pos[start[a:b]], size[a:b], src[start[a:b]], at[start[a:b]]]) for a, b in itertools.pairwise(ends.tolist())]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "ranges": pa.array(ranges, pa.binary())})


class FingerprintIndex:
    """Runs of historical window hashes: folders ``run-<number>-<level>`` in ``path``, each a bucketed table.

    ``bits`` fixes the number of buckets (2**bits) for the life of the index: about ``BUCKET_BYTES``
    of the text that is to be expected for each.  ``hash_bits`` shortens the hashes: smaller runs, but
    more documents whose ranges fail verification and are decided by their words.  This shape is stored
    beside the runs by whoever comes first; an index that is opened again takes it from there, and other
    values than the stored ones raise ValueError.  A folder counts when its writing job has committed it
    (``_SUCCESS``); others, of jobs that failed, are passed over.  One writer at a time: batches that are
    merged at once get runs of their own, but aren't compared with each other.
    """

    def __init__(self, spark: SparkSession, path: str, window: int | None = None, bits: int | None = None, hash_bits: int | None = None):
        self.spark, self.path = spark, path
        wanted = {"window": window, "bits": bits, "hash_bits": hash_bits}
        stored = read_bytes(spark, f"{path}/shape.json")
        if stored is None:
            shape = {k: SHAPE[k] if v is None else v for k, v in wanted.items()}
            write_bytes(spark, f"{path}/shape.json", json.dumps(shape).encode())
        else:
            shape = json.loads(stored)
            other = {k: v for k, v in wanted.items() if v is not None and v != shape[k]}
            if other:
                raise ValueError(f"the index in {path} has {shape}, not {other}")
        self.window, self.bits, self.hash_bits = (shape[k] for k in SHAPE)
        self.files = 1 << max(0, self.bits - 2)  # Spark's reader holds a batch of rows, here a whole file of four buckets
        self.name = f"runs_{uuid.uuid4().hex[:12]}"

    def runs(self) -> list[str]:
        return [d for d in list_dirs(self.spark, self.path) if d.startswith("run-") and exists(self.spark, f"{self.path}/{d}/_SUCCESS")]

    def _table(self, run: str) -> DataFrame:
        table = f"{self.name}_{run.replace('-', '_')}"
        place = f"{self.path}/{run}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({RUN_SCHEMA}) USING parquet CLUSTERED BY (bucket) INTO {self.files} BUCKETS LOCATION '{place}'")
        return self.spark.read.table(table)

    def _write(self, rows: DataFrame, level: int) -> str:
        number = 1 + max([0, *(int(d.split("-")[1]) for d in list_dirs(self.spark, self.path) if d.startswith("run-"))])
        make_dirs(self.spark, f"{self.path}/claims")
        while not create_new(self.spark, f"{self.path}/claims/{number:06d}"):
            number += 1
        run = f"run-{number:06d}-{level}"
        rows.write.format("parquet").bucketBy(self.files, "bucket").option("path", f"{self.path}/{run}").option("parquet.block.size", BLOCK_BYTES).saveAsTable(f"{self.name}_{run.replace('-', '_')}")
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{run.replace('-', '_')}")
        remove(self.spark, f"{self.path}/{run}")

    def merge_batch(self, documents: DataFrame) -> DataFrame:
        """(doc_id, ranges): windows of the batch whose hash starts in a smaller doc_id, in the batch or the index.

        The batch becomes a run of the index.  Documents of earlier batches are not judged again, so
        batches should come in the order of doc_id.  Ranges are by hash; ``remove_repeats`` verifies.
        """
        older = self.runs()
        rows = window_runs(documents, self.window, self.bits, self.hash_bits).repartition(self.files, "bucket")
        new = self._write(rows.groupBy("bucket").applyInArrow(tidy(_merge_batch), RUN_SCHEMA), 0)
        release(self.spark)
        own = self._table(new)
        flags = own.select("flags")
        for run in older:
            flags = flags.union(own.select("bucket", "run").groupBy("bucket").cogroup(self._table(run).select("bucket", "run").groupBy("bucket")).applyInArrow(tidy(_merge_join), "flags binary"))
        homes = flags.where("flags is not null").mapInArrow(tidy(_homes(self.bits)), "home int, flags binary")
        ranges = materialise(homes.groupBy("home").applyInArrow(tidy(_to_ranges), "doc_id bigint, ranges binary"), "substring-ranges")
        release(self.spark)
        self.compact()
        return ranges

    def compact(self) -> None:
        """Two runs of one level become a run of the next, until there are no two."""
        while True:
            by_level: dict[int, list[str]] = {}
            for run in self.runs():
                by_level.setdefault(int(run.split("-")[2]), []).append(run)
            pair = next(((level, runs[:2]) for level, runs in sorted(by_level.items()) if len(runs) > 1), None)
            if pair is None:
                return
            level, (a, b) = pair
            sides = [self._table(r).select("bucket", "run").groupBy("bucket") for r in (a, b)]
            self._write(sides[0].cogroup(sides[1]).applyInArrow(tidy(_compact), RUN_SCHEMA), level + 1)
            self._drop(a)
            self._drop(b)

    def drop(self) -> None:
        """Forget all runs."""
        for run in self.runs():
            self._drop(run)


def _kept(words: list[bytes], pos: np.ndarray, size: np.ndarray, window: int) -> list[bytes]:
    """The words outside windows ``pos`` to ``pos + size - 1``."""
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + size - 1 + window, -1)
    return list(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def _result(words: list[bytes], left: list[bytes]) -> tuple[int, int, str]:
    return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


CLAIMED = f"{RESULT}, src bigint, lo int, hi int, digest binary"
_CLAIM_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _apply(window: int):
    """For (doc_id, text, ranges): a result row, and rows that claim words lo to hi of a source by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text, ranges in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = (text or "").encode().split()
                    if ranges is None:
                        rows.append((doc_id, *_result(words, words), None, None, None, None))
                        continue
                    pos, size, src, at = unpack(ranges)
                    rows.append((doc_id, *_result(words, _kept(words, pos, size, window)), None, None, None, None))
                    for p, n, s, a in zip(pos.tolist(), size.tolist(), src.tolist(), at.tolist(), strict=True):
                        end = a + n - 1 + window
                        for k in range(a // BLOCK, (end - 1) // BLOCK + 1):
                            lo, hi = max(a, k * BLOCK), min(end, (k + 1) * BLOCK)
                            rows.append((doc_id, None, None, None, s, lo, hi, digest(words[p + lo - a : p + hi - a])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CLAIM_TYPES, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "src", "lo", "hi", "digest"])

    return run


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (src, text, claims): whether each claim holds."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for src, text, claims in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = (text or "").encode().split()
                rows += [(src, c["lo"], c["hi"], c["digest"], text is not None and digest(words[c["lo"] : c["hi"]]) == c["digest"]) for c in claims]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["src", "lo", "hi", "digest", "holds"])


def refuted_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The claims (src, lo, hi, digest) that no text of their source bears out.

    Claims are made distinct before they meet, so that a source has a bounded number for each of
    its words, however many documents copy it.
    """
    one = claims.groupBy("src", "lo", "hi", "digest").count().drop("count")
    by_source = one.groupBy("src").agg(F.collect_list(F.struct("lo", "hi", "digest")).alias("claims"))
    by_source = materialise(by_source, "substring-claims")
    _, near = split_by_ids(sources.select("doc_id", "text"), by_source.select("src"))
    met = by_source.join(near, F.col("src") == F.col("doc_id"), "left").select("src", "text", "claims")
    checked = met.mapInArrow(tidy(_check), "src bigint, lo int, hi int, digest binary, holds boolean")
    return checked.groupBy("src", "lo", "hi", "digest").agg(F.max("holds").alias("holds")).where("not holds").drop("holds")


def _spell(window: int):
    """(key, doc_id, pos, words) of every window, the words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                key, _, pos = window_hashes(part.column(1), window)
                words = (part.column(1)[0].as_py() or "").encode().split()
                for lo in range(0, len(key), 10_000):
                    some = slice(lo, min(len(key), lo + 10_000))
                    yield pa.record_batch({"key": pa.array(key[some].view(np.int64)), "doc_id": pa.array([part.column(0)[0].as_py()] * (some.stop - lo), pa.int64()), "pos": pa.array(pos[some]), "words": pa.array([b" ".join(words[p : p + window]) for p in pos[some].tolist()], pa.binary())})

    return run


def exact_ranges(some: DataFrame, everything: DataFrame, window: int) -> DataFrame:
    """(doc_id, ranges) of the documents ``some``, by the words of their windows; for the few whose hashes deceive."""
    kinds = "key bigint, doc_id bigint, pos int, words binary"
    own = materialise(some.select("doc_id", "text").mapInArrow(tidy(_spell(window)), kinds), "substring-spelled")
    keys = materialise(own.select("key").distinct(), "substring-keys")
    near = split_by_ids(everything.where("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(_spell(window)), kinds), keys, "key")[1]
    first = near.join(keys, "key", "left_semi").groupBy("words").agg(F.min("doc_id").alias("first"))
    hits = own.join(first, "words").where("doc_id > first").groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("pos"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for pos in batch.column(1).to_pylist():
                one = np.array(pos, np.int32)
                packed.append(pack([one, np.ones_like(one), np.zeros(len(one), np.int64), one]))
            yield pa.record_batch({"doc_id": batch.column(0), "ranges": pa.array(packed, pa.binary())})

    return hits.mapInArrow(tidy(ranges), "doc_id bigint, ranges binary")


def _resolve(rows: DataFrame, ranges: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """The results of ``rows`` (doc_id, text) with their ranges, each verified on the sources' words."""
    ranges = ranges.select(F.col("doc_id").alias("id"), "ranges")
    without, near = split_by_ids(rows, ranges.select("id"))
    plain = without.select("doc_id", "text", F.lit(None).cast("binary").alias("ranges")).mapInArrow(tidy(_apply(window)), CLAIMED)
    near = near.join(ranges, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "ranges")
    done = materialise(near.mapInArrow(tidy(_apply(window)), CLAIMED), "substring-applied")
    release(rows.sparkSession)
    claims = done.where("src is not null").select("doc_id", "src", "lo", "hi", "digest")
    refuted = materialise(refuted_claims(claims, sources), "substring-refuted")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    results = done.where("src is null").select(*names)
    if not refuted.isEmpty():
        doubtful = materialise(claims.join(refuted, ["src", "lo", "hi", "digest"], "left_semi").select("doc_id").distinct(), "substring-doubtful")
        some = rows.join(doubtful, "doc_id", "left_semi")
        exact = exact_ranges(some, sources, window).withColumnRenamed("doc_id", "id")
        again = some.join(exact, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "ranges")
        results = results.join(doubtful, "doc_id", "left_anti").union(again.mapInArrow(tidy(_apply(window)), CLAIMED).where("src is null").select(*names))
    return plain.select(*names).union(results)


def remove_repeats(documents: DataFrame, window: int = WINDOW, index: FingerprintIndex | None = None, history: DataFrame | None = None, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``documents``.

    A word goes when a window of ``window`` words over it also starts in a smaller doc_id.  The
    rows come to the index in ``batches`` batches by doc_id; the result doesn't depend on their
    number.  An ``index`` of earlier documents goes with ``history``, their (doc_id, text), on which
    ranges are verified.  Null text has no words.  Rows with a null doc_id are returned whole and
    are no source for others.  A doc_id names one text: repeated rows are one document, and their
    results are equal.  An empty table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = max(2, (text_bytes(rows) // BUCKET_BYTES).bit_length())
    own = index or FingerprintIndex(spark, new_path(spark, "substring-index"), window, bits)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    found = []
    for lo, hi in itertools.pairwise(edges):
        part = rows.where(F.lit(True) if lo is None else F.col("doc_id") >= lo).where(F.lit(True) if hi is None else F.col("doc_id") < hi)
        found.append(own.merge_batch(part))
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.union(more)
    known = rows if history is None else rows.union(history.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    out = _resolve(rows, ranges, known, own.window)
    if index is None:
        own.drop()
    return out


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d WHERE len(w) >= 13
), k AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos : pos + 12], ' ')) AS key FROM p
), f AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY key) AS first FROM k
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM f WHERE first < doc_id
), e AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), s AS (
  SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN e.word END, ' ' ORDER BY e.pos) AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
