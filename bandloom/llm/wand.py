"""Ranked lexical search by WAND over document shards.

1. Tasks turn their documents into shards, inverted indexes of a bounded number of postings:
   documents in doc_id order, and for each term its documents and its occurrences in them.
   The shards are a stored table.  Only terms of the queries are indexed, unless these are
   too many to be sent to the tasks; then all terms are.
2. Document frequencies and lengths are summed over all shards and give the terms' weights.
3. A task searches a shard for all queries of a block in step.  Each query has a cursor in
   the postings of each of its terms and a heap of its best documents.  With the cursors in
   document order, the greatest impacts of the terms (their maxima in the shard) are added up
   until they beat the least score of the heap: there stands the pivot.  Cursors before it
   move up to it, and it is scored only if the terms that stand at it can still beat the heap.
4. The heaps of all shards are merged, each task's beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandloom.llm.runs import pack, unpack
from bandloom.llm.textarrays import Words, flat, slices, tidy
from bandloom.storage import materialise

BEST = 10
#: A shard is closed at so many postings or documents.
POSTINGS, DOCUMENTS = 1 << 19, 1 << 14
#: Query terms that are sent to the tasks as a whole (8 bytes each), and query-term pairs of a block (16 bytes each).
MOST_TERMS, MOST_PAIRS = 1 << 20, 1 << 20
#: Cursors that move in step in one array.
CURSORS = 1 << 20

_separators = np.zeros(256, bool)
_separators[:0x80] = True
_separators[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_FAR = np.int64(1) << 40


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, the first term of each text and a last entry)."""
    words = Words(*flat(column), _separators)
    return words.hashes(lower=True), words.first


class _Shard:
    """Documents of a task until there are enough for a shard."""

    def __init__(self):
        self.ids, self.lengths, self.owner, self.term, self.times = [], [], [], [], []
        self.documents = self.postings = self.n_docs = self.n_terms = 0

    def add(self, ids: pa.Array, texts: pa.Array, vocabulary: np.ndarray | None) -> None:
        hashes, first = _terms(texts)
        length = np.diff(first)
        self.n_docs += int((length > 0).sum())
        self.n_terms += len(hashes)
        owner = np.repeat(np.arange(len(length)), length)
        if vocabulary is None:
            known, number = np.unique(hashes, return_inverse=True)
        else:
            known, number = vocabulary, np.searchsorted(vocabulary, hashes)
            hit = vocabulary[np.minimum(number, len(vocabulary) - 1)] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            number, owner = number[hit], owner[hit]
        pair, times = np.unique(owner.astype(np.int64) << 32 | number.astype(np.int64), return_counts=True)
        held, place = np.unique(pair >> 32, return_inverse=True)
        self.ids.append(ids.take(pa.array(held)))
        self.lengths.append(length[held].astype(np.int64))
        self.owner.append(place + self.documents)
        self.term.append(known[pair & 0xFFFFFFFF])
        self.times.append(times.astype(np.int32))
        self.documents += len(held)
        self.postings += len(pair)

    def close(self) -> dict:
        ids = pa.concat_arrays(self.ids)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        order = np.lexsort((number, null))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        doc, term, times = rank[np.concatenate(self.owner)], np.concatenate(self.term), np.concatenate(self.times)
        by_term = np.lexsort((doc, term))
        doc, term, times = doc[by_term], term[by_term], times[by_term]
        terms, start = np.unique(term, return_index=True)
        sizes = np.diff(np.append(start, len(term))).astype(np.int32)
        documents = [number[order], np.concatenate(self.lengths)[order], null[order].astype(np.uint8)]
        row = {"n_docs": self.n_docs, "n_terms": self.n_terms, "documents": pack(documents), "terms": pack([terms, sizes]), "postings": pack([doc, times])}
        self.__init__()
        return row


def build_shards(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """(n_docs, n_terms, documents, terms, postings): a stored table with a row for each shard.

    n_docs and n_terms count all documents with a term and all their terms, whatever the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for part in slices(batch, "text"):
                shard.add(part.column(0), part.column(1), vocabulary)
                if shard.postings >= POSTINGS or shard.documents >= DOCUMENTS:
                    yield pa.RecordBatch.from_pylist([shard.close()], schema)
        if shard.n_docs:
            yield pa.RecordBatch.from_pylist([shard.close()], schema)

    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("documents", pa.binary()), ("terms", pa.binary()), ("postings", pa.binary())])
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return materialise(rows.mapInArrow(tidy(run), "n_docs bigint, n_terms bigint, documents binary, terms binary, postings binary"), "search-shards")


def frequencies(shards: DataFrame) -> DataFrame:
    """(term, df): the documents that hold each indexed term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                terms, sizes = unpack(data.as_py())
                yield pa.record_batch({"term": pa.array(terms.view(np.int64)), "df": pa.array(sizes.astype(np.int64))})

    return shards.select("terms").mapInArrow(tidy(run), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(items: DataFrame) -> DataFrame:
    """(query, item_id, term): a stored table of each item's different terms; every row of ``items`` is a query of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = _terms(part.column(2))
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                own = pa.array(owner[new])
                yield pa.record_batch({"query": part.column(0).take(own), "item_id": part.column(1).take(own), "term": pa.array(hashes[new].view(np.int64))})

    rows = items.select(F.monotonically_increasing_id().alias("query"), items["item_id"].cast("bigint").alias("item_id"), items["text"].cast("string").alias("text"))
    return materialise(rows.mapInArrow(tidy(run), "query bigint, item_id bigint, term bigint"), "search-queries")


def weight(df: int, n: int) -> int:
    """A term's weight from its document frequency among ``n`` documents."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class _Index:
    """One shard with the impacts of its postings, before weights."""

    def __init__(self, row: dict, n: int, length: int):
        self.ids, lengths, self.null = unpack(row["documents"])
        self.terms, sizes = unpack(row["terms"])
        self.doc, times = unpack(row["postings"])
        sizes = sizes.astype(np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        tf = times.astype(np.int64)
        norm = 10 + 90 * lengths * n // length
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[self.doc])
        self.most = np.maximum.reduceat(self.impact, self.start) if len(sizes) else np.zeros(0, np.int64)
        self.key = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32 | self.doc

    def place(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first posting of each term at the document or after it; the term's end if there is none."""
        return np.searchsorted(self.key, term << 32 | doc)


def _search(index: _Index, term: np.ndarray, weights: np.ndarray, first: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the best documents of each query.

    The terms (numbers in the index) and weights of query q lie at first[q] to first[q + 1].
    """
    lanes = np.flatnonzero(np.diff(first) > 0)
    found = ([], [], [])
    width = np.diff(first)[lanes]
    lanes = lanes[np.argsort(width, kind="stable")]
    at = 0
    while at < len(lanes):  # queries of about as many terms, in arrays of bounded size
        wide = np.diff(first)[lanes[at:]]
        take = max(1, int(np.searchsorted(wide * np.arange(1, len(wide) + 1), CURSORS, "right")))
        for out, part in zip(found, _search_together(index, term, weights, first, lanes[at : at + take], best), strict=True):
            out.append(part)
        at += take
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _search_together(index: _Index, term: np.ndarray, weights: np.ndarray, first: np.ndarray, query: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(first)[query]
    column = np.arange(int(size.max()))
    used = column[None] < size[:, None]
    flat_place = np.where(used, first[query][:, None] + column[None], 0)
    t = np.where(used, term[flat_place], 0)
    w = np.where(used, weights[flat_place], 0)
    cursor, end = np.where(used, index.start[t], 0), np.where(used, index.end[t], 0)
    doc = np.where(used, index.doc[np.minimum(cursor, len(index.doc) - 1)].astype(np.int64), _FAR)
    most = w * np.where(used, index.most[t], 0)
    top, kept = np.zeros((len(query), best), np.int64), np.full((len(query), best), -1, np.int64)
    out: tuple[list, list, list] = ([], [], [])
    while len(query):
        order = np.argsort(doc, axis=1)
        bound = np.cumsum(np.take_along_axis(most, order, 1), axis=1)
        beats = bound > top[:, -1:]
        at = beats.argmax(axis=1)
        row = np.arange(len(query))
        pivot = doc[row, order[row, at]]
        over = ~beats[:, -1] | (pivot >= _FAR)
        if over.any():
            r, c = np.nonzero(over[:, None] & (top > 0))
            for part, values in zip(out, (query[r], kept[r, c], top[r, c]), strict=True):
                part.append(values)
            go = ~over
            query, t, w, cursor, end, doc, most, top, kept, pivot = (x[go] for x in (query, t, w, cursor, end, doc, most, top, kept, pivot))
            if not len(query):
                break
        r, c = np.nonzero(doc < pivot[:, None])  # cursors before the pivot move up to it
        if len(r):
            moved = index.place(t[r, c], pivot[r])
            cursor[r, c] = moved
            doc[r, c] = np.where(moved < end[r, c], index.doc[np.minimum(moved, len(index.doc) - 1)], _FAR)
        here = doc == pivot[:, None]
        hopeful = np.flatnonzero((most * here).sum(axis=1) > top[:, -1])
        if len(hopeful):
            mine = here[hopeful]
            score = (np.where(mine, w[hopeful], 0) * index.impact[np.where(mine, cursor[hopeful], 0)]).sum(axis=1)
            won = score > top[hopeful, -1]
            lane = hopeful[won]
            if len(lane):
                scores = np.concatenate([top[lane], score[won][:, None]], axis=1)
                docs = np.concatenate([kept[lane], pivot[lane][:, None]], axis=1)
                first_best = np.argsort(-scores, axis=1, kind="stable")[:, :best]  # equal scores: the earlier document
                top[lane], kept[lane] = np.take_along_axis(scores, first_best, 1), np.take_along_axis(docs, first_best, 1)
        r, c = np.nonzero(here)
        cursor[r, c] += 1
        moved = cursor[r, c]
        doc[r, c] = np.where(moved < end[r, c], index.doc[np.minimum(moved, len(index.doc) - 1)], _FAR)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _heaps(shards: DataFrame, queries: list, n: int, length: int, best: int) -> DataFrame:
    """(query, item_id, doc_id, score): the best documents of each shard for the queries (query, item_id, term, weight)."""
    query = np.array([r[0] for r in queries], np.int64)
    order = np.argsort(query, kind="stable")
    items = pa.array([r[1] for r in queries], pa.int64()).take(pa.array(order))
    terms = np.array([r[2] for r in queries], np.int64).view(np.uint64)[order]
    weights = np.array([r[3] for r in queries], np.int64)[order]
    query = query[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                index = _Index(row, n, length)
                number = np.searchsorted(index.terms, terms)
                hit = np.flatnonzero(index.terms[np.minimum(number, len(index.terms) - 1)] == terms) if len(index.terms) else np.zeros(0, np.int64)
                if not len(hit):
                    continue
                own, start = np.unique(query[hit], return_index=True)
                q, doc, score = _search(index, number[hit].astype(np.int64), weights[hit], np.append(start, len(hit)), best)
                yield pa.record_batch(
                    {
                        "query": pa.array(own[q]),
                        "item_id": items.take(pa.array(hit[start][q])),
                        "doc_id": pa.array(index.ids[doc], mask=index.null[doc].astype(bool)),
                        "score": pa.array(score),
                    }
                )

    return shards.select("documents", "terms", "postings").mapInArrow(tidy(run), "query bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents (doc_id, text) with a score above 0 for each item (item_id, text).

    A null text has no terms; such a document counts nowhere, and such an item finds nothing.  Each row
    of ``docs`` is a document of its own and each row of ``items`` a query of its own, so that repeated rows
    give repeated results.  Of equal scores the smaller doc_id comes first, a null doc_id last.  Texts are
    indexed whole, whatever their length.  Other columns are not read; empty tables give no rows.
    """
    wanted = query_terms(items)
    pairs = wanted.count()
    spark = docs.sparkSession
    distinct = wanted.select("term").distinct()
    vocabulary = None
    if distinct.count() <= MOST_TERMS:
        vocabulary = np.sort(np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64))
    shards = build_shards(docs, vocabulary)
    totals = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, length = int(totals[0] or 0), int(totals[1] or 0)
    if not pairs or not length:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    blocks = -(-pairs // MOST_PAIRS)
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    known = materialise(wanted.join(frequencies(shards), "term").select("query", "item_id", "term", "df", block.alias("block")), "search-weights")
    found = None
    for b in range(blocks):
        rows = [(r[0], r[1], r[2], weight(r[3], n)) for r in known.where(F.col("block") == b).select("query", "item_id", "term", "df").collect()]
        if rows:
            heaps = _heaps(shards, rows, n, length, best)
            found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH a AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM a),
z AS (SELECT count(*)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM e WHERE len(ts) > 0),
p AS (SELECT doc_id, any_value(len(ts)) AS size, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM e) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN f USING (term), z),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // l))))::BIGINT AS score FROM w JOIN p USING (term), z GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
