"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

1. Each task hashes the word n-grams of its texts and seals sorted runs of (hash, document)
   by hash range.  Runs meet by range; an n-gram of two documents is *shared*.
2. Only shared n-grams can be in an intersection, so a document needs at least
   ceil(t * size) of them, and its shared n-grams are all that verification needs.
3. Prefix filter: with unshared n-grams first and the rest from rare to frequent, linked
   documents have a common n-gram among the first size - ceil(t * size) + 1.  Documents that
   meet in one are linked to the least of them, which gives candidate clusters.  Frequencies
   come from a table of 2**COUNTERS sums over ranges of hashes: any order that all documents
   share gives the same links, a better one smaller clusters.
4. A cluster is cut into tiles of two cells; a cell holds documents of one size band, salted
   by hash when the band is large.  Bands are so wide that linked documents lie in the same
   or in neighbouring ones.  In a tile, bit counts of hashed bitmaps bound each overlap from
   above; what may still link is intersected exactly, each pair in one tile.
5. Components of the found links give the classes.  A tile sends a spanning forest of its
   links and the number of links of each document; ``pairs`` sends the links themselves.

Documents with equal sets (128 bits of two independent hashes) are one class from the start;
copies are never compared.
No step drops or samples anything.  An n-gram that several documents of a task have goes to its
bucket once; its places go, as rows of their own, to the buckets of their documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.bounded import join_groups
from bandloom.graph import connected_components
from bandloom.llm.runs import pack, unpack
from bandloom.llm.textarrays import Words, flat, grams, mix, slices, tidy
from bandloom.storage import materialise, release, text_bytes

FLUSH = 1_000_000
#: N-grams and documents in a cell of a tile, about: 8 MB, and some two million pairs.
CELL = 1_000_000
CELL_DOCS = 2048
#: Bytes of text for a bucket at most, and the most buckets (2**LEVEL) that a task deals out to at once.
BUCKET_BYTES = 4 << 20
LEVEL = 13
#: Bits of the number of counters of n-grams, and of counters in a row on the way to their sums.
COUNTERS, COUNTER_ROW = 18, 12
#: Which pairs of a tile are compared: all, those of different sides, or all but two of side 1.
ALL, ACROSS, NOT_UPPER = 0, 1, 2


def least_overlap(a, b, num: int, den: int):
    """Least intersection for sizes a and b with den * both >= num * either."""
    return -(-(num * (a + b)) // (num + den))


def band_bounds(num: int, den: int, top: int) -> np.ndarray:
    """Lower ends of size bands: the partners of a size lie in its band or in a neighbour."""
    bounds = [1, 2]
    while bounds[-1] <= top:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * den // num + 1))
    return np.array(bounds, np.int64)


def shingle_sets(text: pa.Array, width: int) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """(sorted distinct n-gram hashes, key) of each text, A-Z folded; a shorter text is one n-gram.

    The key is 128 bits that stand for a set: a sum over each of two independent families of hashes.
    """
    w = Words(*flat(text))
    first, second = (w.hashes(lower=True, family=k) for k in (0, 1))
    g, g2 = grams(first, width, 0), grams(second, width, 1)
    for a, b in itertools.pairwise(w.first.tolist()):
        if b - a >= width:
            s, at = np.unique(g[a : b - width + 1], return_index=True)
            other = g2[a : b - width + 1][at]
        else:
            n = np.uint64(b - a)
            s, other = (grams(h[a:b], b - a, k) ^ n if b > a else h[:0] for k, h in enumerate((first, second)))
        yield s, (_signed(s.sum(dtype=np.uint64)), _signed(mix(other).sum(dtype=np.uint64)))


def _signed(x: np.uint64) -> int:
    return int(x) - (1 << 63)


def _measure(width: int):
    """Rows (doc_id, n, k1, k2): size and key of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(len(s), *key) for s, key in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "n", "k1", "k2"])

    return run


def _joined(parts: list, dtypes: tuple) -> list[np.ndarray]:
    columns = [unpack(p) for p in parts if p is not None]
    return [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [np.zeros(0, t) for t in dtypes]


_RUN, _PLACES = (np.uint64, np.int64, np.uint8), (np.uint64, np.int64)


def _by_bucket(run: list[np.ndarray], flags: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, run, flags): a run, sorted by hash, by ranges of hashes, and flags by document; never both in a row."""
    edges = np.searchsorted(run[0] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for group in itertools.batched((b for b in range(1 << bits) if edges[b] < edges[b + 1]), 64):
        runs = [pack([c[edges[b] : edges[b + 1]] for c in run]) for b in group]
        yield pa.record_batch({"bucket": pa.array(group, pa.int32()), "run": pa.array(runs, pa.binary()), "flags": pa.nulls(len(group), pa.binary())})
    if len(flags[0]):
        full, packed = _by_document(*flags, 1 << bits)
        yield pa.record_batch({"bucket": full, "run": pa.nulls(len(full), pa.binary()), "flags": packed})


def _by_document(keys: np.ndarray, docs: np.ndarray, homes: int) -> tuple[pa.Array, pa.Array]:
    """(homes, packed places of each home in order of their hash)."""
    home = _home_array(docs, homes)
    order = np.lexsort((keys, home))
    keys, docs, home = keys[order], docs[order], home[order]
    full, first = np.unique(home, return_index=True)
    ends = np.append(first, len(home)).tolist()
    return pa.array(full, pa.int32()), pa.array([pack([keys[a:b], docs[a:b]]) for a, b in itertools.pairwise(ends)], pa.binary())


def _in_order(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _runs(width: int, bits: int):
    """Rows (bucket, run, flags): sorted runs of a task's sets, and what is shared within the task."""

    def seal(sets: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([s for _, s in sets])
        docs = np.repeat(np.array([d for d, _ in sets], np.int64), [len(s) for _, s in sets])
        keys, docs = _in_order([keys, docs])
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        many = ~fresh
        many[:-1] |= ~fresh[1:]
        yield from _by_bucket([keys[fresh], docs[fresh], many[fresh].astype(np.uint8)], [keys[many], docs[many]], bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, held = [], set(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, (s, key) in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), width), strict=True):
                    if len(s) and key not in seen:
                        seen.add(key)
                        sets.append((doc_id, s))
                        held += len(s)
                if held >= FLUSH:
                    yield from seal(sets)
                    sets, seen, held = [], set(), 0
        if sets:
            yield from seal(sets)

    return run


def _finer(bits: int):
    """Runs of a task dealt out to 2**bits buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append((r, f))
                size += len(r or f) // 8
                if size >= FLUSH:
                    yield from deal(held)
                    held, size = [], 0
        if held:
            yield from deal(held)

    def deal(held: list) -> Iterator[pa.RecordBatch]:
        runs, flags = zip(*held, strict=True)
        return _by_bucket(_in_order(_joined(runs, _RUN)), _joined(flags, _PLACES), bits)

    return run


def _find_shared(table: pa.Table) -> pa.Table:
    """A row (shared) with the (n-gram, document) places of a bucket whose n-gram is in several documents."""
    keys, docs, many = _in_order(_joined(table.column("run").to_pylist(), _RUN))
    known = _joined(table.column("flags").to_pylist(), _PLACES)
    meet = np.zeros(len(keys), bool)
    meet[1:] = keys[1:] == keys[:-1]
    meet[:-1] |= meet[1:].copy()
    hit = meet & (many == 0)
    out = [np.concatenate(c) for c in zip((keys[hit], docs[hit]), known, strict=True)]
    return pa.table({"shared": pa.array([pack(_in_order(out))] if len(out[0]) else [], pa.binary())})


def _to_homes(homes: int):
    """Rows (home, shared): places dealt out by their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(unpack(packed))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)

    def deal(held: list) -> pa.RecordBatch:
        full, packed = _by_document(*(np.concatenate(c) for c in zip(*held, strict=True)), homes)
        return pa.record_batch({"home": full, "shared": packed})

    return run


def _gather_sets(num: int, den: int):
    """The live documents of one home: size and shared n-grams."""

    def gather(documents: pa.Table, shared: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n": [], "grams": []}
        if documents.num_rows and shared.num_rows:
            keys, docs = (np.concatenate(c) for c in zip(*(unpack(s) for s in shared.column("shared").to_pylist()), strict=True))
            ids, sizes = documents.column("doc_id").to_numpy(), documents.column("n").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, sizes = ids[order], sizes[order]
            known = np.isin(docs, ids)
            keys, docs = keys[known], docs[known]
            order = np.lexsort((keys, docs))
            keys, docs = keys[order], docs[order]
            for doc_id, n in zip(ids.tolist(), sizes.tolist(), strict=True):
                own = keys[np.searchsorted(docs, doc_id) : np.searchsorted(docs, doc_id, "right")]
                need = -(-num * n // den)
                if len(own) >= need:
                    out["doc_id"].append(doc_id)
                    out["n"].append(n)
                    out["grams"].append(own.tobytes())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "grams": pa.array(out["grams"], pa.binary())})

    return gather


def _counter(keys: np.ndarray, counters: int) -> np.ndarray:
    return (keys >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _count_grams(counters: int):
    """Rows (part, counts): a task's documents per counter, in rows of 2**COUNTER_ROW counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int64)
        for batch in batches:
            for part in slices(batch, "grams"):
                keys = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64)
                counts += np.bincount(_counter(keys, counters), minlength=counters)
        rows = counts.reshape(-1, 1 << COUNTER_ROW)
        full = np.flatnonzero(rows.any(1))
        yield pa.record_batch({"part": pa.array(full, pa.int32()), "counts": pa.array([rows[k].tobytes() for k in full], pa.binary())})

    return run


def _sum_counters(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << COUNTER_ROW, np.int64)
    for packed in table.column("counts").to_pylist():
        total += np.frombuffer(packed, np.int64)
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _frequencies(live: DataFrame) -> np.ndarray:
    """Documents per counter; the driver gets 2**COUNTERS sums, whatever the input."""
    summed = live.select("grams").mapInArrow(tidy(_count_grams(1 << COUNTERS)), "part int, counts binary").groupBy("part").applyInArrow(tidy(_sum_counters), "part int, counts binary")
    total = np.zeros((1 << (COUNTERS - COUNTER_ROW), 1 << COUNTER_ROW), np.int64)
    for row in summed.collect():
        total[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return total.reshape(-1)


def _prefixes(counts: np.ndarray, num: int, den: int):
    """Rows (doc_id, n, gram): the n-grams of each document's prefix, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "grams"):
                ids, sizes, rows = [], [], []
                for doc_id, n, packed in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = np.frombuffer(packed, np.uint64)
                    keep = len(own) - -(-num * n // den) + 1
                    rows.append(own[np.lexsort((own, counts[_counter(own, len(counts))]))[:keep]])
                    ids.append(doc_id)
                    sizes.append(n)
                if rows:
                    times = [len(r) for r in rows]
                    ids, sizes = (np.repeat(np.array(c, np.int64), times) for c in (ids, sizes))
                    yield pa.record_batch({"doc_id": ids, "n": sizes, "gram": np.concatenate(rows).view(np.int64)})

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k


def tile_links(ids: np.ndarray, sizes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int, pairs: int = ALL) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, others, overlaps): all links among the wanted pairs of one tile, each once, by place in ``ids``."""
    order = np.lexsort((ids, sizes))
    sizes, side, sets = sizes[order], side[order], [sets[k] for k in order]
    bits = 1 << int(np.clip(np.ceil(np.log2(max(int(sizes.max()), 1) * 4)), 8, 14))
    maps = np.zeros((len(sets), bits // 8), np.uint8)
    for k, s in enumerate(sets):
        row = np.zeros(bits, bool)
        row[(s >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
        maps[k] = np.packbits(row)
    words = maps.view(np.uint64)
    lengths = np.array([len(s) for s in sets])
    pop = lengths - np.bitwise_count(words).sum(1, dtype=np.int64)  # n-grams that share a bit with another
    values, flat_codes = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.append(0, np.cumsum(lengths))
    mark = np.zeros(len(values), np.uint8)
    for k in range(len(sets) - 1):
        stop = int(np.searchsorted(sizes, sizes[k] * den // num, "right"))
        if stop <= k + 1:
            continue
        common = np.bitwise_count(words[k + 1 : stop] & words[k]).sum(1, dtype=np.int64)
        need = least_overlap(sizes[k], sizes[k + 1 : stop], num, den)
        bound = np.minimum(common + pop[k], common + pop[k + 1 : stop])
        may = bound >= need
        if pairs == ACROSS:
            may &= side[k + 1 : stop] != side[k]
        elif pairs == NOT_UPPER and side[k] == 1:
            may &= side[k + 1 : stop] != 1
        others = np.flatnonzero(may) + k + 1
        if not len(others):
            continue
        own = flat_codes[first[k] : first[k + 1]]
        mark[own] = 1
        if 2 * len(others) > stop - k - 1:  # most of the range: one pass over it
            hits = np.append(0, np.cumsum(mark[flat_codes[first[k + 1] : first[stop]]], dtype=np.int64))
            overlap = hits[first[others + 1] - first[k + 1]] - hits[first[others] - first[k + 1]]
        else:
            overlap = np.array([np.count_nonzero(mark[flat_codes[first[j] : first[j + 1]]]) for j in others], np.int64)
        mark[own] = 0
        linked = overlap >= need[others - k - 1]
        if linked.any():
            yield int(order[k]), order[others[linked]], overlap[linked]


def link_tile(ids: np.ndarray, sizes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int, pairs: int = ALL, weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the wanted pairs of one tile; all links are added to ``counts`` by weight."""
    forest, links = _Forest(len(ids)), []
    for k, others, _ in tile_links(ids, sizes, side, sets, num, den, pairs):
        if counts is not None:
            counts[k] += weights[others].sum()
            counts[others] += weights[k]
        for j in others.tolist():
            a, b = forest.root(k), forest.root(j)
            if a != b:
                forest.up[max(a, b)] = min(a, b)
                links.append((int(ids[k]), int(ids[j])))
    return links


def _tile_columns(table: pa.Table) -> tuple:
    sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    return table.column("rep").to_numpy(), table.column("n").to_numpy(), table.column("side").to_numpy(), sets


def _link_tiles(num: int, den: int):
    """Rows (a, b, links): links of a forest, and with a null b the number of rows that link to a."""

    def link(table: pa.Table) -> pa.Table:
        ids, sizes, side, sets = _tile_columns(table)
        weights, counts = table.column("class_size").to_numpy(), np.zeros(len(ids), np.int64)
        found = link_tile(ids, sizes, side, sets, num, den, table.column("pairs")[0].as_py(), weights, counts) if len(sets) > 1 else []
        some = np.flatnonzero(counts)
        a, b = [a for a, _ in found] + ids[some].tolist(), [b for _, b in found] + [None] * len(some)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([0] * len(found) + counts[some].tolist(), pa.int64())})

    return link


def _pair_tiles(num: int, den: int):
    """Rows (a, b, common): the links themselves, in batches."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, sizes, side, sets = _tile_columns(table)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            a, b, common = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "common": pa.array(common)})

        for k, others, overlap in tile_links(ids, sizes, side, sets, num, den, table.column("pairs")[0].as_py()) if len(sets) > 1 else ():
            held.append((np.full(len(others), ids[k]), ids[others], overlap))
            size += len(others)
            if size >= FLUSH:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return link


def _tiles(members: DataFrame, top: int, num: int, den: int) -> DataFrame:
    """(tile columns, side, pairs, rep, n, class_size, grams): each document in the tiles of its cell.

    A band of one cell is compared within itself in the tile that it shares with the first cell
    of the next band, so that most documents are in two tiles.  ``top`` is the greatest n.
    """
    bounds = band_bounds(num, den, top)
    n = F.col("n")
    # the band of a size: lower ends grow by a factor, so a short binary search over literals
    band = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= n)) - 1
    members = members.withColumn("band", band)
    cells = members.groupBy("cluster", "band").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("docs"))
    cells = cells.withColumn("m", F.ceil(F.greatest(F.col("c") / CELL, F.col("docs") / CELL_DOCS)).cast("int"))
    small = (F.sum("c") <= CELL) & (F.sum("docs") <= CELL_DOCS)
    whole = cells.groupBy("cluster").agg(small.alias("small"))
    near = lambda d, name: cells.select("cluster", (F.col("band") + d).alias("band"), F.col("m").alias(name))
    cells = cells.join(near(-1, "m_up"), ["cluster", "band"], "left").join(near(1, "m_down"), ["cluster", "band"], "left").join(whole, "cluster")
    docs = members.join(cells, ["cluster", "band"])
    salt = F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")
    docs = docs.withColumn("salt", F.when(F.col("small"), 0).otherwise(salt))
    tile = lambda row, a, b, side, pairs: F.struct(row.cast("int").alias("row"), a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"), pairs.cast("int").alias("pairs"))
    s, band, none = F.col("salt"), F.col("band"), F.array().cast("array<struct<row:int,a:int,b:int,side:int,pairs:int>>")
    upto = lambda m: F.when(F.coalesce(m, F.lit(0)) > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    kind = lambda m, t: F.when((m == 1) & (t == 0), NOT_UPPER).otherwise(ACROSS)
    own = F.transform(upto(F.col("m")), lambda t: tile(band * 2, F.least(s, t), F.greatest(s, t), s, F.when(s == t, ALL).otherwise(ACROSS)))
    own = F.when(F.col("m") > 1, own).otherwise(none)
    # the next band may be empty; a single cell still needs its tile
    up = F.transform(upto(F.when(F.col("m") == 1, F.greatest(F.coalesce("m_up", F.lit(0)), F.lit(1))).otherwise(F.col("m_up"))), lambda t: tile(band * 2 + 1, s, t, F.lit(0), kind(F.col("m"), t)))
    down = F.transform(upto(F.col("m_down")), lambda t: tile(band * 2 - 1, t, s, F.lit(1), kind(F.col("m_down"), s)))
    single = F.array(tile(F.lit(-2), F.lit(0), F.lit(0), F.lit(0), F.lit(ALL)))
    docs = docs.withColumn("t", F.explode(F.when(F.col("small"), single).otherwise(F.concat(own, up, down))))
    return docs.select("cluster", "t.row", "t.a", "t.b", "t.side", "t.pairs", "rep", "n", "class_size", "grams")


def components(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size for every row of ``documents``.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of distinct
    ``width``-word shingles; component_id is the least doc_id reachable by links.  class_size
    counts the rows with exactly the same set.  Null, empty and blank texts have no shingles
    and are alone; so are rows with a null doc_id (component_id null).  A doc_id stands for one
    document: repeated rows stay, with equal results.  An empty table gives no rows; other
    columns are not read.
    """
    return linked(documents, width, num, den).select("doc_id", "n_shingles", "component_id", "class_size")


def linked(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The columns of ``components`` and n_links: the number of other rows that link to the row, of its own set or another."""
    docs, classes, tiles = _candidate_tiles(documents, width, num, den)
    found = tiles.groupBy("cluster", "row", "a", "b").applyInArrow(tidy(_link_tiles(num, den)), "a bigint, b bigint, links bigint")
    found = materialise(found, "jaccard-links")
    joined = connected_components(found.select("a", "b")).select(F.col("id").alias("rep"), F.col("component"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(joined.join(counts, "rep"), "rep", "left").select("k1", "k2", "n", "class_size", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("class_size") - 1).alias("n_links"))
    named = materialise(named, "jaccard-named")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    none = F.lit(None).cast("bigint")
    out = docs.where(~linkable).select("k1", "k2", "n", "doc_id", none.alias("class_size"), none.alias("component"), none.alias("n_links")).unionByName(join_groups(docs.where(linkable), named, ["k1", "k2", "n"], "class_size"))
    alone = F.col("doc_id").isNull() | F.col("component").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).alias("class_size"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"))


def pairs(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """(links, members): a, b, common for each link between different sets, a < b, and doc_id, rep for each document.

    a and b are representatives, the least doc_id of each set; common is the size of the
    intersection.  Documents with one representative have equal sets.  The links grow with
    the square of a group of near copies.
    """
    docs, classes, tiles = _candidate_tiles(documents, width, num, den)
    links = tiles.groupBy("cluster", "row", "a", "b").applyInArrow(tidy(_pair_tiles(num, den)), "a bigint, b bigint, common bigint")
    members = join_groups(docs.where("doc_id is not null").distinct(), classes, ["k1", "k2", "n"], "class_size").select("doc_id", "rep")
    return links, members


def _candidate_tiles(documents: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with keys, classes of equal sets, tiles in which all links between classes lie)."""
    rows = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].cast("string").alias("text"))
    docs = materialise(rows.mapInArrow(tidy(_measure(width)), "doc_id bigint, n bigint, k1 bigint, k2 bigint"), "jaccard-documents")
    classes = docs.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"))
    classes = materialise(classes, "jaccard-classes")
    live = _live_sets(rows, docs, width, num, den)
    release(documents.sparkSession)

    # documents of one class have the same shared n-grams, so any of them speaks for it
    named = join_groups(docs.where("doc_id is not null").distinct(), classes, ["k1", "k2", "n"], "class_size")
    chosen = live.select("doc_id", "n").join(named.select("doc_id", "n", "rep", "class_size"), ["doc_id", "n"]).groupBy("rep", "n", "class_size").agg(F.min("doc_id").alias("doc_id"))
    chosen = materialise(chosen, "jaccard-chosen")
    prefixes = live.select("doc_id", "n", "grams").mapInArrow(tidy(_prefixes(_frequencies(live), num, den)), "doc_id bigint, n bigint, gram bigint")
    met = materialise(prefixes.join(chosen, ["doc_id", "n"]).select("rep", "gram"), "jaccard-prefixes")
    hubs = met.groupBy("gram").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("rows")).where("hub <> last")
    candidates = join_groups(met, materialise(hubs.select("gram", "hub", "rows"), "jaccard-hubs"), ["gram"], "rows").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    clusters = connected_components(candidates).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    release(documents.sparkSession)
    members = live.select("doc_id", "n", "grams").join(chosen.join(clusters, "rep"), ["doc_id", "n"]).select("rep", "cluster", "n", "class_size", "grams")
    return docs, classes, _tiles(members, classes.agg(F.max("n")).first()[0] or 1, num, den)


def _home_column(doc_id: Column, homes: int) -> Column:
    """The same place as ``_home_array``, in Spark."""
    part = lambda p, a, q: F.pmod(F.pmod(doc_id, F.lit(p)) * a, F.lit(q))
    return F.pmod(part(1000003, 7919, 65537) + part(999983, 104729, 65521) * 65537, F.lit(homes)).cast("int")


def _home_array(docs: np.ndarray, homes: int) -> np.ndarray:
    return (docs % 1000003 * 7919 % 65537 + docs % 999983 * 104729 % 65521 * 65537) % homes


def _live_sets(rows: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, grams) of the documents with enough shared n-grams for a link.

    A sealed run names one document of each class in its task, so a class may come several times.
    """
    bits = max(2, (text_bytes(rows) // BUCKET_BYTES).bit_length())
    homes, near = 1 << bits, min(bits, LEVEL)
    runs = rows.where("doc_id is not null").mapInArrow(tidy(_runs(width, near)), "bucket int, run binary, flags binary")
    while near < bits:
        coarse, near = near, min(bits, near + LEVEL)
        runs = runs.repartition(1 << coarse, "bucket").mapInArrow(tidy(_finer(near)), "bucket int, run binary, flags binary")
    shared = runs.repartition(1 << max(0, bits - 1), "bucket").groupBy("bucket").applyInArrow(tidy(_find_shared), "shared binary").mapInArrow(tidy(_to_homes(homes)), "home int, shared binary")
    ids = docs.where("n > 0 and doc_id is not null").distinct()
    homed = ids.select(_home_column(F.col("doc_id"), homes).alias("home"), "doc_id", "n").groupBy("home")
    live = homed.cogroup(shared.groupBy("home")).applyInArrow(tidy(_gather_sets(num, den)), "doc_id bigint, n bigint, grams binary")
    return materialise(live, "jaccard-live")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS pos FROM d WHERE len(w) >= 1
), k AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[pos : pos + 2], ' ')) AS key FROM p
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS size, md5(string_agg(key, '' ORDER BY key)) AS same FROM k GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM k a JOIN k b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.size + y.size - common)
), links AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b
), m AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
), g AS (
  SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a
), s AS (
  SELECT same, count(*) AS class_size FROM n GROUP BY same
)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id,
       coalesce(s.class_size, 1) AS class_size, coalesce(g.n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN s ON s.same = n.same
"""
