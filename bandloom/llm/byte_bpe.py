"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

Distinct pieces of a slice of texts are put into padded matrices by length.  In every
round each row looks all its neighbouring pairs up in a hash table, merges the leftmost
pair of least rank and is compacted; rows without a pair leave the matrix.  Pieces that
are a token as a whole are that token.  Very long pieces go through a heap of pairs,
which makes the same merges in the same order without quadratic work.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from bandloom.llm.textarrays import slices, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG_PIECE = 128
ROWS = 1 << 16
_NONE = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(max(len(left), 1) * 3))))
        self.mask, self.shift = size - 1, np.uint64(64 - int(np.log2(size)))
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._home(key)
        todo = np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            winner = dict(zip(slot[free].tolist(), free.tolist(), strict=True))
            won = np.fromiter(winner.values(), np.int64, len(winner))
            self.keys[slot[won]], self.values[slot[won]] = key[won], merged[won]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id, or the largest int32 where there is none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._home(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((seen != key) & (seen != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class ByteBpe:
    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        top = max(self.ranks.values()) + 1
        tokens: list[bytes] = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_length)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _merge_rows(self, ids: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """All rows have at least one entry; ids is padded with -1."""
        out: list[np.ndarray] = [None] * len(ids)
        row = np.arange(len(ids))
        while len(row):
            rank = np.full((len(row), max(ids.shape[1] - 1, 1)), _NONE, np.int32)
            r, c = np.nonzero(ids[:, 1:] >= 0)
            rank[r, c] = self.pairs.find(ids[r, c], ids[r, c + 1])
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            ended = best == _NONE
            for k in np.flatnonzero(ended):
                out[row[k]] = ids[k, : length[k]]
            go = np.flatnonzero(~ended)
            if not len(go):
                break
            ids, length, row, at, best = ids[go], length[go] - 1, row[go], at[go], best[go]
            places = np.arange(ids.shape[1] - 1)
            moved = np.where(places[None, :] > at[:, None], ids[:, 1:], ids[:, :-1])
            moved[np.arange(len(row)), at] = best
            ids = moved[:, : int(length.max())]
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One piece with a heap of (rank, place): the same order of merges."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[k]), k, ids[k], ids[k + 1]) for k in np.flatnonzero(first != _NONE)]
        heapq.heapify(heap)
        find, memo = self.pairs.find, {}

        def push(k: int) -> None:
            if k >= 0 and after[k] < n:
                pair = ids[k], ids[after[k]]
                if pair not in memo:
                    memo[pair] = int(find(np.array(pair[:1]), np.array(pair[1:]))[0])
                if memo[pair] != _NONE:
                    heapq.heappush(heap, (memo[pair], k, *pair))

        while heap:
            rank, k, a, b = heapq.heappop(heap)
            if not alive[k] or ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue
            gone = after[k]
            alive[gone] = False
            ids[k], after[k] = rank, after[gone]
            if after[k] < n:
                before[after[k]] = k
            push(k)
            push(before[k])
        return np.array([x for x, keep in zip(ids, alive, strict=True) if keep], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(piece) > LONG_PIECE:
                out[k] = self._merge_long(piece)
            else:
                by_width.setdefault((len(piece) + 3) // 4 * 4, []).append(k)
        for width, members in by_width.items():
            for lo in range(0, len(members), ROWS):
                part = members[lo : lo + ROWS]
                length = np.array([len(pieces[k]) for k in part])
                raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in part), np.uint8).reshape(len(part), width)
                ids = np.where(np.arange(width)[None, :] < length[:, None], self.byte_id[raw], np.int32(-1))
                for k, ids_k in zip(part, self._merge_rows(ids, length), strict=True):
                    out[k] = ids_k
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        number: dict[str, int] = {}
        place, ends = [], []
        setdefault = number.setdefault
        for text in texts:
            for piece in self.pattern.findall(text):
                place.append(setdefault(piece, len(number)))
            ends.append(len(place))
        if not place:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = self.encode_pieces([p.encode() for p in number])
        sizes = np.array([len(c) for c in coded], np.int64)
        flat, start = np.concatenate(coded), np.concatenate([[0], np.cumsum(sizes)])[:-1]
        place = np.array(place, np.int64)
        ids = gather(flat, start[place], sizes[place])
        bounds = np.concatenate([[0], np.cumsum(sizes[place])])
        return ids, bounds[np.concatenate([[0], np.array(ends, np.int64)])]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[0]:start[0]+size[0]], then those of the next, and so on."""
    total = int(size.sum())
    lead = np.cumsum(size) - size
    return values[np.arange(total) + np.repeat(start - lead, size)]


_coders: dict[tuple, ByteBpe] = {}


def coder(rank_file: str, pattern: str) -> ByteBpe:
    """One coder for each worker process."""
    if (rank_file, pattern) not in _coders:
        _coders[rank_file, pattern] = ByteBpe(rank_file, pattern)
    return _coders[rank_file, pattern]


def default_vocabulary() -> tuple[str, str]:
    """(rank file, pattern) of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>, decoded BINARY) for each row of ``df``.

    A null text counts as empty and has no ids.  Rows keep their number: repeated rows
    give repeated results, an empty table gives none, null keys stay null.  Other columns
    are not read.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = bpe.encode_texts([t or "" for t in part.column(1).to_pylist()])
                decoded = [bpe.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch({"key": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), "decoded": pa.array(decoded, pa.binary())})

    out = df.select(df[key].cast("bigint").alias("key"), df[text].cast("string").alias("text"))
    return out.mapInArrow(tidy(run), "key bigint, ids array<int>, decoded binary").withColumnRenamed("key", key)


def digests(df: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode`` returns, as digests made beside it."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = bpe.encode_texts([t or "" for t in part.column(1).to_pylist()])
                n, a, b = [], [], []
                for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                    one = ids[lo:hi]
                    n.append(int(hi - lo))
                    a.append(hashlib.sha256(one.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(one)).hexdigest())
                yield pa.record_batch({"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)})

    return df.select(df["doc_id"].cast("bigint").alias("doc_id"), df["text"].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_checked(df: DataFrame, carry: list[str], vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, the columns of ``carry``, n_tokens, ids, round_trip: whether decoding gave the text's bytes."""
    from pyspark.sql import types as T

    vocabulary = vocabulary or default_vocabulary()
    rows = df.select(df["doc_id"].cast("bigint").alias("doc_id"), df["text"].cast("string").alias("text"), *[df[c].alias(f"_carry{k}") for k, c in enumerate(carry)])
    names = ["doc_id", *[f"_carry{k}" for k in range(len(carry))], "n_tokens", "ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, offsets = bpe.encode_texts(texts)
                same = [bpe.decode(ids[a:b]) == t.encode() for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                others = [part.column(k) for k in range(part.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*others, pa.array(np.diff(offsets), pa.int64()), lists, pa.array(same, pa.bool_())], names)

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return rows.mapInArrow(tidy(run), schema).toDF("doc_id", *carry, "n_tokens", "ids", "round_trip")


def token_counts(df: DataFrame, carry: list[str], vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, the columns of ``carry`` and n_tokens of each row's text; a null text has none."""
    from pyspark.sql import types as T

    vocabulary = vocabulary or default_vocabulary()
    rows = df.select(df["doc_id"].cast("bigint").alias("doc_id"), df["text"].cast("string").alias("text"), *[df[c].alias(f"_carry{k}") for k, c in enumerate(carry)])
    names = ["doc_id", *[f"_carry{k}" for k in range(len(carry))], "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                _, offsets = bpe.encode_texts([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(np.diff(offsets), pa.int64())], names)

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(tidy(run), schema).toDF("doc_id", *carry, "n_tokens")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
