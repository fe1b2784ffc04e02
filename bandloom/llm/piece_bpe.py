"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary could reach across, which makes words of
it.  The distinct words of a slice of texts lie one after another in one flat numpy array
of symbols.  In every round each word finds its least pair rank (a segmented minimum),
merges its leftmost pairs of that rank, all words at once, and the array is compacted; a
word without a pair leaves it.  A merge whose new neighbours would come first ends the
word's round, so that merges keep the library's order: best score, then leftmost.  A word
with pairs left after ``ROUNDS`` rounds goes through a heap of pairs, which makes the same
merges in the same order without quadratic work.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bandloom.llm.byte_bpe import PairTable, gather
from bandloom.llm.textarrays import slices, tidy

MODEL = "piece_bpe_32k.model"
ROUNDS = 256
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
_NONE = np.int32(2**31 - 1)
#: A symbol of this number or more is a character without a piece: its code point plus this.
_LOOSE = 1 << 24


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceBpe:
    """A BPE model with byte fallback, a dummy prefix and no normalisation; other models raise ValueError."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        rules = dict(_fields(next((v for k, v in top if k == 3), b"")))
        plain = not rules.get(2) and rules.get(3, 1) and not rules.get(4, 1) and rules.get(5, 1) and not trainer.get(24)
        if trainer.get(3) != 2 or not trainer.get(35) or not plain:
            raise ValueError("not a BPE model with byte fallback, a dummy prefix and no normalisation")
        entries = [dict(_fields(v)) for k, v in top if k == 1]
        pieces = [e[1].decode() for e in entries]
        self.kind = np.array([e.get(3, NORMAL) for e in entries], np.int8)
        if not set(self.kind.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not known here")
        score = np.array([struct.unpack("<f", e[2])[0] if 2 in e else 0.0 for e in entries])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        known = {p: k for k, p in enumerate(pieces) if self.kind[k] == NORMAL}
        self.byte_id = np.full(256, -1, np.int32)
        for k in np.flatnonzero(self.kind == BYTE):
            self.byte_id[int(pieces[k][3:5], 16)] = k
        self.char_id = np.arange(0x110000, dtype=np.int32) + _LOOSE
        for p, k in known.items():
            if len(p) == 1:
                self.char_id[ord(p)] = k
        left, right, merged, beside = [], [], [], set()
        for p, k in known.items():
            for at in range(1, len(p)):
                beside.add(ord(p[at - 1]) << 32 | ord(p[at]))
                a, b = (known.get(q, ord(q) + _LOOSE if len(q) == 1 else None) for q in (p[:at], p[at:]))
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(k)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.beside = PairTable(np.array([b >> 32 for b in beside], np.int64), np.array([b & 0xFFFFFFFF for b in beside], np.int64), np.zeros(len(beside), np.int32))
        surface = [{NORMAL: p.replace(SPACE, " "), UNKNOWN: " ⁇ ", CONTROL: "", BYTE: ""}[int(kind)] for p, kind in zip(pieces, self.kind, strict=True)]
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else s.encode() for p, s, kind in zip(pieces, surface, self.kind, strict=True)]
        self.opens = np.array([p.startswith(SPACE) and kind == NORMAL for p, kind in zip(pieces, self.kind, strict=True)])
        self.piece_length = np.array([len(r) for r in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _rank_of(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged == _NONE, _NONE, self.rank[np.where(merged == _NONE, 0, merged)])

    def _merge_flat(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sizes) of all words, with nothing left to merge; every word has at least one symbol."""
        word = np.arange(len(size))
        done_sym, done_size, done_word = [], [], []
        into = np.full(len(sym), _NONE, np.int32)
        if len(sym):
            into[:-1] = self.pairs.find(sym[:-1], sym[1:])
        into[np.cumsum(size) - 1] = _NONE
        rank = self._rank_of(into)
        for turn in range(ROUNDS + 1):
            if not len(word):
                break
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, start)
            over = best == _NONE
            if over.any():
                gone = np.repeat(over, size)
                done_sym.append(sym[gone])
                done_size.append(size[over])
                done_word.append(word[over])
                sym, into, rank = sym[~gone], into[~gone], rank[~gone]
                size, word, best = size[~over], word[~over], best[~over]
                if not len(word):
                    break
                start = np.cumsum(size) - size
            if turn == ROUNDS:
                for k in range(len(word)):
                    rest = self._merge_long(sym[start[k] : start[k] + size[k]])
                    done_sym.append(rest)
                    done_size.append(np.array([len(rest)]))
                    done_word.append(word[k : k + 1])
                break
            owner = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == best[owner])
            # of pairs that overlap in a chain every second merges
            lead = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            chain = np.repeat(lead, np.diff(np.append(lead, len(at))))
            at = at[(np.arange(len(at)) - chain) % 2 == 0]
            made, mine = into[at], owner[at]
            first, last = at == start[mine], at + 1 == start[mine] + size[mine] - 1
            before = np.where(first, 0, sym[at - 1])
            follows = np.flatnonzero((np.diff(at, prepend=-9) == 2) & ~first)
            before[follows] = made[follows - 1]  # what stands before it has just been merged
            after = np.where(last, 0, sym[np.minimum(at + 2, len(sym) - 1)])
            left = np.where(first, _NONE, self.pairs.find(before, made))
            right = np.where(last, _NONE, self.pairs.find(made, after))
            early = np.minimum(self._rank_of(left), self._rank_of(right)) <= best[mine]
            if early.any():  # such a merge is the last of its word in this round
                count = np.cumsum(early) - early
                new = np.diff(mine, prepend=-1) != 0
                base = np.repeat(count[new], np.diff(np.append(np.flatnonzero(new), len(mine))))
                keep = count == base
                at, made, mine = at[keep], made[keep], mine[keep]
            sym[at] = made
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            place = (np.cumsum(stay) - 1)[at]
            size = size - np.bincount(mine, minlength=len(size))
            sym, into, rank = sym[stay], into[stay], rank[stay]
            ends = np.cumsum(size)
            closing = place == ends[mine] - 1
            fresh = np.where(closing, _NONE, self.pairs.find(made, sym[np.minimum(place + 1, len(sym) - 1)]))
            into[place], rank[place] = fresh, self._rank_of(fresh)
            inner = place > (ends - size)[mine]
            back = place[inner] - 1
            fresh = self.pairs.find(sym[back], sym[back + 1])
            into[back], rank[back] = fresh, self._rank_of(fresh)
        order = np.argsort(np.concatenate(done_word), kind="stable") if done_word else np.zeros(0, np.int64)
        sizes = np.concatenate(done_size) if done_size else np.zeros(0, np.int64)
        flat = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        lead = np.cumsum(sizes) - sizes
        return gather(flat, lead[order], sizes[order]), sizes[order]

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """One word with a heap of (rank, place)."""
        ids, n = sym.tolist(), len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        memo: dict[tuple[int, int], tuple[int, int]] = {}
        heap: list[tuple[int, int, int, int, int]] = []

        def push(k: int) -> None:
            if k < 0 or after[k] >= n:
                return
            pair = ids[k], ids[after[k]]
            if pair not in memo:
                merged = int(self.pairs.find(np.array(pair[:1]), np.array(pair[1:]))[0])
                memo[pair] = (int(self.rank[merged]), merged) if merged != _NONE else (-1, -1)
            rank, merged = memo[pair]
            if merged >= 0:
                heapq.heappush(heap, (rank, k, merged, *pair))

        for k in range(n - 1):
            push(k)
        while heap:
            _, k, merged, a, b = heapq.heappop(heap)
            if not alive[k] or ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue
            gone = after[k]
            alive[gone] = False
            ids[k], after[k] = merged, after[gone]
            if after[k] < n:
                before[after[k]] = k
            push(k)
            push(before[k])
        return np.array([x for x, keep in zip(ids, alive, strict=True) if keep], np.int32)

    def _words(self, text: str) -> list[str]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        apart = self.beside.find(points[:-1], points[1:]) == _NONE
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        number: dict[str, int] = {}
        place, ends = [], []
        setdefault = number.setdefault
        for text in texts:
            if text:
                place += [setdefault(w, len(number)) for w in self._words(SPACE + text.replace(" ", SPACE))]
            ends.append(len(place))
        if not place:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer("".join(number).encode("utf-32-le"), np.uint32)
        sym, size = self._merge_flat(self.char_id[points], np.array([len(w) for w in number], np.int64))
        sym, size = self._spell(sym, size)
        start, place = np.cumsum(size) - size, np.array(place, np.int64)
        bounds = np.concatenate([[0], np.cumsum(size[place])])
        return gather(sym, start[place], size[place]), bounds[np.concatenate([[0], np.array(ends, np.int64)])]

    def _spell(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        loose = np.flatnonzero(sym >= _LOOSE)
        if not len(loose):
            return sym, size
        raw = [chr(c).encode() for c in (sym[loose] - _LOOSE).tolist()]
        times = np.ones(len(sym), np.int64)
        times[loose] = [len(r) for r in raw]
        owner = np.repeat(np.arange(len(size)), size)
        size = np.bincount(owner, times, len(size)).astype(np.int64)
        spelt = np.repeat(sym, times)
        spelt[np.repeat(sym >= _LOOSE, times)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return spelt, size

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: control pieces are silent, bytes outside UTF-8 become the replacement character."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.kind)):
            raise ValueError("an id is not in the model")
        start, size = self.piece_start[ids], self.piece_length[ids]
        said = np.flatnonzero(size > 0)
        if len(said) and self.opens[ids[said[0]]]:  # the dummy prefix goes
            start[said[0]] += 1
            size[said[0]] -= 1
        kinds = self.kind[ids]
        if (kinds == BYTE).any() and (kinds == CONTROL).any():  # a silent piece keeps bytes apart
            return self._decode_broken(ids, start, size)
        try:
            return gather(self.piece_bytes, start, size).tobytes().decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids, start, size)

    def _decode_broken(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> str:
        """Runs of byte pieces apart from the others, each byte that starts no character replaced alone."""
        is_byte = self.kind[ids] == BYTE
        cuts = np.flatnonzero(np.diff(is_byte)) + 1
        out = []
        for part in np.split(np.arange(len(ids)), cuts):
            data = gather(self.piece_bytes, start[part], size[part]).tobytes()
            if not len(part) or not is_byte[part[0]]:
                out.append(data.decode())
                continue
            at = 0
            while at < len(data):
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if 0xC0 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF8 else 1
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
        return "".join(out)


_coders: dict[str, PieceBpe] = {}


def coder(model_file: str) -> PieceBpe:
    """One coder for each worker process."""
    if model_file not in _coders:
        _coders[model_file] = PieceBpe(model_file)
    return _coders[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>, decoded STRING) for each row of ``df``.

    A null or empty text has no ids and decodes to the empty string.  Texts of any length are encoded
    whole, a very long one as a slice alone; a single word of very many characters goes through a heap.
    Rows keep their number: repeated rows give repeated results, an empty table gives none, null keys
    stay null.  Ties between equal scores go to the left.  Other columns are not read.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = bpe.encode_texts([t or "" for t in part.column(1).to_pylist()])
                decoded = [bpe.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch({"key": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), "decoded": pa.array(decoded, pa.string())})

    out = df.select(df[key].cast("bigint").alias("key"), df[text].cast("string").alias("text"))
    return out.mapInArrow(tidy(run), "key bigint, ids array<int>, decoded string").withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """(key, text STRING) of each row's ids; null ids give a null text, an id outside the model fails the job."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"key": batch.column(0), "text": pa.array(texts, pa.string())})

    out = df.select(df[key].cast("bigint").alias("key"), df[ids].cast("array<int>").alias("ids"))
    return out.mapInArrow(tidy(run), "key bigint, text string").withColumnRenamed("key", key)


def digests(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode`` returns, as digests made beside it."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = bpe.encode_texts([t or "" for t in part.column(1).to_pylist()])
                a, b = [], []
                for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                    one = ids[lo:hi]
                    a.append(hashlib.sha256(",".join(map(str, one.tolist())).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(one).encode()).hexdigest())
                yield pa.record_batch({"doc_id": part.column(0), "n_tokens": pa.array(np.diff(offsets), pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return df.select(df["doc_id"].cast("bigint").alias("doc_id"), df["text"].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
