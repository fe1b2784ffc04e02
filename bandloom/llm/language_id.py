"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, everything but letters and marks becomes one space, and characters
are 16-bit codes, so that four of them fill a 64-bit key.  Four-gram counts of all training
texts are summed by language and key range in Spark, each range by one task that adds what
comes to its running sums.  The driver turns them into one model
for each language: sorted arrays of hashed keys with log probabilities and back-off weights
of orders four to one.  A text gets the language of least cross-entropy for each character.
A text is rejected when it looks like none of the languages: the cross-entropy that takes,
for each character, whichever model likes it best (so that quotations in another language
do no harm) lies further above its usual value than a margin, which shrinks with the text's
length and is calibrated on all labelled texts by models that have not seen them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.runs import pack, unpack
from bandloom.llm.textarrays import mix, slices, tidy
from bandloom.operators.stats import percentile_row
from bandloom.storage import materialise

ORDER = 4
BUCKETS = 16
FLUSH = 400_000
#: Percentiles of tables of entropies up to this size are one aggregate.
SMALL_TABLE = 1 << 23
#: The margin, in distances from the median to the 90 % point of held-out texts: of these up to a tenth may be junk.
SPREAD = 12.0
LEAST_MARGIN = 5.0
UNDETERMINED = "und"

_LETTER = np.zeros(65536, bool)
_CODE = np.zeros(65536, np.uint16)
for _c in range(65536):
    _kind = unicodedata.category(chr(_c))[0]
    if _kind in "LM":
        _CODE[_c] = _c
        _LETTER[_c] = _kind == "L"


def codes(text: str) -> np.ndarray:
    """16-bit codes with single spaces (0) between words and three at the start; empty without letters."""
    point = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    far = point > 65535
    low = np.where(far, 0, point).astype(np.uint16)
    code = _CODE[low]
    letter = bool(_LETTER[low].any())
    if far.any():
        kinds = {int(p): unicodedata.category(chr(p))[0] for p in np.unique(point[far])}
        code[far] = [0xFFFD if kinds[int(p)] in "LM" else 0 for p in point[far]]
        letter = letter or "L" in kinds.values()
    if not letter:
        return np.zeros(0, np.uint16)
    keep = code != 0
    keep[1:] |= keep[:-1].copy()  # the first space after a word stays
    return np.concatenate([np.zeros(ORDER - 1, np.uint16), code[keep]])


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all four-grams, number of them for each text)."""
    each = [codes(t) for t in texts]
    sizes = np.array([max(0, len(c) - ORDER + 1) for c in each], np.int64)
    each = [c for c in each if len(c)]
    if not each:
        return np.zeros(0, np.uint64), sizes
    c = np.concatenate(each).astype(np.uint64)
    ends = np.cumsum([len(x) for x in each])
    key = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
    inside = np.ones(len(c), bool)
    for k in range(1, ORDER):
        inside[ends - k] = False
    return key[inside[: len(key)]], sizes


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, run) with the summed four-gram counts of (lang, text) rows, sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush(lang: str) -> pa.RecordBatch:
            keys, counts = summed(*(np.concatenate(c) for c in zip(*held.pop(lang), strict=True)))
            home = (mix(keys) >> np.uint64(60)).astype(np.int64)
            runs = [pack([keys[home == b], counts[home == b]]) for b in range(BUCKETS)]
            return pa.record_batch({"lang": pa.array([lang] * BUCKETS), "bucket": pa.array(range(BUCKETS), pa.int32()), "run": pa.array(runs, pa.binary())})

        for batch in batches:
            for part in slices(batch, "text"):
                langs, texts = np.array(part.column(0).to_pylist(), object), np.array(part.column(1).to_pylist(), object)
                for lang in sorted(set(langs)):
                    keys, _ = grams_of([t for t in texts[langs == lang] if t])
                    if len(keys):
                        code, found = pd.factorize(keys)
                        held.setdefault(lang, []).append((found, np.bincount(code).astype(np.int64)))
                        if sum(len(k) for k, _ in held[lang]) > FLUSH:
                            held[lang] = [summed(*(np.concatenate(c) for c in zip(*held[lang], strict=True)))]
                            if len(held[lang][0][0]) > FLUSH:
                                yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running sums: memory follows the different four-grams, not the number of runs."""
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for lang, bucket, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault((lang, bucket), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])
                held.append(unpack(run))
                if sum(len(k) for k, _ in held[1:]) > len(held[0][0]) + FLUSH // BUCKETS:
                    sums[lang, bucket] = [summed(*(np.concatenate(c) for c in zip(*held, strict=True)))]
        for (lang, bucket), held in sums.items():
            run = pack(list(summed(*(np.concatenate(c) for c in zip(*held, strict=True)))))
            yield pa.record_batch({"lang": pa.array([lang], pa.string()), "bucket": pa.array([bucket], pa.int32()), "run": pa.array([run], pa.binary())})

    schema = "lang string, bucket int, run binary"
    return labelled.select("lang", "text").mapInArrow(tidy(run), schema).repartition("lang", "bucket").mapInArrow(tidy(merge), schema)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


@dataclass
class SortedTable:
    """Values by hashed key, found by binary search in the sorted hashes."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> SortedTable:
        h = mix(keys)
        order = np.argsort(h)
        return cls(h[order], values[order].astype(np.float32))

    def get(self, hashed: np.ndarray, default: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashed), default, np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, self.values[at], np.float32(default))


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney: orders[k] has P(c | k characters) where seen, weights[k] the back-off of a context."""

    orders: list[SortedTable] = field(default_factory=list)
    weights: list[SortedTable] = field(default_factory=list)
    unseen: float = 1e-6

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray, alphabet: int) -> KneserNey:
        levels = [(keys, counts)]
        for k in range(ORDER - 1, 0, -1):  # lower orders count the different characters before them
            shorter = levels[0][0] & np.uint64((1 << 16 * k) - 1)
            levels.insert(0, summed(shorter, np.ones(len(shorter), np.int64)))
        model, below = cls(unseen=1.0 / (alphabet + 1)), None
        for k, (key, count) in enumerate(levels):
            n1, n2 = int((count == 1).sum()), int((count == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context = key >> np.uint64(16)
            start = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            total, kinds = np.add.reduceat(count, start), np.diff(np.append(start, len(key)))
            group = np.repeat(np.arange(len(start)), kinds)
            weight = discount * kinds / total
            lower = model.unseen if below is None else below.get(mix(key & np.uint64((1 << 16 * k) - 1)), 0)
            p = np.maximum(count - discount, 0) / total[group] + weight[group] * lower
            below = SortedTable.of(key, p)
            model.orders.append(below)
            model.weights.append(SortedTable.of(context[start], weight))
        return model

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), self.unseen, np.float32)
        for k in range(ORDER):
            own = keys & np.uint64((1 << 16 * (k + 1)) - 1) if k < ORDER - 1 else keys
            backed = self.weights[k].get(mix(own >> np.uint64(16)), 1.0) * p
            seen = self.orders[k].get(mix(own), -1.0)
            p = np.where(seen > 0, seen, backed)
        return np.log(p)


@dataclass
class LanguageModels:
    langs: list[str]
    models: list[KneserNey]
    usual: float = 0.0
    margin: float = np.inf

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats a character: a column for each language and one for the best by character; characters)."""
        keys, sizes = grams_of(texts)
        out = np.zeros((len(texts), len(self.langs) + 1))
        if len(keys) and self.langs:
            code, found = pd.factorize(keys)
            full = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[full]
            log_p = [m.log_p(found) for m in self.models]
            for k, column in enumerate([*log_p, np.max(log_p, axis=0)]):
                out[full, k] = -np.add.reduceat(column.astype(np.float64)[code], starts) / sizes[full]
        return out, sizes

    def excess(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (h[:, -1] - self.usual) * np.sqrt(np.clip(sizes, 1, 400))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        h, sizes = self.entropies(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        each = h[:, :-1]
        best = each.argmin(1)
        gap = (each - each.min(1, keepdims=True)) * np.clip(sizes, 1, 30)[:, None]
        score = np.where(sizes > 0, 1 / np.exp(-gap).sum(1), 0.0)
        rejected = (sizes == 0) | (self.excess(h, sizes) > self.margin)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, sizes, strict=True)], score, rejected

    def calibrate(self, judged: DataFrame) -> None:
        """The usual cross-entropy, and a margin that nearly all texts of a language keep, from all rows (h, size)."""

        def exact(column: Column, share: float) -> float | None:
            found = percentile_row(judged, {"p": column}, [share], SMALL_TABLE).first()["p"]
            return found[0] if found else None

        usual = exact(F.col("h"), 0.5)
        if usual is not None:
            self.usual = usual
            room = F.sqrt(F.least(F.col("size"), F.lit(400)).cast("double"))  # as in ``excess``
            self.margin = max(LEAST_MARGIN, SPREAD * exact((F.col("h") - F.lit(usual)) * room, 0.9))


def _tables(labelled: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The summed four-gram counts of each language of (lang, text) rows, on the driver: they are the model."""
    runs: dict[str, list] = {}
    for row in count_grams(labelled).toLocalIterator():
        runs.setdefault(row["lang"], []).append(unpack(bytes(row["run"])))
    return {x: summed(*(np.concatenate(c) for c in zip(*runs.pop(x), strict=True))) for x in sorted(runs)}


def _fit(tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
    alphabet = len(np.unique(np.concatenate([np.unique(k & np.uint64(0xFFFF)) for k, _ in tables.values()]))) if tables else 1
    return LanguageModels(list(tables), [KneserNey.fit(k, c, alphabet) for k, c in tables.values()])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _by_halves(labelled: DataFrame, half: Column) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], list[LanguageModels], DataFrame]:
    """(counts by half and language, models for each half of the other one's rows, (half, h, size) of every text by these).

    Texts without letters, and those whose other half has no language, are missing in the last.
    """
    tables = _tables(labelled.select(F.concat(half.cast("string"), "lang").alias("lang"), "text"))
    models = [_fit({x[1:]: t for x, t in tables.items() if x[0] == str(1 - k)}) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                halves, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for k, own in enumerate(models):
                    h, sizes = own.entropies([t for t, x in zip(texts, halves, strict=True) if x == k])
                    some = np.flatnonzero(sizes > 0) if own.langs else []
                    if len(some):
                        yield pa.record_batch({"half": pa.array(np.full(len(some), k), pa.int32()), "h": pa.array(h[some, -1]), "size": pa.array(sizes[some])})

    judged = labelled.select(half.alias("half"), "text").mapInArrow(tidy(run), "half int, h double, size bigint")
    return tables, models, materialise(judged, "language-entropies")


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.where("lang is not null and text is not null and doc_id is not null")


def train(labelled: DataFrame) -> LanguageModels:
    """Models of all languages in ``labelled`` (doc_id, lang, text); counts and calibration cover every row, whole.

    For the calibration each half of the rows is judged by models of the other half.
    """
    half = F.shiftright(F.crc32(F.col("doc_id").cast("string").cast("binary")), 8).bitwiseAND(F.lit(1)).cast("int")
    tables, _, judged = _by_halves(_labelled(labelled), half)
    each: dict[str, list] = {}
    for name, table in tables.items():
        each.setdefault(name[1:], []).append(table)
    models = _fit({x: summed(*(np.concatenate(c) for c in zip(*each[x], strict=True))) for x in sorted(each)})
    models.calibrate(judged)
    return models


def fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


def train_folds(labelled: DataFrame) -> list[LanguageModels]:
    """For each of two folds of documents, models of the other fold's rows, calibrated on all of its own.

    So a document never meets a model that has learnt from it, and a labelled text that is no
    language can be rejected.  Of clean texts some 0.02 % are rejected.
    """
    _, out, judged = _by_halves(_labelled(labelled), fold(F.col("doc_id")))
    for k, models in enumerate(out):
        models.calibrate(judged.where(F.col("half") == k))
    return out


def identify_across(documents: DataFrame, carry: list[str] = ()) -> DataFrame:
    """``identify`` with each document judged by models of the other fold of the same table.

    Languages of one fold only are unknown to it; rows with a null doc_id are one fold.
    """
    parts = [identify(documents.where(fold(F.col("doc_id")) == k), models, carry) for k, models in enumerate(train_folds(documents))]
    return parts[0].union(parts[1])


def identify(documents: DataFrame, models: LanguageModels, carry: list[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row, with the columns of ``carry``.

    Null text, or text without letters: ``und``, score 0, rejected.  Ties go to the language
    that comes first by name.  Null doc_id stays null, repeated rows give equal rows, an empty
    table gives none; only doc_id, text and ``carry`` are read.
    """
    from pyspark.sql import types as T

    rows = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].cast("string").alias("text"), *[documents[c].alias(f"_carry{k}") for k, c in enumerate(carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score, rejected = models.predict([t or "" for t in part.column(1).to_pylist()])
                keep = [part.column(k) for k in range(part.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [f"c{k}" for k in range(len(keep))] + ["lang_pred", "score", "rejected"])

    fields = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    out = rows.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(["doc_id", *carry])], "lang_pred", "score", "rejected")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    models = train(documents.where(~held_out(F.col("doc_id"))))
    return identify(documents, models).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
