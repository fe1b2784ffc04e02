"""Secret scans: fixed patterns, then character Markov models for what they miss.

Two models of characters given the two before them are trained from labelled samples:
random strings (drawn from a seeded generator in several alphabets, plus the values that
the fixed patterns find in the corpus sample) and ordinary identifiers: the words of the
same sample outside those matches, and what programs make of words (camel and snake case,
paths, numbered names, versions, times, UUIDs).  A candidate run becomes a span of kind
``markov`` when the log-likelihood ratio for each character is over a threshold that is set
on a high quantile of held-out identifiers: words have no labels, so a few keys may be among
them.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.sampling import by_hash
from bandloom.llm.textarrays import slices, tidy

#: The fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")
#: What the models look at: runs with at least this many characters of the usual alphabets of keys.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Runs under this length without letters are dates, phone and card numbers, of which identifiers say nothing.
NUMBER = 20
#: The share of held-out identifiers below the threshold.
IDENTIFIERS = 0.995
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
WORD = re.compile(r"[A-Za-z_]{5,}")
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 10000
RANDOM_STRINGS = 6000
IDENTIFIERS_MADE, SHAPED_WORDS = 24_000, 2000
#: Hexadecimal strings are left to the fixed pattern: shorter ones are parts of hashes and UUIDs.
_ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "-_")
#: Words of which identifiers are made, beside those of the corpus.
IDENTIFIER_WORDS = """
abstract access account action address admin agent array async backup balance base batch bean binary block body bool
boot buffer build byte cache call char check class client cloud code column command commit common config connection
context control convert cookie core count create cursor data date debug default delete deploy detail device document
domain double download driver edit element email empty enable encode entity error event example exception export factory
field file filter first flag float folder format frame from function gateway generate get global graph group handler
header helper host html http icon image impl import index info init input insert instance integer interface item java
json kernel key label language last layer length level library limit line linux link list listener load local location
lock login long lookup main manager map master max memory message meta method min mobile model module monitor name native
network node null number object offset online option order output package page parameter parent parse password path
pattern pending plugin point policy pool port post prefix print process product profile project property protocol
provider proxy public query queue random range read record reference register release remote render report request
resource response result return root route sample scan schema scope script search select send server service session set
setting share shell simple single size socket sort source stack start state static status step stop storage store stream
string style submit sync system table target task temp template test text theme thread time title token tool total trace
track transaction transform tree type unit update upload user util valid value variable version view virtual wait web
widget window word work world write
""".split()
_SIZE = 64 + 4  # letters, digits, +/-_= and the rest share the codes
_CODE = np.full(256, _SIZE - 1, np.int64)
for _k, _c in enumerate((string.ascii_letters + string.digits + "+/_=-").encode()):
    _CODE[_c] = min(_k, _SIZE - 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _trigrams(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of c1 c2 c3, index of the string) of all strings, each with two start marks."""
    codes, owner = [], []
    for k, s in enumerate(strings):
        c = np.concatenate([[_SIZE - 1, _SIZE - 1], _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]])
        codes.append((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:])
        owner.append(np.full(len(c) - 2, k))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owner)


def _log_model(strings: list[str]) -> np.ndarray:
    """Log probability of each character after two others, interpolated with one and none."""
    grams, _ = _trigrams(strings)
    three = np.bincount(grams, minlength=_SIZE**3).reshape(_SIZE, _SIZE, _SIZE).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + _SIZE)
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    p3 = (three + 8 * p2[None]) / (three.sum(2, keepdims=True) + 8)
    return np.log(p3).reshape(-1)


@dataclass
class MarkovScorer:
    ratio: np.ndarray
    threshold: float

    def scores(self, strings: list[str]) -> np.ndarray:
        grams, owner = _trigrams(strings)
        n = np.bincount(owner, minlength=len(strings))
        return np.bincount(owner, weights=self.ratio[grams], minlength=len(strings)) / np.maximum(n, 1)


def identifiers(words: list[str], n: int, seed: int) -> list[str]:
    """``n`` identifiers of the usual shapes, made of the words."""
    rng = np.random.default_rng(seed)
    number = lambda: str(int(rng.integers(0, 10 ** int(rng.integers(1, 5)))))
    hexed = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    out = []
    for k in range(n):
        some = [words[j] for j in rng.integers(0, len(words), int(rng.integers(2, 5)))]
        low, high = [w.lower() for w in some], [w.capitalize() for w in some]
        tail = number() if rng.random() < 0.3 else ""
        shape = k % 12
        if shape == 11:
            text = "-".join(hexed(m) for m in (8, 4, 4, 4, 12))
            text = text.upper() if rng.random() < 0.2 else text
        elif shape == 10:
            text = f"20{rng.integers(10, 40)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}-{rng.integers(0, 60):02d}Z"
        elif shape == 9:
            text = "-".join([*low[:2], number(), number(), number()])
        elif shape >= 7:
            text = "/" * int(shape == 7) + "/".join(rng.choice([a, b]) for a, b in zip(low, high, strict=True)) + tail
        elif shape == 6:
            text = "-".join(low) + ("-" + tail if tail else "")
        elif shape == 5:
            text = "_".join(low).upper() + ("_" + tail if tail else "")
        elif shape >= 3:
            text = "_".join(low) + ("_" + tail if tail else "")
        elif shape == 2:
            text = "".join(low) + tail
        else:
            text = "".join(high if shape else [low[0], *high[1:]]) + tail
        out.append(text)
    return out


def train(secrets: list[str], ordinary: list[str], seed: int = 11) -> MarkovScorer:
    """Fit both models; the threshold lies above nearly all held-out identifiers and below most random strings."""
    rng = np.random.default_rng(seed)
    random = ["".join(rng.choice(list(_ALPHABETS[k % len(_ALPHABETS)]), int(rng.integers(20, 65)))) for k in range(RANDOM_STRINGS)]
    half = len(ordinary) // 2
    # the held-out half knows other words, so that its identifiers are new as well
    learnt = ordinary[:half] + identifiers([*ordinary[:half][:SHAPED_WORDS], *IDENTIFIER_WORDS[::2]], IDENTIFIERS_MADE, seed)
    new = ordinary[half:] + identifiers([*ordinary[half:][:SHAPED_WORDS], *IDENTIFIER_WORDS[1::2]], IDENTIFIERS_MADE // 4, seed + 1)
    scorer = MarkovScorer(_log_model(random[::2] + secrets) - _log_model(learnt), 0.0)
    held = scorer.scores([s for s in new if len(s) >= 12])
    high = scorer.scores(random[1::2])
    scorer.threshold = max(float(np.quantile(held, IDENTIFIERS, method="lower")) + 0.05, float(np.quantile(high, 0.02)) / 2, 0.5)
    return scorer


def ordinary_words(text: str) -> list[str]:
    """The words of a text, without the pieces of what may be a key: long runs with digits."""
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        if len(run) < 12 or not DIGIT.search(run):
            out += WORD.findall(run)
    return out


def labelled_sample(documents: DataFrame, limit: int = SAMPLE_DOCS) -> tuple[list[str], list[str]]:
    """(secret values, ordinary words) of about ``limit`` documents, drawn by hash of doc_id.

    Only documents of at most ``SAMPLE_CHARS`` characters are drawn, so the sample has a fixed size.
    """
    rows = by_hash(documents.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS), limit).collect()
    secrets, ordinary = set(), set()
    for row in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"])):
        spans, at, text = base_spans(row["text"]), 0, row["text"]
        for start, kind, end in spans:
            m = ASSIGN.match(text, start, end) if kind == 0 else None
            secrets.add(m.group(2) if m else text[start:end])
            ordinary.update(ordinary_words(text[at:start]))
            at = max(at, end)
        ordinary.update(ordinary_words(text[at:]))
    order = sorted(ordinary, key=lambda s: hashlib.md5(s.encode()).digest())
    return sorted(secrets), order


def all_spans(text: str, scorer: MarkovScorer) -> list[tuple[int, int, int]]:
    """Base spans and, outside them, the runs that look random."""
    found = base_spans(text)
    runs, at = [], 0
    for start, end in [*((s, e) for s, _, e in found), (len(text), len(text))]:
        for m in CANDIDATE.finditer(text, at, max(at, start)):
            run = m.group()
            if run.isalpha() and (run.islower() or run.istitle()) or len(run) < NUMBER and not LETTER.search(run):
                continue
            runs.append((m.start(), 3, m.end()))
        at = max(at, end)
    if runs:
        keep = scorer.scores([text[a:b] for a, _, b in runs]) > scorer.threshold
        found = sorted(found + [r for r, k in zip(runs, keep, strict=True) if k])
    return found


def scan(documents: DataFrame, scorer: MarkovScorer) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for each row.

    Null text counts as empty: no spans and the digest of the empty string.  Null doc_id
    stays null, repeated rows give equal rows, an empty table gives none, other columns are
    not read.  Ties in start go by the order of ``KINDS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, digests, texts = [[], [], [], []], [], []
                for text in part.column(1).to_pylist():
                    spans = all_spans(text or "", scorer)
                    for k in range(4):
                        counts[k].append(sum(s[1] == k for s in spans))
                    base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3)
                    digests.append(hashlib.sha256(base.encode()).hexdigest())
                    texts.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
                yield pa.record_batch({"doc_id": part.column(0), "n_assign": pa.array(counts[0], pa.int64()), "n_access": pa.array(counts[1], pa.int64()), "n_hex": pa.array(counts[2], pa.int64()), "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(texts, pa.string()), "n_markov": pa.array(counts[3], pa.int64())})

    rows = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_markov bigint")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(documents, train(*labelled_sample(documents)))
