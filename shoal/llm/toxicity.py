"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding: lower case, accents off, homoglyphs of other alphabets and digits or signs that stand
for letters become those letters, what is no letter parts words. The lexicon holds whole words
and word beginnings (``PREFIX`` letters), each weighted by the log-odds between labelled
toxic and other texts; entries must beat chance at one in as many as were tried. Matches inside
exception phrases don't count. Distinct matched weights are summed, divided by a power of the
length, and a logistic curve, fitted on the same labelled rows, gives the score.

Training reads at most ``TRAIN_ROWS`` labelled rows (a share by hash of doc_id; exact copies once), so the lexicon, which is
broadcast, doesn't grow with the corpus; it has every entry that passes, each of which at least ``LEAST_TEXTS`` of those rows hold. Everything else
covers all rows. Evidence over 10 counts as 10, where the curve is flat. null and empty texts score like texts without a match.
Repeated rows: each gives its own. Without labels of both kinds the lexicon is empty and every score is 0. Other columns
don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import materialize, slices

TRAIN_ROWS = 200_000
PREFIX = (4, 5, 6)
LEAST_TEXTS, PURITY = 4, 0.75
LIMIT = 0.3
#: Characters that look like Latin letters, and digits and signs used for them.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "sore loser", "moron mountain")


class Fold(dict):
    """A translation table that decomposes and folds what it is asked for first."""

    def __missing__(self, c: int) -> str:
        out = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        out = "".join(HOMOGLYPHS.get(x, x) for x in out)
        self[c] = out if out.isascii() and out.isalpha() else (chr(c) if chr(c).isalnum() else " ")
        return self[c]


_FOLD = Fold({c: chr(c) if chr(c).isalnum() or chr(c) in DIGITS else " " for c in range(128)} | {ord(k): v for k, v in HOMOGLYPHS.items()})
_LETTER, _MIXED = re.compile(r"[a-z]"), re.compile(r"[0-9@$!]")
_LEET = str.maketrans(DIGITS)
_TOKEN = re.compile(r"\S*[0-9@$!]\S*")


def _unleet(m: re.Match) -> str:
    """Digits stand for letters only inside a word that has letters; a trailing ! never does."""
    w = m[0].rstrip("!")
    return w.translate(_LEET) if _LETTER.search(w) else " "


def fold(text: str | None) -> str:
    """Folded words, one blank before, between and after."""
    out = (text or "").lower().translate(_FOLD)
    if _MIXED.search(out):
        out = _TOKEN.sub(_unleet, out)
    return f" {' '.join(out.split())} "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    power: float = 0.25
    a: float = -30.0
    b: float = 0.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for w, x in self.weights.items():
            out.add_word(w, (w, x))
        for e in self.exceptions:
            out.add_word(f" {e} ", (f" {e} ", None))
        out.make_automaton()
        return out


def evidence(auto, folded: str, power: float) -> float:
    """The summed weights of distinct matches outside exceptions, over words ** power."""
    hits, outside = [], []
    for end, (w, x) in auto.iter(folded):
        (outside if x is None else hits).append((end - len(w) + 1, end, w, x))
    if not hits:
        return 0.0
    best: dict[int, tuple[str, float]] = {}
    for a, b, w, x in hits:
        if not any(s <= a and b <= e for s, e, _, _ in outside) and (a not in best or best[a][1] < x):
            best[a] = (w, x)  # of entries that begin at the same place, the heaviest
    return sum({w: x for w, x in best.values()}.values()) / max(1, folded.count(" ") - 1) ** power


def features(folded: str) -> set[str]:
    """Candidate entries of a text: whole words, and beginnings of longer ones."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIX if len(w) >= k)
    return out


def training(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled rows whose crc32(doc_id as text) mod 4 isn't 2, exact copies once.

    Which rows these are is found without their texts; they then come by a broadcast of their ids, which ``most`` bounds.
    """
    marks = labels.select("doc_id", "toxic").na.drop().filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    slim = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).join(marks, "doc_id")
    once = materialize(slim.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct())
    n = once.count()
    if n > most:  # the same share of every kind of row
        slot = 1_000_000_000
        once = once.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slot)) < int(slot * most / n)).limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(once), "doc_id")


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from ``training``'s rows. Every count is a Spark aggregation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[dict, dict] = ({}, {})
        size = [0, 0]

        def out() -> Iterator[pa.RecordBatch]:
            for t, own in enumerate(both):
                if own or size[t]:
                    keys = ["", *own]
                    yield pa.record_batch({"entry": pa.array(keys, pa.string()), "toxic": pa.array([t] * len(keys), pa.int32()), "n": pa.array([size[t], *own.values()], pa.int64())})
                own.clear()
                size[t] = 0

        for b in slices(batches, "text"):
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = int(t > 0)
                own = both[t]
                size[t] += 1
                for w in features(fold(text)):
                    own[w] = own.get(w, 0) + 1
            if len(both[0]) + len(both[1]) > 400_000:
                yield from out()
        yield from out()

    counts = rows.select("text", "toxic").mapInArrow(count, "entry string, toxic int, n long").groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"))
    counts = counts.filter((F.col("t") >= LEAST_TEXTS) & (F.col("t") >= PURITY * (F.col("t") + F.col("o"))) | (F.col("entry") == ""))
    counts = materialize(counts)
    total = counts.filter("entry = ''").select("t", "o").first()
    if not total or not total.t or not total.o:
        return Lexicon()
    base = total.t / (total.t + total.o)
    p = (F.col("t") / (F.col("t") + F.col("o"))).cast("double")
    # the log-likelihood ratio against the base rate must beat the number of entries tried
    gain = F.col("t") * F.log(p / base) + F.col("o") * F.log(F.greatest(1 - p, F.lit(1e-9)) / (1 - base))
    tried = max(10, counts.count())
    weight = F.log((F.col("t") + 0.5) / (total.t + 1)) - F.log((F.col("o") + 0.5) / (total.o + 1))
    best = counts.filter("entry <> ''").select("entry", weight.alias("w"), gain.alias("gain")).filter(F.col("gain") >= math.log(tried) + 2).orderBy(F.desc("gain"), "entry").collect()
    lex = Lexicon({r.entry: float(r.w) for r in best})
    if not lex.weights:
        return lex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for b in slices(batches, "text"):
            yield pa.record_batch({"x": pa.array([evidence(auto, fold(t), lex.power) for t in b.column(0).to_pylist()], pa.float64()), "toxic": b.column(1)})

    # the curve is fitted to counts in 1,000 bins, so what the driver gets is bounded
    bins = rows.select("text", "toxic").mapInArrow(score, "x double, toxic int").groupBy(F.least(F.round("x", 2), F.lit(10.0)).alias("x")).agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.count("*").alias("n")).collect()
    x, t, m = (np.array([float(r[k]) for r in bins]) for k in ("x", "t", "n"))
    lex.a, lex.b = logistic(x, t, m)
    return lex


def logistic(x: np.ndarray, t: np.ndarray, m: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """(a, b) of sigmoid(a + b x) for t of m at each x, by Newton steps; a small penalty keeps separable data finite."""
    a = b = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -35, 35)))
        g = np.array([(t - m * p).sum() - ridge * a, ((t - m * p) * x).sum() - ridge * b])
        w = m * p * (1 - p)
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1, 5 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _scorer(lex: Lexicon):
    auto = lex.automaton()

    def score(texts: list[str | None]) -> np.ndarray:
        x = np.array([evidence(auto, fold(t), lex.power) for t in texts])
        return 1 / (1 + np.exp(-np.clip(lex.a + lex.b * np.minimum(x, 10), -35, 35)))

    return score


def scored(docs: DataFrame, lex: Lexicon, limit: float = LIMIT) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for b in slices(batches):
            s = score(b.column(1).to_pylist())
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(s), "predicted": pa.array((s >= limit).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, lex: Lexicon, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for b in slices(batches):
            yield b.filter(pa.array(score(b.column(at).to_pylist()) < limit))

    return docs.mapInArrow(run, docs.schema)
