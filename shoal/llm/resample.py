"""Importance resampling towards a target distribution, by hashed n-grams.

Identical texts are collapsed first: texts are grouped whole, so that features are taken once for each and counted
as often as the text occurs. The features of all documents and of all target texts are summed by
bucket; a bucket's gain is the logarithm of how much likelier the target is to draw it, in thousandths. A text's weight is
the sum of its features' gains; weights are joined back to the documents by the text's SHA-256 digest. Each
document then gets Gumbel noise of its own doc_id, and the highest scores are drawn without replacement.

Every distinct text is read twice (sums, then weights), numbers only are kept of documents. A group of
copies costs one row in the shuffle. Texts that a share of 1 / ``HOT`` of all documents or more have are at most
``HOT`` in number, so their weights are broadcast; all others meet by a shuffle in which no key is hot. Ranks
of drawn documents come from quantiles of their scores: each stretch between two is ordered by itself.

null texts are empty ones: no words, no features, weight 0. A null doc_id has the noise of an empty one. Repeated
rows: each counts, and each gives its own row; rows with one score and one doc_id follow in any order. Other columns
of the documents don't matter. Without documents the result is empty; without target texts all gains come from the corpus alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, NOT_WORD, discard, flat, materialize, slices, spans

BUCKETS, LONGEST, LEAST_WORDS = 10_000, 3, 20
HOT = 4096
STRETCH, STRETCHES = 2000, 4096
SLICE = 1 << 20
FULL = np.uint32(0xFFFFFFFF)
_SHORT = 64


def _crc_table() -> np.ndarray:
    """The register after each byte, from zero: CRC-32 with the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def extend(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers carried on over each data[start:end]; rows by falling length, so that those still going are a prefix."""
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    out, at, left = register[order], starts[order], lens[order]
    most = int(left[0]) if len(left) else 0
    going = np.searchsorted(-left, -np.arange(min(most, _SHORT)), "left")
    for k, m in enumerate(going):
        out[:m] = CRC[(out[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ out[:m] >> np.uint32(8)
    for i in range(int(np.searchsorted(-left, -_SHORT, "left"))):
        rest = data[at[i] + _SHORT : at[i] + left[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i] ^ FULL)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all runs of 1 to LONGEST words, the row of each, words by row)."""
    data, offs = flat(column)
    data = LOWER[data]
    starts, ends, counts = spans(data, offs, NOT_WORD)
    row = np.repeat(np.arange(len(counts)), counts)
    register = extend(np.full(len(starts), FULL), data, starts, ends)
    buckets, rows, n = [register ^ FULL], [row], len(starts)
    for k in range(1, LONGEST):
        first = np.flatnonzero(row[: n - k] == row[k:]) if n > k else np.zeros(0, np.int64)
        before = np.zeros(n, np.uint32)
        before[first] = register[first]
        spaced = CRC[(before[first] ^ np.uint32(32)) & np.uint32(255)] ^ before[first] >> np.uint32(8)
        register = np.zeros(n, np.uint32)
        register[first] = extend(spaced, data, starts[first + k], ends[first + k])
        buckets.append(register[first] ^ FULL)
        rows.append(row[first])
    return np.concatenate(buckets) % np.uint32(BUCKETS), np.concatenate(rows), counts


def distinct(texts: DataFrame) -> DataFrame:
    """(text, digest, copies) of the texts, each once."""
    x = texts.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return x.select("text", digest(F.col("text")).alias("digest"), "copies")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def bucket_sums(texts: DataFrame) -> DataFrame:
    """(bucket, n) over (text, copies); each task adds up its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches, most=SLICE):
            buckets, row, _ = features(b.column(0))
            copies = b.column(1).to_numpy()
            if copies.max() == 1:
                total += np.bincount(buckets, minlength=BUCKETS)
            else:
                np.add.at(total, buckets, copies[row])
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return texts.select("text", "copies").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, in thousandths; BUCKETS rows come to the driver."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for sums, to in ((corpus, s), (target, t)):
        for r in sums.collect():
            to[r["bucket"]] = r["n"]
    odds = ((t + 1) * float(t.size + s.sum())) / ((s + 1) * float(t.size + t.sum()))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, copies, words, n_features, weight) of (text, digest, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            buckets, row, words = features(b.column(0))
            total = np.zeros(len(words), np.int64)
            np.add.at(total, row, gain[buckets])
            yield pa.record_batch([b.column(1), b.column(2), pa.array(words.astype(np.int64)), pa.array(np.bincount(row, minlength=len(words)).astype(np.int64)), pa.array(total)], ["digest", "copies", "words", "n_features", "weight"])

    return texts.select("text", "digest", "copies").mapInArrow(run, "digest binary, copies long, words long, n_features long, weight long")


def joined(docs: DataFrame, weighed: DataFrame) -> DataFrame:
    """(doc_id, words, n_features, weight) of every document, from the weights of its text."""
    total = weighed.agg(F.sum("copies")).first()[0] or 0
    most = max(1, total // HOT)
    values = ["words", "n_features", "weight"]
    hot = weighed.filter(F.col("copies") > most).select(F.col("digest").alias("d"), F.struct(*values).alias("a"))  # fewer than HOT rows
    cold = weighed.filter(F.col("copies") <= most).select(F.col("digest").alias("e"), F.struct(*values).alias("b"))
    x = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(F.broadcast(hot), F.col("digest") == F.col("d"), "left")
    # a document that has met its text is dealt by its own id
    key = F.when(F.col("a").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id"))))
    x = x.withColumn("key", key).join(cold, F.col("key") == F.col("e"), "left").withColumn("w", F.coalesce("a", "b"))
    return x.select("doc_id", *(F.col(f"w.{v}") for v in values))


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, from the digest of the seed and the doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` (doc_id, score, ...) with ``rank`` from 1 for the highest ``percent`` of the eligible rows, null for all others."""
    n = scored.agg(F.count_if(eligible)).first()[0]
    many = percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if not many:
        return scored.select("*", none)
    parts = int(min(max(many // STRETCH, 8), STRETCHES))
    shares = [1 - 1.1 * percent / 100 * k / parts for k in range(1, parts + 1)]
    cuts = np.unique(scored.filter(eligible).agg(F.percentile_approx("score", F.array(*map(F.lit, shares)), F.lit(100_000)).alias("cuts")).first()["cuts"])

    @F.pandas_udf("int")
    def place(score: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, score.to_numpy(), "right"))

    x = scored.withColumn("stretch", F.when(eligible, place("score")))
    held = {r["stretch"]: r["count"] for r in x.filter("stretch is not null").groupBy("stretch").count().collect()}
    before = np.cumsum([0] + [held.get(k, 0) for k in range(len(cuts) + 1)])
    last = int(np.searchsorted(before, many, "left")) - 1
    inside = F.coalesce(F.col("stretch") <= last, F.lit(False))
    ahead = F.element_at(F.array(*(F.lit(int(b)) for b in before)), F.col("stretch") + 1).cast("long")
    w = Window.partitionBy("stretch").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = x.filter(inside).withColumn("rank", ahead + F.row_number().over(w)).withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return best.unionByName(x.filter(~inside).select("*", none)).drop("stretch")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``percent`` of those with ``least_words`` words or more are drawn."""
    texts = materialize(distinct(docs))
    gain = gains(bucket_sums(texts), bucket_sums(distinct(target)))
    weighed = materialize(weights(texts, gain))
    x = joined(docs, weighed)
    scored = materialize(x.withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    discard(texts, weighed)
    return drawn(scored, F.col("words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
