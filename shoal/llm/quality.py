"""Quality by hierarchical empirical Bayes.

A logistic classifier on surface features gives each document's evidence. Labels and that
evidence are summed by host and by path (one aggregation each), and every site's quality rate is
shrunk: a path towards its host, a host towards the global rate, by Beta priors whose strength is
estimated from the spread between sites (method of moments). A document's posterior log-odds are
its own evidence plus what its path's rate adds to the global one.

``host``: the source up to the first slash. ``path``: the source up to the second slash and the
language, as one site writes each language in a section of its own. null sources and languages
are a site of their own. The classifier is fitted to at most ``TRAIN_ROWS`` labelled rows (least
hash of doc_id); rates cover all rows. null and empty texts have zero features. Repeated
rows: each gives its own. Without labels of both kinds every posterior is the prior, 1/2, and all are kept.
Other columns don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANK, LOWER, flat, free, materialize, slices, span_hash, spans

TRAIN_ROWS = 50_000
KEEP = 0.5
FEATURES = ["upper", "symbol", "digit", "repeat", "tail", "bars", "marks", "long", "short", "size"]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",.;:'\"-()"]] = True


def surface(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offs = flat(column)
    starts, ends, counts = spans(data, offs, BLANK)
    n = len(counts)
    h = span_hash(LOWER[data], starts, ends)
    words, size = np.maximum(counts, 1), np.maximum(np.diff(offs), 1)
    row = np.repeat(np.arange(n), counts)

    def share(mask: np.ndarray, over: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mask)][offs]) / over

    def by_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=n) / words

    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    lens = ends - starts
    last = data[np.maximum(ends - 1, 0)] if len(ends) else data[:0]
    tail = _SYMBOL[last]
    first = data[starts] if len(starts) else data[:0]
    bars = (lens == 1) & _SYMBOL[first]
    marks = tail & (lens > 1) & _SYMBOL[data[np.maximum(ends - 2, 0)]] if len(ends) else tail
    upper = _UPPER[data]
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] < 0x9F) & (data[1:] >= 0x80)
    return np.column_stack([share(upper, size), share(_SYMBOL[data], size), share(_DIGIT[data], size), by_word(same), by_word(tail), by_word(bars), by_word(marks), by_word(lens > 14), by_word(lens <= 2), np.log1p(counts) / 10])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge logistic regression by damped Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pen = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * w)
        step *= min(1, 3 / max(1e-9, float(np.abs(step).max())))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def seen() -> Column:
    """A hash of all that a row's posterior comes from; nulls are told from other values, and by where they stand."""
    parts = F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string")
    return F.xxhash64(*(x for c in parts for x in (c.isNull(), c)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, path, features and a hash of what they come from, of every row, written once."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    host = F.substring_index(source, "/", 1)
    path = F.concat_ws(" ", F.substring_index(source, "/", 2), F.coalesce(F.col("lang").cast("string"), F.lit("")))
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), "text", seen().alias("seen"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, path string, x array<double>, seen long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = surface(b.column(3))
            offs = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.record_batch({"doc_id": b.column(0), "host": b.column(1), "path": b.column(2), "x": pa.ListArray.from_arrays(pa.array(offs), pa.array(x.ravel())), "seen": b.column(4)})

    return materialize(rows.mapInArrow(run, kinds))


def strength(rates: DataFrame, n: str, k: str, low: float = 2.0, high: float = 1000.0) -> tuple[float, float]:
    """(rate, prior strength) of sites with k of n good, by the method of moments over all sites."""
    r = F.col(k) / F.col(n)
    total = rates.filter(F.col(n) > 0).agg(F.sum(k), F.sum(n), F.count("*"), F.sum(F.col(n) * F.col(n)), F.sum(F.col(n) * r * r)).first()
    if not total[1]:
        return 0.5, low
    mean = min(max(total[0] / total[1], 1e-3), 1 - 1e-3)
    if total[2] < 2:
        return mean, high
    between = total[4] - total[1] * mean * mean  # sum of n (r - mean)^2
    noise = (total[2] - 1) * mean * (1 - mean)
    spread = (between - noise) / max(total[1] - total[3] / total[1], 1e-9)
    return mean, high if spread <= 0 else float(min(max(mean * (1 - mean) / spread - 1, low), high))


def posterior(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, path_rate, posterior, keep of every row."""
    return judged(docs, labels, train_rows, keep).drop("seen")


def judged(docs: DataFrame, labels: DataFrame, train_rows: int, keep: float) -> DataFrame:
    rows = measured(docs)
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).na.drop().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = materialize(rows.join(marks, "doc_id"))
    n = marked.count()
    part = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n)) if n > train_rows else marked
    sample = part.select("x", "quality").limit(train_rows + train_rows // 20).toArrow() if n else None
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(FEATURES)) if n else np.zeros((0, len(FEATURES)))
    y = (np.array(sample.column("quality").to_pylist()) > 0).astype(float) if n else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return rows.select("doc_id", "seen", F.lit(0.0).alias("evidence"), F.lit(0.5).alias("path_rate"), F.lit(0.5).alias("posterior"), F.lit(True).alias("keep"))
    mean, scale, w = fit(x, y)
    z = lambda k: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("x")[k] - float(mean[k])) / float(scale[k]))) * float(w[k])
    logit = sum((z(k) for k in range(1, len(FEATURES))), z(0)) + float(w[-1])
    clip = lambda c: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c))
    soft = lambda c: 1 / (1 + F.exp(-c))
    lo = F.log(F.lit(float(y.mean()) / (1 - float(y.mean()))))
    scored = rows.select("doc_id", "seen", "host", "path", clip(logit).alias("logit"))
    sites = scored.groupBy("host", "path").agg(F.count("*").alias("docs"), F.sum(soft(F.col("logit"))).alias("soft"))
    known = marked.groupBy("host", "path").agg(F.count("*").alias("n_marked"), F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum(soft(clip(logit))).alias("soft_marked"))
    # labelled documents count by their label, all others by the classifier's evidence
    sites = materialize(sites.join(known, ["host", "path"], "left").select("host", "path", F.col("docs").cast("double").alias("n"), (F.col("soft") - F.coalesce("soft_marked", F.lit(0.0)) + F.coalesce("good", F.lit(0))).alias("k")))
    hosts = sites.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"))
    rate, a_host = strength(hosts, "host_n", "host_k")
    _, a_path = strength(sites, "n", "k")
    hosts = hosts.select("host", ((F.col("host_k") + a_host * rate) / (F.col("host_n") + a_host)).alias("host_rate"))
    shrunk = sites.join(hosts, "host").select("host", "path", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), (F.col("k") + a_path * F.col("host_rate")) / (F.col("n") + a_path))).alias("path_rate"))
    shift = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(rate / (1 - rate)))
    out = scored.join(shrunk, ["host", "path"]).select("doc_id", "seen", (F.col("logit") - lo).alias("evidence"), "path_rate", soft(F.col("logit") + shift).alias("posterior"))
    return out.withColumn("keep", F.col("posterior") >= keep)


def drop_poor(docs: DataFrame, labels: DataFrame, *, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't rejected; each by its own text and site, whatever other rows have its doc_id or none."""
    bad = judged(docs, labels, TRAIN_ROWS, keep).filter("not keep").select(F.col("doc_id").alias("__bad"), F.col("seen").alias("__seen")).distinct()
    own = free(docs, "__own")
    out = docs.withColumn(own, seen())
    return out.join(bad, out["doc_id"].eqNullSafe(bad["__bad"]) & (out[own] == bad["__seen"]), "left_anti").drop(own)
