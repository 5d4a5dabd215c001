"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

A document's size is its number of words. Sources in order of code point, null last, weigh ``WEIGHTS``, repeating, and
share the size of the whole corpus by weight; no target goes beyond ``MOST`` times its source's size, and what is over goes
to the other sources by weight. Of each source all documents are taken as often as its target holds it whole (complete
epochs); the rest is a sample without replacement: each document has an exponential key divided by its quality
weight, keys are sorted within the source, and documents are taken while they fit the rest of the budget by more
than half. A source's taken words thus differ from its target by half a document at most.

Prefix sums go in two levels, as one source may hold most rows: keys fall into bins of their logarithm. Whatever the
weights, no bin holds more than 1 / (e x ``FINE``) of a source's expected rows, and a source has some 40 x ``FINE``
bins at most. Sums of bins are added up by source, documents by bin. One row a source goes to one task for the targets.

null texts are empty ones, of size 0: taken holds 0. Keys come from doc_id and text, so copies have keys of their own, null doc_ids
too; repeated rows have one key and are taken one after the other. null and empty sources are two
sources. Other columns don't matter, and without documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, FINE, SEED = (5, 2, 1), 3, 1024, 42


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, words: Column) -> Column:
    """From 0.1 to 1: falls as the letters a word differ from six (sign heaps, glued words), and for texts of few words."""
    per_word = F.length(text) / F.greatest(words, F.lit(1))
    usual = 1 / (1 + F.abs(F.ln(F.greatest(per_word, F.lit(1.0)) / 6)))
    return F.coalesce(F.greatest(F.lit(0.1), usual * words / (words + 20)), F.lit(0.1))


def exponential(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A standard exponential number that a document's id and text fix."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long")
    return -F.ln((h + 0.5) / float(1 << 52))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size): one row a source.

    Sources that reach their cap are those of the least cap by weight. Down that order, what is left of the whole by
    weight that is left falls until the first source that stays under its cap; all sources beyond take that level.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    x = sources.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * float(most))
    tightest = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before, all_ = tightest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    reached = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(tightest.rowsBetween(Window.unboundedPreceding, 0))
    return x.select("source", "source_size", F.when(reached.isNull(), F.col("cap")).otherwise(F.least("cap", reached * F.col("w"))).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document. ``weight``: of a document in the draw, over 0; by default its ``quality``."""
    x = docs.select("doc_id", "source", size(F.col("text")).alias("size"), exponential(F.col("doc_id"), F.col("text"), seed).alias("e"), *([] if weight is None else [weight.alias("q")]), "text")
    x = x.withColumn("key", F.col("e") / (quality(F.col("text"), F.col("size")) if weight is None else F.col("q")))
    x = materialize(x.select("doc_id", "source", "size", "key", F.floor(F.ln("key") * FINE).alias("bin")))
    bins = x.groupBy("source", "bin").agg(F.sum("size").alias("held"))
    plan = targets(bins.groupBy("source").agg(F.sum("held").alias("source_size")), weights, most).withColumnsRenamed({"source": "s"})
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = F.sum("held").over(Window.partitionBy("source").orderBy("bin")) - F.col("held")
    bins = bins.withColumn("before", before).join(plan, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bin").alias("b"), "source_size", "target", "epochs", "rest", "before")
    y = x.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    fits = 2 * upto - F.col("size") <= 2 * F.col("rest")
    taken = F.col("size") * F.least(F.col("epochs") + F.when(fits, 1).otherwise(0), F.lit(most))
    return y.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def mixed_sql() -> str:
    """The DuckDB twin: targets by recursion, caps added one source at a time, and one plain prefix sum a source."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_SIZE}::BIGINT AS size, length(text) AS chars,
 -ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[:13])::BIGINT + 0.5) / {1 << 52}) AS e FROM documents),
 k AS (SELECT *, e / coalesce(greatest(0.1, 1 / (1 + abs(ln(greatest(chars / greatest(size, 1), 1) / 6))) * size / (size + 20)), 0.1) AS key FROM d),
 s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
 w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
 c AS (SELECT *, row_number() OVER (ORDER BY 3.0 * z / w, source NULLS LAST) AS i FROM w),
 f AS (SELECT 1 AS i, (SELECT sum(z) FROM c)::DOUBLE AS lef, (SELECT sum(w) FROM c)::DOUBLE AS wl UNION ALL
  SELECT f.i + 1, lef - 3.0 * z, wl - w FROM f JOIN c USING (i) WHERE lef / wl * w > 3.0 * z),
 l AS (SELECT arg_max(lef / wl, i) AS lev FROM f WHERE wl > 0),
 t AS (SELECT source, z, least(3.0 * z, lev * w)::DOUBLE AS target FROM c, l),
 r AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END AS n FROM t),
 p AS (SELECT k.*, z, target, n, target - n * z AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN r ON r.source IS NOT DISTINCT FROM k.source)
 SELECT doc_id, size, z AS source_size, target, (size * least(n + (2 * upto - size <= 2 * rest)::INT, 3))::BIGINT AS taken FROM p"""
