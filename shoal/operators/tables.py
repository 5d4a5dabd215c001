"""Keyed tables: upserts, latest rows, as-of joins, bounds, work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: str = "replace", order: str | None = None) -> DataFrame:
    """``new`` wins by key. replace: whole rows, unlisted columns become null; coalesce: only new values that aren't null; insert: only keys that aren't held.

    Of several new rows with one key the one with the greatest ``order`` counts, by default the greatest row. null keys are keys like others.
    """
    rest = [c for c in old.columns if c not in keys]
    new = newest_row(new, keys, order)
    wide = new.select(*keys, *(F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in rest))
    if policy not in ("replace", "coalesce", "insert"):
        raise ValueError(f"unknown policy {policy!r}")
    a, b = old.select(*keys, F.struct(*rest, F.lit(1).alias("_")).alias("_old")), wide.select(*keys, F.struct(*rest, F.lit(1).alias("_")).alias("_new"))
    b = b.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    x = a.join(b, same, "full_outer").select(*(F.when(F.col("_old").isNull(), F.col(f"_k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)), "_old", "_new")
    if policy == "coalesce":
        return x.select(*keys, *(F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) for c in rest))
    first, second = ("_new", "_old") if policy == "replace" else ("_old", "_new")
    return x.withColumn("_r", F.coalesce(first, second)).select(*keys, *(F.col(f"_r.{c}") for c in rest))


def newest_row(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: the one with the greatest ``order``, equal ones by the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    by = F.struct(*([F.col(order)] if order else []), *rest)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, *(F.col(f"_r.{c}") for c in rest))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; one aggregation, combined map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}") for c in rest))


def at_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows of each key at its greatest ``order``."""
    return rows.join(rows.groupBy(*keys).agg(F.max(order).alias(order)), [*keys, order], "left_semi")


def as_of(left: DataFrame, events: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last event of its key at or before its time: a union and a running last value."""
    pack = F.struct(*values)
    kind = events.select(pack.alias("v")).schema["v"].dataType
    both = left.withColumn("_v", F.lit(None).cast(kind)).withColumn("_left", F.lit(1))
    both = both.unionByName(events.select(key, time, pack.alias("_v")).withColumn("_left", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_left = 1")
    return out.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def bounds(bars: DataFrame) -> DataFrame:
    return bars.groupBy("code").agg(F.min("dt").alias("first"), F.max("dt").alias("last"))


def within_bounds(rows: DataFrame, limits: DataFrame, flag: str) -> DataFrame:
    """``flag`` and listed on that date; codes without bounds are not."""
    inside = F.coalesce(F.col("dt").between(F.col("first"), F.col("last")), F.lit(False))
    return rows.join(limits, "code", "left").withColumn(flag, F.col(flag) & inside).drop("first", "last")


def missing_history(universe: DataFrame, bars: DataFrame, least: int) -> DataFrame:
    """Codes of the universe that have fewer than ``least`` bars."""
    return universe.select("code").distinct().join(bars.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "code", "left_anti")


def fresh_bars(new: DataFrame, held: DataFrame) -> DataFrame:
    """Only bars newer than their code's last one; unseen codes are fresh."""
    last = held.groupBy("code").agg(F.max("dt").alias("_last"))
    return new.join(last, "code", "left").filter(F.col("_last").isNull() | (F.col("dt") > F.col("_last"))).drop("_last")


def gaps(bars: DataFrame, days: int = 1) -> DataFrame:
    """(code, last, lag) of codes whose last bar is more than ``days`` days behind the newest of all."""
    newest = bars.agg(F.max("dt").alias("_now"))  # one row
    last = bars.groupBy("code").agg(F.max("dt").alias("last")).crossJoin(F.broadcast(newest))
    return last.select("code", "last", F.datediff("_now", "last").alias("lag")).filter(F.col("lag") > days)


def period_date(period: Column) -> Column:
    """A quarter's end, written with or without hyphens; null for other forms."""
    return F.coalesce(F.try_to_date(period, "yyyyMMdd"), F.try_to_date(period, "yyyy-MM-dd"))
