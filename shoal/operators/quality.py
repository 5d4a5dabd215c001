"""Fundamentals as they were known: which codes were sound on which date, and repairs of missing ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


def sound(min_circ_mv: float = 3e9, min_roe: float = 0.0, max_debt: float = 85.0, min_profit_yoy: float | None = None) -> Column:
    """Not under special treatment, large enough (unknown: not), and nothing known against it."""
    unless = lambda ok: F.coalesce(ok, F.lit(True))
    out = ~F.coalesce("st", F.lit(False)) & (F.coalesce("circ_mv", F.lit(0.0)) >= min_circ_mv) & unless(F.col("roe") >= min_roe) & unless(F.col("debt") <= max_debt)
    return out if min_profit_yoy is None else out & unless(F.col("profit_yoy") >= min_profit_yoy)


def disclosed(days: int = 30) -> Column:
    """The day a report is known from: its own, or some days after its period."""
    return F.coalesce("as_of", F.date_add("period", days))


def quality_panel(grid: DataFrame, reports: DataFrame, bars: DataFrame, ok: Column) -> DataFrame:
    """(code, dt, ok) of every row of ``grid``: what the newest report known by that date says, while the code is listed.

    reports: (code, period, as_of, and what ``ok`` reads). Of reports known from the same day the latest period counts.
    Without a report or bars a code isn't ok.
    """
    known = reports.select("code", disclosed().alias("dt"), "period", ok.alias("ok"))
    newest = tables.latest(known, ["code", "dt"], "period").select("code", "dt", "ok")
    x = tables.as_of(grid.select("code", "dt"), newest, "code", "dt", ["ok"]).withColumn("ok", F.coalesce("ok", F.lit(False)))
    return tables.within_bounds(x, tables.bounds(bars), "ok")


def masked(panel: DataFrame, quality: DataFrame, values: list[str]) -> DataFrame:
    """``panel`` with null for the values of codes that weren't ok on that date."""
    flags = quality.filter("ok").select("code", "dt", F.lit(True).alias("_ok"))
    return panel.join(flags, ["code", "dt"], "left").withColumns({v: F.when(F.col("_ok"), F.col(v)) for v in values}).drop("_ok")


def debt_ratio(liabilities: Column, assets: Column) -> Column:
    """Percent with four places; null outside 0 to 300."""
    x = F.round(F.try_divide(liabilities, assets) * 100, 4)
    return F.when(x.between(0, 300), x)


def filled(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``old`` with values of ``new`` only where ``column`` is null; no rows are added."""
    found = new.groupBy(*keys).agg(F.max(column).alias("_new"))
    return old.join(found, keys, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def incomplete(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, known, n) of keys with rows that lack ``column``."""
    return rows.groupBy(key).agg(F.count(column).alias("known"), F.count("*").alias("n")).filter("known < n")
