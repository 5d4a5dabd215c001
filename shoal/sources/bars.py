"""Scans, and the panels that the driver's tables give: bars (code, dt, open, high, low, close, volume, amount).

Each adapter has a DuckDB twin in ``SQL``; a panel is dense, calendar x codes, so that window
frames count market dates and not a code's own bars.
"""

from __future__ import annotations

from bisect import bisect_right
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ["open", "high", "low", "close", "volume", "amount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of 20 codes from ``events``."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("code"), F.to_date("ts").alias("dt"), "ts", "value")
    return e.groupBy("code", "dt").agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"))


def _line_bars(spark: SparkSession, sf_dir: str, code, unit: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    x = table(spark, sf_dir, "lineitem").withColumns({"code": code.cast("string"), "dt": F.to_date(F.date_trunc(unit, "l_shipdate")), "px": F.col("l_extendedprice") / F.col("l_quantity")})
    return x.groupBy("code", "dt").agg(F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))


def week_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of 25 codes from ``lineitem``, with gaps."""
    return _line_bars(spark, sf_dir, F.col("l_suppkey") % 25, "week")


def month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of all suppliers."""
    return _line_bars(spark, sf_dir, F.col("l_suppkey"), "month")


def dates_of(rows: DataFrame, dt: str = "dt") -> list[date]:
    """The market dates of ``rows``, ascending: one row a date comes to the driver, for a trading calendar some 250 a year."""
    return sorted(r[0] for r in rows.select(dt).filter(F.col(dt).isNotNull()).distinct().collect())


def at_or_before(dates: list[date], day: date | None) -> date | None:
    """The last of ascending ``dates`` at or before ``day``; the last of all if there is no such date, or no day."""
    k = bisect_right(dates, day) if day else 0
    return dates[k - 1] if k else dates[-1] if dates else None


def densify(bars: DataFrame, dates: list[date] | None = None, key: str = "code") -> DataFrame:
    """Every code on every date of the calendar; ``is_bar`` tells bars from filler.

    No grid is joined: each bar writes the filler up to its code's next bar, and the first one what comes before it. Rows are
    dealt by ``key`` once, which the windows over the panel use again. (key, dt) is unique; ``dates``: the calendar, by default the dates of ``bars``.
    """
    spark = bars.sparkSession
    dates = dates_of(bars) if dates is None else dates
    if not dates:
        return bars.withColumn("is_bar", F.lit(True)).limit(0)
    places = spark.createDataFrame([(d, k) for k, d in enumerate(dates)], "dt date, _at int")
    w = Window.partitionBy(key).orderBy("_at")
    x = bars.join(F.broadcast(places), "dt")  # one row a date
    first = F.when(F.lag("_at").over(w).isNull(), 0).otherwise(F.col("_at"))
    x = x.withColumns({"_first": first, "_last": F.coalesce(F.lead("_at").over(w) - 1, F.lit(len(dates) - 1))})
    x = x.withColumn("_to", F.explode(F.sequence("_first", "_last")))
    own = F.col("_to") == F.col("_at")
    rest = [c for c in bars.columns if c not in (key, "dt")]
    day = F.date_add(F.lit(date(1970, 1, 1)), F.element_at(F.array(*(F.lit((d - date(1970, 1, 1)).days) for d in dates)), F.col("_to") + 1))
    return x.select(key, day.alias("dt"), *(F.when(own, F.col(c)).alias(c) for c in rest), own.alias("is_bar"))


#: Values that one task makes of a panel's rows, about.
CELLS = 1 << 20


def dealt(panel: DataFrame, factors: int, rows: int) -> DataFrame:
    """A panel of ``rows`` rows dealt by code over as many tasks as ``factors`` columns need, so that what a task sorts doesn't grow with the panel."""
    return panel.repartition(max(-(-rows * factors // CELLS), panel.sparkSession.sparkContext.defaultParallelism), "code")


def adjusted(bars: DataFrame, raw: DataFrame) -> DataFrame:
    """Adjusted bars, or all raw ones if there are no adjusted bars at all: never some of each.

    Whether there are any is one row, read with the rows themselves, so that no job runs before the query's own.
    """
    some = bars.limit(1).agg((F.count("*") > 0).alias("_any"))
    return bars.unionByName(raw.join(F.broadcast(some), ~F.col("_any")).drop("_any"))


def for_codes(bars: DataFrame, codes: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """The bars of some codes; with ``raw``, its bars of them if there are no adjusted bars of any of them."""
    own = codes.select("code").distinct()
    mine = bars.join(own, "code", "left_semi")
    return mine if raw is None else adjusted(mine, raw.join(own, "code", "left_semi"))


def of_code(bars: DataFrame, code: str) -> DataFrame:
    """One code's bars by date."""
    return bars.filter(F.col("code") == code).orderBy("dt")


_LINE = """SELECT {code}::VARCHAR AS code, date_trunc('{unit}', l_shipdate)::DATE AS dt,
 first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
 min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS "close",
 sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2"""
SQL = {
    "ev": """SELECT (user_id % 20)::VARCHAR AS code, ts::DATE AS dt, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, ts) AS "close", count(*)::DOUBLE AS volume, sum(value) AS amount FROM events GROUP BY 1, 2""",
    "sw": _LINE.format(code="(l_suppkey % 25)", unit="week"),
    "sm": _LINE.format(code="l_suppkey", unit="month"),
}
BARS = {"ev": event_bars, "sw": week_bars, "sm": month_bars}


def calendar(spark: SparkSession, sf_dir: str, kind: str) -> list[date]:
    """The dates of a panel, from the one column of the source that has them."""
    name, day = {"ev": ("events", F.to_date("ts")), "sw": ("lineitem", F.to_date(F.date_trunc("week", "l_shipdate"))), "sm": ("lineitem", F.to_date(F.date_trunc("month", "l_shipdate")))}[kind]
    return dates_of(table(spark, sf_dir, name).select(day.alias("dt")))


def panel(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return densify(BARS[kind](spark, sf_dir), calendar(spark, sf_dir, kind))


def panel_sql(kind: str) -> str:
    """CTEs ``bars`` and ``p`` (the dense panel)."""
    return f"""bars AS ({SQL[kind]}), p AS (SELECT c.code, d.dt, open, high, low, "close", volume, amount, bars.code IS NOT NULL AS is_bar
 FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN (SELECT DISTINCT dt FROM bars) d LEFT JOIN bars ON bars.code = c.code AND bars.dt = d.dt)"""
