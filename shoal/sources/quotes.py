"""Quotation snapshots: texts of many lines, each a code and fields between tildes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: where each field stands, and its unit in shares or money.
FIELDS = {"price": (3, 1), "open": (5, 1), "pct_chg": (32, 1), "high": (33, 1), "low": (34, 1), "volume": (36, 100), "amount": (37, 1e4), "turnover": (38, 1), "pe": (39, 1), "circ_mv": (44, 1e8), "total_mv": (45, 1e8), "pb": (46, 1)}
LEAST = 47
LINE = r'v_(?:sh|sz)(\d{6})="([^"]*)"'


def parse(texts: DataFrame, column: str = "text") -> DataFrame:
    """(code, name, fields) of every quotation with a price; short lines are left out, fields that aren't numbers are null."""
    lines = F.arrays_zip(F.regexp_extract_all(column, F.lit(LINE), 1).alias("code"), F.regexp_extract_all(column, F.lit(LINE), 2).alias("body"))
    x = texts.select(F.explode(lines).alias("q")).select("q.code", F.split("q.body", "~").alias("f"))
    x = x.filter((F.size("f") >= LEAST) & (F.get("f", F.lit(3)) != ""))
    known = {n: F.get("f", F.lit(i)).try_cast("double") * unit for n, (i, unit) in FIELDS.items()}
    known |= {n: F.nullif(known[n], F.lit(0.0)) for n in ("circ_mv", "total_mv")}
    known |= {n: F.coalesce(known[n], F.lit(0.0)) for n in ("volume", "amount")}
    return x.select("code", F.get("f", F.lit(1)).alias("name"), *(c.alias(n) for n, c in known.items()))


def exchange(code: Column) -> Column:
    """The market that a code's first digit stands for."""
    first = F.substring(code, 1, 1)
    return F.when(first == "6", "sh").when(first.isin("8", "4", "9"), "bj").otherwise("sz")


def special(name: Column) -> Column:
    """Whether a name marks special treatment or delisting."""
    return F.coalesce(F.upper(name).contains("ST") | name.contains("退"), F.lit(False))


def todays_bars(spot: DataFrame, day: Column) -> DataFrame:
    """Bars of the day from quotations that have all four prices."""
    prices = ("open", "high", "low", "price")
    known = F.least(*(F.coalesce(F.col(p) != 0, F.lit(False)) for p in prices))
    return spot.filter(known).select("code", day.alias("dt"), "open", "high", "low", F.col("price").alias("close"), "volume", "amount")


def universe(listed: DataFrame) -> DataFrame:
    """(code, name, exchange) of listed shares in a list whose codes carry their market, as in sh.600000."""
    x = listed.filter((F.col("type") == "1") & (F.col("status") == "1")).filter(F.col("code").rlike(r"^(sh\.6|sz\.[03])"))
    part = F.split("code", r"\.")
    return x.select(F.get(part, F.lit(1)).alias("code"), "name", F.get(part, F.lit(0)).alias("exchange"))
