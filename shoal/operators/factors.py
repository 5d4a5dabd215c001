"""The built-in price and volume factors of a dense panel (code, dt, open, high, close, volume, amount); windows must be full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions import panel as P


def windowed(panel: DataFrame) -> DataFrame:
    """The panel with the factors that windows express; returns fill gaps forward first."""
    c = F.col
    mean = lambda x, n: P.rolling(F.avg, c(x), n)
    ratio = lambda x, y: F.try_divide(x, y) - 1
    q = panel.withColumn("y", P.filled(c("close"))).withColumn("ret", P.returns("y", 1))
    fall = F.when(c("ret").isNotNull(), F.least("ret", F.lit(0.0)))
    found: dict[str, Column] = {f"ret_{n}d": P.returns("y", n) for n in (5, 10, 20, 60, 120)}
    found |= {f"rev_{n}d": -P.returns("y", n) for n in (5, 20)}
    found |= {f"close_ma{n}": ratio(c("close"), mean("close", n)) for n in (20, 60, 120)}
    found |= {f"ma{a}_ma{b}": ratio(mean("close", a), mean("close", b)) for a, b in ((5, 20), (20, 60))}
    found |= {f"vol_{n}d": P.rolling(F.stddev_samp, c("ret"), n) for n in (20, 60)} | {"downside_20d": P.rolling(F.stddev_samp, fall, 20)}
    found |= {name: F.try_divide(mean(x, 5), mean(x, 20)) for name, x in (("vol_ratio", "volume"), ("amt_ratio", "amount"))}
    found |= {"log_amt20": F.when(mean("amount", 20).isNotNull(), F.ln(F.greatest(mean("amount", 20), F.lit(1.0))))}
    found |= {f"hi{n}_dist": ratio(c("close"), P.rolling(F.max, c("high"), n)) for n in (20, 60, 120)}
    found |= {"chg": c("ret") * 100, "gap_up": ratio(c("open"), F.lag("close", 1).over(P.by_code()))}
    found |= {"amihud": F.when(c("amount").isNotNull(), F.abs("ret") / F.greatest("amount", F.lit(1.0)))}
    return q.withColumns(found)


def macd(panel: DataFrame, least: int) -> DataFrame:
    """code, dt, dif, dea, hist. Two passes: the signal line, from ``least`` values on, is a mean of a difference of means."""
    p = P.ewm(panel.select("code", "dt", "close"), {"fast": ("close", 2 / 13, 12), "slow": ("close", 2 / 27, 26)})
    p = P.ewm(p.withColumn("dif", F.col("fast") - F.col("slow")), {"dea": ("dif", 2 / 10, least)})
    return p.withColumn("hist", 2 * (F.col("dif") - F.col("dea")))


def panel_rsi(panel: DataFrame) -> DataFrame:
    """code, dt, rsi_14: from the first change on, null without losses."""
    d = F.col("close") - F.lag("close", 1).over(P.by_code())
    p = panel.select("code", "dt", d.alias("d"))
    p = p.select("code", "dt", F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0))).alias("up"), F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0))).alias("down"))
    return P.ewm(p, {"u": ("up", 1 / 14, 1), "v": ("down", 1 / 14, 1)}).withColumn("rsi_14", P.rsi(F.col("u"), F.col("v"), full_at_zero=False))
