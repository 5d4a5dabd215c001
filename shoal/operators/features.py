"""The newest indicators of every code, and the scores that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import panel as P

from .research import momentum_score

#: Scores at or under these aren't signals.
FLOORS = {"momentum": 25, "reversal": 40}


def _reversal() -> list[tuple[Column, int, Column]]:
    """(condition, points, what to say) of the fallback score; the last condition says nothing."""
    c, said = F.col, F.format_string
    return [
        (c("ret_20d").between(-35, -12), 30, said("fell(%.0f%%)", c("ret_20d"))), (c("rsi") < 38, 20, said("oversold(%.0f)", c("rsi"))),
        ((c("close") > c("ma5")) & (c("chg") > 0), 20, said("steady(+%.1f%%)", c("chg"))), (c("close") > c("ma120"), 15, F.lit("trend")),
        ((c("dif") > c("dea")) & (c("dif") < 0), 10, F.lit("cross")), (c("ret_60d").between(-50, -20), 5, F.lit(None).cast("string")),
    ]


def reversal_score() -> Column:
    """Points of the fallback score over ret_20d, ret_60d, rsi, close, ma5, ma120, chg, dif, dea, held within 0 to 100."""
    return F.least(F.greatest(sum((F.when(k, n).otherwise(0) for k, n, _ in _reversal()), F.lit(0)), F.lit(0)), F.lit(100))


def reversal_reasons() -> Column:
    return F.array_join(F.array(*(F.when(k, said) for k, _, said in _reversal())), " ")


def indicators(bars: DataFrame) -> DataFrame:
    """bars with moving means, highs, changes in percent and volume means, over each code's own bars."""
    avg = lambda x, n: P.rolling(F.avg, F.col(x), n)
    change = lambda n: (F.try_divide(F.col("close"), F.lag("close", n).over(P.by_code())) - 1) * 100
    means = {f"ma{n}": avg("close", n) for n in (5, 10, 20, 60, 120)} | {f"vol_ma{n}": avg("volume", n) for n in (5, 20)}
    highs = {"high20": P.rolling(F.max, F.col("high"), 20), "high250": P.rolling(F.max, F.col("high"), 250, 60)}
    return bars.withColumns(means | highs | {"amount_ma20": avg("amount", 20), "ret_20d": change(20), "ret_60d": change(60), "chg": change(1), "vol_prev": F.lag("volume", 1).over(P.by_code())})


def oscillators(bars: DataFrame) -> DataFrame:
    """bars with dif, dea and rsi, from exponential means over each code's bars."""
    d = F.col("close") - F.lag("close", 1).over(P.by_code())
    x = bars.withColumn("_d", d).withColumns({"_up": F.greatest("_d", F.lit(0.0)), "_down": F.greatest(-F.col("_d"), F.lit(0.0))})
    x = x.withColumns({c: F.when(F.col("_d").isNotNull(), F.col(c)) for c in ("_up", "_down")})
    x = P.ewm(x, {"_fast": ("close", 2 / 13, 12), "_slow": ("close", 2 / 27, 26), "_u": ("_up", 1 / 14, 14), "_v": ("_down", 1 / 14, 14)})
    x = P.ewm(x.withColumn("dif", F.col("_fast") - F.col("_slow")), {"dea": ("dif", 2 / 10, 9)})
    return x.withColumn("rsi", P.rsi(F.col("_u"), F.col("_v"))).drop("_d", "_up", "_down", "_fast", "_slow", "_u", "_v")


def newest(rows: DataFrame, least: int = 70) -> DataFrame:
    """The last row of every code that has ``least`` rows or more."""
    w = Window.partitionBy("code")
    x = rows.withColumns({"_last": F.max("dt").over(w), "_n": F.count("*").over(w)})
    return x.filter((F.col("dt") == F.col("_last")) & (F.col("_n") >= least)).drop("_last", "_n")


def signals(rows: DataFrame, liquid: float = 5e7, least: int = 130) -> DataFrame:
    """rows with ``strategy`` and ``score``, 0 to 100, where the score is over the strategy's floor; those without a close, not liquid or with
    fewer than ``least`` bars of their code up to them score nothing. Both strategies read the rows once."""
    fit = F.col("close").isNotNull() & (F.col("amount_ma20") >= liquid) & (F.row_number().over(P.by_code()) >= least)
    points = {"momentum": momentum_score(), "reversal": reversal_score()}
    found = rows.withColumn("_fit", fit).filter("_fit").drop("_fit")
    found = found.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), p.cast("int").alias("score"), F.lit(FLOORS[s]).alias("floor")) for s, p in points.items()))))
    return found.filter("_s.score > _s.floor").select(*rows.columns, "_s.strategy", "_s.score")
