"""Factor statistics: labels, rank information coefficients, turnover, long/short, weights, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.panel import by_code, rank_pct

#: Share of a trade that buying and selling cost.
COST_BUY, COST_SELL = 0.00125, 0.00175


def forward_return(h: int) -> Column:
    """Enter at the next date's open, leave at the open h dates on."""
    return F.try_divide(F.lead("open", h).over(by_code()), F.lead("open", 1).over(by_code())) - 1


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation of complete pairs; null where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def rank_ic_pairwise(rows: DataFrame, x: str, y: str, least: int = 50) -> DataFrame:
    """(dt, n, ic): ranks among complete pairs of a date with at least ``least`` of them."""
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"rx": rank_pct(F.col(x)), "ry": rank_pct(F.col(y))})
    return pairs.groupBy("dt").agg(F.count("*").alias("n"), pearson(F.col("rx"), F.col("ry")).alias("ic")).filter((F.col("n") >= least) & F.col("ic").isNotNull())


def rank_ic_masked(rows: DataFrame, x: str, y: str, ranked: bool = True) -> DataFrame:
    """(dt, ic): each side ranked among its own values (or as it is), then correlated over common rows."""
    own = rank_pct if ranked else lambda c: c
    ranked = rows.withColumns({"rx": own(F.col(x)), "ry": own(F.col(y))})
    return ranked.groupBy("dt").agg(pearson(F.col("rx"), F.col("ry")).alias("ic")).filter(F.col("ic").isNotNull())


def ic_summary(ic: DataFrame, per_year: float = 252.0) -> DataFrame:
    """One row: mean, deviation, annualised ratio, t statistic, positive share, number."""
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    ratio = F.try_divide(mean, F.nullif(std, F.lit(0.0)))
    return ic.agg(mean.alias("ic_mean"), std.alias("ic_std"), (ratio * F.sqrt(F.lit(per_year))).alias("icir"), (ratio * F.sqrt(n)).alias("t_stat"), F.avg((F.col("ic") > 0).cast("double")).alias("pos_ratio"), n.alias("n"))


def turnover(rows: DataFrame, x: str) -> DataFrame:
    """One row: the mean over dates of the mean absolute change in rank."""
    r = rows.withColumn("r", rank_pct(F.col(x)))
    d = r.withColumn("d", F.abs(F.col("r") - F.lag("r").over(by_code()))).groupBy("dt").agg(F.avg("d").alias("d"))
    return d.agg(F.avg("d").alias("turnover"))


#: Dates between rebalances, over which the costs of one are spread.
DATES_BETWEEN = {"D": 1, "W": 5, "M": 22}


def long_short(rows: DataFrame, x: str, y: str, share: float = 0.1, rebalance: str = "D", per_year: float = 252.0, least: int = 30) -> DataFrame:
    """One row (n, net_ir, net_ret) of ``selection.long_shorts`` for one factor: ranks count every value, means only known labels."""
    r = rows.withColumn("r", rank_pct(F.col(x)))
    return net_ratio(spread(r, y, ["dt"], share), [], rebalance, per_year, least)


def spread(ranked: DataFrame, y: str, by: list[str], share: float) -> DataFrame:
    """(by, ls): the mean of ``y`` in the top share of ``r`` less that in the bottom share; null where either is empty."""
    side = lambda inside: F.avg(F.when(inside, F.col(y)))
    return ranked.groupBy(*by).agg((side(F.col("r") >= 1 - share) - side(F.col("r") <= share)).alias("ls")).filter("ls is not null")


def net_ratio(days: DataFrame, by: list[str], rebalance: str, per_year: float, least: int) -> DataFrame:
    """(by, n, net_ir, net_ret) after the costs of both sides; null with fewer than ``least`` dates or without deviation."""
    net = F.col("ls") - 2 * (COST_BUY + COST_SELL) / DATES_BETWEEN[rebalance]
    known = (F.count("*") >= least) & (F.stddev_samp(net) > 0)
    ratio = F.when(known, F.avg(net) / F.stddev_samp(net) * F.sqrt(F.lit(per_year)))
    return days.groupBy(*by).agg(F.count("*").alias("n"), ratio.alias("net_ir"), F.when(known, F.avg(net) * per_year).alias("net_ret"))


def train_weights(ic: DataFrame, train: int, least: int = 30, floor: float = 0.01, embargo: int = 0) -> DataFrame:
    """(dt, weight): the mean coefficient over the last train + 1 dates, embargo dates left out; null where it is too weak or short."""
    w = Window.orderBy("dt").rowsBetween(-train - embargo, -embargo)
    mean, std, n = F.avg("ic").over(w), F.stddev_samp("ic").over(w), F.count("ic").over(w)
    return ic.select("dt", F.when((n >= least) & (F.abs(mean) >= floor) & (std > 0), mean).alias("weight"))


def folds(ic: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """(fold, is_icir, oos_icir) over positional folds of the dates; coefficients are computed once for all folds."""
    size = train + test
    x = ic.withColumns({"i": F.row_number().over(Window.orderBy("dt")) - 1, "all": F.count("*").over(Window.partitionBy())}).filter(F.col("all") >= size)  # one row a date
    first = F.greatest(F.ceil((F.col("i") - size + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("all") - size) / step))
    j = x.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("k", F.explode(F.sequence("first", "last"))).withColumn("begin", (F.col("k") * step).cast("int"))
    j = j.withColumn("oos", F.col("i") >= F.col("begin") + train)
    ratio = lambda c: F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))) * F.sqrt(F.lit(252.0))
    return j.groupBy("begin").agg(ratio(F.when(~F.col("oos"), F.col("ic"))).alias("is_icir"), ratio(F.when(F.col("oos"), F.col("ic"))).alias("oos_icir"))


def by_ratio(s: dict) -> tuple[float, str]:
    """The order of falling ratio, equal ones by name; sums of one series in two orders differ in their last digits and count as equal."""
    return -round(s["icir"], 9), s["id"]


def greedy(stats: list[dict], corr: dict[tuple[str, str], float], gate: float = 0.5, ceiling: float = 0.7, top: int = 20, least: int = 50) -> list[str]:
    """Factors by falling ratio, without those that correlate with one chosen before or have no ratio out of sample.

    If that leaves none, the best that pass the gate. A walk over collected rows, one a factor.
    """
    passed = sorted((s for s in stats if s["n"] >= least and s["icir"] is not None and s["icir"] >= gate), key=by_ratio)
    chosen: list[str] = []
    for s in passed:
        if len(chosen) == top:
            break
        if s["oos_icir"] is not None and all(corr.get((s["id"], c), corr.get((c, s["id"]), 0.0)) < ceiling for c in chosen):
            chosen.append(s["id"])
    return chosen or [s["id"] for s in passed[:top]]


def drop_reason(net_ir: Column, ratio: Column, stability: Column) -> Column:
    """Why a factor must go, or null: first net ratio, then out-of-sample ratio, then stability."""
    return F.when(net_ir.isNull() | ~(net_ir > 0), "net_ir").when(ratio > 5, "oos_is_ratio").when(stability < 0, "stability")


def performance(equity: DataFrame) -> DataFrame:
    """One row from (dt, eq): total return, yearly growth, deepest drawdown, Sharpe ratio."""
    w = Window.orderBy("dt")
    peak = F.max("eq").over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = equity.select("dt", "eq", ((F.col("eq") - peak) / peak).alias("dd"), (F.try_divide(F.col("eq"), F.lag("eq").over(w)) - 1).alias("r"))
    growth = F.try_divide(F.max_by("eq", "dt"), F.min_by("eq", "dt"))
    days = F.datediff(F.max("dt"), F.min("dt"))
    return e.agg((growth - 1).alias("total_return"), (F.pow(growth, F.try_divide(F.lit(365.25), days)) - 1).alias("cagr"), F.min("dd").alias("max_drawdown"), (F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))) * F.sqrt(F.lit(252.0))).alias("sharpe"))
