"""The daily screen: hard filters, liveness, liquidity, scores, caps by industry, outcomes."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.plans.dsl import compile_factors
from shoal.sources.bars import at_or_before, densify
from shoal.sources.commits import Change, Store, kept

from . import features, state, tables


@dataclass(frozen=True)
class Limits:
    """Fixed values of the screen's thresholds."""

    min_mv: float = 5e9
    max_pe: float = 40.0
    min_roe: float = 8.0
    max_debt: float = 65.0
    min_amount: float = 5e7
    cap: int = 3
    top: int = 10


def failures(lim: Limits = Limits()) -> Column:
    """The names of the hard filters that a row (total_mv, pe, roe, debt) fails; unknown debt passes."""
    mv = F.coalesce("total_mv", F.lit(0.0))
    return F.array_compact(F.array(
        F.when(mv < lim.min_mv, "mv"),
        F.when(F.col("pe").isNull() | (F.col("pe") <= 0) | (F.col("pe") > lim.max_pe), "pe"),
        F.when(F.col("roe").isNull() | (F.col("roe") < lim.min_roe), "roe"),
        F.when(F.col("debt") > lim.max_debt, "debt"),
    ))


def live(bars: DataFrame, days: int, as_of: Column | None = None) -> DataFrame:
    """Codes whose last bar is at most 2 x days before ``as_of`` (default: the newest bar)."""
    newest = bars.agg(F.max("dt").alias("_now"))
    last = bars.groupBy("code").agg(F.max("dt").alias("last"))
    return last.crossJoin(F.broadcast(newest)).filter(F.col("last") >= F.date_sub(as_of if as_of is not None else F.col("_now"), 2 * days)).select("code", "last")


def liquid(bars: DataFrame, rows: int, window: int, least: float) -> DataFrame:
    """Codes with ``rows`` bars or more whose mean amount over the newest ``window`` is ``least`` or more."""
    w = Window.partitionBy("code").orderBy(F.desc("dt"))
    x = bars.filter(F.col("amount").isNotNull()).withColumn("rn", F.row_number().over(w))
    out = x.groupBy("code").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("rn") <= window, F.col("amount"))) / window).alias("amount"))
    return out.filter((F.col("n") >= rows) & (F.col("amount") >= least))


def capped_top(scored: DataFrame, top: int, cap: int) -> DataFrame:
    """The best ``top`` rows, at most ``cap`` of an industry (blank or null: any number), ties by code; with their rank."""
    if top <= 0:
        return scored.withColumn("rank", F.lit(0)).limit(0)
    blank = F.trim(F.coalesce("industry", F.lit(""))) == ""
    best = [F.desc_nulls_last("score"), F.asc("code")]
    kept = scored
    if cap > 0:
        # a blank industry's code is one of its own; a large industry is ranked in parts first, each of which gives ``cap`` rows at most
        kept = scored.withColumn("_own", F.when(blank, F.col("code")))
        for part in ([F.xxhash64("code") % 256], []):
            kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy("industry", "_own", *part).orderBy(*best))).filter(F.col("_k") <= cap)
        kept = kept.drop("_own", "_k")
    chosen = kept.orderBy(*best).limit(top)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(*best)))


def composite(rows: DataFrame, weights: dict[str, float], names: dict[str, str] | None = None) -> DataFrame:
    """(code, score, reasons): weighted z-scores of the cross-section, and the three largest contributions, equal ones in the weights' order.

    If any factor has no spread, or one row is left, values stand for themselves. Unknown ones add 0.
    """
    stats = rows.agg(*(g(f).alias(f"_{k}_{f}") for f in weights for k, g in (("m", F.avg), ("s", F.stddev_samp))))
    rows = rows.crossJoin(F.broadcast(stats))  # one row
    flat = F.least(*(F.coalesce(F.col(f"_s_{f}"), F.lit(0.0)) for f in weights), F.lit(math.inf)) == 0
    z = {f: F.coalesce(F.when(flat, F.col(f)).otherwise(F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.nullif(F.col(f"_s_{f}"), F.lit(0.0)))), F.lit(0.0)) * w for f, w in weights.items()}
    parts = F.array(*(F.struct((-F.abs(c)).alias("k"), F.lit(i).alias("i"), F.lit((names or {}).get(f, f)).alias("f"), c.alias("c")) for i, (f, c) in enumerate(z.items())))
    x = rows.select("code", parts.alias("p"))
    reasons = F.transform(F.slice(F.array_sort("p"), 1, 3), lambda s: F.format_string("%s(%+.1f)", s["f"], s["c"]))
    return x.select("code", F.aggregate("p", F.lit(0.0), lambda a, s: a + s["c"]).alias("score"), F.array_join(reasons, " ").alias("reasons"))


def outcomes(picks: DataFrame, bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """picks (run_date, code) with ret_n: open of the first bar after run_date to the close of the n-th bar after that, in percent.

    Picks and bars of a code are sorted once, newest first, and each pick takes the bar last seen; no pick meets all bars.
    """
    ahead = Window.partitionBy("code").orderBy("dt")
    ret = lambda n: F.when(F.col("open") > 0, F.bround((F.lead("close", n).over(ahead) / F.col("open") - 1) * 100, 2) + 0.0).alias(f"ret_{n}")
    b = bars.select("code", "dt", F.lit(1).alias("kind"), F.struct(*map(ret, horizons)).alias("bar"))
    both = b.unionByName(picks.select("code", F.col("run_date").alias("dt"), F.lit(0).alias("kind")), allowMissingColumns=True)
    seen = F.last("bar", ignorenulls=True).over(Window.partitionBy("code").orderBy(F.desc("dt"), "kind").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("bar", seen).filter("kind = 0").select("code", F.col("dt").alias("run_date"), *(F.col(f"bar.ret_{n}") for n in horizons))


def fill_outcomes(store: Store, horizons: tuple[int, ...] = (5, 10, 20, 60), ahead: int = 120) -> int:
    """Fill the outcomes of stored recommendations that are null, from stored bars; the number of run dates written.

    Only unfinished picks are read. Bars come from the months between a pick's and ``ahead`` days on, which the picks name while the query runs, and of
    the picks' codes. A value that is there stays, and only run dates whose rows changed are written.
    """
    base = store.head()
    names = [f"ret_{n}" for n in horizons]
    open_ = store.read("recommendations", snapshot=base).filter(F.least(*(F.col(n).isNotNull() for n in names), F.lit(True)) == F.lit(False)).select("run_date", "code")
    open_ = kept(open_)
    span = F.sequence(F.trunc("run_date", "month"), F.trunc(F.date_add("run_date", ahead), "month"), F.expr("interval 1 month"))
    months = [r[0] for r in open_.select(F.explode(span).alias("m")).select(F.date_format("m", "yyyy-MM")).distinct().collect()]
    bars = store.read("daily", months, base).join(open_.select("code").distinct(), "code", "left_semi")
    found = outcomes(open_, bars.select("code", "dt", "open", "close"), horizons)
    found = kept(found.filter(F.greatest(*(F.col(n).isNotNull() for n in names), F.lit(False))))
    days = [str(r[0]) for r in found.select("run_date").distinct().collect()]
    if not days:
        return 0
    held = store.read("recommendations", days, base)
    new = found.select("run_date", "code", F.struct(*names).alias("_new"))
    rows = held.join(new, ["run_date", "code"], "left").select(*(F.coalesce(F.col(c), F.col(f"_new.{c}")).alias(c) if c in names else F.col(c) for c in held.columns))
    before = held.groupBy("run_date").agg(*(F.count(n).alias(f"_{n}") for n in names))
    after = rows.groupBy("run_date").agg(*(F.count(n).alias(n) for n in names)).join(before, "run_date").filter(F.greatest(*(F.col(n) > F.col(f"_{n}") for n in names), F.lit(False)))
    days = [r[0] for r in after.select("run_date").collect()]
    if days:
        store.commit(f"outcomes:{uuid.uuid4().hex}", [Change("recommendations", rows.filter(F.col("run_date").isin(days)), "swap")], base=base.version)
    return len(days)


def candidates(snapshot: DataFrame, listing: DataFrame, reports: DataFrame, key: str = "code") -> DataFrame:
    """Rows of ``snapshot`` (code, price) that trade in the two main markets, not under special treatment, with the newest
    of their ``reports`` (code, period, metrics) where they have one; by code. ``key`` joins the three, if several rows may have one code."""
    fit = listing.filter(F.col("exchange").isin("sh", "sz") & ~F.coalesce("is_st", F.lit(False)))
    return snapshot.filter("price > 0").join(fit, key).join(tables.latest(reports, [key], "period"), key, "left").orderBy("code", key)


def missing_alert(rows: DataFrame, metrics: list[str], most: float = 0.3) -> DataFrame:
    """One row (n, missing, alert): rows that lack any of ``metrics``, and whether they are more than a share ``most`` of all."""
    lacks = F.greatest(*(F.col(m).isNull() for m in metrics), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(lacks).alias("missing"), F.coalesce(F.try_divide(F.count_if(lacks), F.count("*")) > most, F.lit(False)).alias("alert"))


def recommendation(picks: DataFrame, run_date: Column, metrics: list[str], factor_set: Column) -> DataFrame:
    """Rows to keep of ranked picks (rank, code, score and metrics), one partition a run date, with the factor set they came from."""
    return picks.select(run_date.alias("run_date"), "rank", "code", "score", F.to_json(F.struct(*metrics)).alias("metrics_json"), factor_set.alias("factor_set_id"))


def by_set(panel: DataFrame, members: DataFrame, dates: list[date], as_of: date | None = None) -> DataFrame:
    """(code, score, reasons) of a panel's codes by a set of factors (place, factor, expr, weight), on the last date at or before ``as_of`` or, without
    one, the newest. Expressions come from the rows and are compiled together; one row a factor comes to the driver. Empty for an empty set.
    """
    found = members.orderBy("place").collect()
    day = at_or_before(dates, as_of)
    if not found or day is None:
        return panel.sparkSession.createDataFrame([], "code string, score double, reasons string")
    own = {f"f{k}": r for k, r in enumerate(found)}
    made = compile_factors(panel.filter(F.col("dt") <= F.lit(day)), {f: r["expr"] for f, r in own.items()})
    cross = kept(made.filter(F.col("dt") == F.lit(day)).select("code", *own))
    return composite(cross, {f: r["weight"] for f, r in own.items()}, {f: r["factor"] for f, r in own.items()})


def by_reversal(bars: DataFrame) -> DataFrame:
    """(code, score, reasons) from the newest indicators of every code that has enough bars: what stands in for a set that is empty."""
    x = features.newest(features.oscillators(features.indicators(bars)))
    return x.select("code", features.reversal_score().cast("double").alias("score"), features.reversal_reasons().alias("reasons"))


def run(store: Store, run_date: date, codes: DataFrame, bars: DataFrame, dates: list[date], days: int, rows: int, window: int, lim: Limits = Limits(), persist: bool = True) -> DataFrame:
    """The day's picks (rank, code, industry, score, price, reasons, factor_set_id) of codes (code, industry, price, fundamentals).

    Hard filters, liveness and liquidity first, then the scores of the active set over the codes that are left, or of the fallback where the set is empty.
    ``persist`` puts them in the place of the day's recommendations, with whether the fallback was taken and whether too many
    fundamentals are missing, in one commit.
    """
    flags, _ = funnel(codes.withColumn("score", F.lit(0.0)), bars, days, rows, window, lim)
    left = kept(flags.filter("hard and live and liquid").select("code", "industry", "price"))
    mine = bars.join(left.select("code"), "code", "left_semi")
    members = state.active_weights(store).cache()
    degraded = members.isEmpty()
    scored = by_reversal(mine) if degraded else by_set(densify(mine, dates), members, dates)
    found = state.active(store, state.AUTO).select(F.max("run_at").alias("factor_set_id"))
    picks = capped_top(left.join(scored, "code"), lim.top, lim.cap).crossJoin(F.broadcast(found)).withColumn("run_date", F.lit(run_date))  # one row
    members.unpersist()
    if not persist:
        return picks.drop("run_date")
    alert = missing_alert(codes, ["pe", "roe", "debt"]).first()
    said = {"last_recommend_run": str(run_date), "factor_system_degraded": str(int(degraded)), "universe_fund_missing_alert": f"{alert['missing']}/{alert['n']}" if alert["alert"] else "0"}
    run_id = f"screen:{run_date}:{uuid.uuid4().hex}"
    store.commit(run_id, [Change("recommendations", picks, "swap"), state.settings(store, **said)])
    return store.read("recommendations", [str(run_date)]).select("rank", "code", "industry", "score", "price", "reasons", "factor_set_id")


def funnel(codes: DataFrame, bars: DataFrame, days: int, rows: int, window: int, lim: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(code flags, picks): hard, live and liquid of every code (code, industry, score, fundamentals), and the capped best of those that pass all."""
    newest = Window.partitionBy("code").orderBy(F.desc("dt"))
    known = bars.select("code", "dt", "amount", F.when(F.col("amount").isNotNull(), F.count("amount").over(newest)).alias("_rn"))  # the bars are read once
    mine = known.groupBy("code").agg(F.max("dt").alias("_last"), F.count("amount").alias("_n"), (F.sum(F.when(F.col("_rn") <= window, F.col("amount"))) / window).alias("_mean"))
    mine = mine.withColumn("_now", F.max("_last").over(Window.partitionBy()))  # one row a code
    ok = {"live": F.col("_last") >= F.date_sub("_now", 2 * days), "liquid": (F.col("_n") >= rows) & (F.col("_mean") >= lim.min_amount)}
    x = codes.join(mine, "code", "left").withColumn("hard", F.size(failures(lim)) == 0)
    x = x.select(*codes.columns, "hard", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in ok.items()))
    return x, capped_top(x.filter("hard and live and liquid").select("code", "industry", "score"), lim.top, lim.cap)
