"""Portfolio simulation: path-dependent cash and slots, one run a group, so that many runs go in parallel.

Signals and prices are DataFrames; only the codes that a run's signals name reach its group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import COST_BUY, COST_SELL

LOT = 100


def shares_for(budget: float, price: float | None, cash: float) -> int:
    """Whole lots that the budget and cash pay for, costs included."""
    if not price or price <= 0:
        return 0
    n = int(budget / (price * (1 + COST_BUY)) // LOT) * LOT
    return n if n >= LOT and n * price * (1 + COST_BUY) <= cash else 0


def position_return(sold: float, bought: float) -> float:
    """What a position has brought after the costs of both its trades, as a share of what it took."""
    return sold * (1 - COST_SELL) / (bought * (1 + COST_BUY)) - 1


def exit_price(pos: dict, open_: float | None, low: float | None, high: float | None, *, stop: float | None, profit: float | None, trail: float | None, held: int, horizon: int, stuck: int) -> tuple[float, str] | None:
    """(price, reason) if the position leaves today: stop, then trailing stop, then profit, then age; without a price only after ``stuck`` days.

    stop, profit and trail are percentages, None for none. A stop that the day opens beyond fills at the open, a profit always at its goal.
    """
    if profit is not None and profit <= 0:
        raise ValueError("profit must be over 0, or None")
    if open_ is None or held < 1:
        return (pos["px"], "stuck") if stuck and held >= stuck else None
    levels = []
    if stop is not None:
        levels.append((pos["px"] * (1 + stop / 100), "stop"))
    if trail:
        levels.append((pos["peak"] * (1 - trail / 100), "trail"))
    for level, reason in levels:
        if (low is not None and low <= level) or (reason == "stop" and open_ <= level):
            return min(open_, level), reason
    if profit is not None and high is not None and high >= (goal := pos["px"] * (1 + profit / 100)):
        return goal, "profit"
    return (open_, "age") if held >= max(horizon - 1, 1) else None


def simulate(rows: pd.DataFrame, top: int, horizon: int, stop: float | None, profit: float | None, trail: float | None, capital: float, stuck: int) -> list[dict]:
    """rows: (dt, code, open, high, low, close, pick, enter), pick the signal's rank of the date before.

    One equity point a date, before its trades; positions that are left are sold at the last date's close, or
    dropped where there is none.
    """
    known = lambda x: None if pd.isna(x) else float(x)
    cash, held, out = capital, {}, []

    def leave(c: str, price: float, dt, reason: str) -> dict:
        nonlocal cash
        p = held.pop(c)
        cash += p["n"] * price * (1 - COST_SELL)
        return {"code": c, "bought": p["dt"], "sold": dt, "ret": position_return(price, p["px"]), "reason": reason}

    px: dict = {}
    for i, (dt, day) in enumerate(rows.sort_values(["dt", "pick", "code"]).groupby("dt")):
        px = {r.code: r for r in day.itertuples()}
        at = lambda c: known(px[c].close) if c in px else None
        value = cash + sum(p["n"] * (at(c) or p["px"]) for c, p in held.items())
        closed, bought = [], 0
        for c in sorted(held):
            r, p = px.get(c), held[c]
            o, lo, hi, last = (known(x) for x in ((r.open, r.low, r.high, r.close) if r is not None else (None,) * 4))
            if left := exit_price(p, o, lo, hi, stop=stop, profit=profit, trail=trail, held=i - p["i"], horizon=horizon, stuck=stuck):
                closed.append(leave(c, left[0], dt, left[1]))
            elif last is not None:
                p["peak"] = max(p["peak"], last if hi is None else hi)
        for r in day[day.enter & day.pick.notna()].sort_values(["pick", "code"]).itertuples():
            if len(held) >= top:
                break
            if r.code not in held and (n := shares_for(value / top, known(r.open), cash)):
                cash -= n * r.open * (1 + COST_BUY)
                held[r.code] = {"n": n, "px": float(r.open), "peak": float(r.open), "i": i, "dt": dt}
                bought += 1
        out.append({"dt": dt, "eq": value, "cash": cash, "positions": len(held), "trades": bought + len(closed), "closed": closed})
    if held:
        end = out[-1]
        for c in sorted(held):
            if c in px and (last := known(px[c].close)) is not None:
                end["closed"].append(leave(c, last, end["dt"], "final"))
        end |= {"cash": cash, "positions": 0, "trades": end["trades"] + sum(t["reason"] == "final" for t in end["closed"])}
    return out


#: What a run gives for every date; ``closed`` are the positions that it sold.
CURVE = "run_id string, dt date, eq double, cash double, positions int, trades int, closed array<struct<code: string, bought: date, sold: date, ret: double, reason: string>>"


def backtest(signals: DataFrame, prices: DataFrame, runs: list[dict], capital: float = 1e6) -> DataFrame:
    """Rows of ``CURVE`` of every run. signals: (dt, code, pick, enter), pick 1 the best, for the date it trades on;
    with a run_id of their own, or the same for all runs. runs: dicts of run_id, top, horizon, stop, profit, trail, and
    after how many dates without a price a position goes (stuck, default twice the horizon, 0 never)."""
    spec = {r["run_id"]: r for r in runs}
    if "run_id" not in signals.columns:
        signals = signals.withColumn("run_id", F.explode(F.array(*(F.lit(r) for r in spec))))
    keyed = prices.join(signals.select("run_id", "code").distinct(), "code").join(signals, ["run_id", "dt", "code"], "left").withColumn("enter", F.coalesce("enter", F.lit(False)))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        r = spec[key[0]]
        made = simulate(g, r["top"], r["horizon"], r["stop"], r["profit"], r.get("trail"), capital, r.get("stuck", 2 * r["horizon"]))
        return pd.DataFrame([{"run_id": key[0]} | x for x in made], columns=["run_id", "dt", "eq", "cash", "positions", "trades", "closed"])

    return keyed.groupBy("run_id").applyInPandas(run, CURVE)


def trade_list(curves: DataFrame) -> DataFrame:
    """(run_id, code, bought, sold, ret, reason) of every position that was sold."""
    return curves.select("run_id", F.explode("closed").alias("t")).select("run_id", "t.*")


def results(curves: DataFrame, capital: float = 1e6, bench: DataFrame | None = None, per_year: float = 252.0) -> DataFrame:
    """One row a run: return, yearly growth, drawdown, Sharpe ratio, trades and how they went, the equity as (dt, eq).

    ``bench`` (dt, close) adds its return from its first to its last close in the run's dates.
    """
    w = Window.partitionBy("run_id").orderBy("dt")
    peak = F.max("eq").over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = curves.withColumns({"dd": F.col("eq") / peak - 1, "r": F.try_divide(F.col("eq"), F.lag("eq").over(w)) - 1})
    total = F.max_by("eq", "dt") / capital
    days = F.datediff(F.max("dt"), F.min("dt"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    wins = F.sum(F.size(F.filter("closed", lambda t: t["ret"] > 0)))
    n = F.sum(F.size("closed"))
    out = x.groupBy("run_id").agg(
        F.min("dt").alias("start"), F.max("dt").alias("end"), (total - 1).alias("total_return"), zero(F.pow(total, F.try_divide(F.lit(365.25), days)) - 1).alias("cagr"), F.min("dd").alias("max_drawdown"),
        zero(F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))) * per_year**0.5).alias("sharpe"), n.alias("n_trades"), zero(F.try_divide(wins, n)).alias("win_rate"),
        zero(F.try_divide(F.sum(F.aggregate("closed", F.lit(0.0), lambda a, t: a + t["ret"])), n)).alias("avg_trade_ret"), F.array_sort(F.collect_list(F.struct("dt", "eq"))).alias("equity"))
    if bench is None:
        return out
    b = bench.join(F.broadcast(out.select("run_id", "start", "end")), F.col("dt").between(F.col("start"), F.col("end"))).groupBy("run_id")  # one row a run
    change = b.agg(F.when(F.count("close") >= 2, F.max_by("close", "dt") / F.min_by("close", "dt") - 1).alias("bench_return"))
    return out.join(change, "run_id", "left")
