"""What factor research keeps and asks: pair correlations, stability, demotion, rebalance dates, tags, quarters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import blocks
from shoal.operators import tables


#: Factors of one block; two blocks of a date meet in a task.
BLOCK = 64
_PAIRS = "f1 string, f2 string, n long, r double"


def _matrix(table: pa.Table, skip: tuple[str, ...]) -> tuple[list[str], np.ndarray]:
    """The value columns of a date's rows by code: their names, and the matrix."""
    names = [c for c in table.column_names if c not in skip]
    x = np.empty((table.num_rows, len(names)), order="F")
    for k, c in enumerate(names):
        x[:, k] = table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return names, x


def _pairs(left: list[str], right: list[str], n: np.ndarray, r: np.ndarray) -> pa.Table:
    i, j = np.nonzero(n)
    keep = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if left[x] < right[y] or left is not right and left[x] > right[y]]
    i, j = i[keep], j[keep]
    names = [(min(left[x], right[y]), max(left[x], right[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    return pa.table({"f1": pa.array([a for a, _ in names], pa.string()), "f2": pa.array([b for _, b in names], pa.string()), "n": pa.array(n[i, j]), "r": pa.array(r[i, j], mask=np.isnan(r[i, j]))})


def wide_correlations(tables: list[DataFrame], least: int = 100) -> DataFrame:
    """(f1, f2, cells, corr) of all pairs of the factors of wide tables (dt, code, factor...), one row a date and code in each, blocks of the factors.

    Ranks by date over the cells that both factors have, a correlation by date, its mean over dates; zero for pairs with fewer than ``least`` cells. Tables of no
    more than two blocks in all make one matrix a date, so that each factor is sorted once; of more, each pair of tables meets by date. A task has one date's
    matrices, and gives out pairs and not cells.
    """

    def meet(a: DataFrame, b: DataFrame | None) -> DataFrame:
        def inside(table: pa.Table) -> pa.Table:
            names, x = _matrix(table, ("dt", "code"))
            return _pairs(names, names, *blocks.correlate(x, x))

        def across(one: pa.Table, two: pa.Table) -> pa.Table:
            (left, x), (right, y) = _matrix(one, ("dt", "code")), _matrix(two, ("dt", "code"))
            place = {c: k for k, c in enumerate(one.column("code").to_pylist())}
            at = [(place[c], k) for k, c in enumerate(two.column("code").to_pylist()) if c in place]
            i, j = np.array(at, np.int64).reshape(-1, 2).T
            return _pairs(left, right, *blocks.correlate(x[i], y[j]))

        if b is None:
            return a.groupBy("dt").applyInArrow(inside, _PAIRS)
        return a.groupBy("dt").cogroup(b.groupBy("dt")).applyInArrow(across, _PAIRS)

    of = [[c for c in t.columns if c not in ("dt", "code")] for t in tables]
    names = [c for own in of for c in own]

    def together(table: pa.Table) -> pa.Table:
        """All tables' rows of a date, of which ``part`` is the table and ``x`` the values in it."""
        code = table.column("code").combine_chunks().dictionary_encode("encode")
        row, part = code.indices.to_numpy(), table.column("part").to_numpy()
        x, at = np.full((row.max() + 1, len(names)), np.nan, order="F"), 0
        for k, own in enumerate(of):
            mine = np.flatnonzero(part == k)
            held = table.column("x").take(pa.array(mine)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x[row[mine], at : at + len(own)] = held.reshape(len(mine), len(own))
            at += len(own)
        return _pairs(names, names, *blocks.correlate(x, x))

    if len(tables) > 1 and len(names) <= 2 * BLOCK:
        rows = [t.select("dt", "code", F.lit(k).alias("part"), F.array(*(F.col(c).cast("double") for c in own)).alias("x")) for k, (t, own) in enumerate(zip(tables, of, strict=True))]
        days = reduce(DataFrame.unionByName, rows).groupBy("dt").applyInArrow(together, _PAIRS)
    else:
        parts = [meet(a, None if i == j else b) for i, a in enumerate(tables) for j, b in enumerate(tables) if i <= j]
        days = reduce(DataFrame.unionByName, parts)
    out = days.groupBy("f1", "f2").agg(F.sum("n").alias("cells"), F.avg("r").alias("r"))
    return out.select("f1", "f2", "cells", F.when(F.col("cells") < least, 0.0).otherwise(F.col("r")).alias("corr"))


def pair_correlations(tall: DataFrame, least: int = 100) -> DataFrame:
    """``wide_correlations`` of a tall table (factor, dt, code, value). The factors' names come to the driver."""
    names = sorted(r[0] for r in tall.filter("value is not null").select("factor").distinct().collect())
    wide = [tall.filter(F.col("factor").isin(part)).groupBy("dt", "code").agg(*(F.max(F.when(F.col("factor") == f, F.col("value"))).alias(f) for f in part)) for part in (names[k : k + BLOCK] for k in range(0, len(names), BLOCK))]
    return wide_correlations(wide, least) if wide else tall.sparkSession.createDataFrame([], "f1 string, f2 string, cells long, corr double")


def coefficients(wide: DataFrame, factors: list[str], label: str = "fwd", least: int = 50, masked: bool = False) -> DataFrame:
    """(factor, dt, n, ic) of the factors of a wide table (dt, code, label, factor...): all of a date's ranks in one matrix.

    Ranks count the pairs that are complete or, ``masked``, each side's own values. Dates with fewer than ``least`` pairs or without spread are left out.
    """

    def run(table: pa.Table) -> pa.Table:
        names, x = _matrix(table, ("dt", "code", label))
        n, ic = blocks.rank_ic(x, table.column(label).cast(pa.float64()).to_numpy(zero_copy_only=False), masked)
        keep = np.flatnonzero((n >= least) & ~np.isnan(ic))
        return pa.table({"factor": pa.array([names[k] for k in keep], pa.string()), "dt": pa.array([table.column("dt")[0].as_py()] * len(keep), pa.date32()), "n": pa.array(n[keep]), "ic": pa.array(ic[keep])})

    return wide.select("dt", label, *factors).groupBy("dt").applyInArrow(run, "factor string, dt date, n long, ic double")


def date_ranks(wide: DataFrame, factors: list[str]) -> DataFrame:
    """A wide table with each factor's values as ranks among the date's values, over their number (``panel.rank_pct``): all of a date's in one matrix."""
    passed = [c for c in wide.columns if c not in factors]

    def run(table: pa.Table) -> pa.Table:
        names, x = _matrix(table, tuple(passed))
        r = blocks.ranks(x) / np.maximum((~np.isnan(x)).sum(0), 1)
        return pa.table([*(table.column(c) for c in passed), *(pa.array(r[:, k], mask=np.isnan(r[:, k])) for k in range(len(names)))], names=[*passed, *names])

    x = wide.select(*passed, *(F.col(f).cast("double").alias(f) for f in factors))
    return x.groupBy("dt").applyInArrow(run, x.schema)


def stability(series: DataFrame, key: str, value: str, window: int = 252, floor: float = 0.0, per_year: float = 252.0) -> DataFrame:
    """(key, last, worst, unstable): a rolling information ratio over the non-null values; keys with fewer than ``window`` are left out."""
    w = Window.partitionBy(key).orderBy("dt").rowsBetween(1 - window, 0)
    x = F.col(value)
    ratio = F.try_divide(F.avg(x).over(w), F.stddev_samp(x).over(w)) * per_year**0.5
    rows = series.filter(x.isNotNull()).withColumn("s", F.when(F.count(x).over(w) >= window, ratio)).filter("s is not null")
    return rows.groupBy(key).agg(F.max_by("s", "dt").alias("last"), F.min("s").alias("worst")).withColumn("unstable", F.col("worst") < floor)


def rebalance(dates: DataFrame, unit: str) -> DataFrame:
    """(dt, rebalance): the first market date of each ISO week or month. A calendar has one row a date, so one task may order it."""
    w = Window.orderBy("dt")
    key = F.to_date(F.date_trunc(unit, "dt"))
    return dates.select("dt").distinct().withColumn("key", key).select("dt", F.coalesce(F.col("key") != F.lag("key").over(w), F.lit(True)).alias("rebalance"))


def demotions(active: DataFrame, evals: DataFrame, least_stability: float = 0.0, least_ir: float = 0.0) -> DataFrame:
    """(factor, reason) of active factors by their newest evaluation (factor, run_at, net_ir, stability).

    reason is null for those that stay, as do factors that were never evaluated.
    """
    newest = tables.latest(evals, ["factor"], "run_at").select("factor", "run_at", "net_ir", "stability")
    reason = F.when(F.col("run_at").isNull(), F.lit(None)).when(F.col("stability") < least_stability, "stability").when(F.col("net_ir").isNull() | (F.col("net_ir") <= least_ir), "net_ir")
    return active.select("factor").distinct().join(newest, "factor", "left").select("factor", reason.alias("reason"))


def tags(members: DataFrame, key: str, snapshot: str, tag: str) -> DataFrame:
    """(key, tags): the distinct tags of a key's newest snapshot, sorted, joined by commas."""
    return tables.at_latest(members, [key], snapshot).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("tags"))


def quarters(first: Column, last: Column) -> Column:
    """The ends of the quarters from that of ``first`` to that of ``last``."""
    return F.transform(F.sequence(F.trunc(first, "quarter"), F.trunc(last, "quarter"), F.expr("interval 3 month")), lambda d: F.date_sub(F.add_months(d, 3), 1))


def liquid_recently(panel: DataFrame, dates: int, least: float) -> DataFrame:
    """(code, amount) of codes whose mean amount over the newest ``dates`` of the calendar is ``least`` or more; gaps don't count."""
    newest = panel.select("dt").distinct().orderBy(F.desc("dt")).limit(dates)
    return panel.join(F.broadcast(newest), "dt", "left_semi").groupBy("code").agg(F.avg("amount").alias("amount")).filter(F.col("amount") >= least)


def momentum_score() -> Column:
    """0 to 100 from a row's ma5, ma20, ma60, close, dif, dea, chg, volume, vol_ma5, high20 and rsi; unknown values add nothing."""
    points = [
        F.when((F.col("ma5") > F.col("ma20")) & (F.col("ma20") > F.col("ma60")) & (F.col("close") > F.col("ma20")), 25).when(F.col("close") > F.col("ma60"), 10),
        F.when(F.col("dif") > F.col("dea"), 15),
        F.when((F.col("dif") > F.col("dea")) & (F.col("dif") > 0), 5),
        F.when((F.col("chg") > 1) & (F.col("volume") > 1.2 * F.col("vol_ma5")), 15),
        F.when(F.col("close") >= 0.98 * F.col("high20"), 15),
        F.when(F.col("rsi").between(50, 70), 10),
        F.when(F.col("rsi") > 80, -10),
    ]
    total = sum((F.coalesce(p, F.lit(0)) for p in points), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total))
