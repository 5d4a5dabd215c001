"""Panel functions as columns: rolling by code, ranks by date, guarded arithmetic. Missing is null, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_code():
    return Window.partitionBy("code").orderBy("dt")


def by_date():
    return Window.partitionBy("dt")


def last(n: int):
    """The current date and the n - 1 before it."""
    return by_code().rowsBetween(-(n - 1), 0)


def half(n: int) -> int:
    """Observations that a window of the expression language needs."""
    return max(1, n // 2)


def rolling(agg, x: Column, n: int, least: int | None = None) -> Column:
    """agg over the last n dates where at least ``least`` (default n) are not null."""
    w = last(n)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def returns(x: str, n: int) -> Column:
    """Relative change over n dates of a series whose gaps are filled already."""
    return F.try_divide(F.col(x), F.lag(x, n).over(by_code())) - 1


def filled(x: Column) -> Column:
    """The last value that isn't null."""
    return F.last(x, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


def corr(a: Column, b: Column, n: int, least: int) -> Column:
    """Rolling Pearson correlation over complete pairs; null where either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y, w = F.when(both, a), F.when(both, b), last(n)
    return F.when(F.count(x).over(w) >= least, F.try_divide(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)))


def ts_rank(x: Column, n: int, least: int) -> Column:
    """The share of the window's dates, gaps included, whose value is at most the current one."""
    w = last(n)
    held = F.collect_list(F.struct(x.alias("x"))).over(w)
    return F.when(F.count(x).over(w) >= least, F.size(F.filter(held, lambda k: k["x"] <= x)) / F.size(held))


def rank_pct(x: Column, by: list[str] | None = None) -> Column:
    """Average rank among the values that aren't null, over their number; all of it in one order of the rows, so with one sort."""
    w = Window.partitionBy(*(by or ["dt"])).orderBy(x.asc_nulls_last())
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # this value's copies too
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2 / F.count(x).over(all_))


def zscore_by_date(x: Column, population: bool = False) -> Column:
    dev = F.stddev_pop if population else F.stddev_samp
    return F.try_divide(x - F.avg(x).over(by_date()), F.nullif(dev(x).over(by_date()), F.lit(0.0)))


#: Decay, in powers of e, that one block of a recurrence spans; what lies two blocks back weighs e^-SPAN or less.
SPAN = 100.0


def ewm(panel: DataFrame, specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Columns name -> (source, alpha, least): exponential means by code, recursive (not adjusted), whose old
    weight decays over gaps too; null until ``least`` values have been seen.

    A mean takes the last one by an affine step, y = a y + b, so it is a sum of all b, each decayed by the a after it. The logarithms
    of the a add up along the series; sums run in blocks of ``SPAN`` of that total, where no factor leaves the range of doubles, and a
    block takes over the sum of the block before it. All of it is windows over the code.
    """
    w = by_code()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    flat = {n for n, (_, alpha, _) in specs.items() if alpha >= 1}
    steps: list[dict[str, Column]] = [{"_i": F.row_number().over(w)}, {}, {}, {}, {}, {}]
    for n, (x, alpha, _) in specs.items():
        if n in flat:
            continue
        c = F.col(x).cast("double")
        steps[1][f"_g{n}"] = F.when(c.isNotNull(), F.col("_i") - F.last(F.when(c.isNotNull(), F.col("_i")), ignorenulls=True).over(past))
        old = F.pow(F.lit(1 - alpha), F.col(f"_g{n}"))
        steps[2][f"_l{n}"] = F.when(c.isNotNull(), F.coalesce(F.col(f"_g{n}") * math.log(1 - alpha) - F.ln(old + alpha), F.lit(0.0)))
        steps[2][f"_b{n}"] = F.when(F.col(f"_g{n}").isNull(), c).otherwise(alpha * c / (old + alpha))
        steps[3][f"_s{n}"] = -F.sum(f"_l{n}").over(w)
        block = F.floor(F.col(f"_s{n}") / SPAN)
        steps[4][f"_k{n}"] = block
        steps[4][f"_e{n}"] = F.exp(F.col(f"_s{n}") - SPAN * block)
        inside = Window.partitionBy("code", f"_k{n}").orderBy("dt")
        before = Window.partitionBy("code").orderBy(f"_k{n}").rangeBetween(-1, -1)
        part = F.col(f"_b{n}") * F.col(f"_e{n}")
        steps[5][f"_t{n}"] = F.sum(part).over(inside) + math.exp(-SPAN) * F.coalesce(F.sum(part).over(before), F.lit(0.0))
    out = panel
    for columns in steps:
        out = out.withColumns(columns)
    seen = {n: F.count(x).over(w) >= least for n, (x, _, least) in specs.items()}
    found = {n: F.last(F.col(specs[n][0]).cast("double"), ignorenulls=True).over(w) if n in flat else F.col(f"_t{n}") / F.col(f"_e{n}") for n in specs}
    return out.withColumns({n: F.when(seen[n], found[n]) for n in specs}).select(*panel.columns, *specs)


def rsi(up: Column, down: Column, full_at_zero: bool = True) -> Column:
    """From the means of gains and losses; with no losses 100 or, in the panel variant, null."""
    value = 100 - 100 / (1 + F.try_divide(up, down))
    return F.when((down == 0) & (up > 0), F.lit(100.0)).otherwise(value) if full_at_zero else value
