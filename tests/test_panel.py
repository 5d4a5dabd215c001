"""Panels, exponential means in blocks and what added operators may not do."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoal.functions import panel as P
from shoal.plans import causal, dsl
from shoal.sources import bars

DAY = datetime.date(2024, 1, 1)
DAYS = [DAY + datetime.timedelta(k) for k in range(700)]


def test_every_code_has_every_date(spark):
    rows = [("a", 0), ("a", 3), ("b", 2), ("c", 4)]
    got = bars.densify(spark.createDataFrame([(c, DAYS[k], float(k)) for c, k in rows], "code string, dt date, close double")).collect()
    want = {(c, DAYS[k]): float(k) if (c, k) in rows else None for c in "abc" for k in (0, 2, 3, 4)}
    assert {(r.code, r.dt): r.close for r in got} == want and len(got) == len(want)
    assert {(r.code, r.dt) for r in got if r.is_bar} == {(c, DAYS[k]) for c, k in rows}
    x = spark.createDataFrame([("a", DAYS[1], 1.0)], "code string, dt date, close double")
    assert [(r.dt, r.close) for r in bars.densify(x, DAYS[:3]).orderBy("dt").collect()] == [(DAYS[0], None), (DAYS[1], 1.0), (DAYS[2], None)]
    assert bars.densify(x.limit(0)).collect() == [] and bars.densify(x.limit(0)).columns == ["code", "dt", "close", "is_bar"]
    assert bars.at_or_before(DAYS[:3], DAYS[9]) == DAYS[2] and bars.at_or_before(DAYS[:3], DAY - datetime.timedelta(9)) == DAYS[2] and bars.at_or_before([], DAY) is None


def test_a_panel_is_dealt_once_and_read_once(spark):
    plan = P.ewm(bars.panel(spark, "/root/testdata/sf0.001", "sw"), {"e": ("close", 0.2, 5)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize(("alpha", "least"), [(2 / 27, 26), (0.9, 1), (1.0, 1), (1 / 14, 14), (1e-4, 3)])
def test_exponential_means_are_those_of_pandas(spark, alpha, least):
    r = np.random.default_rng(1)
    series = {"full": r.normal(100, 5, 700), "gaps": np.where(r.random(700) < 0.4, np.nan, r.normal(0, 1, 700)), "late": np.r_[np.full(300, np.nan), r.normal(size=400)], "rare": np.where(np.arange(700) % 230 == 7, 3.0 + np.arange(700), np.nan), "none": np.full(700, np.nan)}
    df = pd.DataFrame([(c, d, float(x)) for c, xs in series.items() for d, x in zip(DAYS, xs, strict=True)], columns=["code", "dt", "x"])
    p = spark.createDataFrame(df).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = P.ewm(p, {"e": ("x", alpha, least)}).toPandas()
    for c, xs in series.items():
        mine = got[got.code == c].sort_values("dt")["e"].astype(float).to_numpy()
        np.testing.assert_allclose(mine, pd.Series(xs).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy(), rtol=1e-9, atol=1e-12, err_msg=c)


AHEAD = {
    "lead": lambda x: F.lead(x, 1).over(P.by_code()),
    "negative lag": lambda x: F.lag(x, -2).over(P.by_code()),
    "frame": lambda x: F.avg(x).over(P.by_code().rowsBetween(-2, 1)),
    "whole frame": lambda x: F.max(x).over(P.by_code().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    "whole code": lambda x: x - F.avg(x).over(Window.partitionBy("code")),
    "backwards": lambda x: F.sum(x).over(Window.partitionBy("code").orderBy(F.desc("dt")).rowsBetween(-3, 0)),
    "another order": lambda x: F.sum(x).over(Window.partitionBy("code").orderBy("close")),
    "inside": lambda x: F.when(x > 0, F.coalesce(F.lead(x).over(P.by_code()), F.lit(0.0))).otherwise(0),
    "everything": lambda x: x - F.avg(x).over(Window.partitionBy()),
}


@pytest.mark.parametrize("name", AHEAD)
def test_operators_that_look_ahead_are_refused(spark, name):
    with pytest.raises(causal.LooksAhead):
        dsl.register_operator("bad", AHEAD[name], "code")
    assert "bad" not in dsl.OPERATORS


def test_operators_may_be_added(spark, monkeypatch):
    monkeypatch.setattr(dsl, "OPERATORS", dict(dsl.OPERATORS))
    with pytest.raises(ValueError, match="no windows"):
        dsl.register_operator("bad", lambda x: F.lag(x).over(P.by_code()))
    with pytest.raises(ValueError, match="unknown kind"):
        dsl.register_operator("bad", lambda x: x, "other")
    dsl.register_operator("twice", lambda x: x * 2)
    dsl.register_operator("range_n", lambda x, n: P.rolling(F.max, x, int(n), 1) - P.rolling(F.min, x, int(n), 1), "code")
    dsl.register_operator("demean", lambda x: x - F.avg(x).over(P.by_date()), "date")
    p = bars.densify(spark.createDataFrame([(c, DAYS[k], *(float(k * s),) * 6) for k in range(6) for c, s in (("a", 1), ("b", 3))], f"code string, dt date, {', '.join(f'{f} double' for f in bars.FIELDS)}"))
    got = {(r.code, r.dt): (r.t, r.r, r.d) for r in dsl.compile_factors(p, {"t": "twice(close)", "r": "range_n(close, 3)", "d": "demean(twice(close))"}).collect()}
    assert got["b", DAYS[4]] == (24.0, 6.0, 8.0) and got["a", DAYS[1]] == (2.0, 1.0, -2.0)


TRIED = {"sma": "n", "ts_mean": "n", "ema": "n", "std": "n", "ts_min": "n", "min": "n", "ts_max": "n", "max": "n", "zscore": "n", "ts_rank": "n", "ref": "n", "returns": "n", "corr": "xn", "cs_rank": "", "cs_zscore": "", "add": "x", "sub": "x", "div": "x", "abs": "", "sign": "", "log": ""}


def test_no_operator_sees_the_future(spark):
    assert set(TRIED) == set(dsl.OPERATORS)
    factors = {f"f_{op}": f"{op}(close{', volume' * ('x' in more)}{', 4' * ('n' in more)})" for op, more in TRIED.items()}
    r = np.random.default_rng(4)
    x = r.normal(100, 3, (5, 30, 2))

    def made(values):
        rows = [(f"c{i}", DAYS[k], *(float(values[i, k, 0]),) * 4, *(float(values[i, k, 1]),) * 2) for i in range(5) for k in range(30) if (i + k) % 7]
        p = bars.densify(spark.createDataFrame(rows, f"code string, dt date, {', '.join(f'{f} double' for f in bars.FIELDS)}"))
        return {(q.code, q.dt): q.asDict() for q in dsl.compile_factors(p, factors).collect() if q.dt < DAYS[20]}

    later = x.copy()
    later[:, 20:] *= 5
    assert made(x) == made(later)
