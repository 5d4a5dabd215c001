"""Many factors by numpy over matrices of codes, against Spark's windows on odd tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.plans import catalogue, dsl

SF = "/root/testdata/sf0.001"
OWN = ["sma(cs_rank(close), 5)", "ema(close, 1)", "cs_zscore(ema(volume, 7))", "sign(sub(open, close))", "close", "add(1, 2)", "sma(1, 5)", "returns(cs_rank(close), 2)", "corr(close, volume, 1)", "std(close, 1)", "ref(close, 200)", "ref(sma(corr(close, open, 7), 3), 0)", "log(sub(open, close))", "sma(close, 500)", "ts_rank(close, 200)", "zscore(open, 4)"]


@pytest.fixture(scope="module")
def odd(spark):
    """Gaps, constant and zero values, codes without values or with one date, codes of unequal length, in no order."""
    r = np.random.default_rng(8)
    rows = []
    for c in range(12):
        for d in sorted(r.choice(40, 1 if c == 11 else 40 if c % 3 else 23, replace=False).tolist()):
            v = [float(np.round(x, 2)) for x in 10 + r.normal(size=6)]
            v[0] = 0.1 if c % 4 == 0 else v[0]
            v[3] = None if c == 5 or r.random() < 0.2 else v[3]
            v[4] = 0.0 if r.random() < 0.3 else 0.3 if c % 4 == 1 else v[4]
            rows.append((f"c{c}" if c else None, datetime.date(2024, 1, 1) + datetime.timedelta(d), *v))
    return spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "code string, dt date, open double, high double, low double, close double, volume double, amount double").cache()


def values(df, ids):
    return {(r.code, r.dt): [np.nan if r[f] is None else r[f] for f in ids] for r in df.collect()}


def test_numpy_gives_what_windows_give(spark, odd, monkeypatch):
    exprs = {s.id: s.expr for s in catalogue.catalogue(grid={"w": [1, 4, 7, 30], "k": [0, 3]})} | {f"own{k}": e for k, e in enumerate(OWN)}
    monkeypatch.setattr(dsl, "MATRIX", 100)
    for ids in dsl.batches(exprs, 60, 20):
        part = {f: exprs[f] for f in ids}
        want, got = values(dsl.compile_factors(odd, part), ids), values(dsl.compile_many(odd, part, odd.count()), ids)
        assert want.keys() == got.keys()
        for k, row in want.items():
            np.testing.assert_allclose(got[k], row, rtol=1e-9, atol=1e-9, err_msg=f"{k}: {ids}")


def test_added_operators_stay_with_spark(spark, odd):
    dsl.register_operator("thrice", lambda x: x * 3)
    try:
        own = {"a": "sma(thrice(sma(close, 3)), 2)", "b": "thrice(open)", "c": "cs_rank(sub(thrice(close), volume))"}
        want, got = values(dsl.compile_factors(odd, own), "abc"), values(dsl.compile_many(odd, own, 400), "abc")
        for k, row in want.items():
            np.testing.assert_allclose(got[k], row, rtol=1e-9, err_msg=k)
    finally:
        del dsl.OPERATORS["thrice"]


def test_many_factors_of_no_rows_and_bad_names(spark, odd):
    assert dsl.compile_many(odd.limit(0), {"a": "sma(close, 3)"}, 0).collect() == []
    with pytest.raises(ValueError):
        dsl.compile_many(odd, {"close": "open"}, 1)


def test_the_catalogue_has_no_windows_over_codes(spark):
    import __spark_entry__ as entry

    x = entry.queries()["recipe_catalogue"](spark, SF)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(dt" in plan and "windowspecdefinition(code" not in plan
    n = {r.factor: r.n for r in x.filter(F.col("factor").isin("change_close__k5", "ranked_close__k5")).collect()}
    assert n["change_close__k5"] == n["ranked_close__k5"] > 0


def test_ranks_and_turnover_of_wide_tables(spark, odd):
    from shoal.operators import research, selection

    x = odd.filter("code is not null").withColumn("fwd", F.col("open"))
    fs = ["close", "volume"]
    r = research.date_ranks(x.select("dt", "code", "fwd", *fs), fs).cache()
    tall = selection.ranked(selection.tall(x, {f: F.col(f) for f in fs}))
    want = {(k.factor, k.dt, k.code): k.r for k in tall.collect()}
    got = {(k.factor, k.dt, k.code): k.value for k in selection.tall(r, {f: F.col(f) for f in fs}).collect()}
    assert got == want and len(got) > 500
    want = {k.factor: k.turnover for k in selection.turnovers(tall).collect()}
    assert {k.factor: k.turnover for k in selection.wide_turnovers(r, fs).collect()} == pytest.approx(want)


def test_tables_of_two_blocks_make_one_matrix_a_date(spark, odd, monkeypatch):
    from shoal.operators import research

    x = odd.filter("code is not null").withColumn("copy", F.col("close"))
    tables = [x.select("dt", "code", "open", "close"), x.select("dt", "code", "volume").filter("code <> 'c3'"), x.select("dt", "code", "high", "copy")]
    go = lambda: {(r.f1, r.f2): (r.cells, r["corr"]) for r in research.wide_correlations(tables, 20).collect()}
    one = go()
    assert "CoGroups" not in research.wide_correlations(tables)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(research, "BLOCK", 2)
    parts = go()
    assert one.keys() == parts.keys() and len(one) == 10 and one["close", "copy"][1] == pytest.approx(1)
    assert all(one[k][0] == parts[k][0] and one[k][1] == (None if parts[k][1] is None else pytest.approx(parts[k][1])) for k in one)


def test_the_loop_takes_no_windows_over_codes_for_its_factors(spark, odd, monkeypatch):
    from shoal.operators import evolution

    plans, real = [], evolution.kept
    monkeypatch.setattr(evolution, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    p = odd.filter("code is not null")
    evolution.research_loop(p, p.select("dt", "code", F.lit(1).alias("h"), F.col("amount").alias("fwd")), [dsl.Spec("a", "x", "ema(sma(close, 5), 3)")], gate=-99.0, least=2).collect()
    made = [x for x in plans if "MapInArrow" in x]
    assert made and not any("Window" in x for x in made)
