"""The expression compiler, the rules of the simulator and the entry."""

import datetime

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from shoal.operators import screen, simulate
from shoal.plans import dsl
from shoal.sources import bars


@pytest.fixture(scope="module")
def wide():
    r = np.random.default_rng(0)
    return pd.DataFrame(r.normal(100, 1, (40, 6)), index=pd.date_range("2024-01-01", periods=40), columns=list("abcdef"))


def panel(spark, wide):
    x = wide.stack().rename_axis(["dt", "code"]).rename("close").reset_index()
    x["dt"] = x["dt"].dt.date
    for c in ("open", "high", "low", "volume", "amount"):
        x[c] = x["close"]
    return bars.densify(spark.createDataFrame(x))


def back(df, name):
    x = df.select("code", "dt", name).toPandas().pivot(index="dt", columns="code", values=name).astype(float)
    x.index = pd.to_datetime(x.index)
    return x


CASES = {
    "sma(close, 5)": lambda w: w.rolling(5, min_periods=2).mean(),
    "ema(close, 5)": lambda w: w.ewm(span=5, adjust=False, min_periods=2).mean(),
    "std(close, 5)": lambda w: w.rolling(5, min_periods=2).std(),
    "ref(close, 3)": lambda w: w.shift(3),
    "returns(close, 3)": lambda w: w / w.shift(3) - 1,
    "cs_rank(close)": lambda w: w.rank(axis=1, pct=True),
    "cs_rank(ema(sma(close, 5), 3))": lambda w: w.rolling(5, min_periods=2).mean().ewm(span=3, adjust=False, min_periods=1).mean().rank(axis=1, pct=True),
}


def test_factors_match_pandas_and_do_not_look_ahead(spark, wide):
    names = {f"f{k}": e for k, e in enumerate(CASES)}
    got = dsl.compile_factors(panel(spark, wide), names).cache()
    later = wide.copy()
    later.iloc[30:] *= 3
    moved = dsl.compile_factors(panel(spark, later), names).cache()
    for name, expr in names.items():
        x = back(got, name)
        np.testing.assert_allclose(x.to_numpy(), CASES[expr](wide).to_numpy(), rtol=1e-9, err_msg=expr)
        np.testing.assert_allclose(x.iloc[:30].to_numpy(), back(moved, name).iloc[:30].to_numpy(), rtol=1e-12, err_msg=expr)


@pytest.mark.parametrize("text", ["nope(close)", "price", "sma(close, 5", "close close", "sma(close; 5)", ""])
def test_bad_expressions(text):
    with pytest.raises(ValueError):
        dsl.parse(text)


def test_recipes_expand():
    made = dsl.expand([{"id": "m", "category": "c", "expr": "sma(close, {w})", "params": ["w"]}, {"id": "k", "category": "c", "expr": "close"}], {"w": [5, 10]})
    assert [(s.id, s.expr) for s in made] == [("m__w5", "sma(close, 5)"), ("m__w10", "sma(close, 10)"), ("k", "close")]


def test_exits():
    go = lambda o, lo, hi, held=1, **k: simulate.exit_price({"px": 100.0, "peak": 110.0}, o, lo, hi, **({"stop": -8, "profit": 8, "trail": None, "horizon": 5, "stuck": 10, "held": held} | k))
    assert go(100, 90, 101) == (92.0, "stop") and go(90, 89, 95) == (90, "stop")
    assert go(100, 99, 109) == (108.0, "profit") and go(100, 98, 101, trail=10) == (99.0, "trail")
    assert go(100, 99, 101, held=4) == (100, "age") and go(100, 99, 101) is None and go(100, 1, 999, held=0) is None
    assert go(None, None, None, held=10) == (100.0, "stuck") and go(None, None, None, held=9) is None
    assert go(112, 110, 115) == (108.0, "profit") and go(112, 110, 115, profit=None) is None  # a gap fills at the goal
    assert go(50, 40, 60, stop=None) is None and go(50, 40, 60, stop=None, trail=5) == (50, "trail")
    assert go(100, 99, 101, horizon=1) == (100, "age") and go(100, 99, None, held=4) == (100, "age")
    assert simulate.position_return(110.0, 100.0) == pytest.approx(110 * (1 - simulate.COST_SELL) / (100 * (1 + simulate.COST_BUY)) - 1)
    with pytest.raises(ValueError):
        go(1, 1, 1, profit=0)


def test_cap_edges(spark):
    rows = spark.createDataFrame([("a", "x", 9.0), ("b", "x", 8.0), ("c", None, 7.0), ("d", " ", 6.0), ("e", "y", 5.0)], "code string, industry string, score double")
    top = lambda n, cap: [r.code for r in screen.capped_top(rows, n, cap).orderBy("rank").collect()]
    assert top(4, 1) == ["a", "c", "d", "e"] and top(2, 0) == ["a", "b"] and top(0, 1) == []


def test_entry_and_rows_only_queries(spark):
    assert entry.entry(spark).count() > 0
    for name in ("backtest_sim", "backtest_trades", "research_loop"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    made = entry.queries()["backtest_results"](spark, "/root/testdata/sf0.001").collect()
    assert {r.run_id for r in made} == {"h4", "h8"} and all(0 <= r.win_rate <= 1 and r.n_trades > 0 and r.max_drawdown <= 0 for r in made)


def test_stream_equals_batch(spark, tmp_path):
    from shoal.streaming.bars import daily_bars

    rows = [("a", datetime.datetime(2024, 1, d, h), float(d * h)) for d in (1, 2, 20) for h in (1, 5)]
    spark.createDataFrame(rows, "code string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("code string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = daily_bars(stream).writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    closed = sorted(tuple(r) for r in spark.table("bars_out").collect())
    batch = sorted(tuple(r) for r in daily_bars(spark.read.parquet(str(tmp_path / "in"))).collect())
    assert closed and set(closed) <= set(batch)


def test_momentum_score(spark):
    from shoal.operators import research

    names = "ma5 ma20 ma60 close dif dea chg volume vol_ma5 high20 rsi"
    rows = [(3.0, 2.0, 1.0, 4.0, 0.2, 0.1, 2.0, 2.0, 1.0, 4.0, 60.0), (1.0, 2.0, 3.0, 1.0, 0.0, 0.1, 0.0, 1.0, 1.0, 4.0, 90.0), (None,) * 11, (1.0, 2.0, 3.0, 4.0, -0.1, -0.2, 0.0, 1.0, 1.0, 9.0, 40.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names.split()))
    assert [r[0] for r in df.select(research.momentum_score().alias("s")).collect()] == [85, 0, 0, 25]


def test_research_edges(spark):
    from pyspark.sql import functions as F

    from shoal.operators import research

    tall = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 1, "y", 2.0), ("b", 1, "x", 3.0), ("b", 1, "y", None)], "factor string, dt int, code string, value double")
    assert [tuple(r) for r in research.pair_correlations(tall).collect()] == [("a", "b", 1, 0.0)]
    assert research.pair_correlations(tall.limit(0)).count() == 0
    evals = spark.createDataFrame([("a", 1, -1.0, 1.0), ("a", 2, 1.0, 1.0), ("b", 1, None, 1.0), ("c", 1, 1.0, -1.0)], "factor string, run_at int, net_ir double, stability double")
    active = spark.createDataFrame([(f,) for f in "abcda"], "factor string")
    assert {tuple(r) for r in research.demotions(active, evals).collect()} == {("a", None), ("b", "net_ir"), ("c", "stability"), ("d", None)}
    ends = spark.sql("select date'2024-02-10' as f, date'2024-07-01' as l").select(research.quarters(F.col("f"), F.col("l")).alias("q")).first().q
    assert [str(d) for d in ends] == ["2024-03-31", "2024-06-30", "2024-09-30"]
    series = spark.createDataFrame([("a", k, float(k)) for k in range(3)], "code string, dt int, x double")
    assert research.stability(series, "code", "x", window=4).count() == 0


def test_quotes_short_lines_blank_prices_and_bad_numbers(spark):
    from shoal.sources import quotes

    body = ["" for _ in range(quotes.LEAST)]
    body[1], body[3], body[36], body[39], body[45] = "One", "2.5", "7", "-", "0"
    none = [*body]
    none[3] = ""
    text = f'v_sh600001="{"~".join(body)}";\nv_sz000002="{"~".join(none)}";v_sz000003="a~b";'
    got = quotes.parse(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()
    assert [(r["code"], r["name"], r["price"], r["volume"], r["amount"], r["pe"], r["total_mv"]) for r in got] == [("600001", "One", 2.5, 700.0, 0.0, None, None)]


def test_selection_queries_choose_factors(spark):
    import __spark_entry__ as entry

    q, sf = entry.queries(), "/root/testdata/sf0.001"
    signals = q["technical_score"](spark, sf).collect()
    assert signals and all(r["score"] > {"momentum": 25, "reversal": 40}[r["strategy"]] and r["score"] <= 100 for r in signals)
    mined = sorted(q["mine_factors"](spark, sf).collect())
    assert mined and [r["sharpe"] for r in mined] == sorted(r["sharpe"] for r in mined)
    # the second factor must raise what the first gives alone
    assert len({r["factor"] for r in mined}) == len(mined)
    chosen = [r["factor"] for r in q["greedy_select"](spark, sf).collect()]
    assert len(chosen) == len(set(chosen))
    walk = q["walk_forward_sim"](spark, sf).collect()
    assert walk and sum(r["trades"] for r in walk) > 0 and max(r["positions"] for r in walk) <= 5


def test_guard_of_no_evaluations(spark):
    from shoal.operators import selection

    none = spark.createDataFrame([], "factor string, run_at int, net_ir double, stability double")
    assert selection.guard(none).first().asDict() == {"bad": 0, "warn": 0, "names": ""}


def test_quality_over_time_and_unknown_reports(spark):
    import datetime as d

    from shoal.operators import quality

    days = [d.date(2024, 1, 1) + d.timedelta(30 * i) for i in range(6)]
    grid = spark.createDataFrame([(c, x) for c in "abc" for x in days], "code string, dt date")
    bars = spark.createDataFrame([("a", days[0]), ("a", days[5]), ("b", days[0]), ("b", days[2])], "code string, dt date")
    reports = spark.createDataFrame(
        [("a", days[0], days[1], False, 4e9, None, None), ("a", days[2], days[3], False, 4e9, -1.0, None), ("a", days[1], days[3], False, 4e9, 1.0, None), ("b", days[0], None, False, 4e9, 1.0, 85.0), ("c", days[0], days[0], False, 4e9, 1.0, 1.0)],
        "code string, period date, as_of date, st boolean, circ_mv double, roe double, debt double",
    )
    got = {(r.code, r.dt): r.ok for r in quality.quality_panel(grid, reports, bars, quality.sound()).collect()}
    want = {"a": [False, True, True, False, False, False], "b": [False, True, True, False, False, False], "c": [False] * 6}
    assert got == {(c, x): ok for c, oks in want.items() for x, ok in zip(days, oks, strict=True)}
    empty = quality.quality_panel(grid, reports.limit(0), bars, quality.sound()).collect()
    assert len(empty) == 18 and not any(r.ok for r in empty)


def test_active_set_weights_and_promotion(spark):
    from pyspark.sql import functions as F

    from shoal.operators import evolution

    log = spark.createDataFrame([("x", 1, "[9]"), ("x", 2, "[3, 1, 2, 7]"), ("y", 3, "[5]")], "source string, at int, factors_json string")
    library = spark.createDataFrame([(1,), (2,), (3,)], "factor bigint")
    evals = spark.createDataFrame([(1, 1, 5.0, 1.0), (1, 2, float("nan"), -2.0), (3, 1, 0.5, 9.0)], "factor bigint, run_at int, net_ir double, is_icir double")
    active = evolution.active_set(log, "x")
    got = sorted(tuple(r) for r in evolution.active_specs(active, library, evals).collect())
    assert got == [(0, 3, 0.5), (1, 1, -2.0), (2, 2, 1.0)]
    zero = spark.createDataFrame([(i, 1, 0.0, 1.0) for i in (1, 2, 3)], "factor bigint, run_at int, net_ir double, is_icir double")
    assert {r.weight for r in evolution.active_specs(active, library, zero).collect()} == {1.0}
    assert evolution.degraded(evolution.active_specs(active, library, evals), evals.limit(0)).first().degraded
    pairs = [(None, None), (0.0, None), (0.1, None), (0.5, 0.49), (0.52, 0.49), (None, 0.1), (float("nan"), 0.1), (0.3, float("nan"))]
    made = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, new double, old double")
    said = [r.v for r in made.select("i", evolution.promotion(F.col("new"), F.col("old")).alias("v")).orderBy("i").collect()]
    assert said == ["first: unknown", "first: not positive", "promote", "too little", "promote", "unknown", "unknown", "unknown"]


def test_a_run_by_hand(spark):
    """Two slots over six dates: a profit, a stop by a gap, a code without a close at the end, and one sold at the end."""
    from shoal.operators.stats import COST_BUY, COST_SELL

    days = [datetime.date(2024, 1, 1) + datetime.timedelta(7 * i) for i in range(6)]
    bar = lambda i, c, o, h, lo, cl: (days[i], c, o, h, lo, cl)
    prices = [bar(i, c, 10.0, 10.0, 10.0, 10.0) for i in range(6) for c in "abc"]
    prices[1 * 3 + 0] = bar(1, "a", 10.0, 10.5, 9.9, 10.2)
    prices[2 * 3 + 0] = bar(2, "a", 10.5, 11.0, 10.4, 10.9)  # over 8 %: leaves at 10.8
    prices[3 * 3 + 1] = bar(3, "b", 9.0, 9.1, 8.9, 9.0)  # opens beyond the stop: leaves at 9
    prices[5 * 3 + 2] = bar(5, "c", None, None, None, None)
    signals = [(days[1], "a", 1, True), (days[1], "b", 2, True), (days[1], "c", 3, True), (days[4], "c", 1, True), (days[4], "a", 2, True)]
    p = spark.createDataFrame(prices, "dt date, code string, open double, high double, low double, close double")
    s = spark.createDataFrame(signals, "dt date, code string, pick int, enter boolean")
    run = {"run_id": "r", "top": 2, "horizon": 9, "stop": -8.0, "profit": 8.0, "trail": None}
    curves = simulate.backtest(s, p, [run], capital=100_000.0).cache()
    got = [(r.code, days.index(r.bought), days.index(r.sold), r.reason) for r in simulate.trade_list(curves).orderBy("sold", "code").collect()]
    assert got == [("a", 1, 2, "profit"), ("b", 1, 3, "stop"), ("a", 4, 5, "final")]
    n = int(50_000 / (10 * (1 + COST_BUY)) // 100) * 100
    cash = 100_000 - 2 * n * 10 * (1 + COST_BUY)
    eq = {r.dt: r.eq for r in curves.collect()}
    assert eq[days[0]] == eq[days[1]] == 100_000
    assert eq[days[2]] == pytest.approx(cash + n * (10.9 + 10))
    cash += n * 10.8 * (1 - COST_SELL)
    assert eq[days[3]] == pytest.approx(cash + n * 9)
    cash += n * 9 * (1 - COST_SELL)
    assert eq[days[4]] == pytest.approx(cash)
    done = simulate.results(curves, 100_000.0, p.filter("code = 'b'").select("dt", "close")).first()
    assert done.n_trades == 3 and done.win_rate == pytest.approx(1 / 3) and done.total_return == pytest.approx(eq[days[5]] / 100_000 - 1)
    assert done.bench_return == 0 and [e.dt for e in done.equity] == days
    assert simulate.results(simulate.backtest(s.limit(0), p, [run]), 1.0).count() == 0


def test_greedy_falls_back_and_drops_relatives():
    from shoal.operators import stats

    row = lambda i, icir, oos=1.0, n=60: {"id": i, "n": n, "icir": icir, "oos_icir": oos}
    rows = [row("a", 3.0), row("b", 2.0), row("c", 1.0), row("d", 9.0, n=49), row("e", 0.4), row("f", 5.0, None), row("g", None)]
    assert stats.greedy(rows, {("a", "b"): 0.7, ("a", "c"): -1.0}) == ["a", "c"]
    assert stats.greedy(rows, {}, top=2) == ["a", "b"]
    assert stats.greedy([row("x", 1.0, None), row("y", 2.0, None)], {}) == ["y", "x"] and stats.greedy([], {}) == []


def test_forward_selection_trades_a_negative_factor_the_right_way(spark):
    """A factor whose high values fall is bought where it is low, as its weight is negative."""
    from pyspark.sql import functions as F

    from shoal.operators import selection

    days = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(12)]
    rows = [(d, c, float(k)) for d in days for k, c in enumerate("abcd")]
    z = spark.createDataFrame([("f", d, c, v) for d, c, v in rows], "factor string, dt date, code string, value double")
    weights = spark.createDataFrame([("f", d, -1.0) for d in days], "factor string, dt date, weight double")
    steps = {"a": 1.05, "b": 1.03, "c": 0.99, "d": 0.95}
    px = [(d, c, *(100 * steps[c] ** i * (1 + 0.001 * (i % 3)),) * 4) for i, d in enumerate(days) for c in "abcd"]
    prices = spark.createDataFrame(px, "dt date, code string, open double, high double, low double, close double")
    chosen = selection.forward_select(z, weights, ["f"], prices, top=1, horizon=3, stop=None, profit=None, trail=None)
    assert chosen[0][0] == "f" and chosen[0][1] > 0
    assert selection.recommend(z, weights, z.agg(F.max("dt").alias("dt")), 2).collect()[0].asDict() == {"code": "a", "score": 0.0, "reasons": "f-0.00"}


def test_folds_hold_each_date_once_per_fold(spark):
    from shoal.operators import selection

    r = np.random.default_rng(3)
    ic = r.normal(0.1, 1, 50)
    rows = [("a", k, float(x)) for k, x in enumerate(ic)] + [("b", k, 1.0) for k in range(9)]
    got = selection.fold_ratios(spark.createDataFrame(rows, "factor string, dt int, ic double"), 12, 6, 5).collect()
    begins = range(0, 50 - 18 + 1, 5)
    ratio = lambda x: x.mean() / x.std(ddof=1) * 252**0.5
    assert [r.factor for r in got] == ["a"] and got[0].folds == len(begins)
    assert got[0].is_icir == pytest.approx(np.mean([ratio(ic[b : b + 12]) for b in begins]))
    assert got[0].oos_icir == pytest.approx(np.mean([ratio(ic[b + 12 : b + 18]) for b in begins]))


def test_research_loop_finds_the_planted_factor(spark):
    """Prices that follow last week's volume: the factor that reads it passes, its copy goes, noise fails; nothing passes an impossible gate."""
    from shoal.operators import evolution, selection, stats
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    n, codes = 120, 30
    volume = r.normal(size=(n, codes))
    change = np.vstack([np.zeros((2, codes)), 0.02 * volume[:-2]]) + r.normal(0, 0.01, (n, codes))
    price = 100 * np.exp(np.cumsum(change, axis=0))
    rows = [(f"c{j:02}", datetime.date(2024, 1, 1) + datetime.timedelta(i), *(float(price[i, j]),) * 4, float(volume[i, j]), float(r.normal())) for i in range(n) for j in range(codes)]
    p = bars.densify(spark.createDataFrame(rows, "code string, dt date, open double, high double, low double, close double, volume double, amount double"))
    labels = p.select("dt", "code", F.lit(2).alias("h"), stats.forward_return(2).alias("fwd"))
    specs = [dsl.Spec("good", "x", "add(volume, 0)"), dsl.Spec("copy", "x", "cs_rank(volume)"), dsl.Spec("noise", "x", "add(amount, 0)"), dsl.Spec("bad", "x", "sub(0, volume)")]
    go = lambda **k: {x.factor: x for x in evolution.research_loop(p, labels, specs, folds=(60, 20, 20), window=60, batch=3, **k).collect()}
    got = go(gate=5.0)
    assert len(got) == 1 and set(got) <= {"good", "copy"}
    x = next(iter(got.values()))
    assert x.selected and x.reason is None and x.net_ir > 0 and x.verdict == "promote" and x.new_oos == pytest.approx(x.oos_icir)
    assert next(iter(go(gate=5.0, old_oos=x.new_oos).values())).verdict == "too little"
    assert go(gate=1e9) == {}


def test_catalogue_compiles(spark, wide):
    from shoal.plans import catalogue

    specs = catalogue.catalogue([{"id": "own", "category": "c", "expr": "close"}, {"id": "level_close", "category": "c", "expr": "open"}])
    ids = [s.id for s in specs]
    assert len(ids) == len(set(ids)) > 200 and "own" in ids and {s.expr for s in specs if s.id == "level_close__w5"} == {"sub(div(close, sma(close, 5)), 1)"}
    for s in specs:
        dsl.parse(s.expr)
    few = {s.id: s.expr for s in catalogue.catalogue(grid={"w": [4], "k": [2]})}
    assert set(few) <= set(dsl.compile_factors(panel(spark, wide), few).columns)


def test_partitions_are_replaced_and_runs_logged(spark, tmp_path):
    from shoal.sources import store

    path = str(tmp_path / "t")
    t = lambda rows: spark.createDataFrame(rows, "k int, v string")
    store.replace_partitions(t([(1, "a"), (1, "b"), (2, "c")]), path, ["k"])
    store.replace_partitions(t([(1, "z")]), path, ["k"])
    store.replace_partitions(t([]), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]
    logs = str(tmp_path / "logs")
    with store.Run(spark, logs, "r1", "screen") as run:
        run.claim("pick", "ten codes", source="here")
        run.calc("x", 1.5, "f", {"a": 1})
        run.conflict("pe", ("one", 1), ("two", 2))
        run.summary = {"n": 10}
    with pytest.raises(ZeroDivisionError), store.Run(spark, logs, "r2", "screen"):
        raise ZeroDivisionError("no")
    assert {(r.run_id, r.status, r.summary_json, r.error) for r in store.manifest(spark, logs).collect()} == {("r1", "complete", '{"n": 10}', None), ("r2", "failed", None, "no")}
    assert [spark.read.parquet(f"{logs}/{k}").count() for k in ("evidence", "calc", "conflicts")] == [1, 1, 1]


def test_listing_edges(spark):
    from pyspark.sql import functions as F

    from shoal.operators import tables
    from shoal.sources import quotes

    x = spark.createDataFrame([("600001", "*st one"), ("300001", "two\u9000"), ("830001", None), ("", "x")], "code string, name string")
    assert [tuple(r) for r in x.select(quotes.exchange(F.col("code")), quotes.special(F.col("name"))).collect()] == [("sh", True), ("sz", True), ("bj", False), ("sz", False)]
    b = spark.createDataFrame([("a", datetime.date(2024, 1, 9)), ("b", datetime.date(2024, 1, 8)), ("c", datetime.date(2024, 1, 7))], "code string, dt date")
    assert [(r.code, r.lag) for r in tables.gaps(b).collect()] == [("c", 2)] and tables.gaps(b.limit(0)).count() == 0
    rows = spark.createDataFrame([], "pe double")
    assert screen.missing_alert(rows, ["pe", "pe"]).first().asDict() == {"n": 0, "missing": 0, "alert": False}
