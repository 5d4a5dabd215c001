"""Queries of features, scores, the whole screen and factor selection, with their DuckDB twins; importing this registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import features, research, screen, selection, simulate, stats, tables
from shoal.plans.dsl import compile_factors
from shoal.plans.registry import CORR, DIM, LEAD, SM, SW, again, dim, ewm_sql, macd_sql, query, r6, srank, sroll
from shoal.sources import bars as B
from shoal.sources import quotes
from shoal.sources.commits import kept

_MEANS = {f"ma{n}": ('"close"', n) for n in (5, 10, 20, 60, 120)} | {"vol_ma5": ("volume", 5), "vol_ma20": ("volume", 20), "amount_ma20": ("amount", 20)}
_CHG = '("close" / nullif(lag("close", {n}) OVER (PARTITION BY code ORDER BY dt), 0) - 1) * 100'


_OSC = f"""{macd_sql('sw', SW, 9, 'bars')}, p2 AS (SELECT code, dt, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS down
 FROM (SELECT code, dt, "close" - lag("close", 1) OVER (PARTITION BY code ORDER BY dt) AS d FROM bars)), {again(ewm_sql('sw', {'u': ('up', 1 / 14, 14), 'v': ('down', 1 / 14, 14)}), 3)},
 o AS (SELECT m.code, m.dt, dif, dea, CASE WHEN v = 0 AND u > 0 THEN 100 ELSE 100 - 100 / (1 + u / nullif(v, 0)) END AS rsi FROM m JOIN w3 ON w3.code = m.code AND w3.dt = m.dt)"""
_FEATURES = f"""x AS (SELECT code, dt, "close", volume, {', '.join(f'{sroll("avg", c, n)} AS {k}' for k, (c, n) in _MEANS.items())}, {sroll('max', 'high', 20)} AS high20, {sroll('max', 'high', 250, 60)} AS high250,
 {_CHG.format(n=20)} AS ret_20d, {_CHG.format(n=60)} AS ret_60d, {_CHG.format(n=1)} AS chg, lag(volume) OVER (PARTITION BY code ORDER BY dt) AS vol_prev,
 row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn, row_number() OVER (PARTITION BY code ORDER BY dt) AS i, count(*) OVER (PARTITION BY code) AS n FROM bars)"""
_SHOWN = ["close", *_MEANS, "high20", "high250", "ret_20d", "ret_60d", "chg", "vol_prev", "dif", "dea", "rsi"]


@query(f"""{_OSC}, {_FEATURES} SELECT code, dt, {', '.join(f'round("{c}", 6) AS "{c}"' for c in _SHOWN)} FROM x JOIN o USING (code, dt) WHERE rn = 1 AND n >= 70""")
def features_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = features.newest(features.oscillators(features.indicators(B.week_bars(spark, sf_dir))))
    return x.select("code", "dt", *(r6(c).alias(c) for c in _SHOWN))


_CASES = {
    "momentum": """CASE WHEN ma5 > ma20 AND ma20 > ma60 AND "close" > ma20 THEN 25 WHEN "close" > ma60 THEN 10 ELSE 0 END + CASE WHEN dif > dea THEN 15 ELSE 0 END + CASE WHEN dif > dea AND dif > 0 THEN 5 ELSE 0 END
 + CASE WHEN chg > 1 AND volume > 1.2 * vol_ma5 THEN 15 ELSE 0 END + CASE WHEN "close" >= 0.98 * high20 THEN 15 ELSE 0 END + CASE WHEN rsi BETWEEN 50 AND 70 THEN 10 ELSE 0 END - CASE WHEN rsi > 80 THEN 10 ELSE 0 END""",
    "reversal": """CASE WHEN ret_20d BETWEEN -35 AND -12 THEN 30 ELSE 0 END + CASE WHEN rsi < 38 THEN 20 ELSE 0 END + CASE WHEN "close" > ma5 AND chg > 0 THEN 20 ELSE 0 END
 + CASE WHEN "close" > ma120 THEN 15 ELSE 0 END + CASE WHEN dif > dea AND dif < 0 THEN 10 ELSE 0 END + CASE WHEN ret_60d BETWEEN -50 AND -20 THEN 5 ELSE 0 END""",
}
_SCORED = " UNION ALL ".join(f"""SELECT code, dt, '{k}' AS strategy, greatest(0, least(100, {c}))::BIGINT AS score FROM x JOIN o USING (code, dt) WHERE "close" IS NOT NULL AND amount_ma20 >= 1000 AND i >= 130""" for k, c in _CASES.items())


@query(f"{_OSC}, {_FEATURES} SELECT * FROM ({_SCORED}) WHERE score > CASE strategy WHEN 'momentum' THEN 25 ELSE 40 END")
def technical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of both strategies on every date (the floor on liquidity is lowered to what the tables hold)."""
    x = features.oscillators(features.indicators(B.week_bars(spark, sf_dir)))
    return features.signals(x, 1000.0).select("code", "dt", "strategy", F.col("score").cast("long").alias("score"))


_TALL = """t AS (SELECT dt, code, 'price' AS factor, "close" AS value FROM p UNION ALL SELECT dt, code, 'volume', volume FROM p UNION ALL SELECT dt, code, 'spread', high - low FROM p)"""


def _values() -> dict[str, Column]:
    return {"price": F.col("close"), "volume": F.col("volume"), "spread": F.col("high") - F.col("low")}


def _tall(p: DataFrame) -> DataFrame:
    return selection.tall(p, _values())


def _labels(p: DataFrame, *horizons: int) -> DataFrame:
    x = p.select("dt", "code", *(stats.forward_return(h).alias(f"f{h}") for h in horizons))
    return x.select("dt", "code", F.explode(F.create_map(*(c for h in horizons for c in (F.lit(h), F.col(f"f{h}"))))).alias("h", "fwd"))


@query(f"""WITH {SM}, {_TALL}, l AS (SELECT dt, code, 1 AS h, {LEAD.format(h=2)} AS fwd FROM p UNION ALL SELECT dt, code, 3, {LEAD.format(h=3)} FROM p),
 j AS (SELECT t.*, h, fwd FROM t JOIN l USING (dt, code) WHERE value IS NOT NULL AND fwd IS NOT NULL),
 r AS (SELECT factor, h, dt, {srank('value').replace('PARTITION BY dt', 'PARTITION BY factor, h, dt')} AS rx, {srank('fwd').replace('PARTITION BY dt', 'PARTITION BY factor, h, dt')} AS ry FROM j),
 ic AS (SELECT factor, h, dt, {CORR} AS ic FROM r GROUP BY ALL HAVING count(*) >= 5 AND {CORR} IS NOT NULL)
 SELECT factor, h, count(*) AS n, round(avg(ic), 6) AS ic, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252), 6) AS icir, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)), 6) AS t_stat,
 round(avg((ic > 0)::INT), 6) AS win FROM ic GROUP BY factor, h HAVING count(*) >= 30""".replace("1 AS h", "2 AS h"))
def analyze_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = selection.analyze(selection.own_coefficients(B.panel(spark, sf_dir, "sm"), _values(), {h: stats.forward_return(h) for h in (2, 3)}, 5))
    return s.select("factor", "h", "n", *(r6(c).alias(c) for c in ("ic", "icir", "t_stat", "win")))


_LIM = screen.Limits(min_amount=1000.0)


@query(f"""WITH {DIM}, {SM}, g AS (SELECT code, max(dt) AS last, count(*) AS n FROM bars GROUP BY code),
 a AS (SELECT code, sum(amount) / 6 AS amount FROM (SELECT code, amount, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM bars) WHERE rn <= 6 GROUP BY code),
 x AS (SELECT d.code, industry, score, coalesce(total_mv, 0) >= 5e9 AND coalesce(pe > 0 AND pe <= 40, false) AND coalesce(roe >= 8, false) AND NOT coalesce(debt > 65, false) AS hard,
 coalesce(last >= (SELECT max(dt) FROM bars) - 120, false) AS live, coalesce(n >= 12 AND amount >= 1000, false) AS liquid FROM d LEFT JOIN g USING (code) LEFT JOIN a USING (code)),
 k AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, code) AS rn FROM x WHERE hard AND live AND liquid)
 SELECT step, n FROM (SELECT 'universe' AS step, count(*) AS n FROM x UNION ALL SELECT 'hard', count(*) FROM x WHERE hard UNION ALL SELECT 'live', count(*) FROM x WHERE hard AND live
 UNION ALL SELECT 'liquid', count(*) FROM x WHERE hard AND live AND liquid UNION ALL SELECT 'picked', least(10, count(*)) FROM k WHERE rn <= 3)""")
def screen_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, best = screen.funnel(dim(spark, sf_dir), B.month_bars(spark, sf_dir), 60, 12, 6, _LIM)
    n = flags.agg(F.count("*").alias("universe"), F.count_if("hard").alias("hard"), F.count_if(F.expr("hard and live")).alias("live"), F.count_if(F.expr("hard and live and liquid")).alias("liquid"))
    steps = n.select(F.explode(F.create_map(*(x for c in n.columns for x in (F.lit(c), F.col(c))))).alias("step", "n"))
    return steps.unionByName(best.agg(F.count("*").alias("n")).select(F.lit("picked").alias("step"), "n"))


def _zsql(f: str, w: float) -> str:
    return f"coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_samp({f}) OVER (), 0), 0) * {w}"


_POINTS = {"pe": -0.5, "roe": 1.25, "debt": -0.25, "score": 0.75}


@query(f"""WITH {DIM}, z AS (SELECT code, {', '.join(f'{_zsql(f, w)} AS z_{f}' for f, w in _POINTS.items())} FROM d),
 k AS (SELECT *, list_sort([{', '.join(f"{{'k': -abs(z_{f}), 'i': {i}, 's': printf('{f}(%+.1f)', z_{f})}}" for i, f in enumerate(_POINTS))}])[:3] AS l FROM z)
 SELECT code, round({' + '.join(f'z_{f}' for f in _POINTS)}, 6) AS score, array_to_string(list_transform(l, lambda e: e.s), ' ') AS reasons FROM k""")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = screen.composite(dim(spark, sf_dir), _POINTS)
    return x.select("code", r6("score").alias("score"), "reasons")


@query(f"""WITH {DIM}, {SM}, g AS (SELECT code, max(dt) AS last, count(*) AS n FROM bars GROUP BY code),
 a AS (SELECT code, sum(amount) / 6 AS amount FROM (SELECT code, amount, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM bars) WHERE rn <= 6 GROUP BY code),
 x AS (SELECT d.code, industry, score FROM d JOIN g USING (code) JOIN a USING (code) WHERE total_mv >= 5e9 AND pe > 0 AND pe <= 40 AND roe >= 8 AND NOT coalesce(debt > 65, false)
 AND last >= (SELECT max(dt) FROM bars) - 120 AND n >= 12 AND amount >= 1000), k AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, code) AS rn FROM x)
 SELECT code, industry, score, (row_number() OVER (ORDER BY score DESC, code))::INT AS rank FROM k WHERE rn <= 3 ORDER BY score DESC, code LIMIT 10""")
def screen_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the whole funnel lets through."""
    return screen.funnel(dim(spark, sf_dir), B.month_bars(spark, sf_dir), 60, 12, 6, _LIM)[1]


_EVALS = """e AS (SELECT l_suppkey AS factor, max(l_shipdate)::DATE AS run_at, arg_max(l_quantity - 25, (l_shipdate, l_orderkey, l_linenumber)) AS net_ir,
 arg_max(l_linenumber - 2, (l_shipdate, l_orderkey, l_linenumber)) AS stability, arg_max(l_discount, (l_shipdate, l_orderkey, l_linenumber)) AS oos, arg_max(l_quantity / l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS ratio FROM lineitem GROUP BY 1)"""


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("run_at")
    return B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("factor"), at, (F.col("l_quantity") - 25).alias("net_ir"), (F.col("l_linenumber") - 2).alias("stability"), F.col("l_discount").alias("oos"), (F.col("l_quantity") / F.col("l_linenumber")).alias("ratio"))


@query(f"""WITH {_EVALS} SELECT count(*) FILTER (net_ir <= 0) AS bad, count(*) FILTER (net_ir > 0 AND stability < 0) AS warn,
 coalesce(string_agg(CASE WHEN net_ir <= 0 THEN 'bad:' || factor WHEN stability < 0 THEN 'warn:' || factor END, ',' ORDER BY CASE WHEN net_ir <= 0 THEN 'bad:' || factor ELSE 'warn:' || factor END), '') AS names FROM e""")
def guard_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.guard(_evals(spark, sf_dir))


@query(f"WITH {_EVALS} SELECT factor, CASE WHEN NOT net_ir > 0 THEN 'net_ir' WHEN ratio > 5 THEN 'oos_is_ratio' WHEN stability < 0 THEN 'stability' END AS reason FROM e")
def drop_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.latest(_evals(spark, sf_dir), ["factor"], "run_at")
    return e.select("factor", stats.drop_reason(F.col("net_ir"), F.col("ratio"), F.col("stability")).alias("reason"))


@query(f"WITH {_EVALS} SELECT s_suppkey AS factor, run_at, oos FROM supplier LEFT JOIN e ON s_suppkey = factor")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = selection.leaderboard(B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("factor")), _evals(spark, sf_dir))
    return x.select("factor", F.to_date("run_at.l_shipdate").alias("run_at"), "oos")


@query("""SELECT lpad((p_partkey % 1000000)::VARCHAR, 6, '0') AS code, 'P' || p_partkey AS name, round(p_retailprice, 6) AS price, p_size * 1e4 AS amount, p_size * 100.0::DOUBLE AS volume,
 CASE WHEN p_size % 3 > 0 THEN p_size::DOUBLE END AS pe, p_size * 1e8 AS total_mv FROM part WHERE p_size % 10 > 0""")
def snapshot_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation texts of up to 60 lines made from ``part``, read back; one part in ten has no price, one in three no ratio."""
    size = F.col("p_size").cast("string")
    at = {1: F.concat(F.lit("P"), "p_partkey"), 3: F.when(F.col("p_size") % 10 > 0, F.col("p_retailprice").cast("string")), 36: size, 37: size, 39: F.when(F.col("p_size") % 3 > 0, size).otherwise("-"), 45: size}
    body = F.concat_ws("~", *(F.coalesce(at.get(i, F.lit("")), F.lit("")) for i in range(quotes.LEAST + 3)))
    line = F.concat(F.lit("v_sh"), F.lpad((F.col("p_partkey") % 1000000).cast("string"), 6, "0"), F.lit('="'), body, F.lit('";\n'))
    texts = B.table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 60).alias("k")).agg(F.array_join(F.collect_list(line), "").alias("text"))
    return quotes.parse(texts).select("code", "name", r6("price").alias("price"), "amount", "volume", "pe", "total_mv")


_EXPRS = {"fallen": "sub(0, returns(close, 4))", "above": "div(close, sma(close, 6))", "busy": "div(volume, sma(volume, 6))", "quiet": "sub(0, div(volume, sma(volume, 6)))"}


@query()
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors by in-sample ratio without close relatives; the later half of the dates is out of sample."""
    p = compile_factors(B.panel(spark, sf_dir, "sm"), _EXPRS).select("dt", "code", stats.forward_return(3).alias("fwd"), *_EXPRS)
    p = kept(p)  # the panel is made once, for the coefficients, the dates and the pairs
    half = p.select("dt").distinct().agg(F.percentile_approx(F.unix_date("dt"), 0.5).alias("half"))
    ic = selection.own_coefficients(p, {f: F.col(f) for f in _EXPRS}, {3: F.col("fwd")}, 5).crossJoin(F.broadcast(half)).withColumn("oos", F.unix_date("dt") > F.col("half"))
    ratio = lambda c: F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))) * 252.0**0.5
    s = ic.groupBy(F.col("factor").alias("id")).agg(F.count("*").alias("n"), ratio(F.when(~F.col("oos"), F.col("ic"))).alias("icir"), ratio(F.when(F.col("oos"), F.col("ic"))).alias("oos_icir"))
    corr = {(r["f1"], r["f2"]): r["corr"] or 0.0 for r in research.wide_correlations([p.drop("fwd")]).collect()}
    chosen = stats.greedy([r.asDict() for r in s.collect()], corr, gate=0.0)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(chosen)], "place int, factor string")


_RUN = {"top": 5, "horizon": 6, "stop": -8.0, "profit": 8.0, "trail": None}


def _weights(p: DataFrame, dates: list) -> DataFrame:
    """Weights from the dates before each, four weeks left out for the label."""
    rows = selection.tall(p, {f: F.col(f) for f in _EXPRS})
    return selection.weights_by_date(selection.coefficients(rows, _labels(p, 3), 5).select("factor", "dt", "ic"), 52, 26, embargo=4, calendar=dates)


def _lagged(p: DataFrame) -> DataFrame:
    return selection.tall(selection.lagged_z(p, {f: F.col(f) for f in _EXPRS}), {f: F.col(f) for f in _EXPRS})


@query()
def mine_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kept(compile_factors(B.panel(spark, sf_dir, "sw"), _EXPRS))
    chosen = selection.forward_select(_lagged(p), _weights(p, B.calendar(spark, sf_dir, "sw")), list(_EXPRS), p.select("dt", "code", "open", "high", "low", "close"), unit="week", **_RUN)
    return spark.createDataFrame([(i + 1, f, s) for i, (f, s) in enumerate(chosen)], "place int, factor string, sharpe double")


@query()
def walk_forward_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained weights, entries on the first date of each month."""
    p = kept(compile_factors(B.panel(spark, sf_dir, "sw"), _EXPRS))
    signals = selection.picks(selection.weighted_score(_lagged(p), _weights(p, B.calendar(spark, sf_dir, "sw"))), _RUN["top"], [], "month")
    eq = simulate.backtest(signals, p.select("dt", "code", "open", "high", "low", "close"), [{"run_id": "walk", "stuck": 0} | _RUN])
    return eq.select("run_id", "dt", F.round("eq", 2).alias("eq"), "positions", "trades")
