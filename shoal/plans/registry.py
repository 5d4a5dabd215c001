"""Every query of the engine by name, with its DuckDB twin.

Each query shows one operator, or a chain of them, on a panel made from the driver's tables. Ratios are rounded
to six places and money to two on both sides, as the order of a sum differs between engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions import panel as P
from shoal.operators import factors, screen, selection, simulate, stats, tables
from shoal.plans.dsl import compile_factors
from shoal.sources import bars as B
from shoal.sources.commits import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def out(df: DataFrame, *names: str, keys: tuple[str, ...] = ("code", "dt")) -> DataFrame:
    return df.select(*keys, *(r6(n).alias(n) for n in names))


# --- SQL fragments -------------------------------------------------------------------------


def sw(n: int) -> str:
    return f"(PARTITION BY code ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sroll(fn: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {sw(n)} >= {n if least is None else least} THEN {fn}({x}) OVER {sw(n)} END"


def srank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY dt ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY dt, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY dt) END"


FILL = 'last_value("close" IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'
FILL = FILL.replace('"close" IGNORE NULLS)', '"close" IGNORE NULLS)')


def sret(n: int, x: str = "y") -> str:
    return f"{x} / nullif(lag({x}, {n}) OVER (PARTITION BY code ORDER BY dt), 0) - 1"


def sround(*names: str, keys: str = "code, dt", table: str = "z") -> str:
    return f"SELECT {keys}, {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM {table}"


SW, SM, EV = (B.panel_sql(k) for k in ("sw", "sm", "ev"))


def dsl_query(name: str, kind: str, factors: dict[str, str], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return out(compile_factors(B.panel(spark, sf_dir, kind), factors), *factors)

    run.__name__ = name
    query(sql)(run)


# --- panel and time series -----------------------------------------------------------------


@query(f"""WITH {EV}, q AS (SELECT *, {FILL} AS y FROM p), r AS (SELECT code, dt, {sret(5)} AS r5 FROM q),
 s AS (SELECT code, dt, {srank('r5')} AS score FROM r WHERE r5 IS NOT NULL), l AS (SELECT *, (code::INT % 4)::VARCHAR AS industry FROM s WHERE dt = (SELECT max(dt) FROM s)),
 k AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, code) AS rn FROM l)
 SELECT code, industry, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, code))::BIGINT AS rank FROM k WHERE rn <= 3 ORDER BY score DESC, code LIMIT 10""")
def slice_csrank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice: returns, ranks by date, newest date, best ten with at most three of a bucket."""
    x = compile_factors(B.panel(spark, sf_dir, "ev"), {"score": "cs_rank(returns(close, 5))"}).filter("score is not null")
    x = x.groupBy("code").agg(F.max("dt").alias("dt"), F.max_by("score", "dt").alias("score")).withColumn("_now", F.max("dt").over(Window.partitionBy()))  # one row a code
    x = x.filter("dt = _now").select("code", (F.col("code").cast("int") % 4).cast("string").alias("industry"), "score")
    return screen.capped_top(x, 10, 3).select("code", "industry", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f'WITH {SW} SELECT code, dt, is_bar, round(open, 6) AS open, round("close", 6) AS "close", round(volume, 2) AS volume FROM p')
def panel_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.panel(spark, sf_dir, "sw").select("code", "dt", "is_bar", r6("open").alias("open"), r6("close").alias("close"), F.round("volume", 2).alias("volume"))


dsl_query("ts_mean_std_minmax", "sw", {"m": "sma(close, 20)", "s": "std(close, 20)", "lo": "ts_min(low, 20)", "hi": "ts_max(high, 20)", "mx": "max(close, 5)", "mn": "min(close, 5)"},
    f"""WITH {SW}, z AS (SELECT code, dt, {sroll('avg', '"close"', 20, 10)} AS m, {sroll('stddev_samp', '"close"', 20, 10)} AS s, {sroll('min', 'low', 20, 10)} AS lo,
 {sroll('max', 'high', 20, 10)} AS hi, {sroll('max', '"close"', 5, 2)} AS mx, {sroll('min', '"close"', 5, 2)} AS mn FROM p) {sround('m', 's', 'lo', 'hi', 'mx', 'mn')}""")  # fmt: skip
dsl_query("ts_zscore", "sw", {"z": "zscore(close, 20)"},
    f"""WITH {SW}, z AS (SELECT code, dt, ("close" - {sroll('avg', '"close"', 20, 10)}) / nullif({sroll('stddev_samp', '"close"', 20, 10)}, 0) AS z FROM p) {sround('z')}""")
dsl_query("ts_rank", "sw", {"r": "ts_rank(close, 10)"},
    f"""WITH {SW}, q AS (SELECT code, dt, "close" AS x, count("close") OVER {sw(10)} AS n, list("close") OVER {sw(10)} AS xs FROM p),
 z AS (SELECT code, dt, CASE WHEN n >= 5 THEN coalesce(len(list_filter(xs, lambda k: k <= x)), 0) / len(xs)::DOUBLE END AS r FROM q) {sround('r')}""")  # fmt: skip
dsl_query("ts_ref_returns", "sw", {"l": "ref(close, 3)", "r1": "returns(close, 1)", "r20": "returns(close, 20)"},
    f"""WITH {SW}, q AS (SELECT *, {FILL} AS y FROM p), z AS (SELECT code, dt, lag("close", 3) OVER (PARTITION BY code ORDER BY dt) AS l, {sret(1)} AS r1, {sret(20)} AS r20 FROM q) {sround('l', 'r1', 'r20')}""")
dsl_query("ts_corr", "sw", {"c": "corr(close, volume, 20)"},
    f"""WITH {SW}, q AS (SELECT code, dt, CASE WHEN volume IS NOT NULL THEN "close" END AS a, CASE WHEN "close" IS NOT NULL THEN volume END AS b FROM p),
 z AS (SELECT code, dt, CASE WHEN count(a) OVER {sw(20)} >= 10 THEN covar_samp(a, b) OVER {sw(20)} / nullif(stddev_samp(a) OVER {sw(20)} * stddev_samp(b) OVER {sw(20)}, 0) END AS c FROM q) {sround('c')}""")  # fmt: skip
dsl_query("cs_rank_zscore", "sm", {"r": "cs_rank(close)", "z": "cs_zscore(volume)"},
    f"""WITH {SM}, z AS (SELECT code, dt, {srank('"close"')} AS r, (volume - avg(volume) OVER (PARTITION BY dt)) / nullif(stddev_samp(volume) OVER (PARTITION BY dt), 0) AS z FROM p) {sround('r', 'z')}""")
dsl_query("dsl_nested_stage", "sw", {"a": "cs_rank(zscore(close, 20))", "b": "sub(0, returns(sma(close, 5), 5))", "c": "log(div(amount, add(volume, 1)))", "d": "abs(sign(sub(close, ref(close, 1))))"},
    f"""WITH {SW}, q AS (SELECT *, ("close" - {sroll('avg', '"close"', 20, 10)}) / nullif({sroll('stddev_samp', '"close"', 20, 10)}, 0) AS zs, {sroll('avg', '"close"', 5, 2)} AS m FROM p),
 y AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM q),
 z AS (SELECT code, dt, {srank('zs')} AS a, 0 - ({sret(5)}) AS b, CASE WHEN amount IS NOT NULL THEN ln(greatest(amount / (volume + 1), 1e-12)) END AS c,
 abs(sign("close" - lag("close", 1) OVER (PARTITION BY code ORDER BY dt)))::DOUBLE AS d FROM y) {sround('a', 'b', 'c', 'd')}""")  # fmt: skip


def ewm_sql(kind: str, cols: dict[str, tuple[str, float, int]], pre: str = "*") -> str:
    """CTE ``w`` with recursive means that carry over gaps; cols: name -> (source, alpha, least)."""
    first = ", ".join(f"{x}::DOUBLE AS {n}_y, 1.0::DOUBLE AS {n}_w, ({x} IS NOT NULL)::INT AS {n}_k" for n, (x, _, _) in cols.items())
    step = ", ".join(
        f"""CASE WHEN q.{x} IS NULL THEN e.{n}_y WHEN e.{n}_y IS NULL THEN q.{x} ELSE ((e.{n}_w * {1 - a!r}) * e.{n}_y + {a!r} * q.{x}) / (e.{n}_w * {1 - a!r} + {a!r}) END,
 CASE WHEN q.{x} IS NULL AND e.{n}_y IS NOT NULL THEN e.{n}_w * {1 - a!r} ELSE 1.0 END, e.{n}_k + (q.{x} IS NOT NULL)::INT"""
        for n, (x, a, _) in cols.items()
    )
    shown = ", ".join(f"CASE WHEN {n}_k >= {least} THEN {n}_y END AS {n}" for n, (_, _, least) in cols.items())
    return f"""q AS (SELECT {pre}, row_number() OVER (PARTITION BY code ORDER BY dt) AS i FROM p0),
 e AS (SELECT code, dt, i, {first} FROM q WHERE i = 1 UNION ALL SELECT q.code, q.dt, q.i, {step} FROM e JOIN q ON q.code = e.code AND q.i = e.i + 1), w AS (SELECT code, dt, {shown} FROM e)"""


dsl_query("ts_ema", "sw", {"e": "ema(close, 10)"}, f"WITH RECURSIVE {SW}, p0 AS (SELECT * FROM p), {ewm_sql('sw', {'e': ('close', 2 / 11, 5)})} {sround('e', table='w')}".replace("close::DOUBLE", '"close"::DOUBLE').replace("(close IS", '("close" IS').replace("q.close", 'q."close"'))


@query(f"""WITH RECURSIVE {EV}, p0 AS (SELECT code, dt, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS down
 FROM (SELECT code, dt, "close" - lag("close", 1) OVER (PARTITION BY code ORDER BY dt) AS d FROM p)), {ewm_sql('ev', {'u': ('up', 1 / 14, 14), 'v': ('down', 1 / 14, 14)})},
 z AS (SELECT code, dt, CASE WHEN v = 0 AND u > 0 THEN 100 ELSE 100 - 100 / (1 + u / nullif(v, 0)) END AS rsi FROM w) {sround('rsi')}""")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.panel(spark, sf_dir, "ev").withColumn("d", F.col("close") - F.lag("close", 1).over(P.by_code()))
    p = p.select("code", "dt", F.when(F.col("d") > 0, F.col("d")).when(F.col("d").isNotNull(), 0.0).alias("up"), F.when(F.col("d") < 0, -F.col("d")).when(F.col("d").isNotNull(), 0.0).alias("down"))
    return out(P.ewm(p, {"u": ("up", 1 / 14, 14), "v": ("down", 1 / 14, 14)}).withColumn("rsi", P.rsi(F.col("u"), F.col("v"))), "rsi")


@query()
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes: the signal line is a mean of a difference of means."""
    return out(factors.macd(B.panel(spark, sf_dir, "sw"), least=9), "dif", "dea", "hist")


def _mean(x: str, n: int) -> str:
    return f"({sroll('avg', x, n)})"


def _over(x: str, y: str) -> str:
    return f"{x} / nullif({y}, 0)"


_CLOSE = '"close"'
_BUILTIN_SQL = {
    **{f"ret_{n}d": sret(n) for n in (5, 10, 20, 60, 120)}, **{f"rev_{n}d": f"-({sret(n)})" for n in (5, 20)},
    **{f"close_ma{n}": f"{_over(_CLOSE, _mean(_CLOSE, n))} - 1" for n in (20, 60, 120)}, "ma5_ma20": f"{_over(_mean(_CLOSE, 5), _mean(_CLOSE, 20))} - 1", "ma20_ma60": f"{_over(_mean(_CLOSE, 20), _mean(_CLOSE, 60))} - 1",
    "vol_20d": sroll("stddev_samp", "ret", 20), "vol_60d": sroll("stddev_samp", "ret", 60), "downside_20d": sroll("stddev_samp", "(CASE WHEN ret IS NOT NULL THEN least(ret, 0) END)", 20),
    "vol_ratio": _over(_mean("volume", 5), _mean("volume", 20)), "amt_ratio": _over(_mean("amount", 5), _mean("amount", 20)),
    "log_amt20": f"CASE WHEN {_mean('amount', 20)} IS NOT NULL THEN ln(greatest({_mean('amount', 20)}, 1)) END", **{f"hi{n}_dist": f"{_over(_CLOSE, '(' + sroll('max', 'high', n) + ')')} - 1" for n in (20, 60, 120)},
    "chg": "ret * 100", "gap_up": 'open / nullif(lag("close", 1) OVER (PARTITION BY code ORDER BY dt), 0) - 1', "amihud": "CASE WHEN amount IS NOT NULL THEN abs(ret) / greatest(amount, 1) * 1e6 END",
}


@query(f"WITH {SW}, q AS (SELECT *, {FILL} AS y FROM p), r AS (SELECT *, {sret(1)} AS ret FROM q), z AS (SELECT code, dt, {', '.join(f'{x} AS {n}' for n, x in _BUILTIN_SQL.items())} FROM r) {sround(*_BUILTIN_SQL)}")
def builtin_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``amihud`` is shown in millionths, so that six places tell something."""
    x = factors.windowed(B.panel(spark, sf_dir, "sw"))
    return out(x.withColumn("amihud", F.col("amihud") * 1e6), *_BUILTIN_SQL)


def again(sql: str, k: int = 2) -> str:
    """A k-th recursion in one statement: q, e, w and p0 by other names."""
    return re.sub(r"\b(q|e|w|p0)\b", lambda m: {"q": f"q{k}", "e": f"e{k}", "w": f"w{k}", "p0": f"p{k - 1}"}[m[1]], sql)


def macd_sql(kind: str, panel: str, least: int, source: str = "p") -> str:
    """WITH of CTE ``m`` (code, dt, dif, dea, hist) over ``source``."""
    fast = ewm_sql(kind, {"fast": ("close", 2 / 13, 12), "slow": ("close", 2 / 27, 26)})
    for a, b in (("close::DOUBLE", '"close"::DOUBLE'), ("(close IS", '("close" IS'), ("q.close", 'q."close"')):
        fast = fast.replace(a, b)
    return f"WITH RECURSIVE {panel}, p0 AS (SELECT * FROM {source}), {fast}, p1 AS (SELECT code, dt, fast - slow AS dif FROM w), {again(ewm_sql(kind, {'dea': ('dif', 2 / 10, least)}))}, m AS (SELECT p1.code, p1.dt, dif, dea, 2 * (dif - dea) AS hist FROM p1 JOIN w2 ON w2.code = p1.code AND w2.dt = p1.dt)"


ORACLES["macd"] = f"{macd_sql('sw', SW, 9)} {sround('dif', 'dea', 'hist', table='m')}"


@query(f"{macd_sql('sw', SW, 1)} SELECT code, dt, round(hist, 6) AS macd_hist, round(dif, 6) AS macd_dif FROM m")
def builtin_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(factors.macd(B.panel(spark, sf_dir, "sw"), least=1).withColumnsRenamed({"hist": "macd_hist", "dif": "macd_dif"}), "macd_hist", "macd_dif")


@query(f"""WITH RECURSIVE {SW}, p0 AS (SELECT code, dt, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS down
 FROM (SELECT code, dt, y - lag(y, 1) OVER (PARTITION BY code ORDER BY dt) AS d FROM (SELECT code, dt, "close" AS y FROM p))), {ewm_sql('sw', {'u': ('up', 1 / 14, 1), 'v': ('down', 1 / 14, 1)})},
 z AS (SELECT code, dt, 100 - 100 / (1 + u / nullif(v, 0)) AS rsi_14 FROM w) {sround('rsi_14')}""")
def builtin_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(factors.panel_rsi(B.panel(spark, sf_dir, "sw")), "rsi_14")


# --- statistics ----------------------------------------------------------------------------

LEAD = "lead(open, {h}) OVER (PARTITION BY code ORDER BY dt) / nullif(lead(open, 1) OVER (PARTITION BY code ORDER BY dt), 0) - 1"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM with a factor x (volume over its own mean) and the label fwd."""
    return compile_factors(B.panel(spark, sf_dir, "sm"), {"x": "div(close, sma(close, 6))"}).withColumn("fwd", stats.forward_return(3))


LAB = f"""{SM}, f AS (SELECT code, dt, "close" / nullif({sroll('avg', '"close"', 6, 3)}, 0) AS x, {LEAD.format(h=3)} AS fwd FROM p)"""
CORR = "covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0)"
PAIRIC = f"""pr AS (SELECT dt, {srank('x')} AS rx, {srank('fwd')} AS ry FROM f WHERE x IS NOT NULL AND fwd IS NOT NULL), ic AS (SELECT dt, count(*) AS n, {CORR} AS ic FROM pr GROUP BY dt HAVING count(*) >= 20 AND {CORR} IS NOT NULL)"""


@query(f"WITH {SW}, z AS (SELECT code, dt, {LEAD.format(h=5)} AS f5, {LEAD.format(h=10)} AS f10, {LEAD.format(h=20)} AS f20 FROM p) {sround('f5', 'f10', 'f20')}")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(B.panel(spark, sf_dir, "sw").withColumns({f"f{h}": stats.forward_return(h) for h in (5, 10, 20)}), "f5", "f10", "f20")


def pair_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_ic_pairwise(labelled(spark, sf_dir), "x", "fwd", 20)


@query(f"WITH {LAB}, {PAIRIC} SELECT dt, n, round(ic, 6) AS ic FROM ic")
def rank_ic_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_ic(spark, sf_dir).select("dt", "n", r6("ic").alias("ic"))


@query(f"""WITH {LAB}, rk AS (SELECT dt, {srank('x')} AS a, {srank('fwd')} AS b FROM f), pr AS (SELECT dt, CASE WHEN b IS NOT NULL THEN a END AS rx, CASE WHEN a IS NOT NULL THEN b END AS ry FROM rk)
 SELECT dt, round({CORR}, 6) AS ic FROM pr GROUP BY dt HAVING {CORR} IS NOT NULL""")
def rank_ic_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_ic_masked(labelled(spark, sf_dir), "x", "fwd").select("dt", r6("ic").alias("ic"))


@query(f"""WITH {LAB}, {PAIRIC} SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252.0), 6) AS icir,
 round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 6) AS t_stat, round(avg((ic > 0)::INT::DOUBLE), 6) AS pos_ratio, count(ic) AS n FROM ic""")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.ic_summary(pair_ic(spark, sf_dir))
    return s.select(*(r6(c).alias(c) for c in s.columns[:-1]), "n")


@query(f"""WITH {LAB}, {PAIRIC} SELECT dt, CASE WHEN count(ic) OVER w >= 12 AND abs(avg(ic) OVER w) >= 0.01 AND stddev_samp(ic) OVER w > 0 THEN round(avg(ic) OVER w, 6) END AS weight
 FROM ic WINDOW w AS (ORDER BY dt ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)""")
def train_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.train_weights(pair_ic(spark, sf_dir), 24, 12).select("dt", r6("weight").alias("weight"))


@query(f"""WITH {LAB}, rk AS (SELECT code, dt, {srank('x')} AS r FROM f), d AS (SELECT dt, avg(abs(d)) AS d FROM (SELECT dt, r - lag(r) OVER (PARTITION BY code ORDER BY dt) AS d FROM rk) GROUP BY dt)
 SELECT round(avg(d), 6) AS turnover FROM d""")
def factor_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.turnover(labelled(spark, sf_dir), "x").select(r6("turnover").alias("turnover"))


@query(f"""WITH {LAB}, rk AS (SELECT dt, fwd, {srank('x')} AS r FROM f), d AS (SELECT dt, avg(CASE WHEN r >= 0.9 THEN fwd END) - avg(CASE WHEN r <= 0.1 THEN fwd END) AS ls FROM rk GROUP BY dt),
 m AS (SELECT ls - 0.006 AS net FROM d WHERE ls IS NOT NULL) SELECT count(*) AS n, CASE WHEN count(*) >= 30 THEN round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0), 6) END AS net_ir, CASE WHEN count(*) >= 30 THEN round(avg(net) * 252, 6) END AS net_ret FROM m""")
def long_short_net_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.long_short(labelled(spark, sf_dir), "x", "fwd").select("n", r6("net_ir").alias("net_ir"), r6("net_ret").alias("net_ret"))


@query(f"""WITH {LAB}, {PAIRIC}, x AS (SELECT ic, row_number() OVER (ORDER BY dt) - 1 AS i FROM ic), b AS (SELECT unnest(range(0, (SELECT count(*) FROM x) + 1 - 36, 12)) AS begin),
 j AS (SELECT begin, CASE WHEN i < begin + 24 THEN ic END AS a, CASE WHEN i >= begin + 24 THEN ic END AS o FROM b JOIN x ON i >= begin AND i < begin + 36)
 SELECT begin::INT AS begin, round(avg(a) / nullif(stddev_samp(a), 0) * sqrt(252.0), 6) AS is_icir, round(avg(o) / nullif(stddev_samp(o), 0) * sqrt(252.0), 6) AS oos_icir FROM j GROUP BY begin""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.folds(pair_ic(spark, sf_dir), 24, 12, 12).select("begin", r6("is_icir").alias("is_icir"), r6("oos_icir").alias("oos_icir"))


@query(f"""WITH {SW}, i AS (SELECT dt, avg("close") AS eq FROM bars GROUP BY dt), e AS (SELECT dt, eq, eq / max(eq) OVER (ORDER BY dt) - 1 AS dd, eq / lag(eq) OVER (ORDER BY dt) - 1 AS r FROM i)
 SELECT round(arg_max(eq, dt) / arg_min(eq, dt) - 1, 6) AS total_return, round(pow(arg_max(eq, dt) / arg_min(eq, dt), 365.25 / date_diff('day', min(dt), max(dt))) - 1, 6) AS cagr, round(min(dd), 6) AS max_drawdown,
 round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 6) AS sharpe FROM e""")
def perf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.performance(B.week_bars(spark, sf_dir).groupBy("dt").agg(F.avg("close").alias("eq")))
    return s.select(*(r6(c).alias(c) for c in s.columns))


# --- keyed tables and the screen -------------------------------------------------------------


@query(f"""WITH {SW}, f AS (SELECT (o_custkey % 25)::VARCHAR AS code, o_orderdate::DATE AS as_of, max(o_totalprice) AS metric FROM orders GROUP BY 1, 2)
 SELECT p.code, p.dt, round(f.metric, 2) AS metric, coalesce(f.metric >= 200000, false) AS ok FROM p ASOF LEFT JOIN f ON p.code = f.code AND p.dt >= f.as_of""")
def pit_quality_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).cast("string").alias("code"), F.to_date("o_orderdate").alias("dt")).agg(F.max("o_totalprice").alias("metric"))
    x = tables.as_of(B.panel(spark, sf_dir, "sw").select("code", "dt"), f, "code", "dt", ["metric"])
    return x.select("code", "dt", F.round("metric", 2).alias("metric"), F.coalesce(F.col("metric") >= 200000, F.lit(False)).alias("ok"))


@query(f"""WITH {SM}, b AS (SELECT code, min(dt) AS f, max(dt) AS l FROM bars GROUP BY code) SELECT p.code, dt, dt BETWEEN f AND l AS ok FROM p JOIN b USING (code)""")
def listing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.month_bars(spark, sf_dir)
    return tables.within_bounds(B.densify(rows).select("code", "dt", F.lit(True).alias("ok")), tables.bounds(rows), "ok")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, round(arg_max(o_totalprice, o_orderkey), 2) AS o_totalprice FROM orders GROUP BY o_custkey")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.latest(B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")
    return x.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT o_custkey, max(o_orderdate) FROM orders GROUP BY 1)")
def latest_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.at_latest(B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with an industry and fundamentals: suppliers, nations, and what their part of the same key says."""
    s, n, p = (B.table(spark, sf_dir, t) for t in ("supplier", "nation", "part"))
    x = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(p, s["s_suppkey"] == p["p_partkey"], "left")
    return x.select(F.col("s_suppkey").cast("string").alias("code"), F.col("n_name").alias("industry"), (F.col("s_acctbal") * 1e6).alias("total_mv"), F.col("p_size").cast("double").alias("pe"), (F.col("p_retailprice") / 100).alias("roe"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 2.0).alias("debt"), F.round(F.col("s_acctbal"), 2).alias("score"))


DIM = """d AS (SELECT s_suppkey::VARCHAR AS code, n_name AS industry, s_acctbal * 1e6 AS total_mv, p_size::DOUBLE AS pe, p_retailprice / 100 AS roe, CASE WHEN p_size % 7 <> 0 THEN p_size * 2.0 END AS debt, round(s_acctbal, 2) AS score
 FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN part ON s_suppkey = p_partkey)"""


@query(f"WITH {DIM} SELECT code, industry FROM d WHERE total_mv > 0")
def universe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim(spark, sf_dir).filter("total_mv > 0").select("code", "industry")


@query(f"""WITH {DIM} SELECT code, concat_ws(',', CASE WHEN coalesce(total_mv, 0) < 5e9 THEN 'mv' END, CASE WHEN pe IS NULL OR pe <= 0 OR pe > 40 THEN 'pe' END, CASE WHEN roe IS NULL OR roe < 8 THEN 'roe' END, CASE WHEN debt > 65 THEN 'debt' END) AS fails FROM d""")
def hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim(spark, sf_dir).select("code", F.array_join(screen.failures(), ",").alias("fails"))


@query(f"""WITH {DIM}, k AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, code) AS rn FROM d) SELECT code, industry, score, (row_number() OVER (ORDER BY score DESC, code))::BIGINT AS rank FROM k WHERE rn <= 3 ORDER BY score DESC, code LIMIT 10""")
def industry_cap_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.capped_top(dim(spark, sf_dir).select("code", "industry", "score"), 10, 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {SM} SELECT code, max(dt) AS last FROM bars GROUP BY code HAVING max(dt) >= (SELECT max(dt) FROM bars) - 60")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.live(B.month_bars(spark, sf_dir), 30)


@query(f"""WITH {SW}, x AS (SELECT code, amount, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM bars)
 SELECT code, count(*) AS n, round(sum(CASE WHEN rn <= 20 THEN amount END) / 20, 2) AS amount FROM x GROUP BY code HAVING count(*) >= 130 AND sum(CASE WHEN rn <= 20 THEN amount END) / 20 >= 1000""")
def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.liquid(B.week_bars(spark, sf_dir), 130, 20, 1000.0).select("code", "n", F.round("amount", 2).alias("amount"))


@query(f"WITH {SM}, a AS (SELECT * FROM bars WHERE code::INT % 5 < 3 OR volume % 3 > 0) SELECT code FROM (SELECT DISTINCT code FROM bars) WHERE code NOT IN (SELECT code FROM a GROUP BY code HAVING count(*) >= 70)")
def missing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes whose adjusted bars are too few: two codes in five lack a third of theirs."""
    b = B.month_bars(spark, sf_dir)
    return tables.missing_history(b, b.filter((F.col("code").cast("int") % 5 < 3) | (F.col("volume") % 3 > 0)), 70)


HORIZONS = (5, 10, 20, 60)


@query(f"""WITH {SW}, b AS (SELECT code, dt, open, "close", row_number() OVER (PARTITION BY code ORDER BY dt) AS ord FROM bars), k AS (SELECT code, dt + 2 AS run_date FROM bars),
 f AS (SELECT k.code, run_date, min(ord) AS ord FROM k JOIN b ON b.code = k.code AND b.dt > run_date GROUP BY 1, 2)
 SELECT k.code, k.run_date, {', '.join(f'round_even(CASE WHEN e.open > 0 THEN (x{h}."close" / e.open - 1) * 100 END, 2) + 0.0 AS ret_{h}' for h in HORIZONS)}
 FROM k LEFT JOIN f USING (code, run_date) LEFT JOIN b e ON e.code = f.code AND e.ord = f.ord {' '.join(f'LEFT JOIN b x{h} ON x{h}.code = f.code AND x{h}.ord = f.ord + {h}' for h in HORIZONS)}""")
def track_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code picked two days after each of its bars, at each horizon."""
    b = B.week_bars(spark, sf_dir)
    picks = b.select(F.date_add("dt", 2).alias("run_date"), "code")
    return screen.outcomes(picks, b, HORIZONS).select("code", "run_date", *(f"ret_{h}" for h in HORIZONS))


_UPSERT = """WITH n AS (SELECT k, arg_max_null(v, seq) AS v FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey ELSE o_custkey END AS k, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS v, o_orderkey AS seq FROM orders WHERE o_custkey % 3 > 0)
 GROUP BY k), o AS (SELECT c_custkey AS k, c_acctbal AS v, c_name AS name FROM customer)"""


def _upsert(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    """Orders of two customers in three, several each, the newest of which counts; one order in fifty has a key that isn't held, one in nine no price."""
    key = F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    new = B.table(spark, sf_dir, "orders").filter("o_custkey % 3 > 0").select(key.alias("k"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")).alias("v"), F.col("o_orderkey").alias("at"))
    old = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("name"))
    return tables.upsert(old, new, ["k"], policy, order="at").select("k", F.round("v", 2).alias("v"), "name")


@query(_UPSERT + " SELECT k, round(v, 2) AS v, name FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, round(v, 2), NULL FROM n")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, "replace")


@query(_UPSERT + " SELECT k, round(coalesce(n.v, o.v), 2) AS v, name FROM o FULL JOIN n USING (k)")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, "coalesce")


@query(_UPSERT + " SELECT k, round(CASE WHEN name IS NULL THEN n.v ELSE o.v END, 2) AS v, name FROM o FULL JOIN n USING (k)")
def upsert_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, "insert")


@query(f"""WITH {SW}, l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM bars), k AS (SELECT code, dt, "close" FROM l WHERE rn <= 250),
 z AS (SELECT code, dt, "close" AS c, {sroll('avg', '"close"', 5)} AS ma5, {sroll('avg', '"close"', 20)} AS ma20, {sroll('avg', '"close"', 60)} AS ma60 FROM k) {sround('c', 'ma5', 'ma20', 'ma60')}""")
def kline_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.week_bars(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("dt")))).filter("rn <= 250")
    return out(b.withColumns({"c": F.col("close"), "ma5": P.rolling(F.avg, F.col("close"), 5), "ma20": P.rolling(F.avg, F.col("close"), 20), "ma60": P.rolling(F.avg, F.col("close"), 60)}), "c", "ma5", "ma20", "ma60")


@query(f"WITH {EV}, h AS (SELECT code, max(dt) AS l FROM bars WHERE dt < DATE '2024-01-20' GROUP BY code) SELECT b.code, b.dt, round(b.\"close\", 6) AS \"close\" FROM bars b LEFT JOIN h USING (code) WHERE l IS NULL OR b.dt > l")
def daily_bars_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.event_bars(spark, sf_dir)
    return tables.fresh_bars(b, b.filter("dt < date'2024-01-20'")).select("code", "dt", r6("close").alias("close"))


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over weekly bars: the ten best by fallen price, traded on the next date."""
    p = kept(compile_factors(B.panel(spark, sf_dir, "sw"), {"x": "sub(0, returns(close, 4))"}))
    signals = selection.picks(p.select("dt", "code", F.col("x").alias("score")), 10, [], "week")
    runs = [{"run_id": f"h{h}", "top": 10, "horizon": h, "stop": -8.0, "profit": 8.0, "trail": None} for h in (4, 8)]
    return simulate.backtest(signals, p.select("dt", "code", "open", "high", "low", "close"), runs)


@query()
def backtest_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulated(spark, sf_dir).select("run_id", "dt", F.round("eq", 2).alias("eq"), "positions", "trades")


@query()
def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.trade_list(simulated(spark, sf_dir)).withColumn("ret", r6("ret"))


@query()
def backtest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run, against the mean close of all codes."""
    bench = B.week_bars(spark, sf_dir).groupBy("dt").agg(F.avg("close").alias("close"))
    x = simulate.results(kept(simulated(spark, sf_dir)), bench=bench)
    return x.select("run_id", "start", "end", *(r6(c).alias(c) for c in ("total_return", "cagr", "max_drawdown", "sharpe", "win_rate", "avg_trade_ret", "bench_return")), "n_trades", F.to_json("equity").alias("equity_json"))
