"""Queries that write tables by commits, or take rows in as streams, and read them back, with their DuckDB twins; importing this registers them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.operators import evolution, quality, screen, selection, state, stats, tables
from shoal.plans.dsl import Spec, compile_factors
from shoal.plans.evolution import _REPORTS, _quality
from shoal.plans.registry import DIM, SM, SW, dim, query, r6, sroll
from shoal.plans.selection import _LIM
from shoal.sources import bars as B
from shoal.sources import feeds
from shoal.sources.commits import Change, Store, kept, scratch
from shoal.streaming import ingest


def new_store(spark: SparkSession) -> Store:
    return Store(spark, scratch(spark))


# --- the active set, promotions ----------------------------------------------------------------

_AT = "strftime(l_shipdate, '%Y-%m-%d') || lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 2, '0')"
_EVALS = f"""ev AS (SELECT l_suppkey::VARCHAR AS code, {_AT} AS run_at, CASE WHEN l_orderkey % 2 > 0 THEN l_tax * 100 - 4 END AS is_icir, l_discount * 100 AS oos_icir, l_quantity / 50 AS turnover, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity - 25 END AS net_ir, (l_linenumber - 2)::DOUBLE AS stability FROM lineitem),
 e AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY code ORDER BY run_at DESC) = 1)"""
_SETS = """s AS (SELECT source, strftime(d, '%Y-%m-%d') || lpad(k::VARCHAR, 12, '0') AS run_at, [((c + i * 5) % 12 + 1)::VARCHAR FOR i IN range(8)] AS factors FROM
 (SELECT o_orderpriority AS source, max(o_orderdate) AS d, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_max(o_custkey, (o_orderdate, o_orderkey)) AS c FROM orders GROUP BY 1))"""


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    at = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lpad(k.cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    return B.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("code"), at.alias("run_at"), F.when(k % 2 > 0, F.col("l_tax") * 100 - 4).alias("is_icir"), (F.col("l_discount") * 100).alias("oos_icir"),
        (F.col("l_quantity") / 50).alias("turnover"), F.when(k % 3 > 0, F.col("l_quantity") - 25).alias("net_ir"), (F.col("l_linenumber") - 2).cast("double").alias("stability"))


def _with_sets(spark: SparkSession, sf_dir: str) -> Store:
    """A store with all evaluations and, by the priority of orders, the set that the newest one of each names; urgent ones are the active set's."""
    store = new_store(spark)
    newest = F.max_by(F.struct("o_orderdate", "o_orderkey", "o_custkey"), F.struct("o_orderdate", "o_orderkey")).alias("o")
    rows = B.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(newest).select("o_orderpriority", "o.*").collect()
    store.commit("evals", [Change("factor_eval", _evals(spark, sf_dir), "replace")])
    for r in sorted(rows, key=lambda r: (r["o_orderdate"], r["o_orderkey"])):
        source = state.AUTO if r["o_orderpriority"] == "1-URGENT" else r["o_orderpriority"]
        state.set_active(store, f"{r['o_orderdate']:%Y-%m-%d}{r['o_orderkey']:012}", [str((r["o_custkey"] + i * 5) % 12 + 1) for i in range(8)], source=source)
    return store


@query(f"""WITH {_EVALS}, {_SETS}, a AS (SELECT unnest(factors) AS code FROM s WHERE source = '1-URGENT') SELECT code, count(*) AS n, max(CASE WHEN code IN (SELECT code FROM a) THEN run_at END) AS selected_at FROM ev GROUP BY code""")
def active_set_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every factor's evaluations, and which of them the active set, written and read back, selects."""
    store = _with_sets(spark, sf_dir)
    x = state.selected(store.read("factor_eval"), state.active(store, state.AUTO))
    return x.groupBy("code").agg(F.count("*").alias("n"), F.max(F.when(F.col("selected") == 1, F.col("run_at"))).alias("selected_at"))


@query(f"""WITH {_EVALS}, {_SETS}, a AS (SELECT unnest(factors) AS code, unnest(range(8)) AS i FROM s WHERE source = '1-URGENT')
 SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS place, code AS factor FROM a LEFT JOIN e USING (code) WHERE e.code IS NULL OR NOT (coalesce(stability < 0, false) OR coalesce(net_ir, 0) <= 0)""")
def demotion_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active set once demotions were written."""
    store = _with_sets(spark, sf_dir)
    state.demote(store, "9999")
    return state.active(store, state.AUTO).select("place", "factor")


def _outcome(spark: SparkSession, sf_dir: str, old: float | None) -> DataFrame:
    """The newest evaluation of every factor as a run of the loop would leave it: the twenty of the highest ratio, with reasons and a verdict."""
    x = tables.latest(_evals(spark, sf_dir), ["code"], "run_at").withColumnRenamed("code", "factor").orderBy(F.desc_nulls_last("is_icir"), "factor").limit(20)
    x = x.withColumn("oos_is_ratio", evolution.out_of_sample_ratio(F.col("oos_icir"), F.col("is_icir")))
    x = x.withColumn("reason", stats.drop_reason(F.col("net_ir"), F.col("oos_is_ratio"), F.col("stability"))).withColumn("selected", F.col("reason").isNull())
    x = x.withColumn("new_oos", F.avg(F.when(F.col("selected"), F.col("oos_icir"))).over(Window.partitionBy()))
    return x.withColumn("verdict", evolution.promotion(F.col("new_oos"), F.lit(old).cast("double")))


@query(f"""WITH {_EVALS}, t AS (SELECT * FROM e ORDER BY is_icir DESC NULLS LAST, code LIMIT 20), c AS (SELECT * FROM t WHERE net_ir > 0 AND NOT coalesce(oos_icir / nullif(is_icir, 0) > 5, false) AND stability >= 0),
 m AS (SELECT avg(oos_icir) AS oos FROM c HAVING avg(oos_icir) > 0)
 SELECT 'library' AS said, code AS key, 'close' AS value FROM c, m UNION ALL SELECT 'eval', code, round(net_ir, 6)::DECIMAL(18, 6)::VARCHAR FROM c, m UNION ALL SELECT 'log', '2024-02', round(oos, 6)::DECIMAL(18, 6)::VARCHAR FROM m
 UNION ALL SELECT 'active', code, (row_number() OVER (ORDER BY is_icir DESC NULLS LAST, code) - 1)::VARCHAR FROM c, m""")
def promotion_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A promotion, a dry run before and its repetition after, and what all four tables hold then."""
    store, found = new_store(spark), kept(_outcome(spark, sf_dir, None))
    specs = [Spec(r["factor"], "x", "close") for r in found.collect()]
    state.promote(store, "2024-01", found, specs, dry_run=True)
    for _ in range(2):
        state.promote(store, "2024-02", found, specs)
    six = lambda c: F.round(c, 6).cast("decimal(18,6)").cast("string")
    x = store.read("factor_library").select(F.lit("library").alias("said"), F.col("code").alias("key"), F.col("expr").alias("value"))
    x = x.unionByName(store.read("factor_eval").select(F.lit("eval").alias("said"), F.col("code").alias("key"), six(F.col("net_ir")).alias("value")))
    x = x.unionByName(store.read("evolution_log").select(F.lit("log").alias("said"), F.col("run_at").alias("key"), six(F.col("new_oos")).alias("value")))
    return x.unionByName(state.active(store, state.AUTO).select(F.lit("active").alias("said"), F.col("factor").alias("key"), F.col("place").cast("string").alias("value")))


# --- the screen from a set that is data ----------------------------------------------------------

_LIBRARY = {"fallen": "sub(0, returns(close, 4))", "high": "div(close, sma(close, 6))", "busy": "div(volume, sma(volume, 6))", "calm": "sub(0, div(std(close, 8), close))"}
_FIRST = """n AS (SELECT l_suppkey AS k, arg_max(l_quantity - 25, (l_shipdate, l_orderkey, l_linenumber)) AS w FROM lineitem GROUP BY 1),
 mem AS (SELECT f, i, CASE WHEN sum(w) OVER () = 0 THEN 1 ELSE w END AS w FROM (SELECT unnest(['fallen', 'high', 'busy', 'calm']) AS f, unnest([0, 1, 2, 3]) AS i) JOIN n ON k = i + 1)"""


def _values_sql(day: str) -> str:
    """CTE ``v``: the four factors of the codes of panel ``g`` on the date ``day``."""
    return f"""y AS (SELECT *, last_value("close" IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM g),
 u AS (SELECT code, dt, 0 - (y / nullif(lag(y, 4) OVER (PARTITION BY code ORDER BY dt), 0) - 1) AS fallen, "close" / nullif({sroll('avg', '"close"', 6, 3)}, 0) AS high, volume / nullif({sroll('avg', 'volume', 6, 3)}, 0) AS busy,
 0 - {sroll('stddev_samp', '"close"', 8, 4)} / nullif("close", 0) AS calm FROM y), v AS (SELECT code, unnest(['fallen', 'high', 'busy', 'calm']) AS f, unnest([fallen, high, busy, calm]) AS x FROM u WHERE dt = {day}),
 st AS (SELECT f, avg(x) AS m, stddev_samp(x) AS s FROM v GROUP BY f), fl AS (SELECT min(coalesce(s, 0)) = 0 AS flat FROM st JOIN mem USING (f)),
 cb AS (SELECT code, f, i, coalesce(CASE WHEN flat THEN x ELSE (x - m) / nullif(s, 0) END, 0) * w AS c FROM v JOIN st USING (f) JOIN mem USING (f), fl),
 sc AS (SELECT code, sum(c) AS score, array_to_string(list_transform(list_sort(list({{'k': -abs(c), 'i': i, 's': printf('%s(%+.1f)', f, c)}}))[:3], lambda e: e.s), ' ') AS reasons FROM cb GROUP BY code)"""


def _with_library(spark: SparkSession, sf_dir: str) -> Store:
    """A store whose active set has the four factors and one that the library doesn't know, weighed by the newest lines of suppliers 1 to 4."""
    store = new_store(spark)
    names = spark.createDataFrame([(f, "x", e, str(i + 1)) for i, (f, e) in enumerate(_LIBRARY.items())], "code string, category string, expr string, k string")
    evals = _evals(spark, sf_dir).withColumnsRenamed({"code": "k", "net_ir": "old"}).join(F.broadcast(names.select("code", "k")), "k")
    weights = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("k")).agg(F.max_by(F.col("l_quantity") - 25, F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("net_ir"))
    evals = evals.groupBy("k", "code").agg(F.max("run_at").alias("run_at")).join(weights, "k")
    store.commit("library", [Change("factor_library", names.withColumn("created_at", F.lit("2024"))), Change("factor_eval", evals)])
    state.set_active(store, "2024-03-01", [*_LIBRARY, "gone"])
    return store


@query(f"""WITH {SW}, {_FIRST}, g AS (SELECT * FROM p), {_values_sql("(SELECT max(dt) FROM p WHERE dt <= DATE '1997-05-20')")} SELECT code, round(score, 6) AS score, reasons FROM sc""")
def screen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes by the active set, as of a day that isn't a date of the calendar."""
    store, dates = _with_library(spark, sf_dir), B.calendar(spark, sf_dir, "sw")
    x = screen.by_set(B.densify(B.week_bars(spark, sf_dir), dates), state.active_weights(store), dates, date(1997, 5, 20))
    return x.select("code", r6("score").alias("score"), "reasons")


@query(f"""WITH {DIM}, {SM}, {_FIRST}, gr AS (SELECT code, max(dt) AS last, count(*) AS n FROM bars GROUP BY code),
 a AS (SELECT code, sum(amount) / 6 AS amount FROM (SELECT code, amount, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM bars) WHERE rn <= 6 GROUP BY code),
 ok AS (SELECT d.code, industry, round(total_mv / 1e6, 2) AS price FROM d JOIN gr USING (code) JOIN a USING (code) WHERE total_mv >= 1e9 AND pe > 0 AND pe <= 40 AND roe >= 8 AND NOT coalesce(debt > 65, false)
 AND last >= (SELECT max(dt) FROM bars) - 120 AND n >= 12 AND amount >= 1000), g AS (SELECT * FROM p WHERE code IN (SELECT code FROM ok)), {_values_sql('(SELECT max(dt) FROM bars)')},
 k AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, code) AS rn FROM ok JOIN sc USING (code)), t AS (SELECT * FROM k WHERE rn <= 3 ORDER BY score DESC, code LIMIT 10)
 SELECT (row_number() OVER (ORDER BY score DESC, code))::INT AS rank, code, industry, round(score, 6) AS score, price, reasons, '2024-03-01' AS factor_set_id FROM t""")
def screen_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole screen by the active set, its recommendations stored twice for one day and read back."""
    store = _with_library(spark, sf_dir)
    codes = dim(spark, sf_dir).withColumn("price", F.round(F.col("total_mv") / 1e6, 2))
    lim = screen.Limits(min_mv=1e9, min_amount=1000.0)
    bars, dates = kept(B.month_bars(spark, sf_dir)), B.calendar(spark, sf_dir, "sm")
    for _ in range(2):
        x = screen.run(store, date(2024, 3, 4), codes, bars, dates, 60, 12, 6, lim)
    return x.withColumn("score", r6("score"))


# --- bars that arrive ------------------------------------------------------------------------------


def _arrive(spark: SparkSession, waves: list[DataFrame], heal: bool) -> DataFrame:
    """Files of bars, one a wave, taken as a stream into a store."""
    store, folder = new_store(spark), scratch(spark)
    for k, w in enumerate(waves):
        w.coalesce(1).write.mode("append").parquet(f"{folder}/in/{k:03}")
    stream = spark.readStream.schema(waves[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    arrived = F.col("_metadata.file_modification_time")
    ingest.ingest(stream, store, "bars", f"{folder}/checkpoint", arrived, heal=heal).awaitTermination()
    return store.read("daily").select("code", "dt", r6("close").alias("close"))


_ALL_BARS = f'SELECT code, dt, round("close", 6) AS "close" FROM ({B.SQL["ev"]})'


@query(_ALL_BARS)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that come by thirds of the month, each with the day before it again at another price: what is held stays."""
    b = kept(B.event_bars(spark, sf_dir))
    day = F.dayofmonth("dt")
    again = lambda n: b.filter(day == n).withColumn("close", F.col("close") + 1)
    return _arrive(spark, [b.filter(day <= 10), b.filter((day > 10) & (day <= 20)).unionByName(again(10)), b.filter(day > 20).unionByName(again(20))], heal=False)


@query(_ALL_BARS)
def stream_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of every third code that are missing on some days come after newer ones, some of them twice."""
    b = kept(B.event_bars(spark, sf_dir))
    late = (F.col("code").cast("int") % 3 == 0) & (F.dayofmonth("dt") % 7 == 3)
    return _arrive(spark, [b.filter(~late & (F.dayofmonth("dt") <= 15)), b.filter(~late & (F.dayofmonth("dt") > 12)), b.filter(late), b.filter(late | (F.dayofmonth("dt") == 1))], heal=True)


_H = (5, 10, 20, 60)


@query(f"""WITH {SM}, b AS (SELECT code, dt, open, "close", row_number() OVER (PARTITION BY code ORDER BY dt) AS ord FROM bars), k AS (SELECT code, dt + 2 AS run_date, CASE WHEN code::INT % 3 = 0 THEN 1.5 END AS old FROM bars WHERE code::INT % 4 > 0),
 f AS (SELECT k.code, run_date, min(ord) AS ord FROM k JOIN b ON b.code = k.code AND b.dt > run_date GROUP BY 1, 2)
 SELECT k.code, k.run_date, {', '.join((f'coalesce(old, ' if h == 5 else '(') + f'round_even(CASE WHEN e.open > 0 THEN (x{h}."close" / e.open - 1) * 100 END, 2) + 0.0) AS ret_{h}' for h in _H)}
 FROM k LEFT JOIN f USING (code, run_date) LEFT JOIN b e ON e.code = f.code AND e.ord = f.ord {' '.join(f'LEFT JOIN b x{h} ON x{h}.code = f.code AND x{h}.ord = f.ord + {h}' for h in _H)}""")
def track_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored picks of three codes in four, a third of them with one outcome already, filled twice; the second time writes nothing."""
    store, b = new_store(spark), kept(B.month_bars(spark, sf_dir))
    picks = b.filter(F.col("code").cast("int") % 4 > 0).select(F.date_add("dt", 2).alias("run_date"), "code", F.when(F.col("code").cast("int") % 3 == 0, 1.5).alias("ret_5"))
    store.commit("seed", [Change("recommendations", picks, "replace"), Change("daily", b.withColumn("month", F.date_format("dt", "yyyy-MM")), "replace")])
    for _ in range(2):
        screen.fill_outcomes(store, _H, ahead=2600)
    return store.read("recommendations").select("code", "run_date", *(f"ret_{h}" for h in _H))


# --- what comes from elsewhere ------------------------------------------------------------------------


@query(f"""WITH {SW}, c AS (SELECT * FROM bars WHERE code::INT % 4 = 1) SELECT code, dt, round("close", 6) AS "close" FROM c""")
def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of some codes of which no adjusted ones are stored: all are raw."""
    raw = B.week_bars(spark, sf_dir)
    adjusted = raw.filter(F.col("code").cast("int") % 4 != 1).withColumn("close", F.col("close") * 2)
    codes = raw.select("code").distinct().filter(F.col("code").cast("int") % 4 == 1)
    return B.for_codes(adjusted, codes, raw).select("code", "dt", r6("close").alias("close"))


@query("""WITH r AS (SELECT lpad((p_partkey % 100000)::VARCHAR, 6, '0') AS code, max({'eps': CASE WHEN p_size % 5 > 0 THEN p_retailprice END, 'roe': p_size::DOUBLE}) AS v FROM part GROUP BY 1),
 b AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS code, s_acctbal AS debt_ratio FROM supplier WHERE s_nationkey % 3 > 0)
 SELECT code, '2024-03-31' AS period, round(v.eps, 2) AS eps, v.roe AS roe, round(debt_ratio, 2) AS debt_ratio FROM r LEFT JOIN b USING (code)""")
def quarter_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results under the vendor's headers, numbers as texts, some of them dashes; balances of two codes in three."""
    size = F.col("p_size")
    theirs = {v: k for k, v in feeds.RESULT_COLUMNS.items()}
    results = B.table(spark, sf_dir, "part").select((F.col("p_partkey") % 100000).alias(theirs["code"]), F.when(size % 5 > 0, F.col("p_retailprice").cast("string")).otherwise("-").alias(theirs["eps"]), size.cast("string").alias(theirs["roe"]), F.lit(None).cast("string").alias(theirs["gross_margin"]), F.lit("nan").alias(theirs["profit_yoy"]))
    balances = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_nationkey") % 3 > 0, F.col("s_acctbal").cast("string")).otherwise("").alias("debt_ratio"))
    x = feeds.quarter(feeds.renamed(results, feeds.RESULT_COLUMNS), balances, "2024-03-31")
    return x.select("code", "period", F.round("eps", 2).alias("eps"), "roe", F.round("debt_ratio", 2).alias("debt_ratio"))


@query("""WITH l AS (SELECT 'n' || (p_partkey % 7) AS source, p_partkey // 25 AS place, p_partkey % 25 AS line, 'raw_' || (p_partkey % 400) AS id, 'rank(' || p_size || ')' AS formula FROM part WHERE p_size % 6 > 0),
 f AS (SELECT id, min({'a': source, 'b': place, 'c': line, 'd': formula}) AS r FROM l GROUP BY id), h AS (SELECT 'raw_' || s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0),
 k AS (SELECT r.a AS source, id, r.d AS formula, row_number() OVER (PARTITION BY r.a ORDER BY r.b, r.c) AS n FROM f WHERE id NOT IN (SELECT id FROM h)) SELECT source, id, formula FROM k WHERE n <= 6""")
def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of up to 25 lines from seven sources, one line in six of another form; some numbers are known already."""
    k = F.col("p_partkey")
    line = F.when(F.col("p_size") % 6 > 0, F.format_string("Alpha#%d %s rank(%d) ", k % 400, F.when(k % 2 == 0, ":").otherwise("="), F.col("p_size"))).otherwise("alpha# none")
    lines = B.table(spark, sf_dir, "part").groupBy(F.concat(F.lit("n"), (k % 7).cast("string")).alias("source"), F.floor(k / 25).alias("place")).agg(F.array_sort(F.collect_list(F.struct((k % 25).alias("at"), line.alias("said")))).alias("l"))
    texts = lines.select("source", "place", F.array_join(F.transform("l", lambda s: s["said"]), "\n").alias("text"))
    held = B.table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("raw_"), F.col("s_suppkey").cast("string")).alias("id"))
    return feeds.formulas(texts, held)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 > 0 THEN c_name || ', \"' || c_mktsegment || '\"' END AS said, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with commas and quotes, empty ones and nulls, written as comma-separated values and read back."""
    k, path = F.col("c_custkey"), scratch(spark)
    x = B.table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 5 == 0, "").when(k % 7 > 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))).alias("said"), F.round("c_acctbal", 2).alias("c_acctbal"))
    feeds.write_csv(x, path)
    return feeds.read_csv(x, path)


@query("""WITH i AS (SELECT 'sh.000300' AS code, ts::DATE AS dt, avg(value) AS "close" FROM events GROUP BY 2) SELECT code, dt, round("close", 6) AS "close" FROM i""")
def benchmark_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's bars: what is stored, and what is newer than its last date."""
    store = new_store(spark)
    b = B.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("dt")).agg(F.avg("value").alias("close")).select(F.lit("sh.000300").alias("code"), "dt", "close", F.date_format("dt", "yyyy-MM").alias("month"))
    store.commit("first", [Change("index_daily", b.filter(F.dayofmonth("dt") <= 12), "replace")])
    store.commit("next", [Change("index_daily", tables.fresh_bars(b, store.read("index_daily").select("code", "dt")), "insert")])
    return store.read("index_daily").select("code", "dt", r6("close").alias("close"))


@query(f"""WITH {SW}, {_REPORTS}, f0 AS (SELECT code, dt, "close" / nullif({sroll('avg', '"close"', 6, 3)}, 0) AS x FROM p), m AS (SELECT code, dt, x FROM f0 JOIN qp USING (code, dt) WHERE ok AND x IS NOT NULL),
 c AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS next FROM (SELECT DISTINCT dt FROM p)), k AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY x DESC, code) AS pick FROM m) SELECT next AS dt, code, pick::INT AS pick FROM k JOIN c USING (dt) WHERE pick <= 3 AND next IS NOT NULL""")
def quality_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three codes of each date among those that were sound on it, to be traded on the next."""
    b = kept(B.week_bars(spark, sf_dir))
    p = B.densify(b)
    x = compile_factors(p, {"score": "div(close, sma(close, 6))"}).select("code", "dt", "score")
    return selection.picks(quality.masked(x, _quality(spark, sf_dir, p, b), ["score"]), 3, []).select("dt", "code", "pick")
