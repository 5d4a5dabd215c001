"""Queries of the research loop, work lists and listings, with their DuckDB twins; importing this registers them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import evolution, screen, selection, stats, tables
from shoal.plans import catalogue
from shoal.plans.dsl import batches, compile_many
from shoal.plans.registry import CORR, LAB, LEAD, SM, SW, labelled, query, r6, srank
from shoal.plans.selection import _TALL, _labels, _tall
from shoal.sources import bars as B
from shoal.sources import quotes
from shoal.sources.commits import kept

_BY_FACTOR = srank("value").replace("PARTITION BY dt", "PARTITION BY factor, dt")
_L3 = f"l AS (SELECT dt, code, {LEAD.format(h=3)} AS fwd FROM p)"
_IC = f"""a AS (SELECT factor, dt, code, {_BY_FACTOR} AS rx FROM t), b AS (SELECT dt, code, {srank('fwd')} AS ry FROM l),
 ic AS (SELECT factor, dt, {CORR} AS ic FROM a JOIN b USING (dt, code) WHERE rx IS NOT NULL AND ry IS NOT NULL GROUP BY ALL HAVING count(*) >= 5 AND {CORR} IS NOT NULL)"""
_RATIO = "avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252.0)"


def _masked(p: DataFrame) -> DataFrame:
    return selection.coefficients(_tall(p), _labels(p, 3), 5, masked=True)


@query(f"""WITH {SM}, y AS (SELECT code, dt, ("close" - avg("close") OVER (PARTITION BY dt)) / nullif(stddev_pop("close") OVER (PARTITION BY dt), 0) AS a, (volume - avg(volume) OVER (PARTITION BY dt)) / nullif(stddev_pop(volume) OVER (PARTITION BY dt), 0) AS b FROM p)
 SELECT code, dt, round(lag(a) OVER w, 6) + 0.0 AS price, round(lag(b) OVER w, 6) + 0.0 AS volume FROM y WINDOW w AS (PARTITION BY code ORDER BY dt)""")
def lagged_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = selection.lagged_z(B.panel(spark, sf_dir, "sm"), {"price": F.col("close"), "volume": F.col("volume")})
    return z.select("code", "dt", (r6("price") + 0.0).alias("price"), (r6("volume") + 0.0).alias("volume"))


@query(f"WITH {LAB} SELECT dt, round({CORR}, 6) + 0.0 AS ic FROM (SELECT dt, x AS rx, fwd AS ry FROM f WHERE x IS NOT NULL AND fwd IS NOT NULL) GROUP BY dt HAVING count(*) > 2 AND {CORR} IS NOT NULL")
def daily_ic_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).filter("x is not null and fwd is not null")
    n = rows.groupBy("dt").count().filter("count > 2")
    return stats.rank_ic_masked(rows, "x", "fwd", ranked=False).join(n, "dt", "left_semi").select("dt", (r6("ic") + 0.0).alias("ic"))


@query(f"""WITH {SM}, {_TALL}, k AS (SELECT factor, dt, code, {_BY_FACTOR} AS r FROM t), g AS (SELECT *, lag(r) OVER (PARTITION BY factor, code ORDER BY dt) AS q FROM k),
 d AS (SELECT factor, dt, avg(abs(r - q)) AS d FROM g GROUP BY ALL), c AS (SELECT factor, code, covar_samp(r, q) / nullif(stddev_samp(r) * stddev_samp(q), 0) AS c FROM g WHERE r IS NOT NULL AND q IS NOT NULL GROUP BY ALL)
 SELECT factor, round((SELECT avg(d) FROM d WHERE d.factor = f.factor), 6) AS turnover, round((SELECT avg(c) FROM c WHERE c.factor = f.factor), 6) AS rank_autocorr FROM (SELECT DISTINCT factor FROM t) f""")
def factor_turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.turnovers(_tall(B.panel(spark, sf_dir, "sm"))).select("factor", r6("turnover").alias("turnover"), r6("rank_autocorr").alias("rank_autocorr"))


@query(f"""WITH {SM}, {_TALL}, {_L3}, k AS (SELECT factor, dt, code, {_BY_FACTOR} AS r FROM t), d AS (SELECT factor, dt, avg(fwd) FILTER (r >= 0.9) - avg(fwd) FILTER (r <= 0.1) AS ls FROM k JOIN l USING (dt, code) GROUP BY ALL),
 m AS (SELECT factor, ls - 0.0012 AS net FROM d WHERE ls IS NOT NULL)
 SELECT factor, count(*) AS n, CASE WHEN count(*) >= 30 THEN round({_RATIO.format(x='net')}, 6) END AS net_ir, CASE WHEN count(*) >= 30 THEN round(avg(net) * 252, 6) END AS net_ret FROM m GROUP BY factor""")
def factor_net_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly rebalancing, which spreads the costs over five dates."""
    p = B.panel(spark, sf_dir, "sm")
    return selection.long_shorts(_tall(p), _labels(p, 3), rebalance="W").select("factor", "n", r6("net_ir").alias("net_ir"), r6("net_ret").alias("net_ret"))


@query(f"""WITH {SM}, {_TALL}, {_L3}, {_IC}, x AS (SELECT factor, ic, row_number() OVER (PARTITION BY factor ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY factor) AS n FROM ic),
 j AS (SELECT factor, begin, CASE WHEN i < begin + 24 THEN ic END AS a, CASE WHEN i >= begin + 24 THEN ic END AS o FROM x JOIN (SELECT unnest(range(0, 1000)) * 12 AS begin) ON i >= begin AND i < begin + 36 AND begin + 36 <= n),
 f AS (SELECT factor, begin, {_RATIO.format(x='a')} AS a, {_RATIO.format(x='o')} AS o FROM j GROUP BY ALL) SELECT factor, count(*) AS folds, round(avg(a), 6) AS is_icir, round(avg(o), 6) AS oos_icir FROM f GROUP BY factor""")
def factor_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = selection.fold_ratios(_masked(B.panel(spark, sf_dir, "sm")), 24, 12, 12)
    return x.select("factor", "folds", r6("is_icir").alias("is_icir"), r6("oos_icir").alias("oos_icir"))


@query(f"WITH {SM}, {_TALL}, {_L3}, {_IC} SELECT factor, count(*) AS n, round({_RATIO.format(x='ic')}, 6) AS icir FROM ic GROUP BY factor HAVING count(*) >= 50 AND {_RATIO.format(x='ic')} >= -1")
def factor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.gated(_masked(B.panel(spark, sf_dir, "sm")), -1.0).withColumn("icir", r6("icir"))


@query()
def recipe_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recipes, and on how many cells of the panel each has a value."""
    p, specs = kept(B.panel(spark, sf_dir, "sm")), catalogue.catalogue()
    rows, exprs, parts = p.count(), {s.id: s.expr for s in specs}, []
    for ids in batches(exprs):
        n = compile_many(p, {f: exprs[f] for f in ids}, rows).agg(*(F.count(f).alias(f) for f in ids))
        parts.append(n.select(F.explode(F.create_map(*(x for f in ids for x in (F.lit(f), F.col(f))))).alias("factor", "n")))
    known = spark.createDataFrame([(s.id, s.family, s.expr) for s in specs], "factor string, category string, expr string")
    return known.join(reduce(DataFrame.unionByName, parts), "factor")


@query()
def research_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop over the whole catalogue, with folds and windows as long as the tables allow."""
    p = kept(B.panel(spark, sf_dir, "sm"))
    specs = catalogue.catalogue()
    x = evolution.research_loop(p, _labels(p, 3), specs, gate=0.0, least=30, folds=(24, 12, 12), window=24)
    return x.select("factor", *(r6(c).alias(c) for c in ("is_icir", "oos_icir", "oos_is_ratio", "stability", "turnover", "net_ir", "new_oos")), "reason", "selected", "verdict")


@query(f"""WITH {SW}, {_TALL}, {_L3}, day AS (SELECT max(dt) AS d FROM p), cal AS (SELECT DISTINCT dt FROM p ORDER BY dt DESC LIMIT 53),
 j AS (SELECT t.factor, t.dt, value, fwd FROM t JOIN l USING (dt, code) WHERE value IS NOT NULL AND fwd IS NOT NULL),
 k AS (SELECT factor, dt, {_BY_FACTOR} AS rx, {srank('fwd').replace('PARTITION BY dt', 'PARTITION BY factor, dt')} AS ry FROM j), ic AS (SELECT factor, dt, {CORR} AS ic FROM k GROUP BY ALL HAVING count(*) >= 5 AND {CORR} IS NOT NULL),
 v AS (SELECT factor, avg(ic) AS w FROM ic WHERE dt IN (SELECT dt FROM cal) GROUP BY factor HAVING count(*) >= 26 AND abs(avg(ic)) >= 0.01 AND stddev_samp(ic) > 0), u AS (SELECT factor, w / sum(abs(w)) OVER () AS w FROM v),
 z0 AS (SELECT factor, dt, code, (value - avg(value) OVER q) / nullif(stddev_pop(value) OVER q, 0) AS z FROM t WINDOW q AS (PARTITION BY factor, dt)), z AS (SELECT factor, dt, code, lag(z) OVER (PARTITION BY factor, code ORDER BY dt) AS z FROM z0)
 SELECT code, round(sum(w * z), 6) AS score, string_agg(printf('%s%+.2f', factor, w * z), ' ' ORDER BY factor) AS reasons FROM z JOIN u USING (factor) WHERE dt = (SELECT d FROM day) AND z IS NOT NULL GROUP BY code ORDER BY sum(w * z) DESC, code LIMIT 10""")
def live_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kept(B.panel(spark, sf_dir, "sw"))
    values = {"price": F.col("close"), "volume": F.col("volume"), "spread": F.col("high") - F.col("low")}
    weights = selection.weights_by_date(selection.coefficients(_tall(p), _labels(p, 3), 5).select("factor", "dt", "ic"), 52, 26, calendar=B.calendar(spark, sf_dir, "sw"))
    z = selection.tall(selection.lagged_z(p, values), {f: F.col(f) for f in values})
    return selection.recommend(z, weights, p.agg(F.max("dt").alias("dt"))).withColumn("score", r6("score"))


_SPOT = """s AS (SELECT (p_partkey % 10)::VARCHAR || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS code, CASE WHEN p_size % 7 = 0 THEN '*st ' ELSE 'x' END || p_partkey AS name, p_retailprice AS price,
 CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS open, p_size % 5 * 1.0 AS low, p_partkey AS k FROM part)"""


def _spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    code = F.concat((k % 10).cast("string"), F.lpad((k % 100000).cast("string"), 5, "0"))
    name = F.concat(F.when(size % 7 == 0, "*st ").otherwise("x"), k.cast("string"))
    return B.table(spark, sf_dir, "part").select(code.alias("code"), name.alias("name"), price.alias("price"), F.when(size % 4 > 0, price).alias("open"), price.alias("high"), (size % 5 * 1.0).alias("low"), k.cast("double").alias("volume"), price.alias("amount"), k.alias("k"))


@query(f"WITH {_SPOT} SELECT code, CASE WHEN code[1] = '6' THEN 'sh' WHEN code[1] IN ('8', '4', '9') THEN 'bj' ELSE 'sz' END AS exchange, upper(name) LIKE '%ST%' AS is_st FROM s")
def spot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spot(spark, sf_dir).select("code", quotes.exchange(F.col("code")).alias("exchange"), quotes.special(F.col("name")).alias("is_st"))


@query(f"""WITH {_SPOT} SELECT code, DATE '2024-01-02' AS dt, round(open, 2) AS open, round(price, 2) AS "close" FROM s WHERE open <> 0 AND low <> 0 AND price <> 0""")
def spot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quotes.todays_bars(_spot(spark, sf_dir), F.lit("2024-01-02").cast("date"))
    return x.select("code", "dt", F.round("open", 2).alias("open"), F.round("close", 2).alias("close"))


@query("""SELECT m[4:] || lpad(s_suppkey::VARCHAR, 5, '0') AS code, s_name AS name, m[:2] AS exchange FROM (SELECT *, CASE s_nationkey % 3 WHEN 0 THEN 'sh.6' WHEN 1 THEN 'sz.0' ELSE 'sh.0' END AS m FROM supplier)
 WHERE s_nationkey % 3 < 2 AND s_suppkey % 5 > 0""")
def listed_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, key = F.col("s_nationkey") % 3, F.col("s_suppkey")
    code = F.concat(F.when(nation == 0, "sh.6").when(nation == 1, "sz.0").otherwise("sh.0"), F.lpad(key.cast("string"), 5, "0"))
    return quotes.universe(B.table(spark, sf_dir, "supplier").select(code.alias("code"), F.col("s_name").alias("name"), F.lit("1").alias("type"), F.when(key % 5 > 0, "1").otherwise("0").alias("status")))


@query(f"""WITH {SM}, x AS (SELECT code, max(dt) AS last FROM bars GROUP BY code) SELECT code, last, date_diff('day', last, (SELECT max(dt) FROM bars))::INT AS lag FROM x WHERE date_diff('day', last, (SELECT max(dt) FROM bars)) > 1""")
def gap_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.gaps(B.month_bars(spark, sf_dir))


@query(f"""WITH {_SPOT}, r AS (SELECT o_custkey AS k, max(o_orderkey) AS period, arg_max(o_totalprice, o_orderkey) AS roe FROM orders GROUP BY 1)
 SELECT code, round(price, 2) AS price, round(roe, 2) AS roe FROM s LEFT JOIN r USING (k) WHERE code[1] NOT IN ('8', '4', '9') AND upper(name) NOT LIKE '%ST%' AND price > 0""")
def hard_filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spot(spark, sf_dir)
    # codes are cut from the keys, so in larger tables several parts have one
    listing = s.select("k", quotes.exchange(F.col("code")).alias("exchange"), quotes.special(F.col("name")).alias("is_st"))
    reports = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("period"), F.col("o_totalprice").alias("roe"))
    return screen.candidates(s.select("k", "code", "price"), listing, reports, "k").select("code", F.round("price", 2).alias("price"), F.round("roe", 2).alias("roe"))


@query("SELECT count(*) AS n, count(*) FILTER (p_size % 4 = 0 OR p_size % 5 = 0) AS missing, count(*) FILTER (p_size % 4 = 0 OR p_size % 5 = 0) / count(*) > 0.3 AS alert FROM part")
def fundamentals_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.table(spark, sf_dir, "part").select(*(F.when(F.col("p_size") % n > 0, F.col("p_size")).alias(c) for c, n in (("pe", 4), ("roe", 5))))
    return screen.missing_alert(x, ["pe", "roe"])


@query("SELECT s_suppkey AS factor FROM supplier WHERE (lower(s_name) LIKE '%er#00%' OR lower(n_of) LIKE '%er#00%') AND s_acctbal >= 100".replace("FROM supplier", "FROM (SELECT *, 'n' || s_nationkey AS n_of FROM supplier)").replace("WHERE", "WHERE n_of = 'n3' AND"))
def factor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("factor"), F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source"), F.col("s_acctbal").alias("sharpe"))
    return evolution.search(x, "ER#00", ["name", "source"], "n3", F.col("sharpe") >= 100).select("factor")


@query("""WITH k AS (SELECT s_suppkey::VARCHAR AS code, round(s_acctbal, 2) AS score, s_nationkey::INT AS pe, row_number() OVER (ORDER BY round(s_acctbal, 2) DESC, s_suppkey::VARCHAR) AS rank FROM supplier)
 SELECT DATE '2024-01-02' AS run_date, rank::INT AS rank, code, score, '{"pe":' || pe || '}' AS metrics_json, 'set' AS factor_set_id FROM k WHERE rank <= 10""")
def recommendation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.lit("").alias("industry"), F.round("s_acctbal", 2).alias("score"), F.col("s_nationkey").cast("int").alias("pe"))
    return screen.recommendation(screen.capped_top(x, 10, 3), F.lit("2024-01-02").cast("date"), ["pe"], F.lit("set"))
