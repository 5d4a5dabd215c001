"""Queries of ``operators.research`` and of the reports, with their DuckDB twins; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.operators import research
from shoal.plans.registry import EV, SW, query, r6, srank, sw
from shoal.sources import bars as B


@query(f"""WITH {SW}, t AS (SELECT dt, code, 'price' AS factor, "close" AS value FROM p UNION ALL SELECT dt, code, 'volume', volume FROM p UNION ALL SELECT dt, code, 'spread', high - low FROM p),
 j AS (SELECT a.dt, a.factor AS f1, b.factor AS f2, a.value AS a, b.value AS b FROM t a JOIN t b ON a.dt = b.dt AND a.code = b.code AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
 r AS (SELECT f1, f2, dt, {srank('a').replace('PARTITION BY dt', 'PARTITION BY f1, f2, dt')} AS ra, {srank('b').replace('PARTITION BY dt', 'PARTITION BY f1, f2, dt')} AS rb FROM j),
 d AS (SELECT f1, f2, dt, count(*) AS n, covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0) AS r FROM r GROUP BY ALL)
 SELECT f1, f2, sum(n)::BIGINT AS cells, round(CASE WHEN sum(n) < 100 THEN 0 ELSE avg(r) END, 6) AS corr FROM d GROUP BY f1, f2""")
def factor_pair_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.panel(spark, sf_dir, "sw")
    made = F.explode(F.create_map(F.lit("price"), "close", F.lit("volume"), "volume", F.lit("spread"), F.col("high") - F.col("low"))).alias("factor", "value")
    return research.pair_correlations(p.select("dt", "code", made)).withColumn("corr", r6("corr"))


@query(f"""WITH {SW}, w AS (SELECT code, dt, CASE WHEN count("close") OVER {sw(26)} >= 26 THEN avg("close") OVER {sw(26)} / nullif(stddev_samp("close") OVER {sw(26)}, 0) * sqrt(252) END AS s FROM bars WHERE "close" IS NOT NULL)
 SELECT code, round(arg_max(s, dt), 6) AS last, round(min(s), 6) AS worst, min(s) < 30 AS unstable FROM w WHERE s IS NOT NULL GROUP BY code""")
def rolling_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.stability(B.week_bars(spark, sf_dir), "code", "close", window=26, floor=30.0)
    return out.select("code", r6("last").alias("last"), r6("worst").alias("worst"), "unstable")


@query(f"""WITH {EV}, d AS (SELECT DISTINCT dt FROM p), k AS (SELECT dt, date_trunc('week', dt) AS w, date_trunc('month', dt) AS m FROM d)
 SELECT dt, coalesce(w <> lag(w) OVER (ORDER BY dt), true) AS weekly, coalesce(m <> lag(m) OVER (ORDER BY dt), true) AS monthly FROM k""")
def rebalance_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.event_bars(spark, sf_dir).select("dt")
    week, month = (research.rebalance(d, u).withColumnRenamed("rebalance", n) for u, n in (("week", "weekly"), ("month", "monthly")))
    return week.join(month, "dt")


@query("""WITH e AS (SELECT l_suppkey AS factor, arg_max(l_quantity - 25, (l_shipdate, l_orderkey, l_linenumber)) AS net_ir, arg_max(l_linenumber - 2, (l_shipdate, l_orderkey, l_linenumber)) AS stability FROM lineitem GROUP BY 1)
 SELECT s_suppkey AS factor, CASE WHEN e.factor IS NULL THEN NULL WHEN stability < 0 THEN 'stability' WHEN net_ir <= 0 THEN 'net_ir' END AS reason FROM supplier LEFT JOIN e ON s_suppkey = e.factor""")
def factor_demotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    evals = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("factor"), at.alias("run_at"), (F.col("l_quantity") - 25).alias("net_ir"), (F.col("l_linenumber") - 2).alias("stability"))
    return research.demotions(B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("factor")), evals)


@query("""SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags FROM lineitem
 WHERE (l_partkey, l_shipdate) IN (SELECT l_partkey, max(l_shipdate) FROM lineitem GROUP BY 1) GROUP BY 1""")
def membership_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.tags(B.table(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate", "l_returnflag")


@query("""WITH b AS (SELECT date_trunc('quarter', min(o_orderdate))::DATE AS f, date_trunc('quarter', max(o_orderdate))::DATE AS l FROM orders)
 SELECT (d + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period FROM (SELECT unnest(generate_series(f::TIMESTAMP, l::TIMESTAMP, INTERVAL 3 MONTH)) AS d FROM b)""")
def report_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("f"), F.to_date(F.max("o_orderdate")).alias("l"))
    return b.select(F.explode(research.quarters(F.col("f"), F.col("l"))).alias("period"))


@query(f"""WITH {SW}, c AS (SELECT DISTINCT dt FROM p ORDER BY dt DESC LIMIT 20)
 SELECT code, round(avg(amount), 6) AS amount FROM p WHERE dt IN (SELECT dt FROM c) GROUP BY code HAVING avg(amount) >= 40000""")
def liquid_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.liquid_recently(B.panel(spark, sf_dir, "sw"), 20, 40000.0).select("code", r6("amount").alias("amount"))


@query("SELECT s_nationkey, s_suppkey, round(abs(s_acctbal) / nullif(sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 0), 6) AS weight FROM supplier")
def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.abs("s_acctbal")
    return B.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", r6(F.try_divide(size, F.sum(size).over(Window.partitionBy("s_nationkey")))).alias("weight"))


@query("SELECT o_orderpriority AS factor, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sets, kept as JSON lists, hold each factor."""
    sets = B.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_set("o_orderpriority")).alias("factors_json"))
    return sets.select(F.explode(F.from_json("factors_json", "array<string>")).alias("factor")).groupBy("factor").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean, count(*) FILTER (l_quantity > 25) AS wins,
 round(count(*) FILTER (l_quantity > 25) / nullif(count(l_quantity), 0)::DOUBLE, 6) AS win_rate FROM lineitem GROUP BY 1""")
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = F.count_if(F.col("l_quantity") > 25)
    return B.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg("l_discount")).alias("mean"), wins.alias("wins"), r6(F.try_divide(wins, F.count("l_quantity"))).alias("win_rate"))


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS customers,
 (SELECT max(o_orderdate)::DATE FROM orders) AS newest, (SELECT count(*) FROM lineitem) AS lines""")
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.to_date(F.max("o_orderdate")).alias("newest"))
    return o.join(B.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("lines")))


@query("""SELECT o_orderdate::DATE AS run_date, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*) AS mean FROM orders GROUP BY 1""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean comes from an exact sum of cents, as a rounded mean of cents has ties."""
    mean = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")
    return B.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("run_date")).agg(F.count("*").alias("n"), mean.alias("mean")).orderBy(F.desc("run_date"))
