"""Queries of the quality panel and the active set, with their DuckDB twins; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import evolution, quality, stats
from shoal.plans.registry import CORR, LEAD, SW, query, r6, srank, sroll
from shoal.plans.dsl import compile_factors
from shoal.sources import bars as B

# Reports made from orders: a customer's code, the quarter end before the order, known from the order's date or not told.
_REPORTS = """f AS (SELECT (o_custkey % 25)::VARCHAR AS code, (date_trunc('quarter', o_orderdate)::DATE - 1)::DATE AS period, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS as_of,
 o_orderpriority = '1-URGENT' AS st, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice * 1e5 END AS circ_mv, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1e4 - 5 END AS roe,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 END::DOUBLE AS debt, o_orderkey AS k FROM orders),
 r AS (SELECT code, coalesce(as_of, period + 30)::DATE AS dt, arg_max(NOT st AND coalesce(circ_mv, 0) >= 3e9 AND coalesce(roe >= 0, true) AND coalesce(debt <= 85, true), (period, k)) AS ok FROM f GROUP BY 1, 2),
 lim AS (SELECT code, min(dt) AS lo, max(dt) AS hi FROM bars GROUP BY code),
 qp AS (SELECT p.code, p.dt, coalesce(r.ok, false) AND coalesce(p.dt BETWEEN lo AND hi, false) AS ok FROM p ASOF LEFT JOIN r ON p.code = r.code AND p.dt >= r.dt LEFT JOIN lim ON lim.code = p.code)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    when = lambda n, x: F.when(k % n != 0, x)
    o = B.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 25).cast("string").alias("code"), F.date_sub(F.trunc(F.to_date("o_orderdate"), "quarter"), 1).alias("end"), k.alias("k"),
        when(7, F.to_date("o_orderdate")).alias("as_of"), (F.col("o_orderpriority") == "1-URGENT").alias("st"), when(11, F.col("o_totalprice") * 1e5).alias("circ_mv"),
        when(5, F.col("o_totalprice") / 1e4 - 5).alias("roe"), when(3, (k % 100).cast("double")).alias("debt"))
    return o


def _quality(spark: SparkSession, sf_dir: str, rows: DataFrame, bars: DataFrame) -> DataFrame:
    # several orders of a code share a day and a period: the key decides, within the period's order
    o = _reports(spark, sf_dir).withColumnsRenamed({"end": "period"})
    once = o.withColumn("as_of", quality.disclosed()).groupBy("code", "period", "as_of").agg(F.max_by(F.struct("st", "circ_mv", "roe", "debt"), "k").alias("r")).select("code", "period", "as_of", "r.*")
    return quality.quality_panel(rows, once, bars, quality.sound())


@query(f"WITH {SW}, {_REPORTS} SELECT code, dt, ok FROM qp")
def quality_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.week_bars(spark, sf_dir)
    return _quality(spark, sf_dir, B.densify(b), b)


@query(f"""WITH {SW}, {_REPORTS}, f0 AS (SELECT code, dt, "close" / nullif({sroll('avg', '"close"', 6, 3)}, 0) AS x, {LEAD.format(h=3)} AS fwd FROM p),
 m AS (SELECT code, dt, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN fwd END AS fwd FROM f0 JOIN qp USING (code, dt)),
 pr AS (SELECT dt, {srank('x')} AS rx, {srank('fwd')} AS ry FROM m WHERE x IS NOT NULL AND fwd IS NOT NULL)
 SELECT dt, count(*) AS n, round({CORR}, 6) + 0.0 AS ic FROM pr GROUP BY dt HAVING count(*) >= 8 AND {CORR} IS NOT NULL""")
def quality_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank coefficients over the codes that were sound on each date."""
    b = B.week_bars(spark, sf_dir)
    p = B.densify(b)
    x = compile_factors(p, {"x": "div(close, sma(close, 6))"}).withColumn("fwd", stats.forward_return(3)).select("code", "dt", "x", "fwd")
    return stats.rank_ic_pairwise(quality.masked(x, _quality(spark, sf_dir, p, b), ["x", "fwd"]), "x", "fwd", 8).select("dt", "n", (r6("ic") + 0.0).alias("ic"))


_EVALS = """ev AS (SELECT l_suppkey AS factor, (l_shipdate, l_orderkey, l_linenumber) AS run_at, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity - 25 END AS net_ir, CASE WHEN l_orderkey % 2 > 0 THEN l_tax * 100 - 4 END AS is_icir, l_discount * 100 AS oos_icir, l_linenumber - 2 AS stability FROM lineitem),
 e AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY factor ORDER BY run_at DESC) = 1)"""


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("factor"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("run_at"), F.when(k % 3 > 0, F.col("l_quantity") - 25).alias("net_ir"), F.when(k % 2 > 0, F.col("l_tax") * 100 - 4).alias("is_icir"), (F.col("l_discount") * 100).alias("oos_icir"), (F.col("l_linenumber") - 2).alias("stability"))


_ACTIVE = """a AS (SELECT arg_max(o_custkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
 s AS (SELECT place::INT AS place, (k + place * 5) % 12 + 1 AS factor FROM a, unnest(range(0, 8)) AS t(place)),
 w AS (SELECT place, s.factor, coalesce(net_ir, is_icir, 1.0) AS w FROM s JOIN supplier ON s_suppkey = s.factor LEFT JOIN e ON e.factor = s.factor)"""


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order writes a set of eight under the name of its priority."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("o_custkey") + i * 5) % 12 + 1)
    log = B.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.to_json(ids).alias("factors_json"))
    library = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("factor"))
    return evolution.active_specs(evolution.active_set(log, "1-URGENT"), library, _evals(spark, sf_dir))


@query(f"WITH {_EVALS}, {_ACTIVE} SELECT place, factor, round(CASE WHEN sum(w) OVER () = 0 THEN 1 ELSE w END, 6) AS weight FROM w")
def active_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specs(spark, sf_dir).select("place", "factor", r6("weight").alias("weight"))


@query(f"WITH {_EVALS}, {_ACTIVE} SELECT count(net_ir) = 0 AS degraded FROM w LEFT JOIN e USING (factor)")
def active_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution.degraded(_specs(spark, sf_dir), _evals(spark, sf_dir))


@query(f"WITH {_EVALS} SELECT factor, CASE WHEN oos_icir / is_icir > 5 THEN 'ratio_high' ELSE 'ratio_low' END AS warning FROM e WHERE is_icir <> 0 AND (oos_icir / is_icir > 5 OR oos_icir / is_icir < 0.3) UNION ALL SELECT factor, 'stability' FROM e WHERE stability < 0")
def factor_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution.factor_health(_evals(spark, sf_dir))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 > 0 THEN l_discount - 0.02 END AS new, CASE WHEN l_orderkey % 4 > 0 THEN l_tax END AS old FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN old IS NULL THEN CASE WHEN new IS NULL THEN 'first: unknown' WHEN new <= 0 THEN 'first: not positive' ELSE 'promote' END
 WHEN new IS NULL THEN 'unknown' WHEN new > old + 0.02 THEN 'promote' ELSE 'too little' END AS verdict FROM x""")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    verdict = evolution.promotion(F.when(k % 3 > 0, F.col("l_discount") - 0.02), F.when(k % 4 > 0, F.col("l_tax")))
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query("""WITH o AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 3 > 0 THEN round(abs(s_acctbal) / 100, 4) END AS debt FROM supplier),
 n AS (SELECT ps AS code, CASE WHEN d BETWEEN 0 AND 300 THEN d END AS debt FROM (SELECT p_partkey AS ps, round(p_retailprice / nullif(p_size * 20.0, 0) * 100, 4) AS d FROM part))
 SELECT code, coalesce(o.debt, n.debt) AS debt FROM o LEFT JOIN n USING (code)""")
def debt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    old = B.table(spark, sf_dir, "supplier").select(k.alias("code"), F.when(k % 3 > 0, F.round(F.abs("s_acctbal") / 100, 4)).alias("debt"))
    new = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), quality.debt_ratio(F.col("p_retailprice"), F.col("p_size") * 20.0).alias("debt"))
    return quality.filled(old, new, ["code"], "debt").select("code", "debt")


@query("SELECT l_suppkey, count(CASE WHEN l_orderkey % 500 > 0 THEN 1 END) AS known, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(CASE WHEN l_orderkey % 500 > 0 THEN 1 END) < count(*)")
def debt_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_orderkey") % 500 > 0, F.col("l_tax")).alias("debt"))
    return quality.incomplete(rows, "l_suppkey", "debt")
