"""The active set of factors: who is in it with what weight, whether it is healthy, and when a new one may follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.plans.dsl import Spec, batches, compile_many
from shoal.sources.commits import kept

from . import research, selection, stats, tables


def known(c: Column) -> Column:
    """A number, or null where there is none or it isn't one."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def active_set(log: DataFrame, source: str) -> DataFrame:
    """(place, factor) of the newest entry of ``source`` in a log of (source, at, factors_json)."""
    newest = tables.latest(log.filter(F.col("source") == source), ["source"], "at")
    return newest.select(F.posexplode(F.from_json("factors_json", "array<bigint>")).alias("place", "factor"))


def active_specs(active: DataFrame, library: DataFrame, evals: DataFrame) -> DataFrame:
    """(place, factor, weight) of active factors that the library has.

    weight: net_ir of the newest evaluation, else is_icir, else 1, signs kept; all the same if their signed sum is zero.
    """
    newest = tables.latest(evals, ["factor"], "run_at").select("factor", "net_ir", "is_icir")
    real = lambda c: known(F.col(c))
    x = active.join(library.select("factor").distinct(), "factor").join(newest, "factor", "left").withColumn("w", F.coalesce(real("net_ir"), real("is_icir"), F.lit(1.0)))
    total = F.sum("w").over(Window.partitionBy())  # one row a factor
    return x.select("place", "factor", F.when(total == 0, 1.0).otherwise(F.col("w")).alias("weight"))


def degraded(specs: DataFrame, evals: DataFrame) -> DataFrame:
    """One row: true if the set is empty or none of its factors has a net ratio."""
    newest = tables.latest(evals, ["factor"], "run_at").select("factor", "net_ir")
    return specs.join(newest, "factor", "left").agg((F.count("net_ir") == 0).alias("degraded"))


def out_of_sample_ratio(oos: Column, within: Column) -> Column:
    """How many times its in-sample ratio a factor has out of sample; null where either is missing or the latter is 0."""
    return F.try_divide(oos, F.nullif(within, F.lit(0.0)))


def factor_health(evals: DataFrame, most: float = 5.0, least: float = 0.3) -> DataFrame:
    """(factor, warning) of the newest evaluations: a ratio out of sample beyond belief, or one that fails there (below ``least``,
    so every negative one), and a negative stability. A ratio that can't be taken gives no warning."""
    newest = tables.latest(evals, ["factor"], "run_at")
    ratio = known(out_of_sample_ratio(F.col("oos_icir"), F.col("is_icir")))
    found = F.array_compact(F.array(F.when(ratio > most, "ratio_high").when(ratio < least, "ratio_low"), F.when(known(F.col("stability")) < 0, "stability")))
    return newest.select("factor", F.explode(found).alias("warning"))


def promotion(new: Column, old: Column, lift: float = 0.02) -> Column:
    """Why a new set does or doesn't follow: it must beat the old one's out-of-sample ratio by ``lift``, or be positive where there is none."""
    bad = lambda c: F.isnan(c)
    first = F.when(new.isNull() | bad(new), "first: unknown").when(new <= 0, "first: not positive").otherwise("promote")
    later = F.when(new.isNull() | bad(new) | bad(old), "unknown").when(new > old + lift, "promote").otherwise("too little")
    return F.when(old.isNull(), first).otherwise(later)


def search(library: DataFrame, text: str, columns: list[str], source: str | None = None, least: Column | None = None) -> DataFrame:
    """Rows of which any of ``columns`` holds ``text`` in any case, of one source, that fulfil ``least``."""
    found = F.exists(F.array(*columns), lambda c: F.contains(F.lower(c), F.lit(text.lower())))
    x = library.filter(F.coalesce(found, F.lit(False)))
    x = x if source is None else x.filter(F.col("source") == source)
    return x if least is None else x.filter(least)


def research_loop(panel: DataFrame, labels: DataFrame, specs: list[Spec], old_oos: float | None = None, *, gate: float = 0.5, least: int = 50, ceiling: float = 0.7, top: int = 20, folds: tuple[int, int, int] = (504, 126, 126), window: int = 252, rebalance: str = "W", batch: int = 64) -> DataFrame:
    """(factor, is_icir, oos_icir, oos_is_ratio, stability, turnover, net_ir, reason, selected, new_oos, verdict), a row for each factor that was chosen.

    All ``specs`` are tried over the dense panel, ``batch`` at a time; those that pass the gate are chosen greedily without
    close relatives; each of those may still have a ``reason`` to go. new_oos is the mean ratio out of sample of the rest, and
    ``verdict`` whether the set may follow one of ``old_oos``. labels: (h, dt, code, fwd) of one horizon. What comes to the
    driver is one row a factor, or a pair of gated factors.
    """
    spark = panel.sparkSession
    made: dict[str, DataFrame] = {}  # by factor, the table that has it
    schema = "factor string, is_icir double, oos_icir double, oos_is_ratio double, stability double, turnover double, net_ir double, reason string, selected boolean, new_oos double, verdict string"
    passed: dict[str, dict] = {}
    exprs = {s.id: s.expr for s in specs}

    own = kept(panel.join(labels.select("dt", "code", "fwd"), ["dt", "code"], "left"))
    rows = own.count()
    for ids in batches(exprs, batch):
        # one table a batch, written once; the gate, the folds and the stability read the same coefficients
        wide = kept(compile_many(own, {f: exprs[f] for f in ids}, rows, ("dt", "code", "fwd")).select("dt", "code", "fwd", *(F.col(f).cast("double").alias(f) for f in ids)))
        made |= dict.fromkeys(ids, wide)
        ic = kept(research.coefficients(wide, ids, "fwd", 2, masked=True).withColumn("h", F.lit(0)))
        found = selection.gated(ic, gate, least).join(selection.fold_ratios(ic, *folds).select("factor", "oos_icir"), "factor", "left")
        found = found.join(research.stability(ic, "factor", "ic", window).select("factor", F.col("worst").alias("stability")), "factor", "left")
        passed |= {r["factor"]: {"id": r["factor"]} | r.asDict() for r in found.collect()}
    if not passed:
        return spark.createDataFrame([], schema)

    def groups(ids: list[str]) -> list[tuple[DataFrame, list[str]]]:
        """The tables that have some of ``ids``, each with those."""
        parts = {id(made[f]): (made[f], []) for f in ids}
        for f in ids:
            parts[id(made[f])][1].append(f)
        return list(parts.values())

    # the walk looks at factors by falling ratio and ends at ``top``, so pairs are worked out as far as it gets
    corr: dict[tuple[str, str], float] = {}
    chosen: list[str] = []
    order = sorted((s for s in passed.values() if s["oos_icir"] is not None), key=stats.by_ratio)
    for k in range(0, len(order), 3 * top):
        ids = sorted({*chosen, *(s["id"] for s in order[k : k + 3 * top])})
        pairs = research.wide_correlations([t.select("dt", "code", *fs) for t, fs in groups(ids)])
        corr |= {(r["f1"], r["f2"]): r["corr"] or 0.0 for r in pairs.collect()} if len(ids) > 1 else {}
        chosen = stats.greedy(order[: k + 3 * top], corr, gate, ceiling, top, least)
        if len(chosen) == top:
            break
    chosen = chosen or stats.greedy(list(passed.values()), corr, gate, ceiling, top, least)
    x = spark.createDataFrame([(f, *(passed[f][c] for c in ("icir", "oos_icir", "stability"))) for f in chosen], "factor string, is_icir double, oos_icir double, stability double")
    ranks = [(kept(research.date_ranks(t.select("dt", "code", "fwd", *fs), fs)), fs) for t, fs in groups(chosen)]
    turnovers = reduce(DataFrame.unionByName, (selection.wide_turnovers(t, fs) for t, fs in ranks))
    own = reduce(DataFrame.unionByName, (selection.tall(t, {f: F.col(f) for f in fs}, "fwd").withColumnRenamed("value", "r") for t, fs in ranks))
    x = x.join(turnovers, "factor", "left").join(selection.long_shorts(own, labels, rebalance=rebalance).select("factor", "net_ir"), "factor", "left")
    x = x.withColumn("oos_is_ratio", out_of_sample_ratio(F.col("oos_icir"), F.col("is_icir")))
    x = x.withColumn("reason", stats.drop_reason(F.col("net_ir"), F.col("oos_is_ratio"), F.col("stability"))).withColumn("selected", F.col("reason").isNull())
    all_ = Window.partitionBy()  # at most ``top`` rows
    x = x.withColumn("new_oos", F.avg(F.when(F.col("selected"), F.col("oos_icir"))).over(all_))
    none = F.count_if("selected").over(all_) == 0
    x = x.withColumn("verdict", F.when(none, "none selected").otherwise(promotion(F.col("new_oos"), F.lit(old_oos).cast("double"))))
    names = [c.split()[0] for c in schema.split(", ")]
    return x.select(*names)
