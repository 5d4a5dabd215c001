"""What the research keeps: the active set and its history, settings, promotions and demotions, as commits of a ``Store``.

The active set has one writer, ``set_active``: a row of history and the setting that mirrors it in one commit. Which evaluations are
selected follows from it and isn't stored, so it can't differ. Each write has a run, whose repetition changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.plans.dsl import Spec
from shoal.sources.commits import Change, Store, kept

from . import evolution, research, tables

AUTO, MINED = "auto_evolve", "research_mine"


def _rows(store: Store, schema: str, *rows: tuple) -> DataFrame:
    return store.spark.createDataFrame(list(rows), schema)


def setting(store: Store, key: str) -> str | None:
    found = store.read("meta").filter(F.col("key") == key).select("value").first()
    return found["value"] if found else None


def settings(store: Store, **values: str) -> Change:
    return Change("meta", _rows(store, "key string, value string", *values.items()), "merge")


def _active(store: Store, run_at: str, factors: Sequence[str], oos: float | None, source: str) -> list[Change]:
    said = json.dumps(list(factors), ensure_ascii=False)
    rows = _rows(store, "run_at string, factors_json string, oos double, source string", (run_at, said, oos, source))
    key = {"active_factors": said} if source == AUTO else {"multifactor_selected": said} if source == MINED else {}
    return [Change("active_sets", rows, "merge"), *([settings(store, **key)] if key else [])]


def set_active(store: Store, run_at: str, factors: Sequence[str], oos: float | None = None, source: str = AUTO, base: int | None = None) -> int:
    """Make ``factors`` the active set of ``source``; a set of the same time is replaced."""
    return store.commit(f"active:{source}:{run_at}", _active(store, run_at, factors, oos, source), base=base)


def active(store: Store, source: str | None = None) -> DataFrame:
    """(place, factor, run_at, oos, source) of the newest set, of one source if told; without any history that of the setting (run_at null).

    A set that is empty has no rows, and isn't replaced by the setting; a setting that isn't a list is an empty set.
    """
    sets = store.read("active_sets")
    sets = sets if source is None else sets.filter(F.col("source") == source)
    x = sets.select(F.lit(1).alias("kind"), "run_at", "factors_json", "oos", "source")
    if source in (None, AUTO):
        old = store.read("meta").filter("key = 'active_factors'").select(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("run_at"), F.col("value").alias("factors_json"), F.lit(None).cast("double").alias("oos"), F.lit(AUTO).alias("source"))
        x = x.unionByName(old)
    newest = x.agg(F.max_by(F.struct("run_at", "factors_json", "oos", "source"), F.struct("kind", "run_at")).alias("s")).select("s.*")
    return newest.select(F.posexplode(F.from_json("factors_json", "array<string>")).alias("place", "factor"), "run_at", "oos", "source")


def selected(evals: DataFrame, members: DataFrame) -> DataFrame:
    """``evals`` (code, run_at, ...) with ``selected``: 1 for the newest row of each factor of ``members``."""
    newest = evals.groupBy("code").agg(F.max("run_at").alias("run_at")).join(members.select(F.col("factor").alias("code")).distinct(), "code", "left_semi")
    return evals.join(newest.withColumn("selected", F.lit(1)), ["code", "run_at"], "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def last_oos(store: Store) -> float | None:
    """The out-of-sample ratio that the last promotion had."""
    return store.read("evolution_log").agg(F.max_by("new_oos", "run_at").alias("oos")).first()["oos"]


def evolve(store: Store, run_at: str, panel: DataFrame, labels: DataFrame, specs: Sequence[Spec], dry_run: bool = False, **how) -> DataFrame:
    """Run the research loop against the last promotion's ratio, keep what it found if that may follow, and return its rows with ``promoted``."""
    outcome = kept(evolution.research_loop(panel, labels, list(specs), last_oos(store), **how))
    done = promote(store, run_at, outcome, specs, dry_run)
    return outcome.withColumn("promoted", F.lit(done))


def promote(store: Store, run_at: str, outcome: DataFrame, specs: Sequence[Spec], dry_run: bool = False) -> bool:
    """Keep what a run of ``evolution.research_loop`` found, if its verdict is to promote: library, evaluations, log and active set in one commit.

    A dry run, or any other verdict, writes nothing. ``outcome`` has a row for each chosen factor, at most the loop's ``top``.
    """
    found = [r.asDict() for r in outcome.orderBy(F.desc_nulls_last("is_icir"), "factor").collect()]
    chosen = [r for r in found if r["selected"]]
    if dry_run or not chosen or chosen[0]["verdict"] != "promote":
        return False
    ids = [r["factor"] for r in chosen]
    known = {s.id: s for s in specs}
    new, old = chosen[0]["new_oos"], last_oos(store)
    library = [(s.id, s.family, s.expr, "{}", s.id, AUTO, run_at) for s in map(known.__getitem__, ids)]
    evals = [(r["factor"], run_at, *(r[c] for c in ("is_icir", "oos_icir", "oos_is_ratio", "stability", "turnover", "net_ir"))) for r in chosen]
    store.commit(f"promote:{run_at}", [
        Change("factor_library", _rows(store, "code string, category string, expr string, params_json string, desc string, source string, created_at string", *library), "merge"),
        Change("factor_eval", _rows(store, "code string, run_at string, is_icir double, oos_icir double, oos_is_ratio double, stability double, turnover double, net_ir double", *evals), "merge"),
        Change("evolution_log", _rows(store, "run_at string, selected_json string, old_oos double, new_oos double, promoted boolean, notes string", (run_at, json.dumps(ids, ensure_ascii=False), old, new, True, "promote")), "merge"),
        *_active(store, run_at, ids, new, AUTO),
    ])
    return True


def demote(store: Store, run_at: str, least_stability: float = 0.0, least_ir: float = 0.0) -> list[tuple[str, str]]:
    """Take factors out of the active set whose newest evaluation is unstable or has no net ratio; (factor, reason) of those that went.

    The set's out-of-sample ratio stays. Nothing is written if none goes. One row a factor comes to the driver.
    """
    base = store.head()
    now = active(store, AUTO)
    why = research.demotions(now, store.read("factor_eval", snapshot=base).withColumnRenamed("code", "factor"), least_stability, least_ir)
    rows = now.join(why, "factor", "left").orderBy("place").collect()
    gone = [(r["factor"], r["reason"]) for r in rows if r["reason"]]
    if gone:
        set_active(store, run_at, [r["factor"] for r in rows if not r["reason"]], rows[0]["oos"], AUTO, base=base.version)
    return gone


def save_selected(store: Store, run_at: str, factors: Sequence[str], summary: dict | None = None) -> int:
    """Keep factors that forward selection chose: a set of its own source and the settings that mirror it; the active set isn't touched."""
    more = [] if summary is None else [settings(store, multifactor_summary=json.dumps(summary))]
    return store.commit(f"mined:{run_at}", _active(store, run_at, factors, None, MINED) + more)


def load_selected(store: Store) -> list[str] | None:
    """The factors kept last; None where there are none or the setting isn't a list."""
    try:
        return json.loads(setting(store, "multifactor_selected") or "null")
    except ValueError:
        return None


def active_weights(store: Store) -> DataFrame:
    """(place, factor, expr, weight) of the active set: of those that the library has, with the weights of ``evolution.active_specs``."""
    library = tables.latest(store.read("factor_library"), ["code"], "created_at").select(F.col("code").alias("factor"), "expr")
    evals = store.read("factor_eval").withColumnRenamed("code", "factor")
    return evolution.active_specs(active(store, AUTO), library, evals).join(library, "factor").select("place", "factor", "expr", "weight")
