"""Tables that change by commits, the active set, promotions, merges, streams and what comes from elsewhere."""

import datetime
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shoal.operators import screen, state, tables
from shoal.plans.dsl import Spec
from shoal.sources import bars, feeds
from shoal.sources.commits import Change, Conflict, Store
from shoal.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def digest(folder):
    return {str(p.relative_to(folder)): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*") if p.is_file()}


EVAL = "code string, run_at string, is_icir double, oos_icir double, oos_is_ratio double, stability double, turnover double, net_ir double"
SEED = [("A", "2026-01-01", 0.5, 0.4, 0.8, -1.0, 0.1, 0.5), ("A", "2026-02-01", 0.5, 0.4, 0.8, -1.0, 0.1, -0.3), ("B", "2026-02-01", 0.6, 0.5, 0.9, 1.0, 0.2, 0.6), ("C", "2026-02-01", 0.4, 0.3, 0.7, 2.0, 0.1, 0.7)]


def members(store, source=None):
    return [r["factor"] for r in state.active(store, source).orderBy("place").collect()]


def marked(store):
    return {(r["code"], r["run_at"]): r["selected"] for r in state.selected(store.read("factor_eval"), state.active(store, state.AUTO)).collect()}


def test_selected_follows_the_active_set_and_demotions(spark, store):
    store.commit("seed", [Change("factor_eval", spark.createDataFrame(SEED, EVAL))])
    state.set_active(store, "2026-02-02", ["A", "B", "C"], 0.7)
    assert marked(store) == {("A", "2026-01-01"): 0, ("A", "2026-02-01"): 1, ("B", "2026-02-01"): 1, ("C", "2026-02-01"): 1}
    assert state.demote(store, "2026-02-03") == [("A", "stability")]
    assert members(store) == ["B", "C"] and state.active(store).first()["oos"] == 0.7
    assert marked(store) == {("A", "2026-01-01"): 0, ("A", "2026-02-01"): 0, ("B", "2026-02-01"): 1, ("C", "2026-02-01"): 1}
    assert state.setting(store, "active_factors") == '["B", "C"]'
    version = store.head().version
    assert state.demote(store, "2026-02-04") == [] and store.head().version == version


def test_a_factor_without_net_ratio_goes_and_the_set_may_be_empty(spark, store):
    store.commit("seed", [Change("factor_eval", spark.createDataFrame([("D", "2026-02-01", 0.5, 0.4, 0.8, 0.5, 0.1, None)], EVAL))])
    state.set_active(store, "2026-02-02", ["D"])
    assert state.demote(store, "2026-02-03") == [("D", "net_ir")]
    assert members(store) == [] and set(marked(store).values()) == {0}


def test_sets_by_source_and_the_setting_without_history(spark, store):
    assert members(store) == [] and state.setting(store, "x") is None
    store.commit("old", [state.settings(store, active_factors='["x", "y"]')])
    assert members(store) == members(store, state.AUTO) == ["x", "y"] and members(store, "other") == []
    state.set_active(store, "2026-01-01", ["a"])
    state.save_selected(store, "2026-01-05", ["m", "n"], {"sharpe": 1.0})
    assert members(store) == ["m", "n"] and members(store, state.AUTO) == ["a"] and state.load_selected(store) == ["m", "n"]
    assert state.setting(store, "active_factors") == '["a"]' and state.setting(store, "multifactor_summary") == '{"sharpe": 1.0}'
    store.commit("bad", [state.settings(store, active_factors="not a list", multifactor_selected="no")])
    assert state.load_selected(store) is None


def test_one_of_two_writers_wins(store):
    base = store.head().version
    state.set_active(store, "2026-01-01", ["a"], base=base)
    with pytest.raises(Conflict):
        state.set_active(store, "2026-01-02", ["b"], base=base)
    assert members(store) == ["a"]
    both = store.head()
    both.version += 1
    store._publish(both)
    with pytest.raises(Conflict):  # both had read the same version
        store._publish(both)
    assert store.head().version == both.version


def test_a_crash_before_the_pointer_leaves_nothing_to_see(store, monkeypatch):
    state.set_active(store, "2026-01-01", ["a"])
    before = store.head()
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda self, snapshot: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            state.set_active(store, "2026-01-02", ["b"])
    assert store.head() == before and members(store) == ["a"] and state.setting(store, "active_factors") == '["a"]'
    state.set_active(store, "2026-01-02", ["b"])
    assert members(store) == ["b"]


def outcome(spark, verdict="promote", chosen=("g", "h")):
    rows = [(f, 2.0 - k, 1.0, 0.5, 0.1, 0.2, 0.9, None if f in chosen else "net_ir", f in chosen, 1.0, verdict) for k, f in enumerate(("g", "h", "i"))]
    return spark.createDataFrame(rows, "factor string, is_icir double, oos_icir double, oos_is_ratio double, stability double, turnover double, net_ir double, reason string, selected boolean, new_oos double, verdict string")


SPECS = [Spec(f, "x", f"sma(close, {k + 2})") for k, f in enumerate(("g", "h", "i"))]


def test_promotion_is_one_commit_over_four_tables(spark, store, tmp_path, monkeypatch):
    state.set_active(store, "2025", ["old"])
    before = digest(tmp_path)
    assert not state.promote(store, "2026", outcome(spark), SPECS, dry_run=True)
    assert not state.promote(store, "2026", outcome(spark, "too little"), SPECS)
    assert not state.promote(store, "2026", outcome(spark, chosen=()), SPECS)
    assert digest(tmp_path) == before
    real, calls = Store._write, []

    def half(self, name, rows):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(self, name, rows)

    with monkeypatch.context() as m:
        m.setattr(Store, "_write", half)
        with pytest.raises(RuntimeError):
            state.promote(store, "2026", outcome(spark), SPECS)
    assert members(store) == ["old"] and store.read("factor_library").count() == store.read("factor_eval").count() == store.read("evolution_log").count() == 0
    assert state.promote(store, "2026", outcome(spark), SPECS) and state.promote(store, "2026", outcome(spark), SPECS)
    assert sorted((r.code, r.expr) for r in store.read("factor_library").collect()) == [("g", "sma(close, 2)"), ("h", "sma(close, 3)")]
    log = store.read("evolution_log").collect()
    assert [(r.selected_json, r.old_oos, r.new_oos) for r in log] == [('["g", "h"]', None, 1.0)]
    assert members(store) == ["g", "h"] and {k for k, v in marked(store).items() if v} == {("g", "2026"), ("h", "2026")}
    assert state.promote(store, "2027", outcome(spark, chosen=("h",)), SPECS) and members(store) == ["h"]
    assert store.read("evolution_log").filter("run_at = '2027'").first()["old_oos"] == 1.0
    assert [r.expr for r in state.active_weights(store).collect()] == ["sma(close, 3)"]


def bar(spark, rows):
    return spark.createDataFrame([(c, datetime.date.fromisoformat(d), x) for c, d, x in rows], "code string, dt date, close double").withColumn("month", F.date_format("dt", "yyyy-MM"))


def closes(store):
    return {(r.code, str(r.dt)): r.close for r in store.read("daily").collect()}


def test_merges_touch_only_their_partitions(spark, store):
    store.commit("a", [Change("daily", bar(spark, [("a", "2024-01-02", 1.0), ("a", "2024-02-02", 2.0), ("b", "2024-02-02", 3.0)]), "merge")])
    first = store.head()
    store.commit("b", [Change("daily", bar(spark, [("a", "2024-02-02", 8.0), ("a", "2024-02-02", 9.0), ("c", "2024-03-01", 4.0)]), "merge")])
    second = store.head()
    assert second.tables["daily"]["2024-01"] == first.tables["daily"]["2024-01"] and second.tables["daily"]["2024-02"] != first.tables["daily"]["2024-02"]
    assert closes(store) == {("a", "2024-01-02"): 1.0, ("a", "2024-02-02"): 9.0, ("b", "2024-02-02"): 3.0, ("c", "2024-03-01"): 4.0}
    assert store.read("daily", snapshot=first).count() == 3 and store.read("daily", ["2024-03"]).count() == 1
    store.commit("c", [Change("daily", bar(spark, [("a", "2024-01-02", None), ("b", "2024-01-02", 5.0)]), "fill")])
    store.commit("d", [Change("daily", bar(spark, [("a", "2024-01-02", 7.0), ("a", "2024-01-03", 6.0)]), "insert")])
    assert {k: v for k, v in closes(store).items() if k[1] < "2024-02"} == {("a", "2024-01-02"): 1.0, ("b", "2024-01-02"): 5.0, ("a", "2024-01-03"): 6.0}
    same = store.head().tables
    store.commit("e", [Change("daily", bar(spark, []), "merge")])
    assert store.head().tables == same
    with pytest.raises(KeyError):
        store.read("nothing")


def test_columns_that_came_later_are_null_and_others_are_dropped(spark, store):
    store.commit("a", [Change("fin_q", spark.createDataFrame([("a", "2024-03-31", 1.0, "x")], "code string, period string, roe double, other string"))])
    assert store.read("fin_q").select("roe", "as_of").first() == (1.0, None)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (None, "n", 2.0), (3, "c", 3.0)], "k int, s string, x double")
    new = spark.createDataFrame([(1, None, 5), (1, 9.0, 4), (None, 7.0, 1), (4, 4.0, 1)], "k int, x double, at int")
    go = lambda **how: sorted(map(repr, (tuple(r) for r in tables.upsert(old, new, ["k"], **how).collect())))
    assert go(order="at") == sorted(map(repr, [(1, None, None), (None, None, 7.0), (3, "c", 3.0), (4, None, 4.0)]))
    assert go() == sorted(map(repr, [(1, None, 9.0), (None, None, 7.0), (3, "c", 3.0), (4, None, 4.0)]))
    assert go(policy="coalesce", order="at") == sorted(map(repr, [(1, "a", 1.0), (None, "n", 7.0), (3, "c", 3.0), (4, None, 4.0)]))
    assert go(policy="insert") == sorted(map(repr, [(1, "a", 1.0), (None, "n", 2.0), (3, "c", 3.0), (4, None, 4.0)]))
    with pytest.raises(ValueError):
        go(policy="other")
    assert tables.upsert(old, new.limit(0), ["k"]).count() == 3


def test_a_stream_that_runs_again_adds_nothing_and_its_state_is_bounded(spark, store, tmp_path):
    rows = [("a", "2024-01-02", 1.0), ("b", "2024-01-02", 2.0), ("a", "2024-03-01", 3.0)]
    bar(spark, rows).write.parquet(f"{tmp_path}/in/1")
    stream = lambda: spark.readStream.schema(bar(spark, []).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def go(checkpoint):
        q = ingest.ingest(stream(), store, "s", f"{tmp_path}/{checkpoint}", F.col("_metadata.file_modification_time"))
        q.awaitTermination()
        return q

    go("one")
    head = store.head()
    go("two")  # a lost checkpoint: the batches come again
    assert store.head() == head
    bar(spark, [("a", "2024-01-02", 9.0), ("a", "2024-01-03", 4.0), ("a", "2024-01-03", 5.0), ("c", "2024-02-01", 6.0)]).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    q = go("one")
    assert closes(store) == {("a", "2024-01-02"): 1.0, ("b", "2024-01-02"): 2.0, ("a", "2024-03-01"): 3.0, ("a", "2024-01-03"): closes(store)["a", "2024-01-03"], ("c", "2024-02-01"): 6.0}
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 6
    assert store.head().tables["daily"]["2024-03"] == head.tables["daily"]["2024-03"]


def test_outcomes_fill_nulls_alone_and_rewrite_changed_days(spark, store):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(40)]
    rows = spark.createDataFrame([("a", d, 10.0 + k, 10.0 + k) for k, d in enumerate(days)], "code string, dt date, open double, close double").withColumn("month", F.date_format("dt", "yyyy-MM"))
    picks = spark.createDataFrame([(days[0], "a", None), (days[0], "b", None), (days[1], "a", 5.0), (days[39], "a", None)], "run_date date, code string, ret_5 double")
    store.commit("x", [Change("daily", rows, "replace"), Change("recommendations", picks, "replace")])
    before = store.head().tables["recommendations"]
    assert screen.fill_outcomes(store) == 2
    got = {(r.run_date, r.code): (r.ret_5, r.ret_10, r.ret_60) for r in store.read("recommendations").collect()}
    ret = lambda i, n: pytest.approx(round(((10 + i + n) / (10 + i) - 1) * 100, 2))
    assert got[days[0], "a"] == (ret(1, 5), ret(1, 10), None) and got[days[1], "a"][:2] == (5.0, ret(2, 10)) and got[days[0], "b"] == got[days[39], "a"] == (None, None, None)
    after = store.head().tables["recommendations"]
    assert {d for d in before if before[d] != after[d]} == {str(days[0]), str(days[1])}
    assert screen.fill_outcomes(store) == 0 and store.head().tables["recommendations"] == after


def cross(spark, rows):
    return spark.createDataFrame(rows, "code string, x double, y double")


def test_composites_without_spread_take_plain_values(spark):
    go = lambda rows: {r.code: (r.score, r.reasons) for r in screen.composite(cross(spark, rows), {"x": 2.0, "y": 1.0}).collect()}
    assert go([("a", 1.0, 5.0), ("b", 3.0, 5.0)]) == {"a": (7.0, "y(+5.0) x(+2.0)"), "b": (11.0, "x(+6.0) y(+5.0)")}
    assert go([("a", 1.0, 5.0)]) == {"a": (7.0, "y(+5.0) x(+2.0)")}
    assert go([("a", None, 1.0), ("b", 3.0, 2.0)]) == {"a": (1.0, "y(+1.0) x(+0.0)"), "b": (8.0, "x(+6.0) y(+2.0)")}
    got = go([("a", 1.0, 1.0), ("b", 3.0, 2.0), ("c", None, 3.0)])
    assert got["a"][0] == pytest.approx(-(2**0.5) - 1) and got["c"][0] == pytest.approx(1.0) and got["b"][0] == pytest.approx(2**0.5)


def test_screen_takes_the_set_as_of_a_day_and_falls_back(spark, store):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(150)]
    rows = spark.createDataFrame([(c, d, *(100 + k * s,) * 4, 1e6, 1e8) for k, d in enumerate(days) for c, s in (("a", 0.5), ("b", -0.1), ("c", 0.2))], "code string, dt date, open double, high double, low double, close double, volume double, amount double")
    p = bars.densify(rows)
    library = [("up", "returns(close, 5)"), ("flat", "sub(volume, volume)")]
    members = lambda *fs: spark.createDataFrame([(k, f, dict(library)[f], w) for k, (f, w) in enumerate(fs)], "place int, factor string, expr string, weight double")
    order = lambda m, **k: [r.code for r in screen.by_set(p, m, days, **k).orderBy(F.desc("score")).collect()]
    assert order(members(("up", 1.0))) == ["a", "c", "b"] and order(members(("up", -1.0))) == ["b", "c", "a"]
    plain = screen.by_set(p, members(("up", 1.0), ("flat", 1.0)), days, as_of=days[10] + datetime.timedelta(0)).collect()
    assert {r.code: round(r.score, 6) for r in plain} == {c: round((100 + 10 * s) / (100 + 5 * s) - 1, 6) for c, s in (("a", 0.5), ("b", -0.1), ("c", 0.2))}
    assert order(members(("up", 1.0)), as_of=datetime.date(2000, 1, 1)) == ["a", "c", "b"]
    assert screen.by_set(p, members(), days).collect() == []
    codes = spark.createDataFrame([(c, "i", 6e9, 10.0, 9.0, 1.0, 5.0) for c in "abcd"], "code string, industry string, total_mv double, pe double, roe double, debt double, price double")
    day = days[-1]
    go = lambda **k: screen.run(store, day, codes, rows, days, 30, 130, 20, **k)
    assert go(persist=False).count() == 3 and store.head().version == 0
    got = go().collect()
    assert {r.code for r in got} == set("abc") and got[0].factor_set_id is None and state.setting(store, "factor_system_degraded") == "1"
    store.commit("lib", [Change("factor_library", spark.createDataFrame([(f, e, "2024") for f, e in library], "code string, expr string, created_at string"))])
    state.set_active(store, "2024-02-02", ["up"])
    for _ in range(2):
        got = go().orderBy("rank").collect()
    assert [(r.rank, r.code, r.factor_set_id) for r in got] == [(1, "a", "2024-02-02"), (2, "c", "2024-02-02"), (3, "b", "2024-02-02")]
    assert store.read("recommendations").count() == 3 and state.setting(store, "factor_system_degraded") == "0" and state.setting(store, "last_recommend_run") == str(day)


def test_adjusted_bars_are_all_or_nothing(spark):
    raw, adjusted = (spark.createDataFrame([(c, 1, x) for c, x in rows], "code string, dt int, close double") for rows in ([("a", 1.0), ("b", 2.0)], [("a", 10.0)]))
    got = lambda df: sorted((r.code, r.close) for r in df.collect())
    pick = lambda *c: spark.createDataFrame([(x,) for x in c], "code string")
    assert got(bars.adjusted(adjusted, raw)) == [("a", 10.0)] and got(bars.adjusted(adjusted.limit(0), raw)) == [("a", 1.0), ("b", 2.0)]
    assert got(bars.for_codes(adjusted, pick("a", "b"), raw)) == [("a", 10.0)] and got(bars.for_codes(adjusted, pick("b"), raw)) == [("b", 2.0)]
    assert got(bars.of_code(raw, "b")) == [("b", 2.0)]


def test_feeds(spark):
    texts = spark.createDataFrame([("s", 1, "Alpha#1: a\nalpha#2 = b \n alpha#x: no"), ("s", 2, "alpha#1: c\nalpha#3:d"), ("t", 1, "alpha#3 : e"), ("t", 2, None), ("u", 1, "")], "source string, place int, text string")
    held = spark.createDataFrame([("raw_2",)], "id string")
    got = sorted((r.source, r.id, r.formula) for r in feeds.formulas(texts, held).collect())
    assert got == [("s", "raw_1", "a"), ("s", "raw_3", "d")]
    many = spark.createDataFrame([("s", 1, "\n".join(f"alpha#{k}: f" for k in range(9, 0, -1)))], "source string, place int, text string")
    assert [r.id for r in feeds.formulas(many, held).collect()] == ["raw_9", "raw_8", "raw_7", "raw_6", "raw_5", "raw_4"]
    ends = spark.sql("select date'2023-05-05' a, date'2024-04-01' b").select(feeds.periods(F.col("a"), F.col("b")).alias("p")).first().p
    assert [str(d) for d in ends] == ["2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31", "2024-03-31"]
    assert feeds.renamed(spark.createDataFrame([("1", 2.0)], "`代码` string, `其他` double"), feeds.SPOT_COLUMNS).columns == ["code", "其他"]


def test_health_warns_of_both_ends(spark):
    from shoal.operators import evolution

    rows = [("high", 1.0, 6.0), ("low", 1.0, 0.2), ("fine", 1.0, 2.0), ("edge", 1.0, 5.0), ("edge2", 10.0, 3.0), ("turned", -1.0, 2.0), ("zero", 0.0, 2.0), ("none", None, 2.0), ("nan", float("nan"), 1.0)]
    evals = spark.createDataFrame([(f, 1, i, o, 1.0) for f, i, o in rows] + [("shaky", 1, 1.0, 1.0, -0.1), ("unknown", 1, 1.0, 1.0, float("nan"))], "factor string, run_at int, is_icir double, oos_icir double, stability double")
    assert {tuple(r) for r in evolution.factor_health(evals).collect()} == {("high", "ratio_high"), ("low", "ratio_low"), ("turned", "ratio_low"), ("shaky", "stability")}


def test_a_run_of_the_loop_promotes_once(spark, store):
    """Prices follow last week's volume: the factor that reads it becomes the active set; the same again isn't better; a dry run writes nothing."""
    import numpy as np

    from shoal.operators import stats

    r = np.random.default_rng(5)
    n, codes = 120, 20
    volume = r.normal(size=(n, codes))
    change = np.vstack([np.zeros((2, codes)), 0.02 * volume[:-2]]) + r.normal(0, 0.01, (n, codes))
    price = 100 * np.exp(np.cumsum(change, axis=0))
    rows = [(f"c{j:02}", datetime.date(2024, 1, 1) + datetime.timedelta(i), *(float(price[i, j]),) * 4, float(volume[i, j]), float(r.normal())) for i in range(n) for j in range(codes)]
    p = bars.densify(spark.createDataFrame(rows, "code string, dt date, open double, high double, low double, close double, volume double, amount double"))
    labels = p.select("dt", "code", F.lit(2).alias("h"), stats.forward_return(2).alias("fwd"))
    specs = [Spec("good", "x", "add(volume, 0)"), Spec("noise", "x", "add(amount, 0)"), Spec("bad", "x", "sub(0, volume)")]
    go = lambda at, **k: state.evolve(store, at, p, labels, specs, folds=(60, 20, 20), window=60, gate=5.0, **k).first()
    assert not go("2026-01", dry_run=True)["promoted"] and store.head().version == 0
    first = go("2026-01")
    assert first["promoted"] and members(store) == ["good"] and store.read("evolution_log").count() == store.read("factor_library").count() == 1
    head = store.head()
    again = go("2026-02")
    assert not again["promoted"] and again["verdict"] == "too little" and store.head() == head
