"""What bounds a task's memory and a query's repeated work, whatever the size of its tables."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from shoal.functions import blocks, panel
from shoal.operators import research, selection, stats
from shoal.plans import catalogue, dsl
from shoal.sources import bars

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_recipes_over_dates_go_apart_and_tasks_follow_rows(spark):
    exprs = {s.id: s.expr for s in catalogue.catalogue()}
    parts = dsl.batches(exprs)
    assert sorted(f for ids in parts for f in ids) == sorted(exprs)
    dated = [[dsl.over_dates(exprs[f]) for f in ids] for ids in parts]
    assert all(all(d) and len(d) <= 4 or not any(d) and len(d) <= 64 for d in dated) and any(map(all, dated))
    p = spark.createDataFrame([("a", 1)], "code string, x int")
    assert [bars.dealt(p, 64, n).rdd.getNumPartitions() for n in (1 << 20, 6 << 20)] == [64, 384]


def test_a_rank_takes_one_sort(spark):
    rows = [(1, 2.0), (1, 2.0), (1, None), (1, -1.0), (2, None), (2, 0.0), (2, -0.0)]
    x = spark.createDataFrame(rows, "dt int, x double").withColumn("r", panel.rank_pct(F.col("x")))
    assert plan(x).count("Sort ") == 1
    assert sorted(((r.dt, r.x, r.r) for r in x.collect()), key=repr) == sorted([(1, 2.0, 2.5 / 3), (1, 2.0, 2.5 / 3), (1, None, None), (1, -1.0, 1 / 3), (2, None, None), (2, 0.0, 0.75), (2, -0.0, 0.75)], key=repr)


def test_own_coefficients_need_no_join(spark):
    r = np.random.default_rng(3)
    v = lambda: float(np.round(r.normal(), 1)) if r.random() > 0.1 else None
    rows = [(datetime.date(2024, 1, d), f"c{i}", v(), v(), v(), v()) for d in (1, 2, 3) for i in range(20)]
    p = spark.createDataFrame(rows, "dt date, code string, a double, b double, f2 double, f3 double")
    labels = p.select("dt", "code", F.explode(F.create_map(F.lit(2), F.col("f2"), F.lit(3), F.col("f3"))).alias("h", "fwd"))
    values = {f: F.col(f) for f in "ab"}
    own = selection.own_coefficients(p, values, {2: F.col("f2"), 3: F.col("f3")}, 5)
    key = lambda df: sorted((x.factor, x.h, x.dt, x.n, round(x.ic, 9)) for x in df.collect())
    assert key(own) == key(selection.coefficients(selection.tall(p, values), labels, 5)) and len(key(own)) == 12
    import __spark_entry__ as entry

    assert "Join" not in plan(entry.queries()["analyze_factors"](spark, SF)).replace("BroadcastHashJoin", "")


def test_greedy_select_makes_its_panel_once(spark, monkeypatch):
    import __spark_entry__ as entry

    seen = []
    real = research.wide_correlations
    monkeypatch.setattr(research, "wide_correlations", lambda tables, *a: seen.extend(map(plan, tables)) or real(tables, *a))
    entry.queries()["greedy_select"](spark, SF).collect()
    assert seen and not any("Aggregate" in p or "Window" in p for p in seen)


def test_equal_ratios_go_by_name():
    row = lambda i, x: {"id": i, "n": 60, "icir": x, "oos_icir": 1.0}
    assert stats.greedy([row("b", 1.0 + 1e-13), row("a", 1.0)], {("a", "b"): 1.0}) == ["a"]


def test_ranks_of_some_rows():
    x = np.round(np.random.default_rng(4).normal(0, 1, (50, 3)), 1)
    rows = np.arange(50) % 3 > 0
    columns = np.array([2, 0])
    np.testing.assert_array_equal(blocks.ranks_of(x, np.argsort(x, axis=0), columns, rows), blocks.ranks(x[rows][:, columns]))


def test_rows_of_weights_fit_short_integers():
    from shoal.llm import lm

    assert all(rows <= 1 << 16 for rows, _ in lm.SHAPES)


def test_a_step_holds_no_gradients_of_all_tokens():
    """A batch's gradients by row and token would be 8 MB; its sums are made in parts."""
    import tracemalloc

    from shoal.llm import lm

    r = np.random.default_rng(3)
    k = r.integers(0, lm.CLASSES, lm.BATCH).astype(np.int32)
    rows = np.minimum(r.integers(0, lm.WORD_ROWS, (lm.BATCH, 4)), r.integers(0, lm.WORD_ROWS, (lm.BATCH, 4))).astype(np.int32)
    t, bias = lm.Trainer(lm.zeros()), np.zeros(lm.CLASSES, np.float32)
    tracemalloc.start()
    t.step(0, rows, k, bias)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    assert t.used[0].sum() == rows.size and np.array_equal(np.flatnonzero(t.used[0]), np.unique(rows))


def test_sums_of_rows_by_parts():
    """Rows chosen once, by a few tokens and by most of them, over several parts, against sums one by one."""
    from shoal.llm import lm

    r = np.random.default_rng(4)
    z = r.normal(size=(4000, lm.CELLS)).astype(np.float32)
    rows = np.where(r.random((4000, 2)) < 0.3, 7, (r.random((4000, 2)) ** 3 * 60000).astype(int)).astype(np.int32)
    want, times = np.zeros((1 << 16, lm.CELLS)), np.bincount(rows.ravel(), minlength=1 << 16)
    np.add.at(want, rows.ravel(), np.repeat(z.astype(float), 2, axis=0))
    seen = []
    for own, size, g in lm.sums_by_row(z, rows, *(np.empty(lm.PART * lm.CELLS, np.float32) for _ in range(2))):
        np.testing.assert_array_equal(size, times[own])
        np.testing.assert_allclose(g, want[own], atol=1e-3)
        seen += own.tolist()
    assert len(seen) > 2 * lm.PART and sorted(seen) == np.unique(rows).tolist()


def test_softmax_of_far_logits():
    """Logits whose exponentials overflow or vanish."""
    from shoal.llm import lm

    for shift in (0, 500, -500):
        z = np.random.default_rng(5).normal(size=(9, 64)).astype(np.float32)
        want = z[np.arange(9), 3] - np.log(np.exp(z).sum(1))
        np.testing.assert_allclose(lm.log_share(z + np.float32(shift), np.full(9, 3)), want, atol=1e-3)


def test_places_of_words():
    from shoal.llm import lm
    from shoal.llm.text import mix

    h = mix(np.arange(1, 5000, dtype=np.uint64))
    ask = np.r_[h, np.array([0, 2**64 - 1], np.uint64)]
    for keys in (np.unique(h[::2]), np.unique(h[:1]), np.arange(50, dtype=np.uint64)):  # the last all begin with the same bits
        np.testing.assert_array_equal(lm.Places(keys).of(ask), np.minimum(np.searchsorted(keys, ask), len(keys) - 1))
    assert len(lm.Places(h[:0]).of(ask)) == len(ask)
