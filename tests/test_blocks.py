"""Ranks, coefficients and correlations of pairs in blocks against pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest

from shoal.functions import blocks
from shoal.operators import research

R = np.random.default_rng(2)


def odd(n, m):
    x = np.round(R.normal(0, 2, (n, m)), 1)  # with ties
    x[R.random((n, m)) < 0.1] = np.nan
    x[:5, : m // 2] = np.nan  # a mask that several share
    x[:, 0] = 1.0
    return x


def test_ranks_are_those_of_pandas():
    x = odd(40, 6)
    np.testing.assert_allclose(blocks.ranks(x), pd.DataFrame(x).rank().to_numpy())
    assert blocks.ranks(np.zeros((0, 3))).shape == (0, 3)


def plain(a, b):
    both = ~np.isnan(a) & ~np.isnan(b)
    if both.sum() < 2:
        return int(both.sum()), np.nan
    return int(both.sum()), pd.Series(a[both]).rank().corr(pd.Series(b[both]).rank())


def test_correlations_of_all_pairs():
    a, b = odd(40, 6), odd(40, 4)
    a[:, 5], b[:, 3] = np.nan, np.r_[1.0, np.full(39, np.nan)]
    n, r = blocks.correlate(a, b)
    for i in range(6):
        for j in range(4):
            want = plain(a[:, i], b[:, j])
            assert n[i, j] == want[0]
            np.testing.assert_allclose(r[i, j], want[1], atol=1e-12)


@pytest.mark.parametrize("masked", [False, True])
def test_rank_coefficients(masked):
    x, y = odd(40, 5), odd(40, 2)[:, 1]
    n, ic = blocks.rank_ic(x, y, masked)
    for k in range(5):
        both = ~np.isnan(x[:, k]) & ~np.isnan(y)
        one, two = (pd.Series(x[:, k]).rank()[both], pd.Series(y).rank()[both]) if masked else (pd.Series(x[both, k]).rank(), pd.Series(y[both]).rank())
        assert n[k] == both.sum()
        np.testing.assert_allclose(ic[k], one.corr(two), atol=1e-12)


def test_blocks_of_factors_meet_by_date(spark, monkeypatch):
    monkeypatch.setattr(research, "BLOCK", 2)
    days = [datetime.date(2024, 1, k) for k in (1, 2, 3)]
    x = {d: odd(30, 5) for d in days}
    rows = [(f"f{k}", d, f"c{i:02}", float(v) if not np.isnan(v) else None) for d in days for (i, k), v in np.ndenumerate(x[d])]
    tall = spark.createDataFrame(rows, "factor string, dt date, code string, value double")
    got = {(r.f1, r.f2): (r.cells, r["corr"]) for r in research.pair_correlations(tall, 60).collect()}
    assert set(got) == {(f"f{a}", f"f{b}") for a in range(5) for b in range(a + 1, 5)}
    for (a, b), (cells, corr) in got.items():
        each = [plain(x[d][:, int(a[1])], x[d][:, int(b[1])]) for d in days]
        assert cells == sum(n for n, _ in each)
        known = [r for _, r in each if not np.isnan(r)]
        want = 0.0 if cells < 60 else np.mean(known) if known else None
        assert corr == (pytest.approx(want) if want is not None else None)
    plan = research.pair_correlations(tall)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
