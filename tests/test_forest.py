"""Isolation forests against a plain forest over the same trees."""

import bisect
import hashlib

import numpy as np
import pytest

from hydroq.operators import forest


def plain(values, column, trees, sample, contamination):
    """values: (key, value); scores by walking every tree for every value."""
    order = [v for _, v in sorted((hashlib.md5(str(k).encode()).hexdigest(), v) for k, v in values)]
    pool = order[:trees * sample]
    size = min(sample, len(pool))
    paths = np.zeros(len(values))
    for tree in range(trees):
        drawn = sorted(pool[(tree * sample + i) % len(pool)] for i in range(size))
        leaves = sorted(forest.leaves_of(drawn, column, tree))
        ends = [left for left, _ in leaves]
        paths += [leaves[bisect.bisect_left(ends, v) - 1][1] for _, v in values]
    score = 2.0 ** (-np.round(paths / trees, 7) / forest._average(size))
    cut = np.quantile(score, 1 - contamination)
    return {v: (round(float(s), 6), bool(s > cut)) for (_, v), s in zip(values, score)}


@pytest.mark.parametrize("n,trees,sample", [(400, 20, 64), (3000, 10, 32), (40, 7, 256), (11, 3, 4)])
def test_equals_a_plain_forest(make, n, trees, sample):
    rng = np.random.default_rng(n)
    values = [(k, float(v)) for k, v in enumerate(np.round(rng.normal(7, 1, n), 2))]
    values[3] = (3, 40.0)
    rows = make([{"row_key": k, "MeasurementValueNum": v} for k, v in values] + [{"row_key": 10_000 + k, "MeasurementValueNum": None} for k in range(5)])
    got = forest.isolation_outliers(rows, ["MeasurementValueNum"], trees=trees, sample=sample).collect()
    assert {r.value: (round(r.score, 6), r.is_outlier) for r in got} == plain(values, "MeasurementValueNum", trees, sample, forest.CONTAMINATION)
    assert sum(r.n for r in got) == n
    assert n < 40 or {r.value: r.is_outlier for r in got}[40.0]


def test_one_value_a_third_of_all_rows_and_an_even_column(make):
    rng = np.random.default_rng(1)
    values = [(k, float(v)) for k, v in enumerate(np.r_[rng.normal(0, 1, 200), np.full(100, 0.5)])]
    rows = make([{"row_key": k, "MeasurementValueNum": v, "MethodDetectionLimit": 2.0} for k, v in values])
    got = forest.isolation_outliers(rows, ["MeasurementValueNum", "MethodDetectionLimit"], trees=10, sample=64).collect()
    want = plain(values, "MeasurementValueNum", 10, 64, forest.CONTAMINATION)
    assert {r.value: (round(r.score, 6), r.is_outlier) for r in got if r.column == "MeasurementValueNum"} == want
    assert [(r.value, r.n, r.is_outlier) for r in got if r.column == "MethodDetectionLimit"] == [(2.0, 300, False)]


def test_numbers_are_not_dealt_by_column(make):
    """A column may hold all rows: neither its numbers nor its scores may meet in one task."""
    rows = make([{"row_key": k, "MeasurementValueNum": k * 0.5} for k in range(50)])
    steps = forest.forest_steps(forest.numbers_of(rows, ["MeasurementValueNum"], "row_key"), trees=3, sample=8)
    found = forest.isolation_outliers(rows, ["MeasurementValueNum"], trees=3, sample=8).where("score is not null")
    for frame in (steps, found):
        assert "SortMergeJoin" not in frame._jdf.queryExecution().executedPlan().toString()


def test_few_numbers_fall_back_to_quartiles_and_no_rows(make):
    rows = make([{"row_key": k, "MeasurementValueNum": v} for k, v in enumerate([1.0, 1.1, 0.9, 1.0, 1.2, 1.05, 50.0, float("nan"), None])])
    got = {r.value: (r.n, r.score, r.is_outlier) for r in forest.isolation_outliers(rows, ["MeasurementValueNum"]).collect()}
    assert got == {1.0: (2, None, False), 1.1: (1, None, False), 0.9: (1, None, False), 1.2: (1, None, False), 1.05: (1, None, False), 50.0: (1, None, True)}
    assert forest.isolation_outliers(rows.limit(0), ["MeasurementValueNum"]).count() == 0


def test_leaves_cover_the_line():
    leaves = sorted(forest.leaves_of([1.0, 1.0, 2.0, 3.0, 100.0], "x", 0))
    assert leaves[0][0] == float("-inf") and all(a[0] < b[0] for a, b in zip(leaves, leaves[1:]))
    assert forest.leaves_of([5.0] * 9, "x", 0) == [(float("-inf"), forest._average(9))]
