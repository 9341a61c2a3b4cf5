"""Ordered operators against brute force, with one key holding a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydroq.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 12, 3000))
    frame = pd.DataFrame({"k": key, "v": np.round(rng.normal(0, 50, 3000), 1), "t": rng.permutation(3000)})
    frame.loc[rng.random(3000) < 0.05, "v"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return frame, rows.cache()


def test_quantiles_are_the_interpolated_ones(skewed):
    frame, rows = skewed
    got = ordered.quantiles(rows, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.973}).toPandas().set_index("k").sort_index()
    want = frame.groupby("k").v.quantile([0.1, 0.5, 0.973]).unstack()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_distribution_positions(skewed):
    frame, rows = skewed
    got = ordered.distribution(rows, ["k"], "v").toPandas()
    for k, group in got.groupby("k"):
        values = np.sort(frame[frame.k == k].v.dropna().to_numpy())
        group = group.sort_values("v")
        assert (np.searchsorted(values, group.v) == group.before).all()
        assert (group["rank"] == np.arange(len(group))).all()
        assert (group.total == len(values)).all() and (group.distinct == len(group)).all()


def test_previous_row_crosses_blocks(skewed):
    frame, rows = skewed
    got = ordered.with_previous(rows, ["k"], "t", {"t": "p"}, F.floor(F.col("t") / 100)).toPandas()
    for _, group in got.groupby("k"):
        group = group.sort_values("t")
        want = group.t.shift()
        assert group.p.isna().iloc[0] and (group.p.iloc[1:] == want.iloc[1:]).all()


def test_previous_row_of_widened_rows(spark):
    """Last rows taken from the narrow rows: the first of a block may lack its place, a null value is carried, a key may be null."""
    cells = [("a" if i % 7 else None, i // 10, None if i % 10 == 0 else i, None if i % 10 == 9 else float(i)) for i in range(60)] + [("b", b, None, float(b)) for b in range(3)]
    rows = spark.createDataFrame(cells, "k string, b int, t int, v double")
    wide = rows.withColumn("more", F.concat("k", F.lit("!")))
    got = ordered.with_previous(wide, ["k"], "t", {"v": "p"}, F.col("b"), rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, ordered.with_previous(wide, ["k"], "t", {"v": "p"}, F.col("b")).collect()))
    assert got.columns == [*wide.columns, "p"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_global_previous_and_running_totals(spark):
    rows = spark.range(50).select(F.col("id").alias("t"), F.lit(2).alias("x"))
    got = ordered.running_totals(rows, [], "t", {"x": "sofar"}, F.floor(F.col("t") / 7)).toPandas().sort_values("t")
    assert (got.sofar == 2 * got.t).all() and (got.sofar_all == 100).all()


def _pair_sum(x):
    return int(np.triu(np.sign(x[None, :] - x[:, None]), 1).sum())


def test_pair_sums_of_short_and_long_series(skewed):
    frame, rows = skewed
    got = ordered.pair_sign_sum(rows.where("v is not null"), ["k"], "t", "v", F.floor(F.col("t") / 100)).toPandas().set_index("k")
    tiny = ordered.pair_sign_sum(rows.where("v is not null and t < 120"), ["k"], "t", "v", F.floor(F.col("t") / 100)).toPandas().set_index("k")
    for k in got.index:
        assert got.s[k] == _pair_sum(frame[(frame.k == k)].dropna().sort_values("t").v.to_numpy())
    for k in tiny.index:
        assert tiny.s[k] == _pair_sum(frame[(frame.k == k) & (frame.t < 120)].dropna().sort_values("t").v.to_numpy())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), min_size=2, max_size=90))
def test_pair_sum_without_pairs(spark, values):
    rows = spark.createDataFrame([(1, i, float(v), len(values)) for i, v in enumerate(values)], "k int, p bigint, v double, n bigint")
    got = ordered.long_pair_sign_sum(rows, ["k"], "p", "v").collect()
    assert got[0]["s"] == _pair_sum(np.array(values, dtype=float)) and got[0]["n"] == len(values)


@pytest.mark.parametrize("size", [16, 150])
def test_pair_sums_of_series_cut_into_stretches_and_ranges(skewed, size):
    """Values with many ties, one of them in a third of the rows: more than a range holds."""
    frame, rows = skewed
    frame = frame.assign(v=np.where(frame.t % 3 == 0, 7.0, np.round(frame.v, -1))).dropna()
    rows = rows.sparkSession.createDataFrame(frame)
    got = ordered.pair_sign_sum(rows, ["k"], "t", "v", F.floor(F.col("t") / 100), size=size).toPandas().set_index("k")
    whole = ordered.pair_sign_sum(rows, [], "t", "v", F.floor(F.col("t") / 100), size=size).collect()
    for k, group in frame.groupby("k"):
        assert (got.n[k], got.s[k]) == (len(group), _pair_sum(group.sort_values("t").v.to_numpy()))
    assert [tuple(r) for r in whole] == [(len(frame), _pair_sum(frame.sort_values("t").v.to_numpy()))]


def test_long_series_are_not_written_once_a_level(spark, monkeypatch):
    """What leaves the fact rows is one row per distinct value and stretch, whatever the number of levels."""
    cells = []
    monkeypatch.setattr(ordered, "long_pair_sign_sum", lambda df, *a, f=ordered.long_pair_sign_sum, **b: (cells.append(df.count()), f(df, *a, **b))[1])
    n = 4000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.expr("(id * 7919) % 4001 * 1.0").cast("double").alias("v"))
    (got,) = ordered.pair_sign_sum(rows, ["k"], "t", "v", F.floor(F.col("t") / 100), size=500).collect()
    x = np.arange(n) * 7919 % 4001
    assert (got.n, got.s) == (n, _pair_sum(x)) and cells and max(cells) <= (n // 500) ** 2


def test_value_blocks_keep_order(spark):
    rows = spark.createDataFrame([(v,) for v in [float("-inf"), -1e300, -2.0, -0.0, 0.0, 1e-9, 3.5, 1e300, float("inf")]], "v double")
    blocks = [r[0] for r in rows.select(ordered.value_block("v")).collect()]
    assert blocks == sorted(blocks)


def test_first_value_and_first_row_differ_on_nulls(make):
    rows = make([
        {"StationNumber": "A", "Station": None},
        {"StationNumber": "A", "Station": "x"},
        {"StationNumber": "A", "Station": "y"},
        {"StationNumber": "B", "Station": "z"},
    ])
    def first(row):
        return {r[0]: r[1] for r in ordered.group_with_first(rows, ["StationNumber"], ["Station"], row=row).collect()}

    assert first(False) == {"A": "x", "B": "z"}
    assert first(True) == {"A": None, "B": "z"}
