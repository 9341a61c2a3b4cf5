"""Statistics against closed forms, published values and brute force."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from hydroq.functions import tails
from hydroq.operators import spatial, stats


def test_tail_probabilities():
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(11.07049769, 5) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(7.0, 2) == pytest.approx(math.exp(-3.5), abs=1e-12)
    assert tails.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert tails.log_normal_cdf(-40.0) == pytest.approx(-804.6084420, abs=1e-5)
    assert tails.kolmogorov_upper(1.0, 10**6) == 0.0
    # the classic 5 % point of the limit distribution
    assert tails.kolmogorov_upper(1.3581 / 1e4, 10**8) == pytest.approx(0.05, abs=2e-3)
    assert tails.gamma_lower(1.0, 2.0) == pytest.approx(1 - math.exp(-2.0), abs=1e-12)


def test_gamma_shape_recovers_parameter():
    k = 3.7
    gap = math.log(k) - (math.lgamma(k + 1e-5) - math.lgamma(k - 1e-5)) / 2e-5
    assert tails.gamma_shape(gap) == pytest.approx(k, rel=1e-4)


def _values(make, xs, code=1):
    return make([{"VmvCode": code, "MeasurementValueNum": float(x), "SampleDateTime": f"2020-01-01 00:{i // 60:02d}:{i % 60:02d}"} for i, x in enumerate(xs)])


def test_ks_and_anderson_against_direct_formulas(make):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(10, 3, 400), 1)
    rows = _values(make, x)
    z = (np.sort(x) - x.mean()) / x.std(ddof=1)
    cdf = np.array([tails.normal_cdf(v) for v in z])
    n, i = len(x), np.arange(1, len(x) + 1)
    ks = max((i / n - cdf).max(), (cdf - (i - 1) / n).max())
    got = stats.kolmogorov_smirnov(rows).collect()[0]
    assert got["statistic"] == pytest.approx(ks, abs=1e-9) and got["normal"]
    a2 = -n - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1])))
    got = stats.anderson_darling(rows).collect()[0]
    assert got["statistic"] == pytest.approx(a2, abs=1e-7)
    assert got["critical_5pct"] == pytest.approx(0.787 / (1 + 4 / n - 25 / n**2), abs=1e-3)


@pytest.mark.parametrize("name,draw", [
    ("normal", lambda r: r.normal(500, 5, 900)),
    ("exponential", lambda r: 2 + r.exponential(3, 900)),
    ("lognormal", lambda r: r.lognormal(1, 1.2, 900)),
    ("weibull", lambda r: 10 * r.weibull(8, 900)),
])
def test_distribution_fit_finds_the_source(make, name, draw):
    rows = _values(make, draw(np.random.default_rng(11)))
    got = stats.identify_distribution(rows).collect()[0]
    assert got["best_fit"] == name or got[f"ks_{name}"] < 0.04


def test_distribution_fit_needs_ten_numbers(make):
    assert stats.identify_distribution(_values(make, range(9))).count() == 0


def test_mann_kendall_sign_and_compat(make):
    rising = _values(make, range(10), 1).unionByName(_values(make, range(10, 0, -1), 2))
    got = {r["VmvCode"]: r for r in stats.with_trend_verdict(stats.mann_kendall(rising, ["VmvCode"])).collect()}
    assert got[1]["s"] == 45 and got[1]["trend"] == "increasing"
    assert got[2]["s"] == -45 and got[2]["trend"] == "decreasing"
    assert got[1]["z"] == pytest.approx(44 / math.sqrt(125))
    flipped = {r["VmvCode"]: r["s"] for r in stats.mann_kendall(rising, ["VmvCode"], compat=True).collect()}
    assert flipped == {1: -45, 2: 45}


def test_tau_is_one_for_a_rising_series(make):
    assert stats.kendall_tau(_values(make, range(8)), ["VmvCode"]).collect()[0]["tau"] == pytest.approx(1.0)


def test_verdict_needs_three_numbers(make):
    got = stats.normality_verdict(_values(make, [1, 2])).collect()[0]
    assert got["error"] == "Insufficient data" and got["skewness"] is None


def test_false_discovery_rate(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.9, 0.03]
    rows = spark.createDataFrame([(p,) for p in ps], "p_value double")
    got = {r["p_value"]: (r["bonferroni"], r["fdr"]) for r in stats.adjust_p_values(rows).collect()}
    order = sorted(ps)
    step = [min(1.0, p * len(ps) / (i + 1)) for i, p in enumerate(order)]
    for i, p in enumerate(order):
        assert got[p][1] == pytest.approx(min(step[i:]))
        assert got[p][0] == pytest.approx(min(1.0, p * 6))


def test_cross_correlation_matches_pandas(make):
    rng = np.random.default_rng(2)
    rows = [
        {"SampleNumber": f"s{i}", "VmvCode": c, "MeasurementValueNum": float(rng.normal() + i * (c == 1))}
        for i in range(40) for c in (1, 2, 3) if rng.random() < 0.8
    ]
    df = make(rows)
    wide = df.toPandas().pivot_table(index="SampleNumber", columns="VmvCode", values="MeasurementValueNum")
    for r in stats.cross_correlation(df, "SampleNumber", "VmvCode", [1, 2, 3]).collect():
        both = wide[[int(r["a"]), int(r["b"])]].dropna()
        assert r["pairs"] == len(both) and r["r"] == pytest.approx(both.corr().iloc[0, 1])


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(9)
    pts = [(f"s{i}", float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(rng.uniform(50, 55, 80), rng.uniform(-115, -110, 80), rng.normal(size=80)))]
    rows = spark.createDataFrame(pts, "StationNumber string, LatitudeDecimalDegrees double, LongitudeDecimalDegrees double, q double")
    got = {r["StationNumber"]: r for r in spatial.neighbour_lag(rows, "q", 1.0).collect()}
    for name, a, b, _ in pts:
        near = [v for m, x, y, v in pts if m != name and abs(math.floor(x) - math.floor(a)) <= 1 and abs(math.floor(y) - math.floor(b)) <= 1]
        assert got[name]["neighbours"] == len(near) and got[name]["neighbour_sum"] == pytest.approx(sum(near), abs=1e-9)


def test_constant_column_has_no_scores(make):
    from hydroq.operators import profile

    rows = _values(make, [7] * 20)
    s = profile.numeric_summary(rows, ["MeasurementValueNum"]).collect()[0]
    assert s["skewness"] is None and s["std"] == 0.0 and s["median"] == 7.0
    assert profile.outlier_counts(rows, ["VmvCode"], method="zscore").collect()[0]["outlier_count"] == 0
    kinds = {r["pattern"] for r in profile.suspicion_patterns(rows, ["MeasurementValueNum", "LatitudeDecimalDegrees"]).collect()}
    assert kinds == {"all_identical_value", "all_missing"}


def _shapiro(values):
    """W by its definition over a sorted sample."""
    x = np.sort(np.array(values, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    a, u, mm = m.copy(), 1 / math.sqrt(n), m @ m
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        a[-1] = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
        k = 2 if n > 5 else 1
        if n > 5:
            a[-2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
        a[k:-k] = m[k:-k] / math.sqrt((mm - 2 * (m[-k:] ** 2).sum()) / (1 - 2 * (a[-k:] ** 2).sum()))
        a[:k] = -a[-k:][::-1]
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def test_shapiro_by_ranks(spark):
    rng = np.random.default_rng(3)
    groups = {1: [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 2: list(rng.normal(1e4, 1, 200)), 3: [1.0, 2.5, 9.0], 4: [1, 2, 2, 7], 5: [3, 1, 1, 1, 2], 6: list(rng.integers(0, 5, 300)), 7: list(rng.normal(0, 1, 6000)), 8: [2, 2, 2], 9: [1, 2], 10: [5, 4, 4, 3, 1, 9]}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "VmvCode int, MeasurementValueNum double")
    got = {r.VmvCode: r for r in stats.shapiro(rows).collect()}
    assert {k: r.sample_size for k, r in got.items()} == {k: len(v) for k, v in groups.items()}
    for k, xs in groups.items():
        if k in (8, 9):
            assert got[k].statistic is None and got[k].p_value is None
        else:
            assert got[k].statistic == pytest.approx(_shapiro(xs), rel=1e-6)
    # the worked example of the test's authors
    assert got[1].statistic == pytest.approx(0.79, abs=0.005) and got[1].p_value == pytest.approx(0.0067, abs=0.002)
    assert got[2].normal and got[7].statistic > 0.99 and got[7].p_value is None


def test_studentised_range():
    for q, df in [(0.3, 1), (2.0, 4), (3.5, 30), (4.0, 10**6)]:
        # two means: the range is the root of two times a t value
        assert tails.studentised_range_upper(q, 2, df) == pytest.approx(tails.t_two_sided(q / math.sqrt(2), df), abs=1e-9)
    # the classic 5 % points
    for q, groups, df in [(3.877, 3, 10), (4.232, 5, 20), (3.314, 3, 10**7), (4.474, 10, 10**7)]:
        assert tails.studentised_range_upper(q, groups, df) == pytest.approx(0.05, abs=1e-4)
    assert tails.studentised_range_upper(0.0, 4, 9) == pytest.approx(1.0)
    assert tails.studentised_range_upper(200.0, 4, 90) == pytest.approx(0.0, abs=1e-12)


def test_tukey_pairs(spark):
    """Pairs of three groups of unequal size by hand; a constant key has no p, a key of one group no row."""
    values = {("a", 1): [4.0, 6.0, 5.0, 7.0], ("a", 2): [9.0, 8.0, 10.0], ("a", 3): [5.5, 6.5, 6.0, 5.0, 7.5], ("b", 1): [2.0, 2.0], ("b", 2): [2.0], ("c", 1): [1.0, 3.0]}
    rows = [(k, g, v) for (k, g), vs in values.items() for v in vs] + [("a", None, 50.0), ("a", 1, None)]
    frame = spark.createDataFrame(rows, "k string, g int, v double").repartition(3)
    got = {(r.k, r.first, r.second): r for r in stats.tukey_hsd(frame, "g", ["k"], "v").collect()}
    assert sorted(got) == [("a", 1, 2), ("a", 1, 3), ("a", 2, 3), ("b", 1, 2)]
    assert got["b", 1, 2].q is None and got["b", 1, 2].p_value is None
    within = sum(np.var(values["a", g]) * len(values["a", g]) for g in (1, 2, 3))
    for i, j in [(1, 2), (1, 3), (2, 3)]:
        x, y, r = values["a", i], values["a", j], got["a", i, j]
        assert r.difference == pytest.approx(np.mean(y) - np.mean(x)) and r.groups == 3 and r.df == 9
        q = abs(r.difference) / math.sqrt(within / 9 / 2 * (1 / len(x) + 1 / len(y)))
        assert r.q == pytest.approx(q) and r.p_value == pytest.approx(tails.studentised_range_upper(q, 3, 9))
    # simulated ranges of the same shape agree
    rng = np.random.default_rng(5)
    draws = rng.standard_normal((200_000, 3))
    ranges = (draws.max(1) - draws.min(1)) / np.sqrt(rng.chisquare(9, 200_000) / 9)
    assert got["a", 1, 2].p_value == pytest.approx((ranges > got["a", 1, 2].q).mean(), abs=3e-3)
    assert stats.tukey_hsd(frame.limit(0), "g", ["k"], "v").count() == 0 and stats.tukey_hsd(frame.limit(0), "g", (), "v").count() == 0
