"""Local regression, interpolation and autocorrelation against plain loops, with one series of a third of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroq.operators import ordered, smoothing


def series(seed=1):
    rng = random.Random(seed)
    rows = []
    for code, n in ((1, 120), (2, 1), (3, 2), (4, 40), (5, 30)):
        for _ in range(n):
            day = 1 if code == 5 else rng.randrange(1, 28)
            rows.append({"VmvCode": code, "MeasurementValueNum": None if rng.random() < 0.1 else 4.0 if code == 4 else rng.gauss(7, 1), "SampleDateTime": f"20{20 if code == 5 else rng.randrange(10, 22):02}-{1 if code == 5 else rng.randrange(1, 13):02}-{day:02} 00:00:00"})
    return rows


def in_order(rows):
    out = {}
    for key, r in enumerate(rows):
        if r["MeasurementValueNum"] is not None:
            out.setdefault(r["VmvCode"], []).append((np.datetime64(r["SampleDateTime"][:10]).astype(int), key, r["MeasurementValueNum"]))
    return {c: sorted(v) for c, v in out.items()}


@pytest.mark.parametrize("size", [4, 7, 4096])
def test_windows_reach_over_the_stretches(spark, size):
    rows = spark.createDataFrame([(k, i, i * i) for k, n in ((0, 50), (1, 1), (2, 9)) for i in range(n)], "k int, i int, v int").repartition(3)
    got = ordered.with_around(rows, ["k"], "i", ["v"], 3, 4, F.floor(F.col("i") / 10), size).collect()
    assert len(got) == 60
    for r in got:
        n = {0: 50, 1: 1, 2: 9}[r.k]
        assert [x.v for x in r.earlier] == [j * j for j in range(r.i - 1, max(-1, r.i - 4), -1)]
        assert [x.v for x in r.later] == [j * j for j in range(r.i + 1, min(n, r.i + 5))]


def test_loess(make):
    rows, k = series(), 5
    got = {r.row_key: r.smooth for r in smoothing.loess(make(rows), k=k).collect()}
    want = {}
    for own in in_order(rows).values():
        for i, (t, key, _) in enumerate(own):
            x, y = (np.array([p[c] for p in own[max(0, i - k):i + k + 1]], float) for c in (0, 2))
            x -= t
            far = np.abs(x).max() * 1.001
            g = (1 - (np.abs(x) / far) ** 3) ** 3 if far else np.ones(len(x))
            want[key] = np.polyfit(x, y, 1, w=np.sqrt(g))[1] if len(set(x)) > 1 else np.average(y, weights=g)
    assert got == pytest.approx(want, abs=1e-6)


def test_interpolation(make):
    months = {1: {0: 1.0, 1: 2.0, 4: 8.0, 5: 9.0, 6: 9.0}, 2: {0: 1.0, 9: 2.0}, 3: {3: 5.0}, 4: {0: 3.0, 1: 4.0}}
    rows = [{"VmvCode": c, "MeasurementValueNum": v + d, "SampleDateTime": f"2020-{m + 1:02}-1{int(d) + 1} 00:00:00"} for c, own in months.items() for m, v in own.items() for d in (-1.0, 1.0)]
    frame = make(rows + [{"VmvCode": 9, "MeasurementValueNum": None, "SampleDateTime": "2020-01-01 00:00:00"}])
    got = {(r.VmvCode, r.month - 2020 * 12): (r.v, r.filled) for r in smoothing.interpolate(frame, ["VmvCode"]).collect()}
    assert got == {(1, 0): (1.0, False), (1, 1): (2.0, False), (1, 2): (4.0, True), (1, 3): (6.0, True), (1, 4): (8.0, False), (1, 5): (9.0, False), (1, 6): (9.0, False), (4, 0): (3.0, False), (4, 1): (4.0, False)}
    report = {r.VmvCode: r.reason for r in smoothing.gap_report(smoothing.monthly_means(frame, ["VmvCode"]), ["VmvCode"]).collect()}
    assert report == {1: None, 2: "too many gaps", 3: "fewer than two months", 4: None}
    assert smoothing.interpolate(frame.limit(0)).count() == 0


def test_autocorrelation(make):
    rows = series(2)
    got = {r.VmvCode: r for r in smoothing.autocorrelation(make(rows), lags=4).collect()}
    for code, own in in_order(rows).items():
        z = np.array([v for _, _, v in own])
        z = z - z.mean()
        want = [float(z[:-k] @ z[k:] / (z @ z)) if len(z) > k and z @ z > 1e-12 else None for k in range(1, 5)]
        assert got[code].n == len(z)
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in zip(got[code].r, want))


def test_memory_widens_the_trend_test(make):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(0, 1, 200))
    rows = make([{"MeasurementValueNum": float(v), "SampleDateTime": f"20{10 + i // 12:02}-{i % 12 + 1:02}-01 00:00:00"} for i, v in enumerate(walk)])
    r = smoothing.corrected_mann_kendall(rows).first()
    assert r.inflation > 5 and abs(r.corrected_z) < abs(r.z) and r.effective_n == pytest.approx(200 / r.inflation)
    strong = [(k, x) for k, x in enumerate(smoothing.autocorrelation(rows).first().r, 1) if abs(x) > 1.96 / math.sqrt(200)]
    assert r.inflation == pytest.approx(1 + 2 * sum((1 - k / 200) * x for k, x in strong))
