"""Nearest stations, outlier factors and permuted Moran statistics against all pairs."""

import hashlib
import math
import random

import pytest

from hydroq.operators import nearest

SCHEMA = "StationNumber string, LatitudeDecimalDegrees double, LongitudeDecimalDegrees double, q double"


def km(a, b):
    (la, lo), (la2, lo2) = [tuple(map(math.radians, x)) for x in (a, b)]
    h = math.sin((la2 - la) / 2) ** 2 + math.cos(la) * math.cos(la2) * math.sin((lo2 - lo) / 2) ** 2
    return 2 * nearest.EARTH_KM * math.asin(math.sqrt(min(1, h)))


def brute(rows, k):
    own = [r for r in rows if None not in r[:3]]
    out = {}
    for i, la, lo, _ in own:
        near = sorted((round(km((la, lo), (r[1], r[2])), 6), r[0]) for r in own if r[0] != i)[:k]
        out |= {(i, rank + 1): (other, d) for rank, (d, other) in enumerate(near)}
    return out


def check(spark, rows, k):
    got = {(r.StationNumber, r["rank"]): (r.neighbour, r.distance_km) for r in nearest.nearest_stations(spark.createDataFrame(rows, SCHEMA).repartition(3), k).collect()}
    want = brute(rows, k)
    assert got.keys() == want.keys()
    assert {x: v[1] for x, v in got.items()} == pytest.approx({x: v[1] for x, v in want.items()}, abs=2e-6)
    assert {x: v[0] for x, v in got.items()} == {x: v[0] for x, v in want.items()}


@pytest.mark.parametrize("k", [1, 3, 8])
def test_nearest_equal_all_pairs(spark, k):
    rng = random.Random(k)
    rows = [(f"W{i:03}", rng.uniform(-90, 90), rng.uniform(-180, 180), 0.0) for i in range(60)]
    rows += [(f"C{i:03}", 53 + rng.gauss(0, 0.01), -113 + rng.gauss(0, 0.01), 0.0) for i in range(80)]
    rows += [(f"E{i:03}", rng.uniform(-70, 70), rng.choice([-179.99, 179.99]), 0.0) for i in range(20)] + [("N1", 90.0, 0.0, 0.0), ("N2", 89.9, 180.0, 0.0), ("N3", 89.9, 0.0, 0.0), ("S", -90.0, 0.0, 0.0), ("L", 0.0, 180.0, 0.0), ("L2", 0.0, -180.0, 0.0)]
    check(spark, rows, k)


def test_one_place_a_third_of_all_stations(spark):
    rows = [(f"A{i:03}", 50.0, -110.0, 0.0) for i in range(60)] + [(f"B{i:03}", 50 + i / 97, -110 + i / 89, 0.0) for i in range(1, 120)]
    check(spark, rows, 4)


def test_few_stations_nulls_radius_and_no_rows(spark):
    rows = [("a", 1.0, 1.0, 0.0), ("b", 1.0, 1.5, 0.0), ("c", 2.0, None, 0.0), (None, 1.0, 1.0, 0.0)]
    check(spark, rows, 5)
    frame = spark.createDataFrame(rows + [("d", 1.0, 9.0, 0.0)], SCHEMA)
    assert {(r.StationNumber, r.neighbour) for r in nearest.nearest_stations(frame, 2, radius_km=100).collect()} == {("a", "b"), ("b", "a")}
    assert nearest.nearest_stations(frame.limit(0)).count() == 0


def test_local_outlier_factor(spark):
    rng = random.Random(4)
    rows = [(f"A{i:03}", 50 + rng.gauss(0, 0.05), -110 + rng.gauss(0, 0.05), 0.0) for i in range(60)] + [("far", 52.0, -110.0, 0.0), ("p1", 50.0, -110.0, 0.0), ("p2", 50.0, -110.0, 0.0)]
    near = brute(rows, 5)
    edges = {}
    for (a, _), (b, d) in near.items():
        edges.setdefault(a, []).append((b, d))
    reach = {a: max(d for _, d in e) for a, e in edges.items()}
    density = {a: 1 / (sum(max(d, reach[b]) for b, d in e) / len(e) + 1e-10) for a, e in edges.items()}
    want = {a: sum(density[b] for b, _ in e) / len(e) / density[a] for a, e in edges.items()}
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.StationNumber: r.lof for r in nearest.local_outlier_factor(nearest.nearest_stations(frame, 5)).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    assert max(got, key=got.get) == "far" and got["far"] > 10


def test_permuted_morans(spark):
    rng = random.Random(9)
    rows = [(f"A{i:03}", 50 + i // 8 / 10, -110 + i % 8 / 10, (i // 8) + rng.random()) for i in range(64)]
    near = {}
    for (a, _), (b, _) in brute(rows, 4).items():
        near.setdefault(a, []).append(b)
    mean = sum(r[3] for r in rows) / len(rows)
    z = {r[0]: r[3] - mean for r in rows}
    rank = lambda s: sorted(z, key=lambda i: (hashlib.md5(f"{i}:{s}".encode()).hexdigest(), i))
    base = rank(0)
    fields = [z] + [{i: z[base[p]] for p, i in enumerate(rank(s))} for s in range(1, 20)]
    square = sum(v * v for v in z.values())
    lags = [{i: sum(f[j] for j in near[i]) / 4 for i in f} for f in fields]
    moran = [sum(f[i] * lag[i] for i in f) / square for f, lag in zip(fields, lags)]
    e = -1 / 63
    frame = spark.createDataFrame(rows, SCHEMA)
    table = nearest.nearest_stations(frame, 4)
    got = nearest.morans_i_permuted(frame, table, "q", permutations=19).first()
    assert got.morans_i == pytest.approx(moran[0]) and got.expected == pytest.approx(e) and got.mean_i == pytest.approx(sum(moran[1:]) / 19)
    assert got.p == pytest.approx((1 + sum(abs(m - e) >= abs(moran[0] - e) for m in moran[1:])) / 20) and got.p == 0.05
    local = {r.StationNumber: r for r in nearest.local_morans_permuted(frame, table, "q", permutations=19).collect()}
    for i in z:
        assert local[i].local_i == pytest.approx(z[i] * lags[0][i] * 64 / square)
        assert local[i].p == pytest.approx((1 + sum(abs(z[i] * lag[i]) >= abs(z[i] * lags[0][i]) for lag in lags[1:])) / 20)
