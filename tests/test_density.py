"""The density surface against a plain sum over all rows and offsets."""

import math
import random

import pytest

from hydroq.operators import spatial


def by_hand(rows, size, reach, sigma):
    bell = lambda d: math.exp(-d * d / (2 * sigma * sigma))
    total = sum(bell(d) for d in range(-reach, reach + 1))
    out = {}
    for key, lat, lon, w in rows:
        if None in (lat, lon, w):
            continue
        for i in range(-reach, reach + 1):
            for j in range(-reach, reach + 1):
                cell = (key, math.floor(lat / size) + i, math.floor(lon / size) + j)
                out[cell] = out.get(cell, 0.0) + w * bell(i) * bell(j) / total ** 2
    return out


@pytest.mark.parametrize("size, reach, sigma", [(0.25, 3, 1.5), (1.0, 0, 1.0), (0.5, 2, 4.0)])
def test_equals_plain_sums(spark, size, reach, sigma):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.uniform(-3, 3), rng.uniform(-3, 3), rng.random()) for _ in range(150)]
    rows += [("a", 1.0, 1.0, 2.0)] * 80  # a third of all rows in one cell
    rows += [("a", None, 1.0, 1.0), ("a", 1.0, None, 1.0), ("b", 2.0, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, LatitudeDecimalDegrees double, LongitudeDecimalDegrees double, w double")
    got = {(r.k, r.cell_row, r.cell_col): r for r in spatial.density_surface(df, ["k"], "w", size, reach, sigma, tile=8).collect()}
    want = by_hand(rows, size, reach, sigma)
    assert set(got) == set(want)
    assert all(abs(got[c].density - want[c]) < 1e-9 for c in want)
    assert all((r.tile_row, r.tile_col) == (r.cell_row // 8, r.cell_col // 8) for r in got.values())
    assert abs(sum(r.density for r in got.values()) - sum(w for _, a, b, w in rows if None not in (a, b, w))) < 1e-9


def test_counts_and_no_rows(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.2, 0.2), (None, 0.1)], "LatitudeDecimalDegrees double, LongitudeDecimalDegrees double")
    out = spatial.density_surface(df, reach=1).collect()
    assert len(out) == 9 and abs(sum(r.density for r in out) - 2) < 1e-12
    assert spatial.density_surface(df.limit(0)).count() == 0
