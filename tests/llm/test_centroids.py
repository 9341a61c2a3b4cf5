import hashlib
import math

import numpy as np
import pytest

from hydroq.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def brute(rows, k, rounds, size, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centre = [v for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(centre)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centre)):
            own = [v for (_, v), (_, at) in zip(kept, found) if at == j]
            if own:
                centre[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    held = {}
    for d, j in found:
        held[j] = held.get(j, 0) + d
    return sorted((repr(i), j, d, held[j], sum(held.values()), hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found))


def check(spark, rows, k, rounds, size, pivots=4):
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA).repartition(3)
    got = c.cluster(frame, k, rounds, size=size, pivots=pivots)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((repr(r.vec_id), *r[1:]) for r in got.collect()) == brute(rows, k, rounds, size)


@pytest.mark.parametrize("k,size,pivots", [(1, 3, 4), (5, 3, 8), (12, 16, 6), (12, 16, 1)])
def test_equals_brute_force(spark, k, size, pivots):
    rng = np.random.default_rng(k + size)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, size)))]
    check(spark, rows, k, 4, size, pivots)


def test_nulls_other_lengths_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (60, 4)) / 256)]  # many ties and equal vectors
    rows += [(5, [0.0] * 4), (5, [1.0] * 4), (None, [0.5] * 4), (None, [0.5] * 4)] + rows[:20]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0]), (906, [None, 0.0, 0.0, 0.0])]
    check(spark, rows, 10, 5, 4)


def test_one_vector_a_third_of_all_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))] + [(1000 + i, [0.25] * 8) for i in range(100)]
    check(spark, rows, 6, 3, 8)


def test_fewer_rows_than_centroids_and_no_rows(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.0, 0.25])], 40, 5, 2)
    check(spark, [(4, None)], 40, 5, 2)
    assert c.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        c.cluster(spark.createDataFrame([(1, [1e9, 1.0], 0, "")], SCHEMA), size=2).count()


@pytest.mark.parametrize("spread", [3, 500, 1 << 26])
def test_bounds_enclose_the_distance(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (400, 24))
    points[:100] = points[:100] // 50 + points[0]  # close to a pivot
    simplex = c.Simplex(points[:40], 8)
    low, high, slack = c.bounds(simplex.apexes(points), simplex.apexes(points[:40]))
    exact = np.stack([c.squared(points, p) for p in points[:40]], 1)
    assert (low - slack <= exact).all() and (exact <= high + slack).all()
    number, least, compared = c.nearest(points, simplex.apexes(points), points[:40], simplex)
    assert (number == exact.argmin(1)).all() and (least == exact.min(1)).all()
    assert compared < exact.size


def test_clustered_vectors_are_compared_with_few_centroids():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 64)) * 500
    points = np.floor(np.repeat(centre, 50, 0) + rng.normal(size=(2000, 64)) * 10).astype(np.int64)
    simplex = c.Simplex(np.floor(centre), 8)
    _, _, compared = c.nearest(points, simplex.apexes(points), np.floor(centre).astype(np.int64), simplex)
    assert compared < 10 * len(points)
