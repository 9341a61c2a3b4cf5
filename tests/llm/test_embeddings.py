import math

import numpy as np

from hydroq.llm import embeddings
from test_simhash import brute_roots

SCHEMA = "vec_id long, embedding array<double>, label int"


def close_to(rng, v, cosine):
    w = rng.normal(size=len(v))
    w -= (w @ v) / (v @ v) * v
    v, w = v / np.linalg.norm(v), w / np.linalg.norm(w)
    return cosine * v + math.sqrt(1 - cosine * cosine) * w


def vectors(rng, d, n):
    base = rng.normal(size=(n, d))
    rows = list(base)
    for k in range(n // 2):
        rows += [close_to(rng, base[k], c) for c in (0.93, 0.955, 0.97, 0.999)]
    return rows


def check(spark, rows):
    got = {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], 0) for i, v in rows], SCHEMA).repartition(3)).collect()}
    fit = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for a in range(len(fit)):
        for b in range(a):
            (i, v), (j, w) = fit[a], fit[b]
            if len(v) == len(w) and (v / np.linalg.norm(v)) @ (w / np.linalg.norm(w)) >= 0.95:
                links.append((i, j))
    roots, degree = brute_roots(links), {}
    for i, j in links:
        degree[i], degree[j] = degree.get(i, 0) + 1, degree.get(j, 0) + 1
    assert got == {i: (degree.get(i, 0), roots.get(i, i), roots.get(i, i) == i) for i, _ in rows}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate(vectors(rng, 64, 60) + vectors(rng, 24, 20)))
    rows += [(1000 + k, rows[k % 5][1]) for k in range(20)]  # copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [math.nan] * 64), (2004, [math.inf] + [1.0] * 63), (2005, [None] + [1.0] * 63)]
    rows += [(2010, [3.0]), (2011, [5.0]), (2012, [-1.0]), (2013, list(7.5 * np.array(rows[0][1])))]
    check(spark, rows)


def test_a_large_group_is_cut(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=64)
    rows = [(k, close_to(rng, centre, 0.99)) for k in range(1300)] + [(5000 + k, rng.normal(size=64)) for k in range(50)]
    check(spark, rows)


def test_no_rows(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(1500, 64))
    b = np.stack([close_to(rng, v, 0.95) for v in a])
    for code in (2, 3):
        x, y = (embeddings.cells_of(embeddings.unit_rows(m), 8, code, 3) for m in (a, b))
        met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
        assert met.mean() >= 0.99
