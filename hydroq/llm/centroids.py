"""Centroid clustering of integer vectors, with n-simplex bounds that spare most exact distances.

A few pivots are chosen among the first centroids, one after the other the one farthest from the flat of those before it.
The pivots form the base of a simplex; a vector's distances to them, taken once and cached, fix the place of an apex
over that base. The Euclidean distance of two apexes is a lower bound of the distance of their vectors, and the distance to
the mirrored apex (last coordinate negated) an upper bound. In each round only centroids whose lower bound exceeds neither the
least upper bound nor the distance of the centroid of least lower bound are compared with a vector, in whole numbers.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import parts_of, stage

LARGEST = 1 << 27  # differences of such components, squared and added up, stay below 2^63
SLACK = 1e-5  # share of the squared distances to the first pivot that rounding may take from a bound
FLAT = 0.02  # pivots closer to the flat of the others than this share of the first edge are left out


class Simplex:
    """The base simplex of the pivots in its own coordinates: pivot k has k of them, the last one its height."""

    def __init__(self, points, pivots):
        points = np.asarray(points, np.int64)
        self.pivots, self.base = points[:1], np.zeros((1, 0))
        while len(self.pivots) < pivots:
            apex = self.apexes(points)
            height = apex[:, -1].copy()
            far = int(height.argmax())
            if height[far] <= (FLAT * self.base[1, 0] if len(self.base) > 1 else 0):
                break
            self.base = np.vstack([np.pad(self.base, ((0, 0), (0, 1))), apex[far]])
            self.pivots = np.vstack([self.pivots, points[far]])

    def squares(self, points):
        """Squared distances to the pivots, exact."""
        return np.stack([squared(points, p) for p in self.pivots], 1)

    def apexes(self, points):
        """One row of coordinates for each of ``points``: their place over the base, then the height above it."""
        square = self.squares(points).astype(np.float64)
        out = np.zeros((len(points), len(self.pivots)))
        for k in range(1, len(self.pivots)):
            own = self.base[k]
            along = (square[:, 0] - square[:, k] + own @ own) / 2 - out[:, :k - 1] @ own[:k - 1]
            out[:, k - 1] = along / own[k - 1]
        out[:, -1] = np.sqrt(np.maximum(0, square[:, 0] - (out[:, :-1] ** 2).sum(1)))
        return out


def squared(points, point):
    step = points - point
    return np.einsum("ij,ij->i", step, step)


def bounds(apex, other):
    """Squared lower and upper bounds of the distances between the rows of ``apex`` and of ``other``, and the slack of either."""
    flat = np.maximum(0, ((apex[:, None, :-1] - other[None, :, :-1]) ** 2).sum(2))
    low, high = (flat + (apex[:, None, -1] + sign * other[None, :, -1]) ** 2 for sign in (-1, 1))
    slack = SLACK * ((apex ** 2).sum(1)[:, None] + (other ** 2).sum(1)[None, :])
    return low, high, slack


def nearest(points, apex, centroids, simplex):
    """(number, squared distance) of the nearest centroid for each row, the smaller number at ties; and how many were compared."""
    low, high, slack = bounds(apex, simplex.apexes(centroids))
    guess = squared(points, centroids[low.argmin(1)]) if len(points) else np.empty(0)
    near = low - slack <= np.minimum((high + slack).min(1), guess)[:, None]
    row, number = np.nonzero(near)  # by row, then number
    distance = squared(points[row], centroids[number])
    starts = np.searchsorted(row, np.arange(len(points)))
    least = np.minimum.reduceat(distance, starts) if len(points) else np.empty(0, np.int64)
    best = np.flatnonzero(distance == least[row])
    first = best[np.unique(row[best], return_index=True)[1]]
    return number[first], least, len(row)


def whole_vectors(rows, size, scale, id_col="vec_id", vector_col="embedding"):
    """(vec_id, point: binary of 32-bit numbers) for the rows with exactly ``size`` components, none null or non-finite."""

    def run(batches):
        for batch in parts_of(batches):
            x = np.floor(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * scale)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component times {scale} lies beyond {LARGEST}: distances would not fit into 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary())], ["vec_id", "point"])

    own = fitting(rows, size, id_col, vector_col)
    return own.mapInArrow(run, "vec_id long, point binary")


def fitting(rows, size, id_col, vector_col):
    """(vec_id, vector: array of doubles) for the rows that are kept."""
    vector = F.col(vector_col).cast("array<double>")
    fit = (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))


def _matrix(column, kind, width):
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def cluster(rows, k=40, rounds=5, seed=2, scale=256, size=64, pivots=8, id_col="vec_id", vector_col="embedding"):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    Kept are vectors of ``size`` components, none null or non-finite; others give no row. Components become floor(scale * x).
    The first centroids are the ``k`` kept vectors of smallest sha256 of ``seed:vec_id`` (vectors without id come last, equal ids
    by their scaled components; fewer vectors, fewer centroids). Each round assigns every vector to the nearest centroid, the smaller number
    at ties, then moves every centroid that has vectors to the floor of their mean; one more assignment follows. Repeated rows
    count as often as they occur. Other columns stay out. A scaled component of 2^27 or more is an error. Empty table: no rows.

    The scaled vectors and their apexes are written once; a round reads them, adds up sums per centroid within each task, and
    k rows a task are shuffled. The driver holds the k centroids, as every task does.
    """
    spark = rows.sparkSession
    points = whole_vectors(rows, size, scale, id_col, vector_col)
    own = fitting(rows, size, id_col, vector_col).select("vec_id", F.transform("vector", lambda x: F.floor(x * scale)).alias("point"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = own.orderBy(F.asc_nulls_last(rank), "point").limit(k).collect()  # k rows
    if not chosen:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.point for r in chosen], np.int64)
    simplex = Simplex(centroids, pivots)
    width = len(simplex.pivots)

    def cache(batches):
        for batch in parts_of(batches):
            apex = simplex.apexes(_matrix(batch.column("point"), np.int32, size).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a.tobytes() for a in apex], pa.binary())], ["vec_id", "point", "apex"])

    cached = stage(points.mapInArrow(cache, "vec_id long, point binary, apex binary"), "apexes")

    def assigned(batch, centroids):
        own = _matrix(batch.column("point"), np.int32, size).astype(np.int64)
        return own, *nearest(own, _matrix(batch.column("apex"), np.float64, width), centroids, simplex)[:2]

    def sums_by(centroids):
        def run(batches):
            count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
            for batch in parts_of(batches):
                own, number, _ = assigned(batch, centroids)
                np.add.at(total, number, own)
                count += np.bincount(number, minlength=len(centroids))
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        return run

    for _ in range(rounds):
        parts = cached.mapInArrow(sums_by(centroids), "cluster long, n long, total array<long>")
        parts = parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
        sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        centroids = centroids.copy()
        for r in sums.collect():  # k * size rows
            centroids[r.cluster, r.place] = int(r.total) // int(r.n)

    def last(batches, centroids=centroids):
        for batch in parts_of(batches):
            _, number, distance = assigned(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stage(cached.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned")
    held = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    whole = sum(int(r.inertia) for r in held)
    digest = {r.cluster: hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest() for r in held}
    totals = spark.createDataFrame([(r.cluster, int(r.inertia), whole, digest[r.cluster]) for r in held], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k=40, rounds=5, seed=2, scale=256, size=64):
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
  SELECT row, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})
)"""]
    for t in range(rounds + 1):
        parts.append(f"""
, d{t} AS MATERIALIZED (
  SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT row, k, sum((x - y) * (x - y)) AS d FROM cells JOIN (SELECT k, generate_subscripts(v, 1) AS i, unnest(v) AS y FROM c{t}) USING (i) GROUP BY row, k
  ) GROUP BY row
)""")
        if t < rounds:
            parts.append(f"""
, c{t + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM cells JOIN d{t} USING (row) GROUP BY k, i) GROUP BY k
  ) m USING (k)
)""")
    parts.append(f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM d{rounds} JOIN kept USING (row) JOIN c{rounds} c USING (k)
""")
    return "".join(parts)


@query("op13_centroid_clustering", _oracle())
def op13(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))
