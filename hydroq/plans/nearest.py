"""Queries over nearest stations: neighbours, outlier factors, spatial statistics with permutations."""

from hydroq.operators import nearest
from hydroq.plans.catalog import obs, query
from hydroq.plans.trend import _CLEAN, _points

_K, _SEEDS = 8, 99
_NEAR = f"""WITH s AS MATERIALIZED (
  SELECT StationNumber AS id, min(LatitudeDecimalDegrees) AS la, min(LongitudeDecimalDegrees) AS lo, {_CLEAN} AS q FROM obs GROUP BY 1
), pairs AS (
  SELECT a.id, b.id AS other, round(2 * {nearest.EARTH_KM} * asin(sqrt(least(1, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))), 6) AS d
  FROM s a JOIN s b ON a.id <> b.id
), near AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM pairs QUALIFY rank <= {_K}
)"""
_FIELDS = f""", z AS MATERIALIZED (
  SELECT id, q - avg(q) OVER () AS z, row_number() OVER (ORDER BY md5(id || ':0'), id) AS place FROM s
), fields AS MATERIALIZED (
  SELECT 0 AS seed, id, z FROM z
  UNION ALL SELECT seed, p.id, z.z FROM (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY md5(id || ':' || seed), id) AS place FROM z, range(1, {_SEEDS + 1}) r(seed)) p JOIN z ON z.place = p.place
), lags AS MATERIALIZED (
  SELECT f.seed, f.id, any_value(f.z) AS z, avg(w.z) AS lag FROM fields f JOIN near n ON n.id = f.id JOIN fields w ON w.seed = f.seed AND w.id = n.other GROUP BY f.seed, f.id
), whole AS (SELECT count(*) AS n, sum(z * z) AS square FROM z)"""


def _table(spark, sf):
    points = _points(spark, sf)
    return points, nearest.nearest_stations(points, _K)


@query("d12_nearest_stations", _NEAR + "SELECT id AS StationNumber, other AS neighbour, rank::INT AS rank, d AS distance_km FROM near", {"distance_km": 3})
def _(spark, sf):
    return _table(spark, sf)[1]


@query("d12_nearest_within", _NEAR + "SELECT id AS StationNumber, other AS neighbour, rank::INT AS rank, d AS distance_km FROM near WHERE d <= 2.5", {"distance_km": 3})
def _(spark, sf):
    return nearest.nearest_stations(_points(spark, sf), _K, radius_km=2.5)


@query(
    "d12_local_outlier_factor",
    _NEAR + """, far AS (SELECT id, max(d) AS r FROM near GROUP BY 1), dens AS (SELECT n.id, 1 / (avg(greatest(f.r, d)) + 1e-10) AS m FROM near n JOIN far f ON f.id = n.other GROUP BY 1)
    SELECT n.id AS StationNumber, any_value(f.r) AS k_distance, any_value(a.m) AS reachability_density, avg(b.m) / any_value(a.m) AS lof
    FROM near n JOIN dens b ON b.id = n.other JOIN dens a ON a.id = n.id JOIN far f ON f.id = n.id GROUP BY 1""",
    {"k_distance": 3, "reachability_density": 5, "lof": 5},
)
def _(spark, sf):
    return nearest.local_outlier_factor(_table(spark, sf)[1])


@query(
    "j21_morans_i_permuted",
    _NEAR + _FIELDS + f""", per AS (SELECT seed, n * sum(z * lag) / (count(*) * any_value(square)) AS i, count(*) AS stations, -1.0::DOUBLE / (any_value(n) - 1) AS e FROM lags, whole GROUP BY seed, n)
    SELECT o.stations, o.i AS morans_i, o.e AS expected, avg(p.i) AS mean_i, stddev_samp(p.i) AS sd_i, (1.0::DOUBLE + count(*) FILTER (round(abs(p.i - p.e), 9) >= round(abs(o.i - o.e), 9))) / {_SEEDS + 1} AS p
    FROM per o JOIN per p ON o.seed = 0 AND p.seed > 0 GROUP BY 1, 2, 3""",
    "morans_i expected mean_i sd_i p",
)
def _(spark, sf):
    points, table = _table(spark, sf)
    return nearest.morans_i_permuted(points, table, "quality", _SEEDS)


@query(
    "j21_local_morans_permuted",
    _NEAR + _FIELDS + f""", per AS (SELECT o.id, any_value(o.z) AS z, any_value(o.lag) AS lag, (1.0::DOUBLE + count(*) FILTER (round(abs(o.z * p.lag), 9) >= round(abs(o.z * o.lag), 9))) / {_SEEDS + 1} AS p
    FROM lags o JOIN lags p ON o.seed = 0 AND p.seed > 0 AND o.id = p.id GROUP BY 1)
    SELECT id AS StationNumber, z * lag * n / square AS local_i, p,
    CASE WHEN p > 0.05 THEN 'none' WHEN z >= 0 AND lag >= 0 THEN 'high-high' WHEN z < 0 AND lag < 0 THEN 'low-low' WHEN z >= 0 THEN 'high-low' ELSE 'low-high' END AS cluster FROM per, whole""",
    "local_i p",
)
def _(spark, sf):
    points, table = _table(spark, sf)
    return nearest.local_morans_permuted(points, table, "quality", _SEEDS)
