"""Nearest stations by great-circle distance, and what is built on them: local outlier factors and spatial weights.

The globe is cut into square cells at ``LEVELS`` levels, each half as wide as the one before. A site takes some k
neighbours from the smallest cell that holds enough stations; the farthest of them bounds the search. A second pass looks at the
nine cells around the site at the finest level whose cells are wide enough for that bound, so the result is exact.
Cells are chosen by what they hold, so a dense cell is never searched as a whole: only finer ones are. Stations at one place are one site.
"""

from pyspark.sql import functions as F

from hydroq.functions.values import col
from hydroq.operators import ordered
from hydroq.sources.staging import stage

EARTH_KM = 6371.0088
LEVELS = 24
KEY, LAT, LON = "StationNumber", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees"


def distance_km(la, lo, la2, lo2):
    """Haversine distance of two places in degrees."""
    a, b = F.radians(la), F.radians(la2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lo2) - F.radians(lo)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _width(level):
    return F.lit(180.0) / F.pow(F.lit(2.0), level)


def _cell(level, la, lo):
    return F.floor((la + 90.0) / _width(level)).alias("cx"), F.pmod(F.floor((lo + 180.0) / _width(level)), F.pow(F.lit(2.0), level + 1).cast("long")).alias("cy")


def _reach(level, la):
    """No place outside of the nine cells around a place of latitude ``la`` is nearer than this, in km."""
    step = F.radians(_width(level))
    across = F.asin(F.cos(F.radians(la)) * F.sin(F.least(step, F.lit(1.5707963267948966))))
    return F.when(level == 0, float("inf")).otherwise(EARTH_KM * F.least(step, across) * (1 - 1e-9))


def _best(candidates, k):
    """The k+1 nearest (distance, id) of each site as a sorted array; the site itself is among them."""
    top = ordered.top_k(candidates, ["la", "lo"], ["d", "other"], k + 1)
    return top.groupBy("la", "lo").agg(F.sort_array(F.collect_list(F.struct("d", "other"))).alias("near"))


def nearest_stations(points, k=8, radius_km=None, key=KEY):
    """(key, neighbour, rank, distance_km): the ``k`` nearest other stations of each, nearest first, equal distances by key.

    With ``radius_km`` only those within it. points: one row for each station; rows without key or coordinates are left out. Distances
    count as equal when they agree to a millionth of a km. Of the stations at one place, the first k + 1 by key can be neighbours of another.
    """
    own = points.select(col(key).alias("id"), col(LAT).cast("double").alias("la"), col(LON).cast("double").alias("lo")).dropna()
    own = own.withColumns({"la": F.col("la") + 0.0, "lo": F.col("lo") + 0.0})
    few = ordered.top_k(own, ["la", "lo"], ["id"], k + 1)
    sites = stage(few.groupBy("la", "lo").agg(F.sort_array(F.collect_list("id")).alias("ids")), "sites")
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    leveled = sites.select("la", "lo", "ids", levels)
    leveled = leveled.select("la", "lo", "ids", "level", *_cell(F.col("level"), F.col("la"), F.col("lo")))
    held = leveled.groupBy("level", "cx", "cy").agg(F.sum(F.size("ids")).alias("held")).where((F.col("held") > k) | (F.col("level") == 0))
    start = leveled.join(held, ["level", "cx", "cy"]).groupBy("la", "lo").agg(F.max("level").alias("level"))
    cell = ["level", "cx", "cy"]
    asked = start.select("la", "lo", "level", *_cell(F.col("level"), F.col("la"), F.col("lo")))
    places = leveled.select("level", "cx", "cy", F.col("la").alias("la2"), F.col("lo").alias("lo2"), F.col("ids").alias("others"))

    def candidates(searched):
        met = searched.join(places, cell).withColumn("d", F.round(distance_km(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2")), 6))
        return met.select("la", "lo", "d", F.explode("others").alias("other"))

    bound = _best(candidates(asked), k).select("la", "lo", F.element_at("near", -1)["d"].alias("bound"), (F.size("near") > k).alias("full"))
    level = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda j: (j == 0) | (_reach(j, F.col("la")) > F.col("bound") + 1e-6)))
    around = bound.select("la", "lo", F.when(F.col("full"), level).otherwise(0).alias("level"))
    around = around.select("la", "lo", "level", *_cell(F.col("level"), F.col("la"), F.col("lo")))
    columns = F.pow(F.lit(2.0), F.col("level") + 1).cast("long")
    steps = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct((F.col("cx") + i).alias("cx"), F.pmod(F.col("cy") + j, columns).alias("cy"))))))
    around = around.select("la", "lo", "level", F.explode(steps).alias("c")).select("la", "lo", "level", "c.cx", "c.cy")
    near = stage(_best(candidates(around), k), "near-sites")
    # all stations of a site share its list; each leaves itself out
    found = own.join(near, ["la", "lo"]).withColumn("near", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k))
    out = found.select(F.col("id").alias(key), F.posexplode("near").alias("i", "x")).select(key, F.col("x.other").alias("neighbour"), (F.col("i") + 1).alias("rank"), F.col("x.d").alias("distance_km"))
    return out if radius_km is None else out.where(F.col("distance_km") <= radius_km)


def local_outlier_factor(neighbours, key=KEY):
    """(key, k_distance, reachability_density, lof) from a table (key, neighbour, distance_km): three rounds of keyed sums.

    A station's neighbours are those the table lists, ties settled by it. Stations at one place have a density of 1e10 at most.
    """
    edges = neighbours.select(F.col(key).alias("a"), F.col("neighbour").alias("b"), F.col("distance_km").alias("d"))
    reach = edges.groupBy("a").agg(F.max("d").alias("k_distance"))
    far = reach.select(F.col("a").alias("b"), F.col("k_distance").alias("r"))
    density = edges.join(far, "b").groupBy("a").agg((1.0 / (F.avg(F.greatest("r", "d")) + 1e-10)).alias("density"))
    density = stage(reach.join(density, "a"), "density")
    around = edges.join(density.select(F.col("a").alias("b"), F.col("density").alias("m")), "b").groupBy("a").agg(F.avg("m").alias("m"))
    return density.join(around, "a").select(F.col("a").alias(key), "k_distance", F.col("density").alias("reachability_density"), (F.col("m") / F.col("density")).alias("lof"))


def _by_hash(rows, keys, seed):
    """0-based places of the rows (id, ...) in the order of the MD5 of id and seed, within each of ``keys``."""
    digest = F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), seed.cast("string")).cast("binary"))
    hashed = rows.withColumn("digest", digest).withColumn("order", F.struct("digest", "id"))
    return ordered.with_position(hashed, keys, "order", F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")).drop("digest", "order")


def _fields(points, value, key, permutations):
    """(seed, id, z): the centred values where they belong (seed 0), and dealt out anew by a hash order for each further seed."""
    mean = points.agg(F.avg(value)).scalar()
    own = points.select(col(key).alias("id"), (col(value) - mean).alias("z")).dropna()
    base = stage(_by_hash(own, [], F.lit(0)), "values")
    seeds = base.select("id", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("seed"))
    dealt = _by_hash(seeds, ["seed"], F.col("seed")).select("seed", "id", "position").join(base.select("position", "z"), "position")
    return stage(base.select(F.lit(0).alias("seed"), "id", "z").union(dealt.select("seed", "id", "z")), "fields")


def _lags(points, neighbours, value, key, permutations):
    """(seed, id, z, lag): each field with the mean of the neighbours' values; stations without neighbours are left out."""
    fields = _fields(points, value, key, permutations)
    edges = neighbours.select(F.col(key).alias("id"), F.col("neighbour").alias("other"))
    lag = edges.join(fields.select("seed", F.col("id").alias("other"), F.col("z").alias("w")), "other").groupBy("seed", "id").agg(F.avg("w").alias("lag"))
    return fields.join(lag, ["seed", "id"])


def _rounded(c):
    """The order of addition must not decide whether a permutation reaches the value observed."""
    return F.round(c, 9)


def morans_i_permuted(points, neighbours, value, permutations=99, key=KEY):
    """Moran's I under row-standardised weights with its expectation, the mean and deviation over permutations, and a two-sided p value.

    neighbours: (key, neighbour). p is (1 + permutations whose I lies as far from the expectation or farther) / (1 + permutations).
    Stations without neighbours count for the mean and the variance, not for the links.
    """
    lags = _lags(points, neighbours, value, key, permutations)
    n, square = points.agg(F.count(value)).scalar(), _fields_square(points, value)
    per = lags.groupBy("seed").agg(F.sum(F.col("z") * F.col("lag")).alias("cross"), F.count(F.lit(1)).alias("rows"))
    per = per.withColumn("i", F.try_divide(n * F.col("cross"), F.col("rows") * square))
    seen = stage(per, "moran")
    found, expected = seen.where("seed = 0").select("i").scalar(), -1.0 / (n - 1)
    dealt = F.col("seed") > 0
    off = dealt & (_rounded(F.abs(F.col("i") - expected)) >= _rounded(F.abs(found - expected)))
    own = F.when(dealt, F.col("i"))
    p = (1.0 + F.count_if(off)) / (1.0 + permutations)
    out = seen.agg(F.max("rows").alias("stations"), F.max(F.when(~dealt, F.col("i"))).alias("morans_i"), F.avg(own).alias("mean_i"), F.stddev_samp(own).alias("sd_i"), p.alias("p"))
    return out.select("stations", "morans_i", expected.alias("expected"), "mean_i", "sd_i", "p")


def _fields_square(points, value):
    return points.agg(F.var_pop(value) * F.count(value)).scalar()


def local_morans_permuted(points, neighbours, value, permutations=99, alpha=0.05, key=KEY):
    """(key, local_i, p, cluster) per station: its value against the mean of its neighbours, under the same permutations.

    p is (1 + permutations whose product of the station's own value and the neighbours' mean is as large in size or larger) / (1 +
    permutations); neighbours' values are drawn without replacement from all stations. cluster: the quadrant where p <= alpha.
    """
    lags = _lags(points, neighbours, value, key, permutations)
    n, square = points.agg(F.count(value)).scalar(), _fields_square(points, value)
    own = stage(lags.where("seed = 0").select("id", F.col("z").alias("own"), F.col("lag").alias("own_lag")), "observed")
    met = lags.where("seed > 0").select("id", "lag").join(own, "id")
    as_far = _rounded(F.abs(F.col("own") * F.col("lag"))) >= _rounded(F.abs(F.col("own") * F.col("own_lag")))
    p = met.groupBy("id", "own", "own_lag").agg(((1.0 + F.count_if(as_far)) / (1.0 + permutations)).alias("p"))
    z, lag = F.col("own"), F.col("own_lag")
    cluster = F.when(F.col("p") > alpha, "none").when((z >= 0) & (lag >= 0), "high-high").when((z < 0) & (lag < 0), "low-low").when(z >= 0, "high-low").otherwise("low-high")
    return p.select(F.col("id").alias(key), F.try_divide(z * lag * n, square).alias("local_i"), "p", cluster.alias("cluster"))
