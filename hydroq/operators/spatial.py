"""Spatial neighbourhoods and autocorrelation on a grid of cells.

Neighbours of a station are all other stations in its own cell and in the eight around it. Sums over
neighbours follow from cell totals, so no pair of stations is ever formed.
"""

import math

from pyspark.sql import functions as F

from hydroq.functions.values import col


def _cells(points, size):
    return points.withColumns({
        "_cx": F.floor(col("LatitudeDecimalDegrees") / size).cast("long"),
        "_cy": F.floor(col("LongitudeDecimalDegrees") / size).cast("long"),
    })


def neighbour_lag(points, value, size=1.0):
    """Number of neighbours and the sum of their values per station."""
    placed = _cells(points, size)
    totals = placed.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("c"), F.sum(value).alias("t"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = totals.select("*", F.explode(steps).alias("s")).select((F.col("_cx") + F.col("s.i")).alias("_cx"), (F.col("_cy") + F.col("s.j")).alias("_cy"), "c", "t")
    around = spread.groupBy("_cx", "_cy").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    joined = placed.join(around, ["_cx", "_cy"])
    return joined.withColumns({"neighbours": F.col("c") - 1, "neighbour_sum": F.col("t") - col(value)}).drop("_cx", "_cy", "c", "t")


def _standardised(points, value):
    mean = points.agg(F.avg(value)).scalar()
    return points.withColumn("_z", col(value) - mean)


def morans_i(points, value, size=1.0):
    """Moran's I with its expectation and the z score under normality."""
    lagged = neighbour_lag(_standardised(points, value), "_z", size)
    d = F.col("neighbours").cast("double")
    sums = lagged.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(d).alias("s0"), F.sum(d * d).alias("d2"),
        F.sum(F.col("_z") * F.col("neighbour_sum")).alias("cross"), F.sum(F.col("_z") ** 2).alias("square"),
    )
    n, s0 = F.col("n"), F.col("s0")
    expected = -1.0 / (n - 1)
    s1, s2 = 2 * s0, 4 * F.col("d2")
    variance = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - expected * expected
    out = sums.withColumns({"morans_i": F.try_divide(n * F.col("cross"), s0 * F.col("square")), "expected": expected, "variance": variance})
    return out.select(F.col("n").cast("long").alias("stations"), s0.cast("long").alias("links"), "morans_i", "expected", F.try_divide(F.col("morans_i") - F.col("expected"), F.sqrt("variance")).alias("z"))


def local_morans(points, value, key="StationNumber", size=1.0):
    """Local Moran value per station with its quadrant against the neighbours' mean."""
    base = _standardised(points, value)
    m2 = base.agg(F.avg(F.col("_z") ** 2)).scalar()
    lagged = neighbour_lag(base, "_z", size)
    lag = F.try_divide(F.col("neighbour_sum"), F.col("neighbours").cast("double"))
    z = F.col("_z")
    quadrant = (
        F.when(lag.isNull(), "isolated").when((z >= 0) & (lag >= 0), "high-high").when((z < 0) & (lag < 0), "low-low").when(z >= 0, "high-low").otherwise("low-high")
    )
    return lagged.select(key, "neighbours", F.try_divide(z * lag, m2).alias("local_i"), quadrant.alias("quadrant"))


def density_surface(df, keys=(), weight=None, size=0.25, reach=3, sigma=1.5, tile=64):
    """(keys, tile_row, tile_col, cell_row, cell_col, density): a Gaussian surface over grid cells, as heat maps show it.

    Rows count by ``weight`` (1 without one) in their cell of ``size`` degrees; each cell then spreads over ``reach`` cells on every side with
    a Gaussian of ``sigma`` cells, cut there and scaled so that the surface sums to the weights. The Gaussian is taken along rows, then along
    columns, so an occupied cell fans out 2 * reach + 1 times twice, whatever the number of rows in it. Tiles of ``tile`` cells are for
    reading a part of the map. Rows without coordinates or weight are left out; null keys are a surface of their own.
    """
    keys = list(keys)
    amount = F.lit(1.0) if weight is None else col(weight).cast("double")
    rows = _cells(df, size).withColumn("_amount", amount).dropna(subset=["_cx", "_cy", "_amount"])
    cells = rows.groupBy(*keys, "_cx", "_cy").agg(F.sum("_amount").alias("_amount"))
    bells = [math.exp(-d * d / (2.0 * sigma * sigma)) for d in range(-reach, reach + 1)]
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(g / sum(bells)).alias("g")) for d, g in zip(range(-reach, reach + 1), bells)])

    def along(frame, axis, other):
        spread = frame.select("*", F.explode(steps).alias("_s")).select(*keys, (F.col(axis) + F.col("_s.d")).alias(axis), other, (F.col("_amount") * F.col("_s.g")).alias("_amount"))
        return spread.groupBy(*keys, axis, other).agg(F.sum("_amount").alias("_amount"))

    smooth = along(along(cells, "_cx", "_cy"), "_cy", "_cx")
    return smooth.select(*keys, F.floor(F.col("_cx") / tile).alias("tile_row"), F.floor(F.col("_cy") / tile).alias("tile_col"), F.col("_cx").alias("cell_row"), F.col("_cy").alias("cell_col"), F.col("_amount").alias("density"))
