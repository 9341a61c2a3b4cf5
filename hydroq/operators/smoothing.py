"""Series with gaps and memory: local regression, interpolation between known months, autocorrelation and its effect on trend tests."""

from pyspark.sql import functions as F

from hydroq.functions import tails
from hydroq.functions.values import col
from hydroq.operators import ordered, stats
from hydroq.sources.staging import stage

V, TS = stats.V, stats.TS


def _in_time(df, keys, value):
    """(keys, order, t, v): the numbers with a time, t in days."""
    days = F.unix_date(F.to_date(TS)) + (F.hour(TS) * 3600 + F.minute(TS) * 60 + F.second(TS)) / 86_400.0
    return df.where(col(value).isNotNull() & col(TS).isNotNull()).select(*keys, F.struct(TS, "row_key").alias("order"), days.alias("t"), col(value).cast("double").alias("v"))


def loess(df, keys=("VmvCode",), value=V, k=5):
    """(keys, SampleDateTime, row_key, v, smooth): local linear regression over each number and the ``k`` before and after it.

    Weights are tricube in the distance of time over the largest distance of the window (a hair more, so that the farthest row
    counts a little). With all weight at one time, smooth is the weighted mean. Rows without number or time are left out.
    """
    keys = list(keys)
    rows = ordered.with_around(_in_time(df, keys, value), keys, "order", ["t", "v"], k, k, ordered.day_block(F.col("order")[TS]))
    around = F.concat("earlier", "later", F.array(F.struct("t", "v")))
    rows = rows.withColumn("w", F.transform(around, lambda x: F.struct((x["t"] - F.col("t")).alias("x"), x["v"].alias("y"))))
    rows = rows.withColumn("far", F.array_max(F.transform("w", lambda p: F.abs(p["x"]))) * 1.001)
    weighted = F.transform("w", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.when(F.col("far") > 0, F.pow(1 - F.pow(F.abs(p["x"]) / F.col("far"), 3), 3)).otherwise(1.0).alias("g")))
    rows = rows.withColumn("w", weighted)

    def total(term):
        return F.aggregate("w", F.lit(0.0), lambda acc, p: acc + p["g"] * term(p))

    rows = rows.select(*keys, "order", "v", total(lambda p: F.lit(1.0)).alias("s0"), total(lambda p: p["x"]).alias("s1"), total(lambda p: p["x"] * p["x"]).alias("s2"), total(lambda p: p["y"]).alias("y0"), total(lambda p: p["x"] * p["y"]).alias("y1"))
    spread = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("y0") - F.col("s1") * F.col("y1")) / spread
    flat = spread <= 1e-9 * F.col("s0") * F.col("s2")
    return rows.select(*keys, f"order.{TS}", "order.row_key", "v", F.when((F.col("s2") == 0) | flat, F.col("y0") / F.col("s0")).otherwise(line).alias("smooth"))


def monthly_means(df, keys, value=V):
    """(keys, month, v): means of the months that have numbers; month counts from year 0."""
    month = (F.year(TS) * 12 + F.month(TS) - 1).cast("long")
    return df.where(col(value).isNotNull() & col(TS).isNotNull()).groupBy(*keys, month.alias("month")).agg(F.avg(value).alias("v"))


def gap_report(known, keys, most_missing=0.3):
    """(keys, first, last, known, missing_share, reason) per series; reason is null for series that may be filled."""
    sums = known.groupBy(*keys).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count(F.lit(1)).alias("known"))
    missing = 1 - F.col("known") / (F.col("last") - F.col("first") + 1)
    reason = F.when(F.col("known") < 2, "fewer than two months").when(missing > most_missing, "too many gaps")
    return sums.withColumn("missing_share", missing).withColumn("reason", reason)


def interpolate(df, keys=("StationNumber", "VmvCode"), value=V, most_missing=0.3):
    """(keys, month, v, filled) for every month between the first and the last of each series that may be filled.

    Months without numbers lie on the line between the known months around them. Each known month only needs the next one.
    """
    keys = list(keys)
    known = stage(monthly_means(df, keys, value), "months")
    fit = gap_report(known, keys, most_missing).where("reason is null").select(*keys)
    joined = ordered.with_next(known.join(fit, keys), keys, "month", {"month": "next_month", "v": "next_v"}, F.floor(F.col("month") / 12))
    months = joined.withColumn("at", F.explode(F.sequence(F.col("month"), F.coalesce(F.col("next_month") - 1, F.col("month")))))
    share = (F.col("at") - F.col("month")) / (F.col("next_month") - F.col("month"))
    value = F.when(F.col("at") == F.col("month"), F.col("v")).otherwise(F.col("v") + share * (F.col("next_v") - F.col("v")))
    return months.select(*keys, F.col("at").alias("month"), value.alias("v"), (F.col("at") > F.col("month")).alias("filled"))


def autocorrelation(df, keys=("VmvCode",), value=V, lags=12):
    """(keys, n, r: array of the autocorrelations at lags 1..``lags``) of the numbers in order of time and arrival.

    Lags that a series is too short for are null, as are all of a series of one value.
    """
    keys = list(keys)
    rows = _in_time(df, keys, value)
    means = rows.groupBy(*keys).agg(F.avg("v").alias("mean"))
    centred = rows.join(means, keys).select(*keys, "order", (F.col("v") - F.col("mean")).alias("z"))
    around = ordered.with_around(centred, keys, "order", ["z"], 0, lags, ordered.day_block(F.col("order")[TS]))
    products = [F.sum(F.col("z") * F.get("later", F.lit(k))["z"]).alias(f"p{k}") for k in range(lags)]
    sums = around.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("square"), *products)
    # a series of one value leaves rounding errors of its mean
    square = F.when(F.col("square") > 1e-18 * F.col("n"), F.col("square"))
    return sums.select(*keys, "n", F.array(*[F.col(f"p{k}") / square for k in range(lags)]).alias("r"))


def corrected_mann_kendall(df, keys=("VmvCode",), value=V, lags=12):
    """Mann-Kendall with its variance inflated by the autocorrelation: keys, n, r1, inflation, effective_n, z, corrected_z, corrected_p.

    inflation is 1 + 2 sum (1 - k/n) r_k over the lags outside of the band of 1.96 / sqrt(n), at least 1 / n; effective_n is n over it.
    """
    keys = list(keys)
    memory = autocorrelation(df, keys, value, lags)
    n = F.col("n").cast("double")
    strong = F.transform("r", lambda r, k: F.when(F.abs(r) > 1.96 / F.sqrt(n), (1 - (k + 1) / n) * r).otherwise(0.0))
    memory = memory.withColumn("inflation", F.greatest(1 + 2 * F.aggregate(strong, F.lit(0.0), lambda a, x: a + x), 1 / n))
    trend = stats.mann_kendall(df, keys, value).select(*keys, "z")
    out = memory.join(trend, keys).withColumn("corrected_z", F.col("z") / F.sqrt("inflation"))
    p = tails.normal_two_sided_p("corrected_z")
    return out.select(*keys, "n", F.get("r", F.lit(0)).alias("r1"), "inflation", (n / F.col("inflation")).alias("effective_n"), "z", "corrected_z", p.alias("corrected_p"))
