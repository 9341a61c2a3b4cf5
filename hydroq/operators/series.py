"""Station values, period series and map frames."""

from pyspark.sql import functions as F

from hydroq.functions import labels as L
from hydroq.functions.values import col, percent_or_zero
from hydroq.operators import filters, ordered

V = "MeasurementValueNum"
TS = "SampleDateTime"
_PLACE = ("LatitudeDecimalDegrees", "LongitudeDecimalDegrees")


def station_values(df, *keys):
    """Mean value, rows and first name, coordinates and unit per station (and extra keys)."""
    rows = filters.with_all(df, [V, *_PLACE]).where(col("StationNumber").isNotNull())
    by = [*keys, "StationNumber"]
    out = ordered.group_with_first(rows, by, ["Station", *_PLACE, "UnitCode"], {"RecordCount": F.lit(1)}, {"_sum": col(V)})
    return out.withColumn(V, col("_sum") / col("RecordCount")).drop("_sum")


def period_percentiles(df, period="M", *keys):
    """Mean and quartiles per period (and extra keys), with a sortable period start."""
    rows = df.where(col(V).isNotNull()).select(
        *keys, L.period_start(TS, period).alias("period_start"), L.period_label(TS, period).alias("period_label"), V
    )
    by = [*keys, "period_start", "period_label"]
    dist = ordered.distribution(rows, by, V)
    return dist.groupBy(*by).agg(
        (F.sum(F.col(V) * F.col("n")) / F.sum("n")).alias("mean"),
        *ordered.quantile_columns(V, {"p25": 0.25, "p50": 0.5, "p75": 0.75}),
    )


def up_to_period(series, label):
    """The series up to and including the period with this label."""
    last = series.where(col("period_label") == label).agg(F.max("period_start")).scalar()
    return series.where(col("period_start") <= last)


def statistical_summary(df, keep):
    """Count, mean, median, std, min, max over the kept rows and the share removed from all rows.

    ``keep`` is the filter predicate, so filtered and unfiltered numbers come from one pass.
    """
    kept = F.coalesce(keep, F.lit(False))
    value = F.when(kept, col(V))
    stats = df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).when(F.count(value) == 1, 0.0).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        percent_or_zero(F.count_if(~kept), F.count(F.lit(1))).alias("pct_removed"),
        F.countDistinct(F.when(kept, col("StationNumber"))).alias("stations"),
    )
    median = ordered.quantiles(df.where(kept), [], V, {"median": 0.5})
    return stats.withColumn("median", median.select("median").scalar())


def threshold_control(df):
    """Slider bounds: min, max (min + 1 when equal), median and step; defaults without values."""
    dist = ordered.distribution(df.select(V), [], V)
    one = dist.agg(F.min(V).alias("lo"), F.max(V).alias("hi"), *ordered.quantile_columns(V, {"mid": 0.5}))
    high = F.when(F.col("lo") == F.col("hi"), F.col("lo") + 1.0).otherwise(F.col("hi"))
    return one.select(
        F.coalesce("lo", F.lit(0.0)).alias("threshold_min"),
        F.coalesce(high, F.lit(1.0)).alias("threshold_max"),
        F.coalesce("mid", F.lit(0.5)).alias("threshold_p50"),
        F.when(F.col("lo").isNull(), 0.001).otherwise(F.greatest((high - F.col("lo")) / 1000, F.lit(0.0001))).alias("threshold_step"),
    )


def period_list(df, period):
    return df.select(L.period_start(TS, period).alias("period_start"), L.period_label(TS, period).alias("period_label")).distinct().orderBy("period_start")


def current_frame(df, period):
    """Rows of the newest period."""
    start = L.period_start(TS, period)
    return df.where(start == df.agg(F.max(start)).scalar())


def frames(df, period):
    """Station values of every period at once, in place of a playback loop."""
    rows = df.withColumns({"period_start": L.period_start(TS, period), "period_label": L.period_label(TS, period)})
    return station_values(rows, "period_start", "period_label")


def threshold_match(points, threshold, direction="above", only_matching=False):
    match = col(V) >= threshold if direction == "above" else col(V) <= threshold
    out = points.withColumn("match", match)
    return out.where("match") if only_matching else out


def quantile_edges(points, keys=(), classes=5, value=V):
    """Bin edges per key: linear quantiles at i/q with q = min(classes, distinct values), duplicates dropped."""
    dist = ordered.distribution(points.select(*keys, value), keys, value)
    q = F.least(F.lit(classes), F.col("distinct"))
    probs = {f"e{i}": F.least(F.lit(float(i)) / q, F.lit(1.0)) for i in range(classes + 1)}
    edges = dist.groupBy(*keys).agg(*ordered.quantile_columns(value, probs), F.max("distinct").alias("_d"))
    return edges.select(*keys, F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))


def quantile_classes(points, keys=(), classes=5, value=V):
    """Right-closed quantile class of each point, the lowest edge included; a single value is class 0."""
    edges = quantile_edges(points, keys, classes, value)
    below = F.size(F.filter("edges", lambda e: e < col(value)))
    if keys:
        joined = points.join(edges, list(keys))
    else:
        joined = points.withColumn("edges", edges.select("edges").scalar())
    return joined.withColumn("quantile_class", F.greatest(F.lit(0), below - 1)).drop("edges")


def scale_breaks(points, steps=5, value=V):
    """Evenly spaced values from min to max."""
    one = points.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / (steps - 1)
    cells = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(i.alias("step"), (F.col("lo") + i * width).alias("value")))
    return one.select(F.explode(cells).alias("c")).select("c.*")


def window_aggregate(df, window, keys=("StationNumber", "VmvCode")):
    """Mean, std, count, min and max per key and period; 'event' returns the rows."""
    if window == "event":
        return df
    if L.period_name(window, None) is None:
        raise ValueError(f"unknown window: {window}")
    return df.groupBy(*keys, L.period_start(TS, window).alias("period_start"), L.period_label(TS, window).alias("period_label")).agg(
        F.avg(V).alias("mean"),
        F.stddev_samp(V).alias("std"),
        F.count(V).alias("count"),
        F.min(V).alias("min"),
        F.max(V).alias("max"),
        F.countDistinct("SampleNumber").alias("samples"),
    )
