"""Sampling gaps, coverage by time and arrival-order checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions import labels as L
from hydroq.functions.values import col, days_between, percent
from hydroq.operators import ordered

TS = "SampleDateTime"


def visits(df, keys, ts=TS):
    """Distinct times per key with their rows and first row key; everything below works on these."""
    return df.where(col(ts).isNotNull()).groupBy(*keys, ts).agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_key").alias("first_key")
    )


def gaps(df, keys=("StationNumber",), ts=TS):
    """Each visit with the one before it and the whole days between, per key."""
    looked = ordered.with_previous(visits(df, keys, ts), list(keys), ts, {ts: "previous"}, ordered.month_block(ts))
    return looked.withColumn("gap_days", days_between(ts, "previous"))


def coverage_by_station(df, compat=False):
    """Samples, date range, years, mean and largest gap, gaps over the limit and frequency class.

    ``compat`` leaves out each station's first gap, as a difference taken after dropping one date does.
    """
    g = gaps(df)
    first = g.groupBy("StationNumber").agg(F.min(TS).alias("_first"))
    used = g
    if compat:
        used = g.join(first, "StationNumber").withColumn("gap_days", F.when(col("previous") > col("_first"), col("gap_days")))
    per_gap = used.groupBy("StationNumber").agg(
        F.min(TS).alias("DateRangeStart"),
        F.max(TS).alias("DateRangeEnd"),
        F.count(F.lit(1)).alias("_dates"),
        F.avg("gap_days").alias("AvgGapDays"),
        F.max("gap_days").alias("MaxGapDays"),
        F.count_if(col("gap_days") > S.GAP_DAYS).alias("_large"),
    )
    names = ordered.group_with_first(df, ["StationNumber"], ["Station"], {"_rows": F.lit(1)}, row=True).where("_rows >= 2")
    per_row = names.join(df.groupBy("StationNumber").agg(F.countDistinct("SampleNumber").alias("SampleCount")), "StationNumber")
    return per_row.join(per_gap, "StationNumber").select(
        "StationNumber", "Station", "SampleCount", "DateRangeStart", "DateRangeEnd",
        (days_between("DateRangeEnd", "DateRangeStart") / 365.25).alias("YearsSpanned"),
        L.frequency_class("AvgGapDays").alias("EstimatedFrequency"),
        "AvgGapDays", "MaxGapDays",
        F.when(col("_dates") > 1, col("_large")).alias("GapsOver60Days"),
    )


def seasonal_sampling(df):
    counts = df.where(col(TS).isNotNull()).groupBy(F.quarter(TS).alias("Quarter")).agg(F.count(F.lit(1)).alias("SampleCount"))
    total = df.agg(F.count(TS)).scalar()
    return counts.withColumns({"QuarterName": L.lookup("Quarter", L.QUARTER_NAMES), "SamplePct": percent("SampleCount", total)})


def monthly_distribution(df):
    counts = df.where(col(TS).isNotNull()).groupBy(F.month(TS).alias("Month")).agg(
        F.countDistinct("SampleNumber").alias("UniqueSamples"), F.count("MeasurementValue").alias("TotalMeasurements")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumns({"MonthName": L.lookup("Month", L.MONTH_NAMES), "SharePct": percent("TotalMeasurements", total)})


def with_arrival_previous(df, keys, rows=None):
    """Each row with the time of the row that arrived before it, per key; ``rows`` as in ``ordered.with_previous``."""
    return ordered.with_previous(df, list(keys), "row_key", {TS: "previous"}, col("arrival_block"), rows)


def time_travel(df, key="StationNumber"):
    """Rows per key whose time lies before that of the row arriving just before."""
    back = with_arrival_previous(df.where(col(key).isNotNull()), [key]).where(col(TS) < col("previous"))
    return back.groupBy(key).agg(F.count(F.lit(1)).alias("reversals"))


def year_coverage(df):
    return df.where(col(TS).isNotNull() & col("StationNumber").isNotNull()).groupBy(F.year(TS).alias("Year"), "StationNumber").agg(
        F.countDistinct("SampleNumber").alias("UniqueSamples"), F.count("MeasurementValue").alias("MeasurementCount")
    )


def year_coverage_wide(df, years):
    return year_coverage(df).groupBy("StationNumber").pivot("Year", list(years)).agg(F.sum("MeasurementCount")).na.fill(0)


def temporal_summary(df):
    """Rows per year next to the overall span."""
    span = df.agg(F.struct(F.min(TS).alias("a"), F.max(TS).alias("b"), F.countDistinct(F.year(TS)).alias("n"))).scalar()
    per_year = df.where(col(TS).isNotNull()).groupBy(F.year(TS).alias("Year")).agg(F.count(F.lit(1)).alias("records"))
    return per_year.withColumn("_s", span).select(
        "Year", "records", col("_s.a").alias("span_start"), col("_s.b").alias("span_end"), col("_s.n").alias("years")
    )


def sample_clusters(df, tolerance_days=1, keys=("StationNumber",), compat=False):
    """Visits grouped into samples: a new one starts when more than the tolerance has passed.

    The cluster number is a running count per key, the id carries the cluster's first day. With
    ``compat`` the id carries each visit's own day, so a cluster never spans days.
    """
    keys = list(keys)
    looked = ordered.with_previous(visits(df, keys), keys, TS, {TS: "previous"}, ordered.month_block(TS))
    far = F.unix_timestamp(TS) - F.unix_timestamp("previous") > tolerance_days * 86400
    marked = looked.withColumn("_new", F.coalesce(far, F.lit(False)).cast("long"))
    run = ordered.running_totals(marked, keys, TS, {"_new": "_before"}, ordered.month_block(TS))
    numbered = run.withColumn("cluster", (F.col("_before") + F.col("_new"))).drop("_new", "_before", "_before_all", "previous")
    by = [*keys, "cluster", F.to_date(TS).alias("day")] if compat else [*keys, "cluster"]
    out = numbered.groupBy(*by).agg(
        F.min(TS).alias("start"), F.max(TS).alias("end"), F.count(F.lit(1)).alias("visits"), F.sum("rows").alias("records")
    )
    return out.withColumn("sample_id", F.concat_ws("_", *keys, F.col("cluster").cast("string"), F.date_format("start", "yyyyMMdd")))


def rolling_year_mean(df, years=3, keys=("StationNumber", "VmvCode")):
    """Mean of the yearly means of the last years; the window covers one row per year of a series."""
    yearly = df.groupBy(*keys, F.year(TS).alias("Year")).agg(F.avg("MeasurementValueNum").alias("year_mean"))
    back = Window.partitionBy(*keys).orderBy("Year").rowsBetween(1 - years, 0)
    return yearly.withColumn("rolling_mean", F.avg("year_mean").over(back))
