"""Summaries kept up to date by increments: mergeable states per station, variable and month, one folder a month.

A refresh reads the increment and the stored months that it touches, never the other months or the measurements behind them. Each
state names the last batch merged into its month. A month's folder is replaced as a whole, so a batch that is run again after a lost
driver skips the months that already hold it: every batch counts once.
"""

from pyspark.sql import functions as F

from hydroq.functions.values import percent
from hydroq.operators import units
from hydroq.sources.staging import stage

V, TS = "MeasurementValueNum", "SampleDateTime"
MONTH = ["period_year", "period_month"]
KEYS = ["StationNumber", "VmvCode", "VariableName", *MONTH]
STATE = (
    "StationNumber string, VmvCode int, VariableName string, rows long, n long, mean double, m2 double, low double, high double, "
    "days long, first timestamp_ntz, last timestamp_ntz, s1 long, m2_hits long, clean long, batch long, period_year int, period_month int"
)


def states(df, batch=0, bad_units=("ug/L",)):
    """Partial states of measurement rows; ``days`` has a bit for each day of the month that has a row.

    Rows without a time form a month of their own (null year and month); null stations and variables are keys like others.
    """
    flagged = units.with_ingest_flags(df, list(bad_units))
    any_flag = F.col("QA_S1") | F.col("QA_M2") | F.col("QA_C2")
    day = F.expr(f"shiftleft(1L, dayofmonth({TS}))")
    out = flagged.groupBy("StationNumber", F.col("VmvCode").cast("int").alias("VmvCode"), "VariableName", F.year(TS).alias("period_year"), F.month(TS).alias("period_month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(V).alias("n"), F.avg(V).alias("mean"), (F.var_pop(V) * F.count(V)).alias("m2"), F.min(V).alias("low"), F.max(V).alias("high"),
        F.coalesce(F.bit_or(day), F.lit(0).cast("long")).alias("days"), F.min(TS).alias("first"), F.max(TS).alias("last"),
        F.count_if("QA_S1").alias("s1"), F.count_if("QA_M2").alias("m2_hits"), F.count_if(~any_flag).alias("clean"),
    )
    return out.withColumn("batch", F.lit(batch).cast("long")).to(_schema(df.sparkSession))


def _schema(spark):
    return spark.createDataFrame([], STATE).schema


def _joined_moments():
    """Count, mean and squared deviations of several states together, two at a time so that no large sums cancel."""
    parts = F.filter(F.collect_list(F.struct("n", "mean", "m2")), lambda p: p["n"] > 0)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a, b):
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))

    return F.aggregate(parts, zero, add)


def merged(parts, keys=KEYS):
    """States of the same keys as one. A key has few states: the stored and the new one, or one for each name of a code."""
    out = parts.groupBy(*keys).agg(
        _joined_moments().alias("moments"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("days").alias("days"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("s1").alias("s1"), F.sum("m2_hits").alias("m2_hits"), F.sum("clean").alias("clean"), F.max("batch").alias("batch"),
    )
    some = F.col("moments.n") > 0
    return out.withColumns({"n": F.col("moments.n"), "mean": F.when(some, F.col("moments.mean")), "m2": F.when(some, F.col("moments.m2"))}).drop("moments")


def stored(spark, path):
    """The states below ``path``; none if nothing was written yet."""
    return spark.read.schema(STATE).parquet(path) if _exists(spark, path) else spark.createDataFrame([], STATE)


def _exists(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _write(whole, path):
    out = whole.hint("rebalance", *[F.col(c) for c in MONTH])  # large months become several files, small ones share a task
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MONTH).parquet(path)


def _same_month(a, b):
    return a.period_year.eqNullSafe(b.period_year) & a.period_month.eqNullSafe(b.period_month)


def refresh(path, df, batch, bad_units=("ug/L",)):
    """Merge the new measurements ``df`` into the states below ``path`` and return the months written.

    Batches are numbered upwards and run one after the other; a batch may be repeated until it has succeeded. Only the folders of
    its months are replaced. An empty batch changes nothing.
    """
    spark = df.sparkSession
    if not _exists(spark, path):  # nothing to merge with: the states of a batch have unique keys
        _write(states(df, batch, bad_units), path)
        return stored(spark, path).select(*MONTH).distinct()
    old = stored(spark, path)
    new = stage(states(df, batch, bad_units), "increment")
    touched = new.select(*MONTH).distinct()
    near = old.join(touched, _same_month(old, touched), "left_semi")
    done = near.groupBy(*MONTH).agg(F.max("batch").alias("held")).where(F.col("held") >= batch)
    fresh = new.join(done, _same_month(new, done), "left_anti")
    open_months = fresh.select(*MONTH).distinct()
    kept = old.join(open_months, _same_month(old, open_months), "left_semi")
    whole = merged(kept.unionByName(fresh)).withColumn("batch", F.lit(batch).cast("long")).to(_schema(spark))
    # written first: the folders it is read from are replaced next
    whole = stage(whole, "refreshed")
    _write(whole, path)
    return whole.select(*MONTH).distinct()


def monthly_from(state):
    """The monthly table per station and variable code, from states."""
    out = merged(state, ["StationNumber", "VmvCode", *MONTH]).where("n > 0")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return out.select("StationNumber", "VmvCode", *MONTH, F.col("mean").alias("value_mean"), std.alias("value_std"), F.col("low").alias("value_min"), F.col("high").alias("value_max"), F.col("n").alias("sample_count"))


def overview_from(stations, state):
    """The station overview from states: every station with its variables, sample days, date range, violations and compliance."""
    months = state.groupBy("StationNumber", *MONTH).agg(
        F.bit_or("days").alias("days"), F.collect_set("VariableName").alias("names"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in ("rows", "s1", "m2_hits", "clean")],
    )
    per = months.groupBy("StationNumber").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("names")))).cast("long").alias("num_parameters"), F.sum(F.bit_count("days")).cast("long").alias("num_samples"),
        F.min("first").alias("first_sample"), F.max("last").alias("last_sample"),
        F.sum("s1").alias("s1_violations"), F.sum("m2_hits").alias("m2_violations"), percent(F.sum("clean"), F.sum("rows")).alias("compliance_pct"),
    )
    return stations.join(per, "StationNumber", "left").na.fill(0, ["num_parameters", "num_samples", "s1_violations", "m2_violations"])
