"""Small tables derived from the measurement rows: variables, stations, units."""

from pyspark.sql import functions as F

from hydroq.functions import labels as L
from hydroq.functions.values import col
from hydroq.operators import ordered


def variable_map(df):
    """VmvCode and the VariableName of its first row (the code as text where no name column exists)."""
    if "VariableName" not in df.columns:
        return df.select("VmvCode").distinct().withColumn("VariableName", col("VmvCode").cast("string"))
    return ordered.group_with_first(df, ["VmvCode"], ["VariableName"], row=True)


def variable_labels(df):
    """VmvCode with its 'code - name' text."""
    return variable_map(df).select("VmvCode", L.code_label("VmvCode", "VariableName").alias("label"))


def variable_keys(df):
    """VmvCode with 'Name (Vmv-VarCode)' from its first row."""
    first = ordered.group_with_first(df, ["VmvCode"], ["VariableCode", "VariableName"], row=True)
    return first.select("VmvCode", L.variable_key_label().alias("variable_label"))


def stations(df):
    """StationNumber, first name and first coordinates."""
    return ordered.group_with_first(df, ["StationNumber"], ["Station", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees"])


def station_labels(df):
    return stations(df).select("StationNumber", L.station_label().alias("station_label"))


def active_unit(df, keys=()):
    """Most frequent unit per key; ties go to the smaller text."""
    counts = df.where(col("UnitCode").isNotNull()).groupBy(*keys, "UnitCode").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("UnitCode", F.struct(-F.col("n"), F.col("UnitCode"))).alias("UnitCode"))


def distinct_sorted(df, column):
    return df.select(column).distinct().orderBy(column)
