"""Registry of the named queries and of the SQL text each is checked against."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroq.sources import test_tables

QUERIES, ORACLES = {}, {}

# Sums of doubles differ in their last digits with the order of addition. Results are compared after
# rounding; the small shift keeps exact halves (means over 2^k rows) on one side of the cut.
SHIFT = 0.0317


def shift_of(digits):
    return SHIFT * 10.0 ** -digits


def settle(df, rounding):
    """Comparable cells: timestamps and dates as text, listed doubles rounded."""
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            df = df.withColumn(field.name, F.col(field.name).cast("string"))
    for name, digits in rounding.items():
        df = df.withColumn(name, F.round(F.col(name) + F.lit(shift_of(digits)), digits))
    return df


def with_views(body):
    """Put the measurement view in front of an oracle text that may bring own WITH entries."""
    body = body.strip()
    if body[:5].upper() == "WITH ":
        body = ",\n" + body[5:]
    return f"WITH obs AS (\n{test_tables.observations_sql()}\n)\n{body}"


def query(name, sql=None, rounding=None, digits=6, raw_sql=False):
    """Register ``build(spark, sf_dir)`` under ``name``; ``rounding`` lists double columns to round."""
    rounding = {c: digits for c in rounding.split()} if isinstance(rounding, str) else (rounding or {})

    def wrap(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: settle(build(spark, sf_dir), rounding)
        if sql is not None:
            text = sql if raw_sql else with_views(sql)
            if rounding:
                cells = ", ".join(f"round({c} + {shift_of(d):.17f}, {d}) AS {c}" for c, d in rounding.items())
                text = f"SELECT * REPLACE ({cells}) FROM (\n{text}\n)"
            ORACLES[name] = text
        return build

    return wrap


obs = test_tables.observations


def records(name="records"):
    return F.count(F.lit(1)).alias(name)
