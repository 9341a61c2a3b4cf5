"""Writers. All of them write in parallel, one file per task."""

import os

from pyspark.sql import functions as F


def write_csv(df, path):
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_outputs(frames, folder, prefix="", fmt="csv"):
    """Write {name: frame} below one folder; returns {name: path}."""
    paths = {name: os.path.join(folder, f"{prefix}{name}") for name in frames}
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(paths[name])
    return paths


def write_json(df, path):
    """Rows as JSON lines; a one-row struct frame becomes one document."""
    df.write.mode("overwrite").json(path)


def write_text_report(df, path, text="text", order="line_no"):
    """Report lines in order. A report is a few dozen lines, so it goes to one file."""
    df.orderBy(order).select(F.col(text).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_versions(df, path, partition=("version",)):
    """Versioned dataset, partitioned for pruning by version."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_table(df, path, ts="SampleDateTime"):
    """The measurement table at rest: one folder per year, files clustered by variable.

    Ranges include the row key, so a variable or year that holds much of the data is cut into
    several files instead of ending in one task.
    """
    rows = df.withColumn("Year", F.year(ts))
    ranged = rows.repartitionByRange("Year", "VmvCode", "row_key").sortWithinPartitions("Year", "VmvCode", ts)
    ranged.write.mode("overwrite").partitionBy("Year").parquet(path)
