"""Scans, typed loading, validation, versions and sinks over the measurement view."""

import os

from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.operators import filters
from hydroq.plans.catalog import obs, query
from hydroq.sources import loader, sinks, staging


def _csv_copy(spark, sf_dir):
    """The view as a measurement CSV in the shared scratch folder."""
    rows = obs(spark, sf_dir).withColumn("SampleDateTime", F.date_format("SampleDateTime", loader.DATE_PATTERN))
    for name, kind in S.CSV_COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    path = staging.scratch_dir(spark, "csv")
    sinks.write_csv(rows.select(*[n for n, _ in S.CSV_COLUMNS]), path)
    return path


@query(
    "a01_csv_round_trip",
    """SELECT StationNumber, count(*) AS records, count(MeasurementValueNum) AS numbers, count(nullif(MeasurementQualifier, '')) AS qualifiers,
    CAST(min(SampleDateTime) AS VARCHAR) AS date_min, sum(VmvCode)::BIGINT AS code_sum FROM obs GROUP BY 1""",
)
def _(spark, sf):
    source = loader.first_existing(spark, ["/nonexistent/measurements.csv", _csv_copy(spark, sf)])
    return loader.read_csv(spark, source).groupBy("StationNumber").agg(
        F.count(F.lit(1)).alias("records"),
        F.count("MeasurementValueNum").alias("numbers"),
        F.count("MeasurementQualifier").alias("qualifiers"),
        F.min("SampleDateTime").alias("date_min"),
        F.sum("VmvCode").alias("code_sum"),
    )


@query("a05_source_fallback", "SELECT count(*) AS records FROM lineitem", raw_sql=True)
def _(spark, sf):
    found = loader.first_existing(spark, [os.path.join(sf, "absent.parquet"), os.path.join(sf, "lineitem.parquet"), os.path.join(sf, "orders.parquet")])
    return spark.read.parquet(found).agg(F.count(F.lit(1)).alias("records"))


@query("a02_parts_union", "SELECT VmvCode, count(*) AS records FROM obs GROUP BY 1")
def _(spark, sf):
    path = _csv_copy(spark, sf)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    parts = [str(s.getPath()) for s in folder.getFileSystem(conf).listStatus(folder) if s.getPath().getName().startswith("part-")]
    return loader.read_parts(spark, parts).groupBy("VmvCode").agg(F.count(F.lit(1)).alias("records"))


@query("a03_first_rows", "SELECT row_key, StationNumber, VmvCode FROM obs ORDER BY row_key LIMIT 500")
def _(spark, sf):
    return loader.first_rows(obs(spark, sf, "row_key", "StationNumber", "VmvCode"), 500)


@query("a04_pruned_count", "SELECT count(VmvCode) AS records FROM obs")
def _(spark, sf):
    return obs(spark, sf, "VmvCode").agg(F.count("VmvCode").alias("records"))


_VERSIONS_SQL = """WITH v AS (
 SELECT *, 'C' AS version FROM obs UNION ALL
 SELECT *, 'A' FROM obs WHERE MeasurementQualifier IS NULL OR MeasurementQualifier NOT IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS') UNION ALL
 SELECT *, 'B' FROM obs WHERE MeasurementQualifier IS NULL OR MeasurementQualifier NOT IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS'))
"""


@query(
    "a06_version_rows",
    """SELECT StationNumber, count(*) AS records, CAST(count_if(MeasurementQualifier IN ('HT','DR','EST','SPNF')) AS BIGINT) AS review FROM obs
    WHERE MeasurementQualifier IS NULL OR MeasurementQualifier NOT IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS') GROUP BY 1""",
)
def _(spark, sf):
    rows = loader.load_version(obs(spark, sf, "StationNumber", "MeasurementQualifier"), "b")
    return rows.groupBy("StationNumber").agg(F.count(F.lit(1)).alias("records"), F.count_if("quality_flag").alias("review"))


@query(
    "a07_date_parsing",
    """SELECT strftime(SampleDateTime, '%Y-%m') AS month, count(*) AS records, count(CASE WHEN coalesce(MeasurementFlag,'') <> 'G' THEN 1 END) AS parsed,
    CAST(min(CASE WHEN coalesce(MeasurementFlag,'') <> 'G' THEN SampleDateTime END) AS VARCHAR) AS first_date FROM obs GROUP BY 1""",
)
def _(spark, sf):
    rows = obs(spark, sf, "SampleDateTime", "MeasurementFlag")
    text = F.when(F.col("MeasurementFlag") == "G", "no date").otherwise(F.date_format("SampleDateTime", loader.DATE_PATTERN))
    rows = rows.select(F.date_format("SampleDateTime", "yyyy-MM").alias("month"), loader.parse_dates(text).alias("ts"))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("records"), F.count("ts").alias("parsed"), F.min("ts").alias("first_date"))


@query(
    "a08_data_info",
    """SELECT count(*) AS total_records, CAST(5 AS BIGINT) AS columns, CAST(min(SampleDateTime) AS VARCHAR) AS date_min,
    CAST(max(SampleDateTime) AS VARCHAR) AS date_max, count(DISTINCT StationNumber) AS stations, count(DISTINCT VmvCode) AS parameters,
    count(DISTINCT MeasurementQualifier) AS qualifiers FROM obs""",
)
def _(spark, sf):
    return loader.data_info(obs(spark, sf, "SampleDateTime", "StationNumber", "VmvCode", "MeasurementQualifier", "MeasurementValue"))


_EXPLORED = ["SampleComment", "MeasurementComment", "MeasurementQualifier", "VmvCode", "UnitCode"]


@query(
    "a09_explore_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", m AS metric, CASE m WHEN 'dtype' THEN '{'int' if c == 'VmvCode' else 'string'}'"
        f" WHEN 'rows' THEN CAST(n AS VARCHAR) WHEN 'filled' THEN CAST(f AS VARCHAR) ELSE CAST(d AS VARCHAR) END AS value"
        f" FROM (SELECT count(*) n, count({c}) f, count(DISTINCT {c}) d FROM obs), (SELECT unnest(['dtype','rows','filled','distinct']) m)"
        for c in _EXPLORED
    ),
)
def _(spark, sf):
    return loader.explore_columns(obs(spark, sf, *_EXPLORED), _EXPLORED)


@query(
    "a09_example_rows",
    """SELECT MeasurementQualifier, row_key, StationNumber, MeasurementComment FROM (SELECT *, row_number() OVER
    (PARTITION BY MeasurementQualifier ORDER BY row_key) rn FROM obs WHERE MeasurementQualifier IN ('HT','SUS')) WHERE rn <= 3""",
)
def _(spark, sf):
    rows = obs(spark, sf, "row_key", "arrival_block", "MeasurementQualifier", "StationNumber", "MeasurementComment")
    return loader.example_rows(rows, "MeasurementQualifier", ["HT", "SUS"]).drop("arrival_block")


@query(
    "a10_csv_sink",
    "SELECT VariableName, count(*) AS records, count(DISTINCT StationNumber) AS stations FROM obs GROUP BY 1",
)
def _(spark, sf):
    report = obs(spark, sf, "VariableName", "StationNumber").groupBy("VariableName").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("StationNumber").alias("stations")
    )
    path = sinks.write_outputs({"variables": report}, staging.scratch_dir(spark, "reports"), "run_")["variables"]
    return spark.read.option("header", True).schema("VariableName string, records bigint, stations bigint").csv(path)


@query(
    "a11_json_sink",
    "SELECT ProjectNumber AS project, count(*) AS records, min(VmvCode) AS low, max(VmvCode) AS high FROM obs GROUP BY 1",
)
def _(spark, sf):
    report = obs(spark, sf, "ProjectNumber", "VmvCode").groupBy(F.col("ProjectNumber").alias("project")).agg(
        F.count(F.lit(1)).alias("records"), F.struct(F.min("VmvCode").alias("low"), F.max("VmvCode").alias("high")).alias("codes")
    )
    path = staging.scratch_dir(spark, "json")
    sinks.write_json(report, path)
    back = spark.read.schema("project string, records bigint, codes struct<low:int,high:int>").json(path)
    return back.select("project", "records", "codes.low", "codes.high")


@query(
    "a12_text_report",
    """SELECT 'Records: ' || count(*) AS text FROM obs UNION ALL SELECT 'Stations: ' || count(DISTINCT StationNumber) FROM obs
    UNION ALL SELECT 'Variables: ' || count(DISTINCT VmvCode) FROM obs""",
)
def _(spark, sf):
    facts = obs(spark, sf, "StationNumber", "VmvCode").agg(
        F.count(F.lit(1)).alias("r"), F.countDistinct("StationNumber").alias("s"), F.countDistinct("VmvCode").alias("v")
    )
    lines = [F.concat(F.lit(t), F.col(c).cast("string")) for t, c in (("Records: ", "r"), ("Stations: ", "s"), ("Variables: ", "v"))]
    report = facts.select(F.posexplode(F.array(*lines)).alias("line_no", "text"))
    path = staging.scratch_dir(spark, "text")
    sinks.write_text_report(report, path)
    return spark.read.text(path).withColumnRenamed("value", "text")


_INGEST = ["StationNumber", "Station", "SampleDateTime", "VmvCode", "MeasurementValue", "UnitCode", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees"]


@query(
    "a13_validated_ingest",
    f"""WITH d AS (SELECT {', '.join(_INGEST)}, count(*) n FROM obs GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after,
    CAST(count_if(NOT (LatitudeDecimalDegrees BETWEEN 49.2 AND 61 AND LongitudeDecimalDegrees BETWEEN -128 AND -110)) AS BIGINT) AS location_failures,
    count(DISTINCT StationNumber) AS stations, 100.0*(sum(n)-count(*))/sum(n) AS duplicate_pct,
    100.0*(sum(n)-count(*))/sum(n) > 5 AS duplicate_warning FROM d""",
    "duplicate_pct",
)
def _(spark, sf):
    return loader.ingest_metrics(obs(spark, sf, *_INGEST), _INGEST, lat=(49.2, 61.0), lon=(-128.0, -110.0))


@query(
    "a14_version_tables",
    _VERSIONS_SQL + "SELECT version, year(SampleDateTime)::INT AS \"year\", count(*) AS records FROM v GROUP BY 1, 2",
)
def _(spark, sf):
    rows = filters.with_versions(obs(spark, sf, "row_key", "SampleDateTime", "MeasurementQualifier"))
    path = staging.scratch_dir(spark, "versions")
    sinks.write_versions(rows, path)
    back = spark.read.parquet(path)
    return back.groupBy("version", F.year("SampleDateTime").alias("year")).agg(F.count(F.lit(1)).alias("records"))


_WIDE = [0, 1, 2, 6]


@query(
    "a15_wide_export",
    "SELECT SampleNumber, " + ", ".join(f'arg_min(MeasurementValueNum, row_key) FILTER (WHERE VmvCode={c} AND MeasurementValueNum IS NOT NULL) AS "{c}"' for c in _WIDE)
    + " FROM obs WHERE VmvCode IN (0,1,2,6) GROUP BY 1",
)
def _(spark, sf):
    return loader.wide_by_variable(obs(spark, sf, "SampleNumber", "VmvCode", "MeasurementValueNum", "row_key"), ["SampleNumber"], _WIDE)


@query(
    "a15_long_again",
    """SELECT SampleNumber, CAST(VmvCode AS VARCHAR) AS VmvCode, arg_min(MeasurementValueNum, row_key) AS MeasurementValueNum FROM obs
    WHERE VmvCode IN (0,1,2,6) AND MeasurementValueNum IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = obs(spark, sf, "SampleNumber", "VmvCode", "MeasurementValueNum", "row_key")
    return loader.long_by_variable(loader.wide_by_variable(rows, ["SampleNumber"], _WIDE), ["SampleNumber"])


@query(
    "a14_stored_table",
    """SELECT VmvCode, count(*) AS records, avg(MeasurementValueNum) AS mean FROM obs WHERE CAST(SampleDateTime AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-02-10' AND VmvCode < 12 GROUP BY 1""",
    "mean",
)
def _(spark, sf):
    path = staging.scratch_dir(spark, "table")
    sinks.write_table(obs(spark, sf, "row_key", "VmvCode", "SampleDateTime", "MeasurementValueNum"), path)
    rows = filters.by_date_range(loader.read_table(spark, path), "1996-03-01", "1998-02-10").where("VmvCode < 12")
    return rows.groupBy("VmvCode").agg(F.count(F.lit(1)).alias("records"), F.avg("MeasurementValueNum").alias("mean"))


@query("a16_remembered_base", "SELECT LabCode, count(*) AS records FROM obs GROUP BY 1")
def _(spark, sf):
    return loader.remember(obs(spark, sf, "LabCode")).groupBy("LabCode").agg(F.count(F.lit(1)).alias("records"))


@query("b26_standard_names", "SELECT StationNumber AS station_id, count(*) AS records FROM obs GROUP BY 1")
def _(spark, sf):
    rows = loader.standardize_column_names(obs(spark, sf, "StationNumber", "UnitCode"), {"station_id": ["STATIONNUMBER", "site"], "unit": ["unitcode"]})
    return rows.groupBy("station_id").agg(F.count("*").alias("records"))


@query("b27_resolved_roles", "SELECT LabCode, count(MeasurementValue) AS records FROM obs GROUP BY 1")
def _(spark, sf):
    rows = obs(spark, sf)
    lab, value = loader.resolve_column(rows, "lab"), loader.resolve_column(rows, "value")
    return rows.groupBy(lab).agg(F.count(value).alias("records"))


@query(
    "b28_type_partition",
    """SELECT CAST(count(VmvCode)+count(MethodDetectionLimit)+count(LabCode) AS BIGINT) AS numeric_cells,
    CAST(count(UnitCode)+count(Station) AS BIGINT) AS text_cells FROM obs""",
)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "MethodDetectionLimit", "LabCode", "UnitCode", "Station")
    cells = {"numeric_cells": loader.numeric_columns(rows), "text_cells": loader.text_columns(rows)}
    sums = [sum((F.count(c) for c in names[1:]), F.count(names[0])).alias(k) for k, names in cells.items()]
    return rows.agg(*sums)
