"""Integrity, coverage and temporal queries over the measurement view."""

from pyspark.sql import functions as F

from hydroq.functions import labels as L
from hydroq.operators import integrity, ordered, quality, temporal
from hydroq.plans.catalog import obs, query, records
from hydroq.sources.test_tables import table

_Q = "MeasurementQualifier"


def _fd(name, keys, columns):
    """One dependency check, all figures in one row."""
    keys = [keys] if isinstance(keys, str) else keys
    number = f"greatest({', '.join(f'count(DISTINCT {c})' for c in columns)})"
    label = f"{'+'.join(keys)} -> {','.join(columns)}"

    @query(
        name,
        f"""SELECT '{label}' AS "check", count(*) AS keys, count(*) FILTER (n = 1) AS consistent, count(*) FILTER (n > 1) AS violations,
        avg(n) AS avg_n, min(n) AS min_n, max(n) AS max_n FROM (SELECT {number} AS n FROM obs WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)})""",
        "avg_n",
    )
    def _(spark, sf):
        return integrity.check_fd(obs(spark, sf, *keys, *columns), keys, columns, label)


_PLACE = ["LatitudeDecimalDegrees", "LongitudeDecimalDegrees"]
_fd("f01_station_name", "StationNumber", ["Station"])
_fd("f02_station_location", "StationNumber", _PLACE)
_fd("f03_station_projects", "StationNumber", ["ProjectNumber"])
_fd("f04_project_samples", "ProjectNumber", ["SampleNumber"])
_fd("f05_sample_datetime", "SampleNumber", ["SampleDateTime"])
_fd("f06_sample_variables", "SampleNumber", ["VmvCode"])
_fd("f07_vmv_unit", "VmvCode", ["UnitCode"])
_fd("f08_vmv_limit", "VmvCode", ["MethodDetectionLimit"])
_fd("f08b_sample_lab", "SampleNumber", ["LabCode"])
_fd("f08b_vmv_method", "VmvCode", ["MethodCode"])
_fd("f08b_method_limit", "MethodCode", ["MethodDetectionLimit"])
_fd("f08b_lab_location", "LabCode", _PLACE)
_fd("f49_variable_unit", "VariableName", ["UnitCode"])
_fd("f65a_method_consistency", ["VariableCode", "MethodCode"], ["MethodDetectionLimit"])


@query(
    "f09_cardinality_report",
    """SELECT StationNumber, count(DISTINCT Station) AS "UniqueNames", count(DISTINCT (LatitudeDecimalDegrees, LongitudeDecimalDegrees)) AS "UniqueLocations",
    count(DISTINCT ProjectNumber) AS "ProjectCount", count(DISTINCT SampleNumber) AS "SampleCount", count(*) AS "RecordCount" FROM obs GROUP BY 1""",
)
def _(spark, sf):
    return integrity.cardinality_report(obs(spark, sf, "StationNumber", "Station", *_PLACE, "ProjectNumber", "SampleNumber"))


@query(
    "f10_location_violations",
    """SELECT ProjectNumber, LatitudeDecimalDegrees, LongitudeDecimalDegrees, count(*) AS "RecordCount" FROM obs WHERE ProjectNumber IN
    (SELECT ProjectNumber FROM obs GROUP BY 1 HAVING greatest(count(DISTINCT LatitudeDecimalDegrees), count(DISTINCT LongitudeDecimalDegrees)) > 1) GROUP BY 1,2,3""",
)
def _(spark, sf):
    return integrity.location_violations(obs(spark, sf, "ProjectNumber", *_PLACE), "ProjectNumber")


@query("f11_station_project", "SELECT StationNumber, ProjectNumber, count(*) AS n FROM obs GROUP BY 1,2")
def _(spark, sf):
    return quality.crosstab(obs(spark, sf, "StationNumber", "ProjectNumber"), "StationNumber", "ProjectNumber")


_REG = """SELECT VmvCode, arg_min(VariableCode, row_key) AS VariableCode, arg_min(VariableName, row_key) AS VariableName, arg_min(MethodCode, row_key) AS MethodCode,
 array_to_string(list_sort(list(DISTINCT coalesce(UnitCode, 'nan'))), '; ') AS "UniquUnits",
 array_to_string(list_sort(list(DISTINCT coalesce(MethodDetectionLimit::VARCHAR, 'nan'))), '; ') AS "UniqueMDLs", count(MeasurementValue) AS "RecordCount",
 count(DISTINCT coalesce(UnitCode, 'nan'))::INT AS "UnitCount", count(DISTINCT coalesce(MethodDetectionLimit::VARCHAR, 'nan'))::INT AS "MDLCount" FROM obs GROUP BY 1"""
_REG_COLS = ("VmvCode", "VariableCode", "VariableName", "MethodCode", "UnitCode", "MethodDetectionLimit", "MeasurementValue", "row_key")


@query("f12_vmv_registry", f'SELECT *, "UnitCount" = 1 AND "MDLCount" = 1 AS "IsConsistent" FROM ({_REG})')
def _(spark, sf):
    return integrity.vmv_registry(obs(spark, sf, *_REG_COLS))


@query("f13_vmv_violations", f'SELECT VmvCode, VariableName, "UnitCount", "MDLCount", "RecordCount", "UniquUnits", "UniqueMDLs" FROM ({_REG}) WHERE NOT ("UnitCount" = 1 AND "MDLCount" = 1)')
def _(spark, sf):
    reg = integrity.vmv_registry(obs(spark, sf, *_REG_COLS))
    return reg.where(~F.col("IsConsistent")).select("VmvCode", "VariableName", "UnitCount", "MDLCount", "RecordCount", "UniquUnits", "UniqueMDLs")


@query("f14_station_variable", "SELECT StationNumber, VariableName, count(*) AS n FROM obs GROUP BY 1,2")
def _(spark, sf):
    return integrity.station_variable_counts(obs(spark, sf, "StationNumber", "VariableName"))


@query(
    "f15_station_summary",
    """SELECT StationNumber, arg_min(Station, row_key) AS "StationName", count(*) AS "MeasurementCount", count(DISTINCT VariableName) AS "UniqueVariables",
    min(SampleDateTime)::VARCHAR AS "DateRangeStart", max(SampleDateTime)::VARCHAR AS "DateRangeEnd" FROM obs GROUP BY 1""",
)
def _(spark, sf):
    return integrity.station_summary(obs(spark, sf, "StationNumber", "Station", "VariableName", "SampleDateTime", "row_key"))


@query("f16_variable_popularity", 'SELECT VariableName, count(MeasurementValue) AS "TotalMeasurements", count(DISTINCT StationNumber) AS "StationCount" FROM obs GROUP BY 1')
def _(spark, sf):
    return integrity.variable_popularity(obs(spark, sf, "VariableName", "MeasurementValue", "StationNumber"))


_COVER = ("StationNumber", "Station", "VariableName", "MeasurementValue", "SampleDateTime")


@query(
    "f17_coverage_data",
    """SELECT StationNumber, Station, VariableName, count(MeasurementValue) AS "MeasurementCount", min(SampleDateTime)::VARCHAR AS "DateMin", max(SampleDateTime)::VARCHAR AS "DateMax" FROM obs GROUP BY 1,2,3""",
)
def _(spark, sf):
    return integrity.coverage_data(obs(spark, sf, *_COVER))


_SHOWN = ["pH", "Dissolved Oxygen", "Temperature", "TURBIDITY"]


@query(
    "f17_coverage_matrix",
    "SELECT StationNumber, " + ", ".join(f"count(MeasurementValue) FILTER (VariableName = '{v}')::DOUBLE AS \"{v}\"" for v in _SHOWN) + " FROM obs GROUP BY 1",
)
def _(spark, sf):
    return integrity.coverage_matrix(obs(spark, sf, *_COVER), _SHOWN)


_PROFILE = ("StationNumber", "Station", *_PLACE, "VariableName", "SampleNumber", "ProjectNumber", "SampleDateTime", "row_key")
_LEVEL = """CASE WHEN v <= 3 THEN 'Minimal (<3 vars)' WHEN v <= 7 THEN 'Basic (3-7 vars)' WHEN v <= 12 THEN 'Moderate (7-12 vars)' WHEN v <= 100 THEN 'Comprehensive (12+ vars)' END"""


@query(
    "f18_station_profiles",
    f"""SELECT StationNumber, arg_min(Station,row_key) AS Station, arg_min(LatitudeDecimalDegrees,row_key) AS "Latitude", arg_min(LongitudeDecimalDegrees,row_key) AS "Longitude",
    count(*) AS "TotalMeasurements", count(DISTINCT VariableName) AS "UniqueVariables", count(DISTINCT SampleNumber) AS "UniqueSamples", count(DISTINCT ProjectNumber) AS "UniqueProjects",
    min(SampleDateTime)::VARCHAR AS "DateRangeStart", max(SampleDateTime)::VARCHAR AS "DateRangeEnd", count(DISTINCT year(SampleDateTime)) AS "YearsOfData",
    array_to_string(list_sort(list(DISTINCT VariableName)), ', ') AS "VariableList", {_LEVEL.replace('v <=', 'count(DISTINCT VariableName) <=')} AS "CoverageLevel",
    100.0*count(DISTINCT VariableName)/(SELECT count(DISTINCT VariableName) FROM obs) AS "VariableDiversityPct" FROM obs GROUP BY 1""",
    "VariableDiversityPct",
)
def _(spark, sf):
    return integrity.station_profiles(obs(spark, sf, *_PROFILE))


@query(
    "f19_coverage_summary",
    f"""SELECT (i-1)::INT AS level_order, l AS "CoverageLevel", (SELECT count(*) FROM (SELECT StationNumber, count(DISTINCT VariableName) v FROM obs GROUP BY 1) WHERE {_LEVEL} = l) AS stations
    FROM (SELECT unnest([1,2,3,4]) i, unnest(['Minimal (<3 vars)','Basic (3-7 vars)','Moderate (7-12 vars)','Comprehensive (12+ vars)']) l)""",
)
def _(spark, sf):
    return integrity.coverage_summary(integrity.station_profiles(obs(spark, sf, *_PROFILE)))


@query(
    "f20_parameter_popularity",
    """SELECT VariableName, count(MeasurementValue) AS "TotalMeasurements", count(DISTINCT StationNumber) AS "StationCount", min(SampleDateTime)::VARCHAR AS "DateMin", max(SampleDateTime)::VARCHAR AS "DateMax",
    100.0*count(DISTINCT StationNumber)/(SELECT count(DISTINCT StationNumber) FROM obs) AS "StationCoverage" FROM obs GROUP BY 1""",
    "StationCoverage",
)
def _(spark, sf):
    return integrity.parameter_popularity(obs(spark, sf, "VariableName", "MeasurementValue", "StationNumber", "SampleDateTime"))


@query(
    "f21_station_extent",
    """SELECT StationNumber, v AS "UniqueVariables", n AS "TotalMeasurements", CASE WHEN v >= 90 THEN 'complete' WHEN v < 88 THEN 'sparse' END AS extent
    FROM (SELECT StationNumber, count(DISTINCT VariableName) v, count(*) n FROM obs GROUP BY 1) WHERE v >= 90 OR v < 88""",
)
def _(spark, sf):
    return integrity.station_extent(integrity.station_profiles(obs(spark, sf, *_PROFILE)), 90, 88)


_GAPS = """WITH d AS (SELECT DISTINCT StationNumber, SampleDateTime AS t FROM obs),
 g AS (SELECT StationNumber, t, lag(t) OVER w AS p, row_number() OVER w AS k, floor((epoch(t) - epoch(lag(t) OVER w))/86400)::BIGINT AS gap FROM d WINDOW w AS (PARTITION BY StationNumber ORDER BY t))"""
_COVERAGE = """SELECT r.*, "DateRangeStart"::VARCHAR AS "DateRangeStart", "DateRangeEnd"::VARCHAR AS "DateRangeEnd", floor((epoch("DateRangeEnd")-epoch("DateRangeStart"))/86400)/365.25 AS "YearsSpanned",
 CASE WHEN "AvgGapDays" < 10 THEN 'Weekly or more' WHEN "AvgGapDays" < 35 THEN 'Monthly' WHEN "AvgGapDays" < 100 THEN 'Quarterly' ELSE 'Annual or less' END AS "EstimatedFrequency", "AvgGapDays", "MaxGapDays", "GapsOver60Days"
 FROM (SELECT StationNumber, arg_min(Station,row_key) AS Station, count(DISTINCT SampleNumber) AS "SampleCount" FROM obs GROUP BY 1 HAVING count(*) >= 2) r JOIN
 (SELECT StationNumber, min(t) AS "DateRangeStart", max(t) AS "DateRangeEnd", avg(gap) FILTER ({f}) AS "AvgGapDays", max(gap) FILTER ({f}) AS "MaxGapDays", count(*) FILTER ({f} AND gap > 60) AS "GapsOver60Days" FROM g GROUP BY 1) x USING (StationNumber)"""
_TEMPORAL = ("StationNumber", "Station", "SampleNumber", "SampleDateTime", "row_key")


@query("f36_temporal_coverage", _GAPS + _COVERAGE.format(f="gap >= 0"), "YearsSpanned AvgGapDays")
def _(spark, sf):
    return temporal.coverage_by_station(obs(spark, sf, *_TEMPORAL))


@query("f36_temporal_coverage_compat", _GAPS + _COVERAGE.format(f="k > 2"), "YearsSpanned AvgGapDays")
def _(spark, sf):
    return temporal.coverage_by_station(obs(spark, sf, *_TEMPORAL), compat=True)


@query(
    "b25_frequency_class",
    _GAPS + """SELECT frequency, count(*) AS stations FROM (SELECT StationNumber, CASE WHEN avg(gap) < 10 THEN 'Weekly or more' WHEN avg(gap) < 35 THEN 'Monthly' WHEN avg(gap) < 100 THEN 'Quarterly' ELSE 'Annual or less' END AS frequency
    FROM g GROUP BY 1) GROUP BY 1""",
)
def _(spark, sf):
    gaps = temporal.gaps(obs(spark, sf, "StationNumber", "SampleDateTime", "row_key"))
    per = gaps.groupBy("StationNumber").agg(F.avg("gap_days").alias("avg_gap"))
    return per.groupBy(L.frequency_class("avg_gap").alias("frequency")).agg(records("stations"))


@query(
    "f37_seasonal_sampling",
    """SELECT quarter(SampleDateTime)::INT AS "Quarter", count(*) AS "SampleCount", ['Q1 (Jan-Mar)','Q2 (Apr-Jun)','Q3 (Jul-Sep)','Q4 (Oct-Dec)'][quarter(SampleDateTime)] AS "QuarterName",
    100.0*count(*)/(SELECT count(*) FROM obs) AS "SamplePct" FROM obs GROUP BY quarter(SampleDateTime)""",
    "SamplePct",
)
def _(spark, sf):
    return temporal.seasonal_sampling(obs(spark, sf, "SampleDateTime"))


@query(
    "f38_monthly_distribution",
    """SELECT month(SampleDateTime)::INT AS "Month", count(DISTINCT SampleNumber) AS "UniqueSamples", count(MeasurementValue) AS "TotalMeasurements",
    ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(SampleDateTime)] AS "MonthName", 100.0*count(MeasurementValue)/(SELECT count(*) FROM obs) AS "SharePct" FROM obs GROUP BY month(SampleDateTime)""",
    "SharePct",
)
def _(spark, sf):
    return temporal.monthly_distribution(obs(spark, sf, "SampleDateTime", "SampleNumber", "MeasurementValue"))


@query(
    "f39_time_travel",
    """SELECT StationNumber, count(*) AS reversals FROM (SELECT StationNumber, SampleDateTime t, lag(SampleDateTime) OVER (PARTITION BY StationNumber ORDER BY row_key) p FROM obs) WHERE t < p GROUP BY 1""",
)
def _(spark, sf):
    return temporal.time_travel(obs(spark, sf, "StationNumber", "SampleDateTime", "row_key", "arrival_block"))


@query("f40_year_coverage", 'SELECT year(SampleDateTime)::INT AS "Year", StationNumber, count(DISTINCT SampleNumber) AS "UniqueSamples", count(MeasurementValue) AS "MeasurementCount" FROM obs GROUP BY 1,2')
def _(spark, sf):
    return temporal.year_coverage(obs(spark, sf, "SampleDateTime", "StationNumber", "SampleNumber", "MeasurementValue"))


@query(
    "f40_year_coverage_wide",
    "SELECT StationNumber, " + ", ".join(f'count(MeasurementValue) FILTER (year(SampleDateTime)={y}) AS "{y}"' for y in range(1995, 2002)) + " FROM obs GROUP BY 1",
)
def _(spark, sf):
    return temporal.year_coverage_wide(obs(spark, sf, "SampleDateTime", "StationNumber", "SampleNumber", "MeasurementValue"), range(1995, 2002))


@query(
    "f41_temporal_summary",
    """SELECT year(SampleDateTime)::INT AS "Year", count(*) AS records, (SELECT min(SampleDateTime)::VARCHAR FROM obs) AS span_start, (SELECT max(SampleDateTime)::VARCHAR FROM obs) AS span_end,
    (SELECT count(DISTINCT year(SampleDateTime)) FROM obs) AS years FROM obs GROUP BY 1""",
)
def _(spark, sf):
    return temporal.temporal_summary(obs(spark, sf, "SampleDateTime"))


_UNITS = """(SELECT VmvCode, arg_min(VariableName, row_key) AS VariableName, coalesce(array_to_string(list_sort(list(DISTINCT UnitCode) FILTER (UnitCode IS NOT NULL)), '; '), '') AS "Units",
 count(DISTINCT coalesce(UnitCode, 'nan')) AS "UniqueUnitCount", count(MeasurementValue) AS "TotalRecords" FROM obs GROUP BY 1)"""
_UNIT_COLS = ("VmvCode", "VariableName", "UnitCode", "MeasurementValue", "row_key")


@query("f42_unit_report", f'SELECT *, "UniqueUnitCount" = 1 AS "IsConsistent" FROM {_UNITS}')
def _(spark, sf):
    return integrity.unit_report(obs(spark, sf, *_UNIT_COLS))


@query(
    "f43_unit_violations",
    f"""SELECT VmvCode, VariableName, UnitCode, "RecordsWithThisUnit", "StationCount", "ProjectCount" FROM (SELECT VmvCode, UnitCode, count(UnitCode) AS "RecordsWithThisUnit",
    count(DISTINCT StationNumber) FILTER (UnitCode IS NOT NULL) AS "StationCount", count(DISTINCT ProjectNumber) FILTER (UnitCode IS NOT NULL) AS "ProjectCount" FROM obs GROUP BY 1,2)
    JOIN {_UNITS} USING (VmvCode) WHERE "UniqueUnitCount" > 1""",
)
def _(spark, sf):
    return integrity.unit_violations(obs(spark, sf, *_UNIT_COLS, "StationNumber", "ProjectNumber"))


@query(
    "f44_unit_conversion_guide",
    """SELECT 'pH' AS "Variable", array_to_string(u, '; ') AS "UnitsFound", 'Harmonize to canonical unit' AS "ConversionNeeded", 'Use pH units as canonical' AS "Recommendation"
    FROM (SELECT list_sort(list(DISTINCT coalesce(UnitCode,'nan'))) u FROM obs WHERE contains(lower(VariableName), 'ph')) WHERE len(u) > 1""",
)
def _(spark, sf):
    return integrity.unit_conversion_guide(obs(spark, sf, "VariableName", "UnitCode"))


@query(
    "f44_unit_conversion_guide_word",
    """SELECT 'pH' AS "Variable", array_to_string(u, '; ') AS "UnitsFound", 'Harmonize to canonical unit' AS "ConversionNeeded", 'Use pH units as canonical' AS "Recommendation"
    FROM (SELECT list_sort(list(DISTINCT coalesce(UnitCode,'nan'))) u FROM obs WHERE regexp_matches(lower(VariableName), '\\bph\\b')) WHERE len(u) > 1""",
)
def _(spark, sf):
    return integrity.unit_conversion_guide(obs(spark, sf, "VariableName", "UnitCode"), "word")


@query(
    "f45_affected_records",
    f"""SELECT count(*) FILTER (VmvCode IN (SELECT VmvCode FROM {_UNITS} WHERE "UniqueUnitCount" > 1)) AS affected, count(*) AS total,
    100.0*count(*) FILTER (VmvCode IN (SELECT VmvCode FROM {_UNITS} WHERE "UniqueUnitCount" > 1))/count(*) AS affected_pct FROM obs""",
    "affected_pct",
)
def _(spark, sf):
    return integrity.affected_records(obs(spark, sf, "VmvCode", "UnitCode"))


@query(
    "f46_code_description_pairs",
    f"SELECT {_Q}, MeasurementQualifierDescription, count(*) AS \"Frequency\" FROM obs WHERE {_Q} IS NOT NULL AND MeasurementQualifierDescription IS NOT NULL GROUP BY 1,2",
)
def _(spark, sf):
    return integrity.code_description_pairs(obs(spark, sf, _Q, "MeasurementQualifierDescription"))


@query(
    "f47_completeness_by_code",
    f"""SELECT {_Q}, arg_min(coalesce(MeasurementQualifierDescription,'-'), row_key) AS description, count(*) AS records, count(MeasurementValue) AS has_value, count(SampleComment) AS has_sample_comment,
    count(MeasurementComment) AS has_measurement_comment, count(MeasurementFlag) AS has_flag FROM obs WHERE {_Q} IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    rows = obs(spark, sf, _Q, "MeasurementQualifierDescription", "MeasurementValue", "SampleComment", "MeasurementComment", "MeasurementFlag", "row_key")
    return integrity.completeness_by_code(rows).na.fill("-", ["description"])


@query(
    "f48_code_details",
    f"""SELECT {_Q}, sum(n)::BIGINT AS frequency, sum(d)::BIGINT AS described, min(lo) AS value_min, max(hi) AS value_max,
    coalesce(array_to_string(list_sort(list(MeasurementFlag || '=' || n) FILTER (MeasurementFlag IS NOT NULL)), '; '), '') AS flags
    FROM (SELECT {_Q}, MeasurementFlag, count(*) n, count(MeasurementQualifierDescription) d, min(MeasurementValueNum) lo, max(MeasurementValueNum) hi FROM obs WHERE {_Q} IS NOT NULL GROUP BY 1,2) GROUP BY 1""",
)
def _(spark, sf):
    return integrity.code_details(obs(spark, sf, _Q, "MeasurementFlag", "MeasurementQualifierDescription", "MeasurementValueNum"))


@query(
    "g01_visit_gaps",
    _GAPS + "SELECT StationNumber, t::VARCHAR AS SampleDateTime, p::VARCHAR AS previous, coalesce(gap, -1) AS gap_days FROM g",
)
def _(spark, sf):
    gaps = temporal.gaps(obs(spark, sf, "StationNumber", "SampleDateTime", "row_key"))
    return gaps.select("StationNumber", "SampleDateTime", "previous", F.coalesce("gap_days", F.lit(-1)).alias("gap_days"))


_EVENT_GAPS = "SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM (SELECT DISTINCT user_id, ts FROM events)"


@query(
    "g01_event_gaps",
    f"""SELECT user_id, count(*) AS gaps, max(floor((epoch(ts)-epoch(p))))::BIGINT AS max_gap FROM ({_EVENT_GAPS}) WHERE p IS NOT NULL GROUP BY 1""",
    raw_sql=True,
)
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts").distinct()
    looked = ordered.with_previous(events, ["user_id"], "ts", {"ts": "p"}, ordered.day_block("ts"))
    # timestamps carry fractions, so the elapsed time is taken in microseconds
    micros = F.expr("timestampdiff(MICROSECOND, p, ts)")
    return looked.where("p is not null").groupBy("user_id").agg(records("gaps"), F.max(F.floor(micros / 1000000)).alias("max_gap"))


@query(
    "g02_running_share",
    """SELECT VmvCode, n AS records, 100.0*sum(n) OVER (ORDER BY n DESC, VmvCode ROWS UNBOUNDED PRECEDING)/sum(n) OVER () AS running_pct FROM (SELECT VmvCode, count(*) n FROM obs GROUP BY 1)""",
    "running_pct",
)
def _(spark, sf):
    counts = obs(spark, sf, "VmvCode").groupBy("VmvCode").agg(records()).withColumn("_k", F.struct(-F.col("records"), "VmvCode"))
    run = ordered.running_totals(counts, [], "_k", {"records": "before"}, ordered.value_block(-F.col("records").cast("double")))
    return run.select("VmvCode", "records", (100.0 * (F.col("before") + F.col("records")) / F.col("before_all")).alias("running_pct"))


_CLUSTERS = """, c AS (SELECT *, sum(CASE WHEN epoch(t) - epoch(p) > 31*86400 THEN 1 ELSE 0 END) OVER (PARTITION BY StationNumber ORDER BY t) AS cluster FROM g),
 r AS (SELECT StationNumber, SampleDateTime AS t, count(*) n FROM obs GROUP BY 1,2)
 SELECT StationNumber, cluster::BIGINT AS cluster, min(t)::VARCHAR AS start, max(t)::VARCHAR AS "end", count(*) AS visits, sum(n)::BIGINT AS records{x},
 StationNumber || '_' || cluster::BIGINT || '_' || strftime(min(t), '%Y%m%d') AS sample_id FROM c JOIN r USING (StationNumber, t) GROUP BY 1,2{g}"""


@query("g03_sample_clusters", _GAPS + _CLUSTERS.format(x="", g=""))
def _(spark, sf):
    return temporal.sample_clusters(obs(spark, sf, "StationNumber", "SampleDateTime", "row_key"), 31)


@query("g03_sample_clusters_compat", _GAPS + _CLUSTERS.format(x=", CAST(t AS DATE)::VARCHAR AS day", g=", CAST(t AS DATE)"))
def _(spark, sf):
    return temporal.sample_clusters(obs(spark, sf, "StationNumber", "SampleDateTime", "row_key"), 31, compat=True)


@query(
    "g04_share_of_total",
    "SELECT LabCode, count(*) AS records, 100.0*count(*)/(SELECT count(*) FROM obs) AS share_pct FROM obs GROUP BY 1",
    "share_pct",
)
def _(spark, sf):
    rows = obs(spark, sf, "LabCode")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.groupBy("LabCode").agg(records()).withColumn("share_pct", 100.0 * F.col("records") / total)


@query(
    "g05_column_max",
    """WITH c AS (SELECT StationNumber, VmvCode, count(*) n FROM obs GROUP BY 1,2) SELECT *, n::DOUBLE / max(n) OVER (PARTITION BY VmvCode) AS of_max FROM c""",
    "of_max",
)
def _(spark, sf):
    cells = quality.crosstab(obs(spark, sf, "StationNumber", "VmvCode"), "StationNumber", "VmvCode")
    most = cells.groupBy("VmvCode").agg(F.max("n").alias("most"))
    return cells.join(most, "VmvCode").select("StationNumber", "VmvCode", "n", (F.col("n") / F.col("most")).alias("of_max"))


@query(
    "g06_rank_by_total",
    "SELECT StationNumber, n AS records, dense_rank() OVER (ORDER BY n DESC) AS position FROM (SELECT StationNumber, count(*) n FROM obs GROUP BY 1)",
)
def _(spark, sf):
    counts = obs(spark, sf, "StationNumber").groupBy("StationNumber").agg(records())
    dist = ordered.distribution(counts.withColumn("v", -F.col("records").cast("double")), [], "v")
    ranks = dist.select((-F.col("v")).cast("long").alias("records"), (F.col("rank") + 1).alias("position"))
    return counts.join(ranks, "records")


@query(
    "g07_rolling_years",
    """WITH y AS (SELECT StationNumber, VmvCode, year(SampleDateTime)::INT AS "Year", avg(MeasurementValueNum) AS year_mean FROM obs GROUP BY 1,2,3)
    SELECT *, avg(year_mean) OVER (PARTITION BY StationNumber, VmvCode ORDER BY "Year" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_mean FROM y""",
    "year_mean rolling_mean",
)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "VmvCode", "SampleDateTime", "MeasurementValueNum")
    return temporal.rolling_year_mean(rows)
