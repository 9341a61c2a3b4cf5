"""Audit rules and reports over the measurement view."""

from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.operators import audit, temporal
from hydroq.plans.catalog import obs, query, records

_Q = "MeasurementQualifier"
_NAME = "lower(VariableName)"
_BAD_UNITS = "(SELECT VmvCode FROM obs GROUP BY 1 HAVING count(DISTINCT coalesce(UnitCode,'nan')) > 1)"
_GAP = """(SELECT StationNumber, t FROM (SELECT StationNumber, t, lag(t) OVER (PARTITION BY StationNumber ORDER BY t) p FROM (SELECT DISTINCT StationNumber, SampleDateTime t FROM obs))
 WHERE floor((epoch(t) - epoch(p))/86400) > 60)"""
_M2 = f"""((VariableName = 'pH' AND (MeasurementValueNum < 0 OR MeasurementValueNum > 14)) OR (contains({_NAME}, 'temperature') AND (MeasurementValueNum < -5 OR MeasurementValueNum > 50))
 OR (contains({_NAME}, 'dissolved oxygen') AND (MeasurementValueNum < 0 OR MeasurementValueNum > 15)))"""
_C1 = "(SELECT SampleNumber FROM obs GROUP BY 1 HAVING 100.0*count(MeasurementValueNum)/(count(DISTINCT VariableName)+1) < 50)"
_C2 = "(SELECT StationNumber, year(SampleDateTime) FROM obs GROUP BY 1,2 HAVING count(DISTINCT SampleNumber) < 3)"
_T3 = f"(month(SampleDateTime) IN (6,7,8) AND MeasurementValueNum < 5 AND contains({_NAME}, 'temperature'))"
_FIRST = "row_key = min(row_key) OVER (PARTITION BY StationNumber, SampleDateTime)"
# one row per observation with a boolean per rule
_FLAGS = f"""WITH x AS (SELECT *, {_FIRST} AS first_of_visit, lag(SampleDateTime) OVER (PARTITION BY ProjectNumber ORDER BY row_key) AS arrived_before FROM obs),
 fl AS (SELECT *, VmvCode IN {_BAD_UNITS} AS s1, StationNumber IN (SELECT StationNumber FROM obs GROUP BY 1 HAVING greatest(count(DISTINCT LatitudeDecimalDegrees), count(DISTINCT LongitudeDecimalDegrees)) > 1) AS s2,
 (ProjectNumber IS NULL OR ProjectNumber = '') AS s3, coalesce(MeasurementFlag = 'S', false) AND ({_Q} IS NULL OR {_Q} = '') AS m1, coalesce({_M2}, false) AS m2,
 StationNumber NOT IN (SELECT StationNumber FROM obs WHERE VariableName IN ('pH','Dissolved Oxygen','Temperature')) AS m3,
 first_of_visit AND (StationNumber, SampleDateTime) IN {_GAP} AS t1, coalesce(SampleDateTime < arrived_before, false) AS t2, coalesce({_T3}, false) AS t3,
 SampleNumber IN {_C1} AS c1, (StationNumber, year(SampleDateTime)) IN {_C2} AS c2 FROM x),
 iss AS (SELECT *, list_filter([CASE WHEN s1 THEN 'S1:MultipleUnits' END, CASE WHEN s2 THEN 'S2:LocationVariation' END, CASE WHEN s3 THEN 'S3:MissingProject' END,
 CASE WHEN m1 THEN 'M1:SuspectNoQualifier' END, CASE WHEN m2 THEN 'M2:OutOfRange' END, CASE WHEN m3 THEN 'M3:SparseCore' END, CASE WHEN t1 THEN 'T1:FrequencyGap' END,
 CASE WHEN t2 THEN 'T2:TimeTravel' END, CASE WHEN t3 THEN 'T3:SeasonalAnomaly' END, CASE WHEN c1 THEN 'C1:LowCompleteness' END, CASE WHEN c2 THEN 'C2:InsufficientRepresentativeness' END],
 lambda z: z IS NOT NULL) AS issues FROM fl)
"""


@query("f50_s1_units", f"SELECT VmvCode, count(*) AS records FROM obs WHERE VmvCode IN {_BAD_UNITS} GROUP BY 1")
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "VariableName", "UnitCode", "MeasurementValue", "row_key")
    return rows.join(audit.codes_with_several_units(rows), "VmvCode", "left_semi").groupBy("VmvCode").agg(records())


@query(
    "f51_s2_location",
    """SELECT ProjectNumber, count(*) AS records FROM obs WHERE ProjectNumber IN
    (SELECT ProjectNumber FROM obs GROUP BY 1 HAVING greatest(count(DISTINCT LatitudeDecimalDegrees), count(DISTINCT LongitudeDecimalDegrees)) > 1) GROUP BY 1""",
)
def _(spark, sf):
    rows = obs(spark, sf, "ProjectNumber", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees")
    return rows.join(audit.moved_keys(rows, "ProjectNumber"), "ProjectNumber", "left_semi").groupBy("ProjectNumber").agg(records())


@query("f52_s3_missing_text", f"SELECT StationNumber, count(*) FILTER (ProjectNumber IS NULL OR ProjectNumber = '') AS no_project, count(*) FILTER ({_Q} IS NULL OR {_Q} = '') AS no_qualifier FROM obs GROUP BY 1")
def _(spark, sf):
    return obs(spark, sf, "StationNumber", "ProjectNumber", _Q).groupBy("StationNumber").agg(
        F.count_if(audit.missing_text()).alias("no_project"), F.count_if(audit.missing_text(_Q)).alias("no_qualifier")
    )


@query(
    "f53_m1_flag_without_qualifier",
    f"SELECT StationNumber, count(*) FILTER (MeasurementFlag = 'S' AND ({_Q} IS NULL OR {_Q} = '')) AS suspect, count(*) FILTER (MeasurementFlag = 'L' AND ({_Q} IS NULL OR {_Q} = '')) AS below FROM obs GROUP BY 1",
)
def _(spark, sf):
    return obs(spark, sf, "StationNumber", "MeasurementFlag", _Q).groupBy("StationNumber").agg(
        F.count_if(audit.flag_without_qualifier()).alias("suspect"), F.count_if(audit.flag_without_qualifier("L")).alias("below")
    )


@query("f54_m2_range", f"SELECT VariableName, count(*) AS records FROM obs WHERE {_M2} GROUP BY 1")
def _(spark, sf):
    return obs(spark, sf, "VariableName", "MeasurementValueNum").where(audit.out_of_range()).groupBy("VariableName").agg(records())


def _core(key):
    @query(
        f"f55_m3_core_{key.lower()}",
        f"""SELECT {key}, count(*) AS records FROM obs WHERE {key} NOT IN (SELECT {key} FROM obs WHERE VariableName IN ('pH','Dissolved Oxygen','Temperature')) GROUP BY 1""",
    )
    def _(spark, sf):
        rows = obs(spark, sf, key, "VariableName")
        return rows.join(audit.keys_without_core(rows, key), key, "left_semi").groupBy(key).agg(records())


_core("StationNumber")
_core("SampleNumber")


@query("f56_t1_gaps", f"SELECT StationNumber, SampleDateTime::VARCHAR AS SampleDateTime, min(row_key) AS row_key FROM obs WHERE (StationNumber, SampleDateTime) IN {_GAP} GROUP BY 1,2")
def _(spark, sf):
    return audit.rows_after_gap(obs(spark, sf, "StationNumber", "SampleDateTime", "row_key")).drop("gap_days")


@query(
    "f57_t2_time_travel",
    """SELECT ProjectNumber, count(*) AS reversals FROM (SELECT ProjectNumber, SampleDateTime t, lag(SampleDateTime) OVER (PARTITION BY ProjectNumber ORDER BY row_key) p FROM obs) WHERE t < p GROUP BY 1""",
)
def _(spark, sf):
    return temporal.time_travel(obs(spark, sf, "ProjectNumber", "SampleDateTime", "row_key", "arrival_block"), "ProjectNumber")


@query("f58_t3_cold_summer", f"SELECT StationNumber, VariableName, count(*) AS records FROM obs WHERE {_T3} GROUP BY 1,2")
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "VariableName", "SampleDateTime", "MeasurementValueNum")
    return rows.where(audit.cold_summer()).groupBy("StationNumber", "VariableName").agg(records())


@query("f59_c1_sample_completeness", f"SELECT SampleNumber, count(*) AS records FROM obs WHERE SampleNumber IN {_C1} GROUP BY 1")
def _(spark, sf):
    rows = obs(spark, sf, "SampleNumber", "VariableName", "MeasurementValueNum")
    return rows.join(audit.incomplete_samples(rows), "SampleNumber", "left_semi").groupBy("SampleNumber").agg(records())


@query("f60_c2_sparse_years", f"SELECT StationNumber, year(SampleDateTime)::INT AS \"Year\", count(*) AS records FROM obs WHERE (StationNumber, year(SampleDateTime)) IN {_C2} GROUP BY 1,2")
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "SampleDateTime", "SampleNumber").withColumn("Year", F.year("SampleDateTime"))
    return rows.join(audit.sparse_years(rows), ["StationNumber", "Year"], "left_semi").groupBy("StationNumber", "Year").agg(records())


def _audited(spark, sf):
    return audit.with_issues(obs(spark, sf, *audit.COLUMNS))


@query(
    "f61_row_report",
    _FLAGS + """SELECT row_key, StationNumber, Station, SampleDateTime::VARCHAR AS SampleDateTime, VariableName, MeasurementValueNum, MeasurementFlag, array_to_string(issues, ';') || ';' AS audit_issues,
    len(issues)::INT AS "IssueCount" FROM iss WHERE len(issues) > 0""",
)
def _(spark, sf):
    return audit.row_report(_audited(spark, sf))


_BY_RULE = " UNION ALL ".join(f"SELECT '{name}' AS \"Rule\", count(*) FILTER ({rule.lower()}) AS \"RecordCount\" FROM fl" for rule, name in S.AUDIT_RULES)


@query("f62_by_rule", _FLAGS + _BY_RULE)
def _(spark, sf):
    return audit.rule_counts(obs(spark, sf, *audit.COLUMNS))


def _by(name, key):
    @query(
        name,
        _FLAGS + f"""SELECT {key}, count(*) FILTER (len(issues) > 0) AS "IssueCount", count(*) FILTER (len(issues) = 0) AS "CompleteRecords", count(*) AS "TotalRecords",
        100.0*count(*) FILTER (len(issues) = 0)/count(*) AS "CompliancePct" FROM iss GROUP BY 1 HAVING count(*) FILTER (len(issues) > 0) > 0""",
        "CompliancePct",
    )
    def _(spark, sf):
        return audit.by_key(_audited(spark, sf), key)


_by("f63_by_station", "StationNumber")
_by("f63_by_project", "ProjectNumber")


@query("f64_overall", _FLAGS + "SELECT count(*) AS records, count(*) FILTER (len(issues) = 0) AS passed, 100.0*count(*) FILTER (len(issues) = 0)/count(*) AS compliance_pct FROM iss", "compliance_pct")
def _(spark, sf):
    return audit.overall(_audited(spark, sf))


@query(
    "f66_action_levels",
    _FLAGS + f""", r AS ({_BY_RULE}) SELECT *, CASE WHEN "Rule"[1:2] IN ('S1','T2') THEN 'ERROR' WHEN "Rule"[1:2] = 'T3' THEN 'INFO' ELSE 'WARNING' END AS severity,
    CASE "Rule"[1:2] WHEN 'S1' THEN 'critical' WHEN 'T2' THEN 'high' WHEN 'S3' THEN 'high' WHEN 'S2' THEN 'medium' WHEN 'M2' THEN 'medium' WHEN 'T1' THEN 'medium' WHEN 'C1' THEN 'none' ELSE 'low' END AS action_level FROM r""",
)
def _(spark, sf):
    return audit.action_levels(audit.rule_counts(obs(spark, sf, *audit.COLUMNS)))


@query(
    "f65b_limit_plausibility",
    """SELECT MethodCode, min(MeasurementValueNum) AS min_value, max(MethodDetectionLimit) AS max_limit, count(MeasurementValueNum) AS numbers,
    coalesce(max(MethodDetectionLimit) > min(MeasurementValueNum), false) AS limit_above_minimum FROM obs GROUP BY 1""",
)
def _(spark, sf):
    return audit.limit_plausibility(obs(spark, sf, "MethodCode", "MeasurementValueNum", "MethodDetectionLimit"))


@query(
    "f65c_below_limit_encoding",
    """WITH e AS (SELECT VariableName, count(*) FILTER (MeasurementValueNum = 0) AS zeros, count(*) FILTER (MeasurementValue IS NULL) AS nulls, count(*) FILTER (starts_with(MeasurementValue,'<')) AS less_than_texts,
    count(*) FILTER (MeasurementValueNum > 0 AND MeasurementValueNum < MethodDetectionLimit) AS small_positives FROM obs GROUP BY 1)
    SELECT *, ((zeros>0)::INT + (nulls>0)::INT + (less_than_texts>0)::INT + (small_positives>0)::INT)::INT AS encodings FROM e""",
)
def _(spark, sf):
    return audit.below_limit_encoding(obs(spark, sf, "VariableName", "MeasurementValue", "MeasurementValueNum", "MethodDetectionLimit"))


def _labs(name, key, sample):
    @query(
        name,
        f"""SELECT {key} AS SampleNumber, count(DISTINCT LabCode) AS labs, count(*) FILTER (LabCode IS NULL) AS unnamed FROM obs GROUP BY 1 HAVING count(DISTINCT LabCode) <> 1 OR count(*) FILTER (LabCode IS NULL) > 0""",
    )
    def _(spark, sf):
        return audit.samples_with_lab_issue(obs(spark, sf, sample, "LabCode").withColumnRenamed(sample, "SampleNumber"))


_labs("f65d_one_lab_per_sample", "SampleNumber", "SampleNumber")
_labs("f65d_one_lab_per_basin", "ContinentalRiverBasinCode", "ContinentalRiverBasinCode")


@query(
    "f65e_lab_stability",
    f"""WITH y AS (SELECT LabCode, year(SampleDateTime)::INT AS "Year", count(*) AS records, count(*) FILTER ({_M2}) AS out_of_range, count(*) FILTER ({_Q} IS NOT NULL AND {_Q} <> '') AS flagged FROM obs GROUP BY 1,2),
    p AS (SELECT *, 100.0*out_of_range/records AS outlier_pct, 100.0*flagged/records AS flagged_pct FROM y)
    SELECT *, flagged_pct - lag(flagged_pct) OVER w AS flagged_change, coalesce(abs(flagged_pct - lag(flagged_pct) OVER w) > 0.5, false) AS jump FROM p WINDOW w AS (PARTITION BY LabCode ORDER BY "Year")""",
    "outlier_pct flagged_pct flagged_change",
)
def _(spark, sf):
    return audit.lab_stability(obs(spark, sf, "LabCode", "SampleDateTime", "VariableName", "MeasurementValueNum", _Q), 0.5)


_CLASSES = ["UnitCode", "MethodDetectionLimit", "MeasurementFlag", "MeasurementValueNum"]


@query(
    "f67_share_classes",
    "SELECT *, CASE WHEN filled_pct >= 95 THEN 'excellent' WHEN filled_pct >= 85 THEN 'good' ELSE 'poor' END AS completeness, CASE WHEN 100-filled_pct >= 50 THEN 'critical' WHEN 100-filled_pct >= 30 THEN 'high'"
    " WHEN 100-filled_pct >= 15 THEN 'moderate' WHEN 100-filled_pct >= 5 THEN 'low' ELSE 'good' END AS missing FROM ("
    + " UNION ALL ".join(f"SELECT LabCode, '{c}' AS \"column\", 100.0*count({c})/count(*) AS filled_pct FROM obs GROUP BY 1" for c in _CLASSES) + ")",
    "filled_pct",
)
def _(spark, sf):
    return audit.share_classes(obs(spark, sf, "LabCode", *_CLASSES), ["LabCode"], _CLASSES)


@query(
    "f67_sampling_frequency",
    """SELECT *, CASE WHEN samples_per_year >= 12 THEN 'good' WHEN samples_per_year >= 4 THEN 'moderate' WHEN samples_per_year >= 1 THEN 'poor' ELSE 'none' END AS frequency FROM
    (SELECT StationNumber, count(DISTINCT SampleNumber) AS samples, count(DISTINCT year(SampleDateTime)) AS years, count(DISTINCT SampleNumber)::DOUBLE/count(DISTINCT year(SampleDateTime)) AS samples_per_year FROM obs GROUP BY 1)""",
    "samples_per_year",
)
def _(spark, sf):
    return audit.sampling_frequency_class(obs(spark, sf, "StationNumber", "SampleNumber", "SampleDateTime"))


@query(
    "f67_below_limit_alert",
    """SELECT *, CASE WHEN below_pct >= 90 THEN 'critical' WHEN below_pct >= 70 THEN 'high' WHEN below_pct >= 50 THEN 'moderate' ELSE 'none' END AS alert FROM (SELECT VmvCode,
    100.0*count(*) FILTER (starts_with(MeasurementValue,'<') OR MeasurementFlag = 'L' OR MeasurementValueNum < MethodDetectionLimit)/count(*) AS below_pct FROM obs GROUP BY 1)""",
    "below_pct",
)
def _(spark, sf):
    return audit.below_limit_class(obs(spark, sf, "VmvCode", "MeasurementValue", "MeasurementFlag", "MethodDetectionLimit"))


@query(
    "c18_trend_filter_set",
    f"""WITH g AS (SELECT StationNumber, max(gap) gap FROM (SELECT StationNumber, floor((epoch(t)-epoch(lag(t) OVER (PARTITION BY StationNumber ORDER BY t)))/86400) gap FROM
    (SELECT DISTINCT StationNumber, SampleDateTime t FROM obs)) GROUP BY 1),
    f AS (SELECT StationNumber FROM (SELECT StationNumber, year(SampleDateTime) y, count(DISTINCT SampleNumber) n FROM obs GROUP BY 1,2) GROUP BY 1 HAVING count(*) >= 3 AND min(n) >= 3)
    SELECT o.StationNumber, count(*) AS records FROM (SELECT *, {_FIRST} AS first_of_visit FROM obs) o JOIN f USING (StationNumber) JOIN g USING (StationNumber) WHERE coalesce(gap,0) <= 120
    AND NOT (first_of_visit AND (o.StationNumber, SampleDateTime) IN {_GAP}) AND (o.StationNumber, year(SampleDateTime)) NOT IN {_C2} AND VmvCode NOT IN {_BAD_UNITS} GROUP BY 1""",
)
def _(spark, sf):
    rows = obs(spark, sf, "row_key", "StationNumber", "SampleDateTime", "SampleNumber", "VmvCode", "VariableName", "UnitCode", "MeasurementValue")
    return audit.trend_filter_set(rows).groupBy("StationNumber").agg(records())


@query("c18_snapshot_filter_set", f"SELECT StationNumber, count(*) AS records FROM obs WHERE SampleNumber NOT IN {_C1} GROUP BY 1")
def _(spark, sf):
    return audit.snapshot_filter_set(obs(spark, sf, "StationNumber", "SampleNumber", "VariableName", "MeasurementValueNum")).groupBy("StationNumber").agg(records())
