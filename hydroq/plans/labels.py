"""Labels, classes and period keys over the measurement view."""

from pyspark.sql import functions as F

from hydroq.functions import labels as L
from hydroq.functions.values import to_number
from hydroq.operators import dimensions, units
from hydroq.plans.catalog import obs, query, records

_FIRST = "(SELECT VmvCode, arg_min(VariableName, row_key) AS name, arg_min(VariableCode, row_key) AS code FROM obs GROUP BY 1)"


def _variables(spark, sf):
    return obs(spark, sf, "VmvCode", "VariableCode", "VariableName", "row_key")


@query("b01_variable_map", f"SELECT VmvCode, name AS VariableName FROM {_FIRST}")
def _(spark, sf):
    return dimensions.variable_map(_variables(spark, sf))


@query("b02_display_label", f"SELECT o.VmvCode || ' - ' || f.name AS label, count(*) AS records FROM obs o JOIN {_FIRST} f USING (VmvCode) GROUP BY 1")
def _(spark, sf):
    rows = _variables(spark, sf)
    counts = rows.groupBy("VmvCode").agg(records())
    return counts.join(dimensions.variable_labels(rows), "VmvCode", "left").select(
        F.coalesce("label", F.col("VmvCode").cast("string")).alias("label"), "records"
    )


@query("b03_label_list", f"SELECT VmvCode || ' - ' || name AS label FROM {_FIRST} ORDER BY VmvCode")
def _(spark, sf):
    return dimensions.variable_labels(_variables(spark, sf)).orderBy("VmvCode").select("label")


@query("b04_code_of_label", f"SELECT VmvCode || ' - ' || name AS label, CAST(VmvCode AS VARCHAR) AS code FROM {_FIRST}")
def _(spark, sf):
    return dimensions.variable_labels(_variables(spark, sf)).select("label", L.code_of_label("label").alias("code"))


@query("b05_variable_key", f"SELECT VmvCode, name || ' (' || VmvCode || '-' || code || ')' AS variable_label FROM {_FIRST}")
def _(spark, sf):
    return dimensions.variable_keys(_variables(spark, sf))


@query("b06_station_label", "SELECT StationNumber, StationNumber || ' (' || arg_min(Station, row_key) || ')' AS station_label FROM obs GROUP BY 1")
def _(spark, sf):
    return dimensions.station_labels(obs(spark, sf, "StationNumber", "Station", "row_key", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees"))


def _by_class(name, sql, expression, *columns):
    """A class of the qualifier (or other columns) with its row count."""

    @query(name, f"SELECT {sql} AS class, count(*) AS records FROM obs GROUP BY 1")
    def _(spark, sf):
        return obs(spark, sf, *columns).groupBy(expression().alias("class")).agg(records())


_Q = "MeasurementQualifier"
_by_class(
    "b07_qualifier_class",
    f"""CASE WHEN {_Q} IS NULL OR {_Q} IN ('', 'nan') THEN 'Clean' WHEN {_Q} IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS') THEN 'Suspect'
    WHEN {_Q} IN ('HT','DR','SPNF','OBS','FSE','RER','EST') THEN 'Acceptable' ELSE 'Other' END""",
    L.qualifier_class, _Q,
)
_by_class(
    "b08_quality_category",
    f"""CASE WHEN {_Q} IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS','DR|SUS') THEN 'Unreliable'
    WHEN {_Q} IN ('HT','HT|RER','FSE|HT','DR|HT','DR','DR|FSE','DR|SPNF','SPNF') THEN 'Potentially Unreliable' ELSE 'Clean' END""",
    L.quality_category, _Q,
)
_by_class(
    "b09_report_category",
    f"""CASE WHEN contains({_Q}, 'SPNF') THEN 'Procedure Deviation' WHEN contains({_Q}, 'SUS') THEN 'Suspect'
    WHEN contains({_Q}, 'HT') THEN 'Hold Time Issue' WHEN {_Q} IN ('OBS','FSE','RER') THEN 'Valid with Info' ELSE 'Clean Data' END""",
    L.report_category, _Q,
)
_by_class(
    "b11_qualifier_severity",
    f"""CASE WHEN {_Q} IS NULL OR {_Q} = '' THEN 0 WHEN contains({_Q}, 'SUS') THEN 3
    WHEN regexp_matches({_Q}, 'HT|DR|SPNF|EST') THEN 2 ELSE 1 END""",
    L.qualifier_severity, _Q,
)
_by_class("b23_qualifier_colour", f"CASE WHEN {_Q} IS NULL THEN 'clean' WHEN {_Q} IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS') THEN 'suspect' ELSE 'other' END", L.qualifier_colour, _Q)


@query(
    "b10_review_columns",
    f"""SELECT coalesce({_Q} IN ('HT','DR','EST','SPNF'), false) AS quality_flag, {_Q} IS NOT NULL AS is_flagged, coalesce({_Q}, 'CLEAN') AS data_quality,
    coalesce(contains({_Q}, 'HT'), false) AS hold_time_flag, count(*) AS records FROM obs GROUP BY 1,2,3,4""",
)
def _(spark, sf):
    rows = L.with_review_columns(obs(spark, sf, _Q))
    return rows.groupBy("quality_flag", "is_flagged", "data_quality", "hold_time_flag").agg(records())


@query(
    "b11_qualifier_parts",
    f"SELECT part, count(*) AS records FROM (SELECT unnest(string_split({_Q}, '|')) AS part FROM obs WHERE {_Q} IS NOT NULL) WHERE part <> '' GROUP BY 1",
)
def _(spark, sf):
    return obs(spark, sf, _Q).groupBy(_Q).agg(records()).select(F.explode(L.qualifier_parts(_Q)).alias("part"), "records").groupBy("part").agg(F.sum("records").alias("records"))


@query(
    "b12_temporal_features",
    """SELECT year(SampleDateTime)::INT AS "Year", month(SampleDateTime)::INT AS "Month", strftime(SampleDateTime,'%Y-%m') AS "YearMonth",
    quarter(SampleDateTime)::INT AS "Quarter", dayofyear(SampleDateTime)::INT AS "DayOfYear", count(*) AS records FROM obs GROUP BY 1,2,3,4,5""",
)
def _(spark, sf):
    return L.with_temporal_features(obs(spark, sf, "SampleDateTime")).groupBy("Year", "Month", "YearMonth", "Quarter", "DayOfYear").agg(records())


PERIOD_SQL = {
    "weekly": "strftime(date_trunc('week', SampleDateTime), '%Y-%m-%d') || '/' || strftime(date_trunc('week', SampleDateTime) + INTERVAL 6 DAY, '%Y-%m-%d')",
    "monthly": "strftime(SampleDateTime, '%Y-%m')",
    "quarterly": "year(SampleDateTime) || 'Q' || quarter(SampleDateTime)",
    "annual": "CAST(year(SampleDateTime) AS VARCHAR)",
    "seasonal": "year(SampleDateTime) || ' ' || CASE WHEN month(SampleDateTime) IN (12,1,2) THEN 'Winter' WHEN month(SampleDateTime) IN (3,4,5) THEN 'Spring'"
    " WHEN month(SampleDateTime) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END",
}


@query(
    "b13_period_label",
    " UNION ALL ".join(f"SELECT '{p}' AS period, {s} AS label, count(*) AS records FROM obs GROUP BY 1,2" for p, s in PERIOD_SQL.items() if p != "seasonal"),
)
def _(spark, sf):
    days = obs(spark, sf, "SampleDateTime").groupBy("SampleDateTime").agg(records())
    cells = [F.struct(F.lit(p).alias("period"), L.period_label("SampleDateTime", p).alias("label")) for p in PERIOD_SQL if p != "seasonal"]
    return days.select(F.explode(F.array(*cells)).alias("c"), "records").groupBy("c.period", "c.label").agg(F.sum("records").alias("records"))


@query(
    "b14_season_label",
    f"""SELECT {PERIOD_SQL['seasonal']} AS label, CAST((month(SampleDateTime) % 12) // 3 AS INT) AS season_order, count(*) AS records FROM obs GROUP BY 1,2""",
)
def _(spark, sf):
    return obs(spark, sf, "SampleDateTime").groupBy(L.season_label("SampleDateTime").alias("label"), L.season_order("SampleDateTime").alias("season_order")).agg(records())


@query(
    "b15_names",
    """SELECT ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(SampleDateTime)] AS month_name,
    ['Q1 (Jan-Mar)','Q2 (Apr-Jun)','Q3 (Jul-Sep)','Q4 (Oct-Dec)'][quarter(SampleDateTime)] AS quarter_name, count(*) AS records FROM obs GROUP BY 1,2""",
)
def _(spark, sf):
    ts = "SampleDateTime"
    return obs(spark, sf, ts).groupBy(
        L.lookup(F.month(ts), L.MONTH_NAMES).alias("month_name"), L.lookup(F.quarter(ts), L.QUARTER_NAMES).alias("quarter_name")
    ).agg(records())


@query(
    "b16_numeric_coercion",
    "SELECT VmvCode, count(*) AS records, count(MeasurementValueNum) AS numbers, min(MeasurementValueNum) AS low, max(MeasurementValueNum) AS high FROM obs GROUP BY 1",
)
def _(spark, sf):
    number = to_number("MeasurementValue")
    return obs(spark, sf, "VmvCode", "MeasurementValue").groupBy("VmvCode").agg(records(), F.count(number).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"))


@query(
    "b29_unit_conversion",
    """SELECT VmvCode, coalesce(CASE WHEN UnitCode = 'ug/L' THEN 'mg/L' ELSE UnitCode END, '-') AS unit, count_if(coalesce(UnitCode = 'ug/L', false))::BIGINT AS converted,
    avg(CASE WHEN UnitCode = 'ug/L' THEN MeasurementValueNum * 0.001 ELSE MeasurementValueNum END) AS mean_value FROM obs GROUP BY 1, 2""",
    "mean_value",
)
def _(spark, sf):
    rows = units.standardize_units(obs(spark, sf, "VmvCode", "UnitCode", "MeasurementValueNum"), "mg/L")
    return rows.groupBy("VmvCode", F.coalesce("UnitStandardized", F.lit("-")).alias("unit")).agg(
        F.count_if("ConversionApplied").alias("converted"), F.avg("ValueStandardized").alias("mean_value")
    )


@query(
    "b30_unit_strategy",
    """WITH m AS (SELECT VmvCode, arg_min(UnitCode, (-n, UnitCode)) AS main FROM (SELECT VmvCode, UnitCode, count(*) n FROM obs WHERE UnitCode IS NOT NULL GROUP BY 1,2) GROUP BY 1)
    SELECT 'separate' AS strategy, count(*) AS records, count(DISTINCT (VmvCode, UnitCode)) AS streams FROM obs WHERE UnitCode IS NOT NULL
    UNION ALL SELECT 'exclude', count(*), count(DISTINCT (VmvCode, UnitCode)) FROM obs JOIN m USING (VmvCode) WHERE UnitCode = main
    UNION ALL SELECT 'convert', count(*), count(DISTINCT (VmvCode, CASE WHEN UnitCode='ug/L' THEN 'mg/L' ELSE UnitCode END)) FROM obs WHERE UnitCode IS NOT NULL""",
)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "UnitCode", "MeasurementValueNum").where(F.col("UnitCode").isNotNull())
    parts = []
    for strategy in ("separate", "exclude", "convert"):
        kept = units.apply_unit_strategy(rows, strategy, "mg/L")
        unit = "UnitStandardized" if strategy == "convert" else "UnitCode"
        parts.append(kept.agg(F.lit(strategy).alias("strategy"), records(), F.countDistinct("VmvCode", unit).alias("streams")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "b31_ingest_flags",
    """SELECT VariableName, coalesce(UnitCode = 'ug/L', false) AS s1, coalesce(CASE VariableName WHEN 'pH' THEN MeasurementValueNum < 6.5 OR MeasurementValueNum > 8.5
    WHEN 'Dissolved Oxygen' THEN MeasurementValueNum < 0 OR MeasurementValueNum > 15 WHEN 'Temperature' THEN MeasurementValueNum < -0.5 OR MeasurementValueNum > 30
    WHEN 'TURBIDITY' THEN MeasurementValueNum < 0 OR MeasurementValueNum > 100 END, false) AS m2,
    (StationNumber IS NULL OR SampleDateTime IS NULL OR VariableName IS NULL) AS c2, count(*) AS records FROM obs GROUP BY 1,2,3,4""",
)
def _(spark, sf):
    rows = units.with_ingest_flags(obs(spark, sf, "StationNumber", "SampleDateTime", "VariableName", "UnitCode", "MeasurementValueNum"), ["ug/L"])
    return rows.groupBy("VariableName", F.col("QA_S1").alias("s1"), F.col("QA_M2").alias("m2"), F.col("QA_C2").alias("c2")).agg(records())


@query(
    "b32_below_limit",
    """WITH b AS (SELECT VmvCode, MeasurementValueNum v, MethodDetectionLimit mdl, coalesce(starts_with(MeasurementValue,'<'),false) OR coalesce(MeasurementFlag='L',false)
    OR coalesce(MeasurementValueNum < MethodDetectionLimit, false) AS below FROM obs)
    SELECT VmvCode, count_if(below)::BIGINT AS below, avg(CASE WHEN NOT below THEN v END) AS mean_excluded, avg(CASE WHEN below THEN mdl/2 ELSE v END) AS mean_half,
    avg(v) AS mean_kept FROM b GROUP BY 1""",
    "mean_excluded mean_half mean_kept",
)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "MeasurementValue", "MeasurementFlag", "MethodDetectionLimit")
    return rows.groupBy("VmvCode").agg(
        F.count_if(L.is_below_limit()).alias("below"),
        F.avg(L.below_limit_value("exclude")).alias("mean_excluded"),
        F.avg(L.below_limit_value("half")).alias("mean_half"),
        F.avg(L.below_limit_value("keep")).alias("mean_kept"),
    )


@query(
    "b33_station_code_parts",
    "SELECT DISTINCT StationNumber, StationNumber[1:2] AS province, StationNumber[3:4] AS basin, StationNumber[5:6] AS sub_basin, StationNumber[7:] AS serial FROM obs",
)
def _(spark, sf):
    return obs(spark, sf, "StationNumber").distinct().withColumns(L.station_code_parts())


@query(
    "b34_comment_words",
    f"""SELECT code, word, n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, word) rn FROM (SELECT code, word, count(*) AS n FROM
    (SELECT {_Q} AS code, unnest(regexp_split_to_array(lower(MeasurementComment), '\\W+')) AS word FROM obs WHERE {_Q} IS NOT NULL AND MeasurementComment IS NOT NULL)
    WHERE word <> '' GROUP BY 1,2)) WHERE rn <= 5""",
)
def _(spark, sf):
    return units.comment_words(obs(spark, sf, _Q, "MeasurementComment"), _Q, "MeasurementComment", 5)


@query(
    "b35_metric_text",
    "SELECT VmvCode, coalesce(format('{:,.2f}', round(max(MeasurementValueNum) FILTER (WHERE MeasurementFlag='G'),2)), 'N/A') AS metric FROM obs GROUP BY 1",
)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "MeasurementValueNum", "MeasurementFlag")
    return rows.groupBy("VmvCode").agg(F.max(F.when(F.col("MeasurementFlag") == "G", F.col("MeasurementValueNum"))).alias("v")).select(
        "VmvCode", L.metric_text("v").alias("metric")
    )


@query(
    "b36_observation_level",
    """SELECT VmvCode, CASE CAST(trunc(MeasurementValueNum) AS INT) WHEN 0 THEN 'Absent' WHEN 1 THEN 'Low' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'High' END AS level, count(*) AS records
    FROM obs GROUP BY 1,2""",
)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "MeasurementValue")
    return rows.groupBy("VmvCode", L.observation_level("MeasurementValue").alias("level")).agg(records())


def _station_classes(name, sql, columns):
    """Display classes of a station number, one row per station."""

    @query(
        name,
        f"""WITH s AS (SELECT StationNumber, count(*) AS n, count(DISTINCT VariableName) AS vars, 100.0 * count_if({_Q} IS NULL) / count(*) AS clean,
        100.0 * count_if({_Q} IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS','DR|SUS')) / count(*) AS flagged FROM obs GROUP BY 1) {sql}""",
        "weight" if "weight" in columns else None,
    )
    def _(spark, sf):
        s = obs(spark, sf, "StationNumber", "VariableName", _Q).groupBy("StationNumber").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("VariableName").alias("vars"),
            (F.avg(F.col(_Q).isNull().cast("int")) * 100).alias("clean"), (F.avg(L.is_tier_flagged().cast("int")) * 100).alias("flagged"),
        )
        if name.startswith("b22"):
            s = s.where("flagged > 0")
        return s.select("StationNumber", *[c().alias(k) for k, c in columns.items()])


_station_classes(
    "b20_station_class",
    "SELECT StationNumber, CASE WHEN clean >= 95 THEN 'Excellent' WHEN clean >= 90 THEN 'Good' ELSE 'Poor' END AS class, CAST(least(4 + n/200.0, 15.0) AS DOUBLE) AS radius FROM s",
    {"class": lambda: L.station_class("clean"), "radius": lambda: L.marker_radius("n")},
)
_station_classes(
    "b21_flag_rate_class",
    "SELECT StationNumber, CASE WHEN flagged = 0 THEN '0%' WHEN flagged <= 5 THEN '>0-5%' WHEN flagged <= 10 THEN '5-10%' ELSE '>10%' END AS class FROM s",
    {"class": lambda: L.flag_rate_class("flagged")},
)
_station_classes(
    "b22_heat_weight",
    "SELECT StationNumber, CAST(greatest(flagged, 0.01) AS DOUBLE) AS weight FROM s WHERE flagged > 0",
    {"weight": lambda: F.greatest(F.col("flagged"), F.lit(0.01))},
)
_station_classes(
    "b24_coverage_level",
    """SELECT StationNumber, CASE WHEN vars <= 3 THEN 'Minimal (<3 vars)' WHEN vars <= 7 THEN 'Basic (3-7 vars)' WHEN vars <= 12 THEN 'Moderate (7-12 vars)'
    WHEN vars <= 100 THEN 'Comprehensive (12+ vars)' END AS level FROM s""",
    {"level": lambda: L.coverage_level("vars")},
)
