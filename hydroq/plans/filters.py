"""Row filters over the measurement view."""

from pyspark.sql import functions as F

from hydroq.functions import labels as L
from hydroq.operators import filters
from hydroq.plans.catalog import obs, query, records

_Q = "MeasurementQualifier"


def _kept(name, where, keep, *columns, key="StationNumber"):
    """Rows a filter keeps, counted per key."""

    @query(name, f"SELECT {key}, count(*) AS records FROM obs WHERE {where} GROUP BY 1")
    def _(spark, sf):
        return keep(obs(spark, sf, *dict.fromkeys((key,) + columns))).groupBy(key).agg(records())


_STATIONS = ["AB00000003", "AB00000007", "AB00000042"]
_DEF = "('SUS','RER|SUS','HT|RER|SUS','HT|SUS','DR|SUS')"
_ALL = "('SUS','RER|SUS','HT|RER|SUS','HT|SUS','DR|SUS','HT','HT|RER','FSE|HT','DR|HT','DR','DR|FSE','DR|SPNF','SPNF')"

_kept("c01_date_range", "CAST(SampleDateTime AS DATE) BETWEEN DATE '1996-02-10' AND DATE '1998-07-13'", lambda d: filters.by_date_range(d, "1996-02-10", "1998-07-13"), "SampleDateTime")
_kept("c02_station_filter", "StationNumber IN ('AB00000003','AB00000007','AB00000042')", lambda d: filters.by_stations(d, _STATIONS))
_kept("c03_parameter_filter", "VmvCode IN (0, 6, 9)", lambda d: filters.by_parameters(d, [0, 6, 9]), "VmvCode")
_kept(
    "c04_global_filters",
    "CAST(SampleDateTime AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND StationNumber IN ('AB00000003','AB00000007','AB00000042') AND VmvCode < 20",
    lambda d: filters.global_filters(d, "1999-12-31", "1996-01-01", _STATIONS, list(range(20))),
    "SampleDateTime", "VmvCode",
)
_kept("c05_tier_definite", f"{_Q} IS NULL OR {_Q} NOT IN {_DEF}", lambda d: filters.by_quality(d, "definite"), _Q)
_kept("c05_tier_broader", f"{_Q} IS NULL OR {_Q} NOT IN {_ALL}", lambda d: filters.by_quality(d, "broader"), _Q)
_kept("c05_tier_all", "true", lambda d: filters.by_quality(d, "all"), _Q)
_kept("c06_suspicious", f"{_Q} IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS')", filters.suspicious, _Q)
_kept(
    "c07_date_preset",
    "CAST(SampleDateTime AS DATE) >= (SELECT max(CAST(SampleDateTime AS DATE)) - 365 FROM obs)",
    lambda d: filters.by_date_preset(d, "Last year"), "SampleDateTime",
)
_kept("c08_version_a", f"{_Q} IS NULL OR {_Q} NOT IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS')", lambda d: filters.dataset_version(d, "A"), _Q)
_kept("c09_strict_baseline", f"{_Q} IS NULL OR NOT regexp_matches({_Q}, 'SUS|HT')", filters.strict_baseline, _Q)
_kept(
    "c10_sensitive_hold_time",
    f"NOT (coalesce(list_contains(string_split({_Q}, '|'), 'HT'), false) AND regexp_matches(lower(VariableName), 'oxygen|ph|temperature|alkalinity|volatile'))",
    filters.drop_sensitive_hold_time, _Q, "VariableName", key="VariableName",
)
_kept("c11_one_variable", "VmvCode = 6", lambda d: filters.by_variable(d, 6), "VmvCode")
_kept(
    "c12_drop_nulls",
    "MeasurementValueNum IS NOT NULL AND UnitCode IS NOT NULL AND MethodDetectionLimit IS NOT NULL",
    lambda d: filters.with_all(d, ["MeasurementValueNum", "UnitCode", "MethodDetectionLimit"]),
    "MeasurementValueNum", "UnitCode", "MethodDetectionLimit",
)
_kept("c16_text_contains", "contains(lower(VariableName), 'temperature')", lambda d: filters.text_contains(d, "VariableName", "Temperature"), "VariableName", key="VariableName")
_kept("c17_station_search", "contains(lower(StationNumber), '0001') OR contains(lower(Station), '0001')", lambda d: filters.search_stations(d, "0001"), "Station")


@query(
    "c07_preset_range",
    """SELECT CAST(greatest(min(CAST(SampleDateTime AS DATE)), max(CAST(SampleDateTime AS DATE)) - 1825) AS VARCHAR) AS start_date,
    CAST(max(CAST(SampleDateTime AS DATE)) AS VARCHAR) AS end_date FROM obs""",
)
def _(spark, sf):
    return filters.preset_range(obs(spark, sf, "SampleDateTime"), "Last 5 years")


@query(
    "c13_top_flagged_rows",
    f"""WITH s AS (SELECT StationNumber FROM obs GROUP BY 1 ORDER BY 100.0*count_if({_Q} IN {_DEF})/count(*) DESC, StationNumber LIMIT 10)
    SELECT VmvCode, count(*) AS records FROM obs SEMI JOIN s USING (StationNumber) GROUP BY 1""",
)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "VmvCode", _Q)
    rate = rows.groupBy("StationNumber").agg((F.count_if(L.is_tier_flagged()) * 100.0 / F.count(F.lit(1))).alias("pct"))
    top = rate.orderBy(F.desc("pct"), "StationNumber").limit(10)
    return filters.rows_of(rows, top, ["StationNumber"]).groupBy("VmvCode").agg(records())


@query(
    "c14_shown_hidden",
    f"""SELECT shown, count(*) AS stations FROM (SELECT StationNumber, count_if({_Q} IN ('SUS','RER|SUS')) > 0 AS shown FROM obs GROUP BY 1) GROUP BY 1""",
)
def _(spark, sf):
    per = obs(spark, sf, "StationNumber", _Q).groupBy("StationNumber").agg((F.count_if(F.col(_Q).isin("SUS", "RER|SUS")) > 0).alias("shown"))
    return per.groupBy("shown").agg(F.count(F.lit(1)).alias("stations"))


@query(
    "c15_default_parameters",
    """WITH t AS (SELECT VmvCode FROM obs GROUP BY 1 ORDER BY count(*) DESC, VmvCode LIMIT 20)
    SELECT StationNumber, count(*) AS records FROM obs SEMI JOIN t USING (VmvCode) GROUP BY 1""",
)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "VmvCode")
    top = rows.groupBy("VmvCode").agg(records()).orderBy(F.desc("records"), "VmvCode").limit(20)
    return filters.rows_of(rows, top, ["VmvCode"]).groupBy("StationNumber").agg(records())


@query(
    "c19_exclusion_matrix",
    f"""WITH c AS (SELECT {_Q} AS q, string_split(coalesce({_Q},''), '|') AS p FROM obs)
    SELECT 'trend' AS analysis, CASE WHEN list_contains(p,'SUS') THEN 'exclude' WHEN list_has_any(p, ['HT','SPNF','EST']) THEN 'caution' ELSE 'accept' END AS usage, count(*) AS records FROM c GROUP BY 1,2
    UNION ALL SELECT 'basin', CASE WHEN list_contains(p,'SUS') THEN 'exclude' WHEN list_contains(p,'SPNF') THEN 'caution' ELSE 'accept' END, count(*) FROM c GROUP BY 1,2
    UNION ALL SELECT 'report', 'accept', count(*) FROM c""",
)
def _(spark, sf):
    counts = obs(spark, sf, _Q).groupBy(_Q).agg(records())
    cells = [F.struct(F.lit(a).alias("analysis"), filters.usage(a).alias("usage")) for a in ("trend", "basin", "report")]
    return counts.select(F.explode(F.array(*cells)).alias("c"), "records").groupBy("c.analysis", "c.usage").agg(F.sum("records").alias("records"))
