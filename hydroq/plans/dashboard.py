"""Dashboard queries: quality page and variable page."""

from hydroq.functions import labels as L
from hydroq.functions.values import none_of
from hydroq import schema as S
from hydroq.operators import dimensions, filters, quality, series
from hydroq.plans.catalog import obs, query, records
from hydroq.plans.labels import PERIOD_SQL

_Q = "MeasurementQualifier"
_DEF = "('SUS','RER|SUS','HT|RER|SUS','HT|SUS','DR|SUS')"
_ALL = "('SUS','RER|SUS','HT|RER|SUS','HT|SUS','DR|SUS','HT','HT|RER','FSE|HT','DR|HT','DR','DR|FSE','DR|SPNF','SPNF')"
_BLANK = f"({_Q} IS NULL OR {_Q} = '')"
_METRICS = f"""count(*) AS total, CAST(count_if({_BLANK}) AS BIGINT) AS clean, CAST(count_if(NOT {_BLANK}) AS BIGINT) AS flagged,
 100.0*count_if({_BLANK})/count(*) AS pct_clean, 100.0*count_if(NOT {_BLANK})/count(*) AS pct_flagged"""
_PCT = "pct_clean pct_flagged"
_PLACE = ("LatitudeDecimalDegrees", "LongitudeDecimalDegrees")
_START = {"monthly": "date_trunc('month', SampleDateTime)", "annual": "date_trunc('year', SampleDateTime)"}


@query("e01_quality_metrics", f"SELECT {_METRICS} FROM obs", _PCT)
def _(spark, sf):
    return quality.metrics(obs(spark, sf, _Q))


@query("e02_quality_by_station", f"SELECT StationNumber, {_METRICS} FROM obs GROUP BY 1", _PCT)
def _(spark, sf):
    return quality.by_station(obs(spark, sf, "StationNumber", _Q))


@query("e03_quality_by_year", f"SELECT year(SampleDateTime)::INT AS \"Year\", {_METRICS} FROM obs GROUP BY 1", _PCT)
def _(spark, sf):
    return quality.by_year(obs(spark, sf, "SampleDateTime", _Q))


@query("e04_quality_by_parameter", f"SELECT VmvCode, {_METRICS} FROM obs GROUP BY 1 ORDER BY pct_flagged DESC, VmvCode LIMIT 25", _PCT)
def _(spark, sf):
    return quality.by_parameter(obs(spark, sf, "VmvCode", _Q), 25)


@query("e05_top_stations", "SELECT StationNumber, count(*) AS records FROM obs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, sf):
    return quality.top_counts(obs(spark, sf, "StationNumber"), "StationNumber")


@query(
    "e06_top_parameters",
    """SELECT VmvCode, VmvCode || ' - ' || arg_min(VariableName, row_key) AS label, count(*) AS records FROM obs GROUP BY 1 ORDER BY records DESC, VmvCode LIMIT 15""",
)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "VariableName", "row_key")
    return quality.top_counts(rows, "VmvCode").join(dimensions.variable_labels(rows), "VmvCode", "left")


@query(
    "e07_qualifier_distribution",
    f"""SELECT coalesce({_Q}, '(Clean/No Flag)') AS "Qualifier", n AS "Count", 100.0*n/sum(n) OVER () AS "Percentage",
    100.0*sum(n) OVER (ORDER BY n DESC, {_Q} NULLS FIRST ROWS UNBOUNDED PRECEDING)/sum(n) OVER () AS "CumulativePct",
    row_number() OVER (ORDER BY n DESC, {_Q} NULLS FIRST)::INT AS position FROM (SELECT {_Q}, count(*) n FROM obs GROUP BY 1)""",
    "Percentage CumulativePct",
)
def _(spark, sf):
    return quality.qualifier_distribution(obs(spark, sf, _Q))


@query("e08_station_qualifier", f"SELECT StationNumber, {_Q}, count(*) AS n FROM obs WHERE {_Q} IS NOT NULL GROUP BY 1,2")
def _(spark, sf):
    return quality.crosstab(obs(spark, sf, "StationNumber", _Q), "StationNumber", _Q)


@query(
    "e08_station_qualifier_wide",
    f"SELECT StationNumber, {', '.join(f'count_if({_Q}={chr(39)}{c}{chr(39)})::BIGINT AS {c}' for c in ('OBS', 'FSE', 'HT', 'SUS'))} FROM obs WHERE {_Q} IN ('OBS','FSE','HT','SUS') GROUP BY 1",
)
def _(spark, sf):
    return quality.crosstab_wide(obs(spark, sf, "StationNumber", _Q), "StationNumber", _Q, ["OBS", "FSE", "HT", "SUS"])


_STATION = "arg_min(Station, row_key) AS Station, arg_min(LatitudeDecimalDegrees, row_key) AS LatitudeDecimalDegrees, arg_min(LongitudeDecimalDegrees, row_key) AS LongitudeDecimalDegrees"
_VALUES = f"""{_STATION}, avg(MeasurementValueNum) AS MeasurementValueNum, count(*) AS RecordCount,
 arg_min(UnitCode, row_key) FILTER (WHERE UnitCode IS NOT NULL) AS UnitCode FROM obs WHERE VmvCode = {{v}} AND MeasurementValueNum IS NOT NULL"""
_STATION_COLS = ("StationNumber", "Station", *_PLACE, "MeasurementValueNum", "UnitCode", "row_key", "VmvCode", "SampleDateTime")


def _one(spark, sf, code=0, *extra):
    return filters.by_variable(obs(spark, sf, *_STATION_COLS, *extra), code)


@query("e09_station_values", f"SELECT StationNumber, {_VALUES.format(v=9)} GROUP BY 1", "MeasurementValueNum")
def _(spark, sf):
    return series.station_values(_one(spark, sf, 9))


def _percentiles(period, start):
    label = PERIOD_SQL[L.period_name(period)]
    return f"""SELECT CAST({start} AS TIMESTAMP)::VARCHAR AS period_start, {label} AS period_label, avg(MeasurementValueNum) AS mean, quantile_cont(MeasurementValueNum, 0.25) AS p25,
    quantile_cont(MeasurementValueNum, 0.5) AS p50, quantile_cont(MeasurementValueNum, 0.75) AS p75 FROM obs
    WHERE VmvCode = 0 AND ({_Q} IS NULL OR {_Q} NOT IN {_DEF}) AND MeasurementValueNum IS NOT NULL GROUP BY 1, 2"""


_SERIES = {
    "e10_period_percentiles": ("M", "date_trunc('month', SampleDateTime)"),
    "e10_weekly_percentiles": ("W", "date_trunc('week', SampleDateTime)"),
    "e10_quarterly_percentiles": ("Q", "date_trunc('quarter', SampleDateTime)"),
    "e10_yearly_percentiles": ("Y", "date_trunc('year', SampleDateTime)"),
    "e10_seasonal_percentiles": ("seasonal", "make_date(year(SampleDateTime), 3*((month(SampleDateTime)%12)//3)+1, 1)"),
}


def _register_series(name, period, start):
    @query(name, _percentiles(period, start), "mean p25 p50 p75")
    def _(spark, sf):
        rows = filters.by_quality(filters.by_variable(obs(spark, sf, "VmvCode", _Q, "SampleDateTime", "MeasurementValueNum"), 0), "definite")
        return series.period_percentiles(rows, period)


for _name, (_period, _start) in _SERIES.items():
    _register_series(_name, _period, _start)


@query(
    "e10_all_variables",
    """SELECT VmvCode, date_trunc('year', SampleDateTime)::TIMESTAMP::VARCHAR AS period_start, CAST(year(SampleDateTime) AS VARCHAR) AS period_label, avg(MeasurementValueNum) AS mean,
    quantile_cont(MeasurementValueNum, 0.25) AS p25, quantile_cont(MeasurementValueNum, 0.5) AS p50, quantile_cont(MeasurementValueNum, 0.75) AS p75
    FROM obs WHERE MeasurementValueNum IS NOT NULL GROUP BY 1,2,3""",
    "mean p25 p50 p75",
)
def _(spark, sf):
    return series.period_percentiles(obs(spark, sf, "VmvCode", "SampleDateTime", "MeasurementValueNum"), "Y", "VmvCode")


@query(
    "e11_statistical_summary",
    f"""WITH f AS (SELECT *, ({_Q} IS NULL OR {_Q} NOT IN {_DEF}) AS keep FROM obs WHERE VmvCode = 10)
    SELECT count(MeasurementValueNum) FILTER (keep) AS count, avg(MeasurementValueNum) FILTER (keep) AS mean, stddev_samp(MeasurementValueNum) FILTER (keep) AS std,
    min(MeasurementValueNum) FILTER (keep) AS min, max(MeasurementValueNum) FILTER (keep) AS max, 100.0*count_if(NOT keep)/count(*) AS pct_removed,
    count(DISTINCT StationNumber) FILTER (keep) AS stations, median(MeasurementValueNum) FILTER (keep) AS median FROM f""",
    "mean std pct_removed median",
)
def _(spark, sf):
    rows = filters.by_variable(obs(spark, sf, "VmvCode", _Q, "MeasurementValueNum", "StationNumber"), 10)
    return series.statistical_summary(rows, none_of(_Q, S.UNRELIABLE_CODES))


_FLAGS = f"count(*) AS total_records, count(*) FILTER ({_Q} IN {{c}}) AS flagged_count, 100.0*(count(*) FILTER ({_Q} IN {{c}}))/count(*) AS flagged_pct"


@query(
    "e12_variable_flag_stats",
    f"""SELECT VmvCode, {_FLAGS.format(c=_DEF)}, arg_min(VariableName, row_key) || ' (' || VmvCode || '-' || arg_min(VariableCode, row_key) || ')' AS variable_label FROM obs GROUP BY VmvCode""",
    "flagged_pct",
)
def _(spark, sf):
    return quality.variable_flag_stats(obs(spark, sf, "VmvCode", "VariableCode", "VariableName", "row_key", _Q))


@query(
    "e13_station_flag_stats",
    f"SELECT StationNumber, {_FLAGS.format(c=_ALL)}, StationNumber || ' (' || arg_min(Station, row_key) || ')' AS station_label FROM obs GROUP BY StationNumber",
    "flagged_pct",
)
def _(spark, sf):
    return quality.station_flag_stats(obs(spark, sf, "StationNumber", "Station", "row_key", _Q), True)


def _matrix(by, key):
    @query(
        f"e14_flag_matrix_{by}",
        f"""WITH c AS (SELECT {key}, {_Q}, count(*) AS n FROM obs WHERE {_Q} IN {_ALL} GROUP BY 1,2)
        SELECT *, CAST(sum(n) OVER (PARTITION BY {key}) AS BIGINT) AS row_total, CAST(sum(n) OVER (PARTITION BY {_Q}) AS BIGINT) AS column_total FROM c""",
    )
    def _(spark, sf):
        return quality.flag_matrix(obs(spark, sf, key, _Q), by)


_matrix("variable", "VmvCode")
_matrix("station", "StationNumber")


@query(
    "e14_flag_matrix_wide",
    "SELECT VmvCode, " + ", ".join(f"count_if({_Q}='{c}')::BIGINT AS \"{c}\"" for c in S.TIER_CODES) + f", count(*) AS row_total FROM obs WHERE {_Q} IN {_ALL} GROUP BY 1",
)
def _(spark, sf):
    return quality.flag_matrix_wide(obs(spark, sf, "VmvCode", _Q))


@query(
    "e15_station_flag_map",
    f"SELECT StationNumber, {_FLAGS.format(c=_DEF)}, {_STATION} FROM obs WHERE VmvCode IN (0,1,2,3,4,5,6) GROUP BY StationNumber",
    "flagged_pct",
)
def _(spark, sf):
    return quality.station_flag_map(obs(spark, sf, "StationNumber", "Station", *_PLACE, "row_key", "VmvCode", _Q), codes=list(range(7)))


@query("e16_quality_timeline", f"SELECT strftime(SampleDateTime,'%Y-%m') AS \"YearMonth\", 100.0*count_if({_Q} IS NULL)/count(*) AS pct_clean FROM obs GROUP BY 1", "pct_clean")
def _(spark, sf):
    return quality.timeline(obs(spark, sf, "SampleDateTime", _Q))


@query(
    "e17_completeness_matrix",
    """WITH c AS (SELECT StationNumber, VmvCode, count(*) n FROM obs GROUP BY 1,2), m AS (SELECT VmvCode, max(n) most FROM c GROUP BY 1),
    s AS (SELECT DISTINCT StationNumber FROM obs)
    SELECT s.StationNumber, m.VmvCode, 100.0*coalesce(n,0)/most AS completeness FROM s CROSS JOIN m LEFT JOIN c USING (StationNumber, VmvCode)""",
    "completeness",
)
def _(spark, sf):
    return quality.completeness_matrix(obs(spark, sf, "StationNumber", "VmvCode"))


@query(
    "e18_station_quality_map",
    f"""WITH s AS (SELECT StationNumber, arg_min(LatitudeDecimalDegrees,row_key) AS LatitudeDecimalDegrees, arg_min(LongitudeDecimalDegrees,row_key) AS LongitudeDecimalDegrees,
    100.0*count_if({_Q} IS NULL)/count(*) AS quality, count(*) AS records FROM obs GROUP BY 1)
    SELECT *, CASE WHEN quality >= 95 THEN 'Excellent' WHEN quality >= 90 THEN 'Good' ELSE 'Poor' END AS category, least(4+records/200.0, 15)::DOUBLE AS radius FROM s""",
    "quality",
)
def _(spark, sf):
    return quality.station_quality_map(obs(spark, sf, "StationNumber", *_PLACE, "row_key", _Q))


@query(
    "e19_map_center",
    f"SELECT avg(LatitudeDecimalDegrees) AS center_lat, avg(LongitudeDecimalDegrees) AS center_lon FROM (SELECT StationNumber, {_VALUES.format(v=0)} GROUP BY 1)",
    "center_lat center_lon",
)
def _(spark, sf):
    return quality.map_center(series.station_values(_one(spark, sf)))


@query(
    "e20_active_unit",
    "SELECT VmvCode, arg_min(UnitCode, (-n, UnitCode)) AS UnitCode FROM (SELECT VmvCode, UnitCode, count(*) n FROM obs WHERE UnitCode IS NOT NULL GROUP BY 1,2) GROUP BY 1",
)
def _(spark, sf):
    return dimensions.active_unit(obs(spark, sf, "VmvCode", "UnitCode"), ["VmvCode"])


@query(
    "e21_threshold_control",
    """SELECT min(MeasurementValueNum) AS threshold_min, max(MeasurementValueNum) AS threshold_max, median(MeasurementValueNum) AS threshold_p50,
    greatest((max(MeasurementValueNum)-min(MeasurementValueNum))/1000, 0.0001) AS threshold_step FROM obs WHERE VmvCode = 6""",
    "threshold_p50 threshold_step",
)
def _(spark, sf):
    return series.threshold_control(filters.by_variable(obs(spark, sf, "VmvCode", "MeasurementValueNum"), 6))


@query(
    "e22_quality_kpis",
    f"""SELECT count(*) AS total_records, count_if({_Q} IN {_DEF})::BIGINT AS unreliable, count_if({_Q} IN {_ALL})::BIGINT AS broad,
    count(DISTINCT StationNumber) FILTER ({_Q} IN {_ALL}) AS stations_affected, count(DISTINCT StationNumber) AS stations,
    count(DISTINCT VmvCode) FILTER ({_Q} IN {_ALL}) AS variables_affected, count(DISTINCT VmvCode) AS variables,
    (count_if({_Q} IN {_ALL}) - count_if({_Q} IN {_DEF}))::BIGINT AS potentially, 100.0*count_if({_Q} IN {_ALL})/count(*) AS flagged_pct FROM obs""",
    "flagged_pct",
)
def _(spark, sf):
    return quality.kpis(obs(spark, sf, "StationNumber", "VmvCode", _Q), True)


@query(
    "e23_filtered_summary",
    f"""SELECT count(*) AS records, count(DISTINCT StationNumber) AS stations, 100.0*count_if({_BLANK})/count(*) AS clean_pct, count(DISTINCT VmvCode) AS parameters,
    min(SampleDateTime)::VARCHAR AS date_min, max(SampleDateTime)::VARCHAR AS date_max FROM obs WHERE CAST(SampleDateTime AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
    "clean_pct",
)
def _(spark, sf):
    return quality.filtered_summary(filters.by_date_range(obs(spark, sf, "StationNumber", "VmvCode", "SampleDateTime", _Q), "1996-01-01", "1997-12-31"))


@query("e24_period_list", f"SELECT DISTINCT date_trunc('quarter', SampleDateTime)::TIMESTAMP::VARCHAR AS period_start, {PERIOD_SQL['quarterly']} AS period_label FROM obs")
def _(spark, sf):
    return series.period_list(obs(spark, sf, "SampleDateTime"), "quarterly")


@query(
    "e24_current_frame",
    """SELECT StationNumber, count(*) AS records FROM obs WHERE date_trunc('quarter', SampleDateTime) = (SELECT max(date_trunc('quarter', SampleDateTime)) FROM obs) GROUP BY 1""",
)
def _(spark, sf):
    return series.current_frame(obs(spark, sf, "StationNumber", "SampleDateTime"), "quarterly").groupBy("StationNumber").agg(records())


def _edges(keys, partition):
    """Oracle text of the bin edges; the number of classes follows the distinct values."""
    steps = " ".join(f"WHEN {q} THEN quantile_cont(v, {[i / q for i in range(q + 1)]})" for q in range(1, 6))
    return f"""e AS (SELECT {keys} list_sort(list_distinct(CASE least(5, d) {steps} END)) AS edges
    FROM (SELECT {keys} v, max(r) OVER ({partition}) AS d FROM
    (SELECT {keys} v, dense_rank() OVER ({partition} ORDER BY v) AS r FROM s)) GROUP BY {keys} d)"""


@query(
    "e25_frames",
    f"""WITH s AS (SELECT date_trunc('year', SampleDateTime)::TIMESTAMP::VARCHAR AS period_start, CAST(year(SampleDateTime) AS VARCHAR) AS period_label, StationNumber, {_VALUES.format(v=2)} GROUP BY 1,2,3)
    SELECT *, MeasurementValueNum >= 12 AS match FROM s""",
    "MeasurementValueNum",
)
def _(spark, sf):
    return series.threshold_match(series.frames(_one(spark, sf, 2), "annual"), 12.0)


@query(
    "e26_cumulative_view",
    f"""SELECT date_trunc('month', SampleDateTime)::TIMESTAMP::VARCHAR AS period_start, strftime(SampleDateTime,'%Y-%m') AS period_label, avg(MeasurementValueNum) AS mean, quantile_cont(MeasurementValueNum,0.25) AS p25,
    quantile_cont(MeasurementValueNum,0.5) AS p50, quantile_cont(MeasurementValueNum,0.75) AS p75 FROM obs WHERE VmvCode = 0 AND MeasurementValueNum IS NOT NULL
    AND SampleDateTime < TIMESTAMP '1998-07-01' GROUP BY 1,2""",
    "mean p25 p50 p75",
)
def _(spark, sf):
    rows = filters.by_variable(obs(spark, sf, "VmvCode", "SampleDateTime", "MeasurementValueNum"), 0)
    return series.up_to_period(series.period_percentiles(rows, "M"), "1998-06")


@query(
    "e27_version_counts",
    f"""SELECT v.version, CASE v.version WHEN 'C' THEN n ELSE n - s END AS records, 100.0*(CASE v.version WHEN 'C' THEN n ELSE n - s END)/n AS share_pct
    FROM (SELECT count(*) n, count_if({_Q} IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS'))::BIGINT s FROM obs), (SELECT unnest(['A','B','C']) AS version) v""",
    "share_pct",
)
def _(spark, sf):
    return quality.version_counts(obs(spark, sf, _Q))


@query(
    "e28_drill_down",
    f"""SELECT CASE WHEN StationNumber IS NOT NULL THEN 'station' WHEN VmvCode IS NOT NULL THEN 'parameter' WHEN y IS NOT NULL THEN 'year' ELSE 'all' END AS level,
    coalesce(StationNumber, VmvCode::VARCHAR, y::VARCHAR, 'all') AS entity, count(*) AS total, count(*) FILTER ({_BLANK}) AS clean, 100.0*(count(*) FILTER ({_BLANK}))/count(*) AS pct_clean
    FROM (SELECT *, year(SampleDateTime) AS y FROM obs) GROUP BY GROUPING SETS ((StationNumber), (VmvCode), (y), ())""",
    "pct_clean",
)
def _(spark, sf):
    return quality.drill_down(obs(spark, sf, "StationNumber", "VmvCode", "SampleDateTime", _Q))


@query(
    "b17_threshold_match",
    f"SELECT *, MeasurementValueNum <= 25 AS match FROM (SELECT StationNumber, {_VALUES.format(v=0)} GROUP BY 1) WHERE MeasurementValueNum <= 25",
    "MeasurementValueNum",
)
def _(spark, sf):
    return series.threshold_match(series.station_values(_one(spark, sf)), 25.0, "below", True)


@query(
    "b18_quantile_class",
    f"""WITH s AS (SELECT StationNumber, avg(MeasurementValueNum) AS v FROM obs WHERE VmvCode = 0 AND MeasurementValueNum IS NOT NULL GROUP BY 1),
    {_edges('', '')} SELECT StationNumber, greatest(0, len(list_filter(edges, lambda x: x < v)) - 1)::INT AS quantile_class FROM s, e""",
)
def _(spark, sf):
    return series.quantile_classes(series.station_values(_one(spark, sf))).select("StationNumber", "quantile_class")


@query(
    "b18_quantile_class_frames",
    f"""WITH s AS (SELECT date_trunc('year', SampleDateTime)::TIMESTAMP::VARCHAR AS period_start, StationNumber, avg(MeasurementValueNum) AS v FROM obs WHERE VmvCode = 0 AND MeasurementValueNum IS NOT NULL GROUP BY 1,2),
    {_edges('period_start,', 'PARTITION BY period_start')}
    SELECT period_start, StationNumber, greatest(0, len(list_filter(edges, lambda x: x < v)) - 1)::INT AS quantile_class FROM s JOIN e USING (period_start)""",
)
def _(spark, sf):
    return series.quantile_classes(series.frames(_one(spark, sf), "annual"), ["period_start"]).select("period_start", "StationNumber", "quantile_class")


@query(
    "b19_scale_breaks",
    f"""SELECT i::INT AS step, lo + i*(hi-lo)/4 AS value FROM (SELECT min(MeasurementValueNum) lo, max(MeasurementValueNum) hi FROM (SELECT StationNumber, {_VALUES.format(v=0)} GROUP BY 1)), range(5) t(i)""",
    "value",
)
def _(spark, sf):
    return series.scale_breaks(series.station_values(_one(spark, sf)))


@query(
    "g08_window_aggregate",
    """SELECT StationNumber, VmvCode, date_trunc('quarter', SampleDateTime)::TIMESTAMP::VARCHAR AS period_start, year(SampleDateTime) || 'Q' || quarter(SampleDateTime) AS period_label,
    avg(MeasurementValueNum) AS mean, stddev_samp(MeasurementValueNum) AS std, count(MeasurementValueNum) AS count, min(MeasurementValueNum) AS min, max(MeasurementValueNum) AS max,
    count(DISTINCT SampleNumber) AS samples FROM obs GROUP BY 1,2,3,4""",
    "mean std",
)
def _(spark, sf):
    return series.window_aggregate(obs(spark, sf, "StationNumber", "VmvCode", "SampleNumber", "SampleDateTime", "MeasurementValueNum"), "quarterly")
