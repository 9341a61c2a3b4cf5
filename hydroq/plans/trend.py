"""Trend, basin, laboratory, station and summary queries."""

from pyspark.sql import functions as F

from hydroq.operators import refresh, spatial, stats, trend
from hydroq.plans import tail_sql
from hydroq.plans.catalog import obs, query
from hydroq.plans.labels import PERIOD_SQL
from hydroq.sources import sinks, staging
from hydroq.sources.test_tables import table

_Q = "MeasurementQualifier"
_V = "MeasurementValueNum"
_BLANK = f"({_Q} IS NULL OR {_Q} = '')"
_M2 = f"""coalesce((VariableName = 'pH' AND ({_V} < 0 OR {_V} > 14)) OR (contains(lower(VariableName), 'temperature') AND ({_V} < -5 OR {_V} > 50))
 OR (contains(lower(VariableName), 'dissolved oxygen') AND ({_V} < 0 OR {_V} > 15)), false)"""
_CLEAN = f"100.0*count(*) FILTER ({_BLANK})/count(*)"


def _trend_sql(keys, source, period):
    k = ", ".join(keys)
    return f"""pm AS (SELECT {k}, date_trunc('{period}', SampleDateTime) AS p, avg({_V}) AS y, count(*) AS c FROM {source} WHERE NOT {_M2} GROUP BY {k}, p),
    ix AS (SELECT *, (row_number() OVER (PARTITION BY {k} ORDER BY p) - 1)::DOUBLE AS x, sum(c) OVER (PARTITION BY {k}) AS allc FROM pm),
    rg AS (SELECT {k}, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared FROM ix WHERE allc >= 10 AND y IS NOT NULL GROUP BY {k} HAVING count(*) >= 3),
    tr AS (SELECT *, CASE WHEN r_squared < 1 THEN sign(slope)*sqrt(r_squared*(n-2)/(1-r_squared)) END AS t, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM rg)"""


_FIT = {"slope": 5, "intercept": 5, "r_squared": 7, "t": 5}
_TREND_COLS = ("RiverBasinCode", "VmvCode", "VariableName", "SampleDateTime", _V)


@query("j08_linear_trend", "WITH " + _trend_sql(["RiverBasinCode", "VmvCode"], "obs", "quarter") + " SELECT * FROM tr", _FIT)
def _(spark, sf):
    return trend.linear_trend(obs(spark, sf, *_TREND_COLS), ["RiverBasinCode", "VmvCode"], "quarterly")


@query("j08_linear_trend_station", "WITH " + _trend_sql(["StationNumber"], "obs", "year") + " SELECT * FROM tr", _FIT)
def _(spark, sf):
    return trend.linear_trend(obs(spark, sf, "StationNumber", "VariableName", "SampleDateTime", _V), ["StationNumber"], "annual")


@query(
    "j08_linear_trend_p",
    "WITH " + _trend_sql(["RiverBasinCode", "VmvCode"], "obs", "quarter") + f""", pv AS (SELECT *, CASE WHEN r_squared >= 1 THEN 0.0 ELSE {tail_sql.t_two_sided('t', '(n - 2)')} END AS p_value FROM tr)
    SELECT *, p_value < 0.05 AS significant FROM pv""",
    {**_FIT, "p_value": 6},
)
def _(spark, sf):
    return trend.with_significance(trend.linear_trend(obs(spark, sf, *_TREND_COLS), ["RiverBasinCode", "VmvCode"], "quarterly"))


@query(
    "j08_trend_diagnostics",
    "WITH " + _trend_sql(["RiverBasinCode", "VmvCode"], "obs", "quarter") + f""",
    e AS MATERIALIZED (SELECT RiverBasinCode, VmvCode, n, slope, r_squared, x, y - intercept - slope * x AS e FROM ix JOIN tr USING (RiverBasinCode, VmvCode) WHERE allc >= 10 AND y IS NOT NULL),
    j AS (SELECT *, e - lag(e) OVER (PARTITION BY RiverBasinCode, VmvCode ORDER BY x) AS jump FROM e),
    m AS (SELECT RiverBasinCode, VmvCode, n, slope, r_squared, avg(e*e) AS m2, avg(e*e*e) AS m3, avg(e*e*e*e) AS m4, var_pop(e*e) AS spread, sum(jump*jump) AS jumps, pow(corr(e*e, x), 2) AS aux FROM j GROUP BY ALL),
    d AS (SELECT *, CASE WHEN ok THEN jumps / (m2 * n) END AS durbin_watson, CASE WHEN ok THEN CASE WHEN spread > 1e-18 * m2 * m2 THEN n * aux ELSE 0 END END AS breusch_pagan,
      CASE WHEN ok THEN n / 6 * (pow(m3, 2) / pow(m2, 3) + pow(m4 / pow(m2, 2) - 3, 2) / 4) END AS jarque_bera FROM (SELECT *, r_squared < 1 - 1e-12 AND m2 > 0 AS ok FROM m))
    SELECT RiverBasinCode, VmvCode, n, slope, r_squared, durbin_watson, CASE WHEN durbin_watson < 1.5 THEN 'positive' WHEN durbin_watson > 2.5 THEN 'negative' WHEN durbin_watson IS NOT NULL THEN 'none' END AS serial,
    breusch_pagan, {tail_sql.chi2_upper('breusch_pagan', 1)} AS bp_p, jarque_bera, {tail_sql.chi2_upper('jarque_bera', 2)} AS jb_p FROM d""",
    {"slope": 5, "r_squared": 7, "durbin_watson": 6, "breusch_pagan": 5, "bp_p": 5, "jarque_bera": 5, "jb_p": 5},
)
def _(spark, sf):
    return trend.trend_diagnostics(obs(spark, sf, *_TREND_COLS), ["RiverBasinCode", "VmvCode"], "quarterly")


@query(
    "j13_trend_robustness",
    f"""WITH ver AS (SELECT *, 'C' AS version FROM obs UNION ALL SELECT *, 'A' FROM obs WHERE {_Q} IS NULL OR {_Q} NOT IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS')), """
    + _trend_sql(["version", "RiverBasinCode", "VmvCode"], "ver", "quarter")
    + """, w AS (SELECT RiverBasinCode, VmvCode, max(slope) FILTER (version='A') AS slope_first, max(slope) FILTER (version='C') AS slope_second, max(abs(t)) FILTER (version='A') AS t_first,
    max(abs(t)) FILTER (version='C') AS t_second FROM tr GROUP BY 1,2)
    SELECT *, CASE WHEN slope_first IS NULL OR slope_second IS NULL THEN 'one version only' WHEN sign(slope_first) <> sign(slope_second) THEN 'filtering-dependent'
    WHEN abs(slope_first - slope_second) <= 0.1*abs(slope_second) THEN 'robust' ELSE 'magnitude differs' END AS agreement FROM w""",
    {"slope_first": 5, "slope_second": 5, "t_first": 5, "t_second": 5},
)
def _(spark, sf):
    keys = ["RiverBasinCode", "VmvCode"]
    rows = obs(spark, sf, *_TREND_COLS, _Q)
    return trend.trend_robustness(trend.trend_by_version(rows, keys, window="quarterly"), keys)


@query(
    "j09_basin_comparison",
    f"""SELECT StationNumber, arg_min(Station, row_key) AS Station, avg({_V}) AS "Mean", stddev_samp({_V}) AS "StdDev", count({_V}) AS "Count", min({_V}) AS "Min", max({_V}) AS "Max" FROM obs
    WHERE RiverBasinCode = 'NATION_3' AND VmvCode = 10 AND year(SampleDateTime) = 1998 AND NOT {_M2} GROUP BY 1""",
    "Mean StdDev",
)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "VmvCode", "VariableName", "SampleDateTime", _V)
    return trend.compare_basin_stations(rows, _stations(spark, sf), "NATION_3", 10, 1998)


def _stations(spark, sf):
    """Every supplier as a station, also those without rows."""
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey")).selectExpr(
        "concat('AB', lpad(CAST(s_suppkey AS STRING),8,'0')) AS StationNumber", "s_name AS Station", "n_name AS RiverBasinCode"
    )


_QA = """coalesce(UnitCode = 'ug/L', false) AS s1, coalesce(CASE VariableName WHEN 'pH' THEN MeasurementValueNum < 6.5 OR MeasurementValueNum > 8.5 WHEN 'Dissolved Oxygen' THEN MeasurementValueNum < 0 OR MeasurementValueNum > 15
 WHEN 'Temperature' THEN MeasurementValueNum < -0.5 OR MeasurementValueNum > 30 WHEN 'TURBIDITY' THEN MeasurementValueNum < 0 OR MeasurementValueNum > 100 END, false) AS m2"""


@query(
    "j10_pre_analysis_check",
    f"""WITH q AS (SELECT *, {_QA} FROM obs) SELECT count(DISTINCT StationNumber) AS n_stations, count(DISTINCT VariableName) AS n_parameters, count(*) AS n_observations, min(SampleDateTime)::VARCHAR AS date_min,
    max(SampleDateTime)::VARCHAR AS date_max, count(*) FILTER (s1) AS s1_violations, count(*) FILTER (m2) AS m2_violations, 0::BIGINT AS c2_violations, true AS data_loaded,
    floor((epoch(max(SampleDateTime))-epoch(min(SampleDateTime)))/86400)/365.25 AS span_years, count(*) FILTER (s1) + count(*) FILTER (m2) AS total_violations,
    100.0 - 100.0*(count(*) FILTER (s1) + count(*) FILTER (m2))/count(*) AS compliance_pct FROM q""",
    "span_years compliance_pct",
)
def _(spark, sf):
    return trend.pre_analysis_check(obs(spark, sf, "StationNumber", "VariableName", "SampleDateTime", "UnitCode", _V))


@query("j10_unknown_keys", "SELECT v AS VariableName FROM (SELECT unnest(['pH', 'Iron Total', 'TURBIDITY', 'Cadmium']) v) WHERE v NOT IN (SELECT VariableName FROM obs)")
def _(spark, sf):
    return trend.unknown_keys(obs(spark, sf, "VariableName"), ["pH", "Iron Total", "TURBIDITY", "Cadmium"], "VariableName")


_OVERVIEW_SQL = f"""WITH q AS (SELECT *, {_QA} FROM obs), st AS (SELECT 'AB' || lpad(s_suppkey::VARCHAR, 8, '0') AS StationNumber, s_name AS Station, n_name AS RiverBasinCode FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT st.StationNumber, any_value(st.Station) AS Station, any_value(st.RiverBasinCode) AS RiverBasinCode, count(DISTINCT VariableName) AS num_parameters, count(DISTINCT CAST(SampleDateTime AS DATE)) AS num_samples,
    min(SampleDateTime)::VARCHAR AS first_sample, max(SampleDateTime)::VARCHAR AS last_sample, count(*) FILTER (s1) AS s1_violations, count(*) FILTER (m2) AS m2_violations,
    100.0*count(*) FILTER (NOT (s1 OR m2))/count(*) AS compliance_pct FROM st LEFT JOIN q ON st.StationNumber = q.StationNumber GROUP BY 1"""


@query(
    "j11_station_overview",
    _OVERVIEW_SQL,
    "compliance_pct",
)
def _(spark, sf):
    return trend.station_overview(_stations(spark, sf), obs(spark, sf, "StationNumber", "VariableName", "SampleDateTime", "UnitCode", _V))


_MONTHLY_SQL = f"""SELECT StationNumber, VmvCode, year(SampleDateTime)::INT AS period_year, month(SampleDateTime)::INT AS period_month, avg({_V}) AS value_mean, stddev_samp({_V}) AS value_std, min({_V}) AS value_min,
    max({_V}) AS value_max, count({_V}) AS sample_count FROM obs WHERE {_V} IS NOT NULL GROUP BY 1,2,3,4"""


@query(
    "j12_monthly_table",
    _MONTHLY_SQL,
    "value_mean value_std",
)
def _(spark, sf):
    made = trend.monthly_table(obs(spark, sf, "StationNumber", "VmvCode", "SampleDateTime", _V))
    path = staging.scratch_dir(spark, "monthly")
    sinks.write_versions(made, path, ["period_year"])
    return spark.read.schema(made.schema).parquet(path)


_STATE_COLS = ("StationNumber", "VmvCode", "VariableName", "SampleDateTime", "UnitCode", "arrival_block", _V)


def _refreshed(spark, sf):
    """Two batches: the second brings every other block of the rows since 1997, so older months are left as they are."""
    rows = obs(spark, sf, *_STATE_COLS)
    late = F.expr("year(SampleDateTime) >= 1997 AND arrival_block % 2 = 1")
    path = staging.scratch_dir(spark, "states")
    refresh.refresh(path, rows.where(~late), 1)
    refresh.refresh(path, rows.where(late), 2)
    return refresh.stored(spark, path)


@query("j12_refreshed_monthly_table", _MONTHLY_SQL, "value_mean value_std")
def _(spark, sf):
    return refresh.monthly_from(_refreshed(spark, sf))


@query("j11_refreshed_overview", _OVERVIEW_SQL, "compliance_pct")
def _(spark, sf):
    return refresh.overview_from(_stations(spark, sf), _refreshed(spark, sf))


_SYN = ["StationNumber", "VmvCode", "UnitCode", "MeasurementFlag", "MethodDetectionLimit", _V]


@query(
    "j14_synthesis",
    f"""SELECT count(*) AS total_rows, count(*)*6 AS total_cells, 100.0*({'+'.join(f'count({c})' for c in _SYN)})/(count(*)*6) AS completeness_percent, 6 AS total_columns,
    CASE WHEN 100.0*({'+'.join(f'count({c})' for c in _SYN)})/(count(*)*6) > 95 THEN 'high' WHEN 100.0*({'+'.join(f'count({c})' for c in _SYN)})/(count(*)*6) > 80 THEN 'moderate' ELSE 'low' END AS raw_data_quality,
    (SELECT count(*) FROM (SELECT VmvCode FROM obs GROUP BY 1 HAVING count({_V}) >= 3)) AS tested,
    (SELECT count(*) FROM (SELECT avg((v-m)**3)/avg((v-m)**2)**1.5 s, avg((v-m)**4)/avg((v-m)**2)**2 - 3 k FROM (SELECT VmvCode, {_V} v, avg({_V}) OVER (PARTITION BY VmvCode) m FROM obs WHERE {_V} IS NOT NULL) GROUP BY VmvCode)
     WHERE abs(s) < 2 AND abs(k) < 3) AS normal FROM obs""",
    "completeness_percent",
)
def _(spark, sf):
    rows = obs(spark, sf, *_SYN)
    return trend.synthesis(rows, stats.normality_verdict(rows))


_RULES = [("pH below 6.5", "ph", "< 6.5"), ("pH above 8.5", "ph", "> 8.5"), ("OXYGEN below 5", "oxygen", "< 5"), ("TURBIDITY above 5", "turbidity", "> 5"), ("PHOSPHORUS above 0.03", "phosphorus", "> 0.03")]


@query(
    "j19_exceedance",
    f"""SELECT StationNumber, y AS "Year", rule, count(*) AS measurements, count(*) FILTER (beyond) AS exceedances, 100.0*count(*) FILTER (beyond)/count(*) AS exceedance_pct FROM ("""
    + " UNION ALL ".join(f"SELECT StationNumber, year(SampleDateTime)::INT AS y, '{r}' AS rule, {_V} {c} AS beyond FROM obs WHERE {_V} IS NOT NULL AND contains(lower(VariableName), '{n}')" for r, n, c in _RULES)
    + ") GROUP BY 1,2,3",
    "exceedance_pct",
)
def _(spark, sf):
    return trend.exceedance(obs(spark, sf, "StationNumber", "VariableName", "SampleDateTime", _V))


_BASIN = f"""(SELECT RiverBasinCode, year(SampleDateTime)::INT AS "Year", VmvCode, avg({_V}) AS mean, stddev_samp({_V}) AS sd, count(DISTINCT StationNumber) AS stations, median({_V}) AS median FROM obs WHERE {_V} IS NOT NULL GROUP BY 1,2,3)"""
_BASIN_COLS = ("RiverBasinCode", "StationNumber", "VmvCode", "SampleDateTime", _V)


@query("j20_basin_aggregates", f"SELECT * FROM {_BASIN}", "mean sd median")
def _(spark, sf):
    return trend.basin_aggregates(obs(spark, sf, *_BASIN_COLS))


@query(
    "j20_basin_slopes",
    f"""SELECT *, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM (SELECT RiverBasinCode, VmvCode, count(*) AS years, regr_slope(median, "Year") AS slope FROM {_BASIN} GROUP BY 1,2 HAVING count(*) >= 2)""",
    "slope",
)
def _(spark, sf):
    return trend.basin_slopes(trend.basin_aggregates(obs(spark, sf, *_BASIN_COLS)))


@query(
    "j20_basin_scorecard",
    f"""SELECT * FROM (SELECT RiverBasinCode, count(DISTINCT StationNumber) AS stations, {_CLEAN} AS quality_score FROM obs GROUP BY 1) JOIN
    (SELECT RiverBasinCode, string_agg({_Q}, ', ' ORDER BY n DESC, {_Q}) AS concerns FROM (SELECT *, row_number() OVER (PARTITION BY RiverBasinCode ORDER BY n DESC, {_Q}) rn FROM
    (SELECT RiverBasinCode, {_Q}, count(*) n FROM obs WHERE NOT {_BLANK} GROUP BY 1,2)) WHERE rn <= 3 GROUP BY 1) USING (RiverBasinCode)""",
    "quality_score",
)
def _(spark, sf):
    return trend.basin_scorecard(obs(spark, sf, "RiverBasinCode", "StationNumber", _Q))


_POINTS = f"(SELECT StationNumber, any_value(LatitudeDecimalDegrees) AS la, any_value(LongitudeDecimalDegrees) AS lo, {_CLEAN} AS q FROM obs GROUP BY 1)"
_NEAR = """s AS (SELECT *, floor(la/0.1)::INT cx, floor(lo/0.1)::INT cy, q - avg(q) OVER () AS z FROM {p}),
 nb AS (SELECT a.StationNumber, a.z, count(b.StationNumber) AS neighbours, coalesce(sum(b.z), 0) AS sz, coalesce(sum(b.q), 0) AS sq FROM s a LEFT JOIN s b ON abs(a.cx-b.cx) <= 1 AND abs(a.cy-b.cy) <= 1 AND a.StationNumber <> b.StationNumber GROUP BY 1,2)"""


def _points(spark, sf):
    rows = obs(spark, sf, "StationNumber", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees", _Q)
    return rows.groupBy("StationNumber").agg(
        F.min("LatitudeDecimalDegrees").alias("LatitudeDecimalDegrees"), F.min("LongitudeDecimalDegrees").alias("LongitudeDecimalDegrees"),
        (100.0 * F.count_if(F.col(_Q).isNull() | (F.col(_Q) == "")) / F.count(F.lit(1))).alias("quality"),
    )


@query("d12_neighbour_lag", "WITH " + _NEAR.format(p=_POINTS) + " SELECT StationNumber, neighbours, sq AS neighbour_sum FROM nb", "neighbour_sum")
def _(spark, sf):
    return spatial.neighbour_lag(_points(spark, sf), "quality", 0.1).select("StationNumber", "neighbours", "neighbour_sum")


@query(
    "j21_morans_i",
    "WITH " + _NEAR.format(p=_POINTS) + """, t AS (SELECT count(*)::DOUBLE n, sum(neighbours)::DOUBLE s0, sum(neighbours**2) d2, sum(z*sz) c, sum(z*z) sq FROM nb),
    v AS (SELECT *, n*c/(s0*sq) AS i, -1/(n-1) AS e, (n*n*2*s0 - n*4*d2 + 3*s0*s0)/((n*n-1)*s0*s0) - 1/((n-1)*(n-1)) AS va FROM t)
    SELECT n::BIGINT AS stations, s0::BIGINT AS links, i AS morans_i, e AS expected, (i-e)/nullif(sqrt(va), 0) AS z FROM v""",
    "morans_i expected z",
)
def _(spark, sf):
    return spatial.morans_i(_points(spark, sf), "quality", 0.1)


@query(
    "j21_local_morans",
    "WITH " + _NEAR.format(p=_POINTS) + """, m AS (SELECT avg(z*z) m2 FROM s) SELECT StationNumber, neighbours, z*sz/nullif(neighbours,0)/m2 AS local_i,
    CASE WHEN neighbours = 0 THEN 'isolated' WHEN z >= 0 AND sz >= 0 THEN 'high-high' WHEN z < 0 AND sz < 0 THEN 'low-low' WHEN z >= 0 THEN 'high-low' ELSE 'low-high' END AS quadrant FROM nb, m""",
    "local_i",
)
def _(spark, sf):
    return spatial.local_morans(_points(spark, sf), "quality", size=0.1)


_BELL = "exp(-{0} * {0} / 4.5)"  # 1.5 cells


@query(
    "j31_density_surface",
    f"""WITH c AS (SELECT ContinentalRiverBasinCode, floor(LatitudeDecimalDegrees / 0.25)::BIGINT AS a, floor(LongitudeDecimalDegrees / 0.25)::BIGINT AS b, count(*) AS n FROM obs WHERE NOT {_BLANK} GROUP BY ALL),
    k AS (SELECT i, j, {_BELL.format('i')} * {_BELL.format('j')} / sum({_BELL.format('i')} * {_BELL.format('j')}) OVER () AS g FROM range(-3, 4) x(i), range(-3, 4) y(j)),
    s AS (SELECT ContinentalRiverBasinCode, a + i AS cell_row, b + j AS cell_col, sum(n * g) AS density FROM c, k GROUP BY ALL)
    SELECT ContinentalRiverBasinCode, floor(cell_row / 64)::BIGINT AS tile_row, floor(cell_col / 64)::BIGINT AS tile_col, cell_row, cell_col, density FROM s""",
    "density",
)
def _(spark, sf):
    rows = obs(spark, sf, "ContinentalRiverBasinCode", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees", _Q)
    return spatial.density_surface(rows.where(F.expr(f"NOT {_BLANK}")), ["ContinentalRiverBasinCode"])


_TIER = "CASE WHEN c >= 95 THEN 'Excellent' WHEN c >= 90 THEN 'Good' WHEN c >= 85 THEN 'Fair' ELSE 'Poor' END"
_USE = "CASE WHEN c >= 95 THEN 'All analyses' WHEN c >= 90 THEN 'Trend analysis' WHEN c >= 85 THEN 'Exploratory' ELSE 'Not recommended' END"


@query(
    "j22_confidence_matrix",
    f"""SELECT StationNumber, VmvCode, y AS "Year", n AS records, c AS confidence, {_TIER} AS tier, {_USE} AS recommended_use FROM
    (SELECT StationNumber, VmvCode, year(SampleDateTime)::INT y, count(*) n, {_CLEAN} AS c FROM obs GROUP BY 1,2,3)""",
    "confidence",
)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "VmvCode", "SampleDateTime", _Q).withColumn("Year", F.year("SampleDateTime"))
    return trend.confidence(rows, ["StationNumber", "VmvCode", "Year"])


@query(
    "j22_station_quality_index",
    f"""WITH c AS (SELECT StationNumber, year(SampleDateTime)::INT AS "Year", VariableName, {_CLEAN} AS c FROM obs GROUP BY 1,2,3),
    g AS (SELECT StationNumber, "Year", CASE WHEN regexp_matches(lower(VariableName), 'phosph|nitrogen|temperature') THEN 'i' WHEN regexp_matches(lower(VariableName), 'oxygen|\\bph\\b') THEN 'c' ELSE 'o' END AS p, avg(c) AS s FROM c GROUP BY 1,2,3)
    SELECT StationNumber, "Year", sum(s*CASE p WHEN 'o' THEN 0.2 ELSE 0.4 END)/sum(CASE p WHEN 'o' THEN 0.2 ELSE 0.4 END) AS quality_index FROM g GROUP BY 1,2""",
    "quality_index",
)
def _(spark, sf):
    return trend.station_quality_index(obs(spark, sf, "StationNumber", "SampleDateTime", "VariableName", _Q))


@query(
    "j23_seasonal_decomposition",
    f"""WITH m AS (SELECT VmvCode, date_trunc('month', SampleDateTime)::TIMESTAMP AS p, avg({_V}) AS y FROM obs WHERE {_V} IS NOT NULL GROUP BY 1,2),
    t AS (SELECT *, CASE WHEN count(y) OVER (PARTITION BY VmvCode ORDER BY p ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (sum(y) OVER (PARTITION BY VmvCode ORDER BY p ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
     + sum(y) OVER (PARTITION BY VmvCode ORDER BY p ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))/24 END AS tr FROM m),
    e AS (SELECT VmvCode, month(p) mo, avg(y - tr) AS e FROM t WHERE tr IS NOT NULL GROUP BY 1,2), s AS (SELECT VmvCode, mo, e - avg(e) OVER (PARTITION BY VmvCode) AS se FROM e)
    SELECT t.VmvCode, p::VARCHAR AS period_start, y, tr AS trend, se AS seasonal, y - tr - se AS residual FROM t LEFT JOIN s ON t.VmvCode = s.VmvCode AND month(p) = mo""",
    "y trend seasonal residual",
    digits=5,
)
def _(spark, sf):
    return trend.seasonal_decomposition(obs(spark, sf, "VmvCode", "SampleDateTime", _V))


_METRICS = f"""count(*) AS total, count(*) FILTER ({_BLANK}) AS clean, count(*) FILTER (NOT {_BLANK}) AS flagged, {_CLEAN} AS pct_clean, 100.0*count(*) FILTER (NOT {_BLANK})/count(*) AS pct_flagged"""


@query("j24a_lab_performance", f"SELECT *, rank() OVER (ORDER BY pct_flagged)::INT AS position FROM (SELECT LabCode, {_METRICS} FROM obs GROUP BY 1)", "pct_clean pct_flagged")
def _(spark, sf):
    return trend.lab_performance(obs(spark, sf, "LabCode", _Q))


@query(
    "j24a_lab_workload",
    f"SELECT LabCode, strftime(SampleDateTime,'%Y-%m') AS \"YearMonth\", count(DISTINCT SampleNumber) AS samples, count(*) AS records, 100.0*count(*) FILTER (NOT {_BLANK})/count(*) AS flagged_pct FROM obs GROUP BY 1,2",
    "flagged_pct",
)
def _(spark, sf):
    return trend.lab_workload(obs(spark, sf, "LabCode", "SampleDateTime", "SampleNumber", _Q))


@query("j24b_lab_method_matrix", f"SELECT LabCode, MethodCode, count(*) AS records, {_CLEAN} AS pct_clean FROM obs GROUP BY 1,2", "pct_clean")
def _(spark, sf):
    return trend.lab_method_matrix(obs(spark, sf, "LabCode", "MethodCode", _Q))


@query(
    "j24c_detection_limit_impact",
    f"""WITH b AS (SELECT VariableName, MethodCode, {_V} v, MethodDetectionLimit*100 AS mdl, coalesce(starts_with(MeasurementValue,'<'),false) OR coalesce(MeasurementFlag='L',false) OR coalesce({_V} < MethodDetectionLimit*100, false) AS below
    FROM obs WHERE MethodDetectionLimit IS NOT NULL)
    SELECT VariableName, MethodCode, count(*) AS records, 100.0*count(*) FILTER (below)/count(*) AS below_pct, 100.0*count(*) FILTER (NOT below AND v <= mdl*2)/count(*) AS near_pct, 100.0*count(*) FILTER (NOT below AND v > mdl*2)/count(*) AS above_pct FROM b GROUP BY 1,2""",
    "below_pct near_pct above_pct",
)
def _(spark, sf):
    rows = obs(spark, sf, "VariableName", "MethodCode", "MeasurementValue", "MeasurementFlag", "MethodDetectionLimit", _V)
    return trend.detection_limit_impact(rows.withColumn("MethodDetectionLimit", F.col("MethodDetectionLimit") * 100))


@query(
    "j24d_method_timeline",
    f"""WITH u AS (SELECT LabCode, VariableCode, MethodCode, min(SampleDateTime) AS f, max(SampleDateTime) AS l, count(*) AS records, avg({_V}) AS mean FROM obs GROUP BY 1,2,3)
    SELECT LabCode, VariableCode, MethodCode, f::VARCHAR AS first_use, l::VARCHAR AS last_use, records, mean, coalesce(lag(MethodCode) OVER w, -1)::INT AS previous_method, mean - lag(mean) OVER w AS mean_change
    FROM u WINDOW w AS (PARTITION BY LabCode, VariableCode ORDER BY f, MethodCode)""",
    "mean mean_change",
    digits=6,
)
def _(spark, sf):
    out = trend.method_timeline(obs(spark, sf, "LabCode", "VariableCode", "MethodCode", "SampleDateTime", _V))
    return out.na.fill(-1, ["previous_method"])


def _summary(name, keys, period=None, where="true"):
    label = f", date_trunc('{period[1]}', SampleDateTime)::TIMESTAMP::VARCHAR AS period_start, {PERIOD_SQL[period[0]]} AS period_label" if period else ""
    k = ", ".join(keys)

    @query(
        name,
        f"""SELECT {k}{label}, count(*) AS records, count({_V}) AS numbers, avg({_V}) AS mean, stddev_samp({_V}) AS std, min({_V}) AS min, max({_V}) AS max, count(DISTINCT SampleNumber) AS samples, {_CLEAN} AS clean_pct,
        median({_V}) AS median FROM obs WHERE {where} GROUP BY ALL""",
        {"mean": 6, "std": 6, "clean_pct": 7, "median": 7},
    )
    def _(spark, sf):
        rows = obs(spark, sf, *dict.fromkeys((*keys, "SampleDateTime", "SampleNumber", "VmvCode", _V, _Q))).where(where)
        return trend.summarize(rows, keys, period and period[0])


_summary("j27_station_snapshot", ["StationNumber", "VmvCode"], where="SampleDateTime < TIMESTAMP '1996-01-01 00:00:00'")
_summary("j27_parameter_comparison", ["VmvCode", "StationNumber"], where="VmvCode = 6")
_summary("j27_basin_summary", ["RiverBasinCode", "VmvCode"], ("annual", "year"))
_summary("j27_station_series", ["StationNumber"], ("monthly", "month"))
_summary("j27_project_campaign", ["ProjectNumber"], ("quarterly", "quarter"))
_summary("j27_lab_summary", ["LabCode"], ("annual", "year"))
_summary("j27_method_summary", ["MethodCode"])
_summary("j27_lab_method_parameter", ["LabCode", "MethodCode", "VmvCode"])

_CATEGORY = """CASE WHEN regexp_matches(lower(VariableName), 'phosph|nitrogen') THEN 'nutrients' WHEN regexp_matches(lower(VariableName), 'temperature|turbidity|oxygen|ph \\(') OR lower(VariableName) = 'ph' THEN 'physical' ELSE 'other' END"""


@query(
    "j28_station_inventory",
    f"SELECT StationNumber, (year(SampleDateTime)//10*10)::INT AS decade, {_CATEGORY} AS category, count(DISTINCT SampleNumber) AS samples, count(*) AS records FROM obs GROUP BY 1,2,3",
)
def _(spark, sf):
    return trend.station_inventory(obs(spark, sf, "StationNumber", "SampleDateTime", "VariableName", "SampleNumber"))


@query(
    "j29_flag_rate_cube",
    f"""SELECT coalesce(y,'all') AS year, coalesce(q,'all') AS quarter, coalesce(c,'all') AS category, count(*) AS records, count(*) FILTER (f) AS flagged, 100.0*count(*) FILTER (f)/count(*) AS flagged_pct FROM
    (SELECT year(SampleDateTime)::VARCHAR y, quarter(SampleDateTime)::VARCHAR q, {_CATEGORY} c, NOT {_BLANK} AS f FROM obs) GROUP BY CUBE (y, q, c)""",
    "flagged_pct",
)
def _(spark, sf):
    return trend.flag_rate_breakdown(obs(spark, sf, "SampleDateTime", "VariableName", _Q))


@query(
    "j29_code_change",
    f"""WITH e AS (SELECT min(year(SampleDateTime)) a, max(year(SampleDateTime)) b FROM obs), t AS (SELECT count(*) FILTER (year(SampleDateTime)=a) ta, count(*) FILTER (year(SampleDateTime)=b) tb FROM obs, e)
    SELECT {_Q} AS code, count(*) FILTER (year(SampleDateTime)=a) AS first_year, count(*) FILTER (year(SampleDateTime)=b) AS last_year,
    100.0*count(*) FILTER (year(SampleDateTime)=b)/max(tb) - 100.0*count(*) FILTER (year(SampleDateTime)=a)/max(ta) AS change_pct FROM obs, e, t WHERE NOT {_BLANK} AND year(SampleDateTime) IN (a, b) GROUP BY 1""",
    "change_pct",
)
def _(spark, sf):
    return trend.code_trend(obs(spark, sf, "SampleDateTime", _Q))


def _codes_by(name, unit, sql, expression):
    """Rows per qualifier code and time unit with the share of the unit's rows."""

    @query(
        name,
        f"""WITH u AS (SELECT {sql} AS unit, {_Q} AS code FROM obs), t AS (SELECT unit, count(*) n FROM u GROUP BY 1)
        SELECT unit, code, count(*) AS records, 100.0*count(*)/max(n) AS share_pct FROM u JOIN t USING (unit) WHERE code IS NOT NULL AND code <> '' GROUP BY 1,2""",
        "share_pct",
    )
    def _(spark, sf):
        rows = obs(spark, sf, "SampleDateTime", _Q).groupBy(expression().alias("unit"), F.col(_Q).alias("code")).agg(F.count(F.lit(1)).alias("records"))
        size = rows.groupBy("unit").agg(F.sum("records").alias("n"))
        shares = rows.where("code is not null and code <> ''").join(size, "unit")
        return shares.select("unit", "code", "records", (100.0 * F.col("records") / F.col("n")).alias("share_pct"))


_codes_by("j29_codes_by_year", "year", "year(SampleDateTime)::INT", lambda: F.year("SampleDateTime"))
_codes_by("j29_codes_by_quarter", "quarter", "quarter(SampleDateTime)::INT", lambda: F.quarter("SampleDateTime"))


@query(
    "j29_flag_rate_by_tier",
    f"""SELECT CASE WHEN v >= 90 AND y >= 4 THEN 1 ELSE 2 END::INT AS tier, count(*) AS stations, sum(n)::BIGINT AS records, sum(f)::BIGINT AS flagged, 100.0*sum(f)/sum(n) AS flagged_pct FROM
    (SELECT StationNumber, count(DISTINCT VariableName) v, count(DISTINCT year(SampleDateTime)) y, count(*) n, count(*) FILTER (NOT {_BLANK}) f FROM obs GROUP BY 1) GROUP BY 1""",
    "flagged_pct",
)
def _(spark, sf):
    return trend.flag_rate_by_tier(obs(spark, sf, "StationNumber", "VariableName", "SampleDateTime", _Q), 90)


@query(
    "j31_station_ranking",
    f"""WITH s AS (SELECT StationNumber, arg_min(Station,row_key) AS Station, arg_min(LatitudeDecimalDegrees,row_key) AS "Latitude", arg_min(LongitudeDecimalDegrees,row_key) AS "Longitude", {_CLEAN} AS quality_score,
    count(DISTINCT VmvCode) AS parameters, floor(date_diff('day', min(SampleDateTime), max(SampleDateTime))/365.25)::BIGINT AS span_years FROM obs GROUP BY 1)
    SELECT *, 100.0 - quality_score AS flag_rate, CASE WHEN quality_score > 98 THEN 'Excellent' WHEN quality_score >= 95 THEN 'Good' WHEN quality_score >= 90 THEN 'Fair' ELSE 'Poor' END AS tier,
    rank() OVER (ORDER BY quality_score DESC) AS position FROM s""",
    "quality_score flag_rate",
)
def _(spark, sf):
    return trend.station_ranking(obs(spark, sf, "StationNumber", "Station", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees", "VmvCode", "SampleDateTime", _Q, "row_key"))


@query(
    "j26_trophic_class",
    f"""WITH y AS (SELECT StationNumber, year(SampleDateTime) y, avg({_V}) a, count(DISTINCT SampleNumber) n FROM obs WHERE contains(lower(VariableName), 'turbidity') AND month(SampleDateTime) BETWEEN 5 AND 10 AND {_V} IS NOT NULL GROUP BY 1,2)
    SELECT StationNumber, count(*) AS years, avg(a) AS mean, CASE WHEN avg(a) >= 30 THEN 'Hyper-eutrophic' WHEN avg(a) >= 25 THEN 'Eutrophic' WHEN avg(a) >= 20 THEN 'Mesotrophic' ELSE 'Oligotrophic' END AS trophic_class
    FROM y GROUP BY 1 HAVING max(n) >= 2""",
    "mean",
)
def _(spark, sf):
    limits = (("Hyper-eutrophic", 30.0), ("Eutrophic", 25.0), ("Mesotrophic", 20.0))
    return trend.trophic_class(obs(spark, sf, "StationNumber", "VariableName", "SampleDateTime", "SampleNumber", _V), "TURBIDITY", limits, 2)
