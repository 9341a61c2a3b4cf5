"""Missing-data, profile, outlier and duplicate queries over the measurement view."""

from pyspark.sql import functions as F

from hydroq.operators import profile
from hydroq.plans.catalog import obs, query

_COLS = ["StationNumber", "VmvCode", "VariableName", "MeasurementFlag", "UnitCode", "SampleDetectLimit", "MeasurementQualifier", "MethodDetectionLimit", "MeasurementValueNum"]
_TYPES = {"VmvCode": "int", "SampleDetectLimit": "double", "MethodDetectionLimit": "double", "MeasurementValueNum": "double"}


@query(
    "f22_missing_by_column",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, 100.0*(count(*)-count({c}))/count(*) AS missing_percent, '{_TYPES.get(c, 'string')}' AS data_type FROM obs" for c in _COLS
    ),
    "missing_percent",
)
def _(spark, sf):
    return profile.missing_by_column(obs(spark, sf, *_COLS))


@query(
    "f23_missing_by_station",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(p) AS missing_percent FROM (SELECT 100.0*(count(*)-count({c}))/count(*) p FROM obs GROUP BY StationNumber)" for c in _COLS[1:]
    ),
    "missing_percent",
)
def _(spark, sf):
    return profile.missing_by_station(obs(spark, sf, *_COLS))


_NULLED = ["MeasurementFlag", "UnitCode", "SampleDetectLimit", "MeasurementQualifier", "MethodDetectionLimit", "MeasurementValueNum", "VmvCode"]
_PAIRS = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, CASE WHEN count({a}) IN (0, count(*)) OR count({b}) IN (0, count(*)) THEN NULL ELSE corr(({a} IS NULL)::INT, ({b} IS NULL)::INT) END AS correlation,
    1 - count({a})/count(*) AS rate_a, 1 - count({b})/count(*) AS rate_b FROM obs"""
    for i, a in enumerate(_NULLED) for b in _NULLED[i + 1:]
)


@query("f24_missingness_correlation", _PAIRS, "correlation rate_a rate_b", digits=9)
def _(spark, sf):
    return profile.missingness_correlation(obs(spark, sf, *_NULLED))


@query(
    "f25_missing_mechanism",
    f"""WITH p AS ({_PAIRS}), b AS (SELECT a AS "column", rate_a AS missing_rate, b AS other, correlation FROM p UNION ALL SELECT b, rate_b, a, correlation FROM p)
    SELECT "column", max(missing_rate) AS missing_rate, coalesce(array_to_string(list_sort(list(other) FILTER (abs(correlation) > 0.1)), ', '), '') AS correlated_with,
    CASE WHEN count(*) FILTER (abs(correlation) > 0.1) > 0 THEN 'MAR' ELSE 'MCAR' END AS mechanism FROM b WHERE missing_rate > 0 GROUP BY 1""",
    "missing_rate",
)
def _(spark, sf):
    return profile.missing_mechanism(obs(spark, sf, *_NULLED))


_DUP = ["StationNumber", "VariableName", "SampleDateTime", "MeasurementFlag", "UnitCode", "MeasurementQualifier"]
_DUP_N = f"(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) n FROM obs GROUP BY {', '.join(_DUP)}) WHERE n > 1)"


@query("f26_dataset_profile", f"SELECT count(*) AS rows, 6 AS columns, count(*)*6 AS total_cells, {_DUP_N} AS duplicate_rows FROM obs")
def _(spark, sf):
    return profile.dataset_profile(obs(spark, sf, *_DUP))


@query(
    "f27_column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null_count, count(*)-count({c}) AS null_count, count(DISTINCT {c}) AS unique_values, 100.0*(count(*)-count({c}))/count(*) AS null_percent,
        count(*)-count(DISTINCT {c}) AS duplicate_values, """
        + (f"(SELECT string_agg(v || '=' || n, '; ' ORDER BY n DESC, v) FROM (SELECT {c} v, count(*) n FROM obs WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_values" if c not in _TYPES else "NULL AS top_values")
        + " FROM obs"
        for c in _COLS
    ),
    "null_percent",
)
def _(spark, sf):
    out = profile.column_profile(obs(spark, sf, *_COLS))
    # a map cell has no SQL counterpart to compare with, so it is shown as text
    return out.withColumn("top_values", F.array_join(F.transform(F.map_entries("top_values"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "; "))


_NUM = ["MeasurementValueNum", "SampleDetectLimit", "MethodDetectionLimit", "LatitudeDecimalDegrees"]


def _summary_sql(keys="", group=""):
    """Moments by hand: the SQL engine's skewness is bias-corrected, ours is the population one."""
    parts = [
        f"""SELECT {keys}'{c}' AS name, count(v) AS count, (count(*)-count(v)) AS missing, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
        avg((v-m)**3)/nullif(avg((v-m)**2)**1.5, 0) AS skewness, avg((v-m)**4)/nullif(avg((v-m)**2)**2, 0) - 3 AS kurtosis, quantile_cont(v,0.25) AS p25, median(v) AS median, quantile_cont(v,0.75) AS p75,
        100.0*(count(*)-count(v))/count(*) AS missing_pct FROM (SELECT {keys}{c} AS v, avg({c}) OVER ({'PARTITION BY ' + keys.rstrip(', ') if keys else ''}) AS m FROM obs) {group}"""
        for c in (_NUM if not keys else _NUM[:1])
    ]
    return " UNION ALL ".join(parts)


_SUMMARY = "mean std skewness kurtosis p25 median p75 missing_pct"


@query("f28_numeric_summary", _summary_sql(), _SUMMARY, digits=6)
def _(spark, sf):
    return profile.numeric_summary(obs(spark, sf, *_NUM), _NUM)


@query("f28_numeric_summary_by_variable", _summary_sql("VmvCode, ", "GROUP BY VmvCode"), _SUMMARY, digits=6)
def _(spark, sf):
    return profile.numeric_summary(obs(spark, sf, "VmvCode", _NUM[0]), _NUM[:1], "VmvCode")


_STATS = """(SELECT VmvCode, avg(MeasurementValueNum) c, stddev_pop(MeasurementValueNum) s, quantile_cont(MeasurementValueNum,0.25) q1, quantile_cont(MeasurementValueNum,0.75) q3 FROM obs GROUP BY 1 HAVING count(MeasurementValueNum) >= 3)"""
_IS_OUT = {
    "zscore": "abs((MeasurementValueNum - c)/nullif(s,0)) > {z}",
    "iqr": "(MeasurementValueNum < q1 - 1.5*(q3-q1) OR MeasurementValueNum > q3 + 1.5*(q3-q1))",
}


def _outliers(name, method, key):
    stats = _STATS.replace("VmvCode", key)

    @query(
        name,
        f"""SELECT {key}, count(*) FILTER ({_IS_OUT[method].format(z=3)}) AS outlier_count, count(MeasurementValueNum) AS numbers,
        100.0*count(*) FILTER ({_IS_OUT[method].format(z=3)})/count(MeasurementValueNum) AS outlier_percent FROM obs JOIN {stats} USING ({key}) GROUP BY 1""",
        "outlier_percent",
    )
    def _(spark, sf):
        return profile.outlier_counts(obs(spark, sf, key, "MeasurementValueNum"), [key], method=method)


_outliers("f29_outliers_zscore", "zscore", "UnitCode")
_outliers("f30_outliers_iqr", "iqr", "UnitCode")


@query(
    "f30_outlier_rows",
    f"SELECT row_key, UnitCode, MeasurementValueNum FROM obs JOIN {_STATS.replace('VmvCode', 'UnitCode')} USING (UnitCode) WHERE {_IS_OUT['iqr']}",
)
def _(spark, sf):
    rows = profile.with_outlier_flag(obs(spark, sf, "row_key", "UnitCode", "MeasurementValueNum"), ["UnitCode"])
    return rows.where("is_outlier").drop("is_outlier")


_OUT_COLS = ["MeasurementValueNum", "SampleDetectLimit", "MethodDetectionLimit", "LatitudeDecimalDegrees", "LabCode"]


@query(
    "f32_outlier_summary",
    " UNION ALL ".join(
        f"""SELECT "column", outlier_count, 100.0*outlier_count/f AS outlier_percent, method FROM (SELECT '{c}' AS "column", '{m}' AS method, count(*) n, count({c}) f,
        count(*) FILTER ({_IS_OUT[m].format(z=3).replace('MeasurementValueNum', c)}) AS outlier_count FROM obs,
        (SELECT avg({c}) c, stddev_pop({c}) s, quantile_cont({c}::DOUBLE,0.25) q1, quantile_cont({c}::DOUBLE,0.75) q3 FROM obs)) WHERE outlier_count > 0 AND f >= 0.5*n"""
        for c in _OUT_COLS for m in ("zscore", "iqr")
    ),
    "outlier_percent",
)
def _(spark, sf):
    return profile.outlier_summary(obs(spark, sf, *_OUT_COLS), _OUT_COLS)


def _validity_sql(hit):
    bounds = [("pH", 0, 14), ("Temperature", -5, 40), ("Conductivity", 0, 100000), ("Turbidity", 0, 5000), ("Dissolved Oxygen", 0, 20), ("Total Suspended Solids", 0, 50000), ("Nitrogen", 0, 1000), ("Phosphorus", 0, 100)]
    tests = [(n, "below_minimum", f"Min: {lo}", f"MeasurementValueNum < {lo}") for n, lo, hi in bounds] + [(n, "above_maximum", f"Max: {hi}" if hi != 100000 else "Max: 100000", f"MeasurementValueNum > {hi}") for n, lo, hi in bounds]
    tests.append(("Dissolved Oxygen", "below_recommended", "Recommended Min: 5", "MeasurementValueNum < 5 AND MeasurementValueNum >= 0"))
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS parameter, '{k}' AS issue_type, '{t}' AS \"constraint\", count(*) FILTER ({c}) AS count, 100.0*count(*) FILTER ({c})/count(*) AS percent FROM obs WHERE {hit(n.lower())}" for n, k, t, c in tests
    ) + ") WHERE count > 0"


@query("f33_validity_issues", _validity_sql(lambda n: f"contains(lower(VariableName), '{n}')"), "percent")
def _(spark, sf):
    return profile.validity_issues(obs(spark, sf, "VariableName", "MeasurementValueNum"), recommended={"Dissolved Oxygen": 5.0})


@query("f33_validity_issues_word", _validity_sql(lambda n: f"regexp_matches(lower(VariableName), '\\b{n}\\b')"), "percent")
def _(spark, sf):
    return profile.validity_issues(obs(spark, sf, "VariableName", "MeasurementValueNum"), recommended={"Dissolved Oxygen": 5.0}, match="word")


@query(
    "f34_duplicates",
    f"""SELECT {_DUP_N} AS exact_duplicates, (SELECT coalesce(sum(n),0)::BIGINT FROM (SELECT count(*) n FROM obs GROUP BY StationNumber, SampleDateTime, VariableName) WHERE n > 1) AS key_column_duplicates""",
)
def _(spark, sf):
    return profile.duplicate_summary(obs(spark, sf, *_DUP))


_SUSPECT = ["CollectionCode", "StationTypeCode", "VmvCode", "MeasurementValueNum", "MethodDetectionLimit", "LabCode"]


@query(
    "f35_suspicion_patterns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'all_identical_value' AS pattern, min({c})::DOUBLE AS value, count({c}) AS count, NULL::DOUBLE AS percent_round FROM obs HAVING count(DISTINCT {c}) = 1 AND count({c}) > 10
        UNION ALL SELECT '{c}', 'suspiciously_round', NULL, count({c}), 100.0*count(*) FILTER ({c} % 1 = 0)/count({c}) FROM obs HAVING count({c}) > 100 AND 100.0*count(*) FILTER ({c} % 1 = 0)/count({c}) > 80
        UNION ALL SELECT '{c}', 'all_missing', NULL, 0, NULL FROM obs HAVING count({c}) = 0"""
        for c in _SUSPECT
    ),
    "percent_round",
)
def _(spark, sf):
    return profile.suspicion_patterns(obs(spark, sf, *_SUSPECT), _SUSPECT)
