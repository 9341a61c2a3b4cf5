"""The composed reports: variable page, quality page, data exploration and audit.

Each returns lazy frames by name; ``sinks.write_outputs`` stores them. The base frame is shared, so
callers that run several of the frames keep it with ``loader.remember``.
"""

from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions.values import none_of
from hydroq.operators import audit, dimensions, filters, integrity, profile, quality, series, stats, temporal, trend
from hydroq.sources import loader


def variable_page(df, code, option="definite", stations=None, start=None, end=None, period="M", threshold=None):
    """One variable: summary, station values with quantile classes, period frames, series and slider bounds."""
    variable = filters.by_variable(df, code)
    chosen = filters.global_filters(filters.by_quality(variable, option), start, end, stations)
    codes = {"definite": S.UNRELIABLE_CODES, "broader": S.TIER_CODES}.get(option, [])
    keep = none_of("MeasurementQualifier", codes) if codes else F.lit(True)
    values = series.station_values(chosen)
    out = {
        "summary": series.statistical_summary(variable, keep),
        "unit": dimensions.active_unit(chosen),
        "periods": series.period_list(chosen, period),
        "quantile_map": series.quantile_classes(series.frames(chosen, period), ["period_start"]),
        "scale": series.scale_breaks(values),
        "center": quality.map_center(values),
        "threshold_control": series.threshold_control(chosen),
        "series": series.period_percentiles(chosen, period),
    }
    if threshold is not None:
        out["threshold_map"] = series.threshold_match(series.frames(chosen, period), threshold)
    return out


def quality_page(df, start=None, end=None, include_potentially=False, top=10):
    """Flag overview: key figures, station map, rankings over all and over the most flagged stations, matrices."""
    rows = filters.by_date_range(df, start, end) if start and end else df
    stations = quality.station_flag_stats(rows, include_potentially)
    leaders = stations.limit(top)
    return {
        "kpis": quality.kpis(rows, include_potentially),
        "map": quality.station_flag_map(rows, include_potentially),
        "variables": quality.variable_flag_stats(rows, include_potentially),
        "variables_in_top_stations": quality.variable_flag_stats(filters.rows_of(rows, leaders, ["StationNumber"]), include_potentially),
        "stations": stations,
        "variable_matrix": quality.flag_matrix(rows, "variable"),
        "station_matrix": quality.flag_matrix(rows, "station"),
    }


def exploration(df, numeric=("MeasurementValueNum",)):
    """Profiles, missing data, quality issues and statistics of a measurement frame."""
    numeric = list(numeric)
    normality = stats.normality_verdict(df)
    return {
        "dataset_profile": profile.dataset_profile(df),
        "column_analysis": profile.column_profile(df),
        "numeric_summaries": profile.numeric_summary(df, numeric),
        "missing_overall": profile.missing_by_column(df),
        "missing_by_station": profile.missing_by_station(df),
        "missing_patterns": profile.missingness_correlation(df),
        "validity_issues": profile.validity_issues(df),
        "outliers": profile.outlier_summary(df, numeric),
        "duplicates": profile.duplicate_summary(df),
        "patterns": profile.suspicion_patterns(df, numeric),
        "normality_tests": normality,
        "trends": stats.with_trend_verdict(stats.mann_kendall(df)),
        "temporal_stability": stats.temporal_stability(df),
        "synthesis": trend.synthesis(df, normality),
    }


def summary_lines(synthesis):
    """Executive summary as numbered text lines."""
    parts = [
        F.lit("DATA SUMMARY"),
        F.concat(F.lit("Rows: "), F.format_number("total_rows", 0)),
        F.concat(F.lit("Columns: "), F.col("total_columns").cast("string")),
        F.concat(F.lit("Completeness: "), F.format_number("completeness_percent", 1), F.lit("%")),
        F.concat(F.lit("Normally distributed variables: "), F.col("normal").cast("string"), F.lit(" of "), F.col("tested").cast("string")),
        F.concat(F.lit("Data quality: "), F.col("raw_data_quality")),
    ]
    return synthesis.select(F.posexplode(F.array(*parts)).alias("line_no", "text"))


def coverage(df):
    """Cardinality, registry, unit, coverage and temporal reports."""
    profiles = integrity.station_profiles(df)
    return {
        "cardinality_report": integrity.cardinality_report(df),
        "cardinality_violations": integrity.location_violations(df),
        "station_project_matrix": quality.crosstab(df, "StationNumber", "ProjectNumber"),
        "vmv_code_registry": integrity.vmv_registry(df),
        "unit_consistency_report": integrity.unit_report(df),
        "unit_violations": integrity.unit_violations(df),
        "unit_conversion_guide": integrity.unit_conversion_guide(df),
        "station_parameter_summary": integrity.station_summary(df),
        "variable_popularity": integrity.variable_popularity(df),
        "parameter_popularity": integrity.parameter_popularity(df),
        "station_profiles": profiles,
        "coverage_summary": integrity.coverage_summary(profiles),
        "temporal_coverage_by_station": temporal.coverage_by_station(df),
        "temporal_coverage_by_year": temporal.year_coverage(df),
        "seasonal_sampling_pattern": temporal.seasonal_sampling(df),
        "temporal_violations": temporal.time_travel(df),
        "qualifier_code_description_pairs": integrity.code_description_pairs(df),
    }


def audit_reports(df, keep=True):
    """The row audit and its four summaries over one audited frame."""
    audited = audit.with_issues(df)
    if keep:
        audited = loader.remember(audited)
    return {
        "data_quality_audit": audit.row_report(audited),
        "quality_summary_by_rule": audit.action_levels(audit.by_rule(audited)),
        "quality_summary_by_station": audit.by_key(audited, "StationNumber"),
        "quality_summary_by_project": audit.by_key(audited, "ProjectNumber"),
        "overall": audit.overall(audited),
    }
