"""Labels, classes and period keys as column expressions."""

from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions.values import any_of, col, contains_text, ladder, to_number

Q = "MeasurementQualifier"

PERIODS = ("event", "daily", "weekly", "monthly", "quarterly", "annual", "seasonal")
_ALIASES = {
    "D": "daily", "W": "weekly", "M": "monthly", "Q": "quarterly", "Y": "annual",
    "Weekly": "weekly", "Monthly": "monthly", "Quarterly": "quarterly", "Yearly": "annual", "Seasonal": "seasonal",
}


def period_name(period, default="monthly"):
    """Normalise a period code; unknown codes fall back to ``default``."""
    name = _ALIASES.get(period, period)
    return name if name in PERIODS else default


def year_text(ts):
    return F.year(col(ts)).cast("string")


def season(ts):
    m = F.month(col(ts))
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )


def season_order(ts):
    """Winter, Spring, Summer, Fall inside the calendar year; December stays in its own year."""
    return (F.month(col(ts)) % 12 / 3).cast("int")


def season_label(ts):
    return F.concat_ws(" ", year_text(ts), season(ts))


def period_start(ts, period):
    """First instant of the period, a sortable key next to the label text."""
    ts, period = col(ts), period_name(period)
    if period == "event":
        start = ts
    elif period == "seasonal":
        start = F.make_date(F.year(ts), season_order(ts) * 3 + 1, F.lit(1))
    else:
        unit = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}[period]
        start = F.date_trunc(unit, ts)
    return start.cast("timestamp_ntz")


def period_label(ts, period):
    """Period text: 2020-01, 2020Q4, 2020, 2019-12-30/2020-01-05 (Monday to Sunday) or '2020 Winter'."""
    ts, period = col(ts), period_name(period)
    if period == "seasonal":
        return season_label(ts)
    if period == "annual":
        return year_text(ts)
    if period == "quarterly":
        return F.concat(year_text(ts), F.lit("Q"), F.quarter(ts).cast("string"))
    if period == "weekly":
        monday = F.date_trunc("week", ts).cast("date")
        return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))
    if period == "daily":
        return ts.cast("date").cast("string")
    if period == "event":
        return ts.cast("string")
    return F.date_format(ts, "yyyy-MM")


def with_temporal_features(df, ts="SampleDateTime"):
    return df.withColumns({
        "Year": F.year(ts),
        "Month": F.month(ts),
        "YearMonth": F.date_format(ts, "yyyy-MM"),
        "Quarter": F.quarter(ts),
        "DayOfYear": F.dayofyear(ts),
    })


QUARTER_NAMES = {1: "Q1 (Jan-Mar)", 2: "Q2 (Apr-Jun)", 3: "Q3 (Jul-Sep)", 4: "Q4 (Oct-Dec)"}
MONTH_NAMES = dict(enumerate(["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"], 1))


def lookup(c, table):
    """Value of a small fixed dict, null for unknown keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))


# ---- qualifier classes ---------------------------------------------------------------

def qualifier_class(q=Q):
    q = col(q)
    return (
        F.when(q.isNull() | q.isin("", "nan"), "Clean")
        .when(q.isin(S.SUSPECT_CODES), "Suspect")
        .when(q.isin(S.ACCEPTABLE_CODES), "Acceptable")
        .otherwise("Other")
    )


def quality_category(q=Q):
    return (
        F.when(col(q).isin(S.UNRELIABLE_CODES), "Unreliable")
        .when(col(q).isin(S.POTENTIALLY_UNRELIABLE_CODES), "Potentially Unreliable")
        .otherwise("Clean")
    )


def is_tier_flagged(include_potentially=False, q=Q):
    codes = S.TIER_CODES if include_potentially else S.UNRELIABLE_CODES
    return F.coalesce(col(q).isin(codes), F.lit(False))


def report_category(q=Q):
    """Five report classes; where several apply the later rule of the list wins."""
    q = col(q)
    return (
        F.when(q.contains("SPNF"), "Procedure Deviation")
        .when(q.contains("SUS"), "Suspect")
        .when(q.contains("HT"), "Hold Time Issue")
        .when(q.isin("OBS", "FSE", "RER"), "Valid with Info")
        .otherwise("Clean Data")
    )


def with_review_columns(df, q=Q):
    q = col(q)
    return df.withColumns({
        "quality_flag": F.coalesce(q.isin(S.REVIEW_CODES), F.lit(False)),
        "is_flagged": q.isNotNull(),
        "data_quality": F.coalesce(q, F.lit("CLEAN")),
        "hold_time_flag": F.coalesce(q.contains("HT"), F.lit(False)),
    })


# Severity of one qualifier part: 3 = exclude, 2 = caution, 1 = information.
SEVERITY = {"SUS": 3, "HT": 2, "DR": 2, "SPNF": 2, "EST": 2, "RER": 1, "OBS": 1, "FSE": 1}


def qualifier_parts(q=Q):
    """Codes of a pipe-joined qualifier; null and empty text give an empty list."""
    return F.filter(F.split(F.coalesce(col(q), F.lit("")), "\\|"), lambda x: x != "")


def qualifier_severity(q=Q):
    """The most restrictive part decides; no qualifier is 0."""
    levels = F.transform(qualifier_parts(q), lambda p: F.coalesce(lookup(p, SEVERITY), F.lit(1)))
    return F.coalesce(F.array_max(levels), F.lit(0))


def qualifier_colour(q=Q):
    q = col(q)
    return F.when(q.isNull(), "clean").when(q.isin(S.SUSPECT_CODES), "suspect").otherwise("other")


# ---- display classes -----------------------------------------------------------------

def station_class(pct_clean, threshold=90.0):
    return F.when(col(pct_clean) >= 95, "Excellent").when(col(pct_clean) >= threshold, "Good").otherwise("Poor")


def marker_radius(rows):
    return F.least(4 + col(rows) / 200.0, F.lit(15.0)).cast("double")


def flag_rate_class(pct):
    p = col(pct)
    return F.when(p == 0, "0%").when(p <= 5, ">0-5%").when(p <= 10, "5-10%").otherwise(">10%")


COVERAGE_LEVELS = ["Minimal (<3 vars)", "Basic (3-7 vars)", "Moderate (7-12 vars)", "Comprehensive (12+ vars)"]


def coverage_order(n):
    """Position of the right-closed bin (0,3], (3,7], (7,12], (12,100]; outside is null."""
    n = col(n)
    return F.when(n <= 0, None).when(n <= 3, 0).when(n <= 7, 1).when(n <= 12, 2).when(n <= 100, 3)


def coverage_level(n):
    return lookup(coverage_order(n), dict(enumerate(COVERAGE_LEVELS)))


def frequency_class(avg_gap):
    g = col(avg_gap)
    return (
        F.when(g < 10, "Weekly or more").when(g < 35, "Monthly").when(g < 100, "Quarterly").otherwise("Annual or less")
    )


def share_class(value, steps, default):
    return ladder(value, steps, default)


def station_label(number="StationNumber", name="Station"):
    return F.concat(col(number), F.lit(" ("), F.coalesce(col(name), F.lit("nan")), F.lit(")"))


def code_label(code, name):
    """'code - name', or the code alone without a name."""
    return F.concat_ws(" - ", col(code).cast("string"), col(name))


def variable_key_label(vmv="VmvCode", code="VariableCode", name="VariableName"):
    vmv, code, name = col(vmv).cast("string"), col(code).cast("string"), col(name)
    return (
        F.when(code.isNotNull() & name.isNotNull(), F.concat(name, F.lit(" ("), vmv, F.lit("-"), code, F.lit(")")))
        .when(name.isNotNull(), F.concat(name, F.lit(" ("), vmv, F.lit(")")))
        .otherwise(vmv)
    )


def code_of_label(label):
    return F.when(col(label).contains(" - "), F.trim(F.split_part(col(label), F.lit(" - "), F.lit(1)))).otherwise(
        col(label)
    )


def metric_text(value, decimals=2):
    return F.coalesce(F.format_number(col(value), decimals), F.lit("N/A"))


def station_code_parts(number="StationNumber"):
    """Province, major basin, sub-basin letters and serial of a code such as AB05CE0350."""
    pattern = r"^([A-Z]{2})(\d{2})(.{2})(.+)$"
    return {
        name: F.regexp_extract(col(number), pattern, i)
        for i, name in enumerate(["province", "basin", "sub_basin", "serial"], 1)
    }


OBSERVATION_LEVELS = {0: "Absent", 1: "Low", 2: "Moderate", 3: "High"}


def observation_level(value):
    return lookup(to_number(value).cast("int"), OBSERVATION_LEVELS)


# ---- detection limit -----------------------------------------------------------------

def is_below_limit(value="MeasurementValue", flag="MeasurementFlag", mdl="MethodDetectionLimit"):
    """Below detection: '<x' text, flag L, or a number under the method limit."""
    return any_of([
        F.coalesce(col(value).startswith("<"), F.lit(False)),
        F.coalesce(col(flag) == "L", F.lit(False)),
        F.coalesce(to_number(value) < col(mdl), F.lit(False)),
    ])


def below_limit_value(strategy, value="MeasurementValue", flag="MeasurementFlag", mdl="MethodDetectionLimit"):
    """Numeric value with below-detection rows excluded (null) or replaced by half the limit."""
    number, below = to_number(value), is_below_limit(value, flag, mdl)
    if strategy == "exclude":
        return F.when(~below, number)
    if strategy == "half":
        return F.when(below, col(mdl) / 2).otherwise(number)
    if strategy == "keep":
        return number
    raise ValueError(f"unknown below-detection strategy: {strategy}")


def parameter_is_sensitive(name="VariableName"):
    """Parameters for which a missed hold time makes the value unusable."""
    return any_of([contains_text(name, w) for w in ("oxygen", "ph", "temperature", "alkalinity", "volatile")])
