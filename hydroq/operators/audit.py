"""The eleven-rule row audit and its reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions import labels as L
from hydroq.functions.values import col, contains_text, is_blank, percent, percent_or_zero, true_or_false
from hydroq.operators import integrity, temporal
from hydroq.sources.staging import stage, stage_all

TS = "SampleDateTime"
V = "MeasurementValueNum"
COLUMNS = (
    "row_key", "arrival_block", "StationNumber", "Station", "ProjectNumber", "SampleNumber", TS, "VmvCode", "VariableName",
    "UnitCode", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees", "MeasurementFlag", "MeasurementQualifier", "MeasurementValue", V,
)


# ---- rules that need only the row ----------------------------------------------------

def missing_text(column="ProjectNumber"):
    return is_blank(column)


def flag_without_qualifier(flag="S"):
    return true_or_false(col("MeasurementFlag") == flag) & is_blank("MeasurementQualifier")


def out_of_range(bounds=S.AUDIT_BOUNDS):
    """Outside the bounds of any rule whose name matches exactly or is contained.

    Breaking one of several bounds means lying under the largest minimum or over the smallest maximum.
    """
    def match(name, exact):
        return true_or_false(col("VariableName") == name) if exact else contains_text("VariableName", name)

    low = F.greatest(*[F.when(match(n, exact), F.lit(lo)) for n, exact, lo, _ in bounds], F.lit(None).cast("double"))
    high = F.least(*[F.when(match(n, exact), F.lit(hi)) for n, exact, _, hi in bounds], F.lit(None).cast("double"))
    return true_or_false(~col(V).between(low, high))


def cold_summer(limit=5.0):
    return true_or_false(F.month(TS).isin(6, 7, 8) & (col(V) < limit)) & contains_text("VariableName", "temperature")


# ---- rules that need their group -----------------------------------------------------

def codes_with_several_units(df):
    """S1: variable codes with more than one unit; a missing unit counts as one."""
    return integrity.unit_report(df).where("UniqueUnitCount > 1").select("VmvCode")


def moved_keys(df, key="StationNumber"):
    """S2: keys with more than one latitude or longitude."""
    return integrity.violating_keys(df, key, ["LatitudeDecimalDegrees", "LongitudeDecimalDegrees"])


def keys_without_core(df, key="StationNumber", core=S.CORE_VARIABLES):
    """M3: keys at which no core variable (exact name) was measured."""
    has = F.max(true_or_false(col("VariableName").isin(list(core))).cast("int"))
    return df.where(col(key).isNotNull()).groupBy(key).agg(has.alias("_core")).where("_core = 0").select(key)


def rows_after_gap(df, keys=("StationNumber",), days=S.GAP_DAYS):
    """T1: the first row of each visit that follows the previous one by more than ``days`` days."""
    return temporal.gaps(df, keys).where(col("gap_days") > days).select(*keys, TS, col("first_key").alias("row_key"), "gap_days")


def incomplete_samples(df, limit=50.0, carry=(), counts=None):
    """C1: 100 * rows with a number / (distinct variables + 1) below the limit; ``carry`` are further aggregates to keep.

    ``counts`` are the same rows reduced to parts of samples, with their rows that have a number (``numbers``) or a variable
    (``named``). A sample has no more variables than rows that name one, so the others pass without their variables being told apart.
    """
    rows = df.where(col("SampleNumber").isNotNull())
    if counts is not None:
        most = counts.where(col("SampleNumber").isNotNull()).groupBy("SampleNumber").agg(F.sum("numbers").alias("numbers"), F.sum("named").alias("named"))
        few = most.where(100.0 * col("numbers") / (col("named") + 1) < limit).select("SampleNumber")
        rows = rows.join(stage(few, "few-numbers"), "SampleNumber", "left_semi")
    s = rows.groupBy("SampleNumber").agg(
        F.count(V).alias("numbers"), F.countDistinct("VariableName").alias("variables"), *carry
    )
    return s.where(100.0 * col("numbers") / (col("variables") + 1) < limit).drop("numbers", "variables")


def sparse_years(df, fewest=3, carry=()):
    """C2: station-years with fewer samples; ``carry`` are further aggregates to keep."""
    years = df.where(col(TS).isNotNull() & col("StationNumber").isNotNull()).groupBy("StationNumber", F.year(TS).alias("Year"))
    return years.agg(F.countDistinct("SampleNumber").alias("samples"), *carry).where(col("samples") < fewest).drop("samples")


PLACE = ["LatitudeDecimalDegrees", "LongitudeDecimalDegrees"]


def _visits(df):
    """One row per visit, sample and place: whether it has a core variable, its first row key, its rows and those with a number or a variable."""
    core = F.max(true_or_false(col("VariableName").isin(S.CORE_VARIABLES)).cast("int")).alias("core")
    return df.groupBy("StationNumber", TS, "SampleNumber", *PLACE).agg(
        core, F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("rows"), F.count(V).alias("numbers"), F.count("VariableName").alias("named")
    )


def _per_station(visits):
    return visits.where(col("StationNumber").isNotNull()).groupBy("StationNumber").agg(
        (F.greatest(*[F.countDistinct(c) for c in PLACE]) > 1).alias("s2"), (F.max("core") == 0).alias("m3"), F.sum("rows").alias("rows")
    )


def station_findings(df, visits=None):
    """All station-level findings in one row per station that has any: S2, M3, C2 years, T1 row keys.

    The fact rows are reduced once to a staged table of one row per visit and sample (``visits``, if it is there
    already), which the four rules read. The lists are bounded by years and by gaps of sixty days.
    """
    reduced = stage(_visits(df), "audit-visits") if visits is None else visits
    per_station = _per_station(reduced)
    sparse = sparse_years(reduced).groupBy("StationNumber").agg(F.collect_list("Year").alias("c2"))
    late = rows_after_gap(reduced).groupBy("StationNumber").agg(F.collect_list("row_key").alias("t1"))
    all_of = per_station.join(sparse, "StationNumber", "left").join(late, "StationNumber", "left")
    return all_of.where("s2 or m3 or c2 is not null or t1 is not null").drop("rows")


def _codes_and_visits(df):
    return stage_all({"codes": codes_with_several_units(df).withColumn("s1", F.lit(True)), "visits": _visits(df)})


def _with_findings(df):
    """Rows with what their code, sample and station were found to break; the findings are staged, small tables."""
    staged = _codes_and_visits(df)
    staged |= stage_all({
        "samples": incomplete_samples(df, counts=staged["visits"]).withColumn("c1", F.lit(True)),
        "stations": station_findings(df, staged["visits"]),
    })
    codes, samples, found = staged["codes"], staged["samples"], staged["stations"]
    return df.join(codes, "VmvCode", "left").join(samples, "SampleNumber", "left").join(found, "StationNumber", "left")


def _in_arrival_order(df, rows=None):
    """Rows with the time of the row that arrived before in their project; ``rows`` are the same rows before they were widened."""
    df, rows = (d if d is None else d.withColumn("_p", F.coalesce("ProjectNumber", F.lit(""))) for d in (df, rows))
    return temporal.with_arrival_previous(df, ["_p"], rows)


def _went_back():
    """T2: a project's row whose time lies before that of the row arriving just before."""
    return (col("_p") != "") & (col(TS) < col("previous"))


def _broken():
    """The conditions of the rules that need findings, on rows with findings."""
    return {
        "S1": col("s1"),
        "S2": col("s2"),
        "M3": col("m3"),
        "T1": F.array_contains("t1", col("row_key")),
        "C1": col("c1"),
        "C2": F.array_contains("c2", F.year(TS)),
    }


def _own_rules():
    """The rules that need only the row."""
    return {"S3": missing_text(), "M1": flag_without_qualifier(), "M2": out_of_range(), "T3": cold_summer()}


RULES = [rule for rule, _ in S.AUDIT_RULES]


def _bits(broken):
    """The rules that a row breaks as bits of one number."""
    return sum((F.when(true_or_false(rule), F.lit(1 << RULES.index(name))).otherwise(0) for name, rule in broken.items()), F.lit(0))


def with_issues(df):
    """Rows with ``issues``, the list of rule codes they break.

    The rules of the row itself become one number first, and those that need findings join it where the findings meet the rows. Only
    then are rows dealt out by project, so neither the columns behind the rules nor the keys of the findings need to travel.
    """
    found = _with_findings(df.withColumn("_own", _bits(_own_rules())))
    told = found.withColumn("_told", col("_own") + _bits(_broken())).select(*df.columns, "_told")
    rows = _in_arrival_order(told, df)
    broken = {name: col("_told").bitwiseAND(1 << i) != 0 for i, name in enumerate(RULES)} | {"T2": _went_back()}
    marks = [F.when(true_or_false(broken[rule]), F.lit(rule)) for rule in RULES]
    return rows.withColumn("issues", F.array_compact(F.array(*marks))).select(*df.columns, "issues")


# ---- reports -------------------------------------------------------------------------

def row_report(audited):
    """Rows with at least one issue, with the issue text and count."""
    text = F.concat(F.array_join(F.transform("issues", lambda r: L.lookup(r, S.AUDIT_TAGS)), ";"), F.lit(";"))
    return audited.where(F.size("issues") > 0).select(
        "row_key", "StationNumber", "Station", TS, "VariableName", V, "MeasurementFlag",
        text.alias("audit_issues"), F.size("issues").alias("IssueCount"),
    )


def by_rule(audited):
    """Rows per rule, rules without findings included."""
    return _listed(audited.agg(*[F.count_if(F.array_contains("issues", rule)).alias(rule) for rule, _ in S.AUDIT_RULES]))


def rule_counts(df):
    """The counts of ``by_rule`` without audited rows: each rule is counted where its groups are, so no findings go back to the rows.

    Arrival order is only followed by project, place and time; rows after a gap are looked up by station and row key alone.
    """
    rows = F.sum("rows").alias("rows")
    staged = _codes_and_visits(df)
    visits = staged["visits"]
    gaps = stage(rows_after_gap(visits).select("StationNumber", "row_key").distinct(), "gap-rows")
    stations = _per_station(visits)
    own = {"S1": col("s1"), **_own_rules()}
    counts = df.join(staged["codes"], "VmvCode", "left").agg(*[F.count_if(true_or_false(broken)).alias(rule) for rule, broken in own.items()])
    sums = {
        "S2": stations.where("s2").agg(rows),
        "M3": stations.where("m3").agg(rows),
        "C1": incomplete_samples(df, carry=[F.count(F.lit(1)).alias("rows")], counts=visits).agg(rows),
        "C2": sparse_years(visits, carry=[rows]).agg(rows),
        "T1": df.select("StationNumber", "row_key").join(gaps, ["StationNumber", "row_key"], "left_semi").agg(F.count(F.lit(1))),
        "T2": _in_arrival_order(df.select("row_key", "arrival_block", "ProjectNumber", TS)).agg(F.count_if(true_or_false(_went_back()))),
    }
    return _listed(counts.withColumns({rule: F.coalesce(frame.scalar(), F.lit(0)) for rule, frame in sums.items()}))


def _listed(counts):
    cells = [F.struct(F.lit(name).alias("Rule"), F.col(rule).alias("RecordCount")) for rule, name in S.AUDIT_RULES]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*").orderBy(F.desc("RecordCount"), "Rule")


def by_key(audited, key):
    """Issue rows, clean rows, all rows and compliance of keys that have issues."""
    out = audited.where(col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.size("issues") > 0).alias("IssueCount"),
        F.count_if(F.size("issues") == 0).alias("CompleteRecords"),
        F.count(F.lit(1)).alias("TotalRecords"),
    )
    return out.where("IssueCount > 0").withColumn("CompliancePct", percent("CompleteRecords", "TotalRecords")).orderBy("CompliancePct", key)


def overall(audited):
    return audited.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.size("issues") == 0).alias("passed")
    ).withColumn("compliance_pct", percent_or_zero("passed", "records"))


# Severity and action level per rule (fixed values).
SEVERITY = {
    "S1": ("ERROR", "critical"), "S2": ("WARNING", "medium"), "S3": ("WARNING", "high"), "M1": ("WARNING", "low"),
    "M2": ("WARNING", "medium"), "M3": ("WARNING", "low"), "T1": ("WARNING", "medium"), "T2": ("ERROR", "high"),
    "T3": ("INFO", "low"), "C1": ("WARNING", "none"), "C2": ("WARNING", "low"),
}


def action_levels(rule_counts):
    """Rule counts with severity and action level."""
    code = F.substring("Rule", 1, 2)
    return rule_counts.withColumns({
        "severity": L.lookup(code, {k: v[0] for k, v in SEVERITY.items()}),
        "action_level": L.lookup(code, {k: v[1] for k, v in SEVERITY.items()}),
    })


# ---- method and laboratory rules -----------------------------------------------------

def limit_plausibility(df):
    """MD2: smallest number and largest limit per method, and whether the limit lies above the number."""
    out = df.where(col("MethodCode").isNotNull()).groupBy("MethodCode").agg(
        F.min(V).alias("min_value"), F.max("MethodDetectionLimit").alias("max_limit"), F.count(V).alias("numbers")
    )
    return out.withColumn("limit_above_minimum", true_or_false(col("max_limit") > col("min_value")))


def below_limit_encoding(df):
    """MD3: how results below detection are written, per variable."""
    number, mdl = col(V), col("MethodDetectionLimit")
    out = df.where(col("VariableName").isNotNull()).groupBy("VariableName").agg(
        F.count_if(number == 0).alias("zeros"),
        F.count_if(col("MeasurementValue").isNull()).alias("nulls"),
        F.count_if(col("MeasurementValue").startswith("<")).alias("less_than_texts"),
        F.count_if((number > 0) & (number < mdl)).alias("small_positives"),
    )
    kinds = sum(((F.col(c) > 0).cast("int") for c in ("nulls", "less_than_texts", "small_positives")), (F.col("zeros") > 0).cast("int"))
    return out.withColumn("encodings", kinds)


def samples_with_lab_issue(df):
    """L1: samples with several laboratories or with rows that name none."""
    s = df.where(col("SampleNumber").isNotNull()).groupBy("SampleNumber").agg(
        F.countDistinct("LabCode").alias("labs"), F.count_if(col("LabCode").isNull()).alias("unnamed")
    )
    return s.where((col("labs") != 1) | (col("unnamed") > 0))


def lab_stability(df, jump=5.0):
    """L3: out-of-range and flag rate per laboratory and year, and the change to the year before."""
    yearly = df.where(col("LabCode").isNotNull()).groupBy("LabCode", F.year(TS).alias("Year")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(out_of_range()).alias("out_of_range"),
        F.count_if(~is_blank("MeasurementQualifier")).alias("flagged"),
    ).withColumns({"outlier_pct": percent("out_of_range", "records"), "flagged_pct": percent("flagged", "records")})
    before = Window.partitionBy("LabCode").orderBy("Year")
    change = yearly.withColumn("flagged_change", col("flagged_pct") - F.lag("flagged_pct").over(before))
    return change.withColumn("jump", true_or_false(F.abs("flagged_change") > jump))


# ---- share classes -------------------------------------------------------------------

def share_classes(df, keys, columns):
    """Completeness and missing classes per key and column, from one aggregate."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), percent(f"_{c}", "_n").alias("filled_pct")) for c in columns])
    long = agg.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return long.withColumns({
        "completeness": L.share_class("filled_pct", S.COMPLETENESS_CLASSES, "poor"),
        "missing": L.share_class(100.0 - col("filled_pct"), S.MISSING_CLASSES, "good"),
    })


def sampling_frequency_class(df):
    """Samples per covered year and station, classified."""
    s = df.groupBy("StationNumber").agg(F.countDistinct("SampleNumber").alias("samples"), F.countDistinct(F.year(TS)).alias("years"))
    rate = s.withColumn("samples_per_year", col("samples") / col("years"))
    return rate.withColumn("frequency", L.share_class("samples_per_year", S.FREQUENCY_CLASSES, "none"))


def below_limit_class(df, keys=("VmvCode",)):
    out = df.groupBy(*keys).agg((F.avg(L.is_below_limit().cast("double")) * 100).alias("below_pct"))
    return out.withColumn("alert", L.share_class("below_pct", S.BELOW_LIMIT_CLASSES, "none"))


def trend_filter_set(df, years=3, samples=3, gap_days=120):
    """Rows of stations fit for trends: enough years and samples per year, no longer gap.

    Sparse station-years, visits after a sixty-day gap and codes with several units are left out.
    """
    yearly = df.groupBy("StationNumber", F.year(TS).alias("Year")).agg(F.countDistinct("SampleNumber").alias("n"))
    enough = yearly.groupBy("StationNumber").agg(F.count(F.lit(1)).alias("y"), F.min("n").alias("fewest"))
    steady = temporal.gaps(df).groupBy("StationNumber").agg(F.max("gap_days").alias("gap"))
    fit = enough.join(steady, "StationNumber").where((col("y") >= years) & (col("fewest") >= samples) & (F.coalesce("gap", F.lit(0)) <= gap_days))
    rows = df.withColumn("Year", F.year(TS)).join(fit.select("StationNumber"), "StationNumber", "left_semi")
    rows = rows.join(sparse_years(df), ["StationNumber", "Year"], "left_anti").drop("Year")
    late = rows_after_gap(df).select("StationNumber", TS, "row_key")
    rows = rows.join(late, ["StationNumber", TS, "row_key"], "left_anti")
    return rows.join(codes_with_several_units(df), "VmvCode", "left_anti")


def snapshot_filter_set(df):
    """Rows of samples that pass the completeness rule."""
    return df.join(incomplete_samples(df), "SampleNumber", "left_anti")
