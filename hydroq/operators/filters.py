"""Row filters. All are plain predicates, so they reach the scan."""

import datetime

from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions import labels as L
from hydroq.functions.values import any_of, col, contains_text, none_of, true_or_false

Q = "MeasurementQualifier"
TS = "SampleDateTime"


def by_date_range(df, start, end, ts=TS):
    """Inclusive on both days, written on the raw column so that it is pushed down.

    A table that is partitioned by Year is pruned to the years of the range as well.
    """
    if "Year" in df.columns:
        df = df.where(col("Year").between(int(str(start)[:4]), int(str(end)[:4])))
    end_open = datetime.date.fromisoformat(str(end)) + datetime.timedelta(days=1)
    low = F.lit(f"{start} 00:00:00").cast("timestamp_ntz")
    return df.where((col(ts) >= low) & (col(ts) < F.lit(f"{end_open} 00:00:00").cast("timestamp_ntz")))


def by_values(df, column, values):
    """Keep listed values; an empty list filters nothing."""
    return df.where(col(column).isin(list(values))) if values else df


def by_stations(df, stations):
    return by_values(df, "StationNumber", stations)


def by_parameters(df, codes):
    return by_values(df, "VmvCode", codes)


def global_filters(df, start=None, end=None, stations=None, codes=None):
    if start is not None and end is not None:
        start, end = min(str(start), str(end)), max(str(start), str(end))
        df = by_date_range(df, start, end)
    return by_parameters(by_stations(df, stations), codes)


def by_quality(df, option):
    """'definite' drops unreliable codes, 'broader' also potentially unreliable ones; else all rows."""
    codes = {"definite": S.UNRELIABLE_CODES, "broader": S.TIER_CODES}.get(option)
    return df.where(none_of(Q, codes)) if codes else df


def suspicious(df):
    return df.where(col(Q).isin(S.SUSPECT_CODES))


def by_date_preset(df, preset, ts=TS):
    """Rows of the last 365 or 1,825 days before the newest row; any other preset keeps all."""
    days = {"Last year": 365, "Last 5 years": 1825}.get(preset)
    if days is None:
        return df
    newest = df.agg(F.date_sub(F.max(ts).cast("date"), days)).scalar()
    return df.where(col(ts) >= newest.cast("timestamp_ntz"))


def preset_range(df, preset, ts=TS):
    """The (start, end) dates a preset stands for, as a one-row frame."""
    days = {"Last year": 365, "Last 5 years": 1825}.get(preset)
    low, high = F.min(ts).cast("date"), F.max(ts).cast("date")
    start = F.greatest(low, F.date_sub(high, days)) if days else low
    return df.agg(start.alias("start_date"), high.alias("end_date"))


def version_predicate(version):
    name = version.upper()
    if name in ("A", "B"):
        return none_of(Q, S.SUSPECT_CODES)
    if name == "C":
        return F.lit(True)
    raise ValueError(f"unknown dataset version: {version}")


def dataset_version(df, version):
    keep = version_predicate(version)
    if version.upper() == "C":
        return df
    rows = df.where(keep)
    return L.with_review_columns(rows) if version.upper() == "B" else rows


def with_versions(df, versions=("A", "B", "C")):
    """Rows of every version they belong to, one pass: the row is copied once per version."""
    tags = F.array_compact(F.array(*[F.when(version_predicate(v), F.lit(v)) for v in versions]))
    return df.withColumn("version", F.explode(tags))


def strict_baseline(df):
    """No code that contains SUS or HT."""
    return df.where(col(Q).isNull() | ~(col(Q).contains("SUS") | col(Q).contains("HT")))


def drop_sensitive_hold_time(df):
    """Drop missed hold times only where the parameter does not keep."""
    missed = true_or_false(F.array_contains(L.qualifier_parts(Q), "HT"))
    return df.where(~(missed & L.parameter_is_sensitive()))


def by_variable(df, vmv_code):
    return df.where(col("VmvCode") == vmv_code)


def with_all(df, columns):
    return df.dropna(subset=list(columns))


def text_contains(df, column, fragment):
    return df.where(contains_text(column, fragment))


def search_stations(stations, fragment):
    """Stations whose number or name contains the text, ignoring case."""
    return stations.where(any_of([contains_text(c, fragment) for c in ("StationNumber", "Station")]))


def rows_of(df, keys_frame, keys):
    """Semi-join; the planner broadcasts the key side only when its size allows it."""
    return df.join(keys_frame.select(*keys), list(keys), "left_semi")


# Accept / caution / exclude per analysis and single code (fixed table; order of CODES).
MATRIX_CODES = ["OBS", "FSE", "HT", "SUS", "DR", "SPNF", "RER", "EST"]
EXCLUSION_MATRIX = {
    "trend": "accept accept caution exclude accept caution accept caution".split(),
    "baseline": "accept accept caution exclude accept caution accept caution".split(),
    "basin": "accept accept accept exclude accept caution accept accept".split(),
    "anomaly": ["accept"] * 8,
    "report": ["accept"] * 8,
}


def usage(analysis, q=Q):
    """Use class of a row for an analysis; combined codes take their most restrictive part."""
    order = {"accept": 0, "caution": 1, "exclude": 2}
    levels = {c: order[u] for c, u in zip(MATRIX_CODES, EXCLUSION_MATRIX[analysis])}
    worst = F.array_max(F.transform(L.qualifier_parts(q), lambda p: F.coalesce(L.lookup(p, levels), F.lit(1))))
    return L.lookup(F.coalesce(worst, F.lit(0)), {v: k for k, v in order.items()})
