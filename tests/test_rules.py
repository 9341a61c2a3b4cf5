"""Hand-made rows: null keys, ties, gaps, reversed arrival, empty and one-row frames."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hydroq.functions import labels as L
from hydroq.functions.values import to_number
from hydroq.operators import audit, dimensions, filters, integrity, profile, quality, series, temporal, trend


def test_null_qualifiers_survive_the_tier_filter(make):
    rows = make([{"MeasurementQualifier": q} for q in (None, "", "SUS", "HT", "DR|SUS", "OBS")])
    assert filters.by_quality(rows, "definite").count() == 4
    assert filters.by_quality(rows, "broader").count() == 3
    assert filters.by_quality(rows, "anything").count() == 6
    assert filters.dataset_version(rows, "a").count() == 5
    assert filters.strict_baseline(rows).count() == 3
    with pytest.raises(ValueError):
        filters.dataset_version(rows, "D")


def test_number_parsing(spark):
    rows = spark.createDataFrame([(t,) for t in ("1.5", "<2", "", "NaN", None, " 3 ", "1e3")], "t string")
    assert [r[0] for r in rows.select(to_number("t")).collect()] == [1.5, None, None, None, None, 3.0, 1000.0]


def test_period_labels_and_december_stays_in_its_year(make):
    rows = make([{"SampleDateTime": t} for t in ("2019-12-31 10:00:00", "2020-01-01 00:00:00", "2020-11-30 23:59:00")])
    def label(p):
        return [r[0] for r in rows.select(L.period_label("SampleDateTime", p)).collect()]

    assert label("W") == ["2019-12-30/2020-01-05"] * 2 + ["2020-11-30/2020-12-06"]
    assert label("Q") == ["2019Q4", "2020Q1", "2020Q4"]
    assert label("seasonal") == ["2019 Winter", "2020 Winter", "2020 Fall"]
    assert label("unknown") == ["2019-12", "2020-01", "2020-11"]


def test_gap_boundary_counts_elapsed_days(make):
    rows = make([{"SampleDateTime": t} for t in ("2020-01-01 22:00:00", "2020-03-02 00:00:00", "2020-05-02 00:00:00", "2020-05-02 00:00:00")])
    days = [r["gap_days"] for r in temporal.gaps(rows).orderBy("SampleDateTime").collect()]
    assert days == [None, 60, 61]
    late = audit.rows_after_gap(rows).collect()
    assert [(r["row_key"], r["gap_days"]) for r in late] == [(2, 61)]


def test_coverage_drops_first_gap_only_in_compat(make):
    rows = make([{"SampleDateTime": t, "SampleNumber": t} for t in ("2020-01-01 00:00:00", "2020-06-01 00:00:00", "2020-06-08 00:00:00")])
    whole = temporal.coverage_by_station(rows).collect()[0]
    compat = temporal.coverage_by_station(rows, compat=True).collect()[0]
    assert whole["MaxGapDays"] == 152 and whole["GapsOver60Days"] == 1
    assert compat["MaxGapDays"] == 7 and compat["EstimatedFrequency"] == "Weekly or more"
    one = temporal.coverage_by_station(make([{"SampleDateTime": "2020-01-01 00:00:00"}] * 2)).collect()[0]
    assert one["AvgGapDays"] is None and one["GapsOver60Days"] is None and one["EstimatedFrequency"] == "Annual or less"


def test_reversed_arrival(make):
    rows = make([{"SampleDateTime": f"2020-01-0{d} 00:00:00", "ProjectNumber": "P"} for d in (3, 1, 2, 5, 4)])
    assert temporal.time_travel(rows).collect()[0]["reversals"] == 2


def test_sample_clusters(make):
    rows = make([{"SampleDateTime": t} for t in ("2020-01-01 00:00:00", "2020-01-01 20:00:00", "2020-01-02 10:00:00", "2020-01-04 00:00:00")])
    got = [(r["cluster"], r["visits"], r["sample_id"]) for r in temporal.sample_clusters(rows).orderBy("cluster").collect()]
    assert got == [(0, 3, "S1_0_20200101"), (1, 1, "S1_1_20200104")]
    assert temporal.sample_clusters(rows, compat=True).count() == 3


def test_location_change_is_found(make):
    rows = make([{"LatitudeDecimalDegrees": a, "LongitudeDecimalDegrees": 1.0, "StationNumber": s} for s, a in (("A", 1.0), ("A", 2.0), ("A", 2.0), ("B", 5.0))])
    got = {(r["StationNumber"], r["LatitudeDecimalDegrees"]): r["RecordCount"] for r in integrity.location_violations(rows).collect()}
    assert got == {("A", 1.0): 1, ("A", 2.0): 2}
    assert integrity.check_fd(rows, "StationNumber", ["LatitudeDecimalDegrees"]).collect()[0]["violations"] == 1
    assert [r[0] for r in audit.moved_keys(rows).collect()] == ["A"]


def test_registry_counts_null_as_a_value(make):
    rows = make([{"VmvCode": 1, "UnitCode": u} for u in ("mg/L", None)] + [{"VmvCode": 2, "UnitCode": "mg/L"}])
    got = {r["VmvCode"]: (r["UniquUnits"], r["UnitCount"], r["MDLCount"]) for r in integrity.vmv_registry(rows).collect()}
    assert got == {1: ("mg/L; nan", 2, 1), 2: ("mg/L", 1, 1)}


def test_quantile_classes_drop_repeated_edges(make):
    values = [1.0] * 8 + [2.0, 3.0, 4.0, 5.0]
    points = make([{"StationNumber": f"s{i}", "MeasurementValueNum": v} for i, v in enumerate(values)])
    got = sorted((r["MeasurementValueNum"], r["quantile_class"]) for r in series.quantile_classes(points).collect())
    assert series.quantile_edges(points).collect()[0]["edges"] == pytest.approx([1.0, 2.8, 5.0])
    assert got == [(1.0, 0)] * 8 + [(2.0, 0), (3.0, 1), (4.0, 1), (5.0, 1)]
    single = series.quantile_classes(make([{"MeasurementValueNum": 4.0, "StationNumber": s} for s in "ab"]))
    assert {r["quantile_class"] for r in single.collect()} == {0}


def test_unit_mode_ties_take_the_smaller_text(make):
    rows = make([{"UnitCode": u} for u in ("b", "a", "b", "a", None, None, None)])
    assert dimensions.active_unit(rows).collect()[0][0] == "a"


def test_empty_frame(make):
    none = make([]).where("false")
    m = quality.metrics(none).collect()[0]
    assert (m["total"], m["pct_clean"]) == (0, 0.0)
    s = series.statistical_summary(none, F.lit(True)).collect()[0]
    assert s["count"] == 0 and s["mean"] is None and s["pct_removed"] == 0.0
    t = series.threshold_control(none).collect()[0]
    assert (t["threshold_min"], t["threshold_max"], t["threshold_p50"], t["threshold_step"]) == (0.0, 1.0, 0.5, 0.001)
    assert quality.flag_matrix(none).count() == 0 and series.station_values(none).count() == 0
    assert series.period_percentiles(none).count() == 0


def test_one_row(make):
    rows = make([{"MeasurementValueNum": 4.0, "SampleDateTime": "2020-05-01 00:00:00", "LatitudeDecimalDegrees": 1.0, "LongitudeDecimalDegrees": 2.0}])
    s = series.statistical_summary(rows, F.lit(True)).collect()[0]
    assert s["std"] == 0.0 and s["median"] == 4.0
    t = series.threshold_control(rows).collect()[0]
    assert (t["threshold_min"], t["threshold_max"]) == (4.0, 5.0)


def test_null_keys_leave_groupings(make):
    rows = make([{"StationNumber": s, "MeasurementQualifier": q} for s, q in ((None, "SUS"), ("A", None), ("A", "SUS"))])
    assert quality.by_station(rows).count() == 1
    assert quality.crosstab(rows, "StationNumber", "MeasurementQualifier").count() == 1
    assert quality.qualifier_distribution(rows).count() == 2


def test_audit_of_hand_made_rows(make):
    base = {"ProjectNumber": "P", "UnitCode": "u", "LatitudeDecimalDegrees": 1.0, "LongitudeDecimalDegrees": 1.0}
    rows = make([
        {**base, "SampleDateTime": "2020-01-01 00:00:00", "SampleNumber": "a", "MeasurementValueNum": 15.0},
        {**base, "SampleDateTime": "2020-07-01 00:00:00", "SampleNumber": "b", "VariableName": "Water Temperature", "VmvCode": 2, "MeasurementValueNum": 3.0, "ProjectNumber": ""},
        {**base, "SampleDateTime": "2020-06-30 00:00:00", "SampleNumber": "b", "VmvCode": 3, "UnitCode": None, "MeasurementFlag": "S", "MeasurementValueNum": 7.0},
    ])
    got = {r["row_key"]: r["issues"] for r in audit.with_issues(rows).collect()}
    assert got == {0: ["M2", "C2"], 1: ["S3", "T3", "C2"], 2: ["M1", "T1", "C2"]}
    report = audit.row_report(audit.with_issues(rows)).where("row_key = 0").collect()[0]
    assert report["audit_issues"] == "M2:OutOfRange;C2:InsufficientRepresentativeness;" and report["IssueCount"] == 2
    counts = {r["Rule"][:2]: r["RecordCount"] for r in audit.by_rule(audit.with_issues(rows)).collect()}
    assert counts["C2"] == 3 and counts["S1"] == 0 and len(counts) == 11


def test_validity_and_duplicates(make):
    rows = make([{"VariableName": "PHOSPHORUS", "MeasurementValueNum": 20.0, "SampleDateTime": "2020-01-01 00:00:00", "row_key": 1, "arrival_block": 0}] * 2)
    assert {r["parameter"] for r in profile.validity_issues(rows).collect()} == {"pH"}
    assert profile.validity_issues(rows, match="word").count() == 0
    d = profile.duplicate_summary(rows).collect()[0]
    assert (d["exact_duplicates"], d["key_column_duplicates"]) == (2, 2)


def test_trend_direction(make):
    rows = make([{"SampleDateTime": f"2020-{m:02d}-10 00:00:00", "MeasurementValueNum": float(m)} for m in range(1, 13)])
    t = trend.with_significance(trend.linear_trend(rows)).collect()[0]
    assert t["slope"] == pytest.approx(1.0) and t["direction"] == "increasing" and t["significant"]
    assert trend.linear_trend(rows.limit(9)).count() == 0


def test_period_labels_are_made_once_a_group(make):
    rows = make([{"SampleDateTime": d, "SampleNumber": "a", "MeasurementValueNum": 1.0} for d in ("2020-12-31 05:00:00", "2020-01-01 00:00:00", "2019-12-30 09:00:00", None)])
    for period in ("daily", "weekly", "monthly", "quarterly", "seasonal", "annual", "event"):
        got = trend.summarize(rows, ["StationNumber"], period)
        assert got.columns[:3] == ["StationNumber", "period_start", "period_label"]
        want = rows.select(L.period_start("SampleDateTime", period).alias("s"), L.period_label("SampleDateTime", period).alias("l")).distinct()
        assert sorted(map(str, ((r.period_start, r.period_label) for r in got.collect()))) == sorted(map(str, ((r.s, r.l) for r in want.collect())))
        plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert period == "event" or not any("Aggregate [" in line and "period_label" in line for line in plan)


def test_audited_rows_do_not_carry_what_the_rules_read(make):
    """The rules of the row itself are settled before rows are dealt out."""
    rows = make([{"SampleDateTime": "2020-01-01 00:00:00", "MeasurementFlag": "S"}])
    plan = audit.overall(audit.with_issues(rows))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    late = [line for line in plan if "Project [" in line and "previous" in line and "AS _own" not in line]
    assert late and not any("MeasurementQualifier" in line or "VariableName" in line for line in late)


def test_rules_are_counted_without_audited_rows(make, monkeypatch):
    base = {"ProjectNumber": "P", "UnitCode": "u", "LatitudeDecimalDegrees": 1.0, "LongitudeDecimalDegrees": 1.0, "SampleNumber": "a", "MeasurementValueNum": 15.0}
    rows = make([{**base, "SampleDateTime": f"20{10 + k % 7}-0{1 + k % 9}-01 00:00:00", "LatitudeDecimalDegrees": 1.0 + k // 20, "StationNumber": None if k % 11 == 0 else f"S{k % 3}",
                  "SampleNumber": None if k % 13 == 0 else f"n{k % 9}", "VmvCode": k % 4, "UnitCode": None if k % 8 == 0 else "u", "VariableName": f"v{k % 5}", "MeasurementValueNum": None if k % 3 else 1.0} for k in range(40)] + [{**base, "row_key": 1}] * 2)
    want = {r["Rule"]: r["RecordCount"] for r in audit.by_rule(audit.with_issues(rows)).collect()}
    monkeypatch.setattr(audit, "station_findings", lambda df: pytest.fail("findings go back to the rows"))
    got = {r["Rule"]: r["RecordCount"] for r in audit.rule_counts(rows).collect()}
    assert got == want and sum(n > 0 for n in got.values()) >= 6


def test_findings_are_taken_from_rows_as_they_come(make, monkeypatch):
    """Only the stations' visits are put in order for the findings; the rows are dealt out by project once, without the keys of the findings."""
    plans = {}

    def look(kept):
        def run(frames, *name):
            plans.update({n: f._jdf.queryExecution().optimizedPlan().toString() for n, f in ({name[0]: frames} if name else frames).items()})
            return kept(frames, *name)
        return run

    monkeypatch.setattr(audit, "stage", look(audit.stage))
    monkeypatch.setattr(audit, "stage_all", look(audit.stage_all))
    rows = make([{"SampleDateTime": "2020-01-01 00:00:00", "SampleNumber": "a", "MeasurementValueNum": 1.0}])
    last = audit.overall(audit.with_issues(rows))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert {n for n, plan in plans.items() if "Window [" in plan} == {"stations"}
    assert sum("Window [lag" in line and "row_key" in line for line in last) == 1
    dealt = [line for line in last if "Project [" in line and "AS _told" in line]
    assert dealt and not any(key in line for line in dealt for key in ("StationNumber", "SampleNumber", "VmvCode"))


def _brute_issues(rows):
    """The rules that need their group, row by row."""
    def of(key, value):
        return [r for r in rows if value is not None and r[key] == value]

    out = {}
    for r in rows:
        found, t = set(), r["SampleDateTime"]
        station, sample = of("StationNumber", r["StationNumber"]), of("SampleNumber", r["SampleNumber"])
        if len({x["UnitCode"] for x in of("VmvCode", r["VmvCode"])}) > 1:
            found.add("S1")
        if len({x["LatitudeDecimalDegrees"] for x in station}) > 1:
            found.add("S2")
        if station and not any(x["VariableName"] in ("pH", "Dissolved Oxygen", "Temperature") for x in station):
            found.add("M3")
        earlier = [x["SampleDateTime"] for x in station if x["SampleDateTime"] < t]
        if earlier and (t - max(earlier)).days > 60 and r["row_key"] == min(x["row_key"] for x in station if x["SampleDateTime"] == t):
            found.add("T1")
        before = [x for x in of("ProjectNumber", r["ProjectNumber"]) if x["row_key"] < r["row_key"]]
        if before and t < max(before, key=lambda x: x["row_key"])["SampleDateTime"]:
            found.add("T2")
        numbers = sum(x["MeasurementValueNum"] is not None for x in sample)
        if sample and 100.0 * numbers / (len({x["VariableName"] for x in sample} - {None}) + 1) < 50:
            found.add("C1")
        if station and len({x["SampleNumber"] for x in station if x["SampleDateTime"].year == t.year} - {None}) < 3:
            found.add("C2")
        out[r["row_key"]] = found
    return out


def test_group_rules_against_brute_force(make):
    rng = random.Random(5)
    given = [{
        "row_key": 10 * k, "arrival_block": k // 4, "SampleDateTime": datetime.datetime(2019 + rng.randrange(3), rng.choice([1, 2, 6, 11]), 1 + rng.randrange(3)),
        "ProjectNumber": rng.choice(["P", "Q"]), "StationNumber": rng.choice([None, "A", "B", "C", "D"]), "SampleNumber": rng.choice([None, *map(str, range(22))]),
        "VmvCode": rng.randrange(6), "UnitCode": "u", "MeasurementValueNum": rng.choice([None, 7.0]),
    } for k in range(90)]
    for r in given:
        r["VariableName"] = {"A": "x", None: "x"}.get(r["StationNumber"], rng.choice([None, "pH", "x", "y"]))
        r["LatitudeDecimalDegrees"] = float(r["StationNumber"] == "B" and rng.randrange(2))
        r["UnitCode"] = rng.choice(["u", None]) if r["VmvCode"] == 2 else "u"
        r["SampleNumber"] = "0" if r["StationNumber"] == "D" else r["SampleNumber"]
    got = {r["row_key"]: set(r["issues"]) for r in audit.with_issues(make(given)).collect()}
    want = _brute_issues(given)
    assert got == want and {rule for found in want.values() for rule in found} == {"S1", "S2", "M3", "T1", "T2", "C1", "C2"}


def test_incomplete_samples_from_counts(make):
    """A sample that the counts alone would pass or fail gets the same verdict as from its variables."""
    rows = make([{"SampleNumber": s, "VariableName": v, "MeasurementValueNum": n, "StationNumber": z} for s, v, n, z in [
        *[("twice", "x", None, "S1")] * 2, ("twice", "x", 1.0, None),  # three rows of one variable: 100 * 1 / 2
        ("low", "x", None, "S1"), ("low", "y", None, "S2"), ("low", "z", 1.0, None),  # 100 * 1 / 4
        ("full", "x", 1.0, "S1"), ("none", None, None, "S1"), (None, "x", None, "S1"),
    ]])
    rows_of = [F.count(F.lit(1)).alias("rows")]
    got = audit.incomplete_samples(rows, carry=rows_of, counts=audit._visits(rows)).collect()
    assert sorted(got) == sorted(audit.incomplete_samples(rows, carry=rows_of).collect()) == [("low", 3), ("none", 1)]
