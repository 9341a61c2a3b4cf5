"""Refreshed summaries against one full run: untouched months keep their files, a repeated batch counts once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hydroq.operators import refresh, trend


def rows_of(seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(300):
        when = None if k % 50 == 7 else f"{rng.choice([2010, 2011])}-{rng.randrange(1, 4):02}-{rng.randrange(1, 29):02} 0{rng.randrange(10)}:00:00"
        station = "S1" if k % 3 == 0 else None if k % 41 == 0 else f"S{rng.randrange(2, 6)}"  # one station holds a third of all rows
        value = None if rng.random() < 0.1 else 1e6 + rng.gauss(0, 1)
        out.append({"StationNumber": station, "VmvCode": rng.choice([1, 2]), "VariableName": rng.choice(["pH", "Iron", None]), "UnitCode": rng.choice(["mg/L", "ug/L"]), "SampleDateTime": when, "MeasurementValueNum": value})
    return out


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def plain(frame, digits=6):
    return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in frame.collect()), key=repr)


def months(frame):
    return plain(frame.select("StationNumber", "VmvCode", "period_year", "period_month", *[F.col(c).cast("double") for c in ("value_mean", "value_std", "value_min", "value_max", "sample_count")]))


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame([(f"S{k}", f"Station {k}") for k in range(1, 8)], "StationNumber string, Station string")


def expected(df, stations):
    return months(trend.monthly_table(df)), plain(trend.station_overview(stations, df))


def state_of(spark, path, stations):
    state = refresh.stored(spark, path)
    return months(refresh.monthly_from(state)), plain(refresh.overview_from(stations, state))


def test_increments_equal_one_run(spark, make, stations, tmp_path):
    rows = rows_of()
    path = str(tmp_path / "states")
    early = [r for r in rows if r["SampleDateTime"] is None or r["SampleDateTime"] < "2011-02"]
    late = [r for r in rows if not (r["SampleDateTime"] is None or r["SampleDateTime"] < "2011-02")]
    first, second = early + late[::2], late[1::2]
    written = refresh.refresh(path, make(first), 1)
    assert written.count() == 7  # six months and the rows without a time
    assert state_of(spark, path, stations) == expected(make(first), stations)
    before = {f: os.stat(f).st_mtime_ns for f in files(path)}
    touched = refresh.refresh(path, make(second), 2)
    assert plain(touched) == [(2011, 2), (2011, 3)]
    after = files(path)
    untouched = [f for f in before if "period_year=2011/period_month=2" not in f and "period_year=2011/period_month=3" not in f]
    assert untouched and all(f in after and os.stat(f).st_mtime_ns == before[f] for f in untouched)
    assert state_of(spark, path, stations) == expected(make(first + second), stations)


def test_a_repeated_batch_counts_once(spark, make, stations, tmp_path):
    rows = rows_of(4)
    path = str(tmp_path / "states")
    first, second = rows[::2], rows[1::2]
    refresh.refresh(path, make(first), 1)
    # the driver was lost after one month of the second batch had been replaced
    refresh.refresh(path, make([r for r in second if r["SampleDateTime"] and r["SampleDateTime"] < "2010-02"]), 2)
    again = refresh.refresh(path, make(second), 2)
    assert (2010, 1) not in plain(again)
    assert state_of(spark, path, stations) == expected(make(rows), stations)
    kept = files(path)
    assert refresh.refresh(path, make(second), 2).count() == 0 and files(path) == kept


def test_empty_batches(spark, make, stations, tmp_path):
    path = str(tmp_path / "states")
    nothing = make(rows_of()[:1]).limit(0)
    assert refresh.refresh(path, nothing, 1).count() == 0
    assert state_of(spark, path, stations) == ([], plain(trend.station_overview(stations, nothing)))
    refresh.refresh(path, make(rows_of()), 2)
    kept = files(path)
    refresh.refresh(path, nothing, 3)
    assert files(path) == kept


def test_the_first_batch_has_nothing_to_merge_with(spark, make, stations, tmp_path, monkeypatch):
    path = str(tmp_path / "states")
    with monkeypatch.context() as m:
        m.setattr(refresh, "merged", lambda *a: pytest.fail("states of one batch are merged"))
        written = refresh.refresh(path, make(rows_of()), 1)
        assert written.count() == 7
    assert state_of(spark, path, stations) == expected(make(rows_of()), stations)
