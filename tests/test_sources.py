"""Loading, validation, sinks and the composed reports."""

import os

import pytest
from pyspark.sql import functions as F

from hydroq import reports
from hydroq import schema as S
from hydroq.operators import filters
from hydroq.plans.catalog import obs
from hydroq.sources import loader, sinks, staging

HEAD = [n for n, _ in S.CSV_COLUMNS]


def _write(path, lines, columns=HEAD):
    with open(path, "w") as f:
        f.write(",".join(columns) + "\n")
        for line in lines:
            f.write(",".join(str(line.get(c, "")) for c in columns) + "\n")


def test_csv_scan_types_nulls_and_order(spark, tmp_path):
    path = str(tmp_path / "data.csv")
    _write(path, [
        {"StationNumber": "A", "SampleDateTime": "1/12/2023 14:35", "VmvCode": 3, "MeasurementValue": "<0.5", "UnitCode": "NA"},
        {"StationNumber": "nan", "SampleDateTime": "soon", "VmvCode": "x", "MeasurementValue": "7.25", "UnitCode": "mg/L"},
    ], list(reversed(HEAD)))
    rows = loader.read_csv(spark, path).orderBy("row_key").collect()
    assert str(rows[0]["SampleDateTime"]) == "2023-01-12 14:35:00" and rows[0]["MeasurementValueNum"] is None and rows[0]["UnitCode"] is None
    assert rows[1]["SampleDateTime"] is None and rows[1]["StationNumber"] is None and rows[1]["VmvCode"] is None and rows[1]["MeasurementValueNum"] == 7.25
    with pytest.raises(Exception):
        loader.read_csv(spark, path, strict_dates=True).collect()


def test_parts_have_one_arrival_order(spark, tmp_path):
    paths = [str(tmp_path / f"p{i}.csv") for i in range(3)]
    for i, p in enumerate(paths):
        _write(p, [{"StationNumber": f"s{i}{j}"} for j in range(4)])
    rows = loader.read_parts(spark, paths)
    assert rows.select("row_key").distinct().count() == 12


def test_arrival_follows_the_files_whatever_their_size(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for name, size in (("a", 2), ("b", 500), ("c", 1), ("d", 90)):
        _write(str(folder / f"{name}.csv"), [{"StationNumber": f"{name}{j}"} for j in range(size)])
        want += [f"{name}{j}" for j in range(size)]
    rows = loader.read_csv(spark, str(folder))
    assert [r[0] for r in rows.orderBy("row_key").select("StationNumber").collect()] == want
    assert [r[0] for r in rows.orderBy("row_key").select("row_key").collect()] == list(range(len(want)))
    parts = loader.read_parts(spark, [str(folder / f"{n}.csv") for n in "dba"])
    assert [r[0][0] for r in parts.orderBy("row_key").select("StationNumber").collect()] == ["d"] * 90 + ["b"] * 500 + ["a"] * 2


def test_equal_rows_of_a_file_are_duplicates(spark, tmp_path):
    path = str(tmp_path / "twice.csv")
    _write(path, [{"StationNumber": f"s{j % 50}", "VmvCode": 1, "VariableName": "pH", "MeasurementValue": j % 50, "SampleDateTime": "1/12/2023 14:35"} for j in range(52)])
    rows = loader.read_csv(spark, path)
    size = len(S.CSV_COLUMNS)
    found = reports.exploration(rows)
    assert found["duplicates"].first()["exact_duplicates"] == 4
    whole = found["dataset_profile"].first()
    assert (whole["rows"], whole["columns"], whole["total_cells"], whole["duplicate_rows"]) == (52, size, 52 * size, 4)
    assert found["missing_overall"].count() == size and found["column_analysis"].count() == size
    assert found["synthesis"].first()["total_columns"] == size
    kept = loader.validate(rows, ["StationNumber"])
    assert kept.columns == [*rows.columns, "location_ok"]
    assert sorted(r[0] for r in kept.select("row_key").collect()) == list(range(50))
    metrics = loader.ingest_metrics(rows, ["StationNumber"]).first()
    assert (metrics["rows_before"], metrics["rows_after"]) == (52, 50)


def test_missing_columns_and_paths(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    _write(path, [{"StationNumber": "A"}], ["StationNumber"])
    with pytest.raises(ValueError, match="VmvCode"):
        loader.read_csv(spark, path)
    assert loader.first_existing(spark, ["/no/where.csv", path]) == path
    with pytest.raises(FileNotFoundError, match="/no/where.csv"):
        loader.first_existing(spark, ["/no/where.csv"])
    with pytest.raises(ValueError, match="missing required"):
        loader.validate(spark.range(1), ["StationNumber"])


def test_names_and_roles(spark):
    rows = spark.createDataFrame([(1, "a")], "SITEID int, unitcode string")
    assert loader.standardize_column_names(rows, {"station": ["siteid"]}).columns == ["station", "unitcode"]
    assert loader.resolve_column(rows, "unit") == "unitcode" and loader.resolve_column(rows, "lab") is None
    assert loader.numeric_columns(rows) == ["SITEID"] and loader.text_columns(rows) == ["unitcode"]


def test_staged_table_keeps_schema_and_rows(spark):
    rows = spark.range(5).select("id", F.array(F.lit(1)).alias("a"))
    back = staging.stage(rows, "t")
    assert back.count() == 5 and back.columns == rows.columns
    assert staging.stage(rows.where("false"), "e").count() == 0


def test_staged_tables_can_be_released(spark):
    staging.release(spark)
    before = set(os.listdir(staging.shared_folder(spark)))
    staging.stage(spark.range(5), "gone")
    assert any(x.startswith("gone-") for x in set(os.listdir(staging.shared_folder(spark))) - before)
    staging.release(spark)
    assert not any(x.startswith("gone-") for x in os.listdir(staging.shared_folder(spark)))


def test_composed_reports_run(spark, sf_dir, tmp_path):
    base = loader.remember(obs(spark, sf_dir))
    pages = {
        **reports.variable_page(base, 0, threshold=20.0, start="1995-01-01", end="2001-12-31"),
        **reports.quality_page(base, "1995-01-01", "2001-12-31"),
        **reports.coverage(base),
    }
    sizes = {name: frame.count() for name, frame in pages.items()}
    assert sizes["series"] > 10 and sizes["kpis"] == 1 and sizes["vmv_code_registry"] == 91
    audit = reports.audit_reports(base)
    by_rule = {r["Rule"]: r["RecordCount"] for r in audit["quality_summary_by_rule"].collect()}
    exploded = audit["data_quality_audit"].select(F.explode(F.split(F.regexp_replace("audit_issues", ";$", ""), ";")).alias("t")).groupBy("t").count()
    totals = {r["t"][:2]: r["count"] for r in exploded.collect()}
    assert {k[:2]: v for k, v in by_rule.items() if v} == totals
    explored = reports.exploration(base.select(*[c for c in base.columns if c not in ("SampleComment",)]))
    lines = reports.summary_lines(explored["synthesis"])
    sinks.write_text_report(lines, str(tmp_path / "summary"))
    assert spark.read.text(str(tmp_path / "summary")).count() == 6
    paths = sinks.write_outputs({"kpis": pages["kpis"]}, str(tmp_path), "x_")
    assert os.path.isdir(paths["kpis"])
    base.unpersist()


def test_filters_reach_the_stored_table(spark, sf_dir, tmp_path, capsys):
    path = str(tmp_path / "table")
    sinks.write_table(obs(spark, sf_dir, "row_key", "StationNumber", "VmvCode", "SampleDateTime", "MeasurementValueNum", "UnitCode"), path)
    rows = filters.by_variable(filters.by_date_range(loader.read_table(spark, path), "1996-03-01", "1996-09-30"), 6)
    rows.groupBy("StationNumber").count().explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(Year" in plan and "EqualTo(VmvCode,6)" in plan and "GreaterThanOrEqual(SampleDateTime" in plan
    assert "UnitCode" not in plan and "MeasurementValueNum" not in plan
