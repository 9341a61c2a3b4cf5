import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hydroq.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "4", app="tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


SCHEMA = (
    "row_key bigint, arrival_block bigint, ProjectNumber string, StationNumber string, Station string, LatitudeDecimalDegrees double, "
    "LongitudeDecimalDegrees double, SampleNumber string, SampleDateTime timestamp_ntz, VmvCode int, VariableCode int, VariableName string, "
    "MethodCode int, MeasurementFlag string, MeasurementValue string, MeasurementValueNum double, UnitCode string, MethodDetectionLimit double, "
    "MeasurementQualifier string, LabCode int"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="session")
def make(spark):
    """Build measurement rows from dicts; missing columns are null, row_key follows list order."""
    import datetime

    def build(rows):
        data = []
        for i, given in enumerate(rows):
            row = {"row_key": i, "arrival_block": i // 3, "StationNumber": "S1", "Station": "One", "VmvCode": 1, "VariableName": "pH", **given}
            if isinstance(row.get("SampleDateTime"), str):
                row["SampleDateTime"] = datetime.datetime.fromisoformat(row["SampleDateTime"])
            if "MeasurementValueNum" in row and "MeasurementValue" not in row and row["MeasurementValueNum"] is not None:
                row["MeasurementValue"] = str(row["MeasurementValueNum"])
            data.append(tuple(row.get(n) for n in NAMES))
        return spark.createDataFrame(data, SCHEMA)

    return build
