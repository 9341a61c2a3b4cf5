"""Measurement rows derived from the TPC-H-like tables; one text serves Spark and the SQL oracle."""

import os

from pyspark.sql import functions as F

_V = "CAST(l_partkey % 91 AS INT)"
_H = "((l_orderkey*31 + l_partkey*17 + l_suppkey*7 + l_linenumber*3) % 1000)"
_D0 = (
    "(CASE WHEN l_suppkey % 10 = 3 THEN date_trunc('quarter', l_shipdate)"
    " WHEN l_suppkey % 10 = 4 THEN date_trunc('year', l_shipdate) ELSE date_trunc('month', l_shipdate) END)"
)
# code of each pseudo-random number 0..48; the last one is the empty text, higher numbers have none
_CODES = (
    ["OBS"] * 12 + ["FSE"] * 11 + ["HT"] * 6 + ["SUS"] * 4 + ["DR"] * 2 + ["SPNF"] * 2
    + ["RER|SUS", "HT|RER", "DR|SUS", "EST", "RER", "FSE|HT", "DR|SPNF", "HT|SUS", "HT|RER|SUS", "DR|HT", "DR|FSE", ""]
)
_QUALIFIER = f"(CASE WHEN {_H} <= 48 THEN split_part('{','.join(_CODES)}', ',', CAST({_H} + 1 AS INT)) END)"
_NAMES = "PH (LAB),OXYGEN DISSOLVED (FIELD METER),TEMPERATURE WATER,TEMPERATURE AIR,PHOSPHORUS TOTAL (P),TURBIDITY,pH,Dissolved Oxygen,Temperature"
_TEXT_VALUE = (
    "(CASE WHEN {h}%97=0 THEN concat('<', CAST(l_quantity AS STRING)) WHEN {v} IN (2,3,8) THEN CAST(l_quantity-10.0 AS STRING)"
    " WHEN {v}<10 THEN CAST(l_quantity AS STRING) ELSE CAST(l_extendedprice AS STRING) END)"
).format(h=_H, v=_V)

# column -> (expression, dimension tables it needs)
COLUMNS = {
    # arrival order: order and line number, then digits that separate repeated pairs
    "row_key": (
        "((l_orderkey*8 + l_linenumber) * 1048576 + (l_partkey*7919 + l_suppkey*104729 + CAST(round(l_extendedprice*100) AS BIGINT)*31) % 1048576)",
        "",
    ),
    # order-preserving block of row_key
    "arrival_block": ("CAST(floor(l_orderkey / 4096) AS BIGINT)", ""),
    "ProjectNumber": ("concat('ABS', lpad(CAST(s_nationkey AS STRING),3,'0'))", "s"),
    "ContinentalRiverBasinCode": ("r_name", "snr"),
    "RiverBasinCode": ("n_name", "sn"),
    "RiverSubBasinCode": ("concat(n_name, '-', CAST(s_suppkey % 6 AS STRING))", "sn"),
    "StationTypeCode": ("CAST(1 AS INT)", ""),
    "StationNumber": ("concat('AB', lpad(CAST(l_suppkey AS STRING),8,'0'))", ""),
    "Station": ("s_name", "s"),
    "LatitudeDecimalDegrees": ("CAST(4900 + l_suppkey % 1000 AS DOUBLE) / CAST(100 AS DOUBLE)", ""),
    "LongitudeDecimalDegrees": ("CAST(-12000 + l_suppkey % 997 AS DOUBLE) / CAST(100 AS DOUBLE)", ""),
    "CollectionCode": ("CAST(1 AS DOUBLE)", ""),
    "SampleMatrixCode": ("CAST(2 AS INT)", ""),
    "SampleTypeCode": ("CAST(3 AS INT)", ""),
    "QCSampleFlag": ("'N'", ""),
    "SampleNumber": (f"concat('S', lpad(CAST(l_suppkey AS STRING),8,'0'), '-', CAST(CAST({_D0} AS DATE) AS STRING))", ""),
    "SampleDateTime": (
        f"(CAST({_D0} AS TIMESTAMP_NTZ) + INTERVAL '1' HOUR * CAST(l_suppkey % 24 AS INT)"
        " + INTERVAL '1' DAY * CAST(l_suppkey % 28 AS INT))",
        "",
    ),
    "VmvCode": (_V, ""),
    "VariableCode": (f"CAST({_V} % 82 + 364 AS INT)", ""),
    "MethodCode": (f"CAST({_V} % 59 + 4 AS INT)", ""),
    "VariableName": (
        f"(CASE WHEN {_V} < 9 THEN split_part('{_NAMES}', ',', {_V} + 1) ELSE concat('VARIABLE ', lpad(CAST({_V} % 82 AS STRING),2,'0')) END)",
        "",
    ),
    "MeasurementFlag": (f"(CASE WHEN {_H}%25=0 THEN 'G' WHEN {_H}%7=0 THEN 'L' END)", ""),
    "MeasurementValue": (_TEXT_VALUE, ""),
    "MeasurementValueNum": (
        f"(CASE WHEN {_H}%97=0 THEN NULL WHEN {_V} IN (2,3,8) THEN l_quantity-10.0 WHEN {_V}<10 THEN l_quantity ELSE l_extendedprice END)",
        "",
    ),
    "UnitCode": (
        f"(CASE WHEN {_V}%11=10 THEN NULL WHEN {_V} IN (0,6) THEN 'pH units' WHEN {_V} IN (2,3,8) THEN 'deg C'"
        f" WHEN {_V}=9 AND {_H}%50=0 THEN 'ug/L' ELSE 'mg/L' END)",
        "",
    ),
    "SampleDetectLimit": (f"(CASE WHEN {_V}%5<2 THEN NULL ELSE CAST(({_V}%29+1)/100.0 AS DOUBLE) END)", ""),
    "MeasurementQualifier": (_QUALIFIER, ""),
    "MeasurementQualifierDescription": (f"(CASE WHEN {_H}<48 THEN concat('Qualifier ', {_QUALIFIER}) END)", ""),
    "MethodDetectionLimit": (f"(CASE WHEN {_V}%3=2 THEN NULL ELSE CAST(({_V}%20+1)/1000.0 AS DOUBLE) END)", ""),
    "SampleComment": (
        f"(CASE WHEN {_H}%31=0 THEN 'Ice cover at station' WHEN {_H}%37=0 THEN 'Sample held overnight; possible contamination' END)",
        "",
    ),
    "MeasurementComment": (
        f"(CASE WHEN {_H} BETWEEN 29 AND 32 THEN 'Suspect value - contamination possible'"
        f" WHEN {_H} BETWEEN 23 AND 28 THEN 'Hold time exceeded by lab' WHEN {_H}%211=0 THEN 'Field duplicate' END)",
        "",
    ),
    "LabCode": ("CAST(10 + s_nationkey % 7 AS INT)", "s"),
}

_JOINS = {
    "s": ("supplier", "l_suppkey = s_suppkey"),
    "n": ("nation", "s_nationkey = n_nationkey"),
    "r": ("region", "n_regionkey = r_regionkey"),
}


def table(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def observations(spark, sf_dir, *columns):
    """The measurement view; a dimension is joined only when a requested column needs it."""
    columns = columns or tuple(COLUMNS)
    rows = table(spark, sf_dir, "lineitem")
    for key in "snr":
        if any(key in COLUMNS[c][1] for c in columns):
            name, condition = _JOINS[key]
            rows = rows.join(table(spark, sf_dir, name), F.expr(condition))
    return rows.selectExpr(*[f"{COLUMNS[c][0]} AS {c}" for c in columns])


def observations_sql():
    """The same view as text for the oracle; its views carry the table names."""
    cells = ",\n  ".join(f"{e} AS {c}" for c, (e, _) in COLUMNS.items()).replace("TIMESTAMP_NTZ", "TIMESTAMP")
    return (
        f"SELECT {cells}\n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
        " JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    )
