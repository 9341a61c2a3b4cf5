"""Column names, types and the fixed reference tables of the measurement model."""

from pyspark.sql import types as T

# Column order of the measurement CSV, with the Spark type each column is read as.
CSV_COLUMNS = [
    ("ProjectNumber", T.StringType()),
    ("SampleNumber", T.StringType()),
    ("ContinentalRiverBasinCode", T.StringType()),
    ("RiverBasinCode", T.StringType()),
    ("RiverSubBasinCode", T.StringType()),
    ("StationTypeCode", T.IntegerType()),
    ("StationNumber", T.StringType()),
    ("Station", T.StringType()),
    ("LatitudeDecimalDegrees", T.DoubleType()),
    ("LongitudeDecimalDegrees", T.DoubleType()),
    ("CollectionCode", T.DoubleType()),
    ("SampleMatrixCode", T.IntegerType()),
    ("SampleTypeCode", T.IntegerType()),
    ("QCSampleFlag", T.StringType()),
    ("SampleDateTime", T.StringType()),
    ("SampleComment", T.StringType()),
    ("VmvCode", T.IntegerType()),
    ("VariableCode", T.IntegerType()),
    ("VariableName", T.StringType()),
    ("MethodCode", T.IntegerType()),
    ("MeasurementFlag", T.StringType()),
    ("MeasurementValue", T.StringType()),
    ("UnitCode", T.StringType()),
    ("SampleDetectLimit", T.DoubleType()),
    ("MeasurementQualifier", T.StringType()),
    ("MeasurementQualifierDescription", T.StringType()),
    ("MethodDetectionLimit", T.DoubleType()),
    ("MeasurementComment", T.StringType()),
    ("LabCode", T.IntegerType()),
    ("MeasurementQualifierComment", T.StringType()),
]

OBSERVATIONS = T.StructType([T.StructField(n, t, True) for n, t in CSV_COLUMNS])

# Texts that a delimited source uses for "no value".
NULL_TEXTS = ["", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# ---- fixed values: qualifier groups -------------------------------------------------
SUSPECT_CODES = ["SUS", "RER|SUS", "HT|RER|SUS", "HT|SUS"]
ACCEPTABLE_CODES = ["HT", "DR", "SPNF", "OBS", "FSE", "RER", "EST"]
UNRELIABLE_CODES = ["SUS", "RER|SUS", "HT|RER|SUS", "HT|SUS", "DR|SUS"]
POTENTIALLY_UNRELIABLE_CODES = ["HT", "HT|RER", "FSE|HT", "DR|HT", "DR", "DR|FSE", "DR|SPNF", "SPNF"]
TIER_CODES = UNRELIABLE_CODES + POTENTIALLY_UNRELIABLE_CODES
REVIEW_CODES = ["HT", "DR", "EST", "SPNF"]

# ---- fixed values: parameter bounds (name fragment, min, max) ------------------------
VALIDITY_BOUNDS = [
    ("pH", 0.0, 14.0),
    ("Temperature", -5.0, 40.0),
    ("Conductivity", 0.0, 100000.0),
    ("Turbidity", 0.0, 5000.0),
    ("Dissolved Oxygen", 0.0, 20.0),
    ("Total Suspended Solids", 0.0, 50000.0),
    ("Nitrogen", 0.0, 1000.0),
    ("Phosphorus", 0.0, 100.0),
]
# Audit bounds: (name, exact match?, min, max)
AUDIT_BOUNDS = [
    ("pH", True, 0.0, 14.0),
    ("Temperature", False, -5.0, 50.0),
    ("Dissolved Oxygen", False, 0.0, 15.0),
]
CORE_VARIABLES = ["pH", "Dissolved Oxygen", "Temperature"]
# Ingest-time plausibility: (exact variable name, min, max)
INGEST_BOUNDS = [
    ("pH", 6.5, 8.5),
    ("Dissolved Oxygen", 0.0, 15.0),
    ("Temperature", -0.5, 30.0),
    ("TURBIDITY", 0.0, 100.0),
]
# Unit conversions: (from, to, factor, offset)
UNIT_CONVERSIONS = [
    ("ug/L", "mg/L", 0.001, 0.0),
    ("mg/L", "ug/L", 1000.0, 0.0),
    ("deg F", "deg C", 5.0 / 9.0, -160.0 / 9.0),
]
# Largest difference in days that is no sampling gap, and the statistical thresholds.
GAP_DAYS = 60
Z_LIMIT = 3.0
IQR_FACTOR = 1.5
CONTAMINATION = 0.05
ALPHA = 0.05
# Share classes: (label, lower bound in percent), highest first.
COMPLETENESS_CLASSES = [("excellent", 95.0), ("good", 85.0), ("poor", 0.0)]
MISSING_CLASSES = [("critical", 50.0), ("high", 30.0), ("moderate", 15.0), ("low", 5.0)]
FREQUENCY_CLASSES = [("good", 12.0), ("moderate", 4.0), ("poor", 1.0)]
BELOW_LIMIT_CLASSES = [("critical", 90.0), ("high", 70.0), ("moderate", 50.0)]
# Audit rules: (code in the row report, rule name, severity, action level)
AUDIT_RULES = [
    ("S1", "S1:VmvCodeUnitInconsistency"),
    ("S2", "S2:StationLocationVariation"),
    ("S3", "S3:MissingProjectNumber"),
    ("M1", "M1:SuspectFlagNoQualifier"),
    ("M2", "M2:OutOfRangeValues"),
    ("M3", "M3:SparseCoreCoverage"),
    ("T1", "T1:SamplingFrequencyGaps"),
    ("T2", "T2:TimeTravel"),
    ("T3", "T3:SeasonalAnomalies"),
    ("C1", "C1:LowCompleteness"),
    ("C2", "C2:InsufficientRepresentativeness"),
]
AUDIT_TAGS = {
    "S1": "S1:MultipleUnits",
    "S2": "S2:LocationVariation",
    "S3": "S3:MissingProject",
    "M1": "M1:SuspectNoQualifier",
    "M2": "M2:OutOfRange",
    "M3": "M3:SparseCore",
    "T1": "T1:FrequencyGap",
    "T2": "T2:TimeTravel",
    "T3": "T3:SeasonalAnomaly",
    "C1": "C1:LowCompleteness",
    "C2": "C2:InsufficientRepresentativeness",
}


# What the reader adds to the columns of a file; whole-row operators leave it out.
DERIVED_COLUMNS = ("row_key", "arrival_block", "MeasurementValueNum")


def source_columns(df):
    """The columns of the data itself. A frame without row_key was chosen column by column and is taken whole."""
    return [c for c in df.columns if c not in DERIVED_COLUMNS] if "row_key" in df.columns else list(df.columns)
