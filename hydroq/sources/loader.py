"""Typed reading and validation of measurement files."""

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroq import schema as S
from hydroq.functions.values import col, percent_or_zero, to_number, true_or_false
from hydroq.operators import filters
from hydroq.operators.ordered import top_k

DATE_PATTERN = "M/d/yyyy H:mm"


def first_existing(spark, candidates):
    """The first path that exists on the cluster file system; an error lists all that were tried."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for candidate in candidates:
        path = jvm.org.apache.hadoop.fs.Path(str(candidate))
        if path.getFileSystem(conf).exists(path):
            return str(candidate)
    raise FileNotFoundError("no data file found; tried: " + ", ".join(map(str, candidates)))


def parse_dates(c, strict=False, pattern=DATE_PATTERN):
    """Text to timestamp. Strict raises on text that is no date, otherwise it becomes null."""
    if strict:
        return F.to_timestamp(col(c), pattern).cast("timestamp_ntz")
    return F.try_to_timestamp(col(c), F.lit(pattern)).cast("timestamp_ntz")


def null_texts_to_null(c):
    return F.when(~col(c).isin(S.NULL_TEXTS), col(c))


def _raw_csv(spark, paths, rank=0):
    """The columns of the schema as text, with the place of each row: rank of the read, file, split start and row id."""
    raw = spark.read.option("header", True).csv(paths)
    missing = [n for n, _ in S.CSV_COLUMNS if n not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    place = [F.lit(rank).alias("_rank"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    return raw.select(*[n for n, _ in S.CSV_COLUMNS], *place, F.monotonically_increasing_id().alias("_id"))


def _in_order(raw):
    """``raw`` with ``row_key``: rows are numbered by file path, then by place in the file.

    Spark deals file splits out by size, so row ids alone do not follow the files. Each split's rows are counted, the
    counts are added up in the order of the splits (one row a split), and a row's number is its split's offset plus its place in it.
    """
    splits = raw.groupBy("_rank", "_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_rank", "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return raw.join(splits, ["_rank", "_file", "_start"]).withColumn("row_key", F.col("_before") + F.col("_id") - F.col("_first"))


def _typed(raw, strict_dates):
    """Fixed schema plus ``row_key``, the arrival order within the read, and its blocks of 2^20 rows."""
    cells = []
    for name, kind in S.CSV_COLUMNS:
        text = null_texts_to_null(name)
        cells.append((text if isinstance(kind, T.StringType) else text.try_cast(kind)).alias(name))
    typed = _in_order(raw).select(*cells, "row_key")
    return typed.withColumns({
        "SampleDateTime": parse_dates("SampleDateTime", strict_dates),
        "MeasurementValueNum": to_number("MeasurementValue"),
        "arrival_block": F.shiftright("row_key", 20),
    })


def read_csv(spark, paths, strict_dates=False):
    """Scan measurement CSV files into the fixed schema; columns are taken by header name."""
    return _typed(_raw_csv(spark, paths), strict_dates)


def read_parts(spark, paths, strict_dates=False):
    """Files with differing column order as one frame: a union by name, the splits taking the place of chunks."""
    frames = [_raw_csv(spark, p, rank) for rank, p in enumerate(paths)]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return _typed(whole, strict_dates)


def first_rows(df, n, order="row_key"):
    return df.orderBy(order).limit(n)


def load_version(df, version="C"):
    """Dataset version A (strict), B (same rows plus review columns) or C (all rows)."""
    return filters.dataset_version(df, version)


def remember(df):
    """Keep a base frame for several queries of one session; the caller unpersists it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def data_info(df):
    """Size, date range and distinct counts in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.min("SampleDateTime").alias("date_min"),
        F.max("SampleDateTime").alias("date_max"),
        F.countDistinct("StationNumber").alias("stations"),
        F.countDistinct("VmvCode").alias("parameters"),
        F.countDistinct("MeasurementQualifier").alias("qualifiers"),
    )


def explore_columns(df, columns):
    """Per column: type, rows, non-null rows and distinct values, as (column, metric, value)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"{c}_filled") for c in columns],
        *[F.countDistinct(c).alias(f"{c}_distinct") for c in columns],
    )
    cells = []
    for c in columns:
        facts = {"dtype": F.lit(types[c]), "rows": F.col("_rows"), "filled": F.col(f"{c}_filled"), "distinct": F.col(f"{c}_distinct")}
        cells += [F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in facts.items()]
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def example_rows(df, column, codes, n=3, order="row_key"):
    """The first n rows of each listed code."""
    return top_k(df.where(col(column).isin(list(codes))), [column], [F.asc(order)], n)


def validate(df, required, lat=(51.0, 61.0), lon=(-128.0, -110.0)):
    """Rows with a location flag, exact duplicates removed, the first to arrive kept; missing columns raise."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    inside = F.col("LatitudeDecimalDegrees").between(*lat) & F.col("LongitudeDecimalDegrees").between(*lon)
    flagged = df.withColumn("location_ok", true_or_false(inside))
    derived = [c for c in S.DERIVED_COLUMNS if c in df.columns and c not in S.source_columns(df)]
    if not derived:
        return flagged.distinct()
    # equal rows have equal derived values but for their place, of which the smallest stays
    return flagged.groupBy(*S.source_columns(df), "location_ok").agg(*[F.min(c).alias(c) for c in derived]).select(*df.columns, "location_ok")


def ingest_metrics(df, required, warn_pct=5.0, **bounds):
    """One row: rows before and after duplicate removal, share of duplicates, location failures."""
    flagged = df.withColumn("_rows", F.lit(1))
    keys = S.source_columns(df)
    validate(df, required, **bounds)
    lat, lon = bounds.get("lat", (51.0, 61.0)), bounds.get("lon", (-128.0, -110.0))
    inside = F.col("LatitudeDecimalDegrees").between(*lat) & F.col("LongitudeDecimalDegrees").between(*lon)
    distinct = flagged.groupBy(*keys).agg(F.count("_rows").alias("_n"))
    return distinct.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.count_if(~true_or_false(inside)).alias("location_failures"),
        F.countDistinct("StationNumber").alias("stations"),
    ).withColumn(
        "duplicate_pct", percent_or_zero(F.col("rows_before") - F.col("rows_after"), "rows_before")
    ).withColumn("duplicate_warning", F.col("duplicate_pct") > warn_pct)


def wide_by_variable(df, keys, codes, value="MeasurementValueNum", code="VmvCode", order="row_key"):
    """Long to wide: one column per listed code, the first value in arrival order."""
    first = F.min_by(col(value), F.when(col(value).isNotNull(), col(order)))
    return df.where(col(code).isin(list(codes))).groupBy(*keys).pivot(code, list(codes)).agg(first)


def long_by_variable(wide, keys, code="VmvCode", value="MeasurementValueNum"):
    """Wide back to long; cells without a value disappear."""
    codes = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), codes, code, value).where(col(value).isNotNull())


def standardize_column_names(df, aliases):
    """Rename columns by a {standard: [aliases]} table, matching case-insensitively on the whole name."""
    known = {a.lower(): std for std, names in aliases.items() for a in names}
    renames = {c: known[c.lower()] for c in df.columns if c.lower() in known}
    return df.withColumnsRenamed(renames)


ROLES = {
    "station_id": ["StationNumber", "StationID", "Station_ID", "SiteID"],
    "date_time": ["SampleDateTime", "DateTime", "SampleDate", "Date"],
    "parameter": ["VariableName", "Parameter", "Analyte", "Parameter_Name"],
    "value": ["MeasurementValue", "Value", "Result", "Concentration"],
    "unit": ["UnitCode", "Unit", "Units"],
    "latitude": ["LatitudeDecimalDegrees", "Latitude", "Lat"],
    "longitude": ["LongitudeDecimalDegrees", "Longitude", "Lon"],
    "method": ["MethodCode", "Method", "Analysis_Method"],
    "lab": ["LabCode", "Lab", "Laboratory"],
    "flag": ["MeasurementFlag", "Flag", "QA_Flag", "QC_Flag"],
    "detection_limit": ["MethodDetectionLimit", "SampleDetectLimit", "DetectionLimit", "MDL"],
}


def resolve_column(df, role):
    """The column that plays a role: the first exact (case-insensitive) alias that exists, else None."""
    present = {c.lower(): c for c in df.columns}
    return next((present[a.lower()] for a in ROLES[role] if a.lower() in present), None)


def numeric_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def read_table(spark, path):
    """The stored measurement table; filters and column choices reach its Parquet files."""
    return spark.read.parquet(path)
