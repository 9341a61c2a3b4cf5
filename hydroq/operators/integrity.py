"""Functional dependencies, registries, coverage and unit consistency."""

from functools import reduce

from pyspark.sql import functions as F

from hydroq.functions import labels as L
from hydroq.functions.values import col, contains_text, first_value, percent, percent_or_zero
from hydroq.operators import ordered, quality

TS = "SampleDateTime"


def distinct_per_key(df, keys, columns):
    """Largest number of distinct non-null values any of ``columns`` takes, per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = reduce(lambda d, k: d.where(col(k).isNotNull()), keys, df)
    counts = [F.countDistinct(c) for c in columns]
    return rows.groupBy(*keys).agg((F.greatest(*counts) if len(counts) > 1 else counts[0]).alias("n"))


def check_fd(df, keys, columns, name=None):
    """One row: keys, keys with exactly one value, keys with several, and the spread of the number."""
    label = name or f"{keys if isinstance(keys, str) else '+'.join(keys)} -> {','.join(columns)}"
    return distinct_per_key(df, keys, columns).agg(
        F.lit(label).alias("check"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(col("n") == 1).alias("consistent"),
        F.count_if(col("n") > 1).alias("violations"),
        F.avg("n").alias("avg_n"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
    )


def violating_keys(df, keys, columns):
    return distinct_per_key(df, keys, columns).where("n > 1").drop("n")


def cardinality_report(df):
    """Per station: names, distinct coordinate pairs (nulls kept), projects, samples, rows."""
    return df.where(col("StationNumber").isNotNull()).groupBy("StationNumber").agg(
        F.countDistinct("Station").alias("UniqueNames"),
        F.countDistinct(F.struct("LatitudeDecimalDegrees", "LongitudeDecimalDegrees")).alias("UniqueLocations"),
        F.countDistinct("ProjectNumber").alias("ProjectCount"),
        F.countDistinct("SampleNumber").alias("SampleCount"),
        F.count(F.lit(1)).alias("RecordCount"),
    )


def location_violations(df, key="StationNumber"):
    """Rows per location of keys that have more than one. Locations are counted once, then filtered."""
    place = ["LatitudeDecimalDegrees", "LongitudeDecimalDegrees"]
    per_place = df.where(col(key).isNotNull()).groupBy(key, *place).agg(F.count(F.lit(1)).alias("RecordCount"))
    return per_place.join(violating_keys(per_place, key, place), key, "left_semi")


def vmv_registry(df):
    """First variable and method per code, all units and limits (null counts as a value), row count."""
    rows = df.where(col("VmvCode").isNotNull()).withColumns({
        "_u": F.coalesce("UnitCode", F.lit("nan")), "_m": F.coalesce(col("MethodDetectionLimit").cast("string"), F.lit("nan"))
    })
    # one row per combination that occurs; the sets and first values are taken from these
    parts = rows.groupBy("VmvCode", "VariableCode", "VariableName", "MethodCode", "_u", "_m").agg(
        F.min("row_key").alias("row_key"), F.count("MeasurementValue").alias("n")
    )
    reg = parts.groupBy("VmvCode").agg(
        *[first_value(c).alias(c) for c in ("VariableCode", "VariableName", "MethodCode")],
        F.array_sort(F.collect_set("_u")).alias("_units"),
        F.array_sort(F.collect_set("_m")).alias("_mdls"),
        F.sum("n").alias("RecordCount"),
    )
    return reg.select(
        "VmvCode", "VariableCode", "VariableName", "MethodCode",
        F.array_join("_units", "; ").alias("UniquUnits"),
        F.array_join("_mdls", "; ").alias("UniqueMDLs"),
        "RecordCount",
        F.size("_units").alias("UnitCount"),
        F.size("_mdls").alias("MDLCount"),
        ((F.size("_units") == 1) & (F.size("_mdls") == 1)).alias("IsConsistent"),
    )


def station_variable_counts(df):
    return quality.crosstab(df, "StationNumber", "VariableName")


def station_summary(df):
    rows = df.where(col("StationNumber").isNotNull())
    names = ordered.group_with_first(rows, ["StationNumber"], ["Station"], row=True).withColumnRenamed("Station", "StationName")
    return names.join(rows.groupBy("StationNumber").agg(
        F.count(F.lit(1)).alias("MeasurementCount"),
        F.countDistinct("VariableName").alias("UniqueVariables"),
        F.min(TS).alias("DateRangeStart"),
        F.max(TS).alias("DateRangeEnd"),
    ), "StationNumber")


def variable_popularity(df):
    return df.where(col("VariableName").isNotNull()).groupBy("VariableName").agg(
        F.count("MeasurementValue").alias("TotalMeasurements"), F.countDistinct("StationNumber").alias("StationCount")
    ).orderBy(F.desc("TotalMeasurements"), "VariableName")


def parameter_popularity(df):
    """Popularity with date range and the share of all stations (counted once, as a scalar)."""
    stations = df.agg(F.countDistinct("StationNumber")).scalar()
    return df.where(col("VariableName").isNotNull()).groupBy("VariableName").agg(
        F.count("MeasurementValue").alias("TotalMeasurements"),
        F.countDistinct("StationNumber").alias("StationCount"),
        F.min(TS).alias("DateMin"),
        F.max(TS).alias("DateMax"),
    ).withColumn("StationCoverage", percent("StationCount", stations))


def coverage_data(df):
    keys = ["StationNumber", "Station", "VariableName"]
    rows = reduce(lambda d, k: d.where(col(k).isNotNull()), keys, df)
    return rows.groupBy(*keys).agg(
        F.count("MeasurementValue").alias("MeasurementCount"), F.min(TS).alias("DateMin"), F.max(TS).alias("DateMax")
    )


def coverage_matrix(df, variables):
    """One column of mean counts per listed variable, zero-filled."""
    return coverage_data(df).groupBy("StationNumber").pivot("VariableName", list(variables)).agg(F.avg("MeasurementCount")).na.fill(0.0)


def station_profiles(df):
    """Coordinates, counts, date range, years, variable list, coverage level and diversity per station."""
    variables = df.agg(F.countDistinct("VariableName")).scalar()
    rows = df.where(col("StationNumber").isNotNull())
    heads = ordered.group_with_first(rows, ["StationNumber"], ["Station", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees"], row=True)
    lists = rows.where(col("VariableName").isNotNull()).groupBy("StationNumber", "VariableName").agg(F.count(F.lit(1)).alias("n")).groupBy("StationNumber").agg(
        F.count(F.lit(1)).alias("UniqueVariables"), F.array_join(F.array_sort(F.collect_list("VariableName")), ", ").alias("VariableList")
    )
    figures = rows.groupBy("StationNumber").agg(
        F.count(F.lit(1)).alias("TotalMeasurements"),
        F.countDistinct("SampleNumber").alias("UniqueSamples"),
        F.countDistinct("ProjectNumber").alias("UniqueProjects"),
        F.min(TS).alias("DateRangeStart"),
        F.max(TS).alias("DateRangeEnd"),
        F.countDistinct(F.year(TS)).alias("YearsOfData"),
    )
    s = heads.withColumnsRenamed({"LatitudeDecimalDegrees": "Latitude", "LongitudeDecimalDegrees": "Longitude"})
    s = s.join(figures, "StationNumber").join(lists, "StationNumber", "left").na.fill(0, ["UniqueVariables"])
    return s.withColumns({
        "CoverageLevel": L.coverage_level("UniqueVariables"),
        "VariableDiversityPct": percent("UniqueVariables", variables),
    })


def coverage_summary(profiles):
    """Stations per coverage level; levels without stations appear with zero."""
    counts = profiles.agg(*[F.count_if(col("CoverageLevel") == name).alias(f"l{i}") for i, name in enumerate(L.COVERAGE_LEVELS)])
    cells = [F.struct(F.lit(i).alias("level_order"), F.lit(n).alias("CoverageLevel"), F.col(f"l{i}").alias("stations")) for i, n in enumerate(L.COVERAGE_LEVELS)]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*").orderBy("level_order")


def station_extent(profiles, complete=7, sparse=3):
    """Stations with at least ``complete`` or fewer than ``sparse`` variables."""
    kind = F.when(col("UniqueVariables") >= complete, "complete").when(col("UniqueVariables") < sparse, "sparse")
    return profiles.select("StationNumber", "UniqueVariables", "TotalMeasurements", kind.alias("extent")).where("extent is not null")


def unit_report(df):
    """Units per code: non-null texts, number with null counted, first variable name, rows."""
    parts = df.where(col("VmvCode").isNotNull()).groupBy("VmvCode", "VariableName", "UnitCode").agg(
        F.min("row_key").alias("row_key"), F.count("MeasurementValue").alias("n")
    )
    reg = parts.groupBy("VmvCode").agg(
        first_value("VariableName").alias("VariableName"),
        F.array_join(F.array_sort(F.collect_set("UnitCode")), "; ").alias("Units"),
        (F.countDistinct("UnitCode") + F.max(col("UnitCode").isNull().cast("int"))).alias("UniqueUnitCount"),
        F.sum("n").alias("TotalRecords"),
    )
    return reg.withColumn("IsConsistent", col("UniqueUnitCount") == 1)


def unit_violations(df):
    """Rows, stations and projects per unit of codes with several units."""
    report = unit_report(df).where(~col("IsConsistent")).select("VmvCode", "VariableName")
    per_unit = df.groupBy("VmvCode", "UnitCode").agg(
        # a null unit matches no row in the source report, so its counts are zero
        F.count("UnitCode").alias("RecordsWithThisUnit"),
        F.countDistinct(F.when(col("UnitCode").isNotNull(), col("StationNumber"))).alias("StationCount"),
        F.countDistinct(F.when(col("UnitCode").isNotNull(), col("ProjectNumber"))).alias("ProjectCount"),
    )
    return per_unit.join(report, "VmvCode").orderBy("VmvCode", F.desc("RecordsWithThisUnit"))


def unit_conversion_guide(df, match="contains"):
    """Conversion candidates: pH in several units, temperature in Celsius and Fahrenheit."""
    def named(word):
        if match == "word":
            return F.coalesce(F.lower("VariableName").rlike(rf"\b{word}\b"), F.lit(False))
        return contains_text("VariableName", word)

    def units_of(word):
        return F.array_sort(F.collect_set(F.when(named(word), F.coalesce("UnitCode", F.lit("nan")))))

    found = df.agg(units_of("ph").alias("ph"), units_of("temperature").alias("temp"))
    both = F.array_contains("temp", "C") & F.array_contains("temp", "F")
    rules = [
        (F.size("ph") > 1, "pH", F.array_join("ph", "; "), "Harmonize to canonical unit", "Use pH units as canonical"),
        (both, "Temperature", F.lit("Celsius; Fahrenheit"), "Celsius-Fahrenheit conversion", "Convert all to Celsius; F = C * 9/5 + 32"),
    ]
    cells = [
        F.when(cond, F.struct(F.lit(v).alias("Variable"), units.alias("UnitsFound"), F.lit(need).alias("ConversionNeeded"), F.lit(todo).alias("Recommendation")))
        for cond, v, units, need, todo in rules
    ]
    return found.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")


def affected_records(df):
    """Rows of codes with several units and their share: counted per code, so no row is joined."""
    per_code = df.groupBy("VmvCode").agg(
        F.count(F.lit(1)).alias("n"), (F.countDistinct("UnitCode") + F.max(col("UnitCode").isNull().cast("int"))).alias("u")
    )
    return per_code.agg(
        F.coalesce(F.sum(F.when(col("VmvCode").isNotNull() & (col("u") > 1), col("n"))), F.lit(0)).alias("affected"),
        F.sum("n").alias("total"),
    ).withColumn("affected_pct", percent_or_zero("affected", "total"))


def code_description_pairs(df):
    return quality.crosstab(df, "MeasurementQualifier", "MeasurementQualifierDescription").withColumnRenamed("n", "Frequency")


def completeness_by_code(df):
    rows = df.where(col("MeasurementQualifier").isNotNull())
    filled = {
        f"has_{n}": col(c) for c, n in (
            ("MeasurementValue", "value"), ("SampleComment", "sample_comment"), ("MeasurementComment", "measurement_comment"), ("MeasurementFlag", "flag"))
    }
    out = ordered.group_with_first(rows, ["MeasurementQualifier"], ["MeasurementQualifierDescription"], {"records": F.lit(1), **filled}, row=True)
    return out.withColumnRenamed("MeasurementQualifierDescription", "description")


def code_details(df):
    """Per code: rows, described rows, value range and flag histogram (flag=rows, sorted)."""
    rows = df.where(col("MeasurementQualifier").isNotNull())
    by_flag = rows.groupBy("MeasurementQualifier", "MeasurementFlag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("MeasurementQualifierDescription").alias("d"),
        F.min("MeasurementValueNum").alias("lo"),
        F.max("MeasurementValueNum").alias("hi"),
    )
    cell = F.when(col("MeasurementFlag").isNotNull(), F.concat_ws("=", "MeasurementFlag", F.col("n").cast("string")))
    return by_flag.groupBy("MeasurementQualifier").agg(
        F.sum("n").alias("frequency"),
        F.sum("d").alias("described"),
        F.min("lo").alias("value_min"),
        F.max("hi").alias("value_max"),
        F.array_join(F.array_sort(F.collect_list(cell)), "; ").alias("flags"),
    )
