"""Flag rates, rankings, crosstabs and station quality: one conditional aggregate each."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions import labels as L
from hydroq.functions.values import col, is_blank, percent, percent_or_zero
from hydroq.operators import filters, ordered

Q = "MeasurementQualifier"
NO_FLAG = "(Clean/No Flag)"


def metrics(df, *keys):
    """Rows, clean rows (no qualifier or empty text), flagged rows and both shares, zero when empty."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(is_blank(Q)).alias("clean"))
    agg = agg.withColumn("flagged", F.col("total") - F.col("clean"))
    return agg.withColumns({"pct_clean": percent_or_zero("clean", "total"), "pct_flagged": percent_or_zero("flagged", "total")})


def by_station(df):
    return metrics(df.where(col("StationNumber").isNotNull()), "StationNumber").orderBy("pct_clean", "StationNumber")


def by_year(df):
    rows = df.withColumn("Year", F.year("SampleDateTime")).where(col("Year").isNotNull())
    return metrics(rows, "Year").orderBy("Year")


def by_parameter(df, top=None):
    out = metrics(df.where(col("VmvCode").isNotNull()), "VmvCode").orderBy(F.desc("pct_flagged"), "VmvCode")
    return out.limit(top) if top else out


def top_counts(df, key, n=15):
    """The n most frequent keys; nulls are not counted."""
    counts = df.where(col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("records"))
    return counts.orderBy(F.desc("records"), key).limit(n)


def qualifier_distribution(df, top=None):
    """Rows per qualifier with share and running share. The window sees one row per code."""
    counts = df.groupBy(Q).agg(F.count(F.lit(1)).alias("n"))
    every, order = Window.partitionBy(), Window.partitionBy().orderBy(F.desc("n"), F.asc_nulls_first(Q))
    shares = counts.select(
        F.coalesce(col(Q), F.lit(NO_FLAG)).alias("Qualifier"),
        F.col("n").alias("Count"),
        percent("n", F.sum("n").over(every)).alias("Percentage"),
        percent(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(every)).alias("CumulativePct"),
        F.row_number().over(order).alias("position"),
    )
    return shares.where(F.col("position") <= top) if top else shares


def crosstab(df, row, column):
    """Long counts of two keys, rows with a null key dropped."""
    return df.where(col(row).isNotNull() & col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df, row, column, values):
    """The same with one column per listed value, zero-filled."""
    return df.where(col(row).isNotNull() & col(column).isin(list(values))).groupBy(row).pivot(column, list(values)).count().na.fill(0)


def _flag_stats(df, key, first, include_potentially, row=False):
    flagged = F.when(L.is_tier_flagged(include_potentially), 1)
    counts = {"total_records": F.lit(1), "flagged_count": flagged}
    agg = ordered.group_with_first(df.where(col(key).isNotNull()), [key], first, counts, row=row)
    return agg.withColumn("flagged_pct", percent("flagged_count", "total_records"))


def variable_flag_stats(df, include_potentially=False):
    """Flag rate per variable code with its display label."""
    stats = _flag_stats(df, "VmvCode", ["VariableCode", "VariableName"], include_potentially, row=True)
    stats = stats.withColumn("variable_label", L.variable_key_label())
    return stats.drop("VariableCode", "VariableName").orderBy(F.desc("flagged_pct"), "VmvCode")


def station_flag_stats(df, include_potentially=False):
    stats = _flag_stats(df, "StationNumber", ["Station"], include_potentially)
    return stats.withColumn("station_label", L.station_label()).drop("Station").orderBy(F.desc("flagged_pct"), "StationNumber")


def station_flag_map(df, include_potentially=False, codes=None):
    """Flag rate per station with its first name and coordinates."""
    rows = filters.by_parameters(df, codes)
    return _flag_stats(rows, "StationNumber", ["Station", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees"], include_potentially)


def flag_matrix(df, by="variable"):
    """Rows per (variable or station, tier code) with row and column totals.

    Column totals are a second aggregate over at most 13 codes, not a window over all rows of a code.
    """
    key = "VmvCode" if by == "variable" else "StationNumber"
    flagged = df.where(col(Q).isin(S.TIER_CODES))
    cells = flagged.where(col(key).isNotNull()).groupBy(key, Q).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(key).agg(F.sum("n").alias("row_total"))
    columns = cells.groupBy(Q).agg(F.sum("n").alias("column_total"))
    return cells.join(rows, key).join(columns, Q)


def flag_matrix_wide(df, by="variable"):
    """One column per tier code, zero-filled, most flagged first."""
    key = "VmvCode" if by == "variable" else "StationNumber"
    wide = crosstab_wide(df.where(col(Q).isin(S.TIER_CODES)), key, Q, S.TIER_CODES)
    total = sum((F.col(f"`{c}`") for c in S.TIER_CODES[1:]), F.col(f"`{S.TIER_CODES[0]}`"))
    return wide.withColumn("row_total", total).orderBy(F.desc("row_total"), key)


def timeline(df):
    """Share of rows without any qualifier per month (empty text counts as a flag here)."""
    month = F.date_format("SampleDateTime", "yyyy-MM")
    return df.groupBy(month.alias("YearMonth")).agg((F.avg(col(Q).isNull().cast("double")) * 100).alias("pct_clean"))


def completeness_matrix(df):
    """Row counts per (station, code) as percent of the code's largest station count, zeros included.

    All stations and all codes of the data; the list of codes, a dictionary, is one scalar value.
    """
    cells = df.where(col("StationNumber").isNotNull()).groupBy("StationNumber", "VmvCode").agg(F.count(F.lit(1)).alias("n"))
    largest = cells.groupBy("VmvCode").agg(F.max("n").alias("most"))
    codes = largest.agg(F.collect_set("VmvCode")).scalar()
    grid = cells.groupBy("StationNumber").agg(F.map_from_entries(F.collect_list(F.struct("VmvCode", "n"))).alias("_n"))
    long = grid.withColumn("_codes", codes).select("StationNumber", "_n", F.explode("_codes").alias("VmvCode"))
    long = long.select("StationNumber", "VmvCode", F.coalesce(F.try_element_at("_n", "VmvCode"), F.lit(0)).alias("n"))
    return long.join(largest, "VmvCode").select("StationNumber", "VmvCode", percent("n", "most").alias("completeness"))


def station_quality_map(df, threshold=90.0):
    """Clean share (null only), rows, class and marker size per station."""
    rows = df.where(col("StationNumber").isNotNull())
    counts = {"records": F.lit(1), "_clean": F.when(col(Q).isNull(), 1)}
    s = ordered.group_with_first(rows, ["StationNumber"], ["LatitudeDecimalDegrees", "LongitudeDecimalDegrees"], counts, row=True)
    s = s.withColumn("quality", percent("_clean", "records")).drop("_clean")
    return s.withColumns({"category": L.station_class("quality", threshold), "radius": L.marker_radius("records")})


def map_center(points):
    return points.agg(F.avg("LatitudeDecimalDegrees").alias("center_lat"), F.avg("LongitudeDecimalDegrees").alias("center_lon"))


def kpis(df, include_potentially=False):
    """Flag counts, affected and total stations and variables in one pass."""
    flagged = L.is_tier_flagged(include_potentially)
    agg = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(L.is_tier_flagged()).alias("unreliable"),
        F.count_if(L.is_tier_flagged(True)).alias("broad"),
        F.countDistinct(F.when(flagged, col("StationNumber"))).alias("stations_affected"),
        F.countDistinct("StationNumber").alias("stations"),
        F.countDistinct(F.when(flagged, col("VmvCode"))).alias("variables_affected"),
        F.countDistinct("VmvCode").alias("variables"),
    )
    shown = F.col("broad") if include_potentially else F.col("unreliable")
    return agg.withColumns({"potentially": F.col("broad") - F.col("unreliable"), "flagged_pct": percent_or_zero(shown, "total_records")})


def filtered_summary(df):
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("StationNumber").alias("stations"),
        percent_or_zero(F.count_if(is_blank(Q)), F.count(F.lit(1))).alias("clean_pct"),
        F.countDistinct("VmvCode").alias("parameters"),
        F.min("SampleDateTime").alias("date_min"),
        F.max("SampleDateTime").alias("date_max"),
    )


def version_counts(df, versions=("A", "B", "C")):
    """Rows per dataset version and their share of all rows, in one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(filters.version_predicate(v)).alias(v) for v in versions])
    cells = F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).alias("records"), percent_or_zero(v, "_all").alias("share_pct")) for v in versions])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def drill_down(df):
    """Quality by station, by parameter, by year and overall: four groupings of one scan."""
    rows = df.withColumn("Year", F.year("SampleDateTime"))
    agg = rows.groupingSets([["StationNumber"], ["VmvCode"], ["Year"], []], "StationNumber", "VmvCode", "Year").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_blank(Q)).alias("clean"), F.grouping_id().alias("_g")
    )
    # one bit per key, set where the key is not part of the grouping
    level = L.lookup("_g", {3: "station", 5: "parameter", 6: "year", 7: "all"})
    entity = F.coalesce("StationNumber", F.col("VmvCode").cast("string"), F.col("Year").cast("string"), F.lit("all"))
    return agg.select(level.alias("level"), entity.alias("entity"), "total", "clean", percent_or_zero("clean", "total").alias("pct_clean"))
