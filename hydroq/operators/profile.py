"""Missing data, column profiles, numeric summaries, outliers, duplicates and suspicious patterns."""

from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions.values import col, contains_text, percent, percent_or_zero, ratio
from hydroq.operators import ordered
from hydroq.sources import loader
from hydroq.sources.staging import stage

V = "MeasurementValueNum"


def _long(wide, cells, *keys):
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def missing_by_column(df):
    """Null count and share per column, one pass."""
    types, names = {f.name: f.dataType.simpleString() for f in df.schema.fields}, S.source_columns(df)
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names])
    cells = [
        F.struct(
            F.lit(c).alias("column"), (F.col("_n") - F.col(c)).alias("missing_count"),
            percent_or_zero(F.col("_n") - F.col(c), "_n").alias("missing_percent"), F.lit(types[c]).alias("data_type"),
        )
        for c in names
    ]
    return _long(wide, cells).orderBy(F.desc("missing_percent"), "column")


def missing_by_station(df, key="StationNumber"):
    """Mean over stations of the station's null share, per column."""
    columns = [c for c in S.source_columns(df) if c != key]
    per = df.where(col(key).isNotNull()).groupBy(key).agg(*[(F.avg(col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    wide = per.agg(*[F.avg(c).alias(c) for c in columns])
    return _long(wide, [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_percent")) for c in columns])


def null_patterns(df):
    """Rows per combination of null columns. Few combinations occur, so all pair counts follow from this."""
    return df.groupBy(F.array_compact(F.array(*[F.when(col(c).isNull(), F.lit(c)) for c in S.source_columns(df)])).alias("nulls")).agg(
        F.count(F.lit(1)).alias("n")
    )


def missingness_correlation(df):
    """Pearson correlation of null indicators for each pair of columns; constant columns give null."""
    names = S.source_columns(df)
    patterns = null_patterns(df)
    has = {c: F.array_contains("nulls", c) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    sums = [F.sum("n").alias("_n")]
    sums += [F.sum(F.when(has[c], F.col("n")).otherwise(0)).alias(f"_{i}") for i, c in enumerate(names)]
    sums += [F.sum(F.when(has[a] & has[b], F.col("n")).otherwise(0)).alias(f"_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    wide = patterns.agg(*sums)
    at = {c: i for i, c in enumerate(names)}
    cells = []
    for a, b in pairs:
        sa, sb, both, n = F.col(f"_{at[a]}"), F.col(f"_{at[b]}"), F.col(f"_{at[a]}_{at[b]}"), F.col("_n")
        spread = F.sqrt((n * sa - sa * sa).cast("double") * (n * sb - sb * sb).cast("double"))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ratio(n * both - sa * sb, spread).alias("correlation"), (sa / n).alias("rate_a"), (sb / n).alias("rate_b")))
    return _long(wide, cells)


def missing_mechanism(df, limit=0.1):
    """MAR where a column's nulls correlate with another's, else MCAR; columns without nulls are skipped."""
    pairs = missingness_correlation(df)
    both = pairs.select(F.col("a").alias("column"), F.col("rate_a").alias("missing_rate"), F.col("b").alias("other"), "correlation").unionByName(
        pairs.select(F.col("b").alias("column"), F.col("rate_b").alias("missing_rate"), F.col("a").alias("other"), "correlation")
    )
    strong = F.when(F.abs("correlation") > limit, col("other"))
    out = both.where("missing_rate > 0").groupBy("column").agg(
        F.max("missing_rate").alias("missing_rate"), F.array_join(F.array_sort(F.collect_list(strong)), ", ").alias("correlated_with")
    )
    return out.withColumn("mechanism", F.when(col("correlated_with") != "", "MAR").otherwise("MCAR"))


def dataset_profile(df):
    """Rows, columns, cells and the rows that belong to groups of equal rows."""
    names = S.source_columns(df)
    groups = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.lit(len(names)).alias("columns"),
        (F.coalesce(F.sum("_n"), F.lit(0)) * len(names)).alias("total_cells"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"),
    )


def value_counts(df, columns):
    """Rows per (column, value as text); the shuffle carries distinct pairs only."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.explode(cells).alias("c")).select("c.*")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df, k=5):
    """Filled, null, distinct and repeated values per column and the k most frequent texts as a map."""
    counts = value_counts(df, S.source_columns(df))
    base = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(col("value").isNotNull(), col("n"))), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.sum(F.when(col("value").isNull(), col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_values"),
    )
    base = base.withColumns({
        "null_percent": percent_or_zero("null_count", F.col("non_null_count") + F.col("null_count")),
        "duplicate_values": F.col("non_null_count") + F.col("null_count") - F.col("unique_values"),
    })
    texts = loader.text_columns(df)
    top = ordered.top_k(counts.where(col("value").isNotNull() & col("column").isin(texts)), ["column"], [F.desc("n"), F.asc("value")], k)
    lists = top.groupBy("column").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n"))), lambda x: F.struct(x["value"], x["n"]))).alias("top_values")
    )
    return base.join(lists, "column", "left")


def numeric_summary(df, columns, *keys):
    """Count, missing, mean, std, extremes, skewness, excess kurtosis and quartiles per numeric column (and key)."""
    aggs = []
    for c in columns:
        v = col(c).cast("double")
        aggs += [
            F.struct(
                F.lit(c).alias("name"), F.count(c).alias("count"), F.count_if(col(c).isNull()).alias("missing"), F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
            ).alias(f"_{c}")
        ]
    moments = _long(df.groupBy(*keys).agg(*aggs), [F.col(f"_{c}") for c in columns], *keys)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    quarts = ordered.quantiles(long, [*keys, "name"], "v", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return moments.join(quarts, [*keys, "name"], "left").withColumn(
        "missing_pct", percent_or_zero("missing", F.col("count") + F.col("missing"))
    )


def outlier_bounds(df, keys, value=V, method="iqr"):
    """Mean and population deviation (zscore) or quartiles (iqr) per key; keys with fewer than three numbers give none."""
    rows = df.where(col(value).isNotNull())
    if method == "zscore":
        return rows.groupBy(*keys).agg(F.avg(value).alias("center"), F.stddev_pop(value).alias("scale"), F.count(value).alias("_n")).where("_n >= 3").drop("_n")
    dist = ordered.distribution(rows.select(*keys, value), keys, value)
    q = dist.groupBy(*keys).agg(*ordered.quantile_columns(value, {"q1": 0.25, "q3": 0.75}), F.max("total").alias("_n"))
    return q.where("_n >= 3").drop("_n")


def outlier_condition(method, value=V):
    v = col(value)
    if method == "zscore":
        return F.coalesce(F.abs(F.try_divide(v - col("center"), col("scale"))) > S.Z_LIMIT, F.lit(False))
    reach = (col("q3") - col("q1")) * S.IQR_FACTOR
    return F.coalesce((v < col("q1") - reach) | (v > col("q3") + reach), F.lit(False))


def outlier_counts(df, keys, value=V, method="iqr"):
    """Outliers per key, judged on distinct values with their frequency: no row is joined."""
    counts = df.where(col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    judged = counts.join(outlier_bounds(df, keys, value, method), list(keys))
    out = judged.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(outlier_condition(method, value), col("n"))), F.lit(0)).alias("outlier_count"), F.sum("n").alias("numbers")
    )
    return out.withColumn("outlier_percent", percent("outlier_count", "numbers"))


def with_outlier_flag(df, keys, value=V, method="iqr", name="is_outlier"):
    """Rows with an outlier flag. The bounds are staged, so a small table is broadcast and a big one is not."""
    bounds = stage(outlier_bounds(df, keys, value, method), "outlier-bounds")
    joined = df.join(bounds, list(keys), "left")
    return joined.withColumn(name, outlier_condition(method, value)).select(*df.columns, name)


def outlier_summary(df, columns, most_null=50.0):
    """Outliers of all numeric columns by both methods; columns with more nulls and zero counts are left out."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.col("_n")) for c in columns]
    kept = _long(wide, cells).where(100.0 - percent_or_zero("filled", "_n") <= most_null).select("column")
    values = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.explode(values).alias("c")).select("c.*")
    parts = [outlier_counts(long, ["column"], "v", m).withColumn("method", F.lit(m)) for m in ("zscore", "iqr")]
    return parts[0].unionByName(parts[1]).where("outlier_count > 0").join(kept, "column", "left_semi").drop("numbers")


def validity_issues(df, bounds=S.VALIDITY_BOUNDS, recommended=None, match="contains"):
    """Rows below the minimum or above the maximum of each parameter whose name is contained."""
    recommended = recommended or {}
    aggs, cells = [], []
    for i, (name, low, high) in enumerate(bounds):
        if match == "word":
            hit = F.coalesce(F.lower("VariableName").rlike(rf"\b{name.lower()}\b"), F.lit(False))
        else:
            hit = contains_text("VariableName", name)
        tests = [("below_minimum", f"Min: {low:g}", col(V) < low), ("above_maximum", f"Max: {high:g}", col(V) > high)]
        if name in recommended:
            r = recommended[name]
            tests.append(("below_recommended", f"Recommended Min: {r:g}", (col(V) < r) & (col(V) >= low)))
        aggs.append(F.count_if(hit).alias(f"n{i}"))
        for j, (kind, text, test) in enumerate(tests):
            aggs.append(F.count_if(hit & test).alias(f"c{i}_{j}"))
            cells.append(F.struct(
                F.lit(name).alias("parameter"), F.lit(kind).alias("issue_type"), F.lit(text).alias("constraint"),
                F.col(f"c{i}_{j}").alias("count"), percent_or_zero(f"c{i}_{j}", f"n{i}").alias("percent"),
            ))
    return _long(df.agg(*aggs), cells).where("count > 0")


def duplicate_summary(df, key=("StationNumber", "SampleDateTime", "VariableName")):
    """Rows in groups of equal rows and rows that share the key columns."""
    def repeated(columns):
        groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        return groups.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("r"))

    exact = repeated(S.source_columns(df)).select(F.col("r").alias("exact_duplicates"))
    return exact.withColumn("key_column_duplicates", repeated(list(key)).scalar())


def suspicion_patterns(df, columns):
    """Columns without any value, with one repeated value, or with mostly whole numbers."""
    aggs, cells = [], []
    for c in columns:
        v = col(c).cast("double")
        aggs += [F.count(c).alias(f"n_{c}"), F.min(v).alias(f"lo_{c}"), F.max(v).alias(f"hi_{c}"), F.count_if(v % 1 == 0).alias(f"w_{c}")]
        n, lo, hi, whole = (F.col(f"{k}_{c}") for k in ("n", "lo", "hi", "w"))
        pct = percent_or_zero(whole, n)
        none = F.lit(None).cast("double")
        for pattern, cond, value, share in (
            ("all_missing", n == 0, none, none),
            ("all_identical_value", (n > 10) & (lo == hi), lo, none),
            ("suspiciously_round", (n > 100) & (pct > 80), none, pct),
        ):
            cells.append(F.when(cond, F.struct(F.lit(c).alias("column"), F.lit(pattern).alias("pattern"), value.alias("value"), n.alias("count"), share.alias("percent_round"))))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
