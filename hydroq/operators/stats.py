"""Normality, distribution fits, trends and group comparisons, computed from ordered distinct values."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions import tails
from hydroq.functions.values import col, normal_quantile, ratio
from hydroq.operators import ordered, profile

V = "MeasurementValueNum"
TS = "SampleDateTime"


def _weighted_moments(dist, keys, value=V):
    n, v = F.col("n"), col(value)
    first = dist.groupBy(*keys).agg((F.sum(v * n) / F.sum(n)).alias("mean"), F.sum(n).alias("size"))
    spread = dist.join(first, list(keys)).groupBy(*keys, "mean", "size").agg(F.sum(n * (v - F.col("mean")) ** 2).alias("ss"))
    return spread.withColumn("sd", F.sqrt(F.try_divide("ss", F.col("size") - 1)))


# ---- normality -----------------------------------------------------------------------

def normality_verdict(df, keys=("VmvCode",), value=V):
    """Population skewness and excess kurtosis; likely normal within 2 and 3. Fewer than 3 numbers give an error."""
    out = df.where(col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("sample_size"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis")
    )
    few = F.col("sample_size") < 3
    return out.select(
        *keys, "sample_size",
        F.when(~few, F.col("skewness")).alias("skewness"),
        F.when(~few, F.col("kurtosis")).alias("kurtosis"),
        F.when(~few, (F.abs("skewness") < 2) & (F.abs("kurtosis") < 3)).alias("is_likely_normal"),
        F.when(few, F.lit("Insufficient data")).alias("error"),
    )


def kolmogorov_smirnov(df, keys=("VmvCode",), value=V):
    """Largest distance to the normal distribution with the sample's mean and deviation, and its p."""
    keys = list(keys)
    dist = ordered.distribution(df.select(*keys, value), keys, value)
    placed = dist.join(_weighted_moments(dist, keys, value), keys).where("size >= 3 and sd > 0")
    cdf = tails.normal_cdf_of((col(value) - F.col("mean")) / F.col("sd"))
    placed = placed.withColumn("cdf", cdf)
    d = F.max(F.greatest((F.col("before") + F.col("n")) / F.col("total") - F.col("cdf"), F.col("cdf") - F.col("before") / F.col("total")))
    out = placed.groupBy(*keys).agg(d.alias("statistic"), F.max("total").alias("sample_size"))
    out = out.withColumn("p_value", tails.kolmogorov_p("statistic", F.col("sample_size").cast("double")))
    return out.withColumn("normal", F.col("p_value") > S.ALPHA)


# Significance levels in percent and asymptotic critical values of the test against a fitted normal.
ANDERSON_CRITICAL = {15.0: 0.576, 10.0: 0.656, 5.0: 0.787, 2.5: 0.918, 1.0: 1.092}


def anderson_darling(df, keys=("VmvCode",), value=V):
    """Anderson-Darling statistic against the fitted normal and its critical values."""
    keys = list(keys)
    dist = ordered.distribution(df.select(*keys, value), keys, value)
    placed = dist.join(_weighted_moments(dist, keys, value), keys).where("size >= 3 and sd > 0")
    z = (col(value) - F.col("mean")) / F.col("sd")
    placed = placed.withColumns({"lower": tails.log_normal_cdf_of(z), "upper": tails.log_normal_cdf_of(-z)})
    b, k, size = F.col("before"), F.col("n"), F.col("total")
    # a value of frequency k takes the ranks before+1 .. before+k; the rank weights are summed in closed form
    rising = (b + k) * (b + k) - b * b
    falling = k * (2 * size + 1) - ((b + k) * (b + k + 1) - b * (b + 1))
    out = placed.groupBy(*keys).agg(
        F.max("total").alias("sample_size"), F.sum(rising * F.col("lower") + falling * F.col("upper")).alias("_sum")
    )
    n = F.col("sample_size").cast("double")
    scale = 1.0 + 4.0 / n - 25.0 / (n * n)
    levels = {f"critical_{str(level).replace('.0', '').replace('.', '_')}pct": F.round(F.lit(c) / scale, 3) for level, c in ANDERSON_CRITICAL.items()}
    return out.withColumn("statistic", -n - F.col("_sum") / n).drop("_sum").withColumns(levels)


# Polynomials in 1/sqrt(n) of the two outer weights, highest power first.
SHAPIRO_LAST = [-2.706056, 4.434685, -2.07119, -0.147981, 0.221157]
SHAPIRO_BEFORE = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981]


def _polynomial(coefficients, x):
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def shapiro(df, keys=("VmvCode",), value=V):
    """Shapiro-Wilk for every key, whatever its size.

    The weights depend on rank and size only, so W is made of sums over the ranked values; no key is gathered. With fewer
    than 3 numbers or a single value W is null. Beyond 5,000 numbers the p value is not defined and stays null.
    """
    keys = list(keys)
    ranked = ordered.distribution(df.select(*keys, value), keys, value)
    ranked = ranked.withColumn("_i", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))))
    n, i, x = F.col("total").cast("double"), F.col("_i"), col(value)
    ranked = ranked.withColumn("_m", normal_quantile((i - 0.375) / (n + 0.25)))

    def at(place):
        return F.max(F.when(i == place, x))

    sums = ranked.groupBy(*keys).agg(
        F.max("total").alias("sample_size"), F.sum(F.col("_m") * F.col("_m")).alias("_mm"), F.sum(F.col("_m") * x).alias("_mx"), (F.var_pop(x) * F.count(x)).alias("_ss"),
        at(F.lit(1)).alias("_x1"), at(F.lit(2)).alias("_x2"), at(F.col("total") - 1).alias("_y2"), at(F.col("total")).alias("_y1"),
        F.max(F.when(i == F.col("total"), F.col("_m"))).alias("_m1"), F.max(F.when(i == F.col("total") - 1, F.col("_m"))).alias("_m2"),
    )
    size, mm, m1, m2 = F.col("sample_size"), F.col("_mm"), F.col("_m1"), F.col("_m2")
    u = 1.0 / F.sqrt(size.cast("double"))
    outer = F.when(size == 3, F.sqrt(F.lit(0.5))).otherwise(_polynomial([*SHAPIRO_LAST, m1 / F.sqrt(mm)], u))
    sums = sums.withColumns({"_a1": outer, "_a2": F.when(size > 5, _polynomial([*SHAPIRO_BEFORE, m2 / F.sqrt(mm)], u))})
    a1, a2 = F.col("_a1"), F.col("_a2")
    wide, inner = F.col("_y1") - F.col("_x1"), F.col("_y2") - F.col("_x2")
    phi = F.when(size > 5, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)).when(size > 3, (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1))
    dot = F.when(size == 3, a1 * wide).when(size > 5, (F.col("_mx") - m1 * wide - m2 * inner) / F.sqrt(phi) + a1 * wide + a2 * inner).otherwise((F.col("_mx") - m1 * wide) / F.sqrt(phi) + a1 * wide)
    w = F.when((size >= 3) & (F.col("_ss") > 0), F.least(F.lit(1.0), dot * dot / F.col("_ss")))
    out = sums.select(*keys, "sample_size", w.alias("statistic"))
    out = out.withColumn("p_value", F.when(F.col("statistic").isNotNull() & (F.col("sample_size") <= 5000), tails.shapiro_p("statistic", F.col("sample_size").cast("double"))))
    return out.withColumn("normal", F.col("p_value") > S.ALPHA)


def identify_distribution(df, keys=("VmvCode",), value=V, least=10):
    """Distance of each key to five fitted distributions and the closest one.

    Fits use sums over the key only: normal by moments, lognormal and Weibull by log moments,
    exponential from the minimum, gamma by likelihood. Locations are fixed (0, or the minimum for
    the exponential); lognormal, gamma and Weibull need positive values.
    """
    keys = list(keys)
    dist = ordered.distribution(df.select(*keys, value), keys, value)
    v, n = col(value), F.col("n")
    lv = F.when(v > 0, F.ln(v))
    first = dist.groupBy(*keys).agg(
        F.sum(n).alias("size"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("lowest"), (F.sum(lv * n) / F.sum(n)).alias("log_mean")
    ).where(F.col("size") >= least)
    second = dist.join(first, keys).groupBy(*keys, *[c for c in first.columns if c not in keys]).agg(
        F.sqrt(F.sum(n * (v - F.col("mean")) ** 2) / F.max("size")).alias("sd"),
        F.sqrt(F.sum(n * (lv - F.col("log_mean")) ** 2) / F.max("size")).alias("log_sd"),
    )
    positive = F.col("lowest") > 0
    shape = F.when(positive, F.lit(3.141592653589793) / (F.sqrt(F.lit(6.0)) * F.col("log_sd")))
    fits = second.where("sd > 0").withColumns({
        "gamma_shape": F.when(positive, tails.gamma_shape_of(F.ln(F.when(F.col("mean") > 0, F.col("mean"))) - F.col("log_mean"))),
        "weibull_shape": shape,
        "weibull_scale": F.exp(F.col("log_mean") + F.lit(0.5772156649015329) / shape),
    })
    placed = dist.join(fits, keys)
    positive = F.col("lowest") > 0
    cdfs = {
        "normal": tails.normal_cdf_of((v - F.col("mean")) / F.col("sd")),
        "lognormal": F.when(positive, tails.normal_cdf_of((lv - F.col("log_mean")) / F.col("log_sd"))),
        "exponential": 1 - F.exp(-(v - F.col("lowest")) / (F.col("mean") - F.col("lowest"))),
        "gamma": F.when(positive, tails.gamma_cdf_of(v, F.col("gamma_shape"), F.col("mean") / F.col("gamma_shape"))),
        "weibull": F.when(positive, 1 - F.exp(-((v / F.col("weibull_scale")) ** F.col("weibull_shape")))),
    }
    placed = placed.withColumns({f"cdf_{k}": c for k, c in cdfs.items()})
    high, low = (F.col("before") + n) / F.col("total"), F.col("before") / F.col("total")
    distances = [F.max(F.greatest(high - F.col(f"cdf_{k}"), F.col(f"cdf_{k}") - low)).alias(f"ks_{k}") for k in cdfs]
    out = placed.groupBy(*keys).agg(F.max("total").alias("sample_size"), *distances)
    ranked = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"ks_{k}").isNotNull(), F.struct(F.col(f"ks_{k}").alias("d"), F.lit(k).alias("name"))) for k in cdfs])))
    return out.withColumn("best_fit", F.try_element_at(ranked, F.lit(1))["name"])


# ---- trend ---------------------------------------------------------------------------

def _pair_sums(df, keys, value):
    """Pair sums of each series in the order of (time, arrival)."""
    rows = df.where(col(value).isNotNull() & col(TS).isNotNull()).select(*keys, F.struct(TS, "row_key").alias("_order"), value)
    return ordered.pair_sign_sum(rows, keys, "_order", value, ordered.day_block(F.col("_order")[TS]))


def mann_kendall(df, keys=("StationNumber", "VmvCode"), value=V, compat=False):
    """S, Z, two-sided p and direction per series. All pairs count; nothing is sampled.

    ``compat`` takes the difference the other way round, so that a rising series has a negative S.
    """
    sums = _pair_sums(df, list(keys), value).where("n >= 3")
    s = -F.col("s") if compat else F.col("s")
    n = F.col("n").cast("double")
    out = sums.withColumns({"s": s, "var_s": n * (n - 1) * (2 * n + 5) / 18})
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var_s")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var_s")).otherwise(0.0)
    return out.withColumn("z", z).drop("var_s")


def with_trend_verdict(mk):
    """Adds p and the trend class to a Mann-Kendall frame."""
    out = mk.withColumn("p_value", tails.normal_two_sided_p("z"))
    direction = F.when(F.col("s") > 0, "increasing").otherwise("decreasing")
    return out.withColumns({
        "trend": F.when(F.col("p_value") < S.ALPHA, direction).otherwise("no_significant_trend"),
        "significant": F.col("p_value") < S.ALPHA,
    })


def kendall_tau(df, keys=("StationNumber", "VmvCode"), value=V):
    """Tau-b of value against time order per series; positions are distinct, so only values can tie."""
    keys = list(keys)
    ties = df.where(col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("t"))
    tied = ties.groupBy(*keys).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2.0).alias("tied"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    joined = _pair_sums(df, keys, value).where("n >= 2").join(tied, keys)
    return joined.select(*keys, "n", "s", ratio(F.col("s"), F.sqrt(pairs * (pairs - F.col("tied")))).alias("tau"))


def temporal_stability(df, keys=(), value=V):
    return df.where(col(value).isNotNull() & col(TS).isNotNull()).groupBy(*keys, F.year(TS).alias("year")).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


# ---- group comparisons ---------------------------------------------------------------

def paired_t(df, first_year, second_year, keys=("VmvCode",), value=V):
    """Paired t per key: the same station and calendar month in two years, from their means."""
    keys = list(keys)
    cells = df.where(col(value).isNotNull() & F.year(TS).isin(first_year, second_year)).groupBy(*keys, "StationNumber", F.month(TS).alias("Month")).agg(
        F.avg(F.when(F.year(TS) == first_year, col(value))).alias("a"), F.avg(F.when(F.year(TS) == second_year, col(value))).alias("b")
    )
    d = F.col("b") - F.col("a")
    out = cells.where("a is not null and b is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"))
    return out.withColumn("t", F.try_divide(F.col("mean_difference"), F.col("sd") / F.sqrt("pairs")))


def _group_moments(df, group, keys, value):
    """Size ``n``, mean ``m`` and variance ``v`` of every group."""
    return df.where(col(value).isNotNull() & col(group).isNotNull()).groupBy(*keys, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")
    )


def one_way_anova(df, group, keys=(), value=V):
    """F of the between-group mean square over the within-group one, from one aggregate per group."""
    return anova_of_groups(_group_moments(df, group, keys, value), keys)


def tukey_hsd(df, group, keys=(), value=V):
    """(keys, first, second, difference, q, groups, df, p_value): every pair of group means by the studentised range.

    Follows a one-way analysis of variance; unequal sizes by Tukey and Kramer. Rows meet in one aggregate per group, pairs are
    made of finished means only (the groups of a key fit one task). q and p_value are null without spread within the groups
    or without degrees of freedom; keys of one group give no row.
    """
    whole = _group_moments(df, group, keys, value).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), "n", "m"))).alias("means"), F.count(F.lit(1)).alias("groups"),
        (F.sum("n") - F.count(F.lit(1))).alias("df"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
    )
    firsts = whole.select("*", F.posexplode("means").alias("place", "a"))
    pairs = firsts.withColumn("b", F.explode(F.slice("means", F.col("place") + 2, F.size("means"))))
    difference = F.col("b.m") - F.col("a.m")
    error = F.sqrt(F.try_divide(F.col("within"), F.col("df").cast("double")) / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    out = pairs.select(*keys, F.col("a.g").alias("first"), F.col("b.g").alias("second"), difference.alias("difference"), F.try_divide(F.abs(difference), error).alias("q"), "groups", "df")
    return out.withColumn("p_value", tails.studentised_range_p("q", F.col("groups").cast("double"), F.col("df").cast("double")))


def anova_of_groups(g, keys=()):
    """The same from a frame of group size ``n``, mean ``m`` and variance ``v``."""
    overall = g.groupBy(*keys).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"))
    joined = g.join(overall, list(keys)) if keys else g.withColumns({c: overall.select(c).scalar() for c in ("grand", "total", "groups")})
    out = joined.groupBy(*keys).agg(
        F.max("groups").alias("groups"), F.max("total").alias("total"),
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
    )
    mean_square = F.try_divide(F.col("within"), (F.col("total") - F.col("groups")).cast("double"))
    return out.withColumn("f", F.try_divide(F.col("between") / (F.col("groups") - 1), mean_square))


def levene(df, group, keys=(), value=V):
    """Equality of variances: the one-way F of absolute deviations from the group mean.

    Judged on distinct values with their frequency, so the group means meet few rows.
    """
    by = [*keys, group]
    counts = df.where(col(value).isNotNull() & col(group).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    means = counts.groupBy(*by).agg((F.sum(col(value) * F.col("k")) / F.sum("k")).alias("gm"))
    dev = counts.join(means, by).withColumn("d", F.abs(col(value) - F.col("gm")))
    first = dev.groupBy(*by, "gm").agg(F.sum("k").alias("n"), (F.sum(F.col("d") * F.col("k")) / F.sum("k")).alias("m"))
    spread = dev.join(first.drop("gm"), by).groupBy(*by, "n", "m").agg(F.sum(F.col("k") * (F.col("d") - F.col("m")) ** 2).alias("ss"))
    g = spread.withColumn("v", F.coalesce(F.try_divide("ss", F.col("n") - 1), F.lit(0.0)))
    return anova_of_groups(g, keys)


def _ranked_groups(df, group, keys, value):
    """Rank sum and size per group with the key's total and tie term; ranks come from distinct values."""
    keys = list(keys)
    rows = df.where(col(value).isNotNull() & col(group).isNotNull())
    cells = rows.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("k"))
    values = cells.groupBy(*keys, value).agg(F.sum("k").alias("n"))
    placed = ordered.running_totals(values, keys, value, {"n": "before"}, ordered.value_block(value))
    placed = ordered.with_average_rank(placed).withColumnRenamed("before_all", "total")
    ties = placed.groupBy(*keys).agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"), F.max("total").alias("total"))
    sums = cells.join(placed.select(*keys, value, "avg_rank"), [*keys, value]).groupBy(*keys, group).agg(
        F.sum("k").alias("size"), F.sum(F.col("k") * F.col("avg_rank")).alias("rank_sum")
    )
    if keys:
        return sums.join(ties, keys)
    return sums.withColumns({c: ties.select(c).scalar() for c in ("ties", "total")})


def mann_whitney(df, group, first, second, keys=(), value=V):
    """U of the first group against the second, and the tie-corrected z with continuity correction."""
    ranked = _ranked_groups(df.where(col(group).isin(first, second)), group, keys, value)
    a, b = col(group) == first, col(group) == second
    out = ranked.groupBy(*keys).agg(
        F.max(F.when(a, F.col("size"))).alias("n1"), F.max(F.when(b, F.col("size"))).alias("n2"), F.max(F.when(a, F.col("rank_sum"))).alias("r1"), F.max("ties").alias("ties")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    out = out.withColumn("u", u)
    shift = F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)) * F.signum(F.col("u") - n1 * n2 / 2)
    return out.withColumn("z", F.try_divide(shift, sd)).drop("r1", "ties")


def kruskal_wallis(df, group, keys=(), value=V):
    """H over all groups with the tie correction."""
    ranked = _ranked_groups(df, group, keys, value)
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.max("total").alias("total"), F.max("ties").alias("ties"), F.sum(F.col("rank_sum") ** 2 / F.col("size")).alias("q")
    )
    n = F.col("total").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return out.withColumn("h", F.try_divide(h, 1 - F.col("ties") / (n * n * n - n))).drop("ties", "q")


def _correlation(n, sx, sy, sxx, syy, sxy):
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.try_divide(n * sxy - sx * sy, F.when(spread > 0, spread))


def spearman(pairs, x, y):
    """Rank correlation of two columns. Equal pairs are counted once before ranks are looked up."""
    counts = pairs.where(col(x).isNotNull() & col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))

    def ranks(c, name):
        values = counts.groupBy(c).agg(F.sum("w").alias("n"))
        placed = ordered.running_totals(values, [], c, {"n": "before"}, ordered.value_block(c))
        return ordered.with_average_rank(placed).select(c, F.col("avg_rank").alias(name))

    ranked = counts.join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y)
    w, rx, ry = F.col("w").cast("double"), F.col("_rx"), F.col("_ry")
    sums = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
        F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"),
    )
    rho = _correlation(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return sums.select(F.col("n").cast("long").alias("pairs"), rho.alias("rho"))


def chi_square(df, row, column, keys=()):
    """Association of two categories: chi-square, degrees of freedom and Cramer's V from the counts."""
    by = list(keys)
    cells = df.where(col(row).isNotNull() & col(column).isNotNull()).groupBy(*by, row, column).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*by, row).agg(F.sum("n").alias("r"))
    columns = cells.groupBy(*by, column).agg(F.sum("n").alias("c"))
    joined = cells.join(rows, [*by, row]).join(columns, [*by, column])
    # sum of (o-e)^2/e equals N * (sum of o^2/(r*c) - 1), so empty cells need no row
    out = joined.groupBy(*by).agg(
        F.sum("n").cast("double").alias("total"), F.countDistinct(row).alias("rows"), F.countDistinct(column).alias("columns"),
        F.sum(F.col("n").cast("double") ** 2 / (F.col("r").cast("double") * F.col("c"))).alias("q"),
    )
    chi = F.col("total") * (F.col("q") - 1)
    least = F.least(F.col("rows") - 1, F.col("columns") - 1)
    return out.select(
        *by, chi.alias("chi2"), ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("df"), F.sqrt(F.try_divide(F.greatest(chi, F.lit(0.0)), F.col("total") * least)).alias("cramers_v")
    )


def effect_size(df, group, first, second, keys=(), value=V):
    """Cohen's d with pooled deviation, its class, and the change of the mean in percent."""
    a, b = F.when(col(group) == first, col(value)), F.when(col(group) == second, col(value))
    g = df.where(col(group).isin(first, second)).groupBy(*keys).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2")
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    out = g.where("n1 > 1 and n2 > 1").withColumns({
        "d": F.try_divide(F.col("m2") - F.col("m1"), pooled), "change_pct": ratio(F.col("m2") - F.col("m1"), F.col("m1"), 100.0)
    })
    size = F.abs("d")
    label = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return out.select(*keys, "n1", "n2", "d", "change_pct", F.when(size.isNotNull(), label).alias("effect"))


def adjust_p_values(df, p="p_value"):
    """Bonferroni and false-discovery-rate adjusted values of a table of p values.

    The step-up rule takes the smallest p * N / rank among the larger p values; that minimum is
    carried over blocks of p, so no task holds the whole table.
    """
    dist = ordered.distribution(df.select(p), [], p, F.floor(col(p) * 100000).cast("int"))
    raw = dist.withColumn("_raw", col(p) * F.col("total") / (F.col("before") + F.col("n"))).withColumn("_b", F.floor(col(p) * 100000).cast("int"))
    later = Window.partitionBy().orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    edges = raw.groupBy("_b").agg(F.min("_raw").alias("_m")).select("_b", F.min("_m").over(later).alias("_later"))
    inside = Window.partitionBy("_b").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    found = raw.join(edges, "_b").withColumn("_q", F.least(F.min("_raw").over(inside), F.col("_later"), F.lit(1.0)))
    table = found.select(p, F.least(col(p) * F.col("total"), F.lit(1.0)).alias("bonferroni"), F.col("_q").alias("fdr"))
    return df.join(table, p)


def outlier_flag_association(df, keys=("VmvCode",), value=V, code="SUS"):
    """2x2 of interquartile outliers against rows whose qualifier names a code, with phi."""
    keys = list(keys)
    has = F.coalesce(col("MeasurementQualifier").contains(code), F.lit(False))
    counts = df.where(col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("f"))
    judged = counts.join(profile.outlier_bounds(df, keys, value, "iqr"), keys).withColumn("_o", profile.outlier_condition("iqr", value))
    out = judged.agg(
        F.sum(F.when(F.col("_o"), F.col("f")).otherwise(0)).alias("outlier_flagged"),
        F.sum(F.when(F.col("_o"), F.col("n") - F.col("f")).otherwise(0)).alias("outlier_only"),
        F.sum(F.when(~F.col("_o"), F.col("f")).otherwise(0)).alias("flagged_only"),
        F.sum(F.when(~F.col("_o"), F.col("n") - F.col("f")).otherwise(0)).alias("neither"),
    )
    a, b, c, d = (F.col(k).cast("double") for k in ("outlier_flagged", "outlier_only", "flagged_only", "neither"))
    spread = F.sqrt((a + b) * (c + d) * (a + c) * (b + d))
    return out.withColumn("phi", F.try_divide(a * d - b * c, F.when(spread > 0, spread)))


def cross_correlation(df, unit, category, categories=None, value=V):
    """Correlation of the unit means of every pair of categories, those of the data (a dictionary) unless listed.

    Each task folds its pivoted rows into one matrix of sums, so a task emits a matrix instead of
    the pairs of every unit, and the matrices are added up.
    """
    if categories is None:
        categories = sorted(r[0] for r in df.where(col(value).isNotNull() & col(category).isNotNull()).select(category).distinct().collect())
    names = [str(c) for c in categories]
    wide = df.where(col(value).isNotNull()).groupBy(unit).pivot(category, list(categories)).agg(F.avg(value)).drop(unit)

    def fold(batches):
        size = len(names)
        sums = np.zeros((6, size, size))
        for batch in batches:
            x = batch[names].to_numpy(dtype="float64")
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype("float64")
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(size, 1)
        cells = {k: sums[s][i, j] for s, k in enumerate(["n", "sx", "sy", "sxx", "syy", "sxy"])}
        yield pd.DataFrame({"a": [names[t] for t in i], "b": [names[t] for t in j], **cells})

    parts = wide.mapInPandas(fold, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    r = _correlation(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return total.select("a", "b", F.col("n").cast("long").alias("pairs"), r.alias("r"))


def pair_differences(df, unit, category, value=V):
    """Mean and deviation of (a - b) over units that have both, for every pair of categories in the data.

    A unit's means, at most one for each category of a dictionary, meet in one sorted array; pairs are taken inside it.
    """
    unit = [unit] if isinstance(unit, str) else list(unit)
    cells = df.where(col(value).isNotNull()).groupBy(*unit, category).agg(F.avg(value).alias("_m"))
    means = cells.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct(col(category).alias("c"), "_m"))).alias("_l")).where(F.size("_l") > 1)

    def later(x, i):
        return F.transform(F.slice("_l", i + 2, F.size("_l")), lambda y: F.struct(x["c"].cast("string").alias("a"), y["c"].cast("string").alias("b"), (x["_m"] - y["_m"]).alias("d")))

    pairs = means.select(F.explode(F.flatten(F.transform("_l", later))).alias("p")).select("p.*")
    return pairs.groupBy("a", "b").agg(F.count("d").alias("pairs"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"))
