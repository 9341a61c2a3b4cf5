"""Statistics queries: normality, fits, trends, group comparisons, correlations."""

from pyspark.sql import functions as F

from hydroq.functions import tails
from hydroq.functions.values import is_blank
from hydroq.operators import profile, stats
from hydroq.plans import tail_sql
from hydroq.plans.catalog import obs, query
from hydroq.sources.test_tables import table

_Q = "MeasurementQualifier"
_V = "MeasurementValueNum"
_DIST = "num AS (SELECT VmvCode, MeasurementValueNum AS v FROM obs WHERE MeasurementValueNum IS NOT NULL)"


@query(
    "j04_normality_verdict",
    """WITH m AS (SELECT VmvCode, MeasurementValueNum v, avg(MeasurementValueNum) OVER (PARTITION BY VmvCode) mu FROM obs WHERE MeasurementValueNum IS NOT NULL),
    s AS (SELECT VmvCode, count(*) AS sample_size, avg((v-mu)**3)/avg((v-mu)**2)**1.5 AS skewness, avg((v-mu)**4)/avg((v-mu)**2)**2 - 3 AS kurtosis FROM m GROUP BY 1)
    SELECT *, abs(skewness) < 2 AND abs(kurtosis) < 3 AS is_likely_normal, NULL::VARCHAR AS error FROM s""",
    "skewness kurtosis",
)
def _(spark, sf):
    return stats.normality_verdict(obs(spark, sf, "VmvCode", _V))


@query(
    "j01_shapiro_wilk",
    f"""WITH r AS (SELECT VmvCode, MeasurementValueNum v, row_number() OVER (PARTITION BY VmvCode ORDER BY MeasurementValueNum) i, count(*) OVER (PARTITION BY VmvCode) n FROM obs WHERE MeasurementValueNum IS NOT NULL),
    m AS (SELECT *, {tail_sql.normal_quantile('(i - 0.375) / (n + 0.25)')} AS m FROM r),
    k AS (SELECT VmvCode, n, sum(m*m) mm, max(m) FILTER (i = n) m1, max(m) FILTER (i = n - 1) m2, 1/sqrt(n) u, avg(v) mean FROM m GROUP BY VmvCode, n),
    a AS (SELECT *, ((((-2.706056*u + 4.434685)*u - 2.07119)*u - 0.147981)*u + 0.221157)*u + m1/sqrt(mm) AS a1, ((((-3.582633*u + 5.682633)*u - 1.752461)*u - 0.293762)*u + 0.042981)*u + m2/sqrt(mm) AS a2 FROM k),
    w AS (SELECT m.VmvCode, m.n AS sample_size, sum(CASE WHEN i = m.n THEN a1 WHEN i = m.n - 1 THEN a2 WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 ELSE m / sqrt((mm - 2*m1*m1 - 2*m2*m2) / (1 - 2*a1*a1 - 2*a2*a2)) END * v)**2 / sum((v - mean)**2) AS statistic
      FROM m JOIN a USING (VmvCode) GROUP BY 1, 2),
    z AS (SELECT *, (ln(1 - statistic) - (((0.0038915*ln(sample_size) - 0.083751)*ln(sample_size) - 0.31082)*ln(sample_size) - 1.5861)) / exp((0.0030302*ln(sample_size) - 0.082676)*ln(sample_size) - 0.4803) AS z FROM w),
    p AS (SELECT VmvCode, sample_size, statistic, CASE WHEN sample_size <= 5000 THEN {tail_sql.normal_upper('z')} END AS p_value FROM z)
    SELECT *, p_value > 0.05 AS normal FROM p""",
    "statistic p_value",
)
def _(spark, sf):
    return stats.shapiro(obs(spark, sf, "VmvCode", _V))


_PLACED = f"""WITH num AS MATERIALIZED (SELECT VmvCode, MeasurementValueNum AS v FROM obs WHERE MeasurementValueNum IS NOT NULL),
    m AS (SELECT VmvCode, count(*) AS n, avg(v) AS mu, stddev_samp(v) AS sd FROM num GROUP BY 1 HAVING count(*) >= 3 AND stddev_samp(v) > 0),
    p AS MATERIALIZED (SELECT VmvCode, v, n, (v - mu) / sd AS z, row_number() OVER (PARTITION BY VmvCode ORDER BY v) AS i FROM num JOIN m USING (VmvCode)),
    c AS MATERIALIZED (SELECT *, {tail_sql.normal_cdf("z")} AS f FROM p)"""
_LEVELS = ", ".join(f"round({c} / (1 + 4.0::DOUBLE / n - 25.0::DOUBLE / n**2), 3) AS critical_{str(level).replace('.0', '').replace('.', '_')}pct" for level, c in stats.ANDERSON_CRITICAL.items())


@query(
    "j02_anderson_darling",
    _PLACED + f"""SELECT VmvCode, n AS sample_size, -n - sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(1 - f)) / n AS statistic, {_LEVELS} FROM c GROUP BY VmvCode, n""",
    {"statistic": 5},
)
def _(spark, sf):
    return stats.anderson_darling(obs(spark, sf, "VmvCode", _V))


@query(
    "j03_kolmogorov_smirnov",
    _PLACED + """, d AS (SELECT VmvCode, max(greatest(i / n - f, f - (i - 1) / n)) AS statistic, n AS sample_size FROM c GROUP BY VmvCode, n),
    x AS (SELECT *, (sqrt(sample_size) + 0.12 + 0.11 / sqrt(sample_size)) * statistic AS x FROM d),
    q AS (SELECT VmvCode, statistic, sample_size, CASE WHEN x < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * x * x))))) END AS p_value FROM x)
    SELECT *, p_value > 0.05 AS normal FROM q""",
    "statistic p_value",
)
def _(spark, sf):
    return stats.kolmogorov_smirnov(obs(spark, sf, "VmvCode", _V))


_FITS = ("normal", "lognormal", "exponential", "gamma", "weibull")


@query(
    "j05_distribution_fit",
    f"""WITH num AS MATERIALIZED (SELECT VmvCode, MeasurementValueNum AS v, CASE WHEN MeasurementValueNum > 0 THEN ln(MeasurementValueNum) END AS lv FROM obs WHERE MeasurementValueNum IS NOT NULL),
    m AS (SELECT VmvCode, count(*) AS n, avg(v) AS mu, stddev_pop(v) AS sd, min(v) AS low, avg(lv) AS lmu, stddev_pop(lv) AS lsd FROM num GROUP BY 1 HAVING count(*) >= 10 AND stddev_pop(v) > 0),
    g AS MATERIALIZED (SELECT *, CASE WHEN low > 0 THEN {tail_sql.gamma_shape("(ln(mu) - lmu)")} END AS k, CASE WHEN low > 0 THEN pi() / (sqrt(6) * lsd) END AS w FROM m),
    p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY VmvCode ORDER BY v) AS i FROM num JOIN g USING (VmvCode)),
    f AS MATERIALIZED (SELECT *, {tail_sql.normal_cdf("(v - mu) / sd")} AS normal, CASE WHEN low > 0 THEN {tail_sql.normal_cdf("(lv - lmu) / lsd")} END AS lognormal, 1 - exp(-(v - low) / (mu - low)) AS exponential,
      CASE WHEN low > 0 THEN {tail_sql.gamma_cdf("(v * k / mu)", "k")} END AS gamma, CASE WHEN low > 0 THEN 1 - exp(-pow(v / exp(lmu + 0.5772156649015329 / w), w)) END AS weibull FROM p),
    d AS (SELECT VmvCode, n AS sample_size, {", ".join(f"max(CASE WHEN {x} IS NOT NULL THEN greatest(i / n - {x}, {x} - (i - 1) / n) END) AS ks_{x}" for x in _FITS)} FROM f GROUP BY VmvCode, n)
    SELECT *, list_sort(list_filter([{", ".join(f"{{'d': ks_{x}, 'name': '{x}'}}" for x in _FITS)}], lambda x: x.d IS NOT NULL))[1].name AS best_fit FROM d""",
    {f"ks_{x}": 5 for x in _FITS},
)
def _(spark, sf):
    return stats.identify_distribution(obs(spark, sf, "VmvCode", _V))


_SERIES = ("StationNumber", "VmvCode", "SampleDateTime", "row_key", _V)


def _pairs_sql(keys):
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    k = ", ".join(keys)
    return f"""r AS (SELECT {k}, MeasurementValueNum v, row_number() OVER (PARTITION BY {k} ORDER BY SampleDateTime, row_key) i FROM obs WHERE MeasurementValueNum IS NOT NULL),
    n AS (SELECT {k}, count(*) AS n FROM r GROUP BY {k}), p AS (SELECT {', '.join('a.' + x for x in keys)}, sum(sign(b.v - a.v))::BIGINT AS s FROM r a JOIN r b ON {on} AND a.i < b.i GROUP BY ALL)"""


_MK = """, t AS (SELECT n.*, coalesce(p.s, 0) * {f} AS s FROM n LEFT JOIN p USING ({k}) WHERE n.n >= 3)
 SELECT {k}, n, s::BIGINT AS s, CASE WHEN s > 0 THEN (s-1)/sqrt(n*(n-1)*(2*n+5)/18.0) WHEN s < 0 THEN (s+1)/sqrt(n*(n-1)*(2*n+5)/18.0) ELSE 0 END::DOUBLE AS z FROM t"""


def _mk(name, keys, compat):
    @query(name, "WITH " + _pairs_sql(keys) + _MK.format(k=", ".join(keys), f=-1 if compat else 1), "z")
    def _(spark, sf):
        return stats.mann_kendall(obs(spark, sf, *dict.fromkeys((*keys, *_SERIES))), keys, compat=compat)


_mk("j06_mann_kendall", ["StationNumber", "VmvCode"], False)
_mk("j06_mann_kendall_by_variable", ["VmvCode"], False)
_mk("j06_mann_kendall_compat", ["VmvCode"], True)


@query(
    "j06_trend_verdict",
    "WITH " + _pairs_sql(["VmvCode"]) + ", mk AS (SELECT * FROM (WITH z0 AS (SELECT 1)" + _MK.format(k="VmvCode", f=1) + f""")), pv AS (SELECT *, {tail_sql.normal_two_sided('z')} AS p_value FROM mk)
    SELECT *, CASE WHEN p_value >= 0.05 THEN 'no_significant_trend' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS trend, p_value < 0.05 AS significant FROM pv""",
    "z p_value",
)
def _(spark, sf):
    return stats.with_trend_verdict(stats.mann_kendall(obs(spark, sf, *_SERIES), ["VmvCode"]))


@query(
    "j06_event_trend",
    """WITH r AS (SELECT user_id, value v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events WHERE value IS NOT NULL),
    n AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1), p AS (SELECT a.user_id, sum(sign(b.v - a.v))::BIGINT AS s FROM r a JOIN r b ON a.user_id = b.user_id AND a.i < b.i GROUP BY 1)
    SELECT n.user_id, n.n, s, CASE WHEN s > 0 THEN (s-1)/sqrt(n*(n-1)*(2*n+5)/18.0) WHEN s < 0 THEN (s+1)/sqrt(n*(n-1)*(2*n+5)/18.0) ELSE 0 END::DOUBLE AS z FROM n JOIN p USING (user_id) WHERE n >= 3""",
    "z",
    raw_sql=True,
)
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.col("ts").alias("SampleDateTime"), F.lpad(F.col("event_id").cast("string"), 18, "0").alias("row_key"), F.col("value").alias(_V))
    return stats.mann_kendall(events, ["user_id"])


_EVENT_STATS = "(SELECT event_type, avg(value) c, stddev_pop(value) s, quantile_cont(value,0.25) q1, quantile_cont(value,0.75) q3 FROM events GROUP BY 1)"


def _event_outliers(name, method, condition):
    @query(
        name,
        f"""SELECT event_type, count(*) FILTER ({condition}) AS outlier_count, count(value) AS numbers, 100.0*count(*) FILTER ({condition})/count(value) AS outlier_percent
        FROM events JOIN {_EVENT_STATS} USING (event_type) GROUP BY 1""",
        "outlier_percent",
        raw_sql=True,
    )
    def _(spark, sf):
        return profile.outlier_counts(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", method)


_event_outliers("f29_event_outliers", "zscore", "abs((value - c)/s) > 3")
_event_outliers("f30_event_outliers", "iqr", "value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1)")


@query(
    "f30_event_outlier_rows",
    f"SELECT event_id, event_type, value FROM events JOIN {_EVENT_STATS} USING (event_type) WHERE value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1)",
    raw_sql=True,
)
def _(spark, sf):
    rows = profile.with_outlier_flag(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return rows.where("is_outlier").drop("is_outlier")


@query(
    "f32_event_outlier_summary",
    " UNION ALL ".join(
        f"""SELECT "column", outlier_count, 100.0*outlier_count/f AS outlier_percent, method FROM (SELECT '{c}' AS "column", '{m}' AS method, count({c}) f, count(*) FILTER ({t}) AS outlier_count
        FROM (SELECT value, sqrt(value) AS root, user_id::DOUBLE AS user_id FROM events), (SELECT avg({c}) c, stddev_pop({c}) s, quantile_cont({c},0.25) q1, quantile_cont({c},0.75) q3 FROM
        (SELECT value, sqrt(value) AS root, user_id::DOUBLE AS user_id FROM events))) WHERE outlier_count > 0"""
        for c in ("value", "root", "user_id") for m, t in (("zscore", f"abs(({c} - c)/s) > 3"), ("iqr", f"{c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1)"))
    ),
    "outlier_percent",
    raw_sql=True,
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("value", F.sqrt("value").alias("root"), F.col("user_id").cast("double").alias("user_id"))
    return profile.outlier_summary(rows, ["value", "root", "user_id"])


@query(
    "j07_temporal_stability",
    """SELECT VmvCode, year(SampleDateTime)::INT AS year, count(MeasurementValueNum) AS count, avg(MeasurementValueNum) AS mean, stddev_samp(MeasurementValueNum) AS std, min(MeasurementValueNum) AS min,
    max(MeasurementValueNum) AS max FROM obs WHERE MeasurementValueNum IS NOT NULL GROUP BY 1,2""",
    "mean std",
)
def _(spark, sf):
    return stats.temporal_stability(obs(spark, sf, "VmvCode", "SampleDateTime", _V), ["VmvCode"])


@query(
    "j18_kendall_tau",
    "WITH " + _pairs_sql(["VmvCode"]) + """, t AS (SELECT VmvCode, sum(c*(c-1)/2.0) AS tied FROM (SELECT VmvCode, v, count(*) c FROM r GROUP BY 1,2) GROUP BY 1)
    SELECT VmvCode, n, s, s/sqrt((n*(n-1)/2.0)*(n*(n-1)/2.0 - tied)) AS tau FROM n JOIN p USING (VmvCode) JOIN t USING (VmvCode)""",
    "tau",
)
def _(spark, sf):
    return stats.kendall_tau(obs(spark, sf, *_SERIES), ["VmvCode"])


_PAIRED = """WITH c AS (SELECT VmvCode, StationNumber, month(SampleDateTime) m, avg(MeasurementValueNum) FILTER (year(SampleDateTime)=1997) a, avg(MeasurementValueNum) FILTER (year(SampleDateTime)=1999) b FROM obs GROUP BY 1,2,3)
 SELECT VmvCode, count(*) AS pairs, avg(b-a) AS mean_difference, stddev_samp(b-a) AS sd, avg(b-a)/(stddev_samp(b-a)/sqrt(count(*))) AS t FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1"""


@query("j15a_paired_t", _PAIRED, "mean_difference sd t", digits=6)
def _(spark, sf):
    return stats.paired_t(obs(spark, sf, "VmvCode", "StationNumber", "SampleDateTime", _V), 1997, 1999)


@query("j15a_paired_t_p", f"WITH pt AS ({_PAIRED}) SELECT *, {tail_sql.t_two_sided('t', '(pairs - 1)')} AS p_value FROM pt", "mean_difference sd t p_value", digits=6)
def _(spark, sf):
    out = stats.paired_t(obs(spark, sf, "VmvCode", "StationNumber", "SampleDateTime", _V), 1997, 1999)
    return out.withColumn("p_value", tails.t_two_sided_p("t", (F.col("pairs") - 1).cast("double")))


def _anova_sql(value, source, by=""):
    k = f"{by}, " if by else ""
    return f"""g AS (SELECT {k}grp, count(x) n, avg(x) m, var_samp(x) v FROM (SELECT {k}{value} AS x, grp FROM {source}) WHERE x IS NOT NULL GROUP BY {k}grp),
    o AS (SELECT {k}sum(n*m)/sum(n) AS grand, sum(n)::BIGINT AS total, count(*) AS groups FROM g {'GROUP BY ' + by if by else ''})
    SELECT {k}max(groups) AS groups, max(total) AS total, sum(n*(m-grand)**2) AS between, sum((n-1)*coalesce(v,0)) AS within,
    (sum(n*(m-grand)**2)/(max(groups)-1))/(sum((n-1)*coalesce(v,0))/(max(total)-max(groups))) AS f FROM g JOIN o {'USING (' + by + ')' if by else 'ON true'} {'GROUP BY ' + by if by else ''}"""


@query("j15b_anova", "WITH s AS (SELECT VmvCode, RiverBasinCode AS grp, MeasurementValueNum FROM obs), " + _anova_sql("MeasurementValueNum", "s", "VmvCode"), {"between": 1, "within": 1, "f": 7})
def _(spark, sf):
    return stats.one_way_anova(obs(spark, sf, "VmvCode", "RiverBasinCode", _V), "RiverBasinCode", ["VmvCode"])


@query("j15b_anova_overall", "WITH s AS (SELECT RiverBasinCode AS grp, MeasurementValueNum FROM obs), " + _anova_sql("MeasurementValueNum", "s"), {"between": 1, "within": -3, "f": 7})
def _(spark, sf):
    return stats.one_way_anova(obs(spark, sf, "RiverBasinCode", _V), "RiverBasinCode")


@query(
    "j15b_anova_p",
    "WITH an AS (WITH s AS (SELECT VmvCode, RiverBasinCode AS grp, MeasurementValueNum FROM obs), " + _anova_sql("MeasurementValueNum", "s", "VmvCode") + f") SELECT *, {tail_sql.f_upper('f', '(groups - 1)', '(total - groups)')} AS p_value FROM an",
    {"between": 1, "within": 1, "f": 7, "p_value": 6},
)
def _(spark, sf):
    out = stats.one_way_anova(obs(spark, sf, "VmvCode", "RiverBasinCode", _V), "RiverBasinCode", ["VmvCode"])
    d1, d2 = (F.col("groups") - 1).cast("double"), (F.col("total") - F.col("groups")).cast("double")
    return out.withColumn("p_value", tails.f_upper_p("f", d1, d2))


_TUKEY = """WITH g AS (SELECT VmvCode, RiverBasinCode AS grp, count(MeasurementValueNum) AS n, avg(MeasurementValueNum) AS m, coalesce(var_samp(MeasurementValueNum), 0) AS v FROM obs
      WHERE MeasurementValueNum IS NOT NULL AND RiverBasinCode IS NOT NULL GROUP BY 1, 2),
    o AS (SELECT VmvCode, count(*) AS groups, (sum(n) - count(*))::BIGINT AS df, sum((n - 1) * v) AS within FROM g GROUP BY 1),
    pq AS (SELECT VmvCode, a.grp AS first, b.grp AS second, b.m - a.m AS difference, abs(b.m - a.m) / nullif(sqrt(within / nullif(df, 0) / 2 * (1 / a.n + 1 / b.n)), 0) AS q, groups, df
      FROM g a JOIN g b USING (VmvCode) JOIN o USING (VmvCode) WHERE a.grp < b.grp), """


@query("j15b_tukey_pairs", _TUKEY + tail_sql.with_studentised_range("pq") + " SELECT pq.*, p_value FROM pq LEFT JOIN ranges USING (q, groups, df)", {"difference": 4, "q": 5, "p_value": 6})
def _(spark, sf):
    return stats.tukey_hsd(obs(spark, sf, "VmvCode", "RiverBasinCode", _V), "RiverBasinCode", ["VmvCode"])


_RANKS = """r AS (SELECT VmvCode, {g} AS grp, v, rank() OVER w + (count(*) OVER (PARTITION BY VmvCode, v) - 1)/2.0 AS rk, count(*) OVER (PARTITION BY VmvCode) AS total FROM
 (SELECT VmvCode, {g}, MeasurementValueNum v FROM obs WHERE MeasurementValueNum IS NOT NULL {f}) WINDOW w AS (PARTITION BY VmvCode ORDER BY v)),
 ti AS (SELECT VmvCode, sum(c::DOUBLE**3 - c) AS ties FROM (SELECT VmvCode, v, count(*) c FROM r GROUP BY 1,2) GROUP BY 1)"""


@query(
    "j15c_mann_whitney",
    "WITH " + _RANKS.format(g="LabCode", f="AND LabCode IN (10, 11)") + """, u AS (SELECT VmvCode, count(*) FILTER (grp=10) AS n1, count(*) FILTER (grp=11) AS n2, sum(rk) FILTER (grp=10) r1 FROM r GROUP BY 1),
    x AS (SELECT VmvCode, n1, n2, ties, r1 - n1*(n1+1)/2.0 AS u FROM u JOIN ti USING (VmvCode))
    SELECT VmvCode, n1, n2, u::DOUBLE AS u, greatest(abs(u - n1*n2/2.0) - 0.5, 0)*sign(u - n1*n2/2.0)/sqrt(n1*n2/12.0*(n1+n2+1-ties/((n1+n2)*(n1+n2-1.0)))) AS z FROM x""",
    "z",
)
def _(spark, sf):
    return stats.mann_whitney(obs(spark, sf, "VmvCode", "LabCode", _V), "LabCode", 10, 11, ["VmvCode"])


_KW = "WITH " + _RANKS.format(g="LabCode", f="") + """, q AS (SELECT VmvCode, count(*) AS groups, max(total) AS total, sum(rs**2/n) AS q FROM (SELECT VmvCode, grp, sum(rk) rs, count(*) n, max(total) total FROM r GROUP BY 1,2) GROUP BY 1)
 SELECT VmvCode, groups, total, (12.0/(total*(total+1.0))*q - 3*(total+1))/(1 - ties/(total::DOUBLE**3 - total)) AS h FROM q JOIN ti USING (VmvCode)"""


@query("j15d_kruskal_wallis", _KW, "h")
def _(spark, sf):
    return stats.kruskal_wallis(obs(spark, sf, "VmvCode", "LabCode", _V), "LabCode", ["VmvCode"])


@query("j15d_kruskal_wallis_p", f"WITH kw AS ({_KW}) SELECT *, {tail_sql.chi2_upper('h', '(groups - 1)')} AS p_value FROM kw", "h p_value")
def _(spark, sf):
    out = stats.kruskal_wallis(obs(spark, sf, "VmvCode", "LabCode", _V), "LabCode", ["VmvCode"])
    return out.withColumn("p_value", tails.chi2_upper_p("h", (F.col("groups") - 1).cast("double")))


_WIDE_SAMPLES = "(SELECT SampleNumber, avg(MeasurementValueNum) FILTER (VmvCode < 30) AS x, avg(MeasurementValueNum) FILTER (VmvCode >= 30) AS y FROM obs GROUP BY 1)"


@query(
    "j15e_spearman",
    f"""WITH p AS (SELECT round(x, 6) AS x, round(y, 6) AS y FROM {_WIDE_SAMPLES} WHERE x IS NOT NULL AND y IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2.0 AS ry FROM p)
    SELECT count(*) AS pairs, corr(rx, ry) AS rho FROM r""",
    "rho",
)
def _(spark, sf):
    rows = obs(spark, sf, "SampleNumber", "VmvCode", _V)
    v = F.col(_V)
    pairs = rows.groupBy("SampleNumber").agg(
        F.round(F.avg(F.when(F.col("VmvCode") < 30, v)), 6).alias("x"), F.round(F.avg(F.when(F.col("VmvCode") >= 30, v)), 6).alias("y")
    )
    return stats.spearman(pairs, "x", "y")


@query(
    "j16a_levene",
    """WITH s AS (SELECT VmvCode, RiverBasinCode AS grp, abs(MeasurementValueNum - avg(MeasurementValueNum) OVER (PARTITION BY VmvCode, RiverBasinCode)) AS d FROM obs WHERE MeasurementValueNum IS NOT NULL), """
    + _anova_sql("d", "s", "VmvCode"),
    {"between": 1, "within": 1, "f": 7},
)
def _(spark, sf):
    return stats.levene(obs(spark, sf, "VmvCode", "RiverBasinCode", _V), "RiverBasinCode", ["VmvCode"])


_CHI = """SELECT {k} sum(e.chi) AS chi2, ((max(nr)-1)*(max(nc)-1))::BIGINT AS df, sqrt(sum(e.chi)/(max(t)*least(max(nr)-1, max(nc)-1))) AS cramers_v FROM
 (SELECT {k} (coalesce(n,0) - r*c::DOUBLE/t)**2/(r*c::DOUBLE/t) AS chi, nr, nc, t FROM rr JOIN cc {u} JOIN tt {u} LEFT JOIN x USING ({j} row_, col_)) e {g}"""


_CHI_ALL = (
    f"""WITH x AS (SELECT LabCode AS row_, {_Q} AS col_, count(*) n FROM obs WHERE {_Q} IS NOT NULL GROUP BY 1,2), rr AS (SELECT row_, sum(n) r FROM x GROUP BY 1), cc AS (SELECT col_, sum(n) c FROM x GROUP BY 1),
    tt AS (SELECT sum(n) t, count(DISTINCT row_) nr, count(DISTINCT col_) nc FROM x) """ + _CHI.format(k="", u="ON true", j="", g="")
)


@query("j16b_chi_square", _CHI_ALL, "chi2 cramers_v")
def _(spark, sf):
    return stats.chi_square(obs(spark, sf, "LabCode", _Q), "LabCode", _Q)


@query("j16b_chi_square_p", f"WITH cs AS ({_CHI_ALL}) SELECT *, {tail_sql.chi2_upper('chi2', 'df')} AS p_value FROM cs", "chi2 cramers_v p_value")
def _(spark, sf):
    out = stats.chi_square(obs(spark, sf, "LabCode", _Q), "LabCode", _Q)
    return out.withColumn("p_value", tails.chi2_upper_p("chi2", F.col("df").cast("double")))


@query(
    "j17a_effect_size",
    """WITH g AS (SELECT VmvCode, count(MeasurementValueNum) FILTER (y=1996) n1, count(MeasurementValueNum) FILTER (y=2000) n2, avg(MeasurementValueNum) FILTER (y=1996) m1, avg(MeasurementValueNum) FILTER (y=2000) m2,
    var_samp(MeasurementValueNum) FILTER (y=1996) v1, var_samp(MeasurementValueNum) FILTER (y=2000) v2 FROM (SELECT *, year(SampleDateTime) y FROM obs) GROUP BY 1),
    d AS (SELECT VmvCode, n1, n2, (m2-m1)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)) AS d, 100.0*(m2-m1)/m1 AS change_pct FROM g)
    SELECT *, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d""",
    "d change_pct",
)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "SampleDateTime", _V).withColumn("y", F.year("SampleDateTime"))
    return stats.effect_size(rows, "y", 1996, 2000, ["VmvCode"])


_P_SQL = f"""x AS (SELECT VmvCode, LabCode % 3 AS row_, ({_Q} IS NULL OR {_Q} = '') AS col_, count(*) n FROM obs GROUP BY 1,2,3),
 e AS (SELECT VmvCode, sum(n) OVER (PARTITION BY VmvCode) t, n, sum(n) OVER (PARTITION BY VmvCode, row_) r, sum(n) OVER (PARTITION BY VmvCode, col_) c FROM x),
 p AS (SELECT VmvCode, round(exp(-(max(t)*(sum(n::DOUBLE**2/(r*c::DOUBLE)) - 1))/2), 6) AS p_value FROM e GROUP BY 1)"""


@query(
    "j17b_adjusted_p",
    f"""WITH {_P_SQL}, r AS (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS k FROM p)
    SELECT VmvCode, p_value, least(p_value*n, 1.0) AS bonferroni, least(min(p_value*n/k) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING), 1.0) AS fdr FROM r""",
    "bonferroni fdr",
)
def _(spark, sf):
    # two degrees of freedom, so the tail of chi-square is exp(-x/2)
    rows = obs(spark, sf, "VmvCode", "LabCode", _Q).select("VmvCode", (F.col("LabCode") % 3).alias("row"), is_blank(_Q).alias("clean"))
    tested = stats.chi_square(rows, "row", "clean", ["VmvCode"])
    return stats.adjust_p_values(tested.select("VmvCode", F.round(F.exp(-F.col("chi2") / 2), 6).alias("p_value")))


@query(
    "j25_outlier_flag_association",
    f"""WITH b AS (SELECT event_type AS k, value v, (user_id % 7 = 0) AS flag FROM events), q AS (SELECT k, quantile_cont(v,0.25) q1, quantile_cont(v,0.75) q3 FROM b GROUP BY 1),
    j AS (SELECT flag, (v < q1-1.5*(q3-q1) OR v > q3+1.5*(q3-q1)) o FROM b JOIN q USING (k)),
    s AS (SELECT count(*) FILTER (o AND flag) AS outlier_flagged, count(*) FILTER (o AND NOT flag) AS outlier_only, count(*) FILTER (NOT o AND flag) AS flagged_only, count(*) FILTER (NOT o AND NOT flag) AS neither FROM j)
    SELECT *, (outlier_flagged*neither - outlier_only*flagged_only)/nullif(sqrt((outlier_flagged+outlier_only)::DOUBLE*(flagged_only+neither)*(outlier_flagged+flagged_only)*(outlier_only+neither)), 0) AS phi FROM s""",
    "phi",
    raw_sql=True,
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("value").alias(_V), F.when(F.col("user_id") % 7 == 0, "SUS").alias(_Q))
    return stats.outlier_flag_association(rows, ["event_type"])


@query(
    "j30_cross_correlation",
    """WITH m AS (SELECT StationNumber, VmvCode, avg(MeasurementValueNum) v FROM obs WHERE MeasurementValueNum IS NOT NULL GROUP BY 1,2)
    SELECT CAST(a.VmvCode AS VARCHAR) AS a, CAST(b.VmvCode AS VARCHAR) AS b, count(*) AS pairs, corr(a.v, b.v) AS r FROM m a JOIN m b ON a.StationNumber = b.StationNumber AND a.VmvCode < b.VmvCode GROUP BY 1,2""",
    "r",
    digits=6,
)
def _(spark, sf):
    return stats.cross_correlation(obs(spark, sf, "StationNumber", "VmvCode", _V), "StationNumber", "VmvCode")


_DIFF = """WITH m AS (SELECT VmvCode, CAST(SampleDateTime AS DATE) d, {c} AS g, avg(MeasurementValueNum) v FROM obs WHERE MeasurementValueNum IS NOT NULL {f} GROUP BY 1,2,3)
 SELECT CAST(a.g AS VARCHAR) AS a, CAST(b.g AS VARCHAR) AS b, count(*) AS pairs, avg(a.v-b.v) AS bias, stddev_samp(a.v-b.v) AS sd FROM m a JOIN m b ON a.VmvCode=b.VmvCode AND a.d=b.d AND a.g < b.g GROUP BY 1,2"""


@query("d11_lab_differences", _DIFF.format(c="LabCode", f=""), "bias sd", digits=6)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "SampleDateTime", "LabCode", _V).withColumn("day", F.to_date("SampleDateTime"))
    return stats.pair_differences(rows, ["VmvCode", "day"], "LabCode")


@query("j24e_method_differences", _DIFF.format(c="MethodCode", f="").replace("VmvCode", "StationNumber"), "bias sd", digits=6)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "SampleDateTime", "MethodCode", _V).withColumn("day", F.to_date("SampleDateTime"))
    return stats.pair_differences(rows, ["StationNumber", "day"], "MethodCode")
