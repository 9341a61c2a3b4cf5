"""Tail probabilities as oracle text: integrals by Simpson's rule, independent of the library's series and fractions."""

from hydroq.functions import values

NODES = 4000


def _simpson(term, high, nodes=NODES):
    """Integral from 0 to ``high`` of ``term``, a text with {x}."""
    at = term.format(x=f"(({high}) * i / {nodes}.0)")
    weight = f"(CASE WHEN i = 0 OR i = {nodes} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(({high}) / {nodes}.0 / 3 * list_sum(list_transform(range(0, {nodes + 1}), lambda i: {weight} * {at})))"


def chi2_upper(x, df):
    """Upper tail of chi-square; with t = s^2 the integrand is smooth at 0."""
    term = f"(CASE WHEN {{x}} = 0 THEN (CASE WHEN {df} = 1 THEN exp(-lgamma(0.5)) ELSE 0 END) ELSE exp(({df} - 1) * ln({{x}}) - {{x}} * {{x}} - lgamma({df} / 2.0)) END)"
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0.0, 1 - 2 * {_simpson(term, f'sqrt(least({x}, 1000.0) / 2.0)')}) END)"


def f_upper(f, d1, d2):
    """Upper tail of F; with x = sin^2 the beta integrand is smooth at both ends."""
    log_beta = f"(lgamma({d1} / 2.0) + lgamma({d2} / 2.0) - lgamma(({d1} + {d2}) / 2.0))"
    term = f"(CASE WHEN sin({{x}}) <= 0 THEN (CASE WHEN {d1} = 1 THEN exp(-{log_beta}) ELSE 0 END) WHEN cos({{x}}) <= 0 THEN 0 ELSE exp(({d1} - 1) * ln(sin({{x}})) + ({d2} - 1) * ln(cos({{x}})) - {log_beta}) END)"
    return f"(CASE WHEN ({f}) IS NOT NULL THEN greatest(0.0, 1 - 2 * {_simpson(term, f'asin(sqrt({d1} * ({f}) / ({d1} * ({f}) + {d2})))')}) END)"


def t_two_sided(t, df):
    return f_upper(f"({t}) * ({t})", 1, df)


def normal_two_sided(z):
    return chi2_upper(f"(({z}) * ({z}))", 1)


def normal_quantile(p):
    """The rational approximation with the fixed values of ``functions.values``."""
    def power(coefficients, x):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    q, tail = f"(({p}) - 0.5)", f"sqrt(-2.0 * ln(least({p}, 1.0 - ({p}))))"
    inside = f"{q} * {power(values.QUANTILE_A, f'({q} * {q})')} / {power(values.QUANTILE_B, f'({q} * {q})')}"
    outside = f"-sign({q}) * {power(values.QUANTILE_C, tail)} / {power(values.QUANTILE_D, tail)}"
    return f"(CASE WHEN abs({q}) <= 0.47575 THEN {inside} ELSE {outside} END)"


def normal_upper(z):
    return f"(CASE WHEN {z} > 0 THEN 0.5 * {normal_two_sided(z)} ELSE 1 - 0.5 * {normal_two_sided(z)} END)"


def normal_cdf(z):
    """Distribution function of many values: fewer nodes than the finished statistics get."""
    half = _simpson(f"(exp(-0.5 * {{x}} * {{x}}) / {(2 * 3.141592653589793) ** 0.5!r})", f"abs({z})", 400)
    return f"(0.5 + sign({z}) * {half})"


def gamma_cdf(x, shape):
    """Distribution function of the gamma law of scale 1; with t = s^2 the integrand is smooth at 0."""
    term = f"(CASE WHEN {{x}} = 0 THEN 0 ELSE 2 * exp((2 * {shape} - 1) * ln({{x}}) - {{x}} * {{x}} - lgamma({shape})) END)"
    return _simpson(term, f"sqrt({x})", 400)


def digamma(k):
    """Ten steps up, then the asymptotic series."""
    up = f"({k} + 10)"
    return f"(ln({up}) - 0.5 / {up} - 1 / (12 * {up} ** 2) + 1 / (120 * {up} ** 4) - 1 / (252 * {up} ** 6) - list_sum(list_transform(range(10), lambda j: 1 / ({k} + j))))"


def gamma_shape(gap):
    """Root of ln(k) - digamma(k) = gap by halving the range of ln(k)."""
    step = f"(CASE WHEN (r.low + r.high) / 2 - {digamma('exp((r.low + r.high) / 2)')} > {gap} THEN {{'low': (r.low + r.high) / 2, 'high': r.high}} ELSE {{'low': r.low, 'high': (r.low + r.high) / 2}} END)"
    return f"exp(list_reduce(list_transform(range(60), lambda i: {{'low': -20.0::DOUBLE, 'high': 20.0::DOUBLE}}), lambda r, i: {step}, {{'low': -20.0::DOUBLE, 'high': 20.0::DOUBLE}}).low)"


# Hart's rational approximation of the normal tail, highest power first.
HART_ABOVE = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BELOW = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def quick_normal_cdf(x):
    """Distribution function of very many values, to 15 digits; ``x`` is the name of a column."""
    def power(coefficients):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * abs({x}) + {c!r})"
        return out

    tail = f"(CASE WHEN abs({x}) > 7 THEN 0 ELSE exp(-0.5 * {x} * {x}) * {power(HART_ABOVE)} / {power(HART_BELOW)} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def with_studentised_range(source):
    """WITH entries that end in ``ranges`` (q, groups, df, p_value) for the different rows of ``source`` (q, groups, df).

    Both integrands fade out at their ends (the spread is taken by its logarithm), where equal weights are far more exact than Simpson's.
    """
    return f"""rq AS (SELECT DISTINCT q, groups, df FROM {source} WHERE q IS NOT NULL),
    rz AS (SELECT z, {quick_normal_cdf('z')} AS below, exp(-0.5 * z * z) / sqrt(2 * pi()) / 6.0 AS mass FROM (SELECT -8 + j / 6.0 AS z FROM range(97) t(j))),
    rs AS (SELECT q, groups, df, exp(u) AS s, exp(df * u - df * (exp(2 * u) - 1) / 2) AS density FROM (SELECT q, groups, df, high - (low + high) * i / steps AS u FROM
      (SELECT *, unnest(range(0, steps + 1)) AS i FROM (SELECT *, greatest(8 / sqrt(2.0 * df), 37.0 / df) AS low, 8 / sqrt(2.0 * df) AS high, CASE WHEN df < 20 THEN 400 ELSE 48 END AS steps FROM rq WHERE df > 0))) ),
    ri AS (SELECT q, groups, df, s, density, groups * sum(mass * pow(greatest(below - {quick_normal_cdf('x')}, 0), groups - 1)) AS inside FROM (SELECT rs.*, below, mass, z - q * s AS x FROM rs, rz) GROUP BY q, groups, df, s, density),
    ranges AS (SELECT q, groups, df, greatest(0.0, least(1.0, sum(density * (1 - inside)) / sum(density))) AS p_value FROM ri GROUP BY q, groups, df)"""
