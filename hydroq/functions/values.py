"""Small column expressions shared by all operators."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c):
    return c if isinstance(c, Column) else F.col(c)


def to_number(c):
    """Text to double; anything that is no number (also NaN) becomes null."""
    number = col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def ratio(a, b, scale=1.0):
    """a / b * scale as double, null when b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double")) * F.lit(float(scale))


def percent(a, b):
    return ratio(a, b, 100.0)


def percent_or_zero(a, b):
    return F.coalesce(percent(a, b), F.lit(0.0))


def count_where(condition):
    return F.count_if(condition)


def is_blank(c):
    return col(c).isNull() | (col(c) == "")


def contains_text(c, fragment):
    """Case-insensitive literal containment; null text counts as no match."""
    return F.coalesce(F.lower(col(c)).contains(fragment.lower()), F.lit(False))


def true_or_false(condition):
    return F.coalesce(condition, F.lit(False))


def none_of(c, codes):
    """NOT IN that keeps nulls."""
    return col(c).isNull() | ~col(c).isin(list(codes))


def ladder(value, steps, default):
    """First label whose lower bound is reached: steps = [(label, bound), ...] in falling order."""
    label, bound = steps[0]
    chain = F.when(col(value) >= bound, F.lit(label))
    for label, bound in steps[1:]:
        chain = chain.when(col(value) >= bound, F.lit(label))
    return chain.otherwise(F.lit(default))


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)


def days_between(later, earlier):
    """Whole elapsed days, rounded down (not the number of midnights between)."""
    return F.floor(seconds_between(later, earlier) / 86400)


def seconds_between(later, earlier):
    return F.unix_timestamp(col(later)) - F.unix_timestamp(col(earlier))


def first_value(c, order="row_key"):
    """Value of the first row in arrival order whose value is not null."""
    return F.min_by(col(c), F.when(col(c).isNotNull(), col(order)))


def first_row(c, order="row_key"):
    """Value of the first row in arrival order, null included."""
    return F.min_by(col(c), col(order))


# The rational approximation of the normal quantile, centre and tails, highest power first.
QUANTILE_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
QUANTILE_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
QUANTILE_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
QUANTILE_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def normal_quantile(p):
    """Quantile of the standard normal distribution as an expression (relative error about 1e-9)."""
    def power(coefficients, x):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    q = p - 0.5
    tail = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    outside = -F.signum(q) * power(QUANTILE_C, tail) / power(QUANTILE_D, tail)
    return F.when(F.abs(q) <= 0.47575, q * power(QUANTILE_A, q * q) / power(QUANTILE_B, q * q)).otherwise(outside)
