"""Unit conversion, ingest flags and comment words."""

from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions.values import any_of, col, true_or_false
from hydroq.operators import dimensions, ordered


def standardize_units(df, target, value="MeasurementValueNum", unit="UnitCode"):
    """Convert what the fixed table can convert into ``target``; keep the original columns."""
    factor = F.lit(1.0)
    offset = F.lit(0.0)
    convertible = F.lit(False)
    for source, into, scale, shift in S.UNIT_CONVERSIONS:
        if into == target:
            hit = true_or_false(col(unit) == source)
            factor = F.when(hit, F.lit(scale)).otherwise(factor)
            offset = F.when(hit, F.lit(shift)).otherwise(offset)
            convertible = convertible | hit
    return df.withColumns({
        "ValueStandardized": F.when(convertible, col(value) * factor + offset).otherwise(col(value)),
        "UnitStandardized": F.when(convertible, F.lit(target)).otherwise(col(unit)),
        "ConversionApplied": convertible,
    })


def apply_unit_strategy(df, strategy, target="mg/L"):
    """'separate' keeps rows as they are, 'convert' standardises, 'exclude' keeps each code's main unit."""
    if strategy == "separate":
        return df
    if strategy == "convert":
        return standardize_units(df, target)
    if strategy == "exclude":
        main = dimensions.active_unit(df, ["VmvCode"])
        return df.join(main, ["VmvCode", "UnitCode"], "left_semi")
    raise ValueError(f"unknown unit strategy: {strategy}")


def with_ingest_flags(df, bad_units, bounds=S.INGEST_BOUNDS, required=("StationNumber", "SampleDateTime", "VariableName")):
    """S1 unit in the bad list, M2 outside the exact-name bounds, C2 a required field is null."""
    v, name = col("MeasurementValueNum"), col("VariableName")
    outside = any_of([(name == n) & ((v < low) | (v > high)) for n, low, high in bounds])
    return df.withColumns({
        "QA_S1": true_or_false(col("UnitCode").isin(list(bad_units))),
        "QA_M2": true_or_false(outside),
        "QA_C2": any_of([col(c).isNull() for c in required]),
    })


def comment_words(df, code, comment, k):
    """The k most frequent words of a comment per code. Texts repeat, so equal ones are counted first."""
    texts = df.where(col(code).isNotNull() & col(comment).isNotNull()).groupBy(code, comment).agg(F.count(F.lit(1)).alias("n"))
    words = texts.select(col(code).alias("code"), F.explode(F.split(F.lower(col(comment)), "\\W+")).alias("word"), "n").where("word <> ''")
    counts = words.groupBy("code", "word").agg(F.sum("n").alias("n"))
    return ordered.top_k(counts, ["code"], [F.desc("n"), F.asc("word")], k)

