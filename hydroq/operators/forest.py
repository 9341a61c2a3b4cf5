"""Outliers by isolation forests over single numeric columns.

A tree of one column cuts the number line into intervals, each with one path length, so a forest is a step function. The trees are
built side by side from small samples; they emit the places where the path length changes, and the sum over all trees up to a
value is a running total over values and places together. No forest is collected or broadcast, and each distinct value is scored once.
"""

import hashlib
import math

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroq.functions.values import col
from hydroq.operators import ordered
from hydroq.operators.profile import with_outlier_flag
from hydroq.sources.staging import stage

TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.05, 42
LEAST_ROWS = 10  # columns of so many numbers or fewer are judged by quartiles
EULER = 0.5772156649015329
STEPS = "column string, at double, delta double"


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` values, as a column."""
    n = n.cast("double")
    return F.when(n > 2, 2.0 * (F.ln(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n).when(n == 2, 1.0).otherwise(0.0)


def _average(n):
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n if n > 2 else float(n == 2)


def share_of(seed, column, tree, node):
    """Where a node splits between its least and its largest value: 12 hex digits of an MD5 digest as a fraction."""
    return int(hashlib.md5(f"{seed}:{column}:{tree}:{node}".encode()).hexdigest()[:12], 16) / 16.0 ** 12


def leaves_of(values, column, tree, seed=SEED):
    """(left end, path length) of the intervals of one tree over sorted ``values``; an interval holds its right end, not its left one."""
    limit = math.ceil(math.log2(max(len(values), 2)))
    out, todo = [], [(1, 0, 0, len(values), -math.inf)]
    while todo:
        node, depth, a, b, left = todo.pop()
        low, high = values[a], values[b - 1]
        if depth == limit or low == high:
            out.append((left, depth + _average(b - a)))
            continue
        split = low + share_of(seed, column, tree, node) * (high - low)
        split = low if split >= high else split
        cut = a
        while values[cut] <= split:
            cut += 1
        todo += [(2 * node + 1, depth + 1, cut, b, split), (2 * node, depth + 1, a, cut, left)]
    return out


def _steps(seed):
    def build(key, rows):
        column, tree = key
        out, before = [], 0.0
        for left, path in leaves_of(sorted(rows["value"].tolist()), column, tree, seed):
            out.append((column, left, path - before))
            before = path
        return pd.DataFrame(out, columns=["column", "at", "delta"])

    return build


def numbers_of(df, columns, key):
    """(column, value, key): the non-null numbers of the columns, one row each."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in columns]))
    return df.select(F.col(key).alias("key"), cells.alias("c")).select("key", "c.*").where("value is not null and not isnan(value)")


def forest_steps(numbers, trees=TREES, sample=SAMPLE, seed=SEED):
    """(column, at, delta): by how much the path length, summed over the trees of a column, grows right of ``at``.

    The sample is drawn in one pass: the rows with the smallest MD5 of their key, ``trees`` * ``sample`` of them at most. A tree takes the next
    ``sample`` of them in that order, starting again at the end, so that no tree holds a row twice.
    """
    # staged, so that the planner knows that a row per column is small and leaves the numbers where they are
    counts = stage(numbers.groupBy("column").agg(F.count(F.lit(1)).alias("rows")), "counts")
    digest = F.md5(F.col("key").cast("string").cast("binary"))
    # twice the rows wanted pass a threshold before the exact ranks are taken, so that tasks send few rows
    share = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / 16.0 ** 12
    drawn = numbers.join(counts, "column").where(share * F.col("rows") < 2.0 * trees * sample).withColumn("digest", digest)
    rank = Window.partitionBy("column").orderBy("digest", "value")
    pool = drawn.withColumn("rank", F.row_number().over(rank) - 1).where(F.col("rank") < trees * sample)
    places = counts.select("column", F.least("rows", F.lit(trees * sample)).alias("pool"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    places = places.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("pool", F.lit(sample)) - 1)))
    places = places.select("column", "tree", ((F.col("tree") * sample + F.col("i")) % F.col("pool")).cast("int").alias("rank"))
    return places.join(pool, ["column", "rank"]).select("column", "tree", "value").groupBy("column", "tree").applyInPandas(_steps(seed), STEPS)


def isolation_scores(numbers, trees=TREES, sample=SAMPLE, seed=SEED):
    """(column, value, n, rows, score) for every distinct value: n rows hold it; score is 2^(-mean path / expected path), near 1 for outliers."""
    values = numbers.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = forest_steps(numbers, trees, sample, seed).groupBy("column", F.col("at").alias("value")).agg(F.sum("delta").alias("delta"))
    # a value that is itself a split belongs to the interval on its left, so it comes before the step
    both = values.select("column", "value", "n", F.lit(0.0).alias("delta"), F.lit(0).alias("side")).unionByName(
        steps.select("column", "value", F.lit(0).cast("long").alias("n"), "delta", F.lit(1).alias("side")))
    both = both.withColumn("place", F.struct("value", "side"))
    totals = ordered.running_totals(both, ["column"], "place", {"delta": "path", "n": "before"}, ordered.value_block("value"))
    size = F.least(F.col("before_all"), F.lit(sample))
    mean = F.round(F.col("path") / trees, 7)  # the order of addition must not decide about equal scores
    score = F.pow(F.lit(2.0), -F.try_divide(mean, average_path(size)))
    return totals.where("side = 0").select("column", "value", "n", F.col("before_all").alias("rows"), score.alias("score"))


def isolation_outliers(df, columns, key="row_key", contamination=CONTAMINATION, trees=TREES, sample=SAMPLE, seed=SEED):
    """(column, value, n, score, is_outlier) for every distinct value of the numeric ``columns``.

    Outliers score above the (1 - ``contamination``) quantile of all rows' scores. Columns with ten numbers or fewer are judged by
    their quartiles and have no score; columns without numbers give no row.
    """
    numbers = numbers_of(df, columns, key)
    scored = stage(isolation_scores(numbers, trees, sample, seed), "scores")
    by_score = scored.groupBy("column", "score").agg(F.sum("n").alias("n"))
    placed = ordered.running_totals(by_score, ["column"], "score", {"n": "before"}, ordered.value_block("score")).withColumnRenamed("before_all", "total")
    cuts = stage(placed.groupBy("column").agg(*ordered.quantile_columns("score", {"cut": 1.0 - contamination})), "cuts")
    judged = scored.where(F.col("rows") > LEAST_ROWS).join(cuts, "column").select("column", "value", "n", "score", (F.col("score") > F.col("cut")).alias("is_outlier"))
    few = scored.where(F.col("rows") <= LEAST_ROWS).select("column", "value", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    few = with_outlier_flag(few, ["column"], "value").groupBy("column", "value", "is_outlier").agg(F.count(F.lit(1)).alias("n"))
    return judged.unionByName(few.select("column", "value", "n", F.lit(None).cast("double").alias("score"), "is_outlier"))
