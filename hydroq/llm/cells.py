"""Comparison of the rows that share a cell, with large cells cut into bounded blocks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hydroq.llm.common import partitions, stage

PAIRS_AT_ONCE = 1 << 20


def in_blocks(rows, tag, most=1024):
    """Add ``part``, ``as_left`` and ``as_right`` to ``rows`` (cell, node, ...), and deal them out by (cell, part).

    A cell of more than ``most`` rows is cut into k lanes by a hash of the node; block (i, j) holds lane i as
    left rows and lane j as right rows, so that every pair meets in exactly one block and no block has
    more than about 2 ``most`` rows. Cell sizes are counted with map-side combine.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("cell").count().where(F.col("count") > most)
    hot = stage(sizes.select("cell", F.ceil(F.col("count") / most).cast("int").alias("k")), f"hot-{tag}")
    lane = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    whole = F.expr("array(named_struct('part', 0, 'as_left', true, 'as_right', true))")
    lanes = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct((lane * F.col("k") + j).alias("part"), F.lit(True).alias("as_left"), (j == lane).alias("as_right"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda i: i != lane), lambda i: F.struct((i * F.col("k") + lane).alias("part"), F.lit(False).alias("as_left"), F.lit(True).alias("as_right"))),
    )
    dealt = rows.join(hot, "cell", "left").withColumn("block", F.explode(F.when(F.col("k").isNull(), whole).otherwise(lanes)))
    dealt = dealt.select(*rows.columns, "block.part", "block.as_left", "block.as_right").where("as_right or primary")
    return dealt.repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part")


def blocks_of(batches):
    """Tables of whole blocks from batches sorted by (cell, part); at most one block and one batch are held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cell, part = held["cell"].to_numpy(), held["part"].to_numpy()
        same = (cell == cell[-1]) & (part == part[-1])
        cut = len(cell) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def pairs_of(table):
    """(left, right) row numbers of the pairs that meet, a bounded number at once: left rows are primary rows."""
    cell, part = table["cell"].to_numpy(), table["part"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.r_[starts, len(cell)])
    group = np.repeat(np.arange(len(starts)), sizes)
    left = np.flatnonzero(table["primary"].to_numpy(zero_copy_only=False) & table["as_left"].to_numpy(zero_copy_only=False))
    right_ok = table["as_right"].to_numpy(zero_copy_only=False)
    left = left[sizes[group[left]] > 1]
    weight = np.cumsum(sizes[group[left]])
    at = 0
    while at < len(left):
        done = weight[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(weight, done + PAIRS_AT_ONCE, "right")))
        own = left[at:end]
        count = sizes[group[own]]
        i = np.repeat(own, count)
        first = np.repeat(np.cumsum(count) - count, count)
        j = np.repeat(starts[group[own]], count) + np.arange(len(i)) - first
        keep = (i != j) & right_ok[j]
        yield i[keep], j[keep]
        at = end


def local_roots(n, i, j):
    """The smallest row number joined to each of ``n`` rows by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low
