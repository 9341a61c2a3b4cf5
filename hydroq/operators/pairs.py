"""Sums of signs over the pairs inside of many bounded groups, counted side by side."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F


def sign_sums(starts, x, y, w):
    """For each group of rows the sum of w * w' * sign(x' - x) * sign(y' - y) over its pairs; equal x or equal y add nothing.

    ``starts`` are the first rows of the groups, which are sorted by ``y``; ``x`` holds numbers from 0 up. Two x first differ at exactly
    one binary digit. From the highest digit down, the right half of each block meets its left half in the order of y, then the block is
    dealt into its halves in that order.
    """
    n = len(x)
    at, out = np.arange(n), np.zeros(len(starts), dtype=np.int64)
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    for level in range(int(x.max()).bit_length() - 1, -1, -1):
        right = (x >> level) & 1
        opens = np.append(True, block[1:] != block[:-1])
        first = np.flatnonzero(opens)
        end, own = np.append(first[1:], n), np.cumsum(opens) - 1
        runs = opens | np.append(True, y[1:] != y[:-1])
        low = np.flatnonzero(runs)
        high, home = np.append(low[1:], n), own[low]
        left = np.append(0, np.cumsum(w * (1 - right)))
        below_less_above = left[low] - left[first[home]] - (left[end[home]] - left[high])
        out += np.add.reduceat(w * right * below_less_above[np.cumsum(runs) - 1], starts)
        lefts = np.append(0, np.cumsum(1 - right))
        before = lefts[:-1] - lefts[first][own]
        to = first[own] + np.where(right == 1, (lefts[end] - lefts[first])[own] + at - first[own] - before, before)
        dealt = []
        for column in (x, y, w, 2 * block + right):
            moved = np.empty_like(column)
            moved[to] = column
            dealt.append(moved)
        x, y, w, block = dealt
    return out


def _starts(rows, keys):
    """First rows of the groups of adjacent equal keys."""
    opens = np.zeros(rows.num_rows, dtype=bool)
    opens[0] = True
    for k in keys:
        column = rows.column(k).combine_chunks()
        opens[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(opens)


def _summed(rows, keys, starts):
    x, y, w = (rows.column(c).to_numpy().astype(np.int64) for c in ("_x", "_y", "_w"))
    out = rows.select(keys).take(pa.array(starts))
    return out.append_column("n", pa.array(np.add.reduceat(w, starts))).append_column("s", pa.array(sign_sums(starts, x, y, w))).to_batches()


def _over(keys):
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            starts = _starts(held, keys)
            if len(starts) > 1:  # the last group may go on in the next batch
                yield from _summed(held.slice(0, starts[-1]), keys, starts[:-1])
                held = held.slice(starts[-1])
        if held is not None:
            yield from _summed(held, keys, np.array([0]))

    return run


def group_sums(df, keys, x, value, weight):
    """(keys, n: rows by weight, s: sum of signs over the pairs) of groups that each fit one task; no key is null."""
    rows = df.select(*keys, value.alias("_v"), x.cast("long").alias("_x"), weight.cast("long").alias("_w"))
    rows = rows.withColumn("_y", F.rank().over(Window.partitionBy(*keys).orderBy("_v"))).sortWithinPartitions(*keys, "_v")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return rows.select(*keys, "_x", "_y", "_w").mapInArrow(_over(list(keys)), f"{kinds}, n long, s long")
