"""Order statistics, previous-row and pair-count operators that never gather a whole key in one task.

A key (station, variable, ...) may hold a large part of all rows. Every function here therefore
first collapses equal rows by a partial aggregate and then splits a key into order-preserving
blocks. Only one summary row per block crosses the key, so a window never covers more than the
distinct entries of one block or the blocks of one key.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroq.functions.values import col
from hydroq.operators import pairs
from hydroq.sources.staging import stage

_BLOCK = "_block"
BLOCKS_PER_LOG = 256
PAIR_ROWS = 65536  # rows of a series whose pairs one task counts at a time


def value_block(c):
    """Order-preserving block number of a double: sign and logarithm, at most some 360,000 blocks."""
    v = col(c)
    return (F.signum(v) * F.floor(F.least(F.log1p(F.abs(v)), F.lit(710.0)) * BLOCKS_PER_LOG)).cast("int")


def month_block(c):
    """Order-preserving block number of a timestamp or date."""
    return F.year(col(c)) * 12 + F.month(col(c))


def _blocked(df, keys, block):
    """The frame with its block, rows with a null key left out.

    A join on keys and block implies null checks on one side only. A block that cannot be null and
    key checks on the shared input keep both sides equal, so the planner reuses one shuffle for both.
    """
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    return df.dropna(subset=list(keys)).withColumn(_BLOCK, F.coalesce(block.cast("bigint"), F.lit(0).cast("bigint"))), list(keys)


def day_block(c):
    """Order-preserving block number of a timestamp: its day."""
    return F.unix_date(F.to_date(col(c)))


def running_totals(df, keys, order, sums, block, equals=False):
    """Add to each row of a frame with unique (keys, order) the totals of all earlier rows.

    ``sums`` maps a numeric column to the name of its exclusive running total; ``<name>_all``
    holds the total of the key. ``block`` is an order-preserving column expression. With ``equals``
    the order may repeat, and the totals take in the row itself and all rows of its order.
    """
    df, keys_ = _blocked(df, keys, block)
    per_block = df.groupBy(*keys_, _BLOCK).agg(*[F.sum(s).alias(f"_b_{n}") for s, n in sums.items()])
    before = Window.partitionBy(*keys_).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys_)
    offsets = per_block.select(
        *keys_,
        _BLOCK,
        *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums.values()],
        *[F.sum(f"_b_{n}").over(whole).alias(f"{n}_all") for n in sums.values()],
    )
    inside = Window.partitionBy(*keys_, _BLOCK).orderBy(order)
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow) if equals else inside.rowsBetween(Window.unboundedPreceding, -1)
    # a merge join shares its partitioning with the window below and may spill on both sides
    joined = df.join(offsets.hint("merge"), [*keys_, _BLOCK])
    for s, n in sums.items():
        joined = joined.withColumn(n, F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_o_{n}"))
    return joined.drop(_BLOCK, "_all", *[f"_o_{n}" for n in sums.values()])


def distribution(df, keys, value, block=None):
    """Distinct values of each key with their frequency and position.

    Columns: keys, value, ``n`` (rows with this value), ``before`` (rows with a smaller value),
    ``rank`` (distinct smaller values), ``total`` (rows of the key) and ``distinct`` (its values).
    Null values are left out.
    """
    counts = (
        df.where(col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_one", F.lit(1).cast("long"))
    )
    placed = running_totals(counts, keys, value, {"n": "before", "_one": "rank"}, block if block is not None else value_block(value))
    return placed.withColumnsRenamed({"before_all": "total", "rank_all": "distinct"}).drop("_one")


def quantile_columns(value, probs):
    """Aggregates over a ``distribution`` frame: {name: probability or column} with linear interpolation."""
    out = []
    for name, p in probs.items():
        spot = (F.col("total") - 1) * (F.lit(float(p)) if isinstance(p, (int, float)) else p)
        low, high = F.floor(spot), F.ceil(spot)

        def at(i):
            return F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), col(value)))

        weight = F.max(spot - low)
        out.append((at(low) + (at(high) - at(low)) * weight).alias(name))
    return out


def quantiles(df, keys, value, probs):
    """Exact interpolated quantiles per key, one row per key."""
    dist = distribution(df.select(*keys, value), keys, value)
    return dist.groupBy(*keys).agg(*quantile_columns(value, probs))


def moments(value="MeasurementValueNum", weight="n"):
    """Count, mean, min and max over a ``distribution`` frame."""
    v, n = col(value), col(weight)
    return {
        "count": F.sum(n),
        "mean": F.sum(v * n) / F.sum(n),
        "min": F.min(v),
        "max": F.max(v),
    }


def with_average_rank(dist):
    """Mid-rank (1-based) of every distinct value; ties share it."""
    return dist.withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2.0)


def with_position(df, keys, order, block, name="position"):
    """0-based position of each row inside its key; (keys, order) must be unique."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(one, keys, order, {"_one": name}, block).drop("_one", f"{name}_all")


def with_previous(df, keys, order, carry, block, rows=None):
    """Previous row's values in key order: ``carry`` maps a column to the name of its lagged copy.

    (keys, order) must be unique. Inside a block a window looks back one row; the first row of a
    block takes the last row of the block before it, which one summary row per block carries over.
    ``rows`` are the same rows before they were widened: the summaries then come from an aggregate
    over them, as a second shuffle of the wide rows would carry other columns and not be reused.
    """
    df, keys_ = _blocked(df, keys, block)
    bundle = F.struct(*[F.col(c).alias(n) for c, n in carry.items()])
    inside = Window.partitionBy(*keys_, _BLOCK).orderBy(order)
    across = Window.partitionBy(*keys_).orderBy(_BLOCK)
    looked = df.withColumns({"_prev": F.lag(bundle).over(inside)} | ({"_next": F.lead(F.lit(1)).over(inside)} if rows is None else {}))
    if rows is None:
        # the last row of each block comes out of the same shuffle and sort
        last = looked.where(F.col("_next").isNull()).select(*keys_, _BLOCK, bundle.alias("_last"))
    else:
        last = _last_of_blocks(_blocked(rows, keys, block)[0], keys_, order, carry)
    edges = last.select(*keys_, _BLOCK, F.lag("_last").over(across).alias("_edge"))
    joined = looked.join(edges.hint("merge"), [*keys_, _BLOCK])
    for n in carry.values():
        joined = joined.withColumn(n, F.coalesce(F.col("_prev")[n], F.col("_edge")[n]))
    return joined.drop(_BLOCK, "_all", "_prev", "_next", "_edge")


def _last_of_blocks(rows, keys, order, carry):
    """The carried values of the last row of each block; a null order comes first, so it only counts where there is no other."""
    last = {n: F.when(F.count(order) > 0, F.max_by(c, order)).otherwise(F.last(c)) for c, n in carry.items()}
    found = rows.groupBy(*keys, _BLOCK).agg(*[value.alias(n) for n, value in last.items()])
    return found.select(*keys, _BLOCK, F.struct(*last).alias("_last"))


def group_with_first(df, keys, first, counts=None, sums=None, row=False, order="row_key"):
    """One row per key: the first value of each ``first`` column in arrival order, with counts and sums.

    The first stage groups by the attributes themselves, so its buffers are numbers and it hashes
    instead of sorting the fact rows; the second stage sees one row per distinct combination.
    ``row`` takes the first row as it is, otherwise each column skips nulls.
    """
    counts, sums = counts or {}, sums or {}
    parts = df.groupBy(*keys, *first).agg(
        F.min(order).alias("_k"), *[F.count(e).alias(n) for n, e in counts.items()], *[F.sum(e).alias(n) for n, e in sums.items()]
    )
    picks = [F.min_by(c, F.col("_k") if row else F.when(col(c).isNotNull(), F.col("_k"))).alias(c) for c in first]
    return parts.groupBy(*keys).agg(*picks, *[F.sum(n).alias(n) for n in (*counts, *sums)])


def top_k(df, keys, order, k):
    """First k rows per key. The planner also applies the rank limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def pair_sign_sum(df, keys, order, value, block, size=PAIR_ROWS):
    """Sum of sign(later value - earlier value) over all row pairs of a series, without making pairs.

    Returns keys, ``n`` and ``s`` for series of two rows or more. A series of up to ``size`` rows is counted in one task, side by side
    with others. A longer one is cut into stretches of ``size`` rows by position and into ranges of about ``size`` rows by value. A pair
    lies in one stretch, or in one range of different stretches, or differs in both; the last kind needs only the rows per stretch and range.
    """
    keys_ = list(keys) or ["_whole"]
    rows = df if keys else df.withColumn("_whole", F.lit(0))
    rows = rows.dropna(subset=keys_).select(*keys_, F.col(order).alias("_order"), col(value).alias("_v"), block.alias("_day"))
    # at most one row per ``size`` fact rows
    long = stage(rows.groupBy(*keys_).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select(*keys_), "long-series")
    one = F.lit(1)
    short = rows.join(long, keys_, "left_anti").withColumn("_at", F.row_number().over(Window.partitionBy(*keys_).orderBy("_order")) - 1)
    out = pairs.group_sums(short, keys_, F.col("_at"), F.col("_v"), one)
    if not long.isEmpty():
        out = out.unionByName(_pair_sums_of_long(rows.join(long, keys_), keys_, size))
    return out.where("n > 1").select(*keys, "n", "s")


def _pair_sums_of_long(rows, keys, size):
    placed = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), keys, "_order", {"_one": "_at"}, F.col("_day"))
    # staged, as rows of equal order must keep the place they got
    placed = stage(placed.select(*keys, F.expr(f"_at div {size}").alias("_stretch"), F.expr(f"_at % {size}").alias("_at"), "_v"), "placed")
    near = pairs.group_sums(placed, [*keys, "_stretch"], F.col("_at"), F.col("_v"), F.lit(1))
    # equal values share a range, a frequent one takes one cell per stretch
    cells = placed.groupBy(*keys, "_stretch", "_v").agg(F.count(F.lit(1)).alias("_w"))
    ranged = running_totals(cells, keys, "_v", {"_w": "_upto"}, value_block("_v"), equals=True)
    ranged = ranged.select(*keys, "_stretch", "_v", "_w", F.expr(f"(_upto - 1) div {size}").alias("_range"), F.expr(f"(_upto_all - 1) div {size} + 1").alias("_stretches"))
    alike = pairs.group_sums(ranged, [*keys, "_range"], F.col("_stretch"), F.col("_v"), F.col("_w"))
    coarse = ranged.groupBy(*keys, "_stretches", "_stretch", "_range").agg(F.sum("_w").alias("_w"))
    apart = long_pair_sign_sum(coarse, keys, "_stretch", "_range", "_stretches", F.col("_w"))
    none = F.lit(0).cast("long").alias("n")
    parts = near.select(*keys, "n", "s").unionByName(alike.select(*keys, none, "s")).unionByName(apart.select(*keys, none, "s"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def long_pair_sign_sum(df, keys, position, value, size="n", weight=None):
    """The pair sum for series of any length from their positions 0..n-1 and their ``size``; a row counts ``weight`` times.

    Two positions first differ at exactly one binary digit; at that digit's level they sit in the
    left and the right half of one block. So each row enters one block per level, and a block
    compares its halves by running totals in value order: n log n rows instead of n squared.
    """
    levels = df.select(
        *keys,
        F.col(size).alias("n"),
        F.col(value).alias("_v"),
        F.col(position).alias("_p"),
        (F.lit(1) if weight is None else weight).cast("long").alias("_c"),
        F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col(size) - 1)) - 1)).alias("_level"),
    )
    block_no = F.expr("shiftright(_p, _level + 1)")
    right = F.expr("shiftright(_p, _level) & 1")
    cells = (
        levels.withColumns({"_half": block_no, "_right": right})
        .groupBy(*keys, "n", "_level", "_half", "_v")
        .agg(F.sum(F.col("_c") * (1 - F.col("_right"))).alias("_l"), F.sum(F.col("_c") * F.col("_right")).alias("_r"))
    )
    run = running_totals(cells, [*keys, "n", "_level", "_half"], "_v", {"_l": "_below"}, value_block("_v"))
    above = F.col("_below_all") - F.col("_below") - F.col("_l")
    return run.groupBy(*keys, "n").agg(F.sum(F.col("_r") * (F.col("_below") - above)).cast("long").alias("s"))


def with_around(df, keys, order, carry, before, after, block, size=4096):
    """Arrays ``earlier`` (nearest first) and ``later`` of up to ``before`` and ``after`` neighbouring rows, as structs of the columns ``carry``.

    (keys, order) must be unique. Rows are numbered within their key and cut into stretches of ``size`` rows; a stretch also receives the
    rows just outside of its ends, so a window never sees more than one stretch and its halo.
    """
    df, keys = (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])
    placed = with_position(df, keys, order, block, "_at")
    own = F.floor(F.col("_at") / size)
    homes = F.array_distinct(F.array(own, F.floor((F.col("_at") - after) / size), F.floor((F.col("_at") + before) / size)))
    spread = placed.withColumn("_home", F.explode(F.filter(homes, lambda h: h >= 0)))
    inside = Window.partitionBy(*keys, "_home").orderBy("_at")
    row = F.struct(*carry)
    seen = spread.withColumns({
        "earlier": F.reverse(F.collect_list(row).over(inside.rowsBetween(-before, -1))) if before else F.array().cast(f"array<{spread.select(row).schema.fields[0].dataType.simpleString()}>"),
        "later": F.collect_list(row).over(inside.rowsBetween(1, after)),
    })
    return seen.where(F.col("_home") == F.floor(F.col("_at") / size)).drop("_home", "_at", "_all")


def with_next(df, keys, order, carry, block):
    """Next row's values in the order of the number ``order``: the mirror of ``with_previous``."""
    mirrored = df.withColumn("_mirror", -F.col(order))
    return with_previous(mirrored, keys, "_mirror", carry, -block).drop("_mirror")
