"""Building blocks that keep hot keys out of single tasks.

Every helper first aggregates to a grain whose size is bounded by the clock
(distinct seconds of one key) or by a constant, then works on blocks of that
grain, so a key that owns a third of all rows is spread over many tasks.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrylake.session import materialize

BLOCK_SECONDS = 3600
SALTS = 32


def block_of(ts: Column, block: int) -> Column:
    return F.floor(ts / F.lit(block)).cast("bigint")


def recent_counts(df, keys, seconds, ts="timestamp", block=BLOCK_SECONDS):
    """Events of the same key in the last `seconds`, ends and ties included.

    One row per (keys, ts).
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    per_second = df.filter(present).groupBy(*keys, ts).agg(F.count("*").alias("n"))
    return recent_sums(per_second, keys, seconds, ts, block)


def recent_sums(per_second, keys, seconds, ts="timestamp", block=BLOCK_SECONDS):
    """Sum of `n` over the last `seconds`, for one row per (keys, ts).

    Each second is placed in its own time block and, where its reach crosses a
    block edge, also in the next one, so no window partition exceeds
    block + seconds rows however hot its key is.
    """
    block = max(block, seconds)
    placed = per_second.withColumn("_own", block_of(F.col(ts), block)).withColumn(
        "_block",
        F.explode(
            F.array_distinct(
                F.array("_own", block_of(F.col(ts) + F.lit(seconds), block))
            )
        ),
    )
    frame = W.partitionBy(*keys, "_block").orderBy(ts).rangeBetween(-seconds, 0)
    return (
        placed.withColumn("n_recent", F.sum("n").over(frame))
        .filter(F.col("_own") == F.col("_block"))
        .select(*keys, ts, "n_recent")
    )


def gap_segments(df, keys, gap, ts="timestamp", block=BLOCK_SECONDS * 24, opener=None):
    """Cut each key's distinct times into segments at gaps longer than `gap`.

    Returns (keys, ts, previous, segment): the previous time of the key (null
    for the first) and the start time of the segment; with `opener`, a column
    of `df` (then one row per (keys, ts)), also `opened_by`, its value at the
    segment start. Two levels: rows inside a (key, block), then one row per
    non-empty block.
    """
    keys = list(keys)
    if opener is None:
        seconds = df.select(*keys, ts).distinct().withColumn("_id", F.lit(0))
    else:
        seconds = df.select(*keys, ts, F.col(opener).alias("_id"))
    seconds = seconds.withColumn("_block", block_of(F.col(ts), block))
    inside = W.partitionBy(*keys, "_block").orderBy(ts)
    here = F.struct(F.col(ts).alias("t"), F.col("_id").alias("id"))
    rows = seconds.withColumn("_prev", F.lag(ts).over(inside))
    rows = rows.withColumn("_start", F.when(F.col(ts) - F.col("_prev") > F.lit(gap), here))
    blocks = rows.groupBy(*keys, "_block").agg(
        F.min(here).alias("_first"),
        F.max(ts).alias("_last"),
        F.max("_start").alias("_inner_start"),
    )
    across = W.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("_carry_prev", F.lag("_last").over(across))
        .withColumn(
            "_head",
            F.when(
                F.col("_carry_prev").isNull()
                | (F.col("_first.t") - F.col("_carry_prev") > F.lit(gap)),
                F.col("_first"),
            ),
        )
        .withColumn(
            "_carry_start",
            F.last(F.coalesce("_inner_start", "_head"), ignorenulls=True).over(before),
        )
        .select(*keys, "_block", "_carry_prev", "_head", "_carry_start")
    )
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_open", F.last("_start", ignorenulls=True).over(so_far))
    start = F.coalesce("_open", "_head", "_carry_start")
    # one row a key at least: not a table for the driver
    return rows.join(blocks.hint("merge"), [*keys, "_block"]).select(
        *keys,
        ts,
        F.coalesce("_prev", "_carry_prev").alias("previous"),
        start["t"].alias("segment"),
        *([start["id"].alias("opened_by")] if opener else []),
    )


def top_k_per_group(df, group, order, k, salts=SALTS):
    """The first `k` rows of each group by `order` (a total order), ranked.

    Ranks inside (group, salt) first, so a hot group is cut to salts*k rows
    before one task sees it. Adds column `rank`.
    """
    group = list(group)
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in group]), F.lit(salts))
    salted = df.withColumn("_salt", salt)
    first = W.partitionBy(*group, "_salt").orderBy(*order)
    kept = salted.withColumn("rank", F.row_number().over(first)).filter(
        F.col("rank") <= k
    )
    final = W.partitionBy(*group).orderBy(*order)
    return (
        kept.drop("_salt")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
    )


def bottom_k_per_group(df, group, key, ties, k, digits=4):
    """The `k` rows of each group with the smallest `key`, a column of uniform hex digits, then by `ties`.

    Rows are counted by the first digits of the key, which fixes in each group
    the bucket in which the k-th row lies: rows below it stay unranked, and only
    the rows of that bucket, 1 in 16**digits of the group, are ordered. `k` may
    be a column of the group. Adds no column.
    """
    group, k = list(group), k if isinstance(k, Column) else F.lit(k)
    keyed = df.withColumn("_bucket", F.substring(key, 1, digits))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_free", k - F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_free > 0")
    cut = counts.groupBy(*group).agg(F.max("_bucket").alias("_cut"), F.min("_free").alias("_free"))
    # groups may be null; a row a group
    names = {g: f"_g{i}" for i, g in enumerate(group)}
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in names.items()])
    rows = keyed.join(cut.withColumnsRenamed(names), same)
    order = W.partitionBy(*group).orderBy(key, *ties)
    last = rows.filter(F.col("_bucket") == F.col("_cut")).withColumn("_rank", F.row_number().over(order))
    last = last.filter(F.col("_rank") <= F.col("_free"))
    return rows.filter(F.col("_bucket") < F.col("_cut")).select(*df.columns).unionByName(last.select(*df.columns))


def running_totals(df, order, sums):
    """Add `cum_<c>` (running totals in `order`, own row included) for each of `sums`.

    `order` must be unique. Rows are range-partitioned and written once, each
    partition is summed on its own, and partition offsets (one row per
    partition) are added.
    """
    sliced = materialize(_sliced(df, order))
    totals = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    inside = W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = sliced.join(F.broadcast(offsets), "_slice")
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(inside) + F.col(f"_o_{c}"))
    return out.select(*df.columns, *[f"cum_{c}" for c in sums])


def number_rows(df, order, name="row_number"):
    """Number all rows 1..n in `order` (a total order) without a one-task sort."""
    position = F.monotonically_increasing_id()
    sliced = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", position)
    )
    inside = F.lit((1 << 33) - 1)
    sliced = sliced.withColumn("_slice", F.shiftright("_id", 33))
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_size"))
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_id").bitwiseAND(inside) + F.col("_offset") + 1)
        .select(*df.columns, name)
    )


def group_quantiles(counted, group, value, weight, shares):
    """Exact linear-interpolated quantiles per group, from (group, value, weight) rows.

    `shares` maps column names to shares. Ranks come from running totals, so
    no task holds the values of a whole group.
    """
    totals = running_totals(
        counted.select(*group, value, weight), [*[F.col(g) for g in group], F.col(value)], [weight]
    )
    cum = F.col(f"cum_{weight}")
    sizes = totals.groupBy(*group).agg(
        F.sum(weight).alias("_n"), F.min(cum - F.col(weight)).alias("_base")
    )
    rows = totals.join(sizes, group).withColumn("_hi", cum - F.col("_base")).withColumn(
        "_lo", F.col("_hi") - F.col(weight)
    )

    def at(position):
        held = (F.col("_lo") <= position) & (position < F.col("_hi"))
        return F.max(F.when(held, F.col(value)))

    out = []
    for name, share in shares.items():
        position = (F.col("_n") - 1) * F.lit(float(share))
        low, high = at(F.floor(position)), at(F.ceil(position))
        part = F.max(position - F.floor(position))
        out.append((low + (high - low) * part).alias(name))
    return rows.groupBy(*group).agg(*out)


def _sliced(df, order):
    return df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())


def weighted_percentile(value, share, weight):
    """Exact linear-interpolated percentile over (value, weight) pairs.

    Callers group by value first, so the aggregate holds distinct values only.
    """
    return F.percentile(value, share, weight)
