"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words. Documents are counted by exact size within each source; all
later decisions look at these counts only. A source's target is met by whole
passes over it and a remaining budget below one pass. Of every size the even
share of that budget is taken, but for FREE times the largest size; fractions
of documents become whole ones by systematic rounding from a seeded start, so
each size is taken in proportion whether its documents are many or one.
Bounded-knapsack dynamic programming over the sizes still in stock then fills
what is left, of any size, as exactly as any subset of these does. Which
documents of a size are taken is decided by a seeded hash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentrylake.functions.scale import number_rows
from sentrylake.session import materialize

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MOST_PASSES = 2
SEED = 73
PER_BUCKET = 4096
FREE = 4


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes, weights=WEIGHTS, percent=TOTAL_PERCENT, most=MOST_PASSES):
    """(source, source_size, target) from (source, size, n).

    Sources by code point, null last, weigh in turn as `weights`; a target
    stops at `most` times its source and the excess goes to the others by
    weight, in rounds until none is above. Each round is one aggregate; two
    numbers a round come to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    numbered = number_rows(totals.withColumn("_null", F.col("source").isNull()), [F.col("_null"), F.col("source")], "_no")
    share = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(numbered.select("source", "source_size", share.cast("double").alias("_w")))
    limit = F.col("source_size") * F.lit(float(most))
    whole = sources.agg(F.sum("source_size"), F.sum("_w")).first()
    budget, weight = (whole[0] or 0) * percent / 100, whole[1] or 1.0
    level, stopped = budget / weight, -1
    while True:
        # at this level a source is above its limit or gets level * weight
        above = F.lit(level) * F.col("_w") > limit
        n, taken, left = sources.agg(
            F.count_if(above), F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_w")))).first()
        if n == stopped or not left:
            break
        level, stopped = (budget - taken) / left, n
    return sources.select("source", "source_size", F.least(limit, F.lit(level) * F.col("_w")).alias("target"))


def fit_budget(sizes, stock, budget, start=0.5):
    """How many documents of each size to take so that their words come nearest to `budget`.

    `sizes` ascending and positive, `stock` documents of each. Each size gets its
    share, rounded up or down by where it falls from `start` (0 to 1) on; in order
    of size these roundings differ from the shares by at most the largest size. The
    program fills the rest, which is at most FREE + 1 times that size.
    """
    sizes, stock = np.asarray(sizes, np.int64), np.asarray(stock, np.int64)
    total = int((sizes * stock).sum())
    budget = max(0, min(int(budget), total))
    if not total or not budget:
        return np.zeros(len(sizes), np.int64)
    even = max(0, budget - FREE * int(sizes[stock > 0].max()))
    take, sofar = np.zeros(len(sizes), np.int64), int(start * total)
    for k, n in enumerate(map(int, stock)):
        take[k] = (sofar + n * even) // total - sofar // total
        sofar += n * even
    return take + _knapsack(sizes, stock - take, budget - int((sizes * take).sum()))


def _knapsack(sizes, stock, budget):
    """Bounded knapsack: counts whose sum is the reachable one nearest to `budget` (the smaller of two)."""
    sizes = np.asarray(sizes, np.int64)
    take = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return take
    # a sum beyond is farther than none, or than itself without one document
    cells = min(2 * budget, budget + int(sizes.max()))
    # of each reachable sum: the lot of documents added last (its size and number); lots are 1, 2, 4, ... documents
    reached = np.zeros(cells + 1, bool)
    reached[0] = True
    last, lot = np.zeros(cells + 1, np.int32), np.zeros(cells + 1, np.int32)
    for k in range(len(sizes) - 1, -1, -1):
        size, number = int(sizes[k]), 1
        left = min(int(stock[k]), cells // size)
        while left > 0 and not reached[budget]:
            number = min(number, left)
            step = number * size
            fresh = np.flatnonzero(reached[: cells + 1 - step] & ~reached[step:]) + step
            reached[fresh], last[fresh], lot[fresh] = True, k, number
            left -= number
            number *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        k, number = int(last[at]), int(lot[at])
        take[k] += number
        at -= number * int(sizes[k])
    return take


_PLAN = "source string, size long, n long, passes int, extra long, source_size long, target double"


def plan_takes(sizes, targets, seed=SEED):
    """(source, size, n, passes, extra, ...): every document `passes` times, `extra` documents of the size once more.

    One group a source; it holds one row for each size that occurs, not for each document.
    """

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("size")
        size, n = table["size"].to_numpy(), table["n"].to_numpy()
        whole, target = table["source_size"][0].as_py(), table["target"][0].as_py()
        passes = min(MOST_PASSES, int(target // whole)) if whole else 0
        some = size > 0
        extra = np.zeros(len(size), np.int64)
        if passes < MOST_PASSES:
            start = xxh64_intdigest(table["source"][0].as_py() or "", seed % (1 << 64)) / (1 << 64)
            extra[some] = fit_budget(size[some], n[some], round(target - passes * whole), start)
        return pa.table({
            "source": table["source"], "size": table["size"], "n": table["n"],
            "passes": pa.array([passes] * len(size), pa.int32()), "extra": pa.array(extra, pa.int64()),
            "source_size": table["source_size"], "target": table["target"],
        })

    joined = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.groupBy("source").applyInArrow(fit, _PLAN)


def mix(documents, seed=SEED):
    """(doc_id, source, size, source_size, target, copies) for every document; its words are taken `copies` times.

    Of a size, documents with the smallest seeded hashes of their ids come
    first. Hashes fall into buckets of about PER_BUCKET documents by the count
    of the size: buckets before the cut are taken whole, those after it not,
    and only the bucket at the cut is ranked. Rows equal in id, source and size
    may stand for each other. Null sources are one source; texts without words
    (null, empty) have size 0.
    """
    rows = materialize(documents.select("doc_id", "source", word_count().alias("size")))
    sizes = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    plan = materialize(plan_takes(sizes, source_targets(sizes), seed))
    return _choose(rows, plan, seed)


def _choose(rows, plan, seed):
    of_size = plan.withColumnsRenamed({"source": "_s", "size": "_z"})
    hashed = rows.join(of_size, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    hashed = hashed.withColumn("_hash", F.xxhash64("doc_id", F.lit(seed)))
    top = F.shiftrightunsigned("_hash", 32)
    hashed = hashed.withColumn("_bucket", F.floor(top * (F.floor(F.col("n") / PER_BUCKET) + 1) / F.lit(1 << 32)))
    counts = hashed.groupBy("source", "size", "_bucket").agg(F.count("*").alias("_in"))
    before = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_bucket").alias("_b"), "_in",
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_ahead"))
    placed = hashed.join(
        cuts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_bucket") == F.col("_b")))
    cut = (F.col("_ahead") < F.col("extra")) & (F.col("extra") < F.col("_ahead") + F.col("_in"))
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("_hash", "doc_id"))
    keep = ("doc_id", "source", "size", "source_size", "target")
    sure = placed.filter(~cut).select(*keep, (F.col("passes") + (F.col("_ahead") < F.col("extra")).cast("int")).alias("copies"))
    ranked = placed.filter(cut).select(
        *keep, (F.col("passes") + (F.col("_ahead") + rank <= F.col("extra")).cast("int")).alias("copies"))
    return sure.unionAll(ranked)


def mixed_documents(documents, seed=SEED):
    """The documents with all their columns, each row as often as the mix takes it."""
    own = documents.columns
    taken = mix(documents, seed).groupBy("doc_id", "source", "size").agg(
        F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    taken = taken.filter("_sum > 0").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_sum", "_rows")
    whole = F.struct(*[F.col(f"`{c}`") for c in own])  # further columns of any name stay inside
    rows = documents.select(whole.alias("_row"), word_count().alias("_words"))
    found = rows.join(
        taken, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & F.col("_row.source").eqNullSafe(F.col("_s"))
        & (F.col("_words") == F.col("_z")))
    # rows with one key share its copies; only where these do not divide are rows told apart
    each, rest = F.floor(F.col("_sum") / F.col("_rows")), F.col("_sum") % F.col("_rows")
    even = found.filter(rest == 0).select("_row", each.alias("_copies"))
    rank = F.row_number().over(Window.partitionBy("_d", "_s", "_z").orderBy("_row.text"))
    uneven = found.filter(rest != 0).select("_row", (each + (rank <= rest).cast("int")).alias("_copies"))
    copies = even.unionAll(uneven).filter("_copies > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def op3(spark, folder):
    mixed = mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
