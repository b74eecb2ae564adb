"""Window and host-window features, splits, labels and drift measures."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import group_quantiles, running_totals
from sentrylake.operators.triage import auth_failure

SIZE, ORIGIN = V.WINDOW_SECONDS, V.STUDY_ORIGIN


def window_id(ts="timestamp", size=SIZE, origin=ORIGIN):
    return F.floor((F.col(ts) - F.lit(origin)) / F.lit(size)).cast("bigint")


def event_indicators(events: DataFrame, rare_processes: DataFrame = None) -> DataFrame:
    """0/1 columns per event. Rare processes are those of the training period."""
    kind = F.col("event_type")
    flag = lambda c: c.cast("int")
    hour = F.floor(F.pmod("timestamp", F.lit(V.DAY_SECONDS)) / V.HOUR_SECONDS)
    out = events.withColumns(
        {
            "is_auth": flag(kind == "auth"),
            "is_proc": flag(kind == "process"),
            "is_dns": flag(kind == "dns"),
            "is_flow": flag(kind == "flow"),
            "auth_fail": flag((kind == "auth") & auth_failure(include_action=True)),
            "auth_ntlm": flag((kind == "auth") & F.lower(F.coalesce("details", F.lit(""))).contains("ntlm")),
            "auth_off_hours": flag((kind == "auth") & ((hour < 6) | (hour >= 20))),
        }
    )
    if rare_processes is None:
        return out.withColumn("proc_rare", F.lit(0))
    # events without a process, most of them, would meet in one task if the join is shuffled
    key = F.coalesce("process", F.xxhash64("timestamp", "user").cast("string"))
    rare = rare_processes.select(F.col("process").alias("_key"), F.lit(1).alias("_rare"))
    listed = F.col("process").isNotNull() & F.col("_rare").isNotNull()
    return out.withColumn("_key", key).join(rare, "_key", "left").withColumn(
        "proc_rare", flag((kind == "process") & listed)
    ).drop("_key", "_rare")


def origin_of(events: DataFrame) -> int:
    """The earliest time, for windows that start at the first event of a slice."""
    return events.agg(F.min("timestamp")).first()[0]


COUNTED = ["is_auth", "auth_fail", "auth_ntlm", "auth_off_hours", "is_proc", "proc_rare", "is_dns", "is_flow"]
DISTINCT = ["user", "destination_host", "source_host", "process"]


def tumbling_features(indicated: DataFrame, size=SIZE, origin=ORIGIN, label="is_redteam") -> DataFrame:
    """Sums, distinct counts and the label of each non-empty window.

    Sums combine on the map side. Different values are narrow rows of (window,
    column, value), spread by all three, so a window holding a third of all rows
    is not one task's work and no task holds the sums beside each value.
    """
    timed = indicated.withColumn("window_id", window_id(size=size, origin=origin))
    sums = timed.groupBy("window_id").agg(
        F.count("*").alias("total_events"), *[F.sum(c).alias(c) for c in COUNTED], F.max(label).alias("label")
    )
    entry = lambda i, c: F.struct(F.lit(i).cast("tinyint").alias("kind"), F.col(c).alias("value"))
    values = (
        timed.select("window_id", F.explode(F.array(*[entry(i, c) for i, c in enumerate(DISTINCT)])).alias("e"))
        .filter(F.col("e.value").isNotNull())
        .select("window_id", "e.kind", "e.value")
        .distinct()
    )
    counts = values.groupBy(F.col("window_id").alias("_window")).agg(
        *[F.count_if(F.col("kind") == i).alias(c) for i, c in enumerate(DISTINCT)]
    )
    # events without a time have a window of their own
    return sums.join(counts, F.col("window_id").eqNullSafe(F.col("_window")), "left").select(
        "window_id", "total_events", *COUNTED, *[F.coalesce(c, F.lit(0)).alias(c) for c in DISTINCT], "label"
    )


def ratio_features(windows: DataFrame) -> DataFrame:
    active = sum((F.col(c) > 0).cast("int") for c in ("is_auth", "is_proc", "is_dns", "is_flow"))
    log = lambda a, b: F.log1p(a) * F.log1p(b)
    return windows.withColumns(
        {
            "auth_fail_rate": F.col("auth_fail") / (F.col("is_auth") + 1e-5),
            "auth_ntlm_rate": F.col("auth_ntlm") / (F.col("is_auth") + 1e-5),
            "user_to_host_ratio": F.col("user") / (F.col("destination_host") + 1e-5),
            "active_sources": active,
            "multi_source_flag": (active >= 2).cast("int"),
            "auth_proc_interaction": log("is_auth", "is_proc"),
            "auth_flow_interaction": log("is_auth", "is_flow"),
        }
    )


DELTAS = {"delta_total_events": "total_events", "delta_auth_fails": "auth_fail", "delta_procs": "is_proc"}


BLOCK_WINDOWS = 4096


def delta_features(windows: DataFrame, dense=False, split="split") -> DataFrame:
    """Change against the previous window of the split; 0 for its first.

    Sparse (default): the previous non-empty window. Dense: the window just
    before, absent counting as 0. Windows are compared inside blocks, and the
    first of a block with the last of the block before, one row a block.
    """
    keys = [split] if split in windows.columns else []
    if dense:
        before = windows.select(
            *keys, (F.col("window_id") + 1).alias("window_id"),
            *[F.col(c).alias(f"_{d}") for d, c in DELTAS.items()],
        )
        joined = windows.join(before, [*keys, "window_id"], "left")
        change = {d: F.col(c) - F.coalesce(F.col(f"_{d}"), F.lit(0)) for d, c in DELTAS.items()}
        return joined.withColumns(change).drop(*[f"_{d}" for d in DELTAS])
    values = F.struct(*DELTAS.values())
    blocked = windows.withColumn("_block", F.floor(F.col("window_id") / BLOCK_WINDOWS))
    inside = W.partitionBy(*keys, "_block").orderBy("window_id")
    across = W.partitionBy(*keys).orderBy("_block")
    ends = blocked.groupBy(*keys, "_block").agg(F.max_by(values, "window_id").alias("_last"))
    carried = ends.select(*keys, "_block", F.lag("_last").over(across).alias("_carried"))
    rows = blocked.withColumn("_before", F.lag(values).over(inside)).join(carried, [*keys, "_block"])
    before = F.coalesce("_before", "_carried")
    return rows.withColumns(
        {d: F.coalesce(F.col(c) - before[c], F.lit(0)) for d, c in DELTAS.items()}
    ).drop("_block", "_before", "_carried")


def densify_windows(windows: DataFrame, first=None, last=None, fill=None) -> DataFrame:
    """Every window id from first to last; missing windows are all zeros."""
    lo, hi = windows.agg(F.min("window_id"), F.max("window_id")).first()
    if lo is None:
        return windows
    lo, hi = lo if first is None else first, hi if last is None else last
    grid = windows.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "window_id")
    columns = fill or [c for c in windows.columns if c != "window_id"]
    return grid.join(windows, "window_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in columns}
    )


def window_features(indicated: DataFrame, size=SIZE, origin=ORIGIN, dense=False, split=None) -> DataFrame:
    """The 23 model features and the label of each window.

    `split`, a column of window_id, cuts the windows into slices that are
    treated apart: the first window of a slice has no window before it.
    """
    base = tumbling_features(indicated, size, origin)
    if dense:
        base = densify_windows(base)
    if split is not None:
        base = base.withColumn("split", split)
    return delta_features(ratio_features(base), dense=dense).select(
        "window_id", *V.WINDOW_FEATURES, "label", *(["split"] if split is not None else [])
    )


FEATURES_16 = [
    "total_events", "is_auth", "auth_fail", "auth_fail_ratio", "auth_ntlm", "auth_off_hours",
    "is_proc", "proc_rare", "is_dns", "is_flow", "user", "destination_host", "source_host",
    "process", "active_sources", "multi_source_flag",
]


def feature_vector_16(indicated: DataFrame, size=SIZE, origin=ORIGIN) -> DataFrame:
    return (
        ratio_features(tumbling_features(indicated, size, origin))
        .withColumnRenamed("auth_fail_rate", "auth_fail_ratio")
        .select("window_id", *FEATURES_16, "label")
    )


def chronological_split(ts="timestamp", train_end=V.TRAIN_END, validation_end=V.VALIDATION_END,
                        start=V.STUDY_ORIGIN, end=V.TEST_END):
    """train / validation / test by half-open time ranges; null outside."""
    t = F.col(ts)
    return (
        F.when((t >= start) & (t < train_end), "train")
        .when((t >= train_end) & (t < validation_end), "validation")
        .when((t >= validation_end) & (t < end), "test")
    )


def window_labels(labels: DataFrame, first: int, last: int, size=SIZE, origin=ORIGIN) -> DataFrame:
    """y = 1 iff a label time falls in the window; every window of the range is kept."""
    grid = labels.sparkSession.range(first, last + 1).withColumnRenamed("id", "window_id")
    hit = labels.groupBy(window_id(size=size, origin=origin).alias("window_id")).agg(
        F.count("*").alias("label_rows")
    )
    return grid.join(hit, "window_id", "left").select(
        "window_id",
        F.coalesce("label_rows", F.lit(0)).alias("label_rows"),
        F.col("label_rows").isNotNull().cast("int").alias("y"),
    )


def window_bounds(events: DataFrame, labels: DataFrame, size=SIZE, origin=ORIGIN) -> DataFrame:
    wid = window_id(size=size, origin=origin).alias("window_id")
    seen = events.groupBy(wid).agg(
        F.min("timestamp").alias("t_start_observed"),
        F.max("timestamp").alias("t_end_observed"),
        F.count("*").alias("total_events"),
    )
    hit = labels.groupBy(wid).agg(F.count("*").alias("label_events"))
    start = F.col("window_id") * size + origin
    return seen.join(hit, "window_id", "left").select(
        "window_id",
        start.alias("nominal_start"),
        (start + size).alias("nominal_end"),
        "t_start_observed",
        "t_end_observed",
        (F.col("t_end_observed") - F.col("t_start_observed")).alias("observed_duration"),
        "total_events",
        F.coalesce("label_events", F.lit(0)).alias("label_events"),
        F.col("label_events").isNotNull().cast("int").alias("ground_truth"),
    )


def host_window_features(events: DataFrame, size=SIZE, origin=ORIGIN) -> DataFrame:
    """Activity of each active (host, window).

    An event whose source and destination are the same host counts once in
    events_total. delta_events compares with the window just before (absent = 0).
    """
    side = lambda host, peer, role: F.struct(
        F.col(host).alias("host"), F.col(peer).alias("peer"), F.lit(role).alias("role")
    )
    once = F.col("source_host").eqNullSafe(F.col("destination_host"))
    hour = F.floor(F.pmod("timestamp", F.lit(V.DAY_SECONDS)) / V.HOUR_SECONDS)
    touched = (
        events.select(
            window_id(size=size, origin=origin).alias("window_id"),
            "event_type",
            once.alias("self"),
            ((hour < 8) | (hour >= 18)).cast("int").alias("off"),
            F.explode(
                F.array(side("source_host", "destination_host", "src"),
                        side("destination_host", "source_host", "dst"))
            ).alias("s"),
        )
        .select("window_id", "event_type", "self", "off", "s.host", "s.peer", "s.role")
        .filter(F.col("host").isNotNull())
    )
    # identical rows are counted first: a busy host is combined on the map side
    packed = touched.groupBy("window_id", "host", "peer", "event_type", "role", "self", "off").agg(
        F.count("*").alias("n")
    )
    first_side = (F.col("role") == "src") | ~F.col("self")
    count_of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    kind = lambda k: count_of(first_side & (F.col("event_type") == k))
    grouped = packed.groupBy("host", "window_id").agg(
        count_of(first_side).alias("events_total"),
        count_of(F.col("role") == "src").alias("events_as_src"),
        count_of(F.col("role") == "dst").alias("events_as_dst"),
        kind("auth").alias("auth_events"),
        kind("process").alias("proc_events"),
        kind("flow").alias("flow_events"),
        kind("dns").alias("dns_events"),
        F.countDistinct(F.when(F.col("peer") != F.col("host"), F.col("peer"))).alias("distinct_peers"),
        F.max("off").alias("auth_off_hours"),
    )
    before = grouped.select(
        "host", (F.col("window_id") + 1).alias("window_id"), F.col("events_total").alias("_before")
    )
    return grouped.join(before, ["host", "window_id"], "left").select(
        "host", "window_id", *V.HOST_WINDOW_FEATURES[:8],
        (F.col("events_as_src") > 0).cast("int").alias("is_src"),
        (F.col("events_as_dst") > 0).cast("int").alias("is_dst"),
        (F.col("events_total") - F.coalesce("_before", F.lit(0))).alias("delta_events"),
        "auth_off_hours",
    )


def host_window_labels(host_windows: DataFrame, labels: DataFrame, size=SIZE, origin=ORIGIN) -> DataFrame:
    positive = (
        labels.select(
            window_id(size=size, origin=origin).alias("window_id"),
            F.explode(F.array("source_host", "destination_host")).alias("host"),
        )
        .filter(F.col("host").isNotNull())
        .distinct()
        .withColumn("_y", F.lit(1))
    )
    return host_windows.join(positive, ["host", "window_id"], "left").withColumn(
        "y", F.coalesce("_y", F.lit(0))
    ).drop("_y")


def rolling_score(windows: DataFrame, score="score", split="split") -> DataFrame:
    """Centered maximum of three windows and trailing mean of three, within a split."""
    order = W.partitionBy(split).orderBy("window_id")
    return windows.withColumns(
        {
            "centered_max": F.max(score).over(order.rowsBetween(-1, 1)),
            "trailing_mean": F.avg(score).over(order.rowsBetween(-2, 0)),
        }
    )


def window_size_sweep(events: DataFrame, sizes=V.SWEEP_WINDOW_SIZES, origin=ORIGIN, label="is_redteam"):
    """Window and attacked-window counts per size, in one pass.

    Seconds are counted first, so the expansion by size works on distinct
    seconds rather than on events.
    """
    seconds = events.groupBy("timestamp").agg(F.max(label).alias("label"))
    sized = seconds.select(
        "timestamp", "label", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    )
    return (
        sized.groupBy("size", F.floor((F.col("timestamp") - origin) / F.col("size")).alias("w"))
        .agg(F.max("label").alias("y"))
        .groupBy("size")
        .agg(F.count("*").alias("windows"), F.sum("y").alias("attack_windows"))
    )


def long_form(windows: DataFrame, features, keep=("split",)) -> DataFrame:
    return windows.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keep), list(features), "feature", "value"
    )


def feature_shift(windows: DataFrame, features=V.WINDOW_FEATURES) -> DataFrame:
    return long_form(windows, features).groupBy("feature", "split").agg(
        F.avg("value").alias("mean"), F.stddev("value").alias("std")
    )


def psi(windows: DataFrame, features=V.WINDOW_FEATURES, reference="train", target="test", floor=1e-6):
    """Population stability index over the deciles of the reference split.

    Both shares are floored, so empty bins are finite. Equal decile edges merge.
    """
    rows = long_form(windows, features).filter(F.col("split").isin(reference, target))
    # equal values are counted once per feature
    counted = rows.groupBy("feature", "split", "value").agg(F.count("*").alias("w"))
    cuts = {f"_d{i}": i / 10 for i in range(1, 10)}
    edges = group_quantiles(
        counted.filter(F.col("split") == reference).select("feature", "value", "w"), ["feature"], "value", "w", cuts
    ).select("feature", F.array_distinct(F.array(*cuts)).alias("edges"))
    bins = F.size(F.filter("edges", lambda e: e < F.col("value")))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("w"))), F.lit(0))
    binned = (
        counted.join(edges, "feature")
        .groupBy("feature", bins.alias("bin"))
        .agg(side(reference).alias("p"), side(target).alias("q"))
    )
    totals = counted.groupBy("feature").agg(side(reference).alias("np"), side(target).alias("nq"))
    p = F.greatest(F.try_divide("p", "np"), F.lit(floor))
    q = F.greatest(F.try_divide("q", "nq"), F.lit(floor))
    value = F.sum((q - p) * F.log(q / p))
    return (
        binned.join(totals, "feature")
        .groupBy("feature")
        .agg(value.alias("psi"))
        .withColumn(
            "band", F.when(F.col("psi") < 0.10, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("shifted")
        )
    )


def mid_ranks(rows: DataFrame, group, value="value") -> DataFrame:
    """Average ranks of `value` inside each group, from counts of distinct values."""
    sizes = rows.groupBy(*group, value).agg(F.count("*").alias("_n"))
    # the running count restarts per group: subtract the count before the group
    totals = running_totals(sizes, [*[F.col(g) for g in group], F.col(value)], ["_n"])
    first = totals.groupBy(*group).agg(F.min(F.col("cum__n") - F.col("_n")).alias("_base"))
    ranks = totals.join(first, group).select(
        *group, value, (F.col("cum__n") - F.col("_base") - (F.col("_n") - 1) / 2).alias("rank")
    )
    return rows.join(ranks, [*group, value])


def feature_label_corr(windows: DataFrame, features=V.WINDOW_FEATURES, label="label") -> DataFrame:
    """Pearson and Spearman correlation with the label, per feature and split.

    Null when either side is constant.
    """
    rows = long_form(windows, features, keep=("split", label)).withColumn("y", F.col(label).cast("double"))
    ranked = mid_ranks(rows, ["feature", "split"]).withColumnRenamed("rank", "rx")
    # ranks of a two-valued label are a linear map of it, which corr ignores
    r = lambda a: F.try_divide(F.covar_pop(a, "y"), F.stddev_pop(a) * F.stddev_pop("y"))
    return ranked.groupBy("feature", "split").agg(r("value").alias("pearson"), r("rx").alias("spearman"))
