"""Exploration, statistics, quality checks and sampling."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import block_of, bottom_k_per_group, group_quantiles, top_k_per_group


def day_of(ts="timestamp"):
    return (F.floor(F.col(ts) / V.DAY_SECONDS) + 1).cast("bigint")


def hour_of(ts="timestamp"):
    return F.floor(F.pmod(F.col(ts), F.lit(V.DAY_SECONDS)) / V.HOUR_SECONDS).cast("bigint")


def daily_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(day_of().alias("day")).agg(F.count("*").alias("events"))


def densify_days(counts: DataFrame) -> DataFrame:
    span = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    grid = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return grid.join(counts, "day", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def rolling_days(dense: DataFrame, n: int) -> DataFrame:
    """Sum over the n days ending at each day; null until n days exist.

    The input is one row per day, so its single window partition is bounded by
    the calendar.
    """
    frame = W.orderBy("day").rowsBetween(-(n - 1), 0)
    total = F.when(F.count("*").over(frame) == n, F.sum("events").over(frame))
    return dense.withColumn("total", total)


def best_rolling_days(dense: DataFrame, sizes=(3, 5)) -> DataFrame:
    out = None
    for n in sizes:
        best = rolling_days(dense, n).filter(F.col("total").isNotNull()).agg(
            F.max(F.struct("total", (-F.col("day")).alias("neg"))).alias("b")
        )
        # no row when there are fewer than n days
        row = best.filter(F.col("b").isNotNull()).select(
            F.lit(n).cast("bigint").alias("days"),
            (-F.col("b.neg") - (n - 1)).alias("first_day"),
            (-F.col("b.neg")).alias("last_day"),
            F.col("b.total").alias("events"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def topk_values(rows: DataFrame, columns, k=10) -> DataFrame:
    """The most frequent values of each column; ties by value. k=None keeps all."""
    counted = (
        rows.select(*columns)
        .unpivot([], list(columns), "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("events"))
    )
    if k is None:
        return counted
    return top_k_per_group(counted, ["column"], [F.col("events").desc(), F.col("value")], k)


def source_composition(rows: DataFrame, relevant=None) -> DataFrame:
    """Count, share, time range and relevant/background split per source."""
    flag = F.lit(0) if relevant is None else F.col(relevant)
    per = rows.groupBy("event_type").agg(
        F.count("*").alias("events"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.sum(flag).alias("relevant"),
    )
    total = per.agg(F.sum("events").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(
        "event_type", "events",
        F.round(F.col("events") / F.col("total") * 100, 2).alias("percent"),
        "first_time", "last_time", "relevant",
        (F.col("events") - F.col("relevant")).alias("background"),
    )


def distinct_entities(rows: DataFrame, approximate=False) -> DataFrame:
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("entity"))
    entries = F.array(
        *[entry("user", c) for c in ("user", "source_user", "destination_user")],
        *[entry("host", c) for c in ("source_host", "destination_host")],
    )
    count = F.approx_count_distinct if approximate else F.countDistinct
    return (
        rows.select(F.explode(entries).alias("e"))
        .groupBy("e.kind")
        .agg(count(F.col("e.entity")).alias("entities"))
    )


def entity_relevance_flag(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds 0/1 `relevant`: the event touches a listed (entity_type, entity)."""
    out = rows
    checks = [("user", c) for c in ("user", "source_user", "destination_user")]
    checks += [("host", c) for c in ("source_host", "destination_host")]
    for i, (kind, column) in enumerate(checks):
        keys = entities.filter(F.col("entity_type") == kind).select(
            F.col("entity").alias(column), F.lit(1).alias(f"_r{i}")
        ).distinct()
        out = out.join(keys, column, "left")
    hit = F.coalesce(*[F.col(f"_r{i}") for i in range(len(checks))], F.lit(0))
    return out.withColumn("relevant", hit).select(*rows.columns, "relevant")


def sampling_key(seed, key="event_id"):
    """A hash order that other engines can reproduce; ties end with the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def capped_sample(rows: DataFrame, relevant_cap=65_000, background_cap=65_000, seed=42) -> DataFrame:
    """At most K relevant and K background rows per source: uniform, deterministic."""
    cap = F.when(F.col("relevant") == 1, relevant_cap).otherwise(background_cap)
    keyed = rows.withColumn("_h", sampling_key(seed))
    return bottom_k_per_group(keyed, ["event_type", "relevant"], "_h", ["event_id"], cap).drop("_h")


def stratified_reservoir(rows: DataFrame, quotas=V.SAMPLE_QUOTAS, seed=42, origin=V.STUDY_ORIGIN) -> DataFrame:
    """Exactly min(quota, N) rows, uniformly, of each (source, hour)."""
    hour = F.floor((F.col("timestamp") - origin) / V.HOUR_SECONDS).cast("bigint")
    keyed = rows.withColumns({"_h": sampling_key(seed), "hour_index": hour})
    out = None
    for kind, quota in quotas.items():
        part = top_k_per_group(
            keyed.filter(F.col("event_type") == kind),
            ["event_type", "hour_index"], [F.col("_h"), F.col("event_id")], quota,
        )
        out = part if out is None else out.unionByName(part)
    return out.drop("_h", "rank")


def sampling_manifest(rows: DataFrame, sample: DataFrame, quotas=V.SAMPLE_QUOTAS, origin=V.STUDY_ORIGIN):
    hour = F.floor((F.col("timestamp") - origin) / V.HOUR_SECONDS).cast("bigint").alias("hour_index")
    raw = rows.groupBy(F.col("event_type").alias("modality"), hour).agg(F.count("*").alias("raw_count"))
    kept = sample.groupBy(F.col("event_type").alias("modality"), hour).agg(F.count("*").alias("sampled_count"))
    quota = F.coalesce(*[F.when(F.col("modality") == k, q) for k, q in quotas.items()], F.lit(0))
    n = F.coalesce("sampled_count", F.lit(0))
    start = F.col("hour_index") * V.HOUR_SECONDS + origin
    return raw.join(kept, ["modality", "hour_index"], "left").select(
        "modality", "hour_index", start.alias("t_start"), (start + V.HOUR_SECONDS).alias("t_end"),
        "raw_count", n.alias("sampled_count"),
        F.round(n / F.col("raw_count"), 6).alias("sampling_fraction"),
        (F.col("raw_count") < quota).cast("int").alias("underflow"),
    )


def hosts_of(rows: DataFrame) -> DataFrame:
    return (
        rows.select(F.explode(F.array("source_host", "destination_host")).alias("host"))
        .filter(F.col("host").isNotNull())
        .distinct()
    )


def blind_cohort(rows: DataFrame, k: int, seed=42) -> DataFrame:
    """K hosts in seeded hash order, chosen without any label."""
    return hosts_of(rows).orderBy(sampling_key(seed, "host"), "host").limit(k)


def cohort_capture(rows: DataFrame, labels: DataFrame, sizes=(50, 100, 200, 500, 1000), seed=42) -> DataFrame:
    """Distinct labelled source and destination hosts captured per cohort size."""
    sides = labels.select(F.lit("src").alias("side"), F.col("source_host").alias("host")).unionByName(
        labels.select(F.lit("dst").alias("side"), F.col("destination_host").alias("host"))
    ).filter(F.col("host").isNotNull()).distinct()
    out = None
    for k in sizes:
        row = sides.join(blind_cohort(rows, k, seed), "host", "left_semi").agg(
            F.lit(k).cast("bigint").alias("k"),
            F.count_if(F.col("side") == "src").alias("src_hits"),
            F.count_if(F.col("side") == "dst").alias("dst_hits"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def top_anomalous_hosts(rows: DataFrame, since, k=1000, pool=4) -> DataFrame:
    """The k hosts that reach most destinations for the first time at or after `since`.

    Two stages: a sketch of the destinations since then (standard error 2 %)
    picks `pool` times k hosts; for these, the different destinations, those that
    the host's history before `since` lacks, and the events are counted exactly.
    """
    edges = rows.filter(F.col("source_host").isNotNull() & F.col("destination_host").isNotNull()).select(
        F.col("source_host").alias("host"), F.col("destination_host").alias("peer"), "timestamp")
    late = F.col("timestamp") >= since
    wide = edges.filter(late).groupBy("host").agg(F.approx_count_distinct("peer", 0.02).alias("_about"))
    chosen = F.broadcast(wide.orderBy(F.col("_about").desc(), "host").limit(k * pool).select("host"))
    seen = edges.join(chosen, "host").groupBy("host", "peer").agg(
        F.min("timestamp").alias("first"), F.count_if(late).alias("events")).filter("events > 0")
    return (
        seen.groupBy("host")
        .agg(F.count_if(F.col("first") >= since).alias("novel_peers"), F.count("*").alias("peers"), F.sum("events").alias("events"))
        .orderBy(F.col("novel_peers").desc(), F.col("peers").desc(), F.col("events").desc(), "host")
        .limit(k)
    )


def lineage_checks(lines: DataFrame) -> DataFrame:
    """Per file of numbered lines (file, line): rows, different line numbers, the first and the last; sound if all agree."""
    per = lines.groupBy("file").agg(
        F.count("*").alias("rows"), F.countDistinct("line").alias("distinct_lines"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    sound = (F.col("rows") == F.col("distinct_lines")) & (F.col("first_line") == 1) & (F.col("last_line") == F.col("rows"))
    return per.withColumn("sound", sound.cast("int"))


def number_checks(rows: DataFrame, columns) -> DataFrame:
    """Per numeric column: nulls, NaN, infinite values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    return rows.select(each).groupBy(F.col("x.column").alias("column")).agg(
        F.count_if(F.col("x.v").isNull()).alias("nulls"), F.count_if(F.isnan("x.v")).alias("nan"),
        F.count_if(F.abs("x.v") == float("inf")).alias("infinite"))


def quality_checks(rows: DataFrame, start=V.STUDY_ORIGIN, end=V.TEST_END, key="event_id") -> DataFrame:
    absent = lambda c: F.count_if(F.col(c).isNull()).alias(f"null_{c}")
    return rows.agg(
        F.count("*").alias("rows"),
        F.countDistinct(key).alias("distinct_keys"),
        F.count_if((F.col("timestamp") < start) | (F.col("timestamp") >= end)).alias("out_of_bounds"),
        *[absent(c) for c in ("user", "source_host", "destination_host", "process")],
        F.count_if(~F.col("event_type").isin("auth", "process", "dns", "flow")).alias("unknown_type"),
    )


def zero_variance(windows: DataFrame, features) -> DataFrame:
    from sentrylake.operators.features import long_form

    spread = F.var_pop("value")
    return long_form(windows, features, keep=()).groupBy("feature").agg(
        (spread == 0).cast("int").alias("zero_variance"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("missing"),
    )


def order_inversions(rows: DataFrame, group="event_type", line="event_id", ts="timestamp", block=100_000):
    """Rows whose time is below that of the preceding line of the same file.

    Lines are compared inside blocks; each block's first line is compared with
    the last line of the block before, so a huge file is many tasks.
    """
    blocked = rows.select(group, line, ts, block_of(F.col(line), block).alias("_b"))
    inside = W.partitionBy(group, "_b").orderBy(line)
    inner = blocked.withColumn("_p", F.lag(ts).over(inside)).filter(F.col("_p") > F.col(ts))
    heads = blocked.groupBy(group, "_b").agg(
        F.min_by(ts, line).alias("head"), F.max_by(ts, line).alias("tail")
    )
    across = W.partitionBy(group).orderBy("_b")
    outer = heads.withColumn("_p", F.lag("tail").over(across)).filter(F.col("_p") > F.col("head"))
    bad = inner.select(group).unionAll(outer.select(group)).groupBy(group).agg(F.count("*").alias("_n"))
    return rows.groupBy(group).agg(F.count("*").alias("rows")).join(bad, group, "left").select(
        group, "rows", F.coalesce("_n", F.lit(0)).alias("inversions")
    )


def modality_coverage(rows: DataFrame, size=V.WINDOW_SECONDS, origin=V.STUDY_ORIGIN) -> DataFrame:
    per = rows.groupBy(
        F.floor((F.col("timestamp") - origin) / size).alias("window_id"), "event_type"
    ).agg(F.count("*").alias("n"))
    return (
        per.groupBy("window_id").agg(F.count("*").alias("modalities"))
        .groupBy("modalities").agg(F.count("*").alias("windows"))
    )


def score_histogram(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("risk_score").agg(F.count("*").alias("events"))


def action_counts(rows: DataFrame, k=20) -> DataFrame:
    return (
        rows.groupBy("action").agg(F.count("*").alias("events"))
        .orderBy(F.col("events").desc(), "action").limit(k)
    )


def time_quantiles_by_type(rows: DataFrame) -> DataFrame:
    seconds = rows.groupBy("event_type", "timestamp").agg(F.count("*").alias("w"))
    ends = seconds.groupBy("event_type").agg(F.min("timestamp").alias("t_min"), F.max("timestamp").alias("t_max"))
    inner = group_quantiles(seconds, ["event_type"], "timestamp", "w", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return ends.join(inner, "event_type").select("event_type", "t_min", "q1", "median", "q3", "t_max")


def label_hour_histogram(labels: DataFrame, split=None) -> DataFrame:
    """Labels per split and hour of day, with the off-hours flag."""
    name = F.lit("all") if split is None else split
    hour = hour_of()
    return labels.groupBy(name.alias("split"), hour.alias("hour")).agg(
        F.count("*").alias("labels"),
        F.max(((hour < 6) | (hour >= 20)).cast("int")).alias("off_hours"),
    )
