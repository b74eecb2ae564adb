"""Profiles of normal behavior: one DataFrame per profile, joined to events."""

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import gap_segments, weighted_percentile
from sentrylake.functions.text import detail_number
from sentrylake.session import materialize


def pair_host():
    return F.coalesce(F.col("destination_host"), F.col("source_host"))


def baseline_cutoff(events: DataFrame, last_ts) -> DataFrame:
    """Rows a profile may learn from: at or before the cutoff."""
    return events.filter(F.col("timestamp") <= last_ts)


def pair_frequency(events: DataFrame) -> DataFrame:
    return (
        events.select("user", pair_host().alias("host"))
        .filter(F.col("user").isNotNull() & F.col("host").isNotNull())
        .groupBy("user", "host")
        .agg(F.count("*").alias("pair_count"))
    )


def process_frequency(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("process").isNotNull())
        .groupBy("process")
        .agg(F.count("*").alias("process_count"))
    )


def adaptive_threshold(counts: DataFrame, column: str, share=0.05, default=2) -> DataFrame:
    """One row: max(1, whole part of the percentile of `column`); `default` if empty."""
    by_value = counts.groupBy(column).agg(F.count("*").alias("_w"))
    cut = F.floor(weighted_percentile(F.col(column), share, F.col("_w")))
    return by_value.agg(
        F.coalesce(F.greatest(F.lit(1), cut), F.lit(default)).cast("bigint").alias("threshold")
    )


VELOCITY_STATE = "user string, windows long, total double, squares double"


def _greedy_windows(window_seconds):
    """Fold per-second counts, sorted by (user, ts), into greedy windows.

    State is one open window per user and survives Arrow batch borders.
    """

    def fold(batches):
        user = None
        start = count = windows = 0
        total = squares = 0.0
        done = []

        def close():
            done.append((user, windows + 1, total + count, squares + count * count))

        for pdf in batches:
            if pdf.empty:
                continue
            names, times, counts = (pdf[c].to_numpy() for c in ("user", "timestamp", "n"))
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            last = np.r_[first[1:], len(names)]
            # users that lie inside one window, and not at the border of a batch, need no fold
            single = times[last - 1] - times[first] <= window_seconds
            single[[0, -1]] = False
            sums = np.add.reduceat(counts, first)[single].astype(float)
            yield pd.DataFrame({"user": names[first[single]], "windows": 1, "total": sums, "squares": sums * sums})
            for a, b in zip(first[~single], last[~single]):
                u, ts, running = names[a], times[a:b], counts[a:b].cumsum()
                if u != user:
                    if user is not None:
                        close()
                    user, start, count, windows, total, squares = u, int(ts[0]), 0, 0, 0.0, 0.0
                taken = 0
                at = 0
                while True:
                    end = int(ts.searchsorted(start + window_seconds, side="right"))
                    if end > at:
                        count += int(running[end - 1]) - taken
                        taken = int(running[end - 1])
                    if end == len(ts):
                        break
                    windows, total, squares = windows + 1, total + count, squares + count * count
                    at, start, count = end, int(ts[end]), 0
            if done:
                yield pd.DataFrame(done, columns=["user", "windows", "total", "squares"])
                done = []
        if user is not None:
            close()
            yield pd.DataFrame(done, columns=["user", "windows", "total", "squares"])

    return fold


def auth_velocity(events: DataFrame, window_seconds=V.WINDOW_SECONDS) -> DataFrame:
    """Mean and population std of a user's logons per greedy window.

    A window opens at an event and takes everything up to `window_seconds`
    later; the next event opens the next one. Rows are counted per second
    first. A gap longer than a window ends the open one, so the segments of a
    user between such gaps are folded apart, by different tasks, with O(1) state.
    """
    per_second = (
        events.filter((F.lower("event_type") == "auth") & F.col("user").isNotNull())
        .groupBy("user", "timestamp")
        .agg(F.count("*").alias("n"))
    )
    segments = gap_segments(per_second, ["user"], window_seconds).select("user", "timestamp", "segment")
    # the segment goes in front of the name: one key for the fold, taken apart again after it
    keyed = per_second.join(segments, ["user", "timestamp"]).select(
        F.concat_ws(" ", "segment", "user").alias("user"), "timestamp", "n")
    folded = (
        keyed.repartition("user")
        .sortWithinPartitions("user", "timestamp")
        .mapInPandas(_greedy_windows(window_seconds), VELOCITY_STATE)
        .groupBy(F.expr("substring(user, locate(' ', user) + 1)").alias("user"))
        .agg(*[F.sum(c).alias(c) for c in ("windows", "total", "squares")])
    )
    mean = F.col("total") / F.col("windows")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("windows") - mean * mean))
    std = F.when(F.col("total") < 2, 0.5).when(F.col("windows") == 1, mean * 0.5).otherwise(spread)
    return folded.select(
        "user", mean.alias("mean"), F.greatest(std, F.lit(0.5)).alias("std")
    )


def flow_volume_profile(events: DataFrame) -> DataFrame:
    size = F.coalesce(F.col("bytes"), detail_number(F.col("details"), "bytes"))
    return (
        events.filter((F.lower("event_type") == "flow") & F.col("source_host").isNotNull())
        .select(F.col("source_host").alias("host"), size.alias("b"))
        .filter(F.col("b") > 0)
        .groupBy("host")
        .agg(
            F.avg("b").alias("mean"),
            F.when(F.count("*") > 1, F.stddev_pop("b")).otherwise(F.avg("b") * 0.5).alias("std"),
        )
    )


def hour_histogram(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("user").isNotNull() & (F.col("timestamp") > 0))
        .withColumn("hour", F.floor(F.pmod("timestamp", F.lit(V.DAY_SECONDS)) / V.HOUR_SECONDS))
        .groupBy("user", "hour")
        .agg(F.count("*").alias("n"))
    )


def hour_profile(events: DataFrame) -> DataFrame:
    """One row per user: total activity and a map from active hour to count."""
    return hour_histogram(events).groupBy("user").agg(
        F.sum("n").alias("activity"),
        F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("by_hour"),
    )


def host_user_diversity(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("user").isNotNull() & F.col("destination_host").isNotNull())
        .groupBy(F.col("destination_host").alias("host"))
        .agg(F.countDistinct("user").alias("users"))
    )


def known_entities(events: DataFrame) -> DataFrame:
    user = F.struct(F.lit("user").alias("entity_type"), F.col("user").alias("entity"))
    hosts = [
        F.struct(F.lit("host").alias("entity_type"), F.col(c).alias("entity"))
        for c in ("source_host", "destination_host")
    ]
    return (
        events.select(F.explode(F.array(user, *hosts)).alias("e"))
        .select("e.entity_type", "e.entity")
        .filter(F.col("entity").isNotNull())
        .distinct()
    )


def rare_process_set(events: DataFrame, train_end, at_most=V.RARE_TRAIN_PROCESS_AT_MOST) -> DataFrame:
    train = events.filter((F.col("timestamp") <= train_end) & (F.col("event_type") == "process"))
    return process_frequency(train).filter(F.col("process_count") <= at_most)


def bigram_nll(events: DataFrame, quiet_end, left, right, size=V.WINDOW_SECONDS, origin=V.STUDY_ORIGIN):
    """Sum of -log P(right | left) per window, P fitted on the quiet period.

    Add-one smoothing over the right-hand values seen in the quiet period.
    """
    named = events.select(
        "timestamp", F.expr(left).alias("l"), F.expr(right).alias("r")
    ).filter(F.col("l").isNotNull() & F.col("r").isNotNull())
    quiet = named.filter(F.col("timestamp") <= quiet_end)
    joint = quiet.groupBy("l", "r").agg(F.count("*").alias("lr"))
    lefts = joint.groupBy("l").agg(F.sum("lr").alias("ln"))
    words = joint.agg(F.countDistinct("r").alias("v"))
    window = F.floor((F.col("timestamp") - origin) / size)
    # count identical (window, l, r) first: the joins then see distinct keys only
    seen = named.groupBy(window.alias("window_id"), "l", "r").agg(F.count("*").alias("n"))
    p = (F.coalesce("lr", F.lit(0)) + 1) / (F.coalesce("ln", F.lit(0)) + F.col("v") + 1)
    return (
        seen.join(joint, ["l", "r"], "left")
        .join(lefts, "l", "left")
        .crossJoin(F.broadcast(words))
        .groupBy("window_id")
        .agg(F.sum(-F.log(p) * F.col("n")).alias("nll"), F.sum("n").alias("events"))
    )


def novel_edges(events: DataFrame, size=V.WINDOW_SECONDS, origin=V.STUDY_ORIGIN, spike=2.0):
    """Per (user, window): hosts first reached there, out-degree, and a spike flag.

    A spike is an out-degree above `spike` times the user's mean out-degree.
    """
    window = F.floor((F.col("timestamp") - origin) / size)
    edges = (
        events.select("user", F.col("destination_host").alias("host"), window.alias("window_id"))
        .filter(F.col("user").isNotNull() & F.col("host").isNotNull())
        .distinct()
    )
    first = edges.groupBy("user", "host").agg(F.min("window_id").alias("first_window"))
    degree = (
        edges.join(first, ["user", "host"])
        .groupBy("user", "window_id")
        .agg(
            F.count("*").alias("out_degree"),
            F.count_if(F.col("first_window") == F.col("window_id")).alias("new_hosts"),
        )
    )
    usual = degree.groupBy("user").agg(F.avg("out_degree").alias("mean_degree"))
    return degree.join(usual, "user").select(
        "user", "window_id", "out_degree", "new_hosts",
        (F.col("out_degree") > F.col("mean_degree") * spike).cast("int").alias("spike"),
    )


@dataclass
class Baseline:
    """The profiles the specialists read. All are DataFrames."""

    pairs: DataFrame
    processes: DataFrame
    velocity: DataFrame
    flows: DataFrame
    hours: DataFrame
    diversity: DataFrame
    known: DataFrame
    pair_threshold: DataFrame
    process_threshold: DataFrame


def build_baseline(events: DataFrame) -> Baseline:
    pairs, processes = pair_frequency(events), process_frequency(events)
    return Baseline(
        pairs=pairs,
        processes=processes,
        velocity=auth_velocity(events),
        flows=flow_volume_profile(events),
        hours=hour_profile(events),
        diversity=host_user_diversity(events),
        known=known_entities(events),
        pair_threshold=adaptive_threshold(pairs, "pair_count"),
        process_threshold=adaptive_threshold(processes, "process_count"),
    )


def store_baseline(base: Baseline) -> Baseline:
    """The same profiles as written tables: each is computed once, and its exact
    size decides how it is joined."""
    return Baseline(**{f.name: materialize(getattr(base, f.name)) for f in fields(base)})
