"""Streaming forms of scoring, bursts, features, sessions and feedback."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sentrylake.functions import fixed_values as V
from sentrylake.operators.correlate import event_entities
from sentrylake.operators.features import COUNTED, DISTINCT
from sentrylake.operators.lists import latest_lists, listed_risk, teaching_verdicts
from sentrylake.operators.triage import triage_frozen
from sentrylake.streaming.state import EpochTable, keep_large_state


def event_time(ts="timestamp"):
    return F.timestamp_seconds(F.col(ts))


def stream_score(events: DataFrame, pairs, processes, iocs=None, **limits) -> DataFrame:
    """Score arriving events against frozen profiles and lists (stream-static joins)."""
    return triage_frozen(events, pairs, processes, iocs, **limits)


SKETCH_BITS = 14  # 2**14 registers: a standard error of 0.8 %, and practically exact up to a thousand values


def stream_features(indicated: DataFrame, size=V.WINDOW_SECONDS, late="10 minutes") -> DataFrame:
    """Window sums, and a sketch of the different values of each entity column.

    Sketches merge: `window_counts` reads them, `wider_windows` adds windows up.
    Windows are aligned to the study origin, which is a multiple of the size.
    """
    timed = indicated.withColumn("event_time", event_time()).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", f"{size} seconds").alias("w")).agg(
        F.count("*").alias("total_events"),
        *[F.sum(c).alias(c) for c in COUNTED],
        *[F.hll_sketch_agg(c, SKETCH_BITS).alias(f"{c}_sketch") for c in DISTINCT],
    ).select(
        F.floor((F.unix_timestamp("w.start") - V.STUDY_ORIGIN) / size).alias("window_id"),
        F.col("total_events"), *COUNTED, *[f"{c}_sketch" for c in DISTINCT],
    )


def window_counts(features: DataFrame) -> DataFrame:
    """The distinct counts in place of their sketches."""
    return features.select(
        "window_id", "total_events", *COUNTED, *[F.hll_sketch_estimate(f"{c}_sketch").alias(c) for c in DISTINCT]
    )


def wider_windows(features: DataFrame, times: int) -> DataFrame:
    """Windows of `times` the size: sums add up, sketches unite, events are not read again."""
    return features.groupBy(F.floor(F.col("window_id") / times).alias("window_id")).agg(
        F.sum("total_events").alias("total_events"),
        *[F.sum(c).alias(c) for c in COUNTED],
        *[F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in DISTINCT],
    )


def stream_sessions(events: DataFrame, gap=V.CORRELATION_GAP, late="10 minutes") -> DataFrame:
    """Per-entity sessions: events at most `gap` seconds apart (touching sessions merge).

    For append mode: a session is given once, when the watermark has passed its
    end, and then leaves the state.
    """
    entities = event_entities(events.withColumn("event_time", event_time()).withWatermark("event_time", late), "event_time")
    return (
        entities.groupBy(
            "entity_type", "entity", F.session_window("event_time", f"{gap} seconds").alias("s")
        )
        .agg(F.count("*").alias("events"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))
        .select("entity_type", "entity", F.unix_timestamp("s.start").alias("session_start"),
                "events", "first_time", "last_time")
    )


def stream_counters(scored: DataFrame) -> DataFrame:
    """Running totals per event type."""
    return scored.groupBy("event_type").agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("is_suspicious") == 1).alias("flagged"),
        F.sum("risk_score").alias("total_risk"),
        F.max("timestamp").alias("latest_time"),
    )


def recent_events(table: DataFrame, n=200) -> DataFrame:
    return table.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(n)


# --- fixed values: replay slices (inclusive seconds) ---
SCENARIOS = {"redteam_lateral": (744500, 749500), "multi_source": (1088000, 1092000)}


def scenario_slice(events: DataFrame, name: str, scenarios=SCENARIOS) -> DataFrame:
    start, end = scenarios[name]
    return events.filter(F.col("timestamp").between(start, end))


class RecentCounts(StatefulProcessor):
    """Per key, the sum over the last `seconds` for every second, from (timestamp, n) in the order of the watermark.

    State is the counts of the last `seconds` of the key; a timer clears it
    when the watermark has passed them.
    """

    def __init__(self, key, seconds, more_than):
        self.key, self.seconds, self.more_than = key, seconds, more_than

    def init(self, handle):
        self.handle = handle
        self.tail = handle.getListState("tail", "timestamp bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(rows)[["timestamp", "n"]].sort_values("timestamp")
        old = pd.DataFrame(list(self.tail.get()), columns=["timestamp", "n"])
        both = pd.concat([old, new]).astype("int64")
        ts, total = both["timestamp"].to_numpy(), both["n"].cumsum().to_numpy()
        start = ts.searchsorted(ts - self.seconds)
        both["n_recent"] = total - total[start] + both["n"].to_numpy()[start]
        self.tail.put([tuple(r) for r in both.loc[ts >= ts[-1] - self.seconds, ["timestamp", "n"]].itertuples(index=False)])
        self.handle.registerTimer(int(ts[-1] + self.seconds + 1) * 1000)
        out = both.iloc[len(old):]
        out = out[out["n_recent"] > self.more_than].copy()
        out.insert(0, self.key, key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        newest = max((t for t, _ in self.tail.get()), default=None)
        if newest is not None and (newest + self.seconds) * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.tail.clear()
        yield pd.DataFrame({self.key: pd.Series(dtype=str), **{c: pd.Series(dtype="int64") for c in ("timestamp", "n", "n_recent")}})

    def close(self):
        pass


def stream_bursts(events: DataFrame, key="user", seconds=V.AUTH_BURST_SECONDS, more_than=V.BURST_MORE_THAN, late="10 minutes") -> DataFrame:
    """(key, timestamp, n, n_recent): the seconds at which a key has more than `more_than` events in the last `seconds`.

    For append mode. Events are first counted by (key, second), combined on the
    map side, so the state of a key gets a row a second however busy it is.
    Events behind the watermark are dropped.
    """
    keep_large_state(events.sparkSession)
    timed = events.withColumn("event_time", event_time()).withWatermark("event_time", late)
    # a condition that reads the time is not moved below the watermark, which rows without a key move too
    keyed = timed.filter(F.when(F.col("event_time").isNotNull(), F.col(key).isNotNull()))
    counted = keyed.groupBy(key, F.window("event_time", "1 second").alias("w")).agg(F.count("*").alias("n"))
    counted = counted.select(
        key, F.window_time("w").alias("event_time"), F.unix_timestamp("w.start").alias("timestamp"), "n")
    return counted.groupBy(key).transformWithStateInPandas(
        RecentCounts(key, seconds, more_than), f"{key} string, timestamp bigint, n bigint, n_recent bigint", "Append", "EventTime")


def stable_id(component):
    return F.concat(F.lit("INC-"), F.upper(F.substring(F.md5(component.cast("string")), 1, 12)))


class StreamFeedback:
    """Scores the events of each batch with the lists that followed from the verdicts of all batches before it.

    Batches hold rows of `tagged`: events and verdicts. The lists have a
    version for each epoch: that of the epoch before, with newer verdicts.
    """

    def __init__(self, root, score=listed_risk):
        self.root, self.score = root, score
        self.versions = EpochTable(f"{root}/lists", "type string, value string, list string, seq bigint")

    @staticmethod
    def tagged(events: DataFrame, verdicts: DataFrame) -> DataFrame:
        """One stream of both, as a column `event` and a column `verdict`, one of them null."""
        event, verdict = F.struct(*events.columns), F.struct(*verdicts.columns)
        none = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType)
        return events.select(event.alias("event"), none(verdicts).alias("verdict")).unionByName(
            verdicts.select(none(events).alias("event"), verdict.alias("verdict")))

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        lists = self.versions.before(batch.sparkSession, epoch)
        events = batch.filter("event is not null").select("event.*")
        self.score(events, lists).write.mode("overwrite").parquet(f"{self.root}/rows/epoch={epoch}")
        newer = teaching_verdicts(batch.filter("verdict is not null").select("verdict.*"))
        self.versions.write(latest_lists(lists.unionByName(newer)), epoch)

    def scored(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.root}/rows")
