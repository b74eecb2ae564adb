"""Streams over several micro-batches against the batch operators."""

import random

from pyspark.sql import functions as F

from sentrylake.functions.scale import gap_segments, recent_counts
from sentrylake.operators import correlate as C
from sentrylake.operators import features as X
from sentrylake.operators.incidents import incident_confidence, incident_risk
from sentrylake.streaming import incidents as SI
from sentrylake.streaming import pipelines as P
from sentrylake.streaming import state as S


def in_files(spark, df, path, edges):
    """One file per time slice, in time order."""
    lo = 0
    for i, hi in enumerate(edges):
        df.filter((F.col("timestamp") >= lo) & (F.col("timestamp") < hi)).coalesce(1).write.mode("append").parquet(path)
        lo = hi
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def sample(make_events, n=400):
    rng = random.Random(11)
    rows = [{"event_type": "auth", "timestamp": 691200 + rng.randrange(9000), "user": rng.choice(["hot", f"u{rng.randrange(40)}"]),
             "source_host": f"s{rng.randrange(9)}", "destination_host": f"h{rng.randrange(200)}", "details": "NTLM", "action": "LogOn"} for _ in range(n)]
    return make_events(rows)


EDGES = [691200 + 2000 * i for i in range(1, 6)]


END = 800_000


def test_bursts_across_batches_and_restarts(spark, make_events, tmp_path):
    events = sample(make_events)
    stream = in_files(spark, events, str(tmp_path / "in"), EDGES)
    progress = []
    got = S.run_to_end(P.stream_bursts, stream, S.new_root(spark), END, progress)  # the end is a second run over the checkpoint
    counts = recent_counts(events, ["user"], 300).filter("n_recent > 3")
    key = lambda df: sorted(tuple(r) for r in df.select("user", "timestamp", "n_recent").collect())
    assert key(got) == key(counts) and key(got)
    assert len(progress) > len(EDGES)
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert max(held) > 0 and held[-1] == 0


def test_late_rows_are_dropped(spark, make_events, tmp_path):
    row = lambda t: {"event_type": "auth", "timestamp": t, "user": "u"}
    first, second = make_events([row(1000)]), make_events([row(t) for t in (899, 901, 902, 950, 1001)])
    source = S.folder_stream(spark, str(tmp_path / "in"), first.schema)
    root = S.new_root(spark)
    pulse = S.Heartbeat(root, first.schema)
    out = P.stream_bursts(source.unionByName(pulse.stream(spark)), late="100 seconds")
    for part in (first, second):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        S.run_available(out, root=root)
    for _ in range(2):
        pulse.beat(spark, 5000)
        S.run_available(out, root=root)
    rows = spark.read.schema(out.schema).parquet(f"{root}/rows").collect()
    assert {r.timestamp: r.n_recent for r in rows} == {1000: 4, 1001: 5}


def test_sessions_are_given_once(spark, make_events, tmp_path):
    events = sample(make_events).select("event_id", "timestamp", "user", "source_user", "destination_user", "source_host", "destination_host")
    stream = in_files(spark, events, str(tmp_path / "in"), EDGES)
    progress = []
    got = S.run_to_end(P.stream_sessions, stream, S.new_root(spark), END, progress)
    cuts = gap_segments(C.event_entities(events), ["entity_type", "entity"], 600)
    want = C.event_entities(events).join(cuts, ["entity_type", "entity", "timestamp"]).groupBy("entity_type", "entity", "segment").agg(
        F.count("*").alias("events"), F.max("timestamp").alias("last_time"))
    key = lambda df, start: sorted(tuple(r) for r in df.select("entity_type", "entity", start, "events", "last_time").collect())
    assert key(got, "session_start") == key(want, "segment")
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def flagged(make_events, seed, n, users, span):
    rng = random.Random(seed)
    rows = [{"event_type": rng.choice(["auth", "flow"]), "timestamp": 691200 + rng.randrange(span), "user": f"u{rng.randrange(users)}",
             "destination_host": rng.choice([None, f"h{rng.randrange(2 * users)}"])} for _ in range(n)]
    rows += [{"event_type": "dns", "timestamp": 691200 + 50}]  # no entity at all
    # two incidents of the first batch that an event of the second one joins
    rows += [{"event_type": "auth", "timestamp": 691200 + t, "user": u, "destination_host": h} for t, u, h in
             ((2400, "m1", "x1"), (2450, "m2", "x2"), (2600, "m1", "x2"))]
    rows.sort(key=lambda r: r["timestamp"])
    return make_events(rows).withColumn("risk_score", (F.col("event_id") % 7).cast("bigint")).withColumn("agent", F.lit("A")).withColumn(
        "rules", F.array()).cache()


def test_incidents_grow_merge_close_and_match_the_batch(spark, make_events, tmp_path):
    events = flagged(make_events, 5, 150, 30, 20000)
    handler = SI.StreamIncidents(S.new_root(spark))
    edges = [691200 + 2500 * i for i in range(1, 9)]
    S.run_available(in_files(spark, events, str(tmp_path / "in"), edges), handler, handler.root)
    found = C.correlate_incidents(events)
    assert {r.event_id: r.component for r in handler.members(spark).collect()} == {r.event_id: r.component for r in found.collect()}
    members = C.incident_members(events, found)
    want = incident_confidence(incident_risk(C.build_incidents(members, numbered=False)))
    names = ["component", "time_start", "time_end", "event_count", "max_risk", "sum_risk", "sources", "n_users", "n_hosts", "risk_score", "severity", "confidence_score"]
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(*names).collect())
    got = handler.incidents(spark)
    assert rows(got) == rows(want)
    assert spark.read.parquet(f"{handler.root}/merges").count() > 0
    status = {r.component: r.status for r in got.collect()}
    newest = events.agg(F.max("timestamp")).first()[0]
    assert {k for k, v in status.items() if v == "closed"} == {r.component for r in want.collect() if r.time_end < newest - 1200}
    # what is kept is of the last twenty minutes, and of one epoch before
    for table in (handler.runs, handler.totals):
        kept = table.at(spark, len(edges) - 1)
        assert 0 < kept.count() < 40 and kept.agg(F.min(kept.columns[2])).first()[0] >= newest - 1200
    left = spark.read.parquet(f"{handler.root}/totals").select("epoch").distinct().count()
    assert left <= 2
    assert handler.counters(spark).first().closed == sum(v == "closed" for v in status.values())


def test_late_events_join_open_incidents_and_epochs_replay(spark, make_events):
    events = flagged(make_events, 9, 80, 10, 6000)
    # three batches that overlap by less than the allowed lateness
    at, mixed = F.col("timestamp") - 691200, F.col("event_id") % 5 == 0
    part = F.least(F.lit(2), F.floor((at + F.when(mixed, 500).otherwise(0)) / 2000))
    handler = SI.StreamIncidents(S.new_root(spark))
    for epoch in (0, 1, 1, 2, 2):
        handler(events.filter(part == epoch), epoch)
    got = handler.members(spark)
    # ids are of opening events, so compare the groups
    groups = lambda df: sorted(sorted(r.ids) for r in df.groupBy("component").agg(F.collect_list("event_id").alias("ids")).collect())
    assert groups(got) == groups(C.correlate_incidents(events))


def test_features_unite(spark, make_events, tmp_path):
    events = sample(make_events)
    stream = in_files(spark, events, str(tmp_path / "in"), EDGES)
    found = S.run_to_end(lambda s: P.stream_features(X.event_indicators(s)), stream, S.new_root(spark), END)
    names = ["window_id", "total_events", "auth_ntlm", "user", "destination_host", "source_host", "process"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*names).collect())
    batch = lambda size: X.tumbling_features(X.event_indicators(events), size)
    assert rows(P.window_counts(found)) == rows(batch(300))
    assert rows(P.window_counts(P.wider_windows(found, 6))) == rows(batch(1800))


def test_feedback_reaches_later_batches(spark):
    verdict = "seq bigint, incident_id string, verdict string, users array<string>, hosts array<string>, processes array<string>"
    event = "event_id bigint, user string, source_host string, risk_score bigint"
    handler = P.StreamFeedback(S.new_root(spark))

    def batch(epoch, verdicts, users):
        events = spark.createDataFrame([(epoch * 10 + i, u, "h", 4) for i, u in enumerate(users)], event)
        handler(handler.tagged(events, spark.createDataFrame(verdicts, verdict)), epoch)

    batch(0, [(1, "i", "suspicious", ["a"], [], [])], ["a", "b"])
    batch(1, [(2, "i", "benign", ["a"], ["h"], [])], ["a", "b"])
    batch(1, [(2, "i", "benign", ["a"], ["h"], [])], ["a", "b"])  # replayed
    batch(2, [], ["a", "b", None])
    got = sorted((r.epoch, r.user or "", r.listed_risk) for r in handler.scored(spark).collect())
    assert got == [(0, "a", 4), (0, "b", 4), (1, "a", 7), (1, "b", 4), (2, "", 4), (2, "a", 0), (2, "b", 4)]
