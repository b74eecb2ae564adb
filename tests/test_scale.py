"""Building blocks and plans under hot keys, shuffled input and odd partition counts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sentrylake.functions.scale import gap_segments, number_rows, recent_counts, running_totals, top_k_per_group
from sentrylake.operators import baselines as B
from sentrylake.operators import correlate as C
from sentrylake.operators import features as X
from sentrylake.operators import specialists as S
from sentrylake.operators import triage as T
from sentrylake.plans.workspace import workspace


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows belong to one key; many ties; gaps on both sides of the limits."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"
        rows.append((i, key, rng.choice([rng.randrange(0, 9000), rng.randrange(0, 90000), 3600, 3599])))
    return rows, spark.createDataFrame(rows, "event_id bigint, user string, timestamp bigint").repartition(7)


def by_key(rows):
    out = defaultdict(list)
    for _, k, t in rows:
        out[k].append(t)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seconds,block", [(300, 3600), (300, 10), (0, 5), (5000, 3600)])
def test_recent_counts_equals_brute_force(hot, seconds, block):
    rows, df = hot
    got = {(r.user, r.timestamp): r.n_recent for r in recent_counts(df, ["user"], seconds, block=block).collect()}
    want = {(k, t): sum(1 for x in ts if t - seconds <= x <= t) for k, ts in by_key(rows).items() for t in ts}
    assert got == want


def test_recent_counts_edges(spark):
    ts = [1000, 1000, 1300, 1301, 1600, 1601]
    df = spark.createDataFrame([("u", t) for t in ts] + [(None, 5)], "user string, timestamp bigint")
    got = {r.timestamp: r.n_recent for r in recent_counts(df, ["user"], 300).collect()}
    assert got == {1000: 2, 1300: 3, 1301: 2, 1600: 3, 1601: 3}


@pytest.mark.parametrize("gap,block", [(600, 86400), (600, 50), (0, 7), (40, 100)])
def test_gap_segments_equals_brute_force(hot, gap, block):
    rows, df = hot
    got = {(r.user, r.timestamp): (r.previous, r.segment) for r in gap_segments(df, ["user"], gap, block=block).collect()}
    want = {}
    for k, ts in by_key(rows).items():
        prev = seg = None
        for t in sorted(set(ts)):
            seg = t if prev is None or t - prev > gap else seg
            want[(k, t)] = (prev, seg)
            prev = t
    assert got == want


def test_top_k_running_totals_and_numbers(hot):
    rows, df = hot
    got = sorted((r.user, r.timestamp, r.event_id) for r in
                 top_k_per_group(df, ["user"], [F.col("timestamp"), F.col("event_id")], 5, salts=4).collect())
    want = []
    for k in by_key(rows):
        mine = sorted((t, i) for i, u, t in rows if u == k)[:5]
        want += [(k, t, i) for t, i in mine]
    assert got == sorted(want)
    totals = running_totals(df.select("event_id", "timestamp"), [F.col("event_id")], ["timestamp"])
    run, expect = 0, {}
    for i, _, t in rows:
        run += t
        expect[i] = run
    assert {r.event_id: r.cum_timestamp for r in totals.collect()} == expect
    numbers = {r.event_id: r.row_number for r in number_rows(df, [F.col("timestamp"), F.col("event_id")]).collect()}
    order = [i for _, i in sorted((t, i) for i, _, t in rows)]
    assert numbers == {i: n for n, i in enumerate(order, start=1)}


def greedy(ts, size=300):
    counts, start, n = [], ts[0], 0
    for t in ts:
        if t - start <= size:
            n += 1
        else:
            counts.append(n)
            start, n = t, 1
    return counts + [n]


def test_auth_velocity_equals_sequential_windows(hot, spark):
    rows, df = hot
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        events = df.withColumn("event_type", F.lit("auth"))
        got = {r.user: (r.mean, r.std) for r in B.auth_velocity(events).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(by_key(rows))
    for k, ts in by_key(rows).items():
        c = greedy(ts)
        mean = sum(c) / len(c)
        std = (sum((x - mean) ** 2 for x in c) / len(c)) ** 0.5 if len(c) > 1 else mean * 0.5
        want = (1.0, 0.5) if len(ts) == 1 else (mean, max(0.5, std))
        assert got[k] == pytest.approx(want)


@pytest.mark.parametrize("ts,want", [
    ([5], (1.0, 0.5)), ([5, 6], (2.0, 1.0)), ([0, 300], (2.0, 1.0)), ([0, 301], (1.0, 0.5)),
    ([0, 200, 400, 600, 800], (5 / 3, 0.5)),
])
def test_auth_velocity_hand_cases(make_events, ts, want):
    events = make_events([{"event_type": "auth", "timestamp": t, "user": "u"} for t in ts])
    row = B.auth_velocity(events).first()
    assert (row.mean, row.std) == pytest.approx(want)


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(600)],
    [(0, i) for i in range(1, 300)] + [(i, i + 1000) for i in range(1, 300)],
    [(random.Random(1).randrange(400), random.Random(i).randrange(400)) for i in range(380)],
    [(999 - i, 998 - i) for i in range(0, 200, 2)] + [(5, 5)],
])
def test_components_equal_union_find(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {r.node: r.component for r in C.connected_components(df).collect()}
    want = {n: c for n, c in union_find(edges).items() if n != c}
    assert got == want


def brute_correlation(rows, gap):
    """rows: (id, ts, entities). Consecutive events of an entity within the gap are linked."""
    per = defaultdict(list)
    for i, t, es in rows:
        for e in es:
            per[e].append((t, i))
    edges = [(i, i) for i, _, _ in rows]
    for seen in per.values():
        seen.sort()
        edges += [(a[1], b[1]) for a, b in zip(seen, seen[1:]) if b[0] - a[0] <= gap]
    return union_find(edges)


def test_correlation_is_right_and_ignores_order(spark, make_events):
    rng = random.Random(3)
    raw = []
    for i in range(700):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(60)}"
        raw.append({"event_id": i, "event_type": "auth", "timestamp": i * 37 + rng.randrange(30), "user": rng.choice([user, None, "nan"]),
                    "source_host": rng.choice([None, f"h{rng.randrange(90)}"]), "destination_host": None})
    want = brute_correlation(
        [(r["event_id"], r["timestamp"], [("u", r["user"])] * (r["user"] not in (None, "nan")) + [("h", r["source_host"])] * (r["source_host"] is not None))
         for r in raw], 600)
    first = {r.event_id: r.component for r in C.correlate_incidents(make_events(raw)).collect()}
    assert first == want
    rng.shuffle(raw)
    again = {r.event_id: r.component for r in C.correlate_incidents(make_events(raw).repartition(13)).collect()}
    assert again == want


@pytest.mark.parametrize("times,users,groups", [
    ([0, 600], ["a", "a"], 1), ([0, 601], ["a", "a"], 2), ([0, 0, 100], ["a", "b", None], 3),
])
def test_correlation_gap_edges(make_events, times, users, groups):
    events = make_events([{"event_type": "auth", "timestamp": t, "user": u} for t, u in zip(times, users)])
    assert C.correlate_incidents(events).select("component").distinct().count() == groups


def test_bridge_event_joins_two_incidents(make_events):
    events = make_events([
        {"event_type": "auth", "timestamp": 0, "user": "a"}, {"event_type": "auth", "timestamp": 10, "user": "b"},
        {"event_type": "auth", "timestamp": 20, "user": "a", "destination_user": "b"},
    ])
    assert {r.component for r in C.correlate_incidents(events).collect()} == {0}


def test_graph_clusters_equal_brute_force(spark, folder):
    events = workspace(spark, folder).events
    rows = [(r.event_id, r.timestamp, {("u", r.user), ("h", r.source_host)} | ({("h", r.destination_host)} if r.destination_host else set()))
            for r in events.collect()]
    comp = brute_correlation(rows, 60)
    groups = defaultdict(list)
    for i, t, es in rows:
        groups[comp[i]].append((t, {e for e in es if e[0] == "h"}))
    want = {c: (len(v), min(t for t, _ in v), max(t for t, _ in v), len(set.union(*[h for _, h in v]))) for c, v in groups.items()}
    want = {c: v for c, v in want.items() if v[0] >= 3 and v[3] >= 2}
    got = {r.component: (r.event_count, r.time_start, r.time_end, r.host_count) for r in C.graph_alert_clusters(events, gap=60).collect()}
    assert got == want and len(got) > 1


# ---- plans ---------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_task_step_over_events(spark, folder):
    w = workspace(spark, folder)
    for df in (T.triage(w.events), X.tumbling_features(w.indicated), X.host_window_features(w.events),
               C.event_entities(w.events), B.pair_frequency(w.events), S.auth_specialist(w.events, w.baseline, w.iocs)):
        plan = plan_of(df)
        assert "SinglePartition" not in plan
        assert "CartesianProduct" not in plan


def test_joins_of_rules_are_keyed(spark, folder):
    w = workspace(spark, folder)
    assert "NestedLoop" not in plan_of(T.triage(w.events))
    # the specialist meets only its one-row threshold without a key
    assert plan_of(S.auth_specialist(w.events, w.baseline, w.iocs)).count("BroadcastNestedLoopJoin") == 1


def test_shared_steps_read_parsed_events(spark, folder):
    w = workspace(spark, folder)
    assert "get_json_object" not in plan_of(w.indicated) + plan_of(S.all_findings(w.stored, w.baseline, w.iocs))


def test_events_without_a_process_are_spread(spark, make_events):
    events = make_events([{"event_type": "auth", "timestamp": i, "user": f"u{i}"} for i in range(2000)])
    rare = spark.createDataFrame([("p",)], "process string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in X.event_indicators(events, rare).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_windows_without_time_or_values(make_events):
    rows = [{"timestamp": t, "event_type": "auth", "user": u, "source_host": "h"} for t, u in ((None, "a"), (None, "b"), (691200, None), (691201, "a"))]
    got = {r.window_id: r for r in X.tumbling_features(X.event_indicators(make_events(rows))).collect()}
    assert {k: (r.total_events, r.user, r.source_host, r.process, r.is_auth) for k, r in got.items()} == {None: (2, 2, 1, 0, 2), 0: (2, 1, 1, 0, 2)}


def test_segments_do_not_pass_through_the_driver(hot):
    assert "BroadcastHashJoin" not in plan_of(gap_segments(hot[1], ["user"], 600))


def test_filters_and_columns_reach_the_scan(spark, folder):
    src = spark.read.parquet(f"{folder}/events.parquet")
    from sentrylake.sources.driver_tables import canonical_of

    plan = plan_of(B.pair_frequency(canonical_of(src)))
    read = [line for line in plan.splitlines() if "FileScan" in line]
    assert read and all("value" not in line.split("ReadSchema")[1] for line in read)


def test_burst_window_partitions_are_bounded(spark):
    """One key, one second apart for ten hours: no window partition above block + reach."""
    df = spark.range(36000).select(F.when(F.col("id") >= 0, "hot").otherwise("none").alias("user"), F.col("id").alias("timestamp"))
    plan = plan_of(recent_counts(df, ["user"], 300))
    assert "hashpartitioning(user" in plan and "_block" in plan
    assert recent_counts(df, ["user"], 300).agg(F.max("n_recent")).first()[0] == 301


def test_group_quantiles_equal_numpy(spark):
    import numpy as np
    from sentrylake.functions.scale import group_quantiles

    rng = random.Random(2)
    rows = [(g, float(rng.randrange(50)), rng.randrange(1, 5)) for g in "ab" for _ in range(60)] + [("c", 3.5, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int").groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = {r.g: (r.q1, r.q2, r.q3) for r in group_quantiles(df, ["g"], "v", "w", {"q1": 0.05, "q2": 0.5, "q3": 0.9}).collect()}
    for g in "abc":
        values = [v for k, v, w in rows if k == g for _ in range(w)]
        assert got[g] == pytest.approx(tuple(np.percentile(values, [5, 50, 90])))


def random_spans(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(0, 400_000)
        out.append((i, a, a + rng.choice([0, 30, 700, 20_000, 350_000])))
    return out


def test_window_overlap_equals_brute_force(spark):
    from sentrylake.operators.evaluate import windows_with_spans

    spans = random_spans(4, 25)
    windows = [(i, i * 900, i * 900 + random.Random(i).randrange(600)) for i in range(900)]
    got = {r.window_id for r in windows_with_spans(
        spark.createDataFrame(windows, "window_id bigint, t_start bigint, t_end bigint"),
        spark.createDataFrame([s[1:] for s in spans if s[2] - s[1] < 30_000], "time_start bigint, time_end bigint")).collect()}
    want = {w for w, a, b in windows if any(not (e < a or s > b) for _, s, e in spans if e - s < 30_000)}
    assert got == want and 0 < len(got) < len(windows)


def test_label_match_equals_brute_force(spark, make_events):
    from sentrylake.operators.evaluate import match_labels

    spans = random_spans(9)
    rng = random.Random(1)
    members = spark.createDataFrame([(i, t) for i, a, b in spans for t in {a, b}], "component bigint, timestamp bigint")
    users = {i: {rng.choice(["hot", f"u{rng.randrange(9)}"])} for i, _, _ in spans}
    bridge = spark.createDataFrame([(i, "user", u) for i, us in users.items() for u in us], "component bigint, entity_type string, entity string")
    labels = [{"event_id": i, "timestamp": rng.randrange(0, 800_000), "user": rng.choice(["hot", "u1", "u2", "none"])} for i in range(200)]
    labels += [{"event_id": 1000 + i, "timestamp": spans[i][2] + d, "user": "hot"} for i, d in enumerate([0, 1, 59, 60, 61, 600, 601])]
    got = {(r.tolerance, r.event_id, r.component) for r in match_labels(make_events(labels), members, bridge).collect()}
    want = {(t, l["event_id"], i) for t in (0, 60, 300, 600) for l in labels for i, a, b in spans
            if a - t <= l["timestamp"] <= b + t and l["user"] in users[i]}
    assert got == want and got
