"""Queries: streaming forms, run over all available input and read back."""

from functools import lru_cache

from pyspark.sql import functions as F

from sentrylake.operators import features as X
from sentrylake.plans import queries_rules  # noqa: F401  (its SQL fragments are used here)
from sentrylake.plans.fragments import fragment
from sentrylake.plans.registry import register
from sentrylake.sources.driver_tables import canonical_of, event_stream, verdict_log
from sentrylake.streaming import incidents as SI
from sentrylake.streaming import pipelines as P
from sentrylake.streaming import state as S


def arriving(w, squeeze=120):
    return canonical_of(event_stream(w.spark, w.folder), squeeze)


def appended(stream):
    root = S.run_available(stream)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def updated(stream, keys):
    root = S.new_root(stream.sparkSession)
    S.run_available(stream, S.upserts(root), root, mode="update")
    return S.latest_rows(stream.sparkSession, root, keys)


def scored_stream(w):
    return P.stream_score(arriving(w), w.baseline.pairs, w.baseline.processes, w.iocs)


fragment("frozen", """
SELECT event_id, ts, event_type, p + CASE WHEN n >= 2 THEN 2 ELSE 0 END AS risk FROM (
 SELECT *, r1 + r3 + q4 + q5 + r7 + q8 + q9 AS n, 2*r1 + r3 + 2*q4 + 2*q5 + r7 + 3*q8 + 2*q9 AS p FROM (
  SELECT f.*, CAST(coalesce(b.c, 0) <= 2 AS INT) AS q4, CAST(event_type = 'process' AND coalesce(pb.c, 0) < 15 AS INT) AS q5,
   CAST(f.usr IN (SELECT value FROM badu) AS INT) AS q8, CAST(src IN (SELECT value FROM badh) OR coalesce(dst, '') IN (SELECT value FROM badh) AS INT) AS q9
  FROM fired f LEFT JOIN bpairs b ON b.usr = f.usr AND b.host = f.pair_host LEFT JOIN bprocs pb ON pb.proc = f.proc))""",
         "fired", "bpairs", "bprocs", "badu", "badh")
register("stream_score", lambda w: appended(scored_stream(w).select("event_id", "timestamp", "event_type", "risk_score", "is_suspicious")), """
SELECT event_id, ts AS timestamp, event_type, CAST(risk AS BIGINT) AS risk_score, CAST(risk >= 3 AS BIGINT) AS is_suspicious FROM frozen""", ["frozen"])
register("stream_counters", lambda w: updated(P.stream_counters(scored_stream(w)), ["event_type"]), """
SELECT event_type, count(*) AS processed, count(*) FILTER (risk >= 3) AS flagged, CAST(sum(risk) AS BIGINT) AS total_risk, max(ts) AS latest_time FROM frozen GROUP BY 1""", ["frozen"])
register("recent_events", lambda w: P.recent_events(appended(scored_stream(w).select("event_id", "timestamp", "event_type", "risk_score"))), """
SELECT event_id, ts AS timestamp, event_type, CAST(risk AS BIGINT) AS risk_score FROM frozen ORDER BY ts DESC, event_id DESC LIMIT 200""", ["frozen"])
AFTER = 900_000  # a time beyond the last event by more than any lateness


def ended(source, make):
    """All rows of a stream in append mode, the input ended by a heartbeat."""
    return S.run_to_end(make, source, S.new_root(source.sparkSession), AFTER)


def windows(w):
    return ended(arriving(w), lambda stream: P.stream_features(X.event_indicators(stream, w.rare)))


DISTINCT_SQL = """count(DISTINCT usr) AS "user", count(DISTINCT dst) AS destination_host, count(DISTINCT src) AS source_host, count(DISTINCT proc) AS process"""
COUNTED_SQL = "count(*) AS total_events, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in X.COUNTED)
register("stream_features", lambda w: P.window_counts(windows(w)),
         f"SELECT (ts - 691200) // 300 AS window_id, {COUNTED_SQL}, {DISTINCT_SQL} FROM ind GROUP BY 1", ["ind"])
register("stream_features_hourly", lambda w: P.window_counts(P.wider_windows(windows(w), 12)),
         f"SELECT (ts - 691200) // 3600 AS window_id, {COUNTED_SQL}, {DISTINCT_SQL} FROM ind GROUP BY 1", ["ind"])
register("stream_sessions", lambda w: ended(arriving(w), P.stream_sessions), """
SELECT entity_type, entity, min(ts) AS session_start, count(*) AS events, min(ts) AS first_time, max(ts) AS last_time FROM (
 SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_type, entity ORDER BY ts, event_id) AS s FROM
 (SELECT *, lag(ts) OVER (PARTITION BY entity_type, entity ORDER BY ts, event_id) AS prev FROM
  (SELECT DISTINCT event_id, ts, 'user' AS entity_type, usr AS entity FROM ev UNION SELECT event_id, ts, 'host', src FROM ev
   UNION SELECT event_id, ts, 'host', dst FROM ev WHERE dst IS NOT NULL))) GROUP BY entity_type, entity, s""", ["ev"])


def bursts(w):
    logons = arriving(w).filter("event_type = 'auth'")
    found = ended(logons, P.stream_bursts)
    return w.events.filter("event_type = 'auth'").join(found, ["user", "timestamp"]).select("event_id", "user", "timestamp", "n_recent")


register("stream_bursts", bursts, """
SELECT event_id, usr AS "user", ts AS timestamp, n_recent FROM ev JOIN recent_auth USING (event_id) WHERE n_recent > 3""", ["recent_auth"])


@lru_cache(maxsize=4)
def incident_stream(w, batches=6):
    """Candidates in the order of time, a part of the time range a batch."""
    root, table = S.new_root(w.spark), w.candidates
    handler = SI.StreamIncidents(root)
    stream = S.folder_stream(w.spark, f"{root}/input", table.schema)
    low, high = table.agg(F.min("timestamp"), F.max("timestamp")).first()
    part = F.least(F.lit(batches - 1), F.floor((F.col("timestamp") - low) * batches / (high + 1 - low)))
    for k in range(batches if low is not None else 0):
        table.filter(part == k).write.mode("append").parquet(f"{root}/input")
        S.run_available(stream, handler, root)
    return handler


register("stream_incidents", lambda w: incident_stream(w).members(w.spark).select("event_id", "component", "incident_id"), """
SELECT event_id, component, 'INC-' || upper(substr(md5(CAST(component AS VARCHAR)), 1, 12)) AS incident_id FROM comp""", ["comp"], wide=True)
register("stream_incident_rows", lambda w: incident_stream(w).incidents(w.spark).select(
    "component", "time_start", "time_end", "event_count", "n_users", "n_hosts", "n_processes", "max_risk", "sum_risk", "risk_score", "confidence_score", "severity",
    "sources", "agents_involved"), """
SELECT component, t0 AS time_start, t1 AS time_end, n AS event_count, n_users, n_hosts, n_processes, CAST(max_risk AS BIGINT) AS max_risk, sum_risk, risk_score,
 confidence_score, severity, sources, agents AS agents_involved FROM scored""", ["scored"], wide=True)
register("stream_incident_counters", lambda w: incident_stream(w).counters(w.spark), """
SELECT count(*) FILTER (live) AS active, count(*) FILTER (live AND severity = 'Critical') AS active_critical, count(*) FILTER (live AND severity = 'High') AS active_high,
 count(*) FILTER (NOT live) AS closed, CAST(sum(n) AS BIGINT) AS events FROM (SELECT *, t1 >= (SELECT max(ts) FROM cand) - 1200 AS live FROM scored)""", ["scored"], wide=True)


@lru_cache(maxsize=4)
def feedback_stream(w, batches=3):
    """Three batches of events and verdicts: by time, and by the place in the log."""
    root = S.new_root(w.spark)
    events = w.triaged.select("event_id", "timestamp", "user", "source_host", "risk_score")
    verdicts = verdict_log(w.spark, w.folder)
    read = lambda name, df: S.folder_stream(w.spark, f"{root}/{name}", df.schema)
    stream = P.StreamFeedback.tagged(read("events", events), read("verdicts", verdicts))
    handler = P.StreamFeedback(root)
    turn = F.when(F.col("timestamp") < 702000, 0).when(F.col("timestamp") < 707400, 1).otherwise(2)
    for k in range(batches):
        events.filter(turn == k).write.mode("append").parquet(f"{root}/events")
        verdicts.filter(F.col("seq") % batches == k).write.mode("append").parquet(f"{root}/verdicts")
        S.run_available(stream, handler, root)
    return handler


fragment("lists_at", "SELECT b, type, value, arg_max(lst, seq) AS lst FROM (SELECT seq, lst, 'user' AS type, usr AS value FROM verd UNION ALL "
         "SELECT seq, lst, 'host', host FROM verd), (SELECT unnest([0, 1, 2]) AS b) WHERE lst IS NOT NULL AND seq % 3 < b GROUP BY 1, 2, 3", "verd")
register("stream_feedback", lambda w: feedback_stream(w).scored(w.spark).select("event_id", "risk_score", "listed_risk"), """
SELECT event_id, CAST(risk AS BIGINT) AS risk_score, CAST(CASE WHEN u.lst = 'safe' THEN 0 ELSE risk + CASE WHEN u.lst = 'watch' THEN 3 ELSE 0 END
 + CASE WHEN h.lst = 'watch' THEN 2 ELSE 0 END END AS BIGINT) AS listed_risk
FROM (SELECT *, CASE WHEN ts < 702000 THEN 0 WHEN ts < 707400 THEN 1 ELSE 2 END AS b FROM triaged) t
LEFT JOIN lists_at u ON u.b = t.b AND u.type = 'user' AND u.value = t.usr LEFT JOIN lists_at h ON h.b = t.b AND h.type = 'host' AND h.value = t.src""", ["triaged", "lists_at"])
register("stream_feedback_lists", lambda w: feedback_stream(w).versions.at(w.spark, 2).drop("seq"),
         "SELECT type, value, lst AS list FROM learned", ["learned"])
SLICES = {"night": (691200, 694800), "morning": (698400, 705600)}
register("scenario_slice", lambda w: appended(P.scenario_slice(arriving(w), "morning", SLICES).select("event_id", "timestamp", "user")), """
SELECT event_id, ts AS timestamp, usr AS "user" FROM ev WHERE ts BETWEEN 698400 AND 705600""", ["ev"])
