"""Queries: correlation, incidents, scoring, review and documented variants."""

from functools import partial

from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import gap_segments
from sentrylake.operators import baselines as B
from sentrylake.operators import correlate as C
from sentrylake.operators import incidents as I
from sentrylake.operators import lists as L
from sentrylake.operators import variants as VA
from sentrylake.plans import queries_rules  # noqa: F401  (its SQL fragments are used here)
from sentrylake.plans.fragments import SCORED, fragment
from sentrylake.plans import registry
from sentrylake.sources.driver_tables import verdict_log

# every query here runs in real time, over thirty days, on all rules and both hosts
register = partial(registry.register, wide=True)

# ---- correlation ---------------------------------------------------------------------------

register("collect_candidates", lambda w: C.collect_candidates(
    w.findings.unionByName(w.findings.filter("risk_score >= 6").withColumn("agent", F.lit(V.PROCESS_AGENT)))).select(
    "event_id", "agent", "risk_score"), """
SELECT event_id, min_by(agent, CASE agent WHEN 'AuthenticationAgent' THEN 1 WHEN 'ProcessAgent' THEN 2 ELSE 3 END) AS agent, CAST(any_value(risk) AS BIGINT) AS risk_score
FROM (SELECT event_id, agent, risk FROM finds UNION ALL SELECT event_id, 'ProcessAgent', risk FROM finds WHERE risk >= 6) GROUP BY 1""", ["finds"])
register("event_entities", lambda w: C.event_entities(w.events), """
SELECT DISTINCT event_id, ts AS timestamp, 'user' AS entity_type, usr AS entity FROM ev UNION SELECT event_id, ts, 'host', src FROM ev
UNION SELECT event_id, ts, 'host', dst FROM ev WHERE dst IS NOT NULL""", ["ev"])
fragment("usec", "SELECT DISTINCT usr, ts FROM ev", "ev")
register("gap_segments", lambda w: gap_segments(w.events, ["user"], 300, block=1800), """
SELECT usr AS "user", ts AS timestamp, prev AS previous, max(CASE WHEN prev IS NULL OR ts - prev > 300 THEN ts END) OVER (PARTITION BY usr ORDER BY ts) AS segment
FROM (SELECT *, lag(ts) OVER (PARTITION BY usr ORDER BY ts) AS prev FROM usec)""", ["usec"])
register("correlate_incidents", lambda w: C.correlate_incidents(w.candidates), "SELECT event_id, component FROM comp", ["comp"])
sweep = " UNION ALL ".join(
    f"SELECT CAST({g} AS BIGINT) AS gap_seconds, count(*) AS incidents, CAST(sum(n) AS BIGINT) AS events, max(n) AS largest FROM (SELECT count(*) AS n FROM {p}mem GROUP BY component)"
    for g, p in ((300, "g300_"), (600, ""), (1800, "g1800_")))
register("correlation_window_sweep", lambda w: C.correlation_sweep(w.candidates), sweep, ["g300_mem", "mem", "g1800_mem"])
register("filter_incidents", lambda w: C.filter_incidents(w.members.groupBy("component").agg(
    F.count("*").alias("event_count"), F.max("risk_score").alias("max_risk")), 4, 7), """
SELECT component, count(*) AS event_count, CAST(max(risk) AS BIGINT) AS max_risk FROM mem GROUP BY 1 HAVING count(*) >= 4 OR max(risk) >= 7""", ["mem"])
register("incident_members", lambda w: w.members.select("event_id", "component", "risk_score"),
         "SELECT event_id, component, CAST(risk AS BIGINT) AS risk_score FROM mem", ["mem"])
register("incident_entities", lambda w: w.bridge, "SELECT * FROM bridge", ["bridge"])
register("build_incidents", lambda w: w.incidents.select(
    "incident_id", "component", "time_start", "time_end", "duration_sec", "event_count", "n_users", "n_hosts", "n_processes", "sources",
    "agents_involved", "is_multi_agent", "max_risk", "sum_risk"), """
SELECT incident_id, component, t0 AS time_start, t1 AS time_end, dur AS duration_sec, n AS event_count, n_users, n_hosts, n_processes, sources, agents AS agents_involved,
  CAST(n_agents > 1 AS BIGINT) AS is_multi_agent, CAST(max_risk AS BIGINT) AS max_risk, sum_risk FROM inc""", ["inc"])
register("incident_base_risk", lambda w: C.incident_base_risk(w.incidents).select("component", "base_risk"), """
SELECT component, CAST(least(100, trunc(max_risk * 5 + greatest(0, sum_risk - max_risk) * 0.4::DOUBLE + n_sources * 5)) AS BIGINT) AS base_risk FROM inc""", ["inc"])
register("incident_progression", lambda w: C.incident_progression(w.members), """
SELECT component, progression, signals FROM
 (SELECT component, string_agg(upper(event_type), ' -> ' ORDER BY f) AS progression FROM
   (SELECT component, event_type, min(ts * 100000000 + event_id) AS f FROM mem GROUP BY 1, 2) GROUP BY 1)
 LEFT JOIN (SELECT component, string_agg(reason, '; ' ORDER BY reason) AS signals FROM
   (SELECT *, row_number() OVER (PARTITION BY component ORDER BY reason) AS rn FROM
     (SELECT DISTINCT component, unnest(string_split(reasons, ' | ')) AS reason FROM mem)) WHERE rn <= 3 GROUP BY 1) USING (component)""", ["mem"])
register("incident_timeline", lambda w: C.incident_timeline(w.members, 5).select(
    "component", "position", "event_id", "timestamp", "event_type", "user", "risk_score", "agent"), """
SELECT component, position, event_id, ts AS timestamp, event_type, usr AS "user", CAST(risk AS BIGINT) AS risk_score, agent FROM
 (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts, event_id) AS position FROM mem) WHERE position <= 5""", ["mem"])
register("timeline_lists", lambda w: C.timeline_lists(w.members, 10).select("component", F.transform("timeline", lambda x: x["event_id"].cast("string")).alias("event_ids")), """
SELECT component, string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY ts, event_id) AS event_ids FROM
 (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts, event_id) AS rn FROM mem) WHERE rn <= 10 GROUP BY 1""", ["mem"])
register("multi_agent_flag", lambda w: w.incidents.filter("is_multi_agent = 1").select("component", "agents_involved"),
         "SELECT component, agents AS agents_involved FROM inc WHERE n_agents > 1", ["inc"])
register("alert_reduction", lambda w: C.alert_reduction(w.candidates, w.incidents), """
SELECT e AS events, i AS incidents, CAST(m AS BIGINT) AS multi_agent_incidents, round((e - i) / e * 100, 2) AS reduction_percent FROM
 (SELECT (SELECT count(*) FROM cand) AS e, count(*) AS i, sum(CAST(n_agents > 1 AS INT)) AS m FROM inc)""", ["inc"])
register("correlation_summary", lambda w: C.correlation_summary(w.incidents), """
SELECT count(*) AS incidents, CAST(sum(n) AS BIGINT) AS events, count(*) FILTER (n_sources >= 2) AS multi_source, round(avg(t1 - t0), 1) AS mean_duration,
  round(avg(n), 1) AS mean_events FROM inc""", ["inc"])
# all events, linked by their real users and hosts: minimum labels spread over the links
fragment("gent", "SELECT event_id, ts, 'u' || usr AS e FROM ev UNION ALL SELECT event_id, ts, 'h' || src FROM ev UNION ALL "
         "SELECT event_id, ts, 'h' || dst FROM ev WHERE dst IS NOT NULL AND dst <> src", "ev")
fragment("gnxt", "SELECT event_id AS a, lead(event_id) OVER w AS b, lead(ts) OVER w - ts AS gap FROM gent WINDOW w AS (PARTITION BY e ORDER BY ts, event_id)", "gent")


def graph_query(name, gap):
    lnk, cc = f"glnk{gap}", f"gcc{gap}"
    fragment(lnk, f"SELECT a, b FROM gnxt WHERE gap <= {gap} UNION SELECT b, a FROM gnxt WHERE gap <= {gap}", "gnxt")
    fragment(f"{cc}(n, m) USING KEY (n)", f"SELECT event_id, event_id FROM ev UNION SELECT l.b, min(r.m) FROM {cc} r JOIN {lnk} l ON l.a = r.n "
             f"JOIN recurring.{cc} p ON p.n = l.b WHERE r.m < p.m GROUP BY l.b", lnk)
    register(name, lambda w: C.graph_alert_clusters(w.events, gap=gap), f"""
SELECT m AS component, count(*) AS event_count, min(ts) AS time_start, max(ts) AS time_end, any_value(h) AS host_count FROM {cc} JOIN ev ON event_id = n
JOIN (SELECT m, count(DISTINCT e) AS h FROM {cc} JOIN gent ON event_id = n WHERE e LIKE 'h%' GROUP BY 1) USING (m) GROUP BY 1 HAVING count(*) >= 3 AND any_value(h) >= 2""",
             [f"{cc}(n, m) USING KEY (n)"])


graph_query("graph_alert_clusters", 600)
graph_query("graph_alert_clusters_short_gap", 60)

# ---- the whole chain on specialist findings, real users and both hosts ---------------------------

fragment("icand", "SELECT f.agent, f.risk, f.rules, e.event_id, e.ts, e.event_type, e.usr, e.src, e.dst, e.proc FROM finds f JOIN ev e USING (event_id)", "finds", "ev")
fragment("ient", "SELECT event_id, ts, 'u' || usr AS e FROM icand UNION ALL SELECT event_id, ts, 'h' || src FROM icand UNION ALL "
         "SELECT event_id, ts, 'h' || dst FROM icand WHERE dst IS NOT NULL AND dst <> src", "icand")
fragment("inxt", "SELECT event_id AS a, lead(event_id) OVER w AS b, lead(ts) OVER w - ts AS gap FROM ient WINDOW w AS (PARTITION BY e ORDER BY ts, event_id)", "ient")
fragment("ilnk", "SELECT a, b FROM inxt WHERE gap <= 600 UNION SELECT b, a FROM inxt WHERE gap <= 600", "inxt")
fragment("icc(n, m) USING KEY (n)", "SELECT event_id, event_id FROM icand UNION SELECT l.b, min(r.m) FROM icc r JOIN ilnk l ON l.a = r.n "
         "JOIN recurring.icc p ON p.n = l.b WHERE r.m < p.m GROUP BY l.b", "ilnk")
fragment("imem", "SELECT c.*, m AS component FROM icand c JOIN icc ON n = event_id WHERE m IN (SELECT m FROM icc JOIN icand ON n = event_id GROUP BY 1 "
         "HAVING count(*) >= 3 OR max(risk) >= 5)", "icc(n, m) USING KEY (n)")
fragment("iinc", """
SELECT component, min(ts) AS t0, max(ts) AS t1, greatest(1, max(ts) - min(ts)) AS dur, count(*) AS n, max(risk) AS max_risk, CAST(sum(risk) AS BIGINT) AS sum_risk,
  count(DISTINCT event_type) AS n_sources, count(DISTINCT agent) AS n_agents, count(DISTINCT usr) AS n_users, any_value(h) AS n_hosts, count(DISTINCT proc) AS n_processes,
  0 AS has_burst
FROM imem JOIN (SELECT component, count(DISTINCT e) AS h FROM imem JOIN ient USING (event_id) WHERE e LIKE 'h%' GROUP BY 1) USING (component) GROUP BY component""", "imem")
fragment("iscored", SCORED % "iinc", "iinc")
register("investigation", lambda w: w.full.responses.select(
    "component", "time_start", "time_end", "event_count", "n_users", "n_hosts", "n_processes", "max_risk", "sum_risk", "risk_score", "confidence_score", "severity"), """
SELECT component, t0 AS time_start, t1 AS time_end, n AS event_count, n_users, n_hosts, n_processes, CAST(max_risk AS BIGINT) AS max_risk, sum_risk, risk_score,
  confidence_score, severity FROM iscored""", ["iscored"])

# ---- incident scoring and review ----------------------------------------------------------------

register("incident_risk", lambda w: w.scored.select("component", "risk_score"), "SELECT component, risk_score FROM scored", ["scored"])
register("incident_risk_v1", lambda w: w.scored.select("component", "risk_v1", "risk_level"), "SELECT component, risk_v1, risk_level FROM scored", ["scored"])
register("incident_confidence", lambda w: w.scored.select("component", "confidence_score"), "SELECT component, confidence_score FROM scored", ["scored"])
register("incident_confidence_v1", lambda w: w.scored.select("component", "confidence_v1"), "SELECT component, confidence_v1 FROM scored", ["scored"])
register("severity", lambda w: I.severity_distribution(w.scored), "SELECT severity, count(*) AS incidents FROM scored GROUP BY 1", ["scored"])
register("confidence_level", lambda w: w.scored.groupBy("confidence_level").agg(F.count("*").alias("incidents")),
         "SELECT confidence_level, count(*) AS incidents FROM scored GROUP BY 1", ["scored"])
register("incident_evidence", lambda w: I.incident_evidence(w.members), """
SELECT component, string_agg(t, ';' ORDER BY rn) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY f, t) AS rn FROM
 (SELECT component, t, min(ts * 10000000000 + event_id * 100 + i) AS f FROM (SELECT component, ts, event_id, unnest(string_split(reasons, ' | ')) AS t,
   generate_subscripts(string_split(reasons, ' | '), 1) AS i FROM mem) GROUP BY 1, 2)) WHERE rn <= 8 GROUP BY 1""", ["mem"])
register("uncertainty_notes", lambda w: I.uncertainty_notes(w.scored).select("component", F.array_join("uncertainty", " | ").alias("notes")), """
SELECT component, concat_ws(' | ',
 CASE WHEN n_sources <= 1 THEN 'Single-telemetry source: lack of cross-domain corroboration limits validation confidence.' END,
 CASE WHEN n_processes = 0 AND contains(sources, 'auth') THEN 'Absence of process execution telemetry: command-line parameters and execution lineage could not be verified.' END,
 CASE WHEN contains(sources, 'dns') AND NOT contains(sources, 'flow') THEN 'DNS query observed without corresponding network flow volume confirmation.' END,
 'Classification is based on behavioral anomaly detection and multi-source corroboration.') AS notes FROM scored""", ["scored"])
fragment("shown", """
SELECT *, array_to_string(list_slice(string_split(users, ';'), 1, 3), ', ') || CASE WHEN n_users > 3 THEN ' (+' || (n_users - 3) || ' more)' ELSE '' END AS u3,
 array_to_string(list_slice(string_split(hosts, ';'), 1, 3), ', ') || CASE WHEN n_hosts > 3 THEN ' (+' || (n_hosts - 3) || ' more)' ELSE '' END AS h3,
 array_to_string(list_slice(string_split(users, ';'), 1, 4), ', ') AS u4, array_to_string(list_slice(string_split(hosts, ';'), 1, 4), ', ') AS h4,
 array_to_string(list_slice(string_split(users, ';'), 1, 3), ', ') AS u3p, array_to_string(list_slice(string_split(hosts, ';'), 1, 3), ', ') AS h3p,
 upper(replace(sources, ';', ' -> ')) AS flow FROM scored""", "scored")
register("incident_narrative", lambda w: I.incident_narrative(w.scored, w.heads).select("component", "explanation"), """
SELECT component, CASE WHEN risk_score >= 60 THEN 'Incident ' || incident_id || ' is an elevated cross-domain anomaly (' || severity || ' severity, Risk ' ||
  printf('%.1f', risk_score) || '/100) involving ' || u3 || ' on ' || h3 || '. Specialist agents flagged abnormal burst velocity and rare entity mappings across ' || flow ||
  '. Behavioral anomaly detection indicates potential threat activity warranting SOC analyst verification.'
 ELSE 'Incident ' || incident_id || ' displays moderate anomalous signals (Risk ' || printf('%.1f', risk_score) || '/100, Confidence ' ||
  printf('%.1f', confidence_score) || '/100) involving ' || u3 || '. Specialist findings indicate isolated baseline deviations without confirmed malicious lateral penetration.' END AS explanation
FROM shown""", ["shown"])
register("response_priority", lambda w: I.response_priority(w.scored, w.heads).select(
    "component", "priority", "recommended_action", F.array_join("investigation_steps", " | ").alias("steps"),
    F.array_join("containment_steps", " | ").alias("containment"), "requires_human_approval"), """
SELECT component, CASE WHEN risk_score >= 80 THEN 'P1 - Critical / Urgent' WHEN risk_score >= 60 THEN 'P2 - High Priority' WHEN risk_score >= 35 THEN 'P3 - Medium Priority' ELSE 'P4 - Low / Informational' END AS priority,
 CASE WHEN risk_score >= 75 THEN 'Immediate Analyst Escalation & Endpoint Isolation Staging' WHEN risk_score >= 50 THEN 'Tier-2 SOC Analyst Review & Target Host Monitoring' ELSE 'Automated Telemetry Logging & Baseline Tracking' END AS recommended_action,
 concat_ws(' | ', 'Audit active sessions and recent authentication logs for accounts: ' || u4, 'Inspect host event logs, volatile memory, and active processes on endpoints: ' || h4,
  CASE WHEN contains(sources, 'process') THEN 'Collect parent-child process execution trees and verify cryptographic file hashes.' END,
  CASE WHEN contains(sources, 'flow') OR contains(sources, 'dns') THEN 'Review network flow egress logs and DNS sinkhole captures for command-and-control beacons.' END) AS steps,
 CASE WHEN risk_score >= 75 THEN 'Stage immediate network segment isolation for compromised hosts: ' || h3p || ' (pending analyst sign-off). | Prepare administrative credential suspension for compromised accounts: ' || u3p || '. | Revoke active Kerberos ticket-granting tickets (TGT) and force credential rotation.'
  WHEN risk_score >= 50 THEN 'Increase telemetry sampling frequency and enable enhanced PowerShell / process logging on involved hosts. | Place affected user accounts on high-alert monitoring watchlists.'
  ELSE 'Log anomalous behavioral pattern to baseline profile for continuous anomaly drift tracking.' END AS containment, CAST(1 AS BIGINT) AS requires_human_approval
FROM shown""", ["shown"])
register("priority_distribution", lambda w: I.priority_distribution(I.response_priority(w.scored, w.heads)), """
SELECT CASE WHEN risk_score >= 80 THEN 'P1 - Critical / Urgent' WHEN risk_score >= 60 THEN 'P2 - High Priority' WHEN risk_score >= 35 THEN 'P3 - Medium Priority' ELSE 'P4 - Low / Informational' END AS priority,
 count(*) AS incidents FROM scored GROUP BY 1""", ["scored"])
register("rank_incidents", lambda w: I.rank_incidents(w.scored, 10).select("component", "risk_score", "confidence_score"),
         "SELECT component, risk_score, confidence_score FROM scored ORDER BY risk_score DESC, confidence_score DESC, component LIMIT 10", ["scored"])
register("risk_confidence_crosstab", lambda w: I.risk_confidence_crosstab(w.scored), """
SELECT coalesce(risk_level, 'All') AS risk_level, coalesce(confidence_level, 'All') AS confidence_level, count(*) AS incidents
FROM scored GROUP BY CUBE (risk_level, confidence_level)""", ["scored"])
fragment("queue", """
SELECT *, CASE WHEN risk_level IN ('Critical', 'High') AND confidence_level IN ('High', 'Medium') THEN 'Review Required'
 WHEN confidence_level = 'Low' AND risk_v1 >= 40 THEN 'Needs More Investigation' WHEN risk_level = 'Low' THEN 'Benign / False Positive' ELSE 'Review Required' END AS review_status FROM scored""", "scored")
register("review_queue", lambda w: I.review_queue(w.scored).select("component", "review_status"), "SELECT component, review_status FROM queue", ["queue"])
register("review_counts", lambda w: I.review_counts(I.review_queue(w.scored)), "SELECT review_status, count(*) AS incidents FROM queue GROUP BY 1", ["queue"])
STATUS = """CASE WHEN risk_score >= 75 THEN 'CRITICAL - Immediate Analyst Review Required' WHEN risk_score >= 50 THEN 'ELEVATED SUSPICION - Secondary Triage Required'
 ELSE 'LOW PRIORITY - Routine Background Correlation' END"""
register("incident_status", lambda w: I.incident_status(w.scored).select("component", "status"), f"SELECT component, {STATUS} AS status FROM scored", ["scored"])
register("search_incidents", lambda w: I.search_incidents(I.review_queue(w.scored), w.bridge, "u12", status="Needs More Investigation").select("component"), """
SELECT component FROM queue WHERE review_status = 'Needs More Investigation' AND (contains(lower(incident_id), 'u12') OR contains(lower(users), 'u12')
 OR contains(lower(hosts), 'u12') OR contains(lower(sources), 'u12'))""", ["queue"])
register("incident_report", lambda w: I.incident_report(w.scored, w.members), f"""
SELECT component, {STATUS} AS status, section, CAST(position AS BIGINT) AS position, line FROM
 (SELECT component, risk_score FROM scored ORDER BY risk_score DESC, confidence_score DESC, component LIMIT 25) JOIN
 (SELECT DISTINCT component, 'reason' AS section, 0 AS position, unnest(string_split(reasons, ' | ')) AS line FROM mem UNION ALL
  SELECT component, 'event', rn, upper(event_type) || ' at t=' || ts || ': ' || action || ' (' || details || ')' FROM
   (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts, event_id) AS rn FROM mem) WHERE rn <= 10) USING (component)""", ["scored"])


def investigation(w):
    analyses = w.scored.filter("risk_score >= 45").select("incident_id", "risk_score", "confidence_score", "severity", F.lit("explained").alias("explanation"))
    answers = I.response_priority(w.scored.filter("risk_score >= 45"), w.heads).select("incident_id", "recommended_action", "priority")
    reviews = verdict_log(w.spark, w.folder).select(
        "seq", "verdict", F.concat(F.lit("INC-"), F.lpad(F.regexp_extract("incident_id", r"(\d+)", 1), 4, "0")).alias("incident_id"))
    return I.join_investigation(w.incidents.select("incident_id", "component"), analyses, answers, reviews)


register("join_investigation", investigation, """
SELECT incident_id, component, CASE WHEN known THEN risk_score ELSE 50.0::DOUBLE END AS risk_score, CASE WHEN known THEN confidence_score ELSE 50.0::DOUBLE END AS confidence_score,
 CASE WHEN known THEN severity ELSE 'Medium' END AS severity, CASE WHEN known THEN 'explained' ELSE 'Multi-agent anomaly detected.' END AS explanation,
 CASE WHEN NOT known THEN 'Investigate host' WHEN risk_score >= 75 THEN 'Immediate Analyst Escalation & Endpoint Isolation Staging' WHEN risk_score >= 50 THEN 'Tier-2 SOC Analyst Review & Target Host Monitoring' ELSE 'Automated Telemetry Logging & Baseline Tracking' END AS recommended_action,
 CASE WHEN NOT known THEN 'P2 - High Priority' WHEN risk_score >= 80 THEN 'P1 - Critical / Urgent' WHEN risk_score >= 60 THEN 'P2 - High Priority' ELSE 'P3 - Medium Priority' END AS priority,
 coalesce(verdict, 'PENDING_REVIEW') AS review_status
FROM (SELECT *, risk_score >= 45 AS known FROM scored) LEFT JOIN (SELECT 'INC-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS incident_id,
  arg_max(CASE o_orderstatus WHEN 'O' THEN 'confirmed suspicious' WHEN 'F' THEN 'False Positive' ELSE 'need more investigation' END, o_orderkey) AS verdict FROM orders GROUP BY 1) USING (incident_id)""", ["scored"])
register("entity_heads", lambda w: w.heads, "SELECT component, replace(u4, ', ', ';') AS first_users, replace(h4, ', ', ';') AS first_hosts FROM shown", ["shown"])

# ---- documented variants -----------------------------------------------------------------------------


def weighted(w):
    mean = w.scored.agg(F.avg("event_count").alias("baseline_mean"))
    watched = L.ioc_match(w.bridge.filter("entity_type = 'user'"), w.iocs, "entity", "user").groupBy("component").agg(F.count("*").alias("watch_matches"))
    return w.scored.crossJoin(F.broadcast(mean)).join(watched, "component", "left").select(
        "component", "event_count", "baseline_mean", F.coalesce("watch_matches", F.lit(0)).alias("watch_matches"),
        (F.col("risk_score") / 100).alias("probability"), F.col("n_hosts").alias("destination_hosts"),
        (F.size("sources") >= 2).cast("int").alias("multi_source"))


register("ml_weighted_risk", lambda w: VA.ml_weighted_risk(weighted(w)).select("component", "ml_risk"), """
SELECT component, round(least(100, risk_score / 100 * 50 + CASE WHEN n_hosts >= 2 THEN 25 ELSE 0 END + CASE WHEN n >= 3 * (SELECT avg(n) FROM scored) THEN 15 ELSE 0 END
 + least(25, coalesce(m, 0) * 20 + CASE WHEN n_sources >= 2 THEN 15 ELSE 0 END)), 6) AS ml_risk FROM scored LEFT JOIN
 (SELECT component, count(*) AS m FROM bridge WHERE entity_type = 'user' AND entity IN (SELECT value FROM badu) GROUP BY 1) USING (component)""", ["scored", "bridge", "badu"])
register("confidence_v2", lambda w: VA.confidence_v2(w.scored).select("component", "confidence_v2"), """
SELECT component, CAST(least(100, least(50, n_sources * 25) + least(25, n * 2.5) + CASE WHEN n_agents >= 2 THEN 25 ELSE 0 END) AS DOUBLE) AS confidence_v2 FROM scored""", ["scored"])
prob = lambda w: w.triaged.withColumn("probability", F.col("risk_score") / 10)
registry.register("escalated_lookup", lambda w: VA.escalated_lookup(prob(w).filter("event_type = 'auth'"), w.events), """
SELECT a.event_id AS auth_event_id, a.ts AS auth_time, a.dst AS host, p.proc AS process, p.event_id AS process_event_id, p.ts AS process_time
FROM triaged a JOIN ev p ON p.src = a.dst AND p.event_type = 'process' AND a.ts - p.ts BETWEEN 0 AND 300
WHERE a.event_type = 'auth' AND a.risk / 10 >= 0.7""", ["triaged"])
def rarity(w):
    """How rare the pair of user and host of an event is: 1 for a pair seen once."""
    host = F.coalesce("destination_host", "source_host").alias("host")
    return w.events.select("event_id", "user", host).join(B.pair_frequency(w.events), ["user", "host"]).select(
        "event_id", (1 / F.col("pair_count")).alias("probability"))


register("evidence_conflicts", lambda w: VA.evidence_conflicts(
    rarity(w),
    w.triaged.filter("risk_score > 0").select("event_id", F.col("triggered_rules").alias("rules"), (F.col("risk_score") >= 6).cast("int").alias("strong")), high=0.5, low=0.25), """
SELECT event_id, round(1 / pair_count, 6) AS probability, CASE WHEN pair_count <= 2 AND risk = 0 THEN 'unexplained_anomaly' ELSE 'rule_overrides_model' END AS conflict
FROM triaged JOIN pairs USING (usr) WHERE host = pair_host AND ((pair_count <= 2 AND risk = 0) OR (pair_count >= 4 AND risk >= 6))""", ["triaged", "pairs"])
register("rule_variants", lambda w: VA.rule_variants(w.events), """
SELECT event_id, 'failure_burst_3' AS rule FROM (SELECT event_id, count(*) OVER (PARTITION BY usr ORDER BY ts RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS n
  FROM ev WHERE event_type = 'auth' AND contains(lower(details), 'fail')) WHERE n >= 3
UNION ALL SELECT event_id, 'process_burst_10' FROM recent_proc WHERE n_recent >= 10
UNION ALL SELECT event_id, 'flow_10mb_1000s' FROM ev WHERE bytes >= 10000000 OR duration >= 1000
UNION ALL SELECT event_id, 'off_hours_6_18' FROM ev WHERE event_type = 'auth' AND ((ts % 86400) // 3600 < 6 OR (ts % 86400) // 3600 >= 18)
UNION ALL SELECT event_id, 'single_target_10' FROM ev WHERE event_type = 'auth' AND usr IN
  (SELECT usr FROM ev WHERE event_type = 'auth' AND dst IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT dst) <= 1)""", ["recent_proc"])
register("regular_destinations", lambda w: VA.regular_destinations(w.wide.withColumn(
    "timestamp", F.col("event_id") * 60).withColumn("destination_host", F.concat(F.lit("R"), F.col("event_id") % 16)), 1900.0), """
SELECT 'R' || h AS destination_host, n AS contacts, round(s, 6) AS gap_std FROM (SELECT h, count(*) + 1 AS n, stddev_pop(g) AS s FROM
 (SELECT event_id % 16 AS h, event_id * 60 - lag(event_id * 60) OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS g FROM ev WHERE event_type IN ('dns', 'flow'))
 WHERE g IS NOT NULL GROUP BY 1) WHERE n >= 5 AND s <= 1900""", ["ev"])
register("list_adjustment", lambda w: VA.list_adjustment(
    w.triaged.select("event_id", "user", "source_host", "process", "risk_score"), w.iocs,
    w.events.filter("process is not null and md5(process) like '8%'").select("user", F.col("source_host").alias("host"), "process")).select("event_id", "adjusted_risk"), """
SELECT event_id, CAST(greatest(0, risk + CASE WHEN usr IN (SELECT value FROM badu) OR src IN (SELECT value FROM badh) THEN 20 ELSE 0 END
 - CASE WHEN t.proc IS NOT NULL AND md5(t.proc) LIKE '8%' THEN 30 ELSE 0 END) AS BIGINT) AS adjusted_risk
FROM triaged t""", ["triaged", "badu", "badh"])
register("response_actions", lambda w: VA.response_actions(w.scored).select("component", "action_id", "techniques", "status"), """
SELECT component, action_id, techniques, CASE WHEN mode = 'human' THEN 'AWAITING_APPROVAL' ELSE 'AUTOMATIC' END AS status FROM scored, (VALUES
 ('ISOLATE_HOST', 'T1021,T1071', 'human'), ('REVOKE_KERBEROS_TGT', 'T1078,T1558', 'human'), ('KILL_PROCESS_TREE', 'T1059,T1055', 'human'),
 ('ADD_TO_WATCHLIST', 'T1087', 'automatic'), ('INCREASE_LOGGING', 'T1562', 'automatic')) AS c(action_id, techniques, mode)
WHERE action_id = 'INCREASE_LOGGING' OR (risk_score >= 50 AND action_id = 'ADD_TO_WATCHLIST')
 OR (risk_score >= 75 AND (action_id IN ('ISOLATE_HOST', 'REVOKE_KERBEROS_TGT') OR (action_id = 'KILL_PROCESS_TREE' AND n_processes > 0)))""", ["scored"])


def staged(w):
    verdicts = verdict_log(w.spark, w.folder).select(
        "seq", "verdict", F.concat(F.lit("INC-"), F.lpad(F.regexp_extract("incident_id", r"(\d+)", 1), 4, "0")).alias("incident_id"))
    events = w.members.select("event_id", "component").join(w.incidents.select("component", "incident_id"), "component")
    return L.training_staging(verdicts, events).select("event_id", "incident_id", "label")


register("training_staging", staged, """
SELECT event_id, incident_id, CAST(lst = 'watch' AS BIGINT) AS label FROM mem JOIN inc USING (component) JOIN (SELECT 'INC-' || lpad(substr(incident_id, 5), 4, '0') AS incident_id,
 arg_max(lst, seq) AS lst FROM verd WHERE lst IS NOT NULL GROUP BY 1) USING (incident_id)""", ["inc", "verd"])
