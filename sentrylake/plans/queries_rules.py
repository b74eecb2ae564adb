"""Queries: triage rules, specialists, threat lists and feedback."""

from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.text import basename, longest_label, shannon_entropy
from sentrylake.operators import lists as L
from sentrylake.operators import specialists as S
from sentrylake.operators import triage as TR
from sentrylake.plans.fragments import fragment
from sentrylake.plans.registry import register
from sentrylake.sources.driver_tables import table, threat_rows, verdict_log

# ---- triage --------------------------------------------------------------------------------


def fires(rule):
    return lambda w: w.triaged.filter(F.array_contains("triggered_rules", rule)).select("event_id")


register("r1_auth_failure", fires("R1_AUTH_FAILURE"), "SELECT event_id FROM fired WHERE r1 = 1", ["fired"])
register("r2_auth_burst", lambda w: TR.auth_bursts(w.events), """
SELECT DISTINCT usr AS "user", ts AS timestamp, n_recent FROM ev JOIN recent_auth USING (event_id) WHERE n_recent > 3""", ["recent_auth"])
register("r3_protocol", fires("R3_UNUSUAL_AUTH"), "SELECT event_id FROM fired WHERE r3 = 1", ["fired"])
register("r4_rare_pair", lambda w: TR.rare_pairs(w.events), 'SELECT usr AS "user", host, pair_count FROM pairs WHERE pair_count <= 2', ["pairs"])
register("r5_rare_process", lambda w: TR.rare_processes(w.events), "SELECT proc AS process, process_count FROM procs WHERE process_count < 15", ["procs"])
register("r6_process_burst", lambda w: TR.process_bursts(w.events), """
SELECT DISTINCT src AS source_host, ts AS timestamp, n_recent FROM ev JOIN recent_proc USING (event_id) WHERE n_recent > 3""", ["recent_proc"])
register("r7_flow_anomaly", fires("R7_NETWORK_ANOMALY"), "SELECT event_id FROM fired WHERE r7 = 1", ["fired"])

listed = lambda w: TR.triage(w.events, w.iocs)
fragment("badu", "SELECT value FROM iocs WHERE type = 'user'", "iocs")
fragment("badh", "SELECT value FROM iocs WHERE type = 'host'", "iocs")
register("r8_listed_user", lambda w: listed(w).filter(F.array_contains("triggered_rules", "R8_REDTEAM_USER")).select("event_id", "user"),
         'SELECT event_id, usr AS "user" FROM ev WHERE usr IN (SELECT value FROM badu)', ["badu", "ev"])
register("r9_listed_host", lambda w: listed(w).filter(F.array_contains("triggered_rules", "R9_REDTEAM_HOST")).select(
    "event_id", F.element_at(F.filter("triage_reasons", lambda r: r.startswith("Involves")), 1).alias("reason")), """
SELECT event_id, 'Involves known compromised host (' || CASE WHEN src IN (SELECT value FROM badh) THEN src ELSE dst END || ')' AS reason
FROM ev WHERE src IN (SELECT value FROM badh) OR coalesce(dst, '') IN (SELECT value FROM badh)""", ["badh", "ev"])
register("r10_compound", fires("R10_TEMPORAL_BURST"), "SELECT event_id FROM triaged WHERE n >= 2", ["triaged"])
register("score_event", lambda w: w.triaged.select(
    "event_id", "risk_score", "is_suspicious", F.array_join("triggered_rules", ";").alias("rules"),
    F.array_join("triage_reasons", " | ").alias("reasons")), """
SELECT event_id, CAST(risk AS BIGINT) AS risk_score, CAST(flagged AS BIGINT) AS is_suspicious, rules, reasons FROM triaged""", ["triaged"])
register("triage_flagged", lambda w: TR.triage(w.events, rare_pair_at_most=1).filter("is_suspicious = 1").select(
    "event_id", "timestamp", "user", "risk_score", F.array_join("triggered_rules", ";").alias("rules")), """
SELECT event_id, ts AS timestamp, usr AS "user", CAST(risk AS BIGINT) AS risk_score, rules FROM triaged WHERE flagged = 1""", ["triaged"])
register("rule_frequency", lambda w: TR.rule_frequency(w.triaged), """
SELECT rule, count(*) AS events FROM (SELECT unnest(string_split(rules, ';')) AS rule FROM triaged WHERE rules <> '') GROUP BY 1""", ["triaged"])
register("triage_summary", lambda w: TR.triage_summary(w.triaged), """
SELECT count(*) AS total_events, CAST(sum(flagged) AS BIGINT) AS flagged_events, CAST(count(*) - sum(flagged) AS BIGINT) AS normal_events,
  round(sum(flagged) / count(*) * 100, 1) AS flagged_percent, round(avg(risk), 2) AS mean_risk, CAST(max(risk) AS BIGINT) AS max_risk FROM triaged""", ["triaged"])
# ---- specialists: profiles up to the training cutoff, later rows scored too -----------------------

fragment("evb", "SELECT * FROM ev WHERE ts <= 702000", "ev")
fragment("bpairs", "SELECT usr, coalesce(dst, src) AS host, count(*) AS c FROM evb GROUP BY 1, 2", "evb")
fragment("bprocs", "SELECT proc, count(*) AS c FROM evb WHERE proc IS NOT NULL GROUP BY 1", "evb")
fragment("bsec", "SELECT usr, ts, count(*) AS n FROM evb WHERE event_type = 'auth' GROUP BY 1, 2", "evb")
fragment("bopens", "SELECT usr, min(ts) AS s FROM bsec GROUP BY 1 UNION ALL "
         "SELECT o.usr, (SELECT min(ts) FROM bsec a WHERE a.usr = o.usr AND a.ts > o.s + 300) AS s FROM bopens o WHERE "
         "EXISTS (SELECT 1 FROM bsec a WHERE a.usr = o.usr AND a.ts > o.s + 300)", "bsec")
fragment("bvel", "SELECT usr, avg(c) AS mean, greatest(0.5, CASE WHEN sum(c) < 2 THEN 0.5 WHEN count(*) = 1 THEN avg(c) * 0.5 ELSE stddev_pop(c) END) AS std FROM "
         "(SELECT o.usr, o.s, sum(a.n) AS c FROM bopens o JOIN bsec a ON a.usr = o.usr AND a.ts BETWEEN o.s AND o.s + 300 GROUP BY 1, 2) GROUP BY 1", "bopens")
fragment("bhour", "SELECT usr, (ts % 86400) // 3600 AS h, count(*) AS n FROM evb GROUP BY 1, 2", "evb")
fragment("bact", "SELECT usr, sum(n) AS activity FROM bhour GROUP BY 1", "bhour")
fragment("bdiv", "SELECT dst, count(DISTINCT usr) AS users FROM evb WHERE dst IS NOT NULL GROUP BY 1", "evb")
fragment("bflow", "SELECT src, avg(bytes) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(bytes) ELSE avg(bytes) * 0.5 END AS std FROM evb "
         "WHERE event_type = 'flow' AND bytes > 0 GROUP BY 1", "evb")
fragment("bknown", "SELECT src AS h FROM evb UNION SELECT dst FROM evb WHERE dst IS NOT NULL", "evb")
register("triage_frozen", lambda w: TR.triage_frozen(w.events, w.baseline.pairs, w.baseline.processes, w.iocs).select(
    "event_id", "risk_score", F.array_join("triggered_rules", ";").alias("rules")), """
SELECT event_id, CAST(p + CASE WHEN n >= 2 THEN 2 ELSE 0 END AS BIGINT) AS risk_score,
  concat_ws(';', CASE WHEN r1 = 1 THEN 'R1_AUTH_FAILURE' END, CASE WHEN r3 = 1 THEN 'R3_UNUSUAL_AUTH' END, CASE WHEN q4 = 1 THEN 'R4_RARE_USER_HOST' END,
   CASE WHEN q5 = 1 THEN 'R5_SUSPICIOUS_PROC' END, CASE WHEN r7 = 1 THEN 'R7_NETWORK_ANOMALY' END, CASE WHEN q8 = 1 THEN 'R8_REDTEAM_USER' END,
   CASE WHEN q9 = 1 THEN 'R9_REDTEAM_HOST' END, CASE WHEN n >= 2 THEN 'R10_TEMPORAL_BURST' END) AS rules
FROM (SELECT *, r1 + r3 + q4 + q5 + r7 + q8 + q9 AS n, 2*r1 + r3 + 2*q4 + 2*q5 + r7 + 3*q8 + 2*q9 AS p FROM (
  SELECT f.*, CAST(coalesce(b.c, 0) <= 2 AS INT) AS q4, CAST(event_type = 'process' AND coalesce(pb.c, 0) < 15 AS INT) AS q5,
    CAST(f.usr IN (SELECT value FROM badu) AS INT) AS q8, CAST(src IN (SELECT value FROM badh) OR coalesce(dst, '') IN (SELECT value FROM badh) AS INT) AS q9
  FROM fired f LEFT JOIN bpairs b ON b.usr = f.usr AND b.host = f.pair_host LEFT JOIN bprocs pb ON pb.proc = f.proc))""",
         ["fired", "bpairs", "bprocs", "badu", "badh"])

fragment("fauth", """
SELECT event_id, 2*r1 + 2*r2 + r3 + 2*r4 + 3*r8 + 2*r9 + 2*r11 + 2*r12 + r14 + CASE WHEN n >= 2 THEN 2 ELSE 0 END AS risk, n,
  concat_ws(';', CASE WHEN r1 = 1 THEN 'R1' END, CASE WHEN r2 = 1 THEN 'R2' END, CASE WHEN r3 = 1 THEN 'R3' END, CASE WHEN r4 = 1 THEN 'R4' END,
   CASE WHEN r8 = 1 THEN 'R8' END, CASE WHEN r9 = 1 THEN 'R9' END, CASE WHEN r11 = 1 THEN 'R11' END, CASE WHEN r12 = 1 THEN 'R12' END,
   CASE WHEN r14 = 1 THEN 'R14' END, CASE WHEN n >= 2 THEN 'R10' END) AS rules
FROM (SELECT *, r1 + r2 + r3 + r4 + r8 + r9 + r11 + r12 + r14 AS n FROM (
  SELECT e.event_id, CAST(contains(lower(e.details), 'fail') AS INT) AS r1,
   CAST(a.n_recent > greatest(3, coalesce(floor(v.mean + 2 * v.std), 3)) AS INT) AS r2,
   CAST(contains(lower(e.details), 'ntlm') OR contains(lower(e.details), 'network') AS INT) AS r3,
   CAST(coalesce(p.c, 0) <= (SELECT greatest(1, floor(quantile_cont(c, 0.05))) FROM bpairs) AS INT) AS r4,
   CAST(e.usr IN (SELECT value FROM badu) AS INT) AS r8,
   CAST(e.src IN (SELECT value FROM badh) OR e.dst IN (SELECT value FROM badh) AS INT) AS r9,
   CAST(coalesce(coalesce(h.n, 0) / t.activity < 0.01, FALSE) AS INT) AS r11,
   CAST(coalesce(p.c, 0) = 0 AS INT) AS r12,
   CAST(coalesce(d.users BETWEEN 1 AND 3, FALSE) AND coalesce(p.c, 0) = 0 AS INT) AS r14
  FROM ev e JOIN recent_auth a USING (event_id) LEFT JOIN bvel v ON v.usr = e.usr
   LEFT JOIN bpairs p ON p.usr = e.usr AND p.host = coalesce(e.dst, e.src) LEFT JOIN bact t ON t.usr = e.usr
   LEFT JOIN bhour h ON h.usr = e.usr AND h.h = (e.ts % 86400) // 3600 LEFT JOIN bdiv d ON d.dst = e.dst
  WHERE e.event_type = 'auth'))""", "recent_auth", "bvel", "bpairs", "bact", "bhour", "bdiv", "badu", "badh")
fragment("fproc", """
SELECT event_id, 2*r5 + 2*r6 + 2*r9 + 3*r8 + 3*r15b + 2*r16 + CASE WHEN n >= 2 THEN 2 ELSE 0 END AS risk, n,
  concat_ws(';', CASE WHEN r5 = 1 THEN 'R5' END, CASE WHEN r6 = 1 THEN 'R6' END, CASE WHEN r9 = 1 THEN 'R9' END, CASE WHEN r8 = 1 THEN 'R8' END,
   CASE WHEN r15b = 1 THEN 'R15b' END, CASE WHEN r16 = 1 THEN 'R16' END, CASE WHEN n >= 2 THEN 'R10' END) AS rules
FROM (SELECT *, r5 + r6 + r9 + r8 + r15b + r16 AS n FROM (
  SELECT e.event_id, CAST(coalesce(b.c, 0) < (SELECT greatest(1, floor(quantile_cont(c, 0.05))) FROM bprocs) AS INT) AS r5,
   CAST(a.n_recent > 3 AS INT) AS r6, CAST(e.src IN (SELECT value FROM badh) AS INT) AS r9, CAST(e.usr IN (SELECT value FROM badu) AS INT) AS r8,
   CAST(e.proc IN (SELECT value FROM iocs WHERE type = 'process') AS INT) AS r15b,
   CAST(b.c IS NULL AND row_number() OVER (PARTITION BY e.usr, e.proc ORDER BY e.ts, e.event_id) = 1 AS INT) AS r16
  FROM ev e JOIN recent_proc a USING (event_id) LEFT JOIN bprocs b ON b.proc = e.proc WHERE e.event_type = 'process'))""",
         "recent_proc", "bprocs", "badu", "badh")
fragment("fnet", """
SELECT event_id, r7a + r7b + 2*r9 + r13 + CASE WHEN n >= 2 THEN 2 ELSE 0 END AS risk, n,
  concat_ws(';', CASE WHEN r7a = 1 THEN 'R7' END, CASE WHEN r7b = 1 THEN 'R7' END, CASE WHEN r9 = 1 THEN 'R9' END, CASE WHEN r13 = 1 THEN 'R13' END,
   CASE WHEN n >= 2 THEN 'R10' END) AS rules
FROM (SELECT *, r7a + r7b + r9 + r13 AS n FROM (
  SELECT e.event_id, CAST(coalesce(e.bytes, 0) > greatest(50000, coalesce(floor(f.mean + 2 * f.std), 50000)) AS INT) AS r7a,
   CAST(coalesce(e.duration, 0) > 100 AS INT) AS r7b,
   CAST(e.src IN (SELECT value FROM badh) OR e.dst IN (SELECT value FROM badh) AS INT) AS r9, CAST(e.dst NOT IN (SELECT h FROM bknown) AS INT) AS r13
  FROM ev e LEFT JOIN bflow f ON f.src = e.src WHERE e.event_type IN ('dns', 'flow')))""", "bflow", "bknown", "badh")
fragment("finds", "SELECT 'AuthenticationAgent' AS agent, * FROM fauth WHERE risk >= 3 UNION ALL SELECT 'ProcessAgent', * FROM fproc WHERE risk >= 3 "
         "UNION ALL SELECT 'NetworkAgent', * FROM fnet WHERE risk >= 3", "fauth", "fproc", "fnet")


def specialist(agent, fr):
    register(f"{agent}_specialist", lambda w: w.findings.filter(F.col("agent") == dict(
        auth=V.AUTH_AGENT, process=V.PROCESS_AGENT, network=V.NETWORK_AGENT)[agent]).select("event_id", "risk_score", "rules"),
        f"SELECT event_id, CAST(risk AS BIGINT) AS risk_score, rules FROM {fr} WHERE risk >= 3", [fr])


specialist("auth", "fauth")
specialist("process", "fproc")
specialist("network", "fnet")


def specialist_rule(name, rule, fr):
    register(name, lambda w: w.findings.filter(F.array_contains("rules", rule)).select("event_id", "agent"),
             f"SELECT event_id, agent FROM finds WHERE list_contains(string_split(rules, ';'), '{rule}')", ["finds"])


for n, r in [("r11_off_hours_user", "R11"), ("r12_first_pair", "R12"), ("r15b_listed_process", "R15b")]:
    specialist_rule(n, r, None)


def first_half_hour_profile(w):
    """Profiles of the first ten minutes only: most hosts and processes are still unseen."""
    from sentrylake.operators.baselines import baseline_cutoff, build_baseline

    return build_baseline(baseline_cutoff(w.events, 691800))


fragment("tiny", "SELECT * FROM ev WHERE ts <= 691800", "ev")
register("r13_unseen_destination", lambda w: S.network_specialist(w.events, first_half_hour_profile(w), w.iocs).filter(
    F.array_contains("rules", "R13")).select("event_id", "risk_score"), """
SELECT event_id, CAST(r7a + r7b + 1 + 2 * r9 + CASE WHEN r7a + r7b + r9 >= 1 THEN 2 ELSE 0 END AS BIGINT) AS risk_score FROM (
 SELECT e.event_id, CAST(coalesce(e.bytes, 0) > greatest(50000, coalesce(floor(f.mean + 2 * f.std), 50000)) AS INT) AS r7a,
  CAST(coalesce(e.duration, 0) > 100 AS INT) AS r7b, CAST(e.src IN (SELECT value FROM badh) OR e.dst IN (SELECT value FROM badh) AS INT) AS r9
 FROM ev e LEFT JOIN (SELECT src, avg(bytes) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(bytes) ELSE avg(bytes) * 0.5 END AS std FROM tiny
   WHERE event_type = 'flow' AND bytes > 0 GROUP BY 1) f ON f.src = e.src
 WHERE e.event_type IN ('dns', 'flow') AND e.dst NOT IN (SELECT src FROM tiny UNION SELECT dst FROM tiny WHERE dst IS NOT NULL))
WHERE r7a + r7b + r9 >= 1""", ["tiny", "badh"])
register("r14_low_diversity_host", lambda w: S.auth_specialist(w.events, first_half_hour_profile(w)).filter(
    F.array_contains("rules", "R14")).select("event_id"), """
SELECT event_id FROM ev e WHERE event_type = 'auth' AND dst IN (SELECT dst FROM tiny WHERE dst IS NOT NULL GROUP BY 1 HAVING count(DISTINCT usr) <= 3)
 AND NOT EXISTS (SELECT 1 FROM tiny t WHERE t.usr = e.usr AND coalesce(t.dst, t.src) = e.dst)""", ["tiny"])
register("r16_new_process", lambda w: S.process_specialist(w.events, first_half_hour_profile(w)).filter(
    F.array_contains("rules", "R16")).select("event_id"), """
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY usr, proc ORDER BY ts, event_id) AS rn FROM ev WHERE event_type = 'process')
WHERE rn = 1 AND proc NOT IN (SELECT proc FROM tiny WHERE proc IS NOT NULL)""", ["tiny"])
LOLBIN_SQL = ", ".join(f"'{n}'" for n in V.LOLBINS)
register("r15_lolbin", lambda w: w.events.filter("event_type = 'process'").withColumn(
    "path", F.when(F.col("process").endswith("1"), F.concat(F.lit("C:\\Win\\"), F.lit("CMD.exe")))
    .when(F.col("process").endswith("2"), F.lit("/usr/bin/whoami")).otherwise(F.concat(F.lit("/opt/at/"), "process"))
).filter(basename(F.col("path")).isin(V.LOLBINS)).select("event_id", "path"), """
SELECT event_id, CASE WHEN proc LIKE '%1' THEN 'C:\\Win\\CMD.exe' ELSE '/usr/bin/whoami' END AS path FROM ev WHERE proc LIKE '%1' OR proc LIKE '%2'""", ["ev"])

names = lambda w: table(w.spark, w.folder, "pages").select(
    "page_id", F.concat(F.substring(F.md5(F.col("url")), 1, 20), F.lit("."), F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("name"))
fragment("dnsn", "SELECT page_id, substr(md5(url), 1, 20) || '.' || regexp_extract(url, '^https?://([^/]+)', 1) AS name FROM pages")
fragment("dnsl", "SELECT page_id, name, unnest(string_split(name, '.')) AS label, generate_subscripts(string_split(name, '.'), 1) AS i FROM dnsn", "dnsn")
fragment("dnsb", "SELECT page_id, name, arg_max(label, length(label) * 100 - i) AS label FROM dnsl GROUP BY 1, 2", "dnsl")
fragment("dnse", "SELECT page_id, name, label, -sum(c / length(label) * log2(c / length(label))) AS entropy FROM "
         "(SELECT page_id, name, label, ch, count(*) AS c FROM (SELECT *, unnest(string_split(lower(label), '')) AS ch FROM dnsb) GROUP BY ALL) GROUP BY 1, 2, 3", "dnsb")
register("r17_dga_entropy", lambda w: names(w).filter(S.dga_hit(F.col("name"))).select(
    "page_id", "name", longest_label(F.col("name")).alias("label"), shannon_entropy(longest_label(F.col("name"))).alias("entropy")),
    "SELECT page_id, name, label, round(entropy, 6) AS entropy FROM dnse WHERE length(label) > 8 AND entropy > 3.5", ["dnse"])
register("label_entropy", lambda w: names(w).select("page_id", shannon_entropy(longest_label(F.col("name"))).alias("entropy")),
         "SELECT page_id, round(entropy, 6) AS entropy FROM dnse", ["dnse"])


def dns_with_names(w):
    return w.events.filter("event_type = 'dns'").withColumn("destination_host", F.concat(F.upper("destination_host"), F.lit(".Example.com")))


def listed_domains(w):
    return w.iocs.unionByName(w.iocs.filter("type = 'host'").select(
        F.lit("domain").alias("type"), F.concat(F.lower("value"), F.lit(".example.com")).alias("value")))


register("r17b_listed_domain", lambda w: S.network_specialist(dns_with_names(w), w.baseline, listed_domains(w)).filter(
    F.array_contains("rules", "R17b")).select("event_id", "destination_host"), """
SELECT event_id, dst || '.Example.com' AS destination_host FROM ev WHERE event_type = 'dns' AND dst IN (SELECT value FROM badh)""", ["ev", "badh"])


def regular(w):
    """All events as contacts of forty derived destinations; half keep a steady rhythm."""
    slot = F.col("event_id") % 40
    jitter = F.length("details") % 3 * F.when(slot < 20, 1).otherwise(200)
    return w.events.select(
        "event_id", F.lit("flow").alias("event_type"), F.concat(F.lit("D"), slot).alias("destination_host"),
        (F.lit(691200) + F.col("event_id") * 7 + jitter).alias("timestamp"))


fragment("regl", "SELECT 'D' || (event_id % 40) AS dst, 691200 + event_id * 7 + length(details) % 3 * "
         "CASE WHEN event_id % 40 < 20 THEN 1 ELSE 200 END AS ts FROM ev", "ev")
register("r18_beaconing", lambda w: S.beacons(regular(w)), """
SELECT dst AS destination_host, n AS contacts, round(m, 6) AS mean_gap, round(s / m, 6) AS cv FROM (
 SELECT dst, count(*) AS n, avg(g) AS m, stddev_pop(g) AS s FROM (SELECT dst, ts - lag(ts) OVER (PARTITION BY dst ORDER BY ts) AS g FROM regl) GROUP BY 1)
WHERE n >= 5 AND m > 0 AND m < 600 AND s / m < 0.15""", ["regl"])
safe = lambda w: w.iocs.select("type", F.when(F.col("type") == "process", F.lower("value")).otherwise(F.col("value")).alias("value")).unionByName(
    w.events.select(F.lit("host").alias("type"), F.col("source_host").alias("value")).distinct()).distinct()
register("safelist_skip", lambda w: S.auth_specialist(w.events, w.baseline, w.iocs, safe(w)).select("event_id", "risk_score"), """
SELECT event_id, CAST(risk AS BIGINT) AS risk_score FROM fauth JOIN ev USING (event_id) WHERE risk >= 3 AND usr NOT IN (SELECT value FROM badu)""", ["fauth"])
register("route_events", lambda w: S.route_events(w.events, ("auth", "network")).groupBy("agent", "event_type").agg(F.count("*").alias("events")), """
SELECT CASE WHEN event_type = 'auth' THEN 'AuthenticationAgent' ELSE 'NetworkAgent' END AS agent, event_type, count(*) AS events
FROM ev WHERE event_type <> 'process' GROUP BY 1, 2""", ["ev"])
fragment("sent", """
SELECT DISTINCT agent, entity FROM (SELECT CASE event_type WHEN 'auth' THEN 'AuthenticationAgent' WHEN 'process' THEN 'ProcessAgent' ELSE 'NetworkAgent' END AS agent,
  unnest([CASE WHEN event_type IN ('auth', 'process') THEN usr END, src, dst, proc]) AS entity FROM ev) WHERE entity IS NOT NULL""", "ev")
register("specialist_entities", lambda w: S.specialist_entities(w.events), "SELECT agent, entity FROM sent", ["sent"])
register("specialist_summary", lambda w: S.specialist_summary(w.events, w.findings).drop("evidence_items"), """
SELECT agent, analyzed, coalesce(flagged, 0) AS flagged, CAST(coalesce(total, 0) AS DOUBLE) AS total_risk, coalesce(round(total / flagged, 2), 0) AS mean_risk, entities FROM
 (SELECT CASE event_type WHEN 'auth' THEN 'AuthenticationAgent' WHEN 'process' THEN 'ProcessAgent' ELSE 'NetworkAgent' END AS agent, count(*) AS analyzed FROM ev GROUP BY 1)
 LEFT JOIN (SELECT agent, count(*) AS flagged, sum(risk) AS total FROM finds GROUP BY 1) USING (agent)
 LEFT JOIN (SELECT agent, count(*) AS entities FROM sent GROUP BY 1) USING (agent)""", ["sent", "finds"])
# every text of every specialist; its oracle-checked part, two texts of one specialist, is the query after it
register("specialist_evidence_all", lambda w: S.specialist_evidence(w.findings).select(
    "agent", "evidence", F.col("first_seen.event_id").alias("first_event_id"), "times"))
register("specialist_evidence", lambda w: S.specialist_evidence(w.findings).filter(
    F.col("evidence").startswith("Failed") | F.col("evidence").startswith("Network auth")).select(
    "agent", "evidence", F.col("first_seen.event_id").alias("first_event_id"), "times"), """
SELECT agent, evidence, arg_min(event_id, ts * 100000000 + event_id) AS first_event_id, count(*) AS times FROM (
 SELECT f.agent, e.event_id, e.ts, CASE x WHEN 'R1' THEN 'Failed authentication attempt by user ' || usr ELSE 'Network authentication using NTLM protocol' END AS evidence
 FROM (SELECT *, unnest(string_split(rules, ';')) AS x FROM finds) f JOIN ev e USING (event_id) WHERE x IN ('R1', 'R3') AND f.agent = 'AuthenticationAgent')
GROUP BY 1, 2""", ["finds"])

# ---- threat lists -----------------------------------------------------------------------------------

register("classify_indicator", lambda w: table(w.spark, w.folder, "pages").select("page_id", F.explode(F.array(
    F.regexp_extract("url", "^https?://([^/]+)", 1), F.md5("url"), F.substring(F.md5("url"), 1, 31), F.concat(F.lit("run"), "page_id", F.lit(".exe")),
    F.concat(F.lit("run"), "page_id", F.lit(".sh")), F.concat(F.lit("10.0.0."), F.col("page_id") % 256), F.concat(F.lit("U"), "page_id"),
    F.concat(F.lit("a b"), "page_id", F.lit(".dll")))).alias("value")).select("value", L.classify_indicator(F.col("value")).alias("type")), """
SELECT unnest([regexp_extract(url, '^https?://([^/]+)', 1), md5(url), substr(md5(url), 1, 31), 'run' || page_id || '.exe', 'run' || page_id || '.sh',
  '10.0.0.' || page_id % 256, 'U' || page_id, 'a b' || page_id || '.dll']) AS value,
 unnest(['domain', 'hash', 'user', 'process', 'domain', 'host', 'user', 'process']) AS type FROM pages""")
register("normalize_ioc_type", lambda w: threat_rows(w.events).withColumn("kind", L.normalize_ioc_type(F.col("type"))).groupBy("type", "kind").agg(
    F.count("*").alias("indicators")), """
SELECT type, kind, count(*) AS indicators FROM (
 SELECT 'Account' AS type, 'user' AS kind FROM ev WHERE md5(usr) LIKE '7%' UNION ALL SELECT 'ip', 'host' FROM ev WHERE md5(dst) LIKE '7%'
 UNION ALL SELECT 'binary', 'process' FROM ev WHERE md5(proc) LIKE '7%') GROUP BY 1, 2""", ["ev"])
register("ioc_match", lambda w: L.ioc_match(w.events.select("event_id", "user"), w.iocs, "user", "user"),
         'SELECT event_id, usr AS "user" FROM ev WHERE usr IN (SELECT value FROM badu)', ["ev", "badu"])
quiet = lambda w: w.events.filter("is_redteam = 1 and event_type = 'auth'").select(F.lit("Users").alias("type"), F.concat(F.col("user"), F.lit(" ")).alias("value"))
register("ioc_remove", lambda w: L.ioc_remove(w.iocs, quiet(w)), """
SELECT type, value FROM iocs WHERE NOT (type = 'user' AND value IN (SELECT usr FROM ev WHERE is_redteam = 1 AND event_type = 'auth'))""", ["iocs"])
register("ioc_enrich", lambda w: L.ioc_counts(L.ioc_enrich(w.iocs, L.watchlist(L.apply_verdicts(verdict_log(w.spark, w.folder))))), """
SELECT type, count(*) AS indicators FROM (SELECT type, value FROM iocs UNION SELECT type, value FROM learned WHERE lst = 'watch') GROUP BY 1""", ["iocs", "learned"])
learned = lambda w: L.apply_verdicts(verdict_log(w.spark, w.folder))
register("apply_verdicts", learned, "SELECT type, value, lst AS list FROM learned", ["learned"])
register("list_lookup", lambda w: L.list_lookup(w.events.select("event_id", "user", "source_host"), learned(w), "user"), """
SELECT event_id, usr AS "user", src AS source_host, CAST(coalesce(lst = 'watch', FALSE) AS BIGINT) AS is_watched, CAST(coalesce(lst = 'safe', FALSE) AS BIGINT) AS is_safe
FROM ev LEFT JOIN (SELECT value, lst FROM learned WHERE type = 'user') ON value = usr""", ["ev", "learned"])
register("feedback_summary", lambda w: L.feedback_summary(verdict_log(w.spark, w.folder), learned(w)), """
SELECT lst AS list, type, count(*) AS entries, (SELECT count(*) FROM orders) AS total_verdicts FROM learned GROUP BY 1, 2""", ["learned"])
