"""SQL fragments for the independent oracle: named common table expressions."""

FRAGMENTS = {}


def fragment(name, sql, *needs):
    FRAGMENTS[name] = (sql, needs)


def compose(query, *needs, wide=False):
    """`query` with the fragments it needs, in dependency order; `wide` takes the events in real time, over thirty days."""
    order = []
    swap = _in_real_time if wide else lambda sql: sql

    def add(name):
        for n in FRAGMENTS[name][1]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return query
    body = lambda n: FRAGMENTS["evw" if wide and n == "ev" else n][0]
    return swap("WITH RECURSIVE " + ",\n".join(f"{n} AS ({body(n)})" for n in order) + "\n" + query)


def _in_real_time(sql):
    """The study's cut times, 120 times as far from its origin."""
    for cut in (702000, 707400, 712800):
        sql = sql.replace(str(cut), str(691200 + (cut - 691200) * 120))
    return sql


def _canonical(squeeze):
    return f"""
SELECT event_id, et AS event_type,
  CAST(691200 + floor(us / {squeeze * 1000000}) AS BIGINT) AS ts,
  'U' || user_id AS usr,
  CASE WHEN et = 'auth' THEN 'U' || user_id END AS source_user,
  CAST(NULL AS VARCHAR) AS destination_user,
  'C' || (user_id % 8) AS src,
  CASE WHEN et <> 'process' THEN 'C' || k END AS dst,
  CASE WHEN et = 'process' THEN 'P' || k END AS proc,
  CASE et WHEN 'auth' THEN 'LogOn' WHEN 'process' THEN 'Start' WHEN 'dns' THEN 'DNS_QUERY' ELSE 'FLOW' END AS action,
  CASE et WHEN 'auth' THEN (CASE WHEN k % 7 = 0 THEN 'NTLM' ELSE 'Kerberos' END) || '|' ||
         (CASE WHEN k % 11 = 0 THEN 'Network' ELSE 'Interactive' END) || '|' ||
         (CASE WHEN kind = 'error' THEN 'Failure' ELSE 'Success' END)
    WHEN 'flow' THEN 'bytes=' || CAST(floor(value * 1000) AS BIGINT) || '|duration=' || CAST(floor(value) AS BIGINT) || '|protocol=tcp'
    WHEN 'dns' THEN 'resolved=C' || k ELSE 'process=P' || k END AS details,
  CASE WHEN et = 'flow' THEN CAST(floor(value * 1000) AS BIGINT) END AS bytes,
  CASE WHEN et = 'flow' THEN CAST(floor(value) AS BIGINT) END AS duration,
  CASE WHEN value > 150 THEN 1 ELSE 0 END AS is_redteam,
  CASE WHEN value > 300 THEN 1 ELSE 0 END AS is_extreme,
  'H' || ((user_id // 5) * 10 + k // 10) AS corr_host,
  k, user_id
FROM (SELECT event_id, user_id, value, event_type AS kind, epoch_us(ts) - 1704067200000000 AS us,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
        CASE WHEN event_type IN ('signup', 'error') THEN 'auth' WHEN event_type = 'click' THEN 'process'
             WHEN event_type = 'view' THEN 'dns' ELSE 'flow' END AS et FROM events)
"""


fragment("ev", _canonical(120))
fragment("evw", _canonical(1))
fragment("lab", "SELECT event_id, ts, usr, src, dst FROM ev WHERE is_redteam = 1", "ev")

# profiles
fragment("pairs", "SELECT usr, coalesce(dst, src) AS host, count(*) AS pair_count FROM ev "
         "WHERE usr IS NOT NULL AND coalesce(dst, src) IS NOT NULL GROUP BY 1, 2", "ev")
fragment("procs", "SELECT proc, count(*) AS process_count FROM ev WHERE proc IS NOT NULL GROUP BY 1", "ev")
fragment("recent_auth", "SELECT event_id, count(*) OVER (PARTITION BY usr ORDER BY ts "
         "RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS n_recent FROM ev WHERE event_type = 'auth'", "ev")
fragment("recent_proc", "SELECT event_id, count(*) OVER (PARTITION BY src ORDER BY ts "
         "RANGE BETWEEN 120 PRECEDING AND CURRENT ROW) AS n_recent FROM ev WHERE event_type = 'process'", "ev")

# triage: one 0/1 column per rule, then the score
fragment("fired", """
SELECT e.*, coalesce(dst, src) AS pair_host,
  CAST(e.event_type = 'auth' AND contains(lower(details), 'fail') AS INT) AS r1,
  CAST(coalesce(a.n_recent, 0) > 3 AS INT) AS r2,
  CAST(e.event_type = 'auth' AND (contains(lower(details), 'ntlm') OR contains(lower(details), 'network')) AS INT) AS r3,
  CAST(p.pair_count <= 1 AS INT) AS r4,
  CAST(coalesce(c.process_count, 99) < 15 AS INT) AS r5,
  CAST(coalesce(b.n_recent, 0) > 3 AS INT) AS r6,
  CAST(coalesce(bytes, 0) > 50000 OR coalesce(duration, 0) > 100 AS INT) AS r7,
  a.n_recent AS auth_recent, b.n_recent AS proc_recent
FROM ev e LEFT JOIN recent_auth a USING (event_id) LEFT JOIN recent_proc b USING (event_id)
JOIN pairs p ON p.usr = e.usr AND p.host = coalesce(e.dst, e.src) LEFT JOIN procs c ON c.proc = e.proc
""", "ev", "recent_auth", "recent_proc", "pairs", "procs")


fragment("triaged", """
SELECT *, points + CASE WHEN n >= 2 THEN 2 ELSE 0 END AS risk,
  CAST(points + CASE WHEN n >= 2 THEN 2 ELSE 0 END >= 3 AS INT) AS flagged,
  concat_ws(';', CASE WHEN r1 = 1 THEN 'R1_AUTH_FAILURE' END, CASE WHEN r2 = 1 THEN 'R2_AUTH_BURST' END,
    CASE WHEN r3 = 1 THEN 'R3_UNUSUAL_AUTH' END, CASE WHEN r4 = 1 THEN 'R4_RARE_USER_HOST' END,
    CASE WHEN r5 = 1 THEN 'R5_SUSPICIOUS_PROC' END, CASE WHEN r6 = 1 THEN 'R6_PROC_BURST' END,
    CASE WHEN r7 = 1 THEN 'R7_NETWORK_ANOMALY' END, CASE WHEN n >= 2 THEN 'R10_TEMPORAL_BURST' END) AS rules,
  concat_ws(' | ', CASE WHEN r1 = 1 THEN 'Authentication attempt failed' END,
    CASE WHEN r2 = 1 THEN 'Rapid auth burst: ' || auth_recent || ' logons in 5 minutes' END,
    CASE WHEN r3 = 1 THEN 'Network logon / NTLM authentication protocol observed' END,
    CASE WHEN r4 = 1 THEN 'Rare user-to-host lateral mapping (' || usr || ' -> ' || pair_host || ')' END,
    CASE WHEN r5 = 1 THEN 'Infrequently executed process (' || proc || ')' END,
    CASE WHEN r6 = 1 THEN 'Process burst: ' || proc_recent || ' processes spawned in 2 minutes' END,
    CASE WHEN r7 = 1 THEN 'High-volume or prolonged network flow (' || bytes || ' bytes, ' || duration || 's)' END,
    CASE WHEN n >= 2 THEN 'Compound threat: ' || n || ' distinct risk indicators triggered simultaneously' END) AS reasons
FROM (SELECT *, r1 + r2 + r3 + r4 + r5 + r6 + r7 AS n, 2*r1 + 2*r2 + r3 + 2*r4 + 2*r5 + 2*r6 + r7 AS points FROM fired)
""", "fired")

fragment("cand", "SELECT *, CASE event_type WHEN 'auth' THEN 'AuthenticationAgent' WHEN 'process' THEN 'ProcessAgent' "
         "ELSE 'NetworkAgent' END AS agent FROM triaged WHERE flagged = 1", "triaged")

# correlation: consecutive events of one entity within the gap are linked
def correlation(prefix, gap, source="cand"):
    fragment(f"{prefix}ent", f"SELECT event_id, ts, 'u' || usr AS e FROM {source} UNION ALL "
             f"SELECT event_id, ts, 'h' || src FROM {source} UNION ALL "
             f"SELECT event_id, ts, 'h' || dst FROM {source} WHERE dst IS NOT NULL AND dst <> src", source)
    fragment(f"{prefix}nxt", f"SELECT event_id AS a, lead(event_id) OVER w AS b, lead(ts) OVER w - ts AS gap FROM {prefix}ent "
             "WINDOW w AS (PARTITION BY e ORDER BY ts, event_id)", f"{prefix}ent")
    fragment(f"{prefix}lnk", f"SELECT a, b FROM {prefix}nxt WHERE gap <= {gap} UNION SELECT b, a FROM {prefix}nxt WHERE gap <= {gap}",
             f"{prefix}nxt")
    reach = f"{prefix}reach(n, m) USING KEY (n)"  # the smallest event that reaches n, so far
    fragment(reach, f"SELECT event_id, event_id FROM {source} UNION SELECT l.b, min(r.m) FROM {prefix}reach r JOIN {prefix}lnk l ON l.a = r.n "
             f"JOIN recurring.{prefix}reach p ON p.n = l.b WHERE r.m < p.m GROUP BY l.b", f"{prefix}lnk")
    fragment(f"{prefix}comp", f"SELECT n AS event_id, m AS component FROM {prefix}reach", reach)
    fragment(f"{prefix}mem", f"SELECT c.*, k.component FROM {source} c JOIN {prefix}comp k USING (event_id) "
             f"WHERE component IN (SELECT component FROM {source} JOIN {prefix}comp USING (event_id) GROUP BY 1 "
             "HAVING count(*) >= 3 OR max(risk) >= 5)", f"{prefix}comp")


correlation("", 600)
correlation("g300_", 300)
correlation("g1800_", 1800)
fragment("bridge", "SELECT DISTINCT component, 'user' AS entity_type, usr AS entity FROM mem UNION "
         "SELECT DISTINCT component, 'host', src FROM mem UNION SELECT DISTINCT component, 'host', dst FROM mem WHERE dst IS NOT NULL UNION "
         "SELECT DISTINCT component, 'process', proc FROM mem WHERE proc IS NOT NULL", "mem")
fragment("inc0", """
SELECT component, min(ts) AS t0, max(ts) AS t1, greatest(1, max(ts) - min(ts)) AS dur, count(*) AS n,
  max(risk) AS max_risk, CAST(sum(risk) AS BIGINT) AS sum_risk,
  string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS sources, count(DISTINCT event_type) AS n_sources,
  string_agg(DISTINCT agent, ';' ORDER BY agent) AS agents, count(DISTINCT agent) AS n_agents,
  string_agg(DISTINCT usr, ';' ORDER BY usr) AS users, count(DISTINCT usr) AS n_users,
  any_value(h.hosts) AS hosts, any_value(h.n) AS n_hosts,
  coalesce(string_agg(DISTINCT proc, ';' ORDER BY proc), '') AS processes, count(DISTINCT proc) AS n_processes,
  max(CAST(contains(rules, 'BURST') AS INT)) AS has_burst
FROM mem JOIN (SELECT component, string_agg(entity, ';' ORDER BY entity) AS hosts, count(*) AS n FROM bridge WHERE entity_type = 'host' GROUP BY 1) h USING (component)
GROUP BY component""", "mem", "bridge")
fragment("inc", "SELECT *, 'INC-' || CASE WHEN no < 10000 THEN lpad(CAST(no AS VARCHAR), 4, '0') ELSE CAST(no AS VARCHAR) END AS incident_id "
         "FROM (SELECT *, row_number() OVER (ORDER BY t0, n DESC, component) AS no FROM inc0)", "inc0")
SCORED = """
SELECT *, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 25 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN risk_v1 >= 75 THEN 'Critical' WHEN risk_v1 >= 50 THEN 'High' WHEN risk_v1 >= 25 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN confidence_v1 >= 70 THEN 'High' WHEN confidence_v1 >= 40 THEN 'Medium' ELSE 'Low' END AS confidence_level
FROM (SELECT *,
  least(100.0::DOUBLE, round_even(base + reach_bonus + least(10.0::DOUBLE, n / dur * 90.0::DOUBLE)
     + CASE WHEN n_agents >= 3 THEN 15.0 WHEN n_agents >= 2 THEN 10.0 ELSE 0.0 END::DOUBLE, 1)) AS risk_score,
  CAST(least(100.0::DOUBLE, round_even(base + reach_bonus + least(10.0::DOUBLE, n / dur * 60.0::DOUBLE * 1.5::DOUBLE)
     + CASE WHEN max_risk >= 6 OR has_burst = 1 THEN 15.0 ELSE 0.0 END::DOUBLE, 0)) AS BIGINT) AS risk_v1,
  least(100.0::DOUBLE, round_even(least(50.0::DOUBLE, greatest(n_sources, n_agents) * 12.5::DOUBLE) + vol + 15.0::DOUBLE
     + least(15.0::DOUBLE, sum_risk / n / 8.0::DOUBLE * 15.0::DOUBLE), 1)) AS confidence_score,
  CAST(least(100.0::DOUBLE, round_even(least(50.0::DOUBLE, n_sources * 12.5::DOUBLE) + vol + 15.0::DOUBLE
     + CASE WHEN dur > 300 AND n >= 5 THEN 15.0 WHEN n >= 3 THEN 8.0 ELSE 0.0 END::DOUBLE, 0)) AS BIGINT) AS confidence_v1
FROM (SELECT *, least(55.0::DOUBLE, max_risk * 3.5::DOUBLE + ln(1 + sum_risk) * 5.0::DOUBLE) AS base,
  least(20.0::DOUBLE, greatest(0, n_hosts - 1) * 4.0::DOUBLE) AS reach_bonus, least(20.0::DOUBLE, log2(n + 1) * 4.0::DOUBLE) AS vol FROM %s))"""
fragment("scored", SCORED % "inc", "inc")

# lists
fragment("iocs", "SELECT DISTINCT 'user' AS type, usr AS value FROM ev WHERE md5(usr) LIKE '7%' UNION "
         "SELECT DISTINCT 'host', dst FROM ev WHERE md5(dst) LIKE '7%' UNION "
         "SELECT DISTINCT 'process', proc FROM ev WHERE md5(proc) LIKE '7%'", "ev")
fragment("verd", """
SELECT o_orderkey AS seq, 'INC-' || o_custkey AS incident_id, 'U' || o_custkey AS usr, 'C' || length(o_orderpriority) AS host,
  CASE o_orderstatus WHEN 'O' THEN 'watch' WHEN 'F' THEN 'safe' END AS lst FROM orders""")
fragment("learned", "SELECT type, value, arg_max(lst, seq) AS lst FROM (SELECT seq, lst, 'user' AS type, usr AS value FROM verd UNION ALL "
         "SELECT seq, lst, 'host', host FROM verd) WHERE lst IS NOT NULL GROUP BY 1, 2", "verd")

# windows
fragment("rare", "SELECT proc FROM ev WHERE ts <= 702000 AND event_type = 'process' GROUP BY 1 HAVING count(*) <= 5", "ev")
fragment("ind", """
SELECT *, CAST(event_type = 'auth' AS INT) AS is_auth, CAST(event_type = 'process' AS INT) AS is_proc,
  CAST(event_type = 'dns' AS INT) AS is_dns, CAST(event_type = 'flow' AS INT) AS is_flow,
  CAST(event_type = 'auth' AND (contains(lower(details), 'fail') OR contains(lower(action), 'fail')) AS INT) AS auth_fail,
  CAST(event_type = 'auth' AND contains(lower(details), 'ntlm') AS INT) AS auth_ntlm,
  CAST(event_type = 'auth' AND ((ts % 86400) // 3600 < 6 OR (ts % 86400) // 3600 >= 20) AS INT) AS auth_off_hours,
  CAST(event_type = 'process' AND proc IN (SELECT proc FROM rare) AS INT) AS proc_rare FROM ev""", "ev", "rare")


def windows(name, size, label):
    fragment(name, f"""
SELECT (ts - 691200) // {size} AS window_id, count(*) AS total_events,
  CAST(sum(is_auth) AS BIGINT) AS is_auth, CAST(sum(auth_fail) AS BIGINT) AS auth_fail, CAST(sum(auth_ntlm) AS BIGINT) AS auth_ntlm,
  CAST(sum(auth_off_hours) AS BIGINT) AS auth_off_hours, CAST(sum(is_proc) AS BIGINT) AS is_proc,
  CAST(sum(proc_rare) AS BIGINT) AS proc_rare, CAST(sum(is_dns) AS BIGINT) AS is_dns, CAST(sum(is_flow) AS BIGINT) AS is_flow,
  count(DISTINCT usr) AS "user", count(DISTINCT dst) AS destination_host, count(DISTINCT src) AS source_host,
  count(DISTINCT proc) AS process, max({label}) AS label FROM ind GROUP BY 1""", "ind")
    fragment(f"{name}_r", f"""
SELECT *, auth_fail / (is_auth + 1e-5::DOUBLE) AS auth_fail_rate, auth_ntlm / (is_auth + 1e-5::DOUBLE) AS auth_ntlm_rate,
  "user" / (destination_host + 1e-5::DOUBLE) AS user_to_host_ratio,
  CAST(is_auth > 0 AS INT) + CAST(is_proc > 0 AS INT) + CAST(is_dns > 0 AS INT) + CAST(is_flow > 0 AS INT) AS active_sources,
  CAST(CAST(is_auth > 0 AS INT) + CAST(is_proc > 0 AS INT) + CAST(is_dns > 0 AS INT) + CAST(is_flow > 0 AS INT) >= 2 AS INT) AS multi_source_flag,
  ln(1 + is_auth) * ln(1 + is_proc) AS auth_proc_interaction, ln(1 + is_auth) * ln(1 + is_flow) AS auth_flow_interaction,
  CASE WHEN window_id * {size} + 691200 < 702000 THEN 'train' WHEN window_id * {size} + 691200 < 707400 THEN 'validation' ELSE 'test' END AS split
FROM {name}""", name)
    fragment(f"{name}_f", f"""
SELECT *, coalesce(total_events - lag(total_events) OVER w, 0) AS delta_total_events,
  coalesce(auth_fail - lag(auth_fail) OVER w, 0) AS delta_auth_fails, coalesce(is_proc - lag(is_proc) OVER w, 0) AS delta_procs
FROM {name}_r WINDOW w AS (PARTITION BY split ORDER BY window_id)""", f"{name}_r")


windows("win", 300, "is_redteam")
windows("mlw", 30, "is_extreme")
