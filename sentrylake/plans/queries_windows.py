"""Queries: window features, evaluation, models and streams."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.operators import baselines as B
from sentrylake.operators import correlate as C
from sentrylake.operators import evaluate as EV
from sentrylake.operators import explore as E
from sentrylake.operators import features as X
from sentrylake.operators import ml as M
from sentrylake.operators.lists import build_iocs
from sentrylake.operators.triage import triage
from sentrylake.plans import queries_incidents  # noqa: F401  (its SQL fragments are used here)
from sentrylake.plans.fragments import fragment
from sentrylake.plans.investigate import investigate
from sentrylake.plans.registry import register
from sentrylake.plans.workspace import TRAIN_END
from sentrylake.session import materialize
from sentrylake.sources.driver_tables import threat_rows

INT_FEATURES = [f for f in V.WINDOW_FEATURES if f not in (
    "auth_fail_rate", "auth_ntlm_rate", "user_to_host_ratio", "auth_proc_interaction", "auth_flow_interaction")]


def feature_sql(name, table):
    cols = ", ".join(
        f'CAST("{f}" AS BIGINT) AS "{f}"' if f in INT_FEATURES else f'round("{f}", 6) AS "{f}"' for f in V.WINDOW_FEATURES)
    return f"SELECT window_id, {cols}, CAST(label AS BIGINT) AS label FROM {table}"


# ---- window features -----------------------------------------------------------------------

register("tumbling_features", lambda w: X.tumbling_features(w.indicated).select(
    "window_id", "total_events", *X.COUNTED, *X.DISTINCT, "label"), """
SELECT window_id, total_events, is_auth, auth_fail, auth_ntlm, auth_off_hours, is_proc, proc_rare, is_dns, is_flow, "user", destination_host, source_host, process,
 CAST(label AS BIGINT) AS label FROM win""", ["win"])
register("ratio_features", lambda w: X.ratio_features(X.tumbling_features(w.indicated)).select(
    "window_id", "auth_fail_rate", "auth_ntlm_rate", "user_to_host_ratio", "active_sources", "multi_source_flag", "auth_proc_interaction", "auth_flow_interaction"), """
SELECT window_id, round(auth_fail_rate, 6) AS auth_fail_rate, round(auth_ntlm_rate, 6) AS auth_ntlm_rate, round(user_to_host_ratio, 6) AS user_to_host_ratio,
 CAST(active_sources AS BIGINT) AS active_sources, CAST(multi_source_flag AS BIGINT) AS multi_source_flag, round(auth_proc_interaction, 6) AS auth_proc_interaction,
 round(auth_flow_interaction, 6) AS auth_flow_interaction FROM win_r""", ["win_r"])
register("window_features", lambda w: X.window_features(w.indicated, split=w.split_of(300)).drop("split"), feature_sql("window_features", "win_f"), ["win_f"])
register("window_features_from_first_event", lambda w: X.tumbling_features(
    w.indicated.filter(F.col("timestamp") > TRAIN_END), origin=X.origin_of(w.events.filter(F.col("timestamp") > TRAIN_END))).select(
    "window_id", "total_events", "auth_fail", "user"), """
SELECT (ts - (SELECT min(ts) FROM ev WHERE ts > 702000)) // 300 AS window_id, count(*) AS total_events, CAST(sum(auth_fail) AS BIGINT) AS auth_fail,
 count(DISTINCT usr) AS "user" FROM ind WHERE ts > 702000 GROUP BY 1""", ["ind"])
register("delta_features", lambda w: w.ml_windows.select("window_id", "delta_total_events", "delta_auth_fails", "delta_procs"),
         "SELECT window_id, delta_total_events, delta_auth_fails, delta_procs FROM mlw_f", ["mlw_f"])
seconds = lambda w: X.tumbling_features(w.indicated, 1)  # short enough to leave gaps
fragment("part_w", "SELECT ts - 691200 AS window_id, count(*) AS total_events, sum(auth_fail) AS auth_fail, sum(is_proc) AS is_proc FROM ind GROUP BY 1", "ind")
fragment("densew", "SELECT d AS window_id, coalesce(total_events, 0) AS total_events, coalesce(auth_fail, 0) AS auth_fail, coalesce(is_proc, 0) AS is_proc FROM "
         "(SELECT unnest(range((SELECT min(window_id) FROM part_w), (SELECT max(window_id) FROM part_w) + 1)) AS d) LEFT JOIN part_w ON d = window_id", "part_w")
register("densify_windows", lambda w: X.densify_windows(seconds(w)).select("window_id", "total_events", "auth_fail", "is_proc"), """
SELECT window_id, CAST(total_events AS BIGINT) AS total_events, CAST(auth_fail AS BIGINT) AS auth_fail, CAST(is_proc AS BIGINT) AS is_proc FROM densew""", ["densew"])
register("delta_features_dense", lambda w: X.delta_features(X.densify_windows(seconds(w)), dense=True).select(
    "window_id", "delta_total_events", "delta_auth_fails", "delta_procs"), """
SELECT window_id, CAST(total_events - coalesce(lag(total_events) OVER (ORDER BY window_id), 0) AS BIGINT) AS delta_total_events,
 CAST(auth_fail - coalesce(lag(auth_fail) OVER (ORDER BY window_id), 0) AS BIGINT) AS delta_auth_fails,
 CAST(is_proc - coalesce(lag(is_proc) OVER (ORDER BY window_id), 0) AS BIGINT) AS delta_procs FROM densew""", ["densew"])
register("feature_vector_16", lambda w: X.feature_vector_16(w.indicated), """
SELECT window_id, total_events, is_auth, auth_fail, round(auth_fail_rate, 6) AS auth_fail_ratio, auth_ntlm, auth_off_hours, is_proc, proc_rare, is_dns, is_flow, "user",
 destination_host, source_host, process, CAST(active_sources AS BIGINT) AS active_sources, CAST(multi_source_flag AS BIGINT) AS multi_source_flag, CAST(label AS BIGINT) AS label
FROM win_r""", ["win_r"])
register("chronological_split", lambda w: w.wide.withColumn("split", X.chronological_split(
    train_end=691200 + 86400 * 18, validation_end=691200 + 86400 * 24, end=691200 + 86400 * 29)).groupBy("split").agg(
    F.count("*").alias("events"), F.sum("is_redteam").alias("labels")), """
SELECT CASE WHEN ts < 691200 + 86400 * 18 THEN 'train' WHEN ts < 691200 + 86400 * 24 THEN 'validation' WHEN ts < 691200 + 86400 * 29 THEN 'test' END AS split,
 count(*) AS events, CAST(sum(is_redteam) AS BIGINT) AS labels FROM evw GROUP BY 1""", ["evw"])
extreme = lambda w: w.events.filter("is_extreme = 1")
fragment("xl", "SELECT (ts - 691200) // 60 AS window_id, count(*) AS n FROM ev WHERE is_extreme = 1 GROUP BY 1", "ev")
register("window_labels", lambda w: X.window_labels(extreme(w), 0, 359, size=60), """
SELECT d AS window_id, coalesce(n, 0) AS label_rows, CAST(n IS NOT NULL AS BIGINT) AS y FROM (SELECT unnest(range(0, 360)) AS d) LEFT JOIN xl ON d = window_id""", ["xl"])
register("window_bounds", lambda w: X.window_bounds(w.events, extreme(w), size=60), """
SELECT window_id, window_id * 60 + 691200 AS nominal_start, window_id * 60 + 691260 AS nominal_end, a AS t_start_observed, b AS t_end_observed, b - a AS observed_duration,
 c AS total_events, coalesce(n, 0) AS label_events, CAST(n IS NOT NULL AS BIGINT) AS ground_truth FROM
 (SELECT (ts - 691200) // 60 AS window_id, min(ts) AS a, max(ts) AS b, count(*) AS c FROM ev GROUP BY 1) LEFT JOIN xl USING (window_id)""", ["xl"])
fragment("side", "SELECT event_id, ts, event_type, src AS host, dst AS peer, 'src' AS role FROM ev UNION ALL "
         "SELECT event_id, ts, event_type, dst, src, 'dst' FROM ev WHERE dst IS NOT NULL", "ev")
fragment("hw", """
SELECT host, (ts - 691200) // 300 AS window_id, count(DISTINCT event_id) AS events_total, count(*) FILTER (role = 'src') AS events_as_src,
 count(*) FILTER (role = 'dst') AS events_as_dst, count(DISTINCT event_id) FILTER (event_type = 'auth') AS auth_events,
 count(DISTINCT event_id) FILTER (event_type = 'process') AS proc_events, count(DISTINCT event_id) FILTER (event_type = 'flow') AS flow_events,
 count(DISTINCT event_id) FILTER (event_type = 'dns') AS dns_events, count(DISTINCT peer) FILTER (peer <> host) AS distinct_peers,
 max(CAST((ts % 86400) // 3600 < 8 OR (ts % 86400) // 3600 >= 18 AS INT)) AS auth_off_hours FROM side GROUP BY 1, 2""", "side")
register("host_window_features", lambda w: X.host_window_features(w.events), """
SELECT a.host, a.window_id, a.events_total, a.events_as_src, a.events_as_dst, a.auth_events, a.proc_events, a.flow_events, a.dns_events, a.distinct_peers,
 CAST(a.events_as_src > 0 AS BIGINT) AS is_src, CAST(a.events_as_dst > 0 AS BIGINT) AS is_dst, a.events_total - coalesce(b.events_total, 0) AS delta_events,
 CAST(a.auth_off_hours AS BIGINT) AS auth_off_hours FROM hw a LEFT JOIN hw b ON b.host = a.host AND b.window_id = a.window_id - 1""", ["hw"])
register("host_window_labels", lambda w: X.host_window_labels(X.host_window_features(w.events).select("host", "window_id"), extreme(w)), """
SELECT host, window_id, CAST((host, window_id) IN (SELECT (src, (ts - 691200) // 300) FROM ev WHERE is_extreme = 1 UNION ALL
 SELECT (dst, (ts - 691200) // 300) FROM ev WHERE is_extreme = 1 AND dst IS NOT NULL) AS BIGINT) AS y FROM hw""", ["hw"])
scored_windows = lambda w: w.windows.select("window_id", "split", "label", (F.col("auth_fail_rate") + F.col("is_flow") / 100).alias("score"))
fragment("sw", "SELECT window_id, split, label, auth_fail_rate + is_flow / 100 AS score FROM win_f", "win_f")
register("rolling_score", lambda w: X.rolling_score(scored_windows(w)).select("window_id", "centered_max", "trailing_mean"), """
SELECT window_id, round(max(score) OVER (PARTITION BY split ORDER BY window_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS centered_max,
 round(avg(score) OVER (PARTITION BY split ORDER BY window_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM sw""", ["sw"])
register("window_size_sweep", lambda w: X.window_size_sweep(w.events), """
SELECT CAST(s AS BIGINT) AS size, count(*) AS windows, CAST(sum(y) AS BIGINT) AS attack_windows FROM
 (SELECT s, (ts - 691200) // s AS win, max(is_redteam) AS y FROM ev, (SELECT unnest([10, 30, 60, 300]) AS s) GROUP BY 1, 2) GROUP BY 1""", ["ev"])


def long_sql(table):
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, split, window_id, label, CAST(\"{f}\" AS DOUBLE) AS value FROM {table}" for f in V.WINDOW_FEATURES)


fragment("lw", long_sql("mlw_f"), "mlw_f")
register("feature_shift", lambda w: X.feature_shift(w.ml_windows), """
SELECT feature, split, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM lw GROUP BY 1, 2""", ["lw"])
fragment("edges", "SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM lw WHERE split = 'train' GROUP BY 1", "lw")
register("psi", lambda w: X.psi(w.ml_windows), """
SELECT feature, round(v, 6) AS psi, CASE WHEN v < 0.1 THEN 'stable' WHEN v < 0.25 THEN 'moderate' ELSE 'shifted' END AS band FROM (
 SELECT feature, sum((q - p) * ln(q / p)) AS v FROM (
  SELECT feature, bin, greatest(count(*) FILTER (split = 'train') / any_value(np), 1e-6) AS p, greatest(count(*) FILTER (split = 'test') / any_value(nq), 1e-6) AS q FROM (
   SELECT feature, split, len(list_filter(e, lambda x: x < value)) AS bin, np, nq FROM lw JOIN edges USING (feature),
    (SELECT count(*) FILTER (split = 'train') AS np, count(*) FILTER (split = 'test') AS nq FROM mlw_f) WHERE split IN ('train', 'test')) GROUP BY 1, 2) GROUP BY 1)""", ["lw", "edges"])
# products of logarithms tie only up to their last bits, so ranks are taken on nine decimals
fragment("lwr", "SELECT * REPLACE (round(value, 9) AS value) FROM lw", "lw")
register("feature_label_corr", lambda w: X.feature_label_corr(w.ml_windows.withColumns(
    {f: F.round(f, 9) for f in V.WINDOW_FEATURES if f not in INT_FEATURES})), """
SELECT feature, split, CASE WHEN stddev_pop(value) > 0 AND stddev_pop(label) > 0 THEN round(corr(value, label), 6) + 0.0::DOUBLE END AS pearson,
 CASE WHEN stddev_pop(value) > 0 AND stddev_pop(label) > 0 THEN round(corr(r, label), 6) + 0.0::DOUBLE END AS spearman FROM (
 SELECT *, rank() OVER (PARTITION BY feature, split ORDER BY value) + (count(*) OVER (PARTITION BY feature, split, value) - 1) / 2 AS r FROM lwr) GROUP BY 1, 2""", ["lwr"])

# ---- evaluation ------------------------------------------------------------------------------

by_event = lambda w: w.triaged.select("event_id", F.col("is_redteam").alias("y"), F.col("risk_score").alias("score"), F.col("is_suspicious").alias("pred"))
fragment("be", "SELECT event_id, is_redteam AS y, risk AS score, flagged AS pred FROM triaged", "triaged")
# a score every event has: flow size and length, else a small share of the id
by_size = lambda w: w.events.select(F.col("is_redteam").alias("y"), F.coalesce(F.col("bytes") % 1009 / 1009 + F.col("duration") / 400, F.col("event_id") % 97 / 485).alias("score"))
fragment("bs", "SELECT is_redteam AS y, coalesce((bytes % 1009) / 1009 + duration / 400, (event_id % 97) / 485) AS score FROM ev", "ev")


def metric_sql(source, group=""):
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {g}tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
 round(coalesce(fp / nullif(tn + fp, 0), 0), 6) AS fpr, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy
FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM
 (SELECT {g}count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn,
  count(*) FILTER (y = 0 AND pred = 0) AS tn FROM ({source}) {by}))"""


register("confusion_metrics", lambda w: EV.confusion_metrics(by_event(w)), metric_sql("SELECT * FROM be"), ["be"])
for name, rows, fr in (("roc_auc", by_event, "be"), ("roc_auc_continuous", by_size, "bs")):
    register(name, lambda w, rows=rows: EV.roc_auc(rows(w)), f"""
SELECT round(u, 6) AS u_statistic, round(u / (p * n), 6) AS roc_auc FROM (SELECT sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2 AS u,
 count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM {fr}))""", [fr])
fragment("cum", "SELECT score, sum(n) OVER w AS cn, sum(p) OVER w AS cp, n, p, (SELECT sum(y) FROM bs) AS pa, (SELECT count(*) FROM bs) AS na FROM "
         "(SELECT score, count(*) AS n, sum(y) AS p FROM bs GROUP BY 1) WINDOW w AS (ORDER BY score DESC)", "bs")
register("average_precision", lambda w: EV.average_precision(by_size(w)), "SELECT round(sum(p / pa * cp / cn), 6) AS average_precision FROM cum", ["cum"])
register("pr_auc_trapezoid", lambda w: EV.pr_auc_trapezoid(by_size(w)), """
SELECT round(sum((r - pr) * (p + pp) / 2), 6) AS pr_auc FROM (SELECT cp / pa AS r, cp / cn AS p, coalesce(lag(cp / pa) OVER (ORDER BY score DESC), 0) AS pr,
 coalesce(lag(cp / cn) OVER (ORDER BY score DESC), 1) AS pp FROM cum)""", ["cum"])
register("pr_curve", lambda w: EV.pr_curve(by_size(w)).select("threshold", "precision", "recall"),
         "SELECT round(score, 6) AS threshold, round(cp / cn, 6) AS precision, round(cp / pa, 6) AS recall FROM cum", ["cum"])
register("roc_curve", lambda w: EV.roc_curve(by_size(w)),
         "SELECT round(score, 6) AS threshold, round(cp / pa, 6) AS tpr, round((cn - cp) / (na - pa), 6) AS fpr FROM cum", ["cum"])
GRID = [round(0.05 * i, 2) for i in range(1, 40)]
GRID_SQL = "(SELECT unnest([" + ", ".join(str(g) for g in GRID) + "])::DOUBLE AS threshold)"
sweep = lambda w: EV.threshold_sweep(by_size(w), GRID)
SWEPT = metric_sql(f"SELECT threshold, y, CAST(score >= threshold AS INT) AS pred FROM bs, {GRID_SQL}", "threshold")
register("threshold_sweep", sweep, SWEPT, ["bs"])
register("operating_points", lambda w: EV.threshold_sweep(by_size(w), V.OPERATING_POINTS),
         metric_sql("SELECT threshold, y, CAST(score >= threshold AS INT) AS pred FROM bs, (SELECT unnest([0.8459, 0.93, 0.95])::DOUBLE AS threshold)", "threshold"), ["bs"])
register("best_f1_threshold", lambda w: EV.best_f1_threshold(by_size(w)), """
SELECT round(score, 6) AS threshold, round(2 * cp / (cn + pa), 6) AS f1, round(cp / cn, 6) AS precision, round(cp / pa, 6) AS recall FROM cum
ORDER BY 2 * cp / (cn + pa) DESC, score DESC LIMIT 1""", ["cum"])
fragment("burden", f"SELECT threshold, tp + fp AS alerts, (tp + fp) / 6 AS aph, coalesce(fp / nullif(tp + fp, 0), 0) AS fdr, precision, recall, f1 FROM ({SWEPT})", "bs")
burden = lambda w: EV.alert_burden(sweep(w), 6)
register("alert_burden", burden, """
SELECT threshold, alerts, round(aph, 6) AS alerts_per_hour, round(fdr, 6) AS false_discovery_rate, precision, recall, f1 FROM burden""", ["burden"])
register("constrained_threshold", lambda w: EV.constrained_threshold(burden(w), 40.0, 0.1), """
SELECT threshold, alerts, round(aph, 6) AS alerts_per_hour, round(fdr, 6) AS false_discovery_rate, precision, recall, f1 FROM burden
WHERE aph <= 40 AND precision >= 0.1 ORDER BY f1 DESC, threshold DESC LIMIT 1""", ["burden"])
register("score_distribution", lambda w: EV.score_distribution(by_size(w)), """
SELECT CAST(y AS BIGINT) AS y, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS minimum, round(quantile_cont(score, 0.25), 6) AS q1,
 round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS maximum FROM bs GROUP BY 1""", ["bs"])
severe = lambda w: w.full.members.join(w.full.responses.filter("severity in ('Critical', 'High')").select("component"), "component", "left_semi")
register("event_level_eval", lambda w: EV.event_level_eval(w.events, w.full.findings, w.full.members, severe(w)), metric_sql("""
SELECT 'specialists' AS scope, is_redteam AS y, CAST(event_id IN (SELECT event_id FROM finds) AS INT) AS pred FROM ev UNION ALL
SELECT 'incidents', is_redteam, CAST(event_id IN (SELECT event_id FROM imem) AS INT) FROM ev UNION ALL
SELECT 'escalated', is_redteam, CAST(event_id IN (SELECT event_id FROM imem JOIN iscored USING (component) WHERE severity IN ('Critical', 'High')) AS INT) FROM ev""", "scope"), ["finds", "imem", "iscored"], wide=True)
fragment("near", """
SELECT l.event_id, i.component, greatest(0, i.t0 - l.ts, l.ts - i.t1) AS d FROM (SELECT event_id, ts, usr, src, dst FROM ev WHERE is_redteam = 1) l JOIN inc i
ON greatest(0, i.t0 - l.ts, l.ts - i.t1) <= 600 AND (list_contains(string_split(i.users, ';'), l.usr) OR list_contains(string_split(i.hosts, ';'), l.src) OR list_contains(string_split(i.hosts, ';'), l.dst))""", "inc", "ev")
register("incident_attack_match", lambda w: EV.incident_attack_match(w.labels, w.members, w.bridge), """
SELECT CAST(t AS BIGINT) AS tolerance, a AS attacks, c AS captured, a - c AS missed, round(c * 100 / a, 2) AS attack_recall, i AS incidents, h AS tp_incidents, i - h AS fp_incidents,
 round(h * 100 / i, 2) AS incident_precision FROM (SELECT t, count(DISTINCT event_id) FILTER (d <= t) AS c, count(DISTINCT component) FILTER (d <= t) AS h FROM near,
 (SELECT unnest([0, 60, 300, 600]) AS t) GROUP BY 1), (SELECT count(*) AS a FROM ev WHERE is_redteam = 1), (SELECT count(*) AS i FROM inc)""", ["near"], wide=True)
register("unmatched_attacks", lambda w: EV.unmatched_attacks(w.labels, w.members, w.bridge).select("event_id", "timestamp", "user"), """
SELECT event_id, ts AS timestamp, usr AS "user" FROM ev WHERE is_redteam = 1 AND event_id NOT IN (SELECT event_id FROM near WHERE d <= 60)""", ["near"], wide=True)


def minute_windows(w):
    return X.window_bounds(w.stored, w.labels, size=60).select(
        "window_id", F.col("t_start_observed").alias("t_start"), F.col("t_end_observed").alias("t_end"), F.col("ground_truth").alias("y"))


fragment("mw", "SELECT (ts - 691200) // 60 AS window_id, min(ts) AS a, max(ts) AS b, max(is_redteam) AS y FROM ev GROUP BY 1", "ev")
flagged = lambda w: w.triaged.filter("is_suspicious = 1")
spans = lambda w: w.incidents.select("time_start", "time_end")
register("window_alert_overlap", lambda w: EV.window_alert_overlap(minute_windows(w), flagged(w), spans(w)).select("window_id", "event_alert", "incident_alert"), """
SELECT window_id, CAST(EXISTS (SELECT 1 FROM triaged t WHERE t.flagged = 1 AND t.ts BETWEEN a AND b) AS BIGINT) AS event_alert,
 CAST(EXISTS (SELECT 1 FROM inc WHERE t1 >= a AND t0 <= b) AS BIGINT) AS incident_alert FROM mw""", ["mw", "triaged", "inc"], wide=True)
graph = lambda w: C.graph_alert_clusters(w.stored, gap=60).select("time_start", "time_end")
# a fixed linear model of window features, so that its scores can be compared
minute_score = lambda w: X.tumbling_features(w.indicated, 60).select(
    "window_id", (3 * (F.col("is_flow") + F.col("auth_fail")) / F.col("total_events")).alias("score"))
fragment("gspan", "SELECT m, min(ts) AS t0, max(ts) AS t1 FROM gcc60 JOIN ev ON event_id = n JOIN (SELECT m, count(DISTINCT e) AS h FROM gcc60 JOIN gent ON event_id = n "
         "WHERE e LIKE 'h%' GROUP BY 1) USING (m) GROUP BY 1 HAVING count(*) >= 3 AND any_value(h) >= 2", "gcc60(n, m) USING KEY (n)")
register("four_system_comparison", lambda w: EV.four_system_comparison(minute_windows(w), flagged(w), graph(w), minute_score(w), spans(w)), metric_sql("""
SELECT system, y, CASE system WHEN 'rule_triage' THEN e WHEN 'incidents' THEN i WHEN 'graph_clusters' THEN g WHEN 'model_0.8459' THEN CAST(coalesce(s >= 0.8459, FALSE) AS INT)
 ELSE CAST(coalesce(s >= 0.93, FALSE) AS INT) END AS pred FROM
 (SELECT y, CAST(EXISTS (SELECT 1 FROM triaged t WHERE t.flagged = 1 AND t.ts BETWEEN a AND b) AS INT) AS e, CAST(EXISTS (SELECT 1 FROM inc WHERE t1 >= a AND t0 <= b) AS INT) AS i,
  CAST(EXISTS (SELECT 1 FROM gspan WHERE t1 >= a AND t0 <= b) AS INT) AS g, s FROM mw LEFT JOIN
  (SELECT (ts - 691200) // 60 AS window_id, 3 * (sum(is_flow) + sum(auth_fail)) / count(*) AS s FROM ind GROUP BY 1) USING (window_id)),
 (SELECT unnest(['rule_triage', 'incidents', 'graph_clusters', 'model_0.8459', 'model_0.93']) AS system)""", "system"), ["mw", "triaged", "inc", "gspan", "ind"], wide=True)
register("specialist_ablation", lambda w: EV.specialist_ablation(w.events, w.findings), metric_sql("""
SELECT CAST(stage AS BIGINT) AS stage, is_redteam AS y, CAST(event_id IN (SELECT event_id FROM finds WHERE CASE agent WHEN 'AuthenticationAgent' THEN 1 WHEN 'ProcessAgent' THEN 2 ELSE 3 END <= stage) AS INT) AS pred
FROM ev, (SELECT unnest([1, 2, 3]) AS stage)""", "stage"), ["finds"])
PERIODS = [("all", 9, 38), ("first", 9, 18), ("last", 30, 38)]
register("period_comparison", lambda w: EV.period_comparison(
    w.wide, w.triaged.filter("is_suspicious = 1").select("event_id", F.lit(1).alias("pred")), PERIODS, E.day_of()), metric_sql("""
SELECT period, e.is_redteam AS y, flagged AS pred FROM evw e JOIN triaged USING (event_id) JOIN (VALUES ('all', 9, 38), ('first', 9, 18), ('last', 30, 38)) AS p(period, lo, hi)
ON e.ts // 86400 + 1 BETWEEN lo AND hi""", "period"), ["evw", "triaged"])
fragment("q0", "SELECT * FROM ev WHERE is_redteam = 0", "ev")
register("label_match_audit", lambda w: EV.label_match_audit(
    w.labels.withColumn("timestamp", F.col("timestamp") + 1), w.events.filter("is_redteam = 0")), """
SELECT criterion, matched, (SELECT count(*) FROM lab) AS labels FROM (
 SELECT unnest(['exact', 'time_user', 'time_source', 'time_destination', 'window_user', 'window_source', 'window_destination']) AS criterion,
  unnest([count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (c), count(*) FILTER (d), count(*) FILTER (e), count(*) FILTER (f), count(*) FILTER (g)]) AS matched FROM (
  SELECT EXISTS (SELECT 1 FROM q0 WHERE q0.ts = l.ts + 1 AND q0.usr = l.usr AND q0.src = l.src AND q0.dst = l.dst) AS a, EXISTS (SELECT 1 FROM q0 WHERE q0.ts = l.ts + 1 AND q0.usr = l.usr) AS b,
   EXISTS (SELECT 1 FROM q0 WHERE q0.ts = l.ts + 1 AND q0.src = l.src) AS c, EXISTS (SELECT 1 FROM q0 WHERE q0.ts = l.ts + 1 AND q0.dst = l.dst) AS d,
   EXISTS (SELECT 1 FROM q0 WHERE (q0.ts - 691200) // 300 = (l.ts + 1 - 691200) // 300 AND q0.usr = l.usr) AS e,
   EXISTS (SELECT 1 FROM q0 WHERE (q0.ts - 691200) // 300 = (l.ts + 1 - 691200) // 300 AND q0.src = l.src) AS f,
   EXISTS (SELECT 1 FROM q0 WHERE (q0.ts - 691200) // 300 = (l.ts + 1 - 691200) // 300 AND q0.dst = l.dst) AS g FROM lab l))""", ["lab", "q0"])
register("label_invariance_check", lambda w: EV.label_invariance_check(
    lambda df: triage(df, rare_pair_at_most=1).select("event_id", "risk_score", "is_suspicious"), w.events).agg(
    F.count("*").alias("differences")), "SELECT CAST(count(*) AS BIGINT) AS differences FROM events WHERE FALSE")


def invariance_of_chain(w):
    """Per stage of the investigation, rows that change when labels are flipped or all zero."""
    def run(events):
        base = B.store_baseline(B.build_baseline(B.baseline_cutoff(events, TRAIN_END)))
        found = investigate(events, base, build_iocs(threat_rows(events)))
        return {
            "findings": found.findings.select("event_id", "agent", "risk_score", "rules", "evidence"),
            "members": found.members.select("event_id", "component"),
            "incidents": found.incidents.select("component", "event_count", "n_users", "n_hosts", "sum_risk"),
            "responses": found.responses.select("component", "risk_score", "confidence_score", "severity", "recommended_action", "explanation"),
        }

    plain = run(w.stored)
    others = [run(w.stored.withColumn("is_redteam", c)) for c in (F.lit(1) - F.col("is_redteam"), F.lit(0))]
    parts = [
        df.exceptAll(other[stage]).unionAll(other[stage].exceptAll(df)).agg(F.lit(stage).alias("stage"), F.count("*").alias("differences"))
        for stage, df in plain.items() for other in others
    ]
    return reduce(DataFrame.unionAll, parts).groupBy("stage").agg(F.sum("differences").alias("differences"))


register("label_invariance_chain", invariance_of_chain, """
SELECT stage, CAST(0 AS BIGINT) AS differences FROM (SELECT unnest(['findings', 'members', 'incidents', 'responses']) AS stage) WHERE EXISTS (SELECT 1 FROM events)""")
register("coverage_metrics", lambda w: EV.coverage_metrics(w.events, w.members), """
SELECT e AS events, CAST(l AS BIGINT) AS labels, c AS captured, li AS label_incidents, i AS incidents, round(c * 100 / l, 6) AS label_coverage, round((e - i) * 100 / e, 6) AS alert_reduction FROM
 (SELECT count(*) AS e, sum(is_redteam) AS l FROM ev), (SELECT count(*) FILTER (is_redteam = 1) AS c, count(DISTINCT component) FILTER (is_redteam = 1) AS li,
  count(DISTINCT component) AS i FROM mem)""", ["ev", "mem"], wide=True)

# ---- models ------------------------------------------------------------------------------------

fragment("tr", "SELECT * FROM mlw_f WHERE split = 'train'", "mlw_f")
register("scale_features", lambda w: M.scale_features(w.ml_split("train"), w.ml_windows, ["total_events", "auth_fail_rate", "delta_procs"]).select(
    "window_id", "total_events", "auth_fail_rate", "delta_procs"), """
SELECT window_id, """ + ", ".join(
    f"round((m.{f} - (SELECT avg({f}) FROM tr)) / (SELECT stddev_pop({f}) FROM tr), 6) AS {f}" for f in ("total_events", "auth_fail_rate", "delta_procs")) + " FROM mlw_f m", ["tr"])
register("class_weights", lambda w: M.class_weights(w.ml_windows).select("window_id", "weight"), """
SELECT window_id, round((SELECT count(*) FROM mlw_f) / (2 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM mlw_f""", ["mlw_f"])
register("majority_baseline", lambda w: M.majority_baseline(w.ml_split("train"), w.ml_windows),
         "SELECT window_id, round((SELECT avg(label) FROM tr), 6) AS score FROM mlw_f", ["tr"])

MODELS = {
    "logistic_regression": lambda: M.logistic_regression(),
    "logistic_regression_l1": lambda: M.logistic_regression(l1=0.01),
    "random_forest": lambda: M.random_forest(trees=40),
    "gradient_boosting": lambda: M.gradient_boosting(rounds=10, depth=4),
    "decision_tree": lambda: M.decision_tree(),
}


def model_scores(w, name):
    model = M.fit(w.ml_split("train"), MODELS[name]())
    return M.score_new_table(model, w.ml_windows, keep=("window_id", "split", "label"))


for model_name in MODELS:
    register(model_name, lambda w, n=model_name: model_scores(w, n))
register("score_new_table", lambda w: M.score_new_table(
    M.fit(w.ml_split("train"), M.random_forest(trees=20)), w.windows.drop("proc_rare", "process")))
register("feature_importance", lambda w: M.feature_importance(M.fit(w.ml_split("train"), M.random_forest(trees=20))))
register("platt_calibration", lambda w: M.platt_calibration(w.ml_split("train"), w.ml_split("test"), M.random_forest(trees=20)))
register("meta_classifier", lambda w: M.meta_classifier(w.ml_windows, M.fit(w.ml_split("train"), M.random_forest(trees=20))))


def measured(scores, name):
    renamed = scores.withColumnRenamed("label", "y")
    best = EV.best_f1_threshold(renamed).select("threshold", "f1")
    return EV.average_precision(renamed).crossJoin(F.broadcast(best)).select(F.lit(name).alias("model"), "threshold", "f1", "average_precision")


def selected(w):
    out = None
    for n in ("logistic_regression", "decision_tree", "random_forest"):
        row = measured(model_scores(w, n).filter("split = 'validation'"), n)
        out = row if out is None else out.unionByName(row)
    return EV.model_select(out)


register("model_select", selected)
STAGES = {
    "counts": ["total_events", "is_auth", "auth_fail"],
    "behavior": ["total_events", "is_auth", "auth_fail", "auth_fail_rate", "auth_off_hours", "proc_rare"],
    "all": V.WINDOW_FEATURES,
}
register("feature_ablation", lambda w: EV.confusion_metrics(
    M.feature_ablation(w.ml_windows, STAGES, M.random_forest(trees=20)).select(
        "stage", F.col("label").alias("y"), (F.col("score") >= 0.5).cast("int").alias("pred")), by=("stage",)))


def isolated(w):
    benign = w.ml_split("train").filter("label = 0")
    forest = M.isolation_forest(benign, V.WINDOW_FEATURES, trees=50)
    fitted = M.isolation_scores(forest, benign, V.WINDOW_FEATURES)
    return M.scaled_by(M.isolation_scores(forest, w.ml_windows, V.WINDOW_FEATURES), fitted).select("window_id", "raw", "score")


register("isolation_forest", isolated)


def certificates(w):
    """What must hold for the fitted models, checked on the rows that they were fitted on."""
    train, fitted = w.ml_split("train"), {n: M.fit(w.ml_split("train"), make()) for n, make in MODELS.items()}
    calibrated = M.platt_calibration(train, w.ml_split("test"), M.random_forest(trees=20))
    benign = train.filter("label = 0")
    rows = [
        M.stationary(fitted["logistic_regression"], train, "logistic_regression"),
        M.calibrated_leaves(fitted["decision_tree"], train, "decision_tree"),
        *[M.better_than_prevalence(model, train, name) for name, model in fitted.items()],
        M.no_inversion(calibrated, "raw_score", "score", "platt_calibration"),
        M.whole_shares(M.feature_importance(fitted["random_forest"]), "feature_importance"),
        M.sound_trees(materialize(M.isolation_forest(benign, V.WINDOW_FEATURES, trees=50)), "isolation_forest"),
    ]
    return reduce(DataFrame.unionAll, rows)


register("model_certificates", certificates, """
SELECT model, certificate, CAST(1 AS BIGINT) AS holds FROM (VALUES ('logistic_regression', 'gradient_zero'), ('decision_tree', 'leaf_shares'),
 ('logistic_regression', 'below_prevalence'), ('logistic_regression_l1', 'below_prevalence'), ('random_forest', 'below_prevalence'),
 ('gradient_boosting', 'below_prevalence'), ('decision_tree', 'below_prevalence'), ('platt_calibration', 'no_inversion'),
 ('feature_importance', 'sum_to_one'), ('isolation_forest', 'children_add_up')) AS c(model, certificate) WHERE EXISTS (SELECT 1 FROM events)""")
register("drop_one", lambda w: EV.confusion_metrics(
    M.drop_one(w.ml_windows, ["total_events", "is_flow", "auth_fail", "is_dns"], M.decision_tree(depth=4)).select(
        "stage", F.col("label").alias("y"), (F.col("score") >= 0.5).cast("int").alias("pred")), by=("stage",)).select(
    "stage", (F.col("tp") + F.col("fn")).alias("attacks"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("windows")), """
SELECT stage, CAST(sum(label) AS BIGINT) AS attacks, count(*) AS windows FROM mlw_f, (SELECT unnest(['none', 'total_events', 'is_flow', 'auth_fail', 'is_dns']) AS stage)
WHERE split = 'test' GROUP BY 1""", ["mlw_f"])


def size_scores(w, size):
    """Windows of one size with a fixed linear score, held apart from fits so that it can be compared."""
    return X.tumbling_features(w.indicated, size).select(
        (3 * (F.col("is_flow") + F.col("auth_fail")) / F.col("total_events")).alias("score"), F.col("label").alias("y"))


def sized(w):
    rows = []
    for size in (30, 60, 300):
        scores = materialize(size_scores(w, size))
        rows.append(EV.average_precision(scores).crossJoin(F.broadcast(EV.best_f1_threshold(scores).select("f1"))).select(
            F.lit(size).alias("size"), "average_precision", "f1"))
    return reduce(DataFrame.unionAll, rows)


SIZED = " UNION ALL ".join(
    f"""SELECT {s} AS size, 3 * (sum(is_flow) + sum(auth_fail)) / count(*) AS score, max(is_redteam) AS y FROM ind GROUP BY (ts - 691200) // {s}""" for s in (30, 60, 300))
register("window_size_metrics", sized, f"""
SELECT CAST(size AS BIGINT) AS size, round(sum(p / pa * cp / cn), 6) AS average_precision, round(max(2 * cp / (cn + pa)), 6) AS f1 FROM
 (SELECT size, p, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY size) AS pa FROM
  (SELECT size, score, count(*) AS n, sum(y) AS p FROM ({SIZED}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY size ORDER BY score DESC)) GROUP BY 1""", ["ind"])
