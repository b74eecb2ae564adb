"""Hand-made cases for rules, lists, parsers and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from sentrylake.functions.text import basename, detail_number, longest_label, shannon_entropy
from sentrylake.operators import baselines as B
from sentrylake.operators import correlate as C
from sentrylake.operators import evaluate as EV
from sentrylake.operators import explore as E
from sentrylake.operators import features as X
from sentrylake.operators import lists as L
from sentrylake.operators import ml as M
from sentrylake.operators import specialists as S
from sentrylake.operators import triage as T
from sentrylake.plans.investigate import investigate
from sentrylake.sources import normalize as N
from sentrylake.sources import readers as R
from sentrylake.sources import threat_lists as TL


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("name,hit", [
    ("xk98q2mzz109b", False), ("xk98q2mzz109b.net", False), ("abcdefgh.net", False), ("q1w2e3r4t5y6u7i8.net", True),
    ("Q1W2E3R4T5Y6U7I8.NET", True), ("aaaaaaaaaaaaaaaa.net", False),
])
def test_dga(spark, name, hit):
    label = max(name.split("."), key=len)
    freq = {c: label.lower().count(c) for c in label.lower()}
    entropy = -sum(n / len(label) * math.log2(n / len(label)) for n in freq.values())
    assert one(spark, shannon_entropy(longest_label(F.col("x"))), name) == pytest.approx(entropy)
    assert one(spark, S.dga_hit(F.col("x")), name) == hit


def test_longest_label_takes_the_first_of_ties(spark):
    assert one(spark, longest_label(F.col("x")), "abc.xyz.de") == "abc"


@pytest.mark.parametrize("path,name", [("C:\\Windows\\CMD.EXE", "cmd.exe"), ("/usr/bin/at", "at"), ("net", "net"), ("a/b\\c", "c")])
def test_basename(spark, path, name):
    assert one(spark, basename(F.col("x")), path) == name


@pytest.mark.parametrize("text,value", [
    ("bytes=10|duration=3", 10), ("duration=3|bytes=7", 7), ("bytes=1|bytes=2", 2), ("nbytes=5", None), ("bytes=|x=1", None), ("bytes=1k", None)])
def test_detail_number(spark, text, value):
    assert one(spark, detail_number(F.col("x"), "bytes"), text) == value


@pytest.mark.parametrize("value,kind", [
    ("10.0.0.1", "host"), ("a" * 31, "user"), ("a" * 32, "hash"), ("a.exe", "process"), ("evil.com", "domain"), ("run.sh", "domain"), ("word", "user")])
def test_classify_indicator(spark, value, kind):
    assert one(spark, L.classify_indicator(F.col("x")), value) == kind


def auth(t, user="u", dst="d", details="Kerberos|Interactive|Success", **more):
    return {"event_type": "auth", "timestamp": t, "user": user, "source_host": "s", "destination_host": dst,
            "action": "LogOn", "details": details, **more}


def test_burst_needs_four_within_the_window(make_events):
    rows = lambda ts: T.auth_bursts(make_events([auth(t) for t in ts])).collect()
    assert [(r.timestamp, r.n_recent) for r in rows([0, 100, 200, 300])] == [(300, 4)]
    assert rows([0, 100, 200, 301]) == []
    assert [(r.timestamp, r.n_recent) for r in rows([5, 5, 5, 5])] == [(5, 4)]


def test_triage_scores_and_texts(make_events):
    events = make_events([auth(0, details="NTLM|Network|Failure")] + [auth(i, user="v", dst="e") for i in range(1000, 1900, 301)])
    rows = {r.event_id: r for r in T.triage(events).collect()}
    assert rows[0].risk_score == 2 + 1 + 2 + 2 and rows[0].is_suspicious == 1
    assert rows[0].triggered_rules == ["R1_AUTH_FAILURE", "R3_UNUSUAL_AUTH", "R4_RARE_USER_HOST", "R10_TEMPORAL_BURST"]
    assert rows[0].triage_reasons[-1] == "Compound threat: 3 distinct risk indicators triggered simultaneously"
    assert rows[1].risk_score == 0 and rows[1].triggered_rules == []


def test_null_entities_never_form_pairs(make_events):
    events = make_events([{"event_type": "dns", "timestamp": 1, "destination_host": "d"}])
    assert T.triage(events).first().risk_score == 0


def quiet_base(make_events):
    """A busy week: user u on d and e, many processes."""
    rows = [auth(i * 301, dst=d) for i in range(300) for d in ("d", "e")]
    rows += [{"event_type": "process", "timestamp": i * 301, "user": "u", "source_host": "s", "process": "known.exe"} for i in range(300)]
    return B.build_baseline(make_events(rows))


def test_attack_is_found_end_to_end(make_events, spark):
    base = quiet_base(make_events)
    t = 500_000
    rows = [auth(t + 2 * i, user="x", dst="d", details="NTLM|Network|Failure") for i in range(5)]
    rows += [auth(t + 20 + i, user="x", dst=h, details="NTLM|Network") for i, h in enumerate("fgh")]
    rows += [{"event_type": "process", "timestamp": t + 30 + i, "user": "x", "source_host": "f", "process": p} for i, p in
             enumerate(["powershell.exe", "whoami.exe", "certutil.exe"])]
    rows += [{"event_type": "flow", "timestamp": t + 60, "source_host": "f", "destination_host": "203.0.113.50", "bytes": 8_000_000,
              "duration": 180, "details": "bytes=8000000|duration=180|protocol=tcp"}]
    rows += [auth(t + 5000, user="u", dst="d")]
    found = investigate(make_events(rows), base)
    assert {r.agent for r in found.findings.collect()} == {"AuthenticationAgent", "ProcessAgent", "NetworkAgent"}
    top = found.responses.orderBy(F.col("risk_score").desc()).first()
    assert top.severity == "Critical" and top.priority.startswith("P1") and top.requires_human_approval == 1
    assert set(top.agents_involved) == {"AuthenticationAgent", "ProcessAgent", "NetworkAgent"}
    by_id = {r.event_id: r for r in found.findings.collect()}
    assert by_id[0].rules == ["R1", "R3", "R4", "R12", "R14", "R10"]
    assert "R15" in by_id[8].rules and "R16" in by_id[8].rules
    # bytes and duration are two evidence items of one rule, the unseen host a third
    assert by_id[11].rules == ["R7", "R7", "R13", "R10"] and by_id[11].risk_score == 5
    assert max(by_id) == 11


def test_empty_input_gives_empty_results(make_events):
    found = investigate(make_events([]))
    assert found.responses.count() == 0 and found.findings.count() == 0


def test_safelist_needs_both_keys_and_first_row_can_be_skipped(make_events, spark):
    base = quiet_base(make_events)
    run = lambda i, host: {"event_type": "process", "timestamp": i, "user": "u", "source_host": host, "process": "New.exe"}
    safe = spark.createDataFrame([("process", "new.exe"), ("host", "s")], "type string, value string")
    rows = {r.event_id: r.rules for r in S.process_specialist(make_events([run(1, "s"), run(2, "t")]), base, None, safe).collect()}
    assert list(rows) == [1] and "R16" in rows[1]
    both = {r.event_id: r.rules for r in S.process_specialist(make_events([run(1, "s"), run(2, "t")]), base).collect()}
    assert "R16" in both[0] and "R16" not in both.get(1, [])


def contact(t, dst="b", big=True):
    return {"event_type": "flow", "timestamp": t, "source_host": "s", "destination_host": dst,
            "bytes": 9_000_000 if big else 1, "duration": 500 if big else 1, "details": ""}


@pytest.mark.parametrize("times,hit", [
    ([0, 60, 120, 180], False), ([0, 60, 120, 180, 240], True), ([7] * 6, False),
    ([i * 599 for i in range(6)], True), ([i * 600 for i in range(6)], False), ([0, 1, 100, 101, 500, 900], False)])
def test_beacons(make_events, times, hit):
    assert (S.beacons(make_events([contact(t) for t in times])).count() == 1) == hit


def test_beacon_bonus_goes_to_the_last_flagged_event(make_events):
    events = make_events([contact(i * 60, big=i in (1, 3)) for i in range(6)])
    base = B.build_baseline(events)
    base.flows = base.flows.filter("false")
    rows = {r.event_id: r for r in S.network_specialist(events, base).collect()}
    assert set(rows) == {1, 3}
    assert rows[3].risk_score == rows[1].risk_score + 3 and rows[3].rules[-1] == "R18"


def test_verdicts(spark):
    schema = "seq bigint, incident_id string, verdict string, users array<string>, hosts array<string>, processes array<string>"
    log = spark.createDataFrame([
        (1, "i", "Suspicious", ["a", " "], ["h"], []), (2, "i", "whatever", ["a"], [], []), (3, "i", "False Positive", ["a "], [], None),
        (4, "j", "FP", ["b"], [], []), (5, "j", "confirmed threat", ["b"], [], ["p"])], schema)
    learned = {(r.type, r.value): r.list for r in L.apply_verdicts(log).collect()}
    assert learned == {("user", "a"): "safe", ("host", "h"): "watch", ("user", "b"): "watch", ("process", "p"): "watch"}
    look = L.list_lookup(spark.createDataFrame([("a",), ("zz",)], "value string"), L.apply_verdicts(log)).collect()
    assert [(r.value, r.is_watched, r.is_safe) for r in sorted(look)] == [("a", 0, 1), ("zz", 0, 0)]


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_syslog(spark):
    rows = R.parse_syslog(lines(
        spark, "<34>Oct 11 22:14:15 web sshd[99]: Failed: password", "Oct  1 02:14:15 h kernel: up", "free text", "   ")).collect()
    assert tuple(rows[0]) == ("Oct 11 22:14:15", "web", "sshd", "pid=99", "Failed: password", "auth")
    assert rows[1].action == "" and rows[1].event_type == "process"
    assert rows[2].details == "free text" and rows[2].event_type == "unknown" and len(rows) == 3


def test_cef(spark):
    rows = R.parse_cef(lines(spark, "CEF:0|v|p|1|100|User logon|7|suser=ann dst=10.0.0.2 msg=two words here shost=ws end=55", "nope")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.event_type, r.timestamp, r.user, r.source_host, r.destination_host) == ("auth", "55", "ann", "ws", "10.0.0.2")


def test_json_logs(spark, tmp_path):
    rows = R.parse_json_logs(lines(spark, '{"a": "1"}', '[{"a": "2"}, {"a": "3"}]', "{bad", '{"a": "4"} {"a": "5"}', "7"), "a: string").collect()
    assert sorted(r.a for r in rows) == ["1", "2", "3"]
    (tmp_path / "x.json").write_text('[\n {"a": "1"},\n {"a": "2"}\n]')
    assert R.read_json_logs(spark, str(tmp_path / "x.json"), "a: string", array_files=True).count() == 2


def test_headerless_lines(spark):
    rows = R.split_headerless(lines(spark, "5,u,h,p,Start", "x,u,h,p,Start", "6,u,h", "7,u,h,p,End,extra"), "process").collect()
    assert [(r.time, r.action) for r in rows] == [(5, "Start"), (7, "End")]


def test_formats_of_files(spark, tmp_path):
    for name, text in {"a.csv": "{}", "b.jsonl": "x", "c.log": "\n  {\"a\":1}", "d.log": "CEF:0|", "e.log": "Oct 11 22:14:15 h p: m", "f": "time,user"}.items():
        (tmp_path / name).write_text(text)
    got = {r.file.rsplit("/", 1)[1]: r.format for r in R.detect_log_format(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "csv", "b.jsonl": "json", "c.log": "json", "d.log": "cef", "e.log": "syslog", "f": "csv"}


@pytest.mark.parametrize("texts,want", [
    (["100", "200"], [100, 200]),
    (["1700000000123", "1700000001000"], [1700000000, 1700000001]),
    (["1700000000123456"], [1700000000]),
    (["2024-01-02T03:04:05Z", "2024-01-02T03:04:06Z"], [1704164645, 1704164646]),
    (["2024-01-02T03:04:05.250Z"], [1704164645]),
    (["2024-01-02T03:04:05+02:00"], [1704157445]),
    (["2024-01-02 03:04:05", "2024-01-02 03:04:06", "x"], [1704164645, 1704164646, 0]),
    (["12/31/2024 10:00:00", "01/02/2024 03:04:05"], [1735639200, 1704164645]),
    (["20240102030405"] * 2 + ["junk"], [1704164645, 1704164645, 0]),
    (["Jan  2 03:04:05"], [-2208891355]),
    (["2024-01-02"], [1704153600]),
    (["1", "2", "3", "4", "bad"], [0, 0, 0, 0, 0]),
])
def test_timestamps(spark, texts, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, timestamp string")
    got = [r.timestamp for r in N.normalize_timestamps(df).orderBy("i").collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert got == [r.timestamp for r in N.normalize_timestamps(df).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_upload_to_canonical(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 00:00:01", "bob", "10.0.0.1", "NTLM logon failed", "z1"), ("2024-01-01 00:00:02", None, "10.0.0.2", "dns lookup", None)],
        "`Event Time` string, Account string, `src-ip` string, Message string, zone string")
    rows = N.parse_records(raw).orderBy("timestamp").collect()
    assert (rows[0].timestamp, rows[0].user, rows[0].source_host, rows[0].details) == (1704067201, "bob", "10.0.0.1", "NTLM logon failed | zone=z1")
    assert [r.event_type for r in rows] == ["auth", "dns"]
    events = N.normalize_events(N.parse_records(raw))
    assert events.filter("user is null").count() == 1
    with pytest.raises(ValueError):
        N.validate_schema(raw)


def test_threat_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Value,IOC_Type\nbad_user,account\n10.1.1.1,\nevil.org,\nx,colour\n")
    got = {(r.type, r.value) for r in L.build_iocs(TL.load_iocs_csv(spark, str(tmp_path / "a.csv"))).collect()}
    assert got == {("user", "bad_user"), ("host", "10.1.1.1"), ("domain", "evil.org")}
    (tmp_path / "b.json").write_text('{"users": ["u1"], "hashes": ["ff"], "processes": ["p.exe"], "colours": ["red"]}')
    got = {(r.type, r.value) for r in L.build_iocs(TL.load_iocs_json(spark, str(tmp_path / "b.json"))).collect()}
    assert got == {("user", "u1"), ("hash", "ff"), ("process", "p.exe")}
    (tmp_path / "c.json").write_text('[{"indicator": "u2", "type": "User"}, {"value": "h2", "indicator_type": "ip"}, {"type": "user"}]')
    got = {(r.type, r.value) for r in L.build_iocs(TL.load_iocs_json(spark, str(tmp_path / "c.json"))).collect()}
    assert got == {("user", "u2"), ("host", "h2")}


# ---- metrics --------------------------------------------------------------------------------


def scored(spark, pairs):
    return spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, score double")


@pytest.mark.parametrize("pairs,auc,ap", [
    ([(1, .9), (1, .8), (0, .2), (0, .1)], 1.0, 1.0),
    ([(0, .9), (0, .8), (1, .2), (1, .1)], 0.0, (1 / 3 + 2 / 4) / 2),
    ([(1, .5), (0, .5), (0, .5), (0, .5)], 0.5, 0.25),
    ([(0, .5), (0, .1)], None, 0.0),
])
def test_curves(spark, pairs, auc, ap):
    got = EV.roc_auc(scored(spark, pairs)).first().roc_auc
    assert got == (auc if auc is None else pytest.approx(auc))
    assert EV.average_precision(scored(spark, pairs)).first().average_precision == pytest.approx(ap)


def test_published_confusion(spark):
    counts = {(1, 1): 32, (0, 1): 14, (1, 0): 32, (0, 0): 211}
    rows = [k for k, n in counts.items() for _ in range(n)]
    m = EV.confusion_metrics(spark.createDataFrame(rows, "y int, pred int")).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (32, 14, 32, 211)
    assert [round(100 * x, 2) for x in (m.precision, m.recall, m.f1)] == [69.57, 50.0, 58.18]


def match_case(spark, make_events, t, user, host, t0=1000, t1=2000, tolerance=(0, 60)):
    members = spark.createDataFrame([(1, t0), (1, t1)], "component bigint, timestamp bigint")
    bridge = spark.createDataFrame([(1, "user", "a"), (1, "host", "h")], "component bigint, entity_type string, entity string")
    labels = make_events([{"timestamp": t, "user": user, "source_host": None, "destination_host": host}])
    return [r.captured for r in EV.incident_attack_match(labels, members, bridge, list(tolerance)).orderBy("tolerance").collect()]


@pytest.mark.parametrize("t,user,host,want", [
    (2000, "a", None, [1, 1]), (2060, "a", None, [0, 1]), (2061, "a", None, [0, 0]), (940, None, "h", [0, 1]), (1500, None, "h", [1, 1]),
    (1500, None, None, [0, 0]), (1500, "b", "g", [0, 0])])
def test_attack_match(spark, make_events, t, user, host, want):
    assert match_case(spark, make_events, t, user, host) == want


def test_windows_edges(make_events, spark):
    events = make_events([auth(691200), auth(691499), auth(691500, user=None), auth(692400)])
    rows = {r.window_id: r for r in X.tumbling_features(X.event_indicators(events)).collect()}
    assert {k: (r.total_events, r.user) for k, r in rows.items()} == {0: (2, 1), 1: (1, 0), 4: (1, 1)}
    labels = make_events([auth(691499), auth(691800)])
    assert [r.y for r in X.window_labels(labels, 0, 3).orderBy("window_id").collect()] == [1, 0, 1, 0]
    dense = X.densify_windows(X.tumbling_features(X.event_indicators(events)))
    assert [r.total_events for r in dense.orderBy("window_id").collect()] == [2, 1, 0, 0, 1]


def test_self_traffic_counts_once(make_events):
    row = X.host_window_features(make_events([{"event_type": "flow", "timestamp": 691200, "source_host": "h", "destination_host": "h"}])).first()
    assert (row.events_total, row.events_as_src, row.events_as_dst, row.flow_events, row.distinct_peers) == (1, 1, 1, 1, 0)


def test_sampling_keeps_everything_below_the_quota(make_events):
    events = make_events([auth(691200 + i) for i in range(30)])
    assert E.stratified_reservoir(events, {"auth": 50}).count() == 30
    assert E.stratified_reservoir(events, {"auth": 7}).count() == 7


def test_every_entity_of_a_large_incident_is_listed(make_events):
    rows = make_events([{**auth(i, user=f"u{i}", dst="d")} for i in range(12_000)])
    members = rows.withColumns({"component": F.lit(0), "risk_score": F.lit(5), "agent": F.lit("A"), "rules": F.array(F.lit("R1")),
                                "evidence": F.array(F.lit("e"))})
    row = C.build_incidents(members).first()
    assert (row.n_users, row.n_hosts) == (12_000, 2)
    assert C.incident_entities(members).filter("entity_type = 'user'").count() == 12_000


def test_isolation_forest_ranks_an_outlier_first(spark):
    rows = [(i, float(i % 5), float(i % 7)) for i in range(400)] + [(999, 90.0, -80.0)]
    df = spark.createDataFrame(rows, "window_id bigint, a double, b double")
    scores = M.isolation_scores(M.isolation_forest(df, ["a", "b"], trees=30, sample=64), df, ["a", "b"])
    assert scores.orderBy(F.col("raw").desc()).first().window_id == 999


def test_isolation_forest_without_training_rows_scores_null(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "window_id bigint, a double")
    forest = M.isolation_forest(df.filter("a < 0"), ["a"], trees=5)
    fitted = M.isolation_scores(forest, df.filter("a < 0"), ["a"])
    rows = M.scaled_by(M.isolation_scores(forest, df, ["a"]), fitted).collect()
    assert sorted((r.window_id, r.raw, r.score) for r in rows) == [(i, None, None) for i in range(20)]


def test_labels_change_nothing(make_events):
    rows = [auth(i, user=f"u{i % 5}", details="NTLM|Network|Failure", is_redteam=i % 2) for i in range(60)]
    score = lambda df: T.triage(df).select("event_id", "risk_score")
    assert EV.label_invariance_check(score, make_events(rows)).count() == 0
