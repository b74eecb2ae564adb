"""The specialist rule set: authentication, process and network detectors with
adaptive thresholds, lists and safelists. Each returns the flagged events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import gap_segments, recent_counts
from sentrylake.functions.text import basename, fired, longest_label, shannon_entropy
from sentrylake.operators.baselines import Baseline
from sentrylake.operators.triage import auth_failure, flow_bytes, flow_duration, unusual_protocol
from sentrylake.session import materialize

FINDING_COLUMNS = [
    "event_id", "timestamp", "event_type", "user", "source_user",
    "destination_user", "source_host", "destination_host", "process", "agent",
    "risk_score", "rules", "evidence",
]


def route_events(events: DataFrame, enabled=("auth", "process", "network")) -> DataFrame:
    """Tag each event with its specialist; label rows go to auth with blanked evidence."""
    kind = F.lower("event_type")
    is_label = kind == "redteam"
    agent = (
        F.when(kind.isin("auth", "redteam"), V.AUTH_AGENT)
        .when(kind == "process", V.PROCESS_AGENT)
        .when(kind.isin("dns", "flow"), V.NETWORK_AGENT)
    )
    names = {"auth": V.AUTH_AGENT, "process": V.PROCESS_AGENT, "network": V.NETWORK_AGENT}
    return (
        events.withColumn("agent", agent)
        .withColumn("action", F.when(is_label, "LogOn").otherwise(F.col("action")))
        .withColumn("details", F.when(is_label, "").otherwise(F.col("details")))
        .filter(F.col("agent").isin([names[e] for e in enabled]))
    )


def listed(lists: DataFrame, kind: str, column: str, flag: str) -> DataFrame:
    """(column, flag) rows of one entry type, shaped for a left join.

    Lists are never hinted: the planner broadcasts them when their measured
    size allows and shuffles otherwise.
    """
    return (
        lists.filter(F.col("type") == kind)
        .select(F.col("value").alias(column), F.lit(1).alias(flag))
        .distinct()
    )


def with_flags(rows: DataFrame, lists: DataFrame, wanted) -> DataFrame:
    for kind, column, flag in wanted:
        if lists is None:
            rows = rows.withColumn(flag, F.lit(None).cast("int"))
        else:
            rows = rows.join(listed(lists, kind, column, flag), column, "left")
    return rows


def finish(rows: DataFrame, rules, agent: str, compound_text: str) -> DataFrame:
    """Score rows by (rule, points, condition, evidence) and keep the flagged ones."""
    # evidence items are counted, not rules: a flow can add two items for one rule
    names = fired([(cond, F.lit(name)) for name, _, cond, _ in rules])
    texts = fired([(cond, text) for _, _, cond, text in rules])
    points = sum(F.when(cond, pts).otherwise(0) for _, pts, cond, _ in rules)
    scored = rows.withColumns({"rules": names, "evidence": texts, "risk_score": points})
    many = F.size("evidence") >= 2
    return (
        scored.withColumns(
            {
                "agent": F.lit(agent),
                "risk_score": F.col("risk_score") + F.when(many, 2).otherwise(0),
                "rules": F.when(many, F.array_append("rules", F.lit("R10"))).otherwise(F.col("rules")),
                "evidence": F.when(many, F.array_append("evidence", F.lit(compound_text))).otherwise(
                    F.col("evidence")
                ),
            }
        )
        .filter(F.col("risk_score") >= V.SUSPICIOUS_AT)
        .select(*FINDING_COLUMNS)
    )


def listed_host():
    src, dst = F.col("_bad_src").isNotNull(), F.col("_bad_dst").isNotNull()
    return src | dst, F.when(src, F.col("source_host")).otherwise(F.col("destination_host"))


HOST_FLAGS = [("host", "source_host", "_bad_src"), ("host", "destination_host", "_bad_dst")]


def auth_specialist(events: DataFrame, base: Baseline, threats=None, safe=None) -> DataFrame:
    rows = events.filter(F.lower("event_type").isin("auth", "redteam")).withColumn(
        "user", F.coalesce("user", "source_user")
    )
    limit = F.greatest(
        F.lit(V.BURST_MORE_THAN),
        F.coalesce(F.floor(F.col("mean") + 2 * F.col("std")), F.lit(V.BURST_MORE_THAN)),
    ).cast("bigint")
    bursts = (
        recent_counts(rows, ["user"], V.AUTH_BURST_SECONDS)
        .filter(F.col("n_recent") > V.BURST_MORE_THAN)
        .join(base.velocity, "user", "left")
        .select("user", "timestamp", "n_recent", limit.alias("burst_limit"))
        .filter(F.col("n_recent") > F.col("burst_limit"))
    )
    rows = with_flags(
        rows, safe, [("user", "user", "_safe_user"), ("host", "source_host", "_safe_src")]
    ).filter(F.col("_safe_user").isNull() | F.col("_safe_src").isNull())
    rows = with_flags(rows, threats, [("user", "user", "_bad_user"), *HOST_FLAGS])
    hour = F.floor(F.pmod("timestamp", F.lit(V.DAY_SECONDS)) / V.HOUR_SECONDS)
    rows = (
        rows.withColumn("pair_host", F.coalesce("destination_host", "source_host"))
        .withColumn("hour", hour)
        .join(bursts, ["user", "timestamp"], "left")
        .join(base.pairs.withColumnRenamed("host", "pair_host"), ["user", "pair_host"], "left")
        .join(base.hours, "user", "left")
        .join(
            base.diversity.select(F.col("host").alias("destination_host"), F.col("users").alias("usual_users")),
            "destination_host",
            "left",
        )
        .crossJoin(F.broadcast(base.pair_threshold.withColumnRenamed("threshold", "rare_limit")))
    )
    has_pair = F.col("user").isNotNull() & F.col("pair_host").isNotNull()
    seen = F.coalesce("pair_count", F.lit(0))
    share = F.coalesce(F.try_element_at("by_hour", F.col("hour")), F.lit(0)) / F.col("activity")
    bad_host, which_host = listed_host()
    rules = [
        ("R1", 2, auth_failure(include_action=True),
         F.format_string(V.AUTH_EVIDENCE["failure"], F.coalesce("user", F.lit("")))),
        ("R2", 2, F.col("n_recent").isNotNull(),
         F.format_string(V.AUTH_EVIDENCE["burst"],
                         "n_recent", "burst_limit")),
        ("R3", 1, unusual_protocol(), F.lit(V.AUTH_EVIDENCE["protocol"])),
        ("R4", 2, has_pair & (seen <= F.col("rare_limit")),
         F.format_string(V.AUTH_EVIDENCE["rare_pair"],
                         "user", "pair_host", seen)),
        ("R8", 3, F.col("_bad_user").isNotNull(),
         F.format_string(V.AUTH_EVIDENCE["listed_user"], "user")),
        ("R9", 2, bad_host,
         F.format_string(V.AUTH_EVIDENCE["listed_host"], which_host)),
        ("R11", 2, (F.col("timestamp") > 0) & (share < V.OFF_HOURS_SHARE_BELOW),
         F.format_string(V.AUTH_EVIDENCE["off_hours"],
                         "hour", share * 100)),
        ("R12", 2, has_pair & (seen == 0),
         F.format_string(V.AUTH_EVIDENCE["first_pair"], "user", "pair_host")),
        ("R14", 1,
         F.col("user").isNotNull() & F.col("destination_host").isNotNull()
         & F.col("usual_users").between(1, V.LOW_DIVERSITY_AT_MOST) & (seen == 0),
         F.format_string(V.AUTH_EVIDENCE["low_diversity"],
                         "destination_host", "usual_users", "user")),
    ]
    return finish(rows, rules, V.AUTH_AGENT,
                  V.AUTH_EVIDENCE["compound"])


def process_specialist(events: DataFrame, base: Baseline, threats=None, safe=None) -> DataFrame:
    rows = events.filter(F.lower("event_type") == "process")
    bursts = recent_counts(rows, ["source_host"], V.PROCESS_BURST_SECONDS).filter(
        F.col("n_recent") > V.BURST_MORE_THAN
    )
    lower = rows.withColumn("process_lower", F.lower("process"))
    lower = with_flags(
        lower, safe, [("process", "process_lower", "_safe_proc"), ("host", "source_host", "_safe_src")]
    ).filter(F.col("_safe_proc").isNull() | F.col("_safe_src").isNull())
    # the first run of a process the profile has never seen, per user: a narrow pass
    unseen = (
        lower.filter(F.col("user").isNotNull() & F.col("process").isNotNull())
        .select("user", "process", "timestamp", "event_id")
        .join(base.processes, "process", "left_anti")
    )
    first = unseen.groupBy("user", "process").agg(
        F.min(F.struct("timestamp", "event_id"))["event_id"].alias("_first_id")
    )
    lower = with_flags(
        lower, threats,
        [("user", "user", "_bad_user"), *HOST_FLAGS,
         ("process", "process", "_bad_proc"), ("process", "process_lower", "_bad_proc_lower")],
    )
    lower = (
        lower.join(base.processes, "process", "left")
        .join(bursts, ["source_host", "timestamp"], "left")
        .crossJoin(F.broadcast(base.process_threshold.withColumnRenamed("threshold", "rare_limit")))
    )
    lower = lower.join(first, ["user", "process"], "left")
    seen = F.coalesce("process_count", F.lit(0))
    bad_host, which_host = listed_host()
    rules = [
        ("R5", 2, F.col("process").isNotNull() & (seen < F.col("rare_limit")),
         F.format_string(V.PROCESS_EVIDENCE["rare"], "process", seen)),
        ("R6", 2, F.col("n_recent").isNotNull(),
         F.format_string(V.PROCESS_EVIDENCE["burst"],
                         "n_recent", "source_host")),
        ("R9", 2, bad_host,
         F.format_string(V.PROCESS_EVIDENCE["listed_host"], which_host)),
        ("R8", 3, F.col("_bad_user").isNotNull(),
         F.format_string(V.PROCESS_EVIDENCE["listed_user"], "user")),
        ("R15", 2, basename(F.col("process")).isin(V.LOLBINS),
         F.format_string(V.PROCESS_EVIDENCE["lolbin"], "process")),
        ("R15b", 3, F.col("_bad_proc").isNotNull() | F.col("_bad_proc_lower").isNotNull(),
         F.format_string(V.PROCESS_EVIDENCE["listed_process"], "process")),
        ("R16", 2, F.col("_first_id") == F.col("event_id"),
         F.format_string(V.PROCESS_EVIDENCE["new"], "process")),
    ]
    return finish(lower, rules, V.PROCESS_AGENT,
                  V.PROCESS_EVIDENCE["compound"])


def beacons(events: DataFrame) -> DataFrame:
    """Destinations contacted at regular intervals: (destination_host, contacts, mean_gap, cv).

    Repeated seconds add zero gaps, so distinct seconds carry the sum of
    squared gaps and the mean follows from first, last and count.
    """
    net = events.filter(
        F.lower("event_type").isin("dns", "flow") & F.col("destination_host").isNotNull()
    ).select("destination_host", "timestamp")
    size = net.groupBy("destination_host").agg(
        F.count("*").alias("contacts"),
        F.min("timestamp").alias("_lo"),
        F.max("timestamp").alias("_hi"),
    )
    gap = (F.col("timestamp") - F.col("previous")).cast("double")
    squares = (
        gap_segments(net, ["destination_host"], V.DAY_SECONDS)
        .groupBy("destination_host")
        .agg(F.sum(gap * gap).alias("_squares"))
    )
    n = F.col("contacts") - 1
    mean = (F.col("_hi") - F.col("_lo")) / n
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") / n - mean * mean))
    return (
        size.filter(F.col("contacts") >= V.BEACON_MIN_CONTACTS)
        .join(squares, "destination_host")
        .withColumns({"mean_gap": mean, "cv": F.try_divide(std, mean)})
        .filter(
            (F.col("mean_gap") > 0)
            & (F.col("cv") < V.BEACON_CV_BELOW)
            & (F.col("mean_gap") < V.BEACON_MEAN_BELOW)
        )
        .select("destination_host", "contacts", "mean_gap", "cv")
    )


def dga_hit(name):
    label = longest_label(name)
    return (
        (F.size(F.split(name, r"\.")) >= 2)
        & (F.length(label) > V.LABEL_LONGER_THAN)
        & (shannon_entropy(label) > V.ENTROPY_ABOVE)
    )


def network_specialist(events: DataFrame, base: Baseline, threats=None, safe=None) -> DataFrame:
    """Flagged DNS and flow events, with the beacon bonus on the last one per beaconing host.

    Events are scored once; the flagged ones are written, and those to beaconing
    hosts among them give the last one.
    """
    rows = events.filter(F.lower("event_type").isin("dns", "flow"))
    found = beacons(rows)
    flagged = materialize(score_network(rows, base, threats, safe))
    suspects = flagged.join(found.select("destination_host"), "destination_host", "left_semi")
    return add_beacons(flagged, suspects, found)


def score_network(rows: DataFrame, base: Baseline, threats=None, safe=None) -> DataFrame:
    known = base.known.filter("entity_type = 'host'").select(
        F.col("entity").alias("destination_host"), F.lit(1).alias("_known_dst")
    )
    any_known = known.limit(1).agg((F.count("*") > 0).alias("_any_known"))
    limit = F.greatest(
        F.lit(V.FLOW_BYTES_ABOVE),
        F.coalesce(F.floor(F.col("mean") + 2 * F.col("std")), F.lit(V.FLOW_BYTES_ABOVE)),
    ).cast("bigint")
    rows = with_flags(rows, threats, HOST_FLAGS)
    rows = with_flags(
        rows.withColumn("domain", F.when(F.lower("event_type") == "dns", F.lower("destination_host"))),
        threats, [("domain", "domain", "_bad_domain")],
    )
    rows = with_flags(rows, safe, [("host", "destination_host", "_safe_dst")])
    rows = (
        rows.join(known, "destination_host", "left")
        .join(base.flows.withColumnRenamed("host", "source_host"), "source_host", "left")
        .crossJoin(F.broadcast(any_known))
        .withColumn("byte_limit", limit)
    )
    is_flow, is_dns = F.lower("event_type") == "flow", F.lower("event_type") == "dns"
    path = F.concat(F.coalesce("source_host", F.lit("")), F.lit(" -> "), F.coalesce("destination_host", F.lit("")))
    bad_host, which_host = listed_host()
    rules = [
        ("R7", 1, is_flow & (flow_bytes() > F.col("byte_limit")),
         F.format_string(V.NETWORK_EVIDENCE["bytes"],
                         flow_bytes(), "byte_limit", path)),
        ("R7", 1, is_flow & (flow_duration() > V.FLOW_DURATION_ABOVE),
         F.format_string(V.NETWORK_EVIDENCE["duration"], flow_duration(), path)),
        ("R9", 2, bad_host,
         F.format_string(V.NETWORK_EVIDENCE["listed_host"], which_host)),
        ("R17", 2, is_dns & dga_hit(F.col("destination_host")),
         F.format_string(V.NETWORK_EVIDENCE["entropy"],
                         "destination_host", shannon_entropy(longest_label(F.col("destination_host"))))),
        ("R17b", 3, F.col("_bad_domain").isNotNull(),
         F.format_string(V.NETWORK_EVIDENCE["listed_domain"], "destination_host")),
        ("R13", 1,
         F.col("_any_known") & F.col("source_host").isNotNull() & F.col("destination_host").isNotNull()
         & F.col("_known_dst").isNull() & F.col("_safe_dst").isNull(),
         F.format_string(V.NETWORK_EVIDENCE["unseen"], "destination_host")),
    ]
    return finish(rows, rules, V.NETWORK_AGENT,
                  V.NETWORK_EVIDENCE["compound"])


def add_beacons(flagged: DataFrame, suspects: DataFrame, found: DataFrame) -> DataFrame:
    """+3 and a beacon evidence line on the last flagged event to each beaconing host.

    `suspects` are the flagged events to hosts in `found`.
    """
    last = (
        suspects.groupBy("destination_host")
        .agg(F.max(F.struct("timestamp", "event_id"))["event_id"].alias("event_id"))
        .join(found, "destination_host")
        .select(
            "event_id",
            F.format_string(
                V.NETWORK_EVIDENCE["beacon"],
                "destination_host", "contacts", "mean_gap", "cv",
            ).alias("_beacon"),
        )
    )
    hit = F.col("_beacon").isNotNull()
    return flagged.join(last, "event_id", "left").select(
        *[c for c in FINDING_COLUMNS if c not in ("risk_score", "rules", "evidence")],
        (F.col("risk_score") + F.when(hit, 3).otherwise(0)).alias("risk_score"),
        F.when(hit, F.array_append("rules", F.lit("R18"))).otherwise(F.col("rules")).alias("rules"),
        F.when(hit, F.array_append("evidence", F.col("_beacon"))).otherwise(F.col("evidence")).alias("evidence"),
    )


def all_findings(events, base, threats=None, safe=None, enabled=("auth", "process", "network")):
    """Flagged events of the enabled specialists."""
    routed = route_events(events, enabled).drop("agent")
    run = {"auth": auth_specialist, "process": process_specialist, "network": network_specialist}
    parts = [run[e](routed, base, threats, safe) for e in enabled]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def specialist_summary(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Per specialist: analyzed, flagged, total and mean risk, entity and evidence counts.

    The entities and evidence themselves are `specialist_entities` and
    `specialist_evidence`, one row each, so nothing is gathered in one task.
    """
    analyzed = route_events(events).groupBy("agent").agg(F.count("*").alias("analyzed"))
    flagged = findings.groupBy("agent").agg(
        F.count("*").alias("flagged"), F.sum("risk_score").cast("double").alias("total_risk")
    )
    entities = specialist_entities(events).groupBy("agent").agg(F.count("*").alias("entities"))
    evidence = specialist_evidence(findings).groupBy("agent").agg(F.count("*").alias("evidence_items"))
    zero = lambda c, v=0: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return (
        analyzed.join(flagged, "agent", "left").join(entities, "agent", "left").join(evidence, "agent", "left")
        .select(
            "agent", "analyzed", zero("flagged"), zero("total_risk", 0.0),
            F.coalesce(F.round(F.col("total_risk") / F.col("flagged"), 2), F.lit(0.0)).alias("mean_risk"),
            zero("entities"), zero("evidence_items"),
        )
    )


def specialist_entities(events: DataFrame) -> DataFrame:
    """Distinct (agent, entity): users and hosts for auth, users, hosts and
    processes for process, hosts for network."""
    routed = route_events(events)
    agent = F.col("agent")
    user = F.when(agent == V.AUTH_AGENT, F.coalesce("user", "source_user")).when(
        agent == V.PROCESS_AGENT, F.col("user")
    )
    dst = F.when(agent != V.PROCESS_AGENT, F.col("destination_host"))
    proc = F.when(agent == V.PROCESS_AGENT, F.col("process"))
    return (
        routed.select("agent", F.explode(F.array(user, F.col("source_host"), dst, proc)).alias("entity"))
        .filter(F.col("entity").isNotNull())
        .distinct()
    )


def specialist_evidence(findings: DataFrame) -> DataFrame:
    """Distinct evidence per agent with the position at which it was first seen."""
    return (
        findings.select(
            "agent", "timestamp", "event_id", F.posexplode("evidence").alias("pos", "evidence")
        )
        .groupBy("agent", "evidence")
        .agg(
            F.min(F.struct("timestamp", "event_id", "pos")).alias("first_seen"),
            F.count("*").alias("times"),
        )
    )
