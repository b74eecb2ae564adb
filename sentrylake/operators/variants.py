"""Documented variants of rules and scores, as parameters or extra operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import recent_counts
from sentrylake.operators.explore import hour_of
from sentrylake.operators.triage import auth_failure, flow_bytes, flow_duration


def ml_weighted_risk(incidents: DataFrame) -> DataFrame:
    """Risk from probability, lateral reach, volume and threat matches.

    Reads probability, destination_hosts, event_count, baseline_mean,
    watch_matches and multi_source.
    """
    threat = F.least(F.lit(25.0), F.col("watch_matches") * 20.0 + F.col("multi_source") * 15.0)
    risk = (
        F.col("probability") * 50.0
        + F.when(F.col("destination_hosts") >= 2, 25.0).otherwise(0.0)
        + F.when(F.col("event_count") >= F.col("baseline_mean") * 3, 15.0).otherwise(0.0)
        + threat
    )
    return incidents.withColumn("ml_risk", F.least(F.lit(100.0), risk))


def confidence_v2(incidents: DataFrame) -> DataFrame:
    """25 per source up to 50, volume up to 25, and 25 when specialists agree."""
    return incidents.withColumn(
        "confidence_v2",
        F.least(
            F.lit(100.0),
            F.least(F.lit(50.0), F.size("sources") * 25.0)
            + F.least(F.lit(25.0), F.col("event_count") * 2.5)
            + F.when(F.size("agents_involved") >= 2, 25.0).otherwise(0.0),
        ),
    )


def escalated_lookup(scored_auth: DataFrame, events: DataFrame, at_least=0.70, seconds=300) -> DataFrame:
    """Processes on the destination host in the `seconds` before a suspicious logon.

    Joined on (host, time block); the logon also looks into the block before,
    so a busy host is spread over its blocks.
    """
    block = F.floor(F.col("timestamp") / seconds)
    asked = scored_auth.filter(
        (F.col("probability") >= at_least) & F.col("destination_host").isNotNull()
    ).select(
        F.col("event_id").alias("auth_event_id"),
        F.col("timestamp").alias("auth_time"),
        F.col("destination_host").alias("host"),
        F.explode(F.array(block, block - 1)).alias("_block"),
    )
    procs = events.filter(
        (F.col("event_type") == "process") & F.col("source_host").isNotNull()
    ).select(
        F.col("source_host").alias("host"), "process",
        F.col("event_id").alias("process_event_id"), F.col("timestamp").alias("process_time"),
        block.alias("_block"),
    )
    gap = F.col("auth_time") - F.col("process_time")
    return asked.join(procs, ["host", "_block"]).filter(gap.between(0, seconds)).drop("_block")


def evidence_conflicts(predictions: DataFrame, rule_hits: DataFrame, high=0.9, low=0.2) -> DataFrame:
    """Events where the model and the rules disagree; a strong rule wins.

    predictions: event_id, probability. rule_hits: event_id, rules, strong (0/1).
    """
    both = predictions.join(rule_hits, "event_id", "full")
    p = F.coalesce("probability", F.lit(0.0))
    ruled = F.col("rules").isNotNull() & (F.size("rules") > 0)
    kind = F.when((p >= high) & ~ruled, "unexplained_anomaly").when(
        (p <= low) & ruled & (F.col("strong") == 1), "rule_overrides_model"
    )
    return both.withColumn("conflict", kind).filter(F.col("conflict").isNotNull()).select(
        "event_id", p.alias("probability"), "conflict"
    )


def rule_variants(events: DataFrame, beacon_std=2.0) -> DataFrame:
    """(event_id, rule) hits of the documented constants."""
    kind = F.col("event_type")
    fails = events.filter((kind == "auth") & auth_failure(include_action=True))
    burst = recent_counts(fails, ["user"], V.AUTH_BURST_SECONDS).filter("n_recent >= 3")
    procs = events.filter(kind == "process")
    spawn = recent_counts(procs, ["source_host"], V.PROCESS_BURST_SECONDS).filter("n_recent >= 10")
    hour = hour_of()
    by_user = (
        events.filter((kind == "auth") & F.col("destination_host").isNotNull())
        .groupBy("user").agg(F.count("*").alias("n"), F.countDistinct("destination_host").alias("hosts"))
        .filter("n >= 10 and hosts <= 1")
    )
    hit = lambda df, name: df.select("event_id", F.lit(name).alias("rule"))
    return (
        hit(fails.join(burst, ["user", "timestamp"], "left_semi"), "failure_burst_3")
        .unionByName(hit(procs.join(spawn, ["source_host", "timestamp"], "left_semi"), "process_burst_10"))
        .unionByName(hit(events.filter(
            (kind == "flow") & ((flow_bytes() >= 10_000_000) | (flow_duration() >= 1000))), "flow_10mb_1000s"))
        .unionByName(hit(events.filter((kind == "auth") & ((hour < 6) | (hour >= 18))), "off_hours_6_18"))
        .unionByName(hit(events.filter(kind == "auth").join(by_user, "user", "left_semi"), "single_target_10"))
    )


def regular_destinations(events: DataFrame, max_std=2.0, contacts=5) -> DataFrame:
    """Destinations with at least `contacts` contacts whose gaps have std <= max_std."""
    from sentrylake.functions.scale import gap_segments

    net = events.filter(
        F.col("event_type").isin("dns", "flow") & F.col("destination_host").isNotNull()
    )
    size = net.groupBy("destination_host").agg(
        F.count("*").alias("contacts"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    gap = (F.col("timestamp") - F.col("previous")).cast("double")
    squares = gap_segments(net, ["destination_host"], V.DAY_SECONDS).groupBy("destination_host").agg(
        F.sum(gap * gap).alias("squares")
    )
    mean = (F.col("hi") - F.col("lo")) / (F.col("contacts") - 1)
    variance = F.col("squares") / (F.col("contacts") - 1) - mean * mean
    return (
        size.filter(F.col("contacts") >= contacts)
        .join(squares, "destination_host")
        .withColumn("gap_std", F.sqrt(F.greatest(F.lit(0.0), variance)))
        .filter(F.col("gap_std") <= max_std)
        .select("destination_host", "contacts", "gap_std")
    )


def list_adjustment(scored: DataFrame, watched: DataFrame, safe_tuples: DataFrame) -> DataFrame:
    """+20 for a watched user or host, -30 for a safelisted (user, host, process)."""
    users = watched.filter("type = 'user'").select(F.col("value").alias("user"), F.lit(1).alias("_wu")).distinct()
    hosts = watched.filter("type = 'host'").select(F.col("value").alias("source_host"), F.lit(1).alias("_wh")).distinct()
    tuples = safe_tuples.select("user", F.col("host").alias("source_host"), "process", F.lit(1).alias("_st")).distinct()
    plus = F.when(F.col("_wu").isNotNull() | F.col("_wh").isNotNull(), 20).otherwise(0)
    minus = F.when(F.col("_st").isNotNull(), 30).otherwise(0)
    return (
        scored.join(users, "user", "left").join(hosts, "source_host", "left")
        .join(tuples, ["user", "source_host", "process"], "left")
        .withColumn("adjusted_risk", F.greatest(F.lit(0), F.col("risk_score") + plus - minus))
        .select(*scored.columns, "adjusted_risk")
    )


def response_actions(scored: DataFrame) -> DataFrame:
    """Proposed catalog actions per incident, with technique ids and approval mode."""
    catalog = scored.sparkSession.createDataFrame(
        V.RESPONSE_CATALOG, "action_id string, action_name string, techniques string, mode string"
    )
    severe, listed = F.col("risk_score") >= 75, F.col("risk_score") >= 50
    proposed = F.filter(
        F.array(
            F.when(severe & (F.col("n_hosts") > 0), "ISOLATE_HOST"),
            F.when(severe & (F.col("n_users") > 0), "REVOKE_KERBEROS_TGT"),
            F.when(severe & (F.col("n_processes") > 0), "KILL_PROCESS_TREE"),
            F.when(listed, "ADD_TO_WATCHLIST"),
            F.lit("INCREASE_LOGGING"),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        scored.select("component", F.explode(proposed).alias("action_id"))
        .join(F.broadcast(catalog), "action_id")
        .withColumn("status", F.when(F.col("mode") == "human", "AWAITING_APPROVAL").otherwise("AUTOMATIC"))
    )
