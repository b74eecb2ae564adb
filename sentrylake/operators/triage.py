"""The triage rule set: ten explainable rules, their score and summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import recent_counts
from sentrylake.functions.text import contains_any, detail_number, fired
from sentrylake.operators.baselines import pair_frequency, pair_host, process_frequency


def never():
    return F.lit(False)


def auth_failure(include_action=False):
    hit = F.lower(F.coalesce("details", F.lit(""))).contains("fail")
    if include_action:
        hit = hit | F.lower(F.coalesce("action", F.lit(""))).contains("fail")
    return hit


def unusual_protocol():
    return contains_any(F.lower(F.coalesce("details", F.lit(""))), ["ntlm", "network"])


def flow_bytes():
    return F.coalesce(F.col("bytes"), detail_number(F.col("details"), "bytes"), F.lit(0))


def flow_duration():
    return F.coalesce(F.col("duration"), detail_number(F.col("details"), "duration"), F.lit(0))


def auth_bursts(events, seconds=V.AUTH_BURST_SECONDS, more_than=V.BURST_MORE_THAN):
    """(user, timestamp, n_recent) of the seconds at which a user is in a burst."""
    auth = events.filter(F.col("event_type") == "auth")
    return recent_counts(auth, ["user"], seconds).filter(F.col("n_recent") > more_than)


def process_bursts(events, seconds=V.PROCESS_BURST_SECONDS, more_than=V.BURST_MORE_THAN):
    procs = events.filter(F.col("event_type") == "process")
    return recent_counts(procs, ["source_host"], seconds).filter(F.col("n_recent") > more_than)


def rare_pairs(events, at_most=V.RARE_PAIR_AT_MOST):
    return pair_frequency(events).filter(F.col("pair_count") <= at_most)


def rare_processes(events, below=V.RARE_PROCESS_BELOW):
    return process_frequency(events).filter(F.col("process_count") < below)


def triage(
    events: DataFrame,
    iocs: DataFrame = None,
    rare_pair_at_most=V.RARE_PAIR_AT_MOST,
    rare_process_below=V.RARE_PROCESS_BELOW,
    bytes_above=V.FLOW_BYTES_ABOVE,
    duration_above=V.FLOW_DURATION_ABOVE,
    skip=(),
) -> DataFrame:
    """Score every event; adds risk_score, is_suspicious, triggered_rules, triage_reasons.

    Only the keys that fire a count rule (bursts, rare pairs, rare processes)
    are joined back, and each event type only takes the joins it needs, so no
    join sees a null key. Whether the wide event rows are shuffled for them
    follows from the sizes that adaptive execution sees. The label is never read.
    """
    host = pair_host()
    bursts = auth_bursts(events).withColumnRenamed("n_recent", "auth_recent")
    spawns = process_bursts(events).withColumnRenamed("n_recent", "proc_recent")
    pairs = rare_pairs(events, rare_pair_at_most).withColumnRenamed("host", "pair_host")
    procs = rare_processes(events, rare_process_below)

    keyed = events.withColumn("pair_host", host)
    none = F.lit(None).cast("bigint")
    kind = F.col("event_type")
    auth = (
        keyed.filter(kind == "auth")
        .join(bursts, ["user", "timestamp"], "left")
        .withColumn("proc_recent", none)
        .withColumn("process_count", none)
    )
    process = (
        keyed.filter(kind == "process")
        .join(spawns, ["source_host", "timestamp"], "left")
        .join(procs, "process", "left")
        .withColumn("auth_recent", none)
    )
    other = (
        keyed.filter(~kind.isin("auth", "process"))
        .withColumn("auth_recent", none)
        .withColumn("proc_recent", none)
        .withColumn("process_count", none)
    )
    all_rows = auth.unionByName(process).unionByName(other)
    all_rows = all_rows.join(pairs, ["user", "pair_host"], "left")

    all_rows = all_rows.withColumns(
        {"rare_pair": F.col("pair_count").isNotNull(), "rare_process": F.col("process_count").isNotNull()}
    )
    return apply_rules(with_listed(all_rows, iocs), events.columns, bytes_above, duration_above, skip)


def with_listed(rows: DataFrame, iocs: DataFrame = None) -> DataFrame:
    """Adds listed_user, listed_src and listed_dst flags."""
    checks = [("user", "user", "listed_user"), ("host", "source_host", "listed_src"),
              ("host", "destination_host", "listed_dst")]
    for kind, column, flag in checks:
        if iocs is None:
            rows = rows.withColumn(flag, never())
            continue
        keys = iocs.filter(F.col("type") == kind).select(F.col("value").alias(column), F.lit(True).alias("_hit"))
        rows = rows.join(keys.distinct(), column, "left").withColumn(flag, F.coalesce("_hit", never())).drop("_hit")
    return rows


def triage_frozen(
    events: DataFrame, pairs: DataFrame, processes: DataFrame, iocs: DataFrame = None,
    rare_pair_at_most=V.RARE_PAIR_AT_MOST, rare_process_below=V.RARE_PROCESS_BELOW,
    bytes_above=V.FLOW_BYTES_ABOVE, duration_above=V.FLOW_DURATION_ABOVE, skip=(),
) -> DataFrame:
    """Score events against frozen profiles: row by row, so it also runs on streams.

    A pair or process the profile has never seen counts as 0. Burst rules need
    other rows and are left out; `stream_bursts` adds them.
    """
    rows = (
        events.withColumn("pair_host", pair_host())
        .join(pairs.withColumnRenamed("host", "pair_host"), ["user", "pair_host"], "left")
        .join(processes, "process", "left")
    )
    none = F.lit(None).cast("bigint")
    known = F.col("user").isNotNull() & F.col("pair_host").isNotNull()
    is_process = (F.col("event_type") == "process") & F.col("process").isNotNull()
    rows = rows.withColumns(
        {
            "auth_recent": none,
            "proc_recent": none,
            "rare_pair": known & (F.coalesce("pair_count", F.lit(0)) <= rare_pair_at_most),
            "rare_process": is_process & (F.coalesce("process_count", F.lit(0)) < rare_process_below),
        }
    )
    return apply_rules(with_listed(rows, iocs), events.columns, bytes_above, duration_above, skip)


def apply_rules(rows, columns, bytes_above, duration_above, skip=()) -> DataFrame:
    """Evaluate the rules over prepared flags and score each row."""
    kind = F.col("event_type")
    is_auth, is_flow = kind == "auth", kind == "flow"
    w = V.TRIAGE_WEIGHTS
    rules = [
        ("R1_AUTH_FAILURE", is_auth & auth_failure(), F.lit(V.TRIAGE_REASONS["failure"])),
        ("R2_AUTH_BURST", F.col("auth_recent").isNotNull(),
         F.format_string(V.TRIAGE_REASONS["auth_burst"], "auth_recent")),
        ("R3_UNUSUAL_AUTH", is_auth & unusual_protocol(),
         F.lit(V.TRIAGE_REASONS["protocol"])),
        ("R4_RARE_USER_HOST", F.col("rare_pair"),
         F.format_string(V.TRIAGE_REASONS["rare_pair"], "user", "pair_host")),
        ("R5_SUSPICIOUS_PROC", F.col("rare_process"),
         F.format_string(V.TRIAGE_REASONS["rare_process"], "process")),
        ("R6_PROC_BURST", F.col("proc_recent").isNotNull(),
         F.format_string(V.TRIAGE_REASONS["process_burst"], "proc_recent")),
        ("R7_NETWORK_ANOMALY", is_flow & ((flow_bytes() > bytes_above) | (flow_duration() > duration_above)),
         F.format_string(V.TRIAGE_REASONS["flow"], flow_bytes(), flow_duration())),
        ("R8_REDTEAM_USER", F.col("listed_user"),
         F.format_string(V.TRIAGE_REASONS["listed_user"], "user")),
        ("R9_REDTEAM_HOST", F.col("listed_src") | F.col("listed_dst"),
         F.format_string(V.TRIAGE_REASONS["listed_host"],
                         F.when(F.col("listed_src"), F.col("source_host")).otherwise(F.col("destination_host")))),
    ]
    rules = [(name, cond, text) for name, cond, text in rules if name not in skip]
    names = fired([(cond, F.lit(name)) for name, cond, _ in rules])
    texts = fired([(cond, text) for _, cond, text in rules])
    points = sum(F.when(cond, w[name]).otherwise(0) for name, cond, _ in rules)
    scored = rows.withColumns({"_names": names, "_texts": texts, "_points": points})
    return score_event(scored, F.size("_names") >= 2).select(
        *columns, "risk_score", "is_suspicious", "triggered_rules", "triage_reasons"
    )


def score_event(scored: DataFrame, compound) -> DataFrame:
    """Turn fired rules into the final score, flag, rule list and reasons."""
    bonus = V.TRIAGE_WEIGHTS["R10_TEMPORAL_BURST"]
    text = F.format_string(
        V.TRIAGE_REASONS["compound"], F.size("_names")
    )
    return scored.withColumns(
        {
            "risk_score": F.col("_points") + F.when(compound, bonus).otherwise(0),
            "is_suspicious": (
                F.col("_points") + F.when(compound, bonus).otherwise(0) >= V.SUSPICIOUS_AT
            ).cast("int"),
            "triggered_rules": F.when(
                compound, F.array_append("_names", F.lit("R10_TEMPORAL_BURST"))
            ).otherwise(F.col("_names")),
            "triage_reasons": F.when(compound, F.array_append("_texts", text)).otherwise(F.col("_texts")),
        }
    )


def rule_frequency(triaged: DataFrame) -> DataFrame:
    return (
        triaged.select(F.explode("triggered_rules").alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("events"))
    )


def triage_summary(triaged: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("is_suspicious") == 1)
    return triaged.agg(
        F.count("*").alias("total_events"),
        flagged.alias("flagged_events"),
        (F.count("*") - flagged).alias("normal_events"),
        F.round(F.try_divide(flagged * 100, F.count("*")), 1).alias("flagged_percent"),
        F.round(F.avg("risk_score"), 2).alias("mean_risk"),
        F.max("risk_score").cast("bigint").alias("max_risk"),
    )
