"""Scoring, explanation, prioritization and review of incidents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import top_k_per_group
from sentrylake.functions.text import fired, level


def _base_and_lateral():
    base = F.least(F.lit(55.0), F.col("max_risk") * 3.5 + F.log1p("sum_risk") * 5.0)
    lateral = F.least(F.lit(20.0), F.greatest(F.lit(0), F.col("n_hosts") - 1) * 4.0)
    return base, lateral


def incident_risk(incidents: DataFrame) -> DataFrame:
    """Adds risk_score and severity; the bonus comes from agreeing specialists."""
    base, lateral = _base_and_lateral()
    velocity = F.least(F.lit(10.0), F.col("event_count") / F.col("duration_sec") * 90.0)
    agents = F.size("agents_involved")
    threat = F.when(agents >= 3, 15.0).when(agents >= 2, 10.0).otherwise(0.0)
    risk = F.least(F.lit(100.0), F.bround(base + lateral + velocity + threat, 1))
    return incidents.withColumn("risk_score", risk).withColumn(
        "severity", level(F.col("risk_score"), V.SEVERITY_LEVELS)
    )


def incident_risk_v1(incidents: DataFrame) -> DataFrame:
    """Earlier whole-number risk: the bonus comes from a strong event or a burst rule."""
    base, lateral = _base_and_lateral()
    velocity = F.least(F.lit(10.0), F.col("event_count") / F.col("duration_sec") * 60.0 * 1.5)
    threat = F.when((F.col("max_risk") >= 6) | (F.col("has_burst") == 1), 15.0).otherwise(0.0)
    risk = F.least(F.lit(100.0), F.bround(base + lateral + velocity + threat)).cast("int")
    return incidents.withColumn("risk_v1", risk).withColumn(
        "risk_level", level(F.col("risk_v1"), V.SEVERITY_LEVELS)
    )


def _sources_and_volume(sources):
    return (
        F.least(F.lit(50.0), sources * 12.5),
        F.least(F.lit(20.0), F.log2(F.col("event_count") + 1) * 4.0),
    )


def incident_confidence(incidents: DataFrame) -> DataFrame:
    by_source, volume = _sources_and_volume(F.greatest(F.size("sources"), F.size("agents_involved")))
    entities = F.when((F.col("n_users") > 0) & (F.col("n_hosts") > 0), 15.0).otherwise(8.0)
    density = F.least(F.lit(15.0), F.col("sum_risk") / F.col("event_count") / 8.0 * 15.0)
    score = F.least(F.lit(100.0), F.bround(by_source + volume + entities + density, 1))
    return incidents.withColumn("confidence_score", score)


def incident_confidence_v1(incidents: DataFrame) -> DataFrame:
    by_source, volume = _sources_and_volume(F.size("sources"))
    hosts, users = F.col("n_hosts") > 0, F.col("n_users") > 0
    entities = F.when(hosts & users, 15.0).when(hosts, 8.0).otherwise(0.0)
    lasting = (
        F.when((F.col("duration_sec") > 300) & (F.col("event_count") >= 5), 15.0)
        .when(F.col("event_count") >= 3, 8.0)
        .otherwise(0.0)
    )
    score = F.least(F.lit(100.0), F.bround(by_source + volume + entities + lasting)).cast("int")
    return incidents.withColumn("confidence_v1", score).withColumn(
        "confidence_level", level(F.col("confidence_v1"), V.CONFIDENCE_LEVELS)
    )


def severity_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("severity").agg(F.count("*").alias("incidents"))


def incident_evidence(members: DataFrame, first=8) -> DataFrame:
    """The first distinct evidence strings of each incident in event order."""
    items = members.select(
        "component", "timestamp", "event_id", F.posexplode("evidence").alias("pos", "text")
    )
    distinct = items.groupBy("component", "text").agg(
        F.min(F.struct("timestamp", "event_id", "pos")).alias("at")
    )
    kept = top_k_per_group(distinct, ["component"], [F.col("at"), F.col("text")], first)
    return kept.groupBy("component").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("evidence")
    )


def uncertainty_notes(incidents: DataFrame) -> DataFrame:
    has = lambda s: F.array_contains("sources", s)
    notes = [
        (F.size("sources") <= 1,
         V.CAVEATS["single_source"]),
        ((F.col("n_processes") == 0) & has("auth"),
         V.CAVEATS["no_process"]),
        (has("dns") & ~has("flow"),
         V.CAVEATS["no_flow"]),
        (F.col("n_people") == 0,
         V.CAVEATS["machines"]),
        (F.lit(True),
         V.CAVEATS["standing"]),
    ]
    return incidents.withColumn("uncertainty", fired([(c, F.lit(t)) for c, t in notes]))


def head_text(column, total, first=3, nothing="none"):
    """`a, b, c (+n more)`."""
    shown = F.array_join(F.slice(column, 1, first), ", ")
    more = F.format_string(" (+%d more)", total - first)
    return F.when(total == 0, nothing).otherwise(
        F.concat(shown, F.when(total > first, more).otherwise(""))
    )


def entity_heads(members_bridge: DataFrame, first=4) -> DataFrame:
    """(component, first_users, first_hosts): leading names by sort order.

    Works from the entity bridge, so it is exact for incidents whose full list
    is too long to inline.
    """
    wanted = members_bridge.filter(F.col("entity_type").isin("user", "host"))
    kept = top_k_per_group(wanted, ["component", "entity_type"], [F.col("entity")], first)
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("entity_type") == k, F.col("entity"))))
    return kept.groupBy("component").agg(pick("user").alias("first_users"), pick("host").alias("first_hosts"))


def incident_narrative(scored: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds a templated explanation of each incident; labels are never read."""
    empty = F.array().cast("array<string>")
    rows = scored.join(heads, "component", "left").withColumns(
        {c: F.coalesce(F.col(c), empty) for c in ("first_users", "first_hosts")}
    )
    users = head_text(F.col("first_users"), F.col("n_users"), nothing="unspecified users")
    hosts = head_text(F.col("first_hosts"), F.col("n_hosts"), nothing="unspecified endpoints")
    sources = F.array_join(F.transform("sources", lambda s: F.upper(s)), " -> ")
    strong = F.format_string(
        V.NARRATIVES["strong"],
        "incident_id", "severity", "risk_score", users, hosts, sources,
    )
    weak = F.format_string(
        V.NARRATIVES["weak"],
        "incident_id", "risk_score", "confidence_score", users,
    )
    return rows.withColumn("explanation", F.when(F.col("risk_score") >= 60, strong).otherwise(weak))


def response_priority(scored: DataFrame, heads: DataFrame) -> DataFrame:
    """Priority, action and steps of each incident; approval is always required."""
    empty = F.array().cast("array<string>")
    rows = scored.join(heads, "component", "left").withColumns(
        {c: F.coalesce(F.col(c), empty) for c in ("first_users", "first_hosts")}
    )
    risk = F.col("risk_score")
    has = lambda *s: F.arrays_overlap("sources", F.array(*[F.lit(x) for x in s]))
    names = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    investigate = fired([
        (F.size("first_users") > 0,
         F.concat(F.lit(V.STEPS["audit"]), names("first_users", 4))),
        (F.size("first_hosts") > 0,
         F.concat(F.lit(V.STEPS["inspect"]),
                  names("first_hosts", 4))),
        (has("process"),
         F.lit(V.STEPS["lineage"])),
        (has("flow", "dns"),
         F.lit(V.STEPS["egress"])),
    ])
    contain = (
        F.when(risk >= 75, F.array(
            F.concat(F.lit(V.STEPS["isolate"]),
                     names("first_hosts", 3), F.lit(V.STEPS["sign_off"])),
            F.concat(F.lit(V.STEPS["suspend"]),
                     names("first_users", 3), F.lit(".")),
            F.lit(V.STEPS["revoke"]),
        ))
        .when(risk >= 50, F.array(
            F.lit(V.STEPS["sample"]),
            F.lit(V.STEPS["watch"]),
        ))
        .otherwise(F.array(
            F.lit(V.STEPS["log"]),
        ))
    )
    return rows.withColumns(
        {
            "priority": level(risk, V.PRIORITIES),
            "recommended_action": level(risk, V.ACTIONS),
            "investigation_steps": investigate,
            "containment_steps": contain,
            "requires_human_approval": F.lit(1),
        }
    ).drop("first_users", "first_hosts")


def priority_distribution(responses: DataFrame) -> DataFrame:
    return responses.groupBy("priority").agg(F.count("*").alias("incidents"))


def rank_incidents(scored: DataFrame, first=25, risk="risk_score", confidence="confidence_score"):
    return scored.orderBy(F.col(risk).desc(), F.col(confidence).desc(), F.col("component")).limit(first)


def risk_confidence_crosstab(scored: DataFrame) -> DataFrame:
    """Counts by level and level, with `All` margins."""
    both = [F.coalesce(F.col(c), F.lit("All")).alias(c) for c in ("risk_level", "confidence_level")]
    return scored.cube("risk_level", "confidence_level").agg(F.count("*").alias("incidents")).select(
        *both, "incidents"
    )


def review_queue(scored: DataFrame) -> DataFrame:
    """Status and note per incident from the two levels; labels are never read."""
    risk, sure = F.col("risk_level"), F.col("confidence_level")
    ladder = [
        (risk.isin("Critical", "High") & sure.isin("High", "Medium"), V.REVIEW_STATUS["required"],
         V.REVIEW_NOTES["strong"]),
        ((sure == "Low") & (F.col("risk_v1") >= 40), V.REVIEW_STATUS["more"],
         V.REVIEW_NOTES["thin"]),
        (risk == "Low", V.REVIEW_STATUS["benign"],
         V.REVIEW_NOTES["benign"]),
        (F.lit(True), V.REVIEW_STATUS["required"], V.REVIEW_NOTES["moderate"]),
    ]
    status = F.coalesce(*[F.when(c, s) for c, s, _ in ladder])
    note = F.coalesce(*[F.when(c, n) for c, _, n in ladder])
    return scored.withColumns({"review_status": status, "analyst_recommendation": note})


def review_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("review_status").agg(F.count("*").alias("incidents"))


def incident_status(scored: DataFrame, risk="risk_score") -> DataFrame:
    return scored.withColumn("status", level(F.col(risk), V.REPORT_STATUS))


def search_incidents(queue: DataFrame, bridge: DataFrame, text="", status=None, risk=None) -> DataFrame:
    """Case-insensitive substring over id, users, hosts and types, with filters.

    Entity names are searched in the bridge, so long lists are searched whole.
    """
    rows = queue
    if status:
        rows = rows.filter(F.col("review_status") == status)
    if risk:
        rows = rows.filter(F.col("risk_level") == risk)
    if not text:
        return rows
    q = text.lower()
    named = (
        bridge.filter(F.col("entity_type").isin("user", "host") & F.lower("entity").contains(q))
        .select("component", F.lit(1).alias("_named"))
        .distinct()
    )
    own = F.lower("incident_id").contains(q) | F.lower(F.array_join("sources", ";")).contains(q)
    return rows.join(named, "component", "left").filter(own | F.col("_named").isNotNull()).drop("_named")


def incident_report(scored: DataFrame, members: DataFrame, first=25, steps=10) -> DataFrame:
    """Report lines of the top incidents: (component, status, section, position, line).

    Sections: `reason` (distinct, read in text order) and `event` (the first
    events, by position). The top incidents are fixed first, so nothing of the
    others is gathered, and long reason lists stay rows.
    """
    top = incident_status(rank_incidents(scored, first)).select("component", "status")
    inside = members.join(F.broadcast(top), "component")
    reasons = (
        inside.select("component", "status", F.explode("evidence").alias("line"))
        .distinct()
        .select("component", "status", F.lit("reason").alias("section"), F.lit(0).alias("position"), "line")
    )
    events = top_k_per_group(
        inside.select("component", "status", "timestamp", "event_id", "event_type", "action", "details"),
        ["component"], [F.col("timestamp"), F.col("event_id")], steps,
    )
    line = F.format_string(
        "%s at t=%d: %s (%s)", F.upper("event_type"), "timestamp",
        F.coalesce("action", F.lit("")), F.coalesce("details", F.lit("")),
    )
    return reasons.unionByName(
        events.select("component", "status", F.lit("event").alias("section"),
                      F.col("rank").alias("position"), line.alias("line"))
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("incident_id").agg(F.max_by("verdict", "seq").alias("verdict"))


def join_investigation(incidents, analyses, recommendations, reviews) -> DataFrame:
    """Incidents with analysis, recommendation and latest review, defaults where absent."""
    fill = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    joined = (
        incidents.join(analyses, "incident_id", "left")
        .join(recommendations, "incident_id", "left")
        .join(latest_reviews(reviews), "incident_id", "left")
    )
    return joined.select(
        *incidents.columns,
        fill("risk_score", 50.0), fill("confidence_score", 50.0), fill("severity", "Medium"),
        fill("explanation", V.JOIN_DEFAULTS["explanation"]),
        fill("recommended_action", V.JOIN_DEFAULTS["action"]), fill("priority", "P2 - High Priority"),
        F.coalesce("verdict", F.lit(V.JOIN_DEFAULTS["review"])).alias("review_status"),
    )
