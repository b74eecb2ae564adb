"""Correlation of flagged events into incidents.

Two events are linked when they share an entity and lie in the same run of that
entity's events with no gap above the limit; incidents are the connected
components. The result does not depend on row order or partitioning.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import gap_segments, number_rows, top_k_per_group
from sentrylake.functions.text import present
from sentrylake.session import discard, materialize


def collect_candidates(findings: DataFrame) -> DataFrame:
    """One row per event id; the first specialist in the fixed order wins."""
    rank = F.array_position(F.array(*[F.lit(a) for a in V.AGENT_ORDER]), F.col("agent"))
    columns = findings.columns
    best = findings.groupBy("event_id").agg(
        F.min_by(F.struct(*[c for c in columns if c != "event_id"]), rank).alias("row")
    )
    return best.select("event_id", "row.*").select(*columns)


def event_entities(events: DataFrame, *keep) -> DataFrame:
    """(event_id, timestamp, entity_type, entity), each entity once per event; `keep` names further columns."""
    entry = lambda kind, c: F.struct(
        F.lit(kind).alias("entity_type"), present(c).alias("entity")
    )
    entries = F.array(
        *[entry("user", c) for c in ("user", "source_user", "destination_user")],
        *[entry("host", c) for c in ("source_host", "destination_host")],
    )
    return (
        events.select("event_id", "timestamp", *keep, F.explode(F.array_distinct(entries)).alias("e"))
        .filter(F.col("e.entity").isNotNull())
        .select("event_id", "timestamp", *keep, "e.entity_type", "e.entity")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id of each component.

    Alternates two star contractions (each node points its larger neighbours,
    then its smaller ones, at the smallest id it knows), which needs
    O(log^2 n) rounds at any graph diameter, until a round changes nothing. The
    edge count never grows; minima combine on the map side, and every half
    round is written to shared storage once, so a lost executor costs that at most.
    Joins are merges: sides as large as the edges do not pass through the driver.
    """
    pairs = lambda df: df.filter("a <> b").distinct()
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    current = materialize(
        pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    )
    before = state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # every (a, b) has b < a from here on, so b is a smaller neighbour of a
        large = materialize(
            both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low.hint("merge"), "a")
        following = materialize(pairs(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                low.select("a", F.col("m").alias("b"))
            )
        ))
        discard(current)
        discard(large)
        current, after = following, state(following)
        if after == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def correlate_incidents(candidates: DataFrame, gap=V.CORRELATION_GAP) -> DataFrame:
    """(event_id, component) for every candidate.

    A run of an entity's events is named by the event that opens it; a
    component by the smallest such id, which is its first event when ids follow
    time. An event without entities is its own component.
    """
    seen = event_entities(candidates)
    keys = ["entity_type", "entity"]
    at = seen.groupBy(*keys, "timestamp").agg(F.min("event_id").alias("first_id"))
    runs = gap_segments(at, keys, gap, opener="first_id")
    # an event touches at most five entities, so at most five runs
    touched = materialize(
        seen.join(runs, [*keys, "timestamp"])
        .groupBy("event_id")
        .agg(F.min("opened_by").alias("root"), F.collect_set("opened_by").alias("roots"))
    )
    links = touched.filter(F.size("roots") > 1).select(
        F.col("root").alias("b"), F.explode("roots").alias("a")
    )
    components = connected_components(links).withColumnRenamed("node", "root")
    return (
        candidates.select("event_id")
        .join(touched.select("event_id", "root"), "event_id", "left")
        .join(components, "root", "left")
        .select("event_id", F.coalesce("component", "root", "event_id").alias("component"))
    )


def correlation_sweep(candidates: DataFrame, gaps=V.SWEEP_GAPS) -> DataFrame:
    """Incident counts per gap: one correlation per parameter value."""
    out = None
    for gap in gaps:
        members = incident_members(candidates, correlate_incidents(candidates, gap))
        row = members.groupBy("component").agg(F.count("*").alias("n")).agg(
            F.lit(gap).cast("bigint").alias("gap_seconds"),
            F.count("*").alias("incidents"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
            F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def filter_incidents(sizes: DataFrame, min_events=V.INCIDENT_MIN_EVENTS, min_risk=V.INCIDENT_MIN_RISK):
    return sizes.filter((F.col("event_count") >= min_events) | (F.col("max_risk") >= min_risk))


def incident_members(candidates: DataFrame, components: DataFrame) -> DataFrame:
    """Candidates of the components that are kept as incidents."""
    rows = candidates.join(components, "event_id")
    sizes = rows.groupBy("component").agg(
        F.count("*").alias("event_count"), F.max("risk_score").alias("max_risk")
    )
    return rows.join(filter_incidents(sizes).select("component"), "component", "left_semi")


def incident_entities(members: DataFrame) -> DataFrame:
    """Bridge: distinct (component, entity_type, entity), processes included."""
    entry = lambda kind, c: F.struct(F.lit(kind).alias("entity_type"), present(c).alias("entity"))
    entries = F.array(
        *[entry("user", c) for c in ("user", "source_user", "destination_user")],
        *[entry("host", c) for c in ("source_host", "destination_host")],
        entry("process", "process"),
    )
    return (
        members.select("component", F.explode(entries).alias("e"))
        .filter(F.col("e.entity").isNotNull())
        .select("component", "e.entity_type", "e.entity")
        .distinct()
    )


def build_incidents(members: DataFrame, numbered=True) -> DataFrame:
    """One row per incident, numbered by (start, -size).

    Entities are counted here and listed, one row each, by `incident_entities`;
    `entity_heads` gives the first few for display.
    """
    facts = members.groupBy("component").agg(
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
        F.count("*").alias("event_count"),
        F.max("risk_score").cast("bigint").alias("max_risk"),
        F.sum("risk_score").cast("bigint").alias("sum_risk"),
        F.sort_array(F.collect_set(F.lower("event_type"))).alias("sources"),
        F.sort_array(F.collect_set("agent")).alias("agents_involved"),
        F.max(F.exists("rules", lambda r: r.contains("BURST")).cast("int")).alias("has_burst"),
    )
    bridge = incident_entities(members)
    counts = bridge.groupBy("component").agg(
        *[F.count_if(F.col("entity_type") == k).alias(f"n_{p}")
          for k, p in (("user", "users"), ("host", "hosts"), ("process", "processes"))],
        F.count_if((F.col("entity_type") == "user") & ~F.col("entity").endswith("$")).alias("n_people"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = (
        facts.join(counts, "component", "left")
        .select(
            *facts.columns,
            F.greatest(F.lit(1), F.col("time_end") - F.col("time_start")).alias("duration_sec"),
            (F.size("agents_involved") > 1).cast("int").alias("is_multi_agent"),
            zero("n_users").alias("n_users"), zero("n_hosts").alias("n_hosts"),
            zero("n_processes").alias("n_processes"), zero("n_people").alias("n_people"),
        )
    )
    if not numbered:
        return rows
    order = [F.col("time_start"), F.col("event_count").desc(), F.col("component")]
    rows = materialize(rows)  # numbering reads its input twice
    return number_rows(rows, order, "incident_no").withColumn(
        "incident_id", F.format_string("INC-%04d", "incident_no")
    ).drop("incident_no")


def incident_base_risk(incidents: DataFrame) -> DataFrame:
    raw = (
        F.col("max_risk") * 5
        + F.greatest(F.lit(0), F.col("sum_risk") - F.col("max_risk")) * 0.4
        + F.size("sources") * 5
    )
    return incidents.withColumn("base_risk", F.least(F.lit(100), raw.cast("int")))


def incident_progression(members: DataFrame, reasons=3) -> DataFrame:
    """Event types in first-seen order joined by ` -> `, and the first reasons by name."""
    kinds = members.groupBy("component", "event_type").agg(
        F.min(F.struct("timestamp", "event_id")).alias("first_seen")
    )
    flow = kinds.groupBy("component").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_seen", F.upper("event_type").alias("t")))),
                lambda x: x["t"],
            ),
            " -> ",
        ).alias("progression")
    )
    named = members.select("component", F.explode("evidence").alias("reason")).distinct()
    signals = top_k_per_group(named, ["component"], [F.col("reason")], reasons).groupBy("component").agg(
        F.array_join(F.array_sort(F.collect_list("reason")), "; ").alias("signals")
    )
    return flow.join(signals, "component", "left")


TIMELINE_FIELDS = [
    "timestamp", "event_id", "event_type", "user", "source_host",
    "destination_host", "risk_score", "agent",
]


def incident_timeline(members: DataFrame, first=15) -> DataFrame:
    """(component, position, event fields): the first events of each incident."""
    rows = members.select("component", *TIMELINE_FIELDS)
    return top_k_per_group(
        rows, ["component"], [F.col("timestamp"), F.col("event_id")], first
    ).withColumnRenamed("rank", "position")


def timeline_lists(members: DataFrame, first=15) -> DataFrame:
    entry = F.struct("position", *TIMELINE_FIELDS)
    return incident_timeline(members, first).groupBy("component").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("position")).alias("timeline")
    )


def alert_reduction(candidates: DataFrame, incidents: DataFrame) -> DataFrame:
    events = candidates.agg(F.count("*").alias("events"))
    found = incidents.agg(
        F.count("*").alias("incidents"),
        F.coalesce(F.sum("is_multi_agent"), F.lit(0)).alias("multi_agent_incidents"),
    )
    return events.crossJoin(F.broadcast(found)).withColumn(
        "reduction_percent",
        F.coalesce(
            F.round(F.try_divide((F.col("events") - F.col("incidents")) * 100, F.col("events")), 2),
            F.lit(0.0),
        ),
    )


def correlation_summary(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        F.count("*").alias("incidents"),
        F.sum("event_count").alias("events"),
        F.count_if(F.size("sources") >= 2).alias("multi_source"),
        F.round(F.avg(F.col("time_end") - F.col("time_start")), 1).alias("mean_duration"),
        F.round(F.avg("event_count"), 1).alias("mean_events"),
    )


def graph_alert_clusters(
    events: DataFrame, gap=V.CORRELATION_GAP, min_events=V.INCIDENT_MIN_EVENTS, min_hosts=V.GRAPH_MIN_HOSTS
) -> DataFrame:
    """Clusters over all events, scores unread; alerting ones have enough events and hosts."""
    narrow = events.select(
        "event_id", "timestamp", "user", "source_user", "destination_user", "source_host", "destination_host"
    )
    rows = materialize(narrow.join(correlate_incidents(narrow, gap), "event_id"))
    sizes = rows.groupBy("component").agg(
        F.count("*").alias("event_count"),
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
    )
    hosts = (
        rows.select("component", F.explode(F.array("source_host", "destination_host")).alias("h"))
        .filter(F.col("h").isNotNull())
        .groupBy("component")
        .agg(F.countDistinct("h").alias("host_count"))
    )
    return sizes.join(hosts, "component", "left").filter(
        (F.col("event_count") >= min_events) & (F.col("host_count") >= min_hosts)
    )
