"""Incidents that grow, merge and close across micro-batches.

What is kept between batches is bounded by the correlation gap and the allowed
lateness, not by the stream: the open runs of entities (an entity's events
without a gap above the limit, as one interval), and the totals and entities of
open incidents. A batch cuts its own events into runs, joins them to the open
runs that they touch, and solves the components of those few. An incident's id
is the smallest id of the events that opened one of its runs; where incidents
meet, the smaller id stays and a merge row tells the other's. Each batch gives
the scored rows of the incidents that it changed, closed or merged. Tables that
grow with the batch are joined by merges, so that none passes through the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import gap_segments
from sentrylake.operators.correlate import connected_components, event_entities, incident_entities
from sentrylake.operators.incidents import incident_confidence, incident_risk
from sentrylake.session import discard, materialize
from sentrylake.streaming.pipelines import stable_id
from sentrylake.streaming.state import EpochTable, latest_rows

ENTITY = ["entity_type", "entity"]
RUN = "entity_type string, entity string, first bigint, last bigint, node bigint"
TOTAL = (
    "component bigint, time_start bigint, time_end bigint, event_count bigint, max_risk bigint, sum_risk bigint, "
    "sources array<string>, agents_involved array<string>"
)
BRIDGE = "component bigint, entity_type string, entity string"


def joined_runs(runs: DataFrame, gap) -> DataFrame:
    """(entity, first, last, root, node): runs of an entity no more than `gap` apart are one, of the smallest node."""
    inside = W.partitionBy(*ENTITY).orderBy("first", "last", "node")
    reach = F.max("last").over(inside.rowsBetween(W.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col("first") > reach + gap)
    numbered = runs.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(inside))
    whole = W.partitionBy(*ENTITY, "_run")
    return numbered.select(
        *ENTITY, F.min("first").over(whole).alias("first"), F.max("last").over(whole).alias("last"),
        F.min("node").over(whole).alias("root"), "node")


def totals_of(members: DataFrame) -> DataFrame:
    return members.groupBy("component").agg(
        F.min("timestamp").alias("time_start"), F.max("timestamp").alias("time_end"), F.count("*").alias("event_count"),
        F.max("risk_score").cast("bigint").alias("max_risk"), F.sum("risk_score").cast("bigint").alias("sum_risk"),
        F.collect_set(F.lower("event_type")).alias("sources"), F.collect_set("agent").alias("agents_involved"))


def added_totals(totals: DataFrame) -> DataFrame:
    """One row per component of several partial ones."""
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return totals.groupBy("component").agg(
        F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"), F.sum("event_count").alias("event_count"),
        F.max("max_risk").alias("max_risk"), F.sum("sum_risk").alias("sum_risk"), names("sources"), names("agents_involved"))


def scored_incidents(totals: DataFrame, bridge: DataFrame) -> DataFrame:
    """Incident rows with risk, severity and confidence, as the batch operators score them."""
    counts = bridge.groupBy("component").agg(
        *[F.count_if(F.col("entity_type") == k).alias(n) for k, n in (("user", "n_users"), ("host", "n_hosts"), ("process", "n_processes"))])
    rows = totals.join(counts.hint("merge"), "component", "left").fillna(0, ["n_users", "n_hosts", "n_processes"])
    rows = rows.withColumn("duration_sec", F.greatest(F.lit(1), F.col("time_end") - F.col("time_start")))
    return incident_confidence(incident_risk(rows)).withColumn("incident_id", stable_id(F.col("component")))


class StreamIncidents:
    """A foreachBatch handler over flagged events (event_id, timestamp, entities, event_type, agent, risk_score).

    Events more than `late` seconds behind the newest event of earlier batches
    are dropped. An incident closes when no event that may still come can touch
    it: its last one is more than the gap plus `late` behind the newest.
    """

    def __init__(self, root, gap=V.CORRELATION_GAP, late=600):
        self.root, self.gap, self.late = root, gap, late
        self.runs, self.totals = EpochTable(f"{root}/runs", RUN), EpochTable(f"{root}/totals", TOTAL)
        self.bridge, self.clock = EpochTable(f"{root}/entities", BRIDGE), EpochTable(f"{root}/clock", "newest bigint")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        runs, totals, bridge, clock = (t.before(spark, epoch) for t in (self.runs, self.totals, self.bridge, self.clock))
        seen = clock.agg(F.max("newest")).first()[0]
        rows = batch.dropDuplicates(["event_id"])
        rows = materialize(rows if seen is None else rows.filter(F.col("timestamp") >= seen - self.late))
        newest = rows.agg(F.max("timestamp")).first()[0]
        newest = max(x for x in (seen, newest, -(1 << 62)) if x is not None)

        # runs of this batch, each named by the event that opens it
        entities = event_entities(rows)
        at = entities.groupBy(*ENTITY, "timestamp").agg(F.min("event_id").alias("id"))
        cut = materialize(gap_segments(at, ENTITY, self.gap, opener="id"))
        fresh = cut.groupBy(*ENTITY, F.col("opened_by").alias("node")).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        joined = materialize(joined_runs(fresh.unionByName(runs), self.gap))
        touched = materialize(entities.join(cut.hint("merge"), [*ENTITY, "timestamp"]).groupBy("event_id").agg(
            F.min("opened_by").alias("own"), F.collect_set("opened_by").alias("all")))
        links = joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(
            touched.select(F.explode("all").alias("a"), F.col("own").alias("b")))
        found = connected_components(links).withColumnRenamed("component", "to")
        moved = lambda df, c: df.join(found.withColumnRenamed("node", c).hint("merge"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")

        members = moved(rows.join(touched.select("event_id", F.col("own").alias("component")).hint("merge"), "event_id", "left").withColumn(
            "component", F.coalesce("component", "event_id")), "component")
        members = materialize(members.select(*rows.columns, "component"))
        members.write.mode("overwrite").parquet(f"{self.root}/members/epoch={epoch}")
        merges = materialize(totals.select(F.col("component").alias("from")).join(
            found.withColumnRenamed("node", "from").hint("merge"), "from").filter(F.col("from") != F.col("to")))
        merges.write.mode("overwrite").parquet(f"{self.root}/merges/epoch={epoch}")

        totals = materialize(added_totals(moved(totals, "component").select(*totals.columns).unionByName(totals_of(members))))
        bridge = materialize(moved(bridge, "component").select(*bridge.columns).unionByName(incident_entities(members)).distinct())
        limit = newest - self.gap - self.late
        changed = members.select("component").unionByName(merges.select(F.col("to").alias("component"))).unionByName(
            totals.filter(F.col("time_end") < limit).select("component")).distinct()
        status = F.when(F.col("time_end") < limit, "closed").otherwise("open")
        rows_out = scored_incidents(totals.join(changed.hint("merge"), "component"), bridge).withColumn("status", status)
        gone = merges.select(F.col("from").alias("component"), F.lit("merged").alias("status"))
        rows_out.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.root}/incidents/epoch={epoch}")

        stay = materialize(totals.filter(F.col("time_end") >= limit))
        self.totals.write(stay, epoch)
        self.bridge.write(bridge.join(stay.select("component").hint("merge"), "component", "left_semi").select("component", *ENTITY), epoch)
        ends = joined.filter(F.col("last") >= limit).select(*ENTITY, "first", "last", F.col("root").alias("node")).distinct()
        self.runs.write(moved(ends, "node").select(*ENTITY, "first", "last", "node"), epoch)
        self.clock.write(spark.createDataFrame([(newest,)], "newest bigint"), epoch)
        for table in (rows, cut, joined, touched, members, merges, totals, bridge, stay):
            discard(table)

    def members(self, spark) -> DataFrame:
        """All member rows with the ids that their incidents have now."""
        rows = spark.read.parquet(f"{self.root}/members").drop("epoch")
        merges = spark.read.parquet(f"{self.root}/merges").select(F.col("from").alias("a"), F.col("to").alias("b"))
        now = connected_components(merges).select(F.col("node").alias("component"), F.col("component").alias("_now"))
        rows = rows.join(now.hint("merge"), "component", "left").withColumn("component", F.coalesce("_now", "component")).drop("_now")
        return rows.withColumn("incident_id", stable_id(F.col("component")))

    def incidents(self, spark, min_events=V.INCIDENT_MIN_EVENTS, min_risk=V.INCIDENT_MIN_RISK) -> DataFrame:
        """The latest scored row of every incident that counts as one."""
        rows = latest_rows(spark, self.root, ["component"], "incidents").filter("status <> 'merged'")
        return rows.filter((F.col("event_count") >= min_events) | (F.col("max_risk") >= min_risk))

    def counters(self, spark) -> DataFrame:
        """Active incidents, Critical and High ones among them, closed ones, and events in them, so far."""
        rows = self.incidents(spark)
        live = F.col("status") == "open"
        return rows.agg(
            F.count_if(live).alias("active"), F.count_if(live & (F.col("severity") == "Critical")).alias("active_critical"),
            F.count_if(live & (F.col("severity") == "High")).alias("active_high"), F.count_if(~live).alias("closed"),
            F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"))
