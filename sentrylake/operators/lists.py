"""Threat lists and analyst feedback as DataFrames of (type, value)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V


def classify_indicator(value):
    """The indicator type implied by the text itself; the ladder order matters."""
    v = F.trim(value)
    endings = r"\.(" + "|".join(V.EXECUTABLE_SUFFIXES) + ")$"
    return (
        F.when(v.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "host")
        .when(v.rlike(r"^[a-fA-F0-9]{32,}$"), "hash")
        .when(v.rlike(r"^[\w\-]+\.[\w\-]+") & ~v.endswith(".exe"), "domain")
        .when(v.rlike(endings), "process")
        .otherwise("user")
    )


def normalize_ioc_type(kind):
    """Type synonyms to the five types; null when unknown."""
    k = F.lower(F.trim(kind))
    out = None
    for name, words in V.IOC_TYPES.items():
        out = F.when(k.isin(words), name) if out is None else out.when(k.isin(words), name)
    return out


def build_iocs(raw: DataFrame) -> DataFrame:
    """(indicator, type) rows to distinct (type, value); untyped rows are classified."""
    value = F.trim("indicator")
    typed = F.col("type").isNotNull() & (F.trim("type") != "")
    return (
        raw.select(
            F.when(typed, normalize_ioc_type(F.col("type"))).otherwise(classify_indicator(value)).alias("type"),
            value.alias("value"),
        )
        .filter(F.col("type").isNotNull() & (F.col("value") != ""))
        .distinct()
    )


def ioc_match(values: DataFrame, iocs: DataFrame, column="value", kind=None) -> DataFrame:
    """The rows of `values` whose `column` is listed, under one type or any."""
    wanted = iocs if kind is None else iocs.filter(F.col("type") == kind)
    keys = wanted.select(F.col("value").alias("_listed")).distinct()
    return values.join(keys, F.trim(F.col(column)) == F.col("_listed"), "left_semi")


def ioc_remove(iocs: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.select(normalize_ioc_type(F.col("type")).alias("type"), F.trim("value").alias("value"))
    return iocs.join(gone, ["type", "value"], "left_anti")


def ioc_enrich(iocs: DataFrame, existing: DataFrame) -> DataFrame:
    return iocs.select("type", "value").unionByName(existing.select("type", "value")).distinct()


def ioc_counts(iocs: DataFrame) -> DataFrame:
    return iocs.groupBy("type").agg(F.count("*").alias("indicators"))


def verdict_list(verdict):
    """watch, safe, or null for a verdict that teaches nothing."""
    v = F.replace(F.upper(verdict), F.lit(" "), F.lit("_"))
    return F.when(v.isin(V.SUSPICIOUS_VERDICTS), "watch").when(v.isin(V.BENIGN_VERDICTS), "safe")


def apply_verdicts(verdicts: DataFrame) -> DataFrame:
    """(type, value, list): the latest teaching verdict of each entity decides.

    Input: seq, incident_id, verdict, users[], hosts[], processes[]. Both list
    membership and its replacement follow from one `max_by`, so the verdict log
    itself is the only state.
    """
    return teaching_verdicts(verdicts).drop("seq")


def teaching_verdicts(verdicts: DataFrame) -> DataFrame:
    """(type, value, list, seq): the latest teaching verdict of each entity with its place in the log."""
    entity = lambda col, kind: F.transform(
        F.coalesce(F.col(col), F.array().cast("array<string>")),
        lambda x: F.struct(F.lit(kind).alias("type"), F.trim(x).alias("value")),
    )
    return (
        verdicts.withColumn("list", verdict_list(F.col("verdict")))
        .filter(F.col("list").isNotNull())
        .select(
            "seq",
            "list",
            F.explode(
                F.concat(entity("users", "user"), entity("hosts", "host"), entity("processes", "process"))
            ).alias("e"),
        )
        .select("seq", "list", "e.type", "e.value")
        .filter(F.col("value") != "")
        .transform(latest_lists)
    )


def latest_lists(entries: DataFrame) -> DataFrame:
    """(type, value, list, seq): of several entries of an entity, the one with the largest seq."""
    return entries.groupBy("type", "value").agg(
        F.max_by("list", "seq").alias("list"), F.max("seq").alias("seq")
    )


def listed_risk(events: DataFrame, learned: DataFrame) -> DataFrame:
    """Adds `listed_risk`: risk_score, +3 for a watched user, +2 for a watched source host, 0 for a safe user."""
    rows = list_lookup(events, learned, "user", "user").withColumnsRenamed({"is_watched": "_user", "is_safe": "_safe"})
    rows = list_lookup(rows, learned, "source_host", "host")
    raised = F.col("risk_score") + 3 * F.col("_user") + 2 * F.col("is_watched")
    return rows.withColumn("listed_risk", F.when(F.col("_safe") == 1, 0).otherwise(raised)).select(*events.columns, "listed_risk")


def watchlist(learned: DataFrame) -> DataFrame:
    return learned.filter("list = 'watch'").select("type", "value")


def safelist(learned: DataFrame) -> DataFrame:
    return learned.filter("list = 'safe'").select("type", "value")


def list_lookup(values: DataFrame, learned: DataFrame, column="value", kind=None) -> DataFrame:
    """Adds 0/1 `is_watched` and `is_safe` for the trimmed value, one type or any."""
    wanted = learned if kind is None else learned.filter(F.col("type") == kind)
    flags = wanted.groupBy(F.col("value").alias("_key")).agg(
        F.max((F.col("list") == "watch").cast("int")).alias("is_watched"),
        F.max((F.col("list") == "safe").cast("int")).alias("is_safe"),
    )
    out = values.join(flags, F.trim(F.col(column)) == F.col("_key"), "left").drop("_key")
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("is_watched", "is_safe")}
    )


def feedback_summary(verdicts: DataFrame, learned: DataFrame) -> DataFrame:
    per_list = learned.groupBy("list", "type").agg(F.count("*").alias("entries"))
    total = verdicts.agg(F.count("*").alias("total_verdicts"))
    return per_list.crossJoin(F.broadcast(total))


def training_staging(verdicts: DataFrame, incident_events: DataFrame) -> DataFrame:
    """Events of incidents with a teaching verdict, labelled by the latest one."""
    latest = (
        verdicts.withColumn("list", verdict_list(F.col("verdict")))
        .filter(F.col("list").isNotNull())
        .groupBy("incident_id")
        .agg(F.max_by("list", "seq").alias("list"))
    )
    return incident_events.join(latest, "incident_id").withColumn(
        "label", (F.col("list") == "watch").cast("int")
    ).drop("list")
