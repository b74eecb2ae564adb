"""From external records to canonical events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import number_rows
from sentrylake.functions.text import detail_number, present
from sentrylake.operators.explore import day_of, hour_of
from sentrylake.sources.readers import infer_from_row

TEXT_COLUMNS = [c for c in V.EVENT_COLUMNS if c not in ("timestamp", "is_redteam")]


def column_plan(columns):
    """{external name: canonical name}; the first column of a target wins."""
    plan = {}
    for c in columns:
        target = V.COLUMN_SYNONYMS.get(c.strip().lower().replace(" ", "_").replace("-", "_"))
        if target and target not in plan.values():
            plan[c] = target
    return plan


def map_column_synonyms(rows: DataFrame) -> DataFrame:
    """Rename known columns, keep the others, add absent canonical ones as empty.

    A column that already carries a canonical name but lost to an earlier
    synonym is dropped with its target taken.
    """
    plan = column_plan(rows.columns)
    taken = set(plan.values())
    kept = [
        F.col(f"`{c}`").alias(plan.get(c, c)) for c in rows.columns if c in plan or c not in taken
    ]
    missing = [
        (F.lit(0) if c == "is_redteam" else F.lit("")).alias(c)
        for c in V.EVENT_COLUMNS
        if c not in taken and c not in rows.columns
    ]
    return rows.select(*kept, *missing)


def fold_unmapped_columns(rows: DataFrame) -> DataFrame:
    """Append the other non-empty columns to `details` as ` | name=value`."""
    extra = [c for c in rows.columns if c not in V.EVENT_COLUMNS]
    if not extra:
        return rows
    text = lambda c: F.col(f"`{c}`").cast("string")
    filled = lambda c: (F.trim(text(c)) != "") & (F.lower(F.trim(text(c))) != "nan")
    items = [F.when(filled(c), F.concat(F.lit(f"{c}="), text(c))) for c in extra]
    base = F.coalesce(F.col("details"), F.lit(""))
    tail = F.concat_ws(" | ", *items)
    joined = F.btrim(F.concat(base, F.lit(" | "), tail), F.lit(" |"))
    return rows.withColumn("details", F.when(tail != "", joined).otherwise(base)).drop(*extra)


def infer_event_type(rows: DataFrame) -> DataFrame:
    """Fill event_type from the whole row, only when no row states one."""
    stated = rows.agg(F.count_if(F.trim(F.col("event_type")) != "").alias("_stated"))
    values = [F.col(c).cast("string") for c in V.EVENT_COLUMNS if c in rows.columns]
    return (
        rows.crossJoin(F.broadcast(stated))
        .withColumn(
            "event_type",
            F.when(F.col("_stated") == 0, infer_from_row(values)).otherwise(F.col("event_type")),
        )
        .drop("_stated")
    )


def layout_time(text, layout):
    """Epoch seconds of `text` under one layout, else null."""
    pattern, shape, prefix, suffix = layout
    clean = F.regexp_replace(text, r"\s+", " ")
    parsed = F.try_to_timestamp(F.concat(F.lit(prefix), clean, F.lit(suffix)), F.lit(pattern))
    return F.when(clean.rlike(shape), F.unix_timestamp(parsed))


def general_time(text):
    """Epoch seconds of any text that some layout or Spark itself can read; UTC without a zone."""
    clock = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit(" UTC")))
    other = F.when(text.contains(":"), F.unix_timestamp(clock.try_cast("timestamp"))).otherwise(
        F.unix_date(text.try_cast("date")) * V.DAY_SECONDS
    )
    return F.coalesce(*[layout_time(text, l) for l in V.TIMESTAMP_LAYOUTS], other)


def normalize_timestamps(rows: DataFrame) -> DataFrame:
    """Epoch seconds in `timestamp`; failures are 0.

    One aggregate decides for the whole table: numeric when more than 80 % of
    the rows are numbers (milliseconds or microseconds by the median), else
    the first layout that fits at least 70 % of the texts present. The
    decision is a single row, joined back. The session time zone does not matter.
    """
    text = F.trim(F.col("timestamp").cast("string"))
    number = text.try_cast("double")
    given = F.when(text != "", text)
    fits = [F.count_if(layout_time(given, l).isNotNull()).alias(f"_f{i}") for i, l in enumerate(V.TIMESTAMP_LAYOUTS)]
    facts = rows.agg(
        F.count("*").alias("_n"),
        F.count(number).alias("_numbers"),
        F.percentile_approx(number, 0.5).alias("_median"),
        F.count(given).alias("_given"),
        *fits,
    )
    chosen = F.coalesce(
        *[
            F.when((F.col("_given") > 0) & (F.col(f"_f{i}") >= F.col("_given") * V.LAYOUT_SHARE), i)
            for i in range(len(V.TIMESTAMP_LAYOUTS))
        ],
        F.lit(-1),
    )
    choice = facts.select(
        (F.col("_numbers") > F.col("_n") * V.NUMERIC_SHARE).alias("_numeric"),
        F.when(F.col("_median") > V.MICROS_ABOVE, 1e6)
        .when(F.col("_median") > V.MILLIS_ABOVE, 1e3)
        .otherwise(1.0).alias("_unit"),
        chosen.alias("_layout"),
    )
    parsed = F.coalesce(
        *[F.when(F.col("_layout") == i, layout_time(text, l)) for i, l in enumerate(V.TIMESTAMP_LAYOUTS)],
        F.when(F.col("_layout") == -1, general_time(text)),
    )
    value = F.when(F.col("_numeric"), (number / F.col("_unit")).cast("bigint")).otherwise(parsed)
    return (
        rows.crossJoin(F.broadcast(choice))
        .withColumn("timestamp", F.coalesce(value, F.lit(0)).cast("bigint"))
        .drop("_numeric", "_unit", "_layout")
    )


def validate_schema(rows: DataFrame, required=V.EVENT_COLUMNS) -> DataFrame:
    """The rows unchanged; raises while planning when a required column is absent."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return rows


def normalize_events(rows: DataFrame) -> DataFrame:
    """Trimmed canonical events with day columns and typed flow measures.

    Absent text is null, user falls back to source_user, rows without a whole
    timestamp are dropped, the label is 0/1.
    """
    validate_schema(rows)
    extra = [c for c in rows.columns if c not in V.EVENT_COLUMNS]
    second = F.pmod("timestamp", F.lit(V.DAY_SECONDS)).cast("bigint")
    return (
        rows.select(
            *extra,
            *[present(F.col(c).cast("string")).alias(c) for c in TEXT_COLUMNS],
            F.col("timestamp").try_cast("double").cast("bigint").alias("timestamp"),
            F.coalesce(F.col("is_redteam").try_cast("int"), F.lit(0)).alias("is_redteam"),
        )
        .filter(F.col("timestamp").isNotNull())
        .withColumns(
            {
                "user": F.coalesce("user", "source_user"),
                "day": day_of(),
                "time_in_day_sec": second,
                "hour_of_day": hour_of(),
                "bytes": F.when(F.col("event_type") == "flow", detail_number(F.col("details"), "bytes")),
                "duration": F.when(F.col("event_type") == "flow", detail_number(F.col("details"), "duration")),
            }
        )
    )


def assign_event_id(rows: DataFrame, tie_break) -> DataFrame:
    """`EVT-0000001`... by (timestamp, event_type, tie_break)."""
    order = [F.col("timestamp"), F.col("event_type"), *[F.col(c) for c in tie_break]]
    return number_rows(rows, order, "_no").withColumn(
        "event_id", F.format_string("EVT-%07d", "_no")
    ).drop("_no")


def strip_annotations(rows: DataFrame, keep_rows=False) -> DataFrame:
    """Drop label rows, or keep them with label-derived text blanked; zero the label."""
    is_label = F.lower("event_type") == "redteam"
    out = rows if keep_rows else rows.filter(~is_label)
    return out.withColumns(
        {
            "action": F.when(is_label, "LogOn").otherwise(F.col("action")),
            "details": F.when(is_label, "").otherwise(F.col("details")),
            "is_redteam": F.lit(0),
        }
    )


def parse_records(rows: DataFrame) -> DataFrame:
    """External records of any reader to canonical columns with epoch seconds."""
    mapped = infer_event_type(fold_unmapped_columns(map_column_synonyms(rows)))
    return normalize_timestamps(mapped).select(*V.EVENT_COLUMNS)
