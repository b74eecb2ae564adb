"""Threat list files as (indicator, type) rows for `build_iocs`."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_iocs_csv(spark: SparkSession, path) -> DataFrame:
    """CSV with column synonyms; without a known column the first one holds indicators."""
    raw = spark.read.option("header", True).csv(path)
    by_name = {c.lower().strip(): c for c in raw.columns}
    pick = lambda names: [F.col(f"`{by_name[n]}`") for n in names if n in by_name]
    filled = lambda cols: F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols], F.lit(None).cast("string"))
    values = pick(["indicator", "value", "ioc"]) + [F.col(f"`{raw.columns[0]}`")]
    return raw.select(
        filled(values).alias("indicator"), filled(pick(["type", "indicator_type", "ioc_type"])).alias("type")
    ).filter(F.col("indicator").isNotNull())


def load_iocs_json(spark: SparkSession, path) -> DataFrame:
    """Each file is a JSON map of lists or a list of objects."""
    return parse_iocs_json(spark.read.text(path, wholetext=True))


def parse_iocs_json(texts: DataFrame) -> DataFrame:
    """One JSON document per row: a map of lists, or a list of objects.

    The type name of a map entry is its key; plural keys are type synonyms.
    """
    text = texts.select(F.trim("value").alias("t"))
    maps = (
        text.filter(F.col("t").startswith("{"))
        .select(F.explode(F.from_json("t", "map<string,array<string>>")).alias("type", "values"))
        .select(F.explode("values").alias("indicator"), "type")
    )
    entry = "array<struct<indicator: string, value: string, type: string, indicator_type: string>>"
    objects = text.filter(F.col("t").startswith("[")).select(F.explode(F.from_json("t", entry)).alias("o")).select(
        F.coalesce("o.indicator", "o.value").alias("indicator"),
        F.coalesce("o.type", "o.indicator_type", F.lit("unknown")).alias("type"),
    )
    return maps.unionByName(objects).filter(F.col("indicator").isNotNull())
