"""Session settings, and the reliable storage used to cut long lineages."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="sentrylake", master=None, **conf):
    """A session with the settings the operators assume.

    Shuffle partition count is left to the cluster; adaptive execution merges
    small partitions and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="sentrylake-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table.

    The table survives lost executors, is computed exactly once, and gives the
    planner exact sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by `materialize` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        delete_folder(df.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)
