"""Runs, sinks and tables of micro-batch pipelines."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.session import checkpoint_root, delete_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_large_state(spark: SparkSession) -> None:
    """State in RocksDB: on disk, with incremental checkpoints; custom state needs it."""
    spark.conf.set(PROVIDER, ROCKSDB)


def new_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, handle=None, root=None, mode="append", progress=None) -> str:
    """Process all available input and stop. Returns the output folder.

    Without `handle` rows go to Parquet files (exactly once); with it, each
    micro-batch is passed to handle(batch, epoch). A list given as `progress`
    gets the reports of the batches.
    """
    root = root or new_root(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
    if handle is None:
        query = writer.outputMode(mode).format("parquet").start(f"{root}/rows")
    else:
        query = writer.outputMode(mode).foreachBatch(handle).start()
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return root


def folder_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet files of a folder, made if absent, and all that are added to it."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


class Heartbeat:
    """Rows that hold a time and nothing else, to end a stream.

    Append mode gives a result once the watermark has passed it. A beat behind
    the last event lets the watermark pass all of them, and state empties.
    """

    def __init__(self, root: str, schema, ts="timestamp"):
        self.path, self.ts = f"{root}/beats", ts
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])  # all may be null

    def stream(self, spark: SparkSession) -> DataFrame:
        return folder_stream(spark, self.path, self.schema)

    def beat(self, spark: SparkSession, at: int) -> None:
        row = spark.createDataFrame([{self.ts: at}], self.schema)
        row.write.mode("append").parquet(self.path)


def run_to_end(make, source: DataFrame, root: str, after: int, progress=None) -> DataFrame:
    """All rows that `make(stream)` gives for a source in append mode, read back.

    Runs three times over one checkpoint: what is there, then two beats at
    `after`, a time beyond all events by more than any lateness: the first moves
    the watermark, the second is a batch that works with it.
    """
    spark = source.sparkSession
    pulse = Heartbeat(root, source.schema)
    out = make(source.unionByName(pulse.stream(spark)))
    run_available(out, root=root, progress=progress)
    for _ in range(2):
        pulse.beat(spark, after)
        run_available(out, root=root, progress=progress)
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def upserts(root: str):
    """A foreachBatch handler that keeps every epoch's changed rows."""

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{root}/rows/epoch={epoch}")

    return write


def latest_rows(spark: SparkSession, root: str, keys, folder="rows") -> DataFrame:
    """Per key, the row of the last epoch that changed it."""
    rows = spark.read.parquet(f"{root}/{folder}")
    rest = [c for c in rows.columns if c not in keys and c != "epoch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")


class EpochTable:
    """A small table that each epoch replaces: written under its epoch, read by the next one.

    A replayed epoch reads the same rows and writes the same folder. Older
    epochs cannot be replayed any more, so their folders are deleted.
    """

    def __init__(self, root: str, schema):
        self.root, self.schema = root, schema

    def _path(self, epoch):
        return f"{self.root}/epoch={epoch}"

    def before(self, spark: SparkSession, epoch: int) -> DataFrame:
        """What the epoch before left; empty at the start."""
        if epoch == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self._path(epoch - 1))

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(epoch))
        if epoch > 1:
            delete_folder(df.sparkSession, self._path(epoch - 2))

    def at(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self._path(epoch))
