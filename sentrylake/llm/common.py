"""Helpers shared by the training-data operators.

Texts meet Python only as Arrow columns inside Spark tasks, a slice at a time.
An operator selects the columns it needs, so further columns of a table, of
any name, do not meet its own names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SLICE = 256


def texts_of(column):
    """The values of an Arrow text column as str, null as "", without holding all of them at once."""
    for start in range(0, len(column), SLICE):
        for value in column.slice(start, SLICE).to_pylist():
            yield value or ""


def struct_of(rows, kind):
    """An Arrow struct column of type `kind` from tuples."""
    columns = list(zip(*rows)) if rows else [()] * kind.num_fields
    arrays = [pa.array(c, kind.field(i).type) for i, c in enumerate(columns)]
    return pa.StructArray.from_arrays(arrays, fields=list(kind))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark, rows="1000"):
    """Send texts to Python in batches of fewer rows than Spark's default of 10,000, unless the user has set a number."""
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, rows)


def text_udf(make, kind, ddl):
    """A scalar Arrow UDF of one text column; `make()` gives, in each task, the function of one text that returns the fields of `kind`."""
    short_batches(SparkSession.active())

    @F.arrow_udf(ddl)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for column in columns:
            yield struct_of([one(t) for t in texts_of(column)], kind)

    return run


def fold_of(key, parts):
    """crc32 of the key's text modulo `parts`, 0 for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def text_key(text="text"):
    """128 bits that stand for a text (null as empty), to meet again what was computed from equal texts."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def labelled_sample(documents, labels, label, keep, max_rows, seed):
    """(doc_id, text, <label>, _order): at most `max_rows` labelled documents, chosen by a seeded hash of doc_id.

    `keep` is a condition on labels. Null ids and labels are left out, a
    doc_id with several labels takes the largest, one with several texts the
    smallest text. The chosen ids are few by `max_rows`, hence broadcast.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
        .withColumn("_order", F.xxhash64(F.col("doc_id"), F.lit(seed)))
        .orderBy("_order", "doc_id").limit(max_rows)
    )
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", label, "_order").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def train_in_one_task(sample, fit, ddl):
    """Run `fit(rows)` over a bounded sample in one task, rows in the order of their hash; returns its rows.

    `fit` gets an iterator of dicts and gives an Arrow record batch of type `ddl`, with a row at least.
    """

    def run(batches):
        yield fit(row for b in batches for s in range(0, b.num_rows, SLICE) for row in b.slice(s, SLICE).to_pylist())

    found = sample.repartition(1).sortWithinPartitions("_order", "doc_id").mapInArrow(run, ddl).collect()
    return found or fit(iter(())).to_pylist()  # an empty sample may have no task at all


MOST_BITS = 26
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x):
    """A hash of 64-bit integers (numpy)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def bits_for(table):
    """log2 of the size of a bit set for the rows of a written table: 16 to 32 bits a row, 2**26 bits (8 MB) at most."""
    return min(MOST_BITS, max(16, (16 * table.count()).bit_length()))


def bit_table(hashes, bits):
    """(word, bits): a bit set of fixed size, 2**bits, of the 64-bit `hash` column; at most 2**(bits - 6) rows."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.groupBy(F.shiftrightunsigned("hash", 70 - bits).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def with_maybe(rows, hash, table, bits):
    """`rows` with `_maybe`: false only where no hash in the table equals `hash`; broadcast, as its size is fixed by `bits`."""
    keyed = rows.withColumn("_at", F.shiftrightunsigned(hash, 64 - bits)).withColumn("_word", F.shiftrightunsigned("_at", 6))
    found = keyed.join(F.broadcast(table), "_word", "left")
    held = F.call_function("shiftright", F.col("_bits"), F.col("_at").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return found.withColumn("_maybe", F.coalesce(held, F.lit(False))).drop("_at", "_word", "_bits")
