"""Quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words, numbers and runs of punctuation are hashed one by one and in pairs into
2**BITS cells; a text is the sparse vector of their counts over the root of
their number, and its score the logistic of a dot product. Training takes a
bounded sample of labelled rows (`SAMPLE_ROWS`) in one task, sequentially, as
the method asks; scoring reads every text where it lies.
"""

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.llm.common import fold_of, labelled_sample, text_udf, train_in_one_task

BITS = 18
SAMPLE_ROWS = 12000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.5
SEED = 29
FOLDS, HELD_OUT = 3, 1
MEMO = 400_000

_MASK = (1 << BITS) - 1
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")


class Hashes(dict):
    """Word -> hash, remembered up to MEMO words."""

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = crc32(word.encode("utf-8", "replace")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF
        return found


def cells_of(text, hashes):
    """Cells of all single words and neighbouring pairs of a text; a word met again one or two places later is a pair of its own kind."""
    words = _WORD.findall(text)
    single = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
    pairs = (single[:-1] * 31 + single[1:] * 17) ^ (single[1:] >> 20)
    pairs[single[1:] == single[:-1]] = 1 << 9
    again = np.count_nonzero(single[2:] == single[:-2])
    return np.concatenate([single >> 12, pairs >> 9, np.full(again, 2)]) & _MASK


def fit(rows):
    """The non-zero weights as (cell, weight) rows; cell -1 is the bias."""
    hashes = Hashes()
    examples = []
    for row in rows:
        cells, counts = np.unique(cells_of(row["text"], hashes), return_counts=True)
        examples.append((cells.astype(np.int32), (counts / math.sqrt(max(1, counts.sum()))).astype(np.float32), row["quality"]))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    draw = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in draw.permutation(len(examples)):
            cells, values, label = examples[k]
            w, bias = _weights(z[cells], n[cells]), _bias(bias_z, bias_n)
            g = _logistic(float(values @ w) + bias) - label
            gradient = g * values
            squares = gradient * gradient
            z[cells] += gradient - (np.sqrt(n[cells] + squares) - np.sqrt(n[cells])) / ALPHA * w
            n[cells] += squares
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    weights = _weights(z, n)
    used = np.flatnonzero(weights)
    return pa.RecordBatch.from_pydict({
        "cell": pa.array([-1, *used.tolist()], pa.int32()),
        "weight": pa.array([_bias(bias_z, bias_n), *weights[used].tolist()], pa.float64()),
    })


def _weights(z, n):
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _bias(z, n):
    return -z / ((BETA + math.sqrt(n)) / ALPHA)


def _logistic(x):
    return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def train_quality(documents, labels, keep=None, max_rows=SAMPLE_ROWS):
    """(bias, weights by cell), from the labels that meet `keep` (a condition on doc_id; default all)."""
    sample = labelled_sample(documents, labels, "quality", F.lit(True) if keep is None else keep, max_rows, SEED)
    found = {r["cell"]: r["weight"] for r in train_in_one_task(sample, fit, "cell int, weight double")}
    weights = np.zeros(1 << BITS, dtype=np.float32)
    bias = found.pop(-1)
    weights[list(found)] = list(found.values())
    return bias, weights


def quality_of(model):
    """A UDF: text -> score."""
    bias, weights = model

    def make():
        hashes = Hashes()

        def one(text):
            cells = cells_of(text, hashes)
            return (_logistic(float(weights[cells].sum(dtype=np.float64)) / math.sqrt(max(1, len(cells))) + bias),)

        return one

    return text_udf(make, pa.struct([("score", pa.float64())]), "struct<score:double>")


def score_quality(documents, model):
    """One row per document: doc_id, score, predicted. A text without words (null, empty) has the score of the bias."""
    scored = documents.select("doc_id", quality_of(model)("text")["score"].alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = train_quality(documents, labels, fold_of("doc_id", FOLDS) != HELD_OUT)
    return score_quality(documents, model).withColumn("held_out", fold_of("doc_id", FOLDS) == HELD_OUT)
