"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the whole has a label. Each
sentence gets a probability p from the sum of the weights of its distinct
words and of their beginnings (stems with changing ends); the document's score is the noisy-or 1 - prod(1 - p). The likelihood of
the document labels is raised by adaptive gradient steps with an L1 penalty,
so that weight gathers on the words whose presence in a single sentence
explains a label, and the trained sentence scores locate the offence.

Training takes a bounded sample of labelled rows (`SAMPLE_ROWS`, of whole
texts) in one task; scoring reads every text where it lies.
"""

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.llm.common import fold_of, labelled_sample, text_udf, train_in_one_task

SAMPLE_ROWS = 12000
MIN_DOCUMENTS = 3
STEMS = (5, 7)
EPOCHS = 15
BATCH = 64
RATE = 1.0
MEMO = 200_000
L1 = 2e-4
SEED = 17
FOLDS = 5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences_of(text):
    """(start, end) of the sentences of a text, ended by . ! ? or a line end."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def words_of(sentence):
    return set(_WORD.findall(sentence.lower()))


def features_of(word):
    """A word and its beginnings, the latter marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def fit(rows):
    """Features and weights, the first entry ("") being the bias, from rows with text and toxic."""
    vocabulary, seen, last = {}, [], []
    words, sentence_ends, document_ends, labels = array("i"), array("q"), array("q"), []
    for document, row in enumerate(rows):
        for start, end in sentences_of(row["text"]):
            found = words_of(row["text"][start:end])
            if not found:
                continue
            for feature in (f for word in found for f in features_of(word)):
                number = vocabulary.setdefault(feature, len(vocabulary))
                if number == len(seen):
                    seen.append(0)
                    last.append(-1)
                if last[number] != document:
                    last[number] = document
                    seen[number] += 1
                words.append(number)
            sentence_ends.append(len(words))
        document_ends.append(len(sentence_ends))
        labels.append(row["toxic"])
    # words of few documents get no weight: all map to one cell that stays 0
    usual = np.array(seen, dtype=np.int64) >= MIN_DOCUMENTS
    cell = np.where(usual, np.cumsum(usual), 0) if len(seen) else np.zeros(0, np.int64)
    size = int(usual.sum()) + 1
    words = cell.astype(np.int32)[np.frombuffer(words, np.int32)] if words else np.zeros(0, np.int32)
    ends = lambda x: np.concatenate([[0], np.array(x, np.int64)])
    weights, bias = _ascend(words, ends(sentence_ends), ends(document_ends), np.array(labels, dtype=np.float64), size)
    names = [w for w, k in vocabulary.items() if usual[k] and weights[cell[k]] != 0]
    return pa.RecordBatch.from_pydict({
        "word": pa.array(["", *names], pa.string()),
        "weight": pa.array([bias, *(float(weights[cell[vocabulary[w]]]) for w in names)], pa.float64()),
    })


def _ascend(words, sentences, documents, labels, size):
    weights, squares = np.zeros(size), np.full(size, 1e-8)
    share = min(max(labels.mean(), 0.01), 0.99) if len(labels) else 0.5
    per_document = max(1.0, np.diff(documents).mean()) if len(labels) else 1.0
    bias, bias_squares = math.log(share / (1 - share) / per_document), 1e-8
    draw = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            batch = batch[documents[batch] < documents[batch + 1]]
            if not len(batch):
                continue
            rows = _ranges(documents[batch], documents[batch + 1])
            bags = np.repeat(np.arange(len(batch)), documents[batch + 1] - documents[batch])
            features = words[_ranges(sentences[rows], sentences[rows + 1])]
            owner = np.repeat(np.arange(len(rows)), sentences[rows + 1] - sentences[rows])
            logit = np.clip(np.bincount(owner, weights[features], len(rows)) + bias, -30, 30)
            p = 1 / (1 + np.exp(-logit))
            clean = np.exp(np.bincount(bags, np.log1p(-p), len(batch)))
            y = labels[batch][bags]
            slope = np.where(y > 0, p * (clean / np.maximum(1 - clean, 1e-9))[bags], -p)
            touched, place = np.unique(features, return_inverse=True)
            gradient = np.bincount(place, slope[owner], len(touched)) / len(batch)
            squares[touched] += gradient**2
            rate = RATE / np.sqrt(squares[touched])
            moved = weights[touched] + rate * gradient
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)
            weights[0] = 0
            step = slope.sum() / len(batch)
            bias_squares += step**2
            bias += RATE / math.sqrt(bias_squares) * step
    return weights, bias


def _ranges(starts, ends):
    """Concatenation of the ranges start..end."""
    sizes = ends - starts
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def train_toxicity(documents, labels, keep=None, max_rows=SAMPLE_ROWS):
    """{word: weight} with the bias under "", from the labels that meet `keep` (a condition on doc_id; default all)."""
    sample = labelled_sample(documents, labels, "toxic", F.lit(True) if keep is None else keep, max_rows, SEED)
    return {r["word"]: r["weight"] for r in train_in_one_task(sample, fit, "word string, weight double")}


_SCORE = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
_SCORE_DDL = "struct<score:double,offending:array<struct<start:int,end:int,score:double>>>"


class WordWeights(dict):
    """Word -> sum of the weights of its features, remembered up to MEMO words."""

    def __init__(self, model):
        self.model = {w: x for w, x in model.items() if w}

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = sum(self.model.get(f, 0.0) for f in features_of(word))
        return found


def toxicity_of(model):
    """A UDF: text -> (score, offending sentences with p >= 0.5 as code point ranges)."""

    def make():
        bias = model[""]
        weight = WordWeights(model).__getitem__
        silent = math.log1p(-1 / (1 + math.exp(-bias)))

        def one(text):
            lowered = text.lower()
            if len(lowered) != len(text):  # a few characters grow in lower case; offsets stay those of the text
                lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
            total, found = 0.0, []
            for m in _SENTENCE.finditer(lowered):
                words = _WORD.findall(m[0])
                if not words:
                    continue
                known = [x for x in map(weight, set(words)) if x]
                if not known:
                    continue
                logit = min(max(bias + math.fsum(known), -30), 30)
                p = 1 / (1 + math.exp(-logit))
                # what a sentence adds to one without known words, so that length alone makes no text toxic
                total += min(0.0, math.log1p(-p) - silent)
                if p >= 0.5:
                    found.append({"start": m.start(), "end": m.end(), "score": p})
            return -math.expm1(total), found

        return one

    return text_udf(make, _SCORE, _SCORE_DDL)


def score_toxicity(documents, model):
    """One row per document: doc_id, score, predicted, offending.

    A text without words (null, empty), or without any word that has a weight,
    has score 0 at any length. Repeated rows are scored one by one.
    """
    scored = documents.select("doc_id", toxicity_of(model)("text").alias("_s"))
    return scored.select(
        "doc_id", F.col("_s.score").alias("score"), (F.col("_s.score") >= 0.5).cast("int").alias("predicted"),
        F.col("_s.offending").alias("offending"),
    )


def drop_toxic(documents, labels):
    """The documents, with all their columns, that a model of the labels outside the held-out fold does not call toxic."""
    model = train_toxicity(documents, labels, fold_of("doc_id", FOLDS) != 0)
    return documents.filter(toxicity_of(model)("text")["score"] < 0.5)


def op4(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = train_toxicity(documents, labels, fold_of("doc_id", FOLDS) != 0)
    return score_toxicity(documents, model).withColumn("held_out", fold_of("doc_id", FOLDS) == 0)
