"""Quality rules: counts of a text, and a linear-chain conditional random field over its lines.

The lines with words of a text are a sequence of content (0) and boilerplate
(1) states. Features of single lines and of neighbouring states have weights
that are trained by the gradient of the sequence likelihood (forward-backward)
on a bounded sample of labelled rows, whose lines take the label of their
document; Viterbi decoding then marks the lines of every text, and the share of
words in content lines decides.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.llm.common import labelled_sample, text_udf, train_in_one_task

SAMPLE_ROWS = 6000
EPOCHS = 4
RATE = 0.1
L2 = 1e-4
SEED = 41
CONTENT_SHARE = 0.5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
LINE_FEATURES = (
    "always", "1-2 words", "3-8 words", "9-20 words", "more words", "ends as a sentence", "pipe", "many symbols",
    "mostly capitals", "many digits", "seen before", "long words", "few distinct words", "address", "marks repeated",
)


def words_of(text):
    """Runs of characters other than ASCII white space, as UTF-8."""
    return text.encode("utf-8").split()


def repeated_words(words, window=5):
    """Words that lie in a window of `window` words found twice or more, the first included."""
    count = len(words)
    if count <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == count:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, count)
    key = ids
    for k in range(1, window):  # ranks stay below `count`, so a pair of them is exact in 64 bits
        ranks = np.unique(key, return_inverse=True)[1] if k > 1 else key
        key = ranks[: count - k] * len(number) + ids[k:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(count + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def lines_of(text):
    """(numbers of the features that hold, words) of each line with words, and how many equal an earlier line."""
    seen, out, again = set(), [], 0
    for line in text.split("\n"):
        words = words_of(line)
        if not words:
            continue
        n, size = len(words), len(line)
        on = [0, 1 if n <= 2 else 2 if n <= 8 else 3 if n <= 20 else 4]
        if line.rstrip()[-1:] in ".!?":
            on.append(5)
        if "|" in line:
            on.append(6)
        if 20 * sum(map(line.count, SYMBOLS)) > size:
            on.append(7)
        if line.isupper():
            on.append(8)
        if 4 * sum(map(line.count, "0123456789")) > size:
            on.append(9)
        if line in seen:
            on.append(10)
            again += 1
        seen.add(line)
        if size > 16 * n:
            on.append(11)
        if n >= 6 and 2 * len(set(words)) < n:
            on.append(12)
        if "http" in line or "@" in line or "www." in line:
            on.append(13)
        if "!!" in line or "***" in line or "###" in line:
            on.append(14)
        out.append((on, n))
    return out, again


def viterbi(lines, state_weights, moves):
    """The most likely states; ties go to content."""
    if not lines:
        return []
    back, best = [], None
    for on, _ in lines:
        here = [sum(w[f] for f in on) for w in state_weights]
        if best is None:
            best = here
            continue
        step = [0 if best[0] + moves[0][s] >= best[1] + moves[1][s] else 1 for s in (0, 1)]
        best = [best[step[s]] + moves[step[s]][s] + here[s] for s in (0, 1)]
        back.append(step)
    state = 0 if best[0] >= best[1] else 1
    states = [state]
    for step in reversed(back):
        state = step[state]
        states.append(state)
    return states[::-1]


def fit(rows):
    """Weights as (state, feature, weight) rows; features from 100 are moves to state feature - 100."""
    examples = [(x, 0 if r["quality"] else 1) for r in rows for x, _ in (lines_of(r["text"]),) if x]
    weights, moves = np.zeros((2, len(LINE_FEATURES))), np.zeros((2, 2))
    draw = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for k in draw.permutation(len(examples)):
            lines, label = examples[k]
            own, pairs = _marginals(lines, weights.tolist(), moves.tolist())
            scale = rate / math.sqrt(len(lines))
            for (on, _), p in zip(lines, own):
                weights[0, on] += scale * ((label == 0) - p[0])
                weights[1, on] += scale * ((label == 1) - p[1])
            truth = np.zeros((2, 2))
            truth[label, label] = len(lines) - 1
            moves += scale * (truth - pairs)
            weights *= 1 - rate * L2
            moves *= 1 - rate * L2
            np.clip(moves, -2, 2, out=moves)
    rows = [(s, f, float(weights[s, f])) for s in (0, 1) for f in range(len(LINE_FEATURES))]
    rows += [(s, 100 + t, float(moves[s, t])) for s in (0, 1) for t in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64()))],
                                      ["state", "feature", "weight"])


def _marginals(lines, weights, moves):
    """Probabilities of the states of each line, and expected counts of each move (forward-backward)."""
    e = [[math.exp(m) for m in row] for row in moves]
    own = []
    for on, _ in lines:
        gap = sum(weights[1][f] for f in on) - sum(weights[0][f] for f in on)
        p = 1 / (1 + math.exp(-min(max(gap, -30), 30)))
        own.append((1 - p, p))
    forward = [own[0]]
    for x in own[1:]:
        a, b = forward[-1]
        c, d = (a * e[0][0] + b * e[1][0]) * x[0], (a * e[0][1] + b * e[1][1]) * x[1]
        forward.append((c / (c + d), d / (c + d)))
    backward, out, pairs = (0.5, 0.5), [], np.zeros((2, 2))
    for k in range(len(own) - 1, -1, -1):
        c, d = forward[k][0] * backward[0], forward[k][1] * backward[1]
        out.append((c / (c + d), d / (c + d)))
        if k:
            a, b = forward[k - 1]
            t = [[(a, b)[i] * e[i][j] * own[k][j] * backward[j] for j in (0, 1)] for i in (0, 1)]
            whole = t[0][0] + t[0][1] + t[1][0] + t[1][1]
            pairs += np.array(t) / whole
            c = e[0][0] * own[k][0] * backward[0] + e[0][1] * own[k][1] * backward[1]
            d = e[1][0] * own[k][0] * backward[0] + e[1][1] * own[k][1] * backward[1]
            backward = (c / (c + d), d / (c + d))
    return out[::-1], pairs


def train_lines(documents, labels, max_rows=SAMPLE_ROWS):
    """(weights of the two states, weights of the moves) from labels.quality."""
    sample = labelled_sample(documents, labels, "quality", F.lit(True), max_rows, SEED)
    found = {(r["state"], r["feature"]): r["weight"] for r in train_in_one_task(sample, fit, "state int, feature int, weight double")}
    return ([[found[s, f] for f in range(len(LINE_FEATURES))] for s in (0, 1)], [[found[s, 100 + t] for t in (0, 1)] for s in (0, 1)])


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "n_lines", "n_content_lines")
_FOUND = pa.struct([*((n, pa.int64()) for n in _NAMES), ("line_states", pa.string())])


def _measure(model):
    def make():
        state_weights, moves = model

        def one(text):
            words = words_of(text)
            lines, again = lines_of(text)
            states = viterbi(lines, state_weights, moves)
            content = sum(n for (_, n), s in zip(lines, states) if s == 0)
            return (
                len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), again,
                repeated_words(words), content, len(lines), states.count(0), "".join("CB"[s] for s in states),
            )

        return one

    return make


def apply_rules(documents, model):
    """One row per document: doc_id, the counts, line_states (C or B per line with words), base_failed, kept.

    Null and empty texts have no words, fail the base rules and are not kept.
    """
    ddl = f"struct<{','.join(f'{n}:long' for n in _NAMES)},line_states:string>"
    rows = documents.select("doc_id", text_udf(_measure(model), _FOUND, ddl)("text").alias("_f")).select("doc_id", "_f.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    content = F.col("content_words") >= CONTENT_SHARE * F.col("n_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & content)


def op8(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = train_lines(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    return apply_rules(documents, model)
