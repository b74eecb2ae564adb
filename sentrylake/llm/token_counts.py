"""Token counts by a compiled finite-state transducer.

Byte-pair encoding of a word is read left to right by a deterministic
transducer over bytes. The encoding of a prefix ends in one token; whether a
token can follow another is a property of the pair alone, so the last tokens at
the positions that a vocabulary entry can still reach back to are all that the
future depends on. A state is that: the longest suffix that begins a vocabulary
entry, with the last token and the relative count at each of its positions.
Every transition carries the change of the number of emitted tokens. States are
compiled when first met and kept up to a bound.

Words are cut where text of any kind before and after gives the same split:
before white space that follows something else. A chunk of text is summed up
as a map: the fragment before its first cut, the count between, the fragment
after its last. Maps compose associatively; the counts of a text are the
result of a scan over the maps of its chunks, in rounds of neighbouring pairs.
"""

import json
import re

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from sentrylake.llm.common import text_key, text_udf

CHUNK = 1 << 15
MAX_STATES = 200_000
MEMO = 500_000
LIMIT = 512

_SEGMENT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
# below U+0530 all versions of Unicode agree on letters and numbers
_PIECE = regex.compile(public_tokenizers.PATTERN)
_LATER = re.compile("[԰-\U0010ffff]")
_SPLIT = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def byte_alphabet():
    """Byte -> the character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Transducer:
    """Byte-level BPE as a lazily compiled transducer that counts tokens."""

    def __init__(self, vocabulary):
        spec = json.loads(vocabulary)
        self.byte_of = {c: b for b, c in byte_alphabet().items()}
        raw = lambda token: bytes(map(self.byte_of.__getitem__, token))
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.token = {raw(t): i for t, i in ids.items()}
        self.bytes = {i: t for t, i in self.token.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        # the halves of a token and the rank of the merge that makes it
        self.made = {new: (rank, *pair) for pair, (rank, new) in self.merge.items()}
        self.open = {t[:n] for t in self.token for n in range(1, len(t))} | {b""}
        self.follows = {}
        self._restart()

    def _restart(self):
        start = (b"", ((None, 0),))
        self.number, self.states, self.next = {start: 0}, [start], {}

    def merged(self, data):
        """The token ids of bytes by merging in order of rank; used on single tokens."""
        ids = [self.token[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            found = [(self.merge[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
            if not found:
                break
            (_, new), at = min(found)
            ids[at : at + 2] = [new]
        return ids

    def can_follow(self, before, token):
        """Whether the encoding of both tokens' bytes is just these two."""
        key = (before, token)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= 8 * MAX_STATES:
                self.follows.clear()
            alone = before is None
            known = self.follows[key] = self.merged(self.bytes[token]) == [token] if alone else self._apart(before, token)
        return known

    def _apart(self, left, right):
        """No merge across the border comes before those inside.

        Back in time from the finished tokens, the one made last falls apart
        and its half at the border takes its place; a merge of the two at the
        border must come after the end of either (at equal rank the left one goes first).
        """
        left_ends = right_ends = len(self.merge)
        while True:
            across = self.merge.get((left, right))
            if across and across[0] < left_ends and across[0] <= right_ends:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a and (not b or a[0] >= b[0]):
                left_ends, left = a[0], a[2]
            elif b:
                right_ends, right = b[0], b[1]
            else:
                return True

    def compile(self, state, byte):
        """The transition of a state on a byte: (next state, change of the count)."""
        suffix, history = self.states[state]
        grown = suffix + bytes((byte,))
        last = len(suffix)
        for at in range(len(grown)):
            token = self.token.get(grown[at:])
            if token is not None and history[at] and self.can_follow(history[at][0], token):
                break
        else:
            raise ValueError(f"no token ends here: {grown!r}")
        new = history[at][1] + 1
        change = new - history[last][1]
        cut = 0
        while grown[cut:] not in self.open:
            cut += 1
        # places where no longer vocabulary entry can begin are forgotten
        kept = tuple(
            (history[k][0], history[k][1] - new) if history[k] and grown[k:] in self.open else None
            for k in range(cut, len(grown)))
        reached = (grown[cut:], (*kept, (token, 0)))
        number = self.number.setdefault(reached, len(self.states))
        if number == len(self.states):
            self.states.append(reached)
        self.next[state << 8 | byte] = found = (number, change)
        return found

    def count(self, data):
        """Tokens of one word."""
        if len(self.states) > MAX_STATES:
            self._restart()
        state = total = 0
        known = self.next.get
        for byte in data:
            state, change = known(state << 8 | byte) or self.compile(state, byte)
            total += change
        return total


class SegmentCounts(dict):
    """Segment (white space, then other characters) -> tokens, remembered up to MEMO segments."""

    def __init__(self, transducer):
        self.transducer = transducer
        self.special = re.compile("|".join(map(re.escape, transducer.special))) if transducer.special else None

    def __missing__(self, segment):
        if len(self) >= MEMO:
            self.clear()
        parts = self.special.split(segment) if self.special else [segment]
        found = self[segment] = len(parts) - 1 + sum(map(self.of_words, parts))
        return found

    def of_words(self, part):
        count = self.transducer.count
        if _LATER.search(part):
            byte = self.transducer.byte_of.__getitem__
            return sum(count(bytes(map(byte, piece))) for piece, _ in _SPLIT.pre_tokenize_str(part))
        return sum(count(piece.encode()) for piece in _PIECE.findall(part))

    def of_text(self, text):
        return sum(map(self.__getitem__, _SEGMENT.findall(text)))

    def map_of(self, chunk):
        """The map of a chunk: (cut, head, count, tail); without a cut all of it is head."""
        segments = _SEGMENT.findall(chunk)
        if len(segments) < 2:
            return False, chunk, 0, ""
        return True, segments[0], sum(map(self.__getitem__, segments[1:-1])), segments[-1]

    def compose(self, a, b):
        """The map of two neighbouring stretches of text."""
        if not a[0] and not b[0]:
            return False, a[1] + b[1], 0, ""
        if not a[0]:
            return True, a[1] + b[1], b[2], b[3]
        if not b[0]:
            return True, a[1], a[2], a[3] + b[1]
        return True, a[1], a[2] + self.of_text(a[3] + b[1]) + b[2], b[3]

    def scan(self, maps):
        """Tokens of the text whose chunks have these maps: rounds of compositions of neighbours."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[k : k + 2]) for k in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0][2] + self.of_text(maps[0][1]) + self.of_text(maps[0][3])


_COUNTERS = {}


def counter_of(vocabulary):
    """The counter of a vocabulary, kept by the Python worker between tasks."""
    if vocabulary not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[vocabulary] = SegmentCounts(Transducer(vocabulary))
    return _COUNTERS[vocabulary]


_MAP = pa.struct([("cut", pa.bool_()), ("head", pa.string()), ("count", pa.int64()), ("tail", pa.string())])
_MAP_DDL = "struct<cut:boolean,head:string,count:long,tail:string>"


def count_tokens(documents, vocabulary, chunk=CHUNK):
    """One row per document: doc_id, n_bytes, n_tokens; `vocabulary` is the text of a byte-level BPE file.

    Null is empty and has no tokens; repeated rows are answered one by one.
    Special strings of the vocabulary count as one token.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    map_of = text_udf(lambda: counter_of(shared.value).map_of, _MAP, _MAP_DDL)

    @F.arrow_udf("long")
    def scan(column: pa.Array) -> pa.Array:
        counter = counter_of(shared.value)
        return pa.array([
            counter.scan([(m["map"]["cut"], m["map"]["head"], m["map"]["count"], m["map"]["tail"]) for m in maps])
            for maps in column.to_pylist()
        ], pa.int64())

    text = F.coalesce(F.col("text"), F.lit(""))
    last = F.greatest(F.floor((F.length(text) - 1) / chunk), F.lit(0)).cast("int")
    chunks = documents.select(
        "doc_id", text_key().alias("_key"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * chunk + 1, F.lit(chunk))))
        .alias("no", "_chunk"),
    )
    maps = chunks.select("doc_id", "_key", "n_bytes", F.struct("no", map_of("_chunk").alias("map")).alias("_map"))
    # copies of a row give the same maps: a set holds them once, the first chunks tell how many copies there are
    texts = maps.groupBy("doc_id", "_key").agg(
        F.max("n_bytes").alias("n_bytes"), F.array_sort(F.collect_set("_map")).alias("_maps"),
        F.count_if(F.col("_map.no") == 0).alias("_copies"),
    )
    counted = texts.select("doc_id", "n_bytes", scan("_maps").alias("n_tokens"), "_copies")
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        "doc_id", "n_bytes", "n_tokens")


def read_vocabulary(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1(spark, folder):
    counted = count_tokens(spark.read.parquet(f"{folder}/documents.parquet"), read_vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
