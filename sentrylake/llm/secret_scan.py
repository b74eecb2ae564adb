"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

A candidate is a long run of token characters with letters and digits that
follows a sensitive word. Its novelty is what it adds to the compressed size
of the text before it, per character, under a compressor primed with a
dictionary of common identifiers: a repeated or guessable string adds little,
a random one nearly its entropy. Candidates above `NOVELTY` that no pattern
found, and their repetitions, are reported as spans of kind "novel".
"""

import hashlib
import re

import pyarrow as pa
import zstandard

from sentrylake.llm.common import text_udf

NOVELTY = 0.6
NEAR = 64
AROUND = 512
KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# maximal runs: the length can stand in the pattern without moving a match
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_SENSITIVE = re.compile(
    r"(?ai:(?<![a-z])(?:passw(?:or)?d|passphrase|pwd|secret|token|api[ _-]?key|key|auth|authorization|bearer|"
    r"credentials?|private|cookie|session|signature|access)(?![a-z]))")
#: identifiers and framings that code and configuration repeat
_IDENTIFIERS = (
    "id name value type path file user host port url http https www com org net api key token secret password config "
    "client server session cookie header content-type application/json authorization bearer basic sha256 md5 uuid "
    "public private static final return import from class def function const let var string int long bool true false "
    "null none begin end certificate request response error warning debug info version release build index "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ deadbeef 00000000 ffffffff 12345678 "
    "example test sample placeholder changeme your_token_here xxxxxxxxxxxxxxxx"
)


def base_spans(text):
    """(start, kind number, end) of the fixed patterns, sorted; offsets in code points."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes per character of a candidate in its surroundings."""

    def __init__(self):
        primed = zstandard.ZstdCompressionDict(_IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = lambda data, z=zstandard.ZstdCompressor(level=3, dict_data=primed): len(z.compress(data))

    def of(self, text, start, end):
        before, candidate = text[max(0, start - AROUND) : start].encode(), text[start:end].encode()
        return (self.size(before + candidate) - self.size(before)) / len(candidate)


def novel_spans(text, known, novelty):
    """Candidates after a sensitive word, apart from the `known` spans, that hardly compress."""
    found, novel, at, stop = [], set(), 0, -1
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(known) and known[at][0] < end:
            stop = max(stop, known[at][2])
            at += 1
        token = m[0]
        if start < stop or token.isalpha() or token.isdigit():
            continue
        if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
            continue
        if _SENSITIVE.search(text, max(0, start - NEAR), start) and (token in novel or novelty.of(text, start, end) >= NOVELTY):
            novel.add(token)
            found.append((start, 3, end))
    return found


def written(spans):
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_FOUND = pa.struct([
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan():
    novelty = Novelty()

    def one(text):
        base = base_spans(text)
        spans = sorted(base + novel_spans(text, base, novelty))
        counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
        return *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)

    return one


def scan_secrets(documents):
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Null and empty texts have none.

    `spans` lists kind:start:end of all findings by start, then kind, in code points, end exclusive.
    """
    udf = text_udf(_scan, _FOUND, "struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string>")
    return documents.select("doc_id", udf("text").alias("_f")).select("doc_id", "_f.*")


def op7(spark, folder):
    return scan_secrets(spark.read.parquet(f"{folder}/documents.parquet"))
