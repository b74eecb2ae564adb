"""Suffix-array removal of repeated passages.

A byte goes when a string of `length` bytes that covers it also starts earlier:
in a document before, or earlier in the same one. Equal strings must meet in one
task, though no task may hold the corpus, so texts are cut where their content
says: each string of `length` bytes belongs to its least 32-byte gram by hash,
and neighbours that share that gram are one segment, at most 2 * length - 32
bytes long. Equal strings have equal grams. Grams that occur once need no more
work. Of equal segments, told by 128 bits of hash, the first stands for all.
Different segments of one gram can only share a string if the 32 bytes before
the gram or the 32 after it agree too; of those that pass, the bytes are fetched
and sorted as a generalised suffix array.

Sorting takes two stages. Only suffixes smaller than their successors are
compared with each other, by first character and then up to `length` bytes; the
others are induced by scanning the buckets of first characters in order: a
suffix's predecessor, where it is greater, is the next free place of its own
bucket. Common prefixes of neighbours in that order give the equal strings.

Order of documents: doc_id, null last; rows that share a doc_id follow the hash
of their texts, and rows that are equal in both are one document, answered
alike. Null texts are empty. Texts below `length` bytes lose nothing.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentrylake.llm.common import bit_table, bits_for, mixed, short_batches, text_key, with_maybe
from sentrylake.session import discard, materialize

LENGTH = 100
GRAM = 32
CHUNK = 1 << 15  # what is hashed at a time stays in the processor's cache
BLOCK = 1 << 20
HOT = 20_000  # different segments of one gram beyond which their strings meet by hash instead of in one block
LAST = (1 << 63) - 1

_PLACE = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15
_FIELDS = {"hash": np.int64, "start": np.int64, "n": np.int32, "same": np.int64, "before": np.int64, "after": np.int64}
_KINDS = ["hash:long", "start:long", "n:int", "same:long", "before:long", "after:long"]


def gram_hashes(data):
    """Hashes of every GRAM and every 2 * GRAM consecutive bytes, doubling the width of what is hashed."""
    found, factor, width = data.astype(np.uint64) + np.uint64(1), _ODD, 1
    while width < GRAM:
        found = found[:-width] * np.uint64(factor) + found[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return mixed(found), found[:-width] * np.uint64(factor) + found[width:]


def anchor_runs(data, ends, length=LENGTH):
    """The segments of joined pieces that end at `ends`, as arrays of _FIELDS: n strings from `start` share their least gram, of this hash.

    `same` is a hash of the segment, `before` and `after` of the gram with the GRAM bytes before or after it.
    """
    if len(data) < length:
        return [np.zeros(0, t) for t in _FIELDS.values()]
    hashes, wide = gram_hashes(data)
    # the leftmost least gram of every string; 40 bits of the hash decide, then the place
    least, width, reach = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), 1, length - GRAM + 1
    while 2 * width <= reach:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < reach:
        least = np.minimum(least[: len(least) - reach + width], least[reach - width :])
    ends = np.asarray(ends)
    end_of = np.repeat(ends, np.diff(ends, prepend=0))[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + length <= end_of)  # strings that cross no end
    least = least[inside]
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(least)), bool), least[1:] != least[:-1])))
    anchor = (least[cut] & _PLACE).astype(np.int64)
    start, n = inside[cut], np.diff(cut, append=len(least))
    raw = data.tobytes()
    same = [xxh64_intdigest(raw[a:z]) for a, z in zip(start.tolist(), (start + n + (length - 1)).tolist())]
    # beyond the ends these mean nothing, and no string reaches there
    before, after = wide[np.maximum(anchor - GRAM, 0)], wide[np.minimum(anchor, len(wide) - 1)] + np.uint64(1)
    return [hashes[anchor].astype(np.int64), start, n, np.array(same, np.uint64).astype(np.int64), before.astype(np.int64), after.astype(np.int64)]


def _pieces(column, length, chunk):
    """Lists of (row, offset in the text, bytes) of about `chunk` bytes; a long text is cut, with the overlap that its strings need."""
    found, size = [], 0
    for row, text in enumerate(column):
        data = memoryview(text.as_buffer())
        for start in range(0, max(1, len(data) - length + 1), chunk):
            piece = data[start : start + chunk + length - 1]
            found.append((row, start, piece))
            size += len(piece)
            if size >= chunk:
                yield found
                found, size = [], 0
    if found:
        yield found


def anchors(docs, length=LENGTH, chunk=CHUNK, fields=tuple(_FIELDS)):
    """(doc, tie, runs): the segments of every text of (doc, tie, text as binary), an array of structs of `fields`."""
    at = [list(_FIELDS).index(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, parts = np.zeros(batch.num_rows, np.int64), []
            for pieces in _pieces(batch.column(2), length, chunk):
                ends = np.cumsum([len(p) for _, _, p in pieces])
                found = anchor_runs(np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8), ends, length)
                piece = np.searchsorted(ends, found[1], "right")
                found[1] = found[1] + (np.array([offset for _, offset, _ in pieces]) - (ends - [len(p) for _, _, p in pieces]))[piece]
                parts.append([found[k] for k in at])
                sizes += np.bincount(np.array([row for row, _, _ in pieces])[piece], minlength=batch.num_rows)
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [()] * len(at)
            arrays = [pa.array(np.asarray(c, _FIELDS[f])) for c, f in zip(columns, fields)]
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, list(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), runs], ["doc", "tie", "runs"])

    short_batches(docs.sparkSession)
    kind = ",".join(_KINDS[k] for k in at)
    return docs.select("doc", "tie", "text").mapInArrow(run, f"doc long, tie long, runs array<struct<{kind}>>")


def suffix_order(text, depth=LENGTH):
    """The suffixes of `text` (uint8, 0 ends a segment and the whole) in the order of their first `depth` characters, two-stage sorted."""
    change = np.flatnonzero(text[1:] != text[:-1])
    if not len(change):
        return np.arange(len(text))
    # a suffix compares with its successor as the first two characters that differ
    at = change[np.minimum(np.searchsorted(change, np.arange(len(text))), len(change) - 1)]
    ends = text == 0
    small = (text[at + 1] > text[at]) & ~ends
    large = ~small & ~ends
    width = -(-depth // 8) * 8
    strings = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(width, np.uint8))), width)
    small = np.flatnonzero(small)
    first = text[small]
    small = small[np.argsort(first, kind="stable")]
    bounds = np.searchsorted(np.sort(first), np.arange(257))
    waiting = [[] for _ in range(256)]

    def induce(bucket, char):
        """Put the greater predecessors of a finished bucket in line for their own, later buckets."""
        before = bucket[bucket > 0] - 1
        before = before[large[before] & (text[before] > char)]
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(chars)), bool), chars[1:] != chars[:-1])))
        for part, c in zip(np.split(before[order], cuts[1:]), chars[cuts]):
            waiting[c].append(part)

    done = [np.flatnonzero(ends)]
    induce(done[0], 0)
    for char in range(1, 256):
        wave = np.concatenate(waiting[char]) if waiting[char] else np.zeros(0, np.int64)
        bucket = []
        while len(wave):  # predecessors in the same bucket: runs of one character
            bucket.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == char) & large[wave]]
        direct = small[bounds[char] : bounds[char + 1]]
        if len(direct):
            keys = np.ascontiguousarray(strings[direct]).view(f"S{width}").ravel()
            bucket.append(direct[np.argsort(keys, kind="stable")])
        if bucket:
            bucket = np.concatenate(bucket)
            done.append(bucket)
            induce(bucket, char)
    return np.concatenate(done)


def _common(text, order, length):
    """Whether each suffix of `order` has a common prefix of `length` or more with the one before it."""
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    found = np.zeros(len(order), bool)
    for start in range(1, len(order), 1 << 16):
        a, b = order[start - 1 : start - 1 + (1 << 16)], order[start : start + (1 << 16)]
        a = a[: len(b)]
        found[start : start + len(b)] = (strings[a] == strings[b]).all(axis=1)
    return found


def repeats_in(segments, doc, tie, start, length=LENGTH):
    """(doc, tie, begin, end) of what goes: runs of strings of the segments that also occur earlier in (doc, tie, start)."""
    sizes = np.array([len(s) + 1 for s in segments])
    ends = np.cumsum(sizes)
    text = np.zeros(ends[-1], np.uint8)
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text[:] = raw + np.uint8(1)  # no byte of UTF-8 is 255
    text[ends - 1] = 0
    order = suffix_order(text, length)
    segment = np.repeat(np.arange(len(segments)), sizes)
    order = order[ends[segment[order]] - 1 - order >= length]
    if not len(order):
        return [np.zeros(0, np.int64)] * 4
    group = np.cumsum(~_common(text, order, length))
    owner = segment[order]
    place = start[owner] + order - (ends - sizes)[owner]
    ranked = np.lexsort((place, tie[owner], doc[owner], group))
    later = ranked[1:][group[ranked[1:]] == group[ranked[:-1]]]
    gone = np.sort(order[later])
    if not len(gone):
        return [np.zeros(0, np.int64)] * 4
    new = np.concatenate(([True], (np.diff(gone) != 1) | (segment[gone[1:]] != segment[gone[:-1]])))
    head, tail = gone[new], gone[np.append(np.flatnonzero(new)[1:] - 1, len(gone) - 1)]
    owner = segment[head]
    base = start[owner] - (ends - sizes)[owner]
    return [doc[owner], tie[owner], base + head, base + tail + length]


_SPANS = "doc long, tie long, begin long, end long"


def _sorted_blocks(rows, size, length, block):
    """Intervals of the segments in `rows` (hash, doc, tie, start, seg), `size` bytes in all, whole grams a block."""

    def run(batches):
        held, size, last = [], 0, None

        def finish():
            columns = list(zip(*held))
            found = repeats_in(columns[3], *(np.array(c, np.int64) for c in columns[:3]), length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["doc", "tie", "begin", "end"])

        for batch in batches:
            for hash_, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= block and hash_ != last:
                    yield finish()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = hash_
        if held:
            yield finish()

    # as many partitions as give each a few blocks
    parts = max(1, size // (4 * block), min(size // 65_536, rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.select("hash", "doc", "tie", "start", "seg").repartition(int(parts), "hash").sortWithinPartitions("hash")
    return dealt.mapInArrow(run, _SPANS)


def document_rows(documents):
    """(doc_id, doc, tie, key, text): `doc` puts null ids last, `tie` tells rows of one id apart, text as binary."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tie"),
        text_key().alias("key"), text.cast("binary").alias("text"))


def repeated_spans(documents, length=LENGTH, hot=HOT, block=BLOCK, chunk=CHUNK):
    """(doc, tie, spans): the maximal runs of bytes to remove, as structs of begin and end, of every document that loses any.

    `doc` and `tie` are those of `document_rows`; `length` is 3 * GRAM at least. Equal texts are one text, of
    their first document; the other documents with it lose it whole.
    """
    if length < 3 * GRAM:  # a string must hold the bytes before or after its gram
        raise ValueError(f"length must be {3 * GRAM} at least")
    rows = document_rows(documents).filter(F.octet_length("text") >= length)
    # texts that several rows have, without their words
    same = rows.groupBy("key").agg(F.min("doc").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    same = materialize(same.drop("n"))
    bits = bits_for(same)
    table = bit_table(same.select(F.xxhash64("key").alias("hash")), bits)
    told = with_maybe(rows, F.xxhash64("key"), table, bits)
    several = told.filter("_maybe").join(same, "key", "left")
    once = several.filter("lead is null").select("doc", "tie", "text")
    leads = several.filter("doc = lead").dropDuplicates(["key"]).select("doc", "tie", "text")
    docs = told.filter("not _maybe").select("doc", "tie", "text").unionAll(once).unionAll(leads)
    copies = with_maybe(rows.select("doc", "tie", "key", F.octet_length("text").cast("long").alias("end")), F.xxhash64("key"), table, bits)
    copies = copies.filter("_maybe").join(same, "key").filter("doc <> lead")
    copies = copies.select("doc", "tie", F.lit(0).cast("long").alias("begin"), "end").distinct()

    # grams that are the least of several strings: a bit set of them spares the others a shuffle
    hashes = anchors(docs, length, chunk, ["hash"]).select(F.explode("runs.hash").alias("hash"))
    repeated = materialize(hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    # least hashes lie low, so they are hashed once more to spread over the bits
    at, bits = F.xxhash64("hash"), bits_for(repeated)
    runs = anchors(docs, length, chunk).select("doc", "tie", F.inline("runs"))
    runs = materialize(with_maybe(runs, at, bit_table(repeated.select(at.alias("hash")), bits), bits).filter("_maybe").drop("_maybe"))
    discard(repeated)

    # equal segments: the first stands for all, the others go whole
    kinds = materialize(runs.groupBy("hash", "same").agg(
        F.min(F.struct("doc", "tie", "start")).alias("first"), F.count("*").alias("times"), *[F.min(c).alias(c) for c in ("n", "before", "after")]))
    several = kinds.filter("times > 1").select("hash", "same", "first")
    later = runs.select("hash", "same", "doc", "tie", "start", "n").join(several, ["hash", "same"])
    later = materialize(later.filter(F.struct("doc", "tie", "start") != F.col("first")).select(
        "doc", "tie", F.col("start").alias("begin"), (F.col("start") + F.col("n") + F.lit(length - 1)).alias("end")).unionAll(copies))
    discard(runs)

    # different segments of one gram that agree beside it
    sides = kinds.select("hash", "first.*", "n", F.explode(F.array_distinct(F.array("before", "after"))).alias("side"))
    agree = sides.groupBy("hash", "side").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    agree = materialize(sides.join(agree, ["hash", "side"]).select("hash", "doc", "tie", "start", "n").distinct())
    left = materialize(agree.join(agree.groupBy("hash").agg(F.count("*").alias("kinds")), "hash"))
    discard(agree)
    discard(kinds)
    size, most = left.agg(F.sum(F.col("n") + F.lit(length - 1)), F.max("kinds")).first()
    segments = materialize(fetched(docs, left, length))  # read by both ways
    found = [later, _sorted_blocks(segments.filter(F.col("kinds") <= hot), size or 0, length, block)]
    if (most or 0) > hot:
        found.append(_by_hash(segments.filter(F.col("kinds") > hot), length))
    spans = materialize(reduce(DataFrame.unionAll, found))
    for table in (left, later, segments):
        discard(table)
    return spans.groupBy("doc", "tie").agg(merged_spans(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def fetched(docs, runs, length):
    """(hash, kinds, doc, tie, start, n, seg): the runs (hash, doc, tie, start, n, kinds) with their bytes; texts without any are not moved."""
    wanted = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("hash", "kinds", "start", "n")).alias("runs"))
    at, bits = F.xxhash64("doc", "tie"), bits_for(runs)
    docs = with_maybe(docs, at, bit_table(runs.select(at.alias("hash")), bits), bits).filter("_maybe").drop("_maybe")

    def cut(batches):
        for batch in batches:
            for doc, tie, text, found in zip(*batch.columns):
                data, (hash_, kinds, start, n) = text.as_py(), (c for c in found.values.flatten())
                segs = [data[a : a + k + length - 1] for a, k in zip(start.to_pylist(), n.to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    hash_, kinds, pa.array([doc.as_py()] * len(segs), pa.int64()), pa.array([tie.as_py()] * len(segs), pa.int64()),
                    start, n, pa.array(segs, pa.binary()),
                ], ["hash", "kinds", "doc", "tie", "start", "n", "seg"])

    texts = docs.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "runs")
    return texts.mapInArrow(cut, "hash long, kinds long, doc long, tie long, start long, n int, seg binary")


def _by_hash(rows, length):
    """Intervals of segments of which a gram has too many for one block: their single strings meet by 128 bits of hash."""
    single = rows.select("hash", "doc", "tie", "start", "seg", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select(
        "hash", "doc", "tie", (F.col("start") + F.col("k")).alias("begin"), F.xxhash64(F.substr("seg", F.col("k") + 1, F.lit(length))).alias("string"))
    first = single.groupBy("hash", "string").agg(F.min(F.struct("doc", "tie", "begin")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    later = single.join(first, ["hash", "string"]).filter(F.struct("doc", "tie", "begin") != F.col("first"))
    return later.select("doc", "tie", "begin", (F.col("begin") + F.lit(length)).alias("end"))


def merged_spans(spans):
    """An array of (begin, end) as maximal runs, in order."""

    @F.arrow_udf("array<struct<begin:long,end:long>>")
    def merge(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in column:
            out, sizes = [], []
            for row in lists:
                begin, end = (np.asarray(c) for c in row.values.flatten())
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.concatenate(([True], begin[1:] > end[:-1]))
                out.append((begin[new], end[np.append(new[1:], True)]))
                sizes.append(new.sum())
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            arrays = [pa.array(np.concatenate(c)) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 2
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, ["begin", "end"]))

    return merge(spans)


def kept_bytes(text, spans):
    """The bytes of a text outside its spans (null: none)."""

    @F.arrow_udf("binary")
    def keep(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, lists):
            data, at, parts = text.as_py(), 0, []
            for span in found.as_py() or ():
                parts.append(data[at : span["begin"]])
                at = span["end"]
            out.append(b"".join([*parts, data[at:]]) if parts else data)
        return pa.array(out, pa.binary())

    return keep(text, spans)


def cut_repeats(documents, length=LENGTH, **limits):
    """doc_id, n_bytes, spans (removed runs of bytes, begin and end) and kept (the bytes that stay), one row per row of documents.

    What stays may begin or end inside a character, hence binary. See the
    module for null, short, equal and repeated rows.
    """
    spans = materialize(repeated_spans(documents, length, **limits))
    rows = document_rows(documents).select("doc_id", "doc", "tie", "text")
    at, bits = F.xxhash64("doc", "tie"), bits_for(spans)
    rows = with_maybe(rows, at, bit_table(spans.select(at.alias("hash")), bits), bits)
    none = F.array().cast("array<struct<begin:long,end:long>>")
    whole = rows.filter("not _maybe").select("doc_id", "text", none.alias("spans"), F.col("text").alias("kept"))
    found = rows.filter("_maybe").join(spans, ["doc", "tie"], "left").withColumn("spans", F.coalesce("spans", none))
    found = found.select("doc_id", "text", "spans", kept_bytes("text", "spans").alias("kept"))
    return whole.unionAll(found).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "spans", "kept")


def op13(spark, folder):
    found = cut_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (
  SELECT r, doc_id, t, unnest(range(0, octet_length(t) - 99)) AS s FROM d WHERE octet_length(t) >= 100),
k AS (
  SELECT r, s, row_number() OVER (PARTITION BY t[s + 1 : s + 100] ORDER BY doc_id NULLS LAST, r, s) AS k FROM w),
gone AS (
  SELECT r, s, s - coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -1000) AS gap FROM k WHERE k > 1),
runs AS (
  SELECT r, s, sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS run FROM gone),
spans AS (SELECT r, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY r, run),
cut AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM spans),
kept AS (
  SELECT d.r, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(hex(t[c + 1 : a]), '' ORDER BY a) || hex(any_value(t)[max(b) + 1 :]) AS x
  FROM cut JOIN d ON d.r = cut.r GROUP BY d.r)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(unhex(x), t)) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
