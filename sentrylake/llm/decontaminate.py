"""Benchmark decontamination by Wu-Manber search over words.

Windows of benchmark items are the patterns, documents the texts, words the
letters. A table of blocks of two words tells how far the search may shift;
most positions of a document are never looked at. Where no shift is allowed,
the block selects a bucket, the first two words select test strings in it, and
direct comparison confirms.

The benchmark is searched in blocks of bounded size, so what is sent to the
tasks does not grow with it; every document is searched for every block.
"""


import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.llm.common import text_key, text_udf

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: lower-case A-Z; what is no digit, letter or byte of a non-ASCII character ends a word
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text):
    """Words of a text as bytes: maximal runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.encode("utf-8").translate(_LETTERS).split()


class WindowSearch:
    """Wu-Manber tables, one set for each length of window."""

    def __init__(self, items, window=WINDOW):
        """`items`: (id, text) pairs; ids are numbered by their first place."""
        self.ids = list(dict.fromkeys(i for i, _ in items))
        number = {i: k for k, i in enumerate(self.ids)}
        patterns = {}
        for i, text in items:
            words = tuple(words_of(text))
            size = min(window, len(words))
            for start in range(len(words) - size + 1) if size else ():
                patterns.setdefault(size, {}).setdefault(words[start : start + size], set()).add(number[i])
        self.single = {p[0]: frozenset(x) for p, x in patterns.pop(1, {}).items()}
        self.tables = []
        for size, found in sorted(patterns.items()):
            shift, buckets = {}, {}
            for pattern, owners in found.items():
                for end in range(1, size):
                    block = pattern[end - 1 : end + 1]
                    shift[block] = min(shift.get(block, size), size - 1 - end)
                buckets.setdefault(pattern[-2:], {}).setdefault(pattern[:2], []).append((list(pattern), frozenset(owners)))
            self.tables.append((size, shift, buckets))

    def search(self, words):
        """Merged [start, end) ranges of hit words, in order, and the numbers of the items found."""
        spans, owners = [], set()
        if self.single:
            for at, word in enumerate(words):
                if word in self.single:
                    spans.append((at, at + 1))
                    owners |= self.single[word]
        for size, shift, buckets in self.tables:
            at, n, skip = size - 1, len(words), size - 1
            while at < n:
                block = (words[at - 1], words[at])
                step = shift.get(block, skip)
                if step:
                    at += step
                    continue
                start = at - size + 1
                for pattern, of in buckets[block].get((words[start], words[start + 1]), ()):
                    if words[start : at + 1] == pattern:
                        spans.append((start, at + 1))
                        owners |= of
                at += 1
        return merged(spans), owners


def merged(spans):
    """Sorted ranges without overlap."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "n_words long, spans array<array<int>>, items array<string>"


def _searching(items, window):
    def make():
        tables = WindowSearch(items, window)

        def one(text):
            words = words_of(text)
            spans, owners = tables.search(words)
            return len(words), spans, [tables.ids[k] for k in owners if tables.ids[k] is not None]

        return one

    return text_udf(make, _FOUND, f"struct<{', '.join(x.replace(' ', ':', 1) for x in _FOUND_DDL.split(', '))}>")


def benchmark_blocks(benchmark, block_bytes=BLOCK_BYTES):
    """The benchmark as lists of (id as text, text), each of about `block_bytes` by hash; at least one list."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").filter("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = total // block_bytes + 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    for k in range(count):
        yield [tuple(r) for r in items.filter(block == k).orderBy("id", "text").collect()]


def find_contamination(documents, benchmark, window=WINDOW, block_bytes=BLOCK_BYTES):
    """One row per document: doc_id, n_words, spans (hit word ranges), items (ids as text, sorted), n_hit, n_items.

    A window is `window` consecutive words of an item, or all words of a
    shorter one. Null and empty texts have no words. Items with a null id hit
    words but are not listed or counted; equal ids count once. Repeated rows
    are answered one by one.
    """
    source = documents.select("doc_id", "text")
    parts = None
    for k, items in enumerate(benchmark_blocks(benchmark, block_bytes)):
        part = source.select(
            "doc_id", text_key().alias("_key"), F.lit(k).alias("_block"), _searching(items, window)("text").alias("_f")
        )
        parts = part if parts is None else parts.unionAll(part)
    # copies of one row meet as a count, then one entry per block
    once = parts.groupBy("doc_id", "_key", "_block").agg(F.first("_f").alias("_f"), F.count("*").alias("_copies"))
    whole = once.groupBy("doc_id", "_key").agg(
        F.max("_copies").alias("_copies"), F.max("_f.n_words").alias("n_words"),
        F.flatten(F.collect_list("_f.spans")).alias("_spans"), F.flatten(F.collect_list("_f.items")).alias("_items"),
    )
    spans = _merge_spans("_spans")
    rows = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        "doc_id", "n_words", spans.alias("spans"), F.array_sort(F.array_distinct("_items")).alias("items")
    )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return rows.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))


def _merge_spans(column):
    """Ranges of several blocks as sorted ranges without overlap."""
    none = F.array().cast("array<array<int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1])))
        )
        return F.when(F.size(done) == 0, F.array(span)).when(span[0] <= last[1], joined).otherwise(
            F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(column), none, add)


def drop_contaminated(documents, benchmark, window=WINDOW, block_bytes=BLOCK_BYTES):
    """The documents, with all their columns, in which no benchmark window occurs."""
    kept = documents
    for items in benchmark_blocks(benchmark, block_bytes):
        kept = kept.filter(F.size(_searching(items, window)("text")["spans"]) == 0)
    return kept


def op9(spark, folder):
    found = find_contamination(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM p),
dw AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT DISTINCT r, s, dw.n, item_id FROM dw JOIN p ON dw.g = p.g AND dw.n = p.n),
hits AS (
  SELECT r, count(DISTINCT pos) AS n_hit
  FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
