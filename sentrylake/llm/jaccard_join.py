"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of word shingles; two link at a Jaccard similarity of
`percent` or more. Sizes are cut into bands. Similar sets fall into one band or
two neighbouring ones and differ in few elements, at most k for the band. The
element domain is partitioned by hash; with n1 partitions of n2 parts each, some
partition holds few of the k differences, and some n2 - k2 of its parts none.
Each set has one signature for every such choice of parts, the sum of the
hashes of its elements there, so sets that are similar enough share one.

Sets that share a signature are a group, and groups may be large. No pairs are
formed inside a group; each member is compared with the group's hub, the member
with most shared signatures. Members that do not link to the hub are told apart
by their differences from it: two members can only link if their differences
overlap, by a known amount, so an inverted index over the rarest differences
finds those pairs and the differences alone decide them. Only members of unlike
components of the links to hubs are met. Every pair that shares a signature is
linked through hubs, found by that index, or provably not similar.

`first_of_each` works at lower bounds too, where sets have many signatures and
unlike ones often share some, through passages they have in common. It takes as
signatures the prefixes of the sets under one order of the elements, and only
those of sets with enough shared elements (`prefix_signatures`).
"""

from bisect import bisect_left
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentrylake.llm.common import bit_table, short_batches, text_key, texts_of, with_maybe
from sentrylake.operators.correlate import connected_components
from sentrylake.session import discard, materialize

WORDS = 3
PERCENT = 90
WORD = r"[^\x20\x09-\x0D]"
FILTER_BITS = 25
EXTRA = 10
MEMO = 200_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x):
    """A hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to MEMO words."""

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxh64_intdigest(word)
        return found


def shingles_of(text, hashes, words=WORDS):
    """The distinct hashes of a text's shingles, sorted; a text of fewer words has one, of all of them."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    total = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        total *= _ODD
        total += each[k : len(found) - size + 1 + k]
    return np.unique(mixed(total))


class Band:
    """The signatures of one band: sets of up to `high` elements, with partners down to the similarity bound below `low`."""

    def __init__(self, number, low, high, percent):
        self.low, self.high = low, high
        # |a| + |b| <= 2 high, and similar sets differ in at most this share of |a| + |b|
        self.k = 2 * high * (100 - percent) // (100 + percent)
        if self.k <= 2:
            self.n1, self.n2, self.k2, self.spare = 1, self.k + 2, self.k, 0
        else:
            self.spare = 1 if self.k >= 4 else 0
            self.n1, self.k2 = self.k // 2 + 1 + self.spare, 1
            # two parts make fewer signatures, three make them more selective
            self.n2 = 2 if high >= 8 * 2 * self.n1 else 3
        self.choices = np.array(list(combinations(range(self.n2), self.n2 - self.k2)))
        self.seed = mixed(np.array([number * 1_000_003 + 1], np.uint64)) | np.uint64(1)
        cells = np.arange(self.n1 * self.n2, dtype=np.uint64)
        self.code = mixed((cells + np.uint64(1)) * _ODD + self.seed).reshape(self.n1, self.n2)
        self.mark = mixed(np.arange(len(self.choices), dtype=np.uint64) * _ODD + self.seed)

    def signatures(self, shingles):
        cells = self.n1 * self.n2
        cell = ((shingles * self.seed >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        # elements are sorted, so equal parts give equal sums
        total = np.bincount(cell, (shingles >> np.uint64(20)).astype(np.float64), cells).reshape(self.n1, self.n2)
        parts = mixed(total.astype(np.uint64) + self.code)
        chosen = mixed(parts[:, self.choices].sum(axis=2, dtype=np.uint64) + self.mark)
        void = (total == 0)[:, self.choices].all(axis=2)
        # similar sets agree in more than `spare` partitions: unless that many have an empty
        # choice, they also share a signature with elements in it
        if void.any(axis=1).sum() <= self.spare:
            return chosen[~void]
        return chosen.ravel()


class PartEnum:
    """Signatures of sets of any size; bands are made when first needed."""

    def __init__(self, percent=PERCENT):
        self.percent, self.bands = percent, []

    def of(self, shingles):
        """The signatures of a set, sorted; equal sets need none."""
        size = len(shingles)
        while not self.bands or self.bands[-1].low * self.percent <= 100 * size:
            low = self.bands[-1].high + 1 if self.bands else 1
            # two steps of the bound, so that half of the sets lie in one band only
            high = max(low, low * 100 * 100 // (self.percent * self.percent))
            self.bands.append(Band(len(self.bands), low, high, self.percent))
        found = []
        for band in self.bands[bisect_left(self.bands, size, key=lambda b: b.high) :] if size else ():
            if band.low * self.percent > 100 * size:
                break
            if band.k:  # else only equal sets are similar
                found.append(band.signatures(shingles))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


class Prefixes:
    """The first elements of a set in ascending signed order: as many as leave the least overlap with a partner, and EXTRA percent of the set and one more."""

    def __init__(self, percent=PERCENT):
        self.percent = percent

    def of(self, shingles):
        size = len(shingles)
        least = -(-self.percent * size // 100)
        return np.sort(shingles.view(np.int64))[: size - least + size * EXTRA // 100 + 1]


def fingerprint(shingles):
    """A hash of a set as a signed 64-bit integer."""
    return int(mixed(mixed(shingles).sum(dtype=np.uint64, keepdims=True) * _ODD + np.uint64(len(shingles))).astype(np.int64)[0])


def _lists(arrays):
    """An Arrow list column of signed 64-bit integers."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


STEP = 512


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def set_rows(documents, words=WORDS, percent=PERCENT, make=PartEnum):
    """(doc_id, key, n_shingles, fp, sigs) of every document; `key` stands for the text, `fp` for the set."""

    def run(batches):
        hashes, enum = WordHashes(), make(percent)
        for part in _slices(batches):
            sets = [shingles_of(t, hashes, words) for t in texts_of(part.column(2))]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) for s in sets], pa.int64()), _lists([enum.of(s) for s in sets]),
            ], ["doc_id", "key", "n_shingles", "fp", "sigs"])

    short_batches(documents.sparkSession)
    return documents.select("doc_id", text_key().alias("key"), "text").mapInArrow(
        run, "doc_id long, key binary, n_shingles long, fp long, sigs array<long>")


def shared_signatures(rows):
    """(sig, fp): the signatures that two different sets have, with the sets that have them."""
    sigs = rows.select("fp", F.explode("sigs").alias("sig"))
    pairs = sigs.groupBy("sig").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    shared = materialize(pairs.filter("a < b").select("sig"))
    # most signatures are of one set only: a bit set keeps most of these from the second shuffle
    table = bit_table(shared.select(F.col("sig").alias("hash")), FILTER_BITS)
    maybe = with_maybe(sigs, F.col("sig"), table, FILTER_BITS).filter("_maybe").select("sig", "fp")
    return materialize(maybe.join(shared, "sig").distinct())


def prefix_signatures(rows, percent=PERCENT):
    """(sig, fp) as of `shared_signatures`, for the `Prefixes` of sets.

    Let t(n) = ceil(n * percent / 100) and l(n) = floor(n * EXTRA / 100) + 1. Sets x and y
    that link have at least t(|x|) and t(|y|) elements in common, so the k smallest of these
    are among the first |x| - t(|x|) + k of x, and likewise of y. For k = l(t(|x|)), at most
    l(|x|) and l(|y|) since |y| >= t(|x|), that many are in both prefixes: sets with fewer
    shared signatures link to nothing. Of the others, with s shared ones, the first s - k + 1
    in any common order hold one that both have: rarest first, it is seldom one of a passage
    that unlike documents have in common.
    """
    shared = shared_signatures(rows)
    enough = F.expr(f"(({percent} * n_shingles + 99) DIV 100) * {EXTRA} DIV 100 + 1").alias("_enough")
    least = rows.select("fp", enough).distinct()
    able = shared.groupBy("fp").agg(F.count("*").alias("_n")).join(least, "fp").filter("_n >= _enough")
    near = materialize(shared.join(able.select("fp", "_enough"), "fp"))
    discard(shared)
    counts = near.groupBy("sig").agg(F.count("*").alias("_c")).filter("_c > 1")
    own = Window.partitionBy("fp")
    ranked = near.join(counts, "sig").withColumn("_n", F.count("*").over(own)).withColumn("_rank", F.row_number().over(own.orderBy("_c", "sig")))
    first = materialize(ranked.filter("_rank <= _n - _enough + 1").select("sig", "fp"))
    discard(near)
    several = first.groupBy("sig").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("sig")
    found = materialize(first.join(several, "sig"))
    discard(first)
    return found


def hub_pairs(shared):
    """(fp, hub): every set with the hubs of its groups; the hub is the member with most shared signatures."""
    scored = shared.join(shared.groupBy("fp").agg(F.count("*").alias("score")), "fp")
    hubs = scored.groupBy("sig").agg(F.max(F.struct("score", "fp"))["fp"].alias("hub"))
    return materialize(shared.join(hubs, "sig").filter("fp <> hub").select("fp", "hub").distinct())


def sets_of(documents, rows, pairs, words=WORDS):
    """(fp, shingles) of the sets in `pairs`, from one text of each."""
    wanted = pairs.select("fp").unionAll(pairs.select(F.col("hub").alias("fp"))).distinct()
    keys = materialize(rows.select("fp", "key").join(wanted, "fp").groupBy("fp").agg(F.min("key").alias("key")))
    table = bit_table(keys.select(F.xxhash64("key").alias("hash")), FILTER_BITS)
    texts = documents.select("text", text_key().alias("key"))
    maybe = with_maybe(texts, F.xxhash64("key"), table, FILTER_BITS).filter("_maybe")
    once = maybe.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key").select("fp", "text")

    def run(batches):
        hashes = WordHashes()
        for part in _slices(batches):
            sets = [shingles_of(t, hashes, words) for t in texts_of(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], ["fp", "shingles"])

    return materialize(once.mapInArrow(run, "fp long, shingles array<long>"))


def compared(pairs, sets, percent=PERCENT):
    """(fp, hub, size, linked, apart): `apart` are the elements in one of both sets only."""
    # renamed alike on both sides, the sets are shuffled once
    both = pairs.join(sets.select(F.col("fp").alias("_f"), F.col("shingles").alias("_set")), F.col("fp") == F.col("_f"))
    both = both.join(sets.select(F.col("fp").alias("_h"), F.col("shingles").alias("_hub")), F.col("hub") == F.col("_h"))
    apart = both.select(
        "fp", "hub", F.size("_set").alias("size"), F.size("_hub").alias("_other"),
        F.concat(F.array_except("_set", "_hub"), F.array_except("_hub", "_set")).alias("apart"))
    linked = _similar(F.size("apart"), F.col("size") + F.col("_other"), percent)
    return materialize(apart.withColumn("linked", linked).drop("_other"))


def _similar(different, sizes, percent):
    """Jaccard similarity >= percent: (100 + percent) * |differences| <= (100 - percent) * (|a| + |b|)."""
    return (100 + percent) * different <= (100 - percent) * sizes


def residual_pairs(found, percent=PERCENT, joined=None):
    """Members of the hubs' groups that have something to find, and pairs (hub, x, y, _cx, _cy) of them that may link.

    x does not link to the hub; _cx and _cy are the components of x and y, which differ.

    With D the differences from the hub, a pair of members differs in
    |Dx| + |Dy| - 2 |Dx & Dy| elements. Let s = (100 - percent) / (100 + percent).
    If x does not link to the hub, a link to y needs |Dx & Dy| > |Dy| (1 - s) / 2,
    and at least |Dx| - |x| (1 - percent/100) / (percent/100). It needs more than
    |Dx| (1 - s) / 2 only if y does not link to the hub either. Under one order of the
    elements, rarest first, the prefixes that these bounds leave must meet.

    Both sides know their sizes when they meet, so the pair is held to its own bound:
    2 |Dx & Dy| >= (|Dx| - s |x|) + (|Dy| - s |y|), and from the first element that both
    have on, either has at least |Dx & Dy| elements (`_left`, `_slack`: these times 2 (100 +
    percent)). Linked sets are also no smaller than percent/100 of each other.
    """
    if joined is None:
        found = found.withColumn("c", F.col("fp"))
    else:
        found = found.join(joined.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    # a group whose members are all linked to the hub, or all in one component, has nothing to find
    open_groups = found.groupBy("hub").agg(F.count_if(~F.col("linked")).alias("_loose"), F.min("c").alias("_low"), F.max("c").alias("_high"))
    open_groups = open_groups.filter("_loose > 0 AND _low < _high").select("hub")
    rows = materialize(found.filter(F.size("apart") > 0).join(open_groups, "hub", "left_semi").withColumn("n", F.size("apart")))
    tokens = rows.select("hub", "fp", "linked", "size", "c", "n", F.explode("apart").alias("e"))
    counts = tokens.groupBy("hub", "e").agg(F.count("*").alias("_c"), F.count_if("linked").alias("_c_linked")).filter("_c > 1")
    own = Window.partitionBy("hub", "fp")
    # elements of one member come first in the order, and meet nothing: only their number moves on
    several = tokens.join(counts, ["hub", "e"]).withColumn("_several", F.count("*").over(own)).withColumn("_at", F.row_number().over(own.orderBy("_c", "e")))
    ranked = several.withColumn("rank", F.col("n") - F.col("_several") + F.col("_at"))
    # |Dx & Dy| > |Dy| (1 - s) / 2 with (1 - s) / 2 = percent / (100 + percent)
    as_partner = F.col("n") - F.floor(F.lit(percent) * F.col("n") / F.lit(100 + percent))
    as_loose = F.least("n", F.floor(F.col("size") * (100 - percent) / F.lit(percent)) + 1)
    # past the short prefix only linked members are met
    partner = F.col("rank") <= as_partner
    probe = ~F.col("linked") & (F.col("rank") <= as_loose) & (partner | (F.col("_c_linked") > 0))
    left = (2 * (100 + percent) * (F.col("n") - F.col("rank") + 1)).alias("_left")
    slack = ((100 + percent) * F.col("n") - (100 - percent) * F.col("size")).alias("_slack")
    ranked = materialize(ranked.filter(partner | probe).select(
        "hub", "e", "fp", "linked", "c", "size", left, slack, partner.alias("partner"), probe.alias("probes")))
    member = lambda name: [F.col("fp").alias(name), F.col("c").alias(f"_c{name}"), F.col("size").alias(f"_n{name}"),
                           F.col("_left").alias(f"_left{name}"), F.col("_slack").alias(f"_slack{name}")]
    probes = ranked.filter("probes").select("hub", "e", *member("x"), F.col("partner").alias("_short"))
    partners = ranked.filter("partner").select("hub", "e", *member("y"), "linked")
    # a partner that links to the hub is met by the whole prefix, a loose one by the short one
    met = F.col("linked") | (F.col("_short") & (F.col("x") < F.col("y")))
    enough = F.least("_leftx", "_lefty") >= F.col("_slackx") + F.col("_slacky")
    alike = 100 * F.least("_nx", "_ny") >= percent * F.greatest("_nx", "_ny")
    pairs = probes.join(partners, ["hub", "e"]).filter(met & enough & alike & (F.col("_cx") != F.col("_cy")))
    return rows, pairs.select("hub", "x", "y", "_cx", "_cy").distinct()


def residual_links(found, percent=PERCENT, joined=None):
    """(a, b): linked pairs of one hub's group of which at least one does not link to the hub.

    With `joined` (node, component), only those of two components, as
    (component of a, component of b): the others join nothing new.
    """
    rows, pairs = residual_pairs(found, percent, joined)
    side = lambda name: rows.select("hub", F.col("fp").alias(name), F.col("size").alias(f"_n{name}"), F.col("apart").alias(f"_d{name}"))
    both = pairs.join(side("x"), ["hub", "x"]).join(side("y"), ["hub", "y"])
    different = F.size("_dx") + F.size("_dy") - 2 * F.size(F.array_intersect("_dx", "_dy"))
    return both.filter(_similar(different, F.col("_nx") + F.col("_ny"), percent)).select(F.col("_cx").alias("a"), F.col("_cy").alias("b"))


def _components(documents, words, percent, make=PartEnum, signatures=shared_signatures):
    """(doc_id, n_shingles, key, _c): the component of every document; `key` stands for its text."""
    sets = materialize(set_rows(documents, words, percent, make))
    shared = signatures(sets)
    rows = materialize(sets.drop("sigs"))
    discard(sets)
    pairs = hub_pairs(shared)
    discard(shared)
    arrays = sets_of(documents, rows, pairs, words)
    found = compared(pairs, arrays, percent)
    discard(arrays)
    joined = connected_components(found.filter("linked").select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    wider = connected_components(residual_links(found, percent, joined))
    found = rows.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("_c", F.coalesce("component", "fp"))
    found = found.join(wider.select(F.col("node").alias("_c"), F.col("component").alias("_wider")), "_c", "left")
    return materialize(found.select("doc_id", "n_shingles", "key", F.coalesce("_wider", "_c").alias("_c")))


def jaccard_components(documents, words=WORDS, percent=PERCENT):
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included).

    Null and empty texts have no shingles and link with nothing. A null doc_id
    is no smallest id; a component without any other has a null component_id.
    Repeated rows are answered one by one.
    """
    rows = _components(documents, words, percent)
    smallest = rows.filter("n_shingles > 0").groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.filter("n_shingles > 0").join(smallest, "_c").select("doc_id", "n_shingles", "component_id").unionAll(alone)


def first_of_each(documents, words=WORDS, percent=PERCENT):
    """One document, with all its columns, of each component: the smallest doc_id (null last).

    Documents without words are in no component and all stay.
    """
    rows = _components(documents, words, percent, Prefixes, lambda sets: prefix_signatures(sets, percent))
    rows = rows.filter("n_shingles > 0").groupBy("_c", "doc_id", "key").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    lead = rows.groupBy("_c").agg(F.min_by(F.struct("doc_id", "key", "n"), order).alias("k"))
    lead = lead.select(F.col("k.doc_id").alias("_d"), F.col("k.key").alias("_k"), F.col("k.n").alias("_n"))
    own = [F.col(f"`{c}`") for c in documents.columns]
    table = documents.select(F.struct(*own).alias("_row"), text_key().alias("_key"), F.coalesce("text", F.lit("")).rlike(WORD).alias("_any"))
    found = table.filter("_any").join(lead, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    # rows that repeat id and text: the one with the smallest hash of all columns
    several = found.filter("_n > 1").groupBy("_d", "_k").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return table.filter("not _any").select("_row.*").unionAll(found.filter("_n = 1").select("_row.*")).unionAll(several.select("_row.*"))


def op10(spark, folder):
    return jaccard_components(spark.read.parquet(f"{folder}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[k : k + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT r, r AS c FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.c)
SELECT any_value(d.doc_id) AS doc_id, CAST(any_value(coalesce(n.n, 0)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN d ON d.r = reach.r JOIN d o ON o.r = reach.c LEFT JOIN n ON n.r = reach.r GROUP BY reach.r
"""
