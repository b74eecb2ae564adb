"""Source divergence audit on count vectors.

Every document becomes an exact sparse vector, the counts of its terms. A
vocabulary is fitted for each language: the terms of at least MIN_DOCUMENTS of
its documents, as many as there are. Vectors are added up by (language, source)
and cut to the vocabulary, and each group is compared with every other of its
language and with the language itself.

Vocabularies grow with the corpus, so none goes through the driver or into a
broadcast, as that of Spark ML's CountVectorizer does. A task adds up the
vectors of its documents, term by term, and passes them on whenever it holds
HELD sums; document frequencies travel along, and the vocabulary is a table
that is joined to the sums.

Pairs are evaluated from sparse counts: a pair's sum over all terms is that of
two histograms of counts against an absent term, corrected on the terms that
both sources have, plus the terms that neither has.
"""

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentrylake.functions.scale import top_k_per_group
from sentrylake.llm.common import short_batches, texts_of
from sentrylake.session import discard, materialize

MIN_DOCUMENTS = 3
UNIT = 1_000_000_000
TERMS = 200
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
HELD = 300_000
LONG = 1 << 20  # texts beyond it are not split at once
SUMS = "lang string, source string, term string, count long, documents long"


def count_vector(text):
    """The counts of a text's terms, only A to Z lower-cased."""
    text = text.encode().lower().decode()
    if len(text) <= LONG:
        return Counter(TERM.findall(text))
    return Counter(found.group() for found in TERM.finditer(text))


def group_sums(documents, held=HELD):
    """(lang, source, term, count, documents): the vectors of each group added up, and the documents that have the term; nulls are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size = {}, 0

        def parts():
            for (lang, source), (seen, more) in sums.items():
                n, documents_of = len(seen), pa.array(list(seen.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(seen), pa.string()),
                    pc.add(documents_of, pa.array([more.get(t, 0) for t in seen], pa.int64())), documents_of,
                ], ["lang", "source", "term", "count", "documents"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                vector = count_vector(text)
                # the documents of a term, and what its counts are above one each: most counts are one
                seen, more = sums.setdefault((lang, source), (Counter(), {}))
                size -= len(seen)
                seen.update(vector.keys())
                size += len(seen)
                for term, count in vector.items():
                    if count > 1:
                        more[term] = more.get(term, 0) + count - 1
                if size >= held:
                    yield from parts()
                    sums, size = {}, 0
        yield from parts()

    short_batches(documents.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = documents.select(name("lang"), name("source"), name("text")).mapInArrow(run, SUMS)
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def group_counts(documents, min_documents=MIN_DOCUMENTS, held=HELD):
    """(lang, term, source, count) of the kept terms that occur in each group, and (lang, term) of all kept terms; both written."""
    sums = materialize(group_sums(documents, held))
    kept = sums.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= min_documents)
    kept = materialize(kept.select("lang", "term"))
    counts = materialize(sums.join(kept, ["lang", "term"]).select("lang", "term", "source", "count"))
    discard(sums)
    return counts, kept


def _share(count, total, terms):
    """1 + floor(UNIT * (count + 1) / (total + terms))."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * ({count} + 1) DIV ({total} + {terms}))")


def _gap(p, q):
    """floor((p - q) * (p - q) / q) of two long columns."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV {q}")


def pair_divergence(counts, groups):
    """(lang, source, item, value): the sum over all kept terms, for each two sources of a language.

    `counts` has lang, term, source, p of the terms that occur, and the group's p0; `groups` lang, source, n_terms, present (terms that occur), p0 (of an absent term).
    """
    spectrum = counts.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    side = lambda name: groups.select("lang", *[F.col(c).alias(f"{c}_{name}") for c in ("source", "present", "p0")])
    pairs = side("a").join(side("b").join(groups.select("lang", "n_terms").distinct(), "lang"), "lang").filter("source_a <> source_b")
    seen = spectrum.withColumnRenamed("source", "source_a").join(pairs, ["lang", "source_a"])
    # own terms against an absent one, in both directions
    alone = seen.groupBy("lang", "source_a", "source_b").agg(
        F.sum(F.col("m") * _gap("p", "p0_b")).alias("out"), F.sum(F.col("m") * _gap("p0_b", "p")).alias("back"))
    # added up on the map side: terms that two sources have are not shuffled again
    has = lambda name: counts.select("lang", "term", *[F.col(c).alias(f"{c}_{name}") for c in ("source", "p", "p0")])
    change = lambda a, b: F.sum(_gap(f"p_{a}", f"p_{b}") - _gap(f"p_{a}", f"p0_{b}") - _gap(f"p0_{a}", f"p_{b}"))
    met = has("a").join(has("b"), ["lang", "term"]).filter("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(
        F.count("*").alias("shared"), change("a", "b").alias("change_a"), change("b", "a").alias("change_b"))
    both = met.select("lang", "source_a", "source_b", "shared", F.col("change_a").alias("change")).unionAll(
        met.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "shared", F.col("change_b").alias("change")))
    back = alone.select("lang", F.col("source_a").alias("source_b"), F.col("source_b").alias("source_a"), "back")
    keys = ["lang", "source_a", "source_b"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    rows = pairs.join(alone.drop("back"), keys, "left").join(back, keys, "left").join(both, keys, "left")
    neither = F.col("n_terms") - F.col("present_a") - F.col("present_b") + zero("shared")
    value = zero("out") + zero("back") + zero("change") + F.coalesce(neither * _gap("p0_a", "p0_b"), F.lit(0).cast("long"))
    return rows.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), value.alias("value"))


def term_divergence(counts, totals, terms=TERMS):
    """(lang, source, item, value, rank): terms that a group has more of than its language, the most divergent first."""
    rows = counts.join(totals, ["lang", "term"]).filter("p > q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    return top_k_per_group(rows, ["lang", "source"], [F.col("value").desc(), F.col("item")], terms)


def audit_sources(documents, min_documents=MIN_DOCUMENTS, terms=TERMS, held=HELD):
    """lang, source, part, item, value, rank: every group against the other sources of its language (part pair) and its own terms (part term).

    Null text, lang and source are ''. A group whose documents have no terms,
    and a language without kept terms, still give their pairs. Repeated rows
    count as documents of their own. Groups are few; terms are not collected.
    """
    counts, kept = group_counts(documents, min_documents, held)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = documents.select(name("lang"), name("source")).distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    has = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("present"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = groups.join(sizes, "lang", "left").join(has, ["lang", "source"], "left").select(
        "lang", "source", zero("n_terms"), zero("total"), zero("present"))
    absent = F.when(F.col("n_terms") > 0, _share("0", "total", "n_terms"))
    groups = materialize(groups.withColumn("p0", absent))
    shares = materialize(counts.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "count", _share("count", "total", "n_terms").alias("p"), "p0"))
    languages = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("n_terms").alias("n_terms"))
    totals = counts.groupBy("lang", "term").agg(F.sum("count").alias("count")).join(languages, "lang").select(
        "lang", "term", _share("count", "total", "n_terms").alias("q"))
    pairs = pair_divergence(shares, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    found = term_divergence(shares, totals, terms).withColumn("part", F.lit("term"))
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*names).unionAll(found.select(*names))


def op11(spark, folder):
    return audit_sources(spark.read.parquet(f"{folder}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS MATERIALIZED (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (gn.n + v.v) AS p
  FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang),
q AS (
  SELECT lang, term, 1 + 1000000000 * (sum(c.n) + 1)::HUGEINT // (any_value(ln.n) + any_value(v.v)) AS q
  FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
ps AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(ps.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN ps ON ps.lang = a.lang AND ps.source = a.source AND ps.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
