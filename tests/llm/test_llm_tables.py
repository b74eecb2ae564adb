"""WARC, mixing, decontamination, Jaccard join and the pipeline: against brute force."""

import os
import re
import uuid
from ast import literal_eval
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentrylake.llm import decontaminate, jaccard_join, mixing, warc
from sentrylake.llm.queries import ORACLES, QUERIES
from sentrylake.session import checkpoint_root, materialize

from oracle import compare, connect


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, folder, name):
    problem = compare(spark, connect(folder), name, QUERIES[name], ORACLES[name], folder)
    assert problem is None or problem.startswith("types"), problem  # booleans stay booleans


# --- decontamination ---

def brute_windows(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            patterns[tuple(w[s : s + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in patterns}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in patterns:
                    hit.update(range(s, s + n))
                    found |= patterns[tuple(w[s : s + n])]
        out.append(repr((i, len(w), len(hit), len(found - {None}), sorted(str(x) for x in found - {None}))))
    return sorted(out)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, "x"), (4, None), (5, ""), (2, "short item"),
         (None, "nameless item here"), (6, "a a a a a a a a a a a a"), (7, "Ünï ten words " * 4)]
TEXTS = [(1, "Zero ONE two, three four five six seven eight nine ten eleven twelve"), (2, None), (2, None), (None, "short item x"), (3, ""),
         (4, "a " * 30), (5, "a " * 9), (6, "nameless item here! short. item"), (7, "Ünï ten words " * 5), (8, "y " * 40_000 + "short item")]


def test_decontamination_in_one_and_many_blocks(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, spans int")
    for size in (decontaminate.BLOCK_BYTES, 20):
        got = decontaminate.find_contamination(docs, bench, block_bytes=size)
        assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"])) for r in got.collect()) == brute_windows(TEXTS, ITEMS)
        kept = decontaminate.drop_contaminated(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "5"]
    none = decontaminate.find_contamination(docs, bench.limit(0))
    assert {r.n_hit for r in none.collect()} == {0} and none.count() == len(TEXTS)
    assert decontaminate.find_contamination(docs.limit(0), bench).collect() == []


def test_window_search_skips_but_misses_nothing():
    import random

    draw = random.Random(2)
    for _ in range(200):
        items = [(k, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 14)))) for k in range(4)]
        text = " ".join(draw.choice("abc") for _ in range(60))
        search = decontaminate.WindowSearch(items, 6)
        spans, owners = search.search(decontaminate.words_of(text))
        got = repr((0, 60, sum(b - a for a, b in spans), len(owners), sorted(str(search.ids[k]) for k in owners)))
        assert [got] == brute_windows([(0, text)], items, 6)


# --- WARC ---

def test_warc_edge_cases(spark):
    same = "x" * 2000
    rows = [(1, "u", same), (2, "u\r\nv: w", same), (2, "u\r\nv: w", same), (None, None, same), (3, None, None), (3, None, ""), (4, "u", "é" * 600),
            (5, "u", "é" * 600), (6, "s", "abc"), (7, "s", "abc"), (8, "b", "\r\n\r\nWARC/1.1\r\n" * 400)]
    pages = spark.createDataFrame([(*r, 0, "q") for r in rows], "page_id long, url string, html string, size int, digest string")
    root = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    index = warc.write_archives(pages, root, file_bytes=600)
    records = warc.read_records(index, root)
    by_page = {r.page_id: r for r in records.filter("record_type = 'response'").collect()}
    assert by_page[8].payload.decode() == rows[-1][2] and by_page[2].payload_bytes == 2000
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolve_revisits(records).collect())
    assert got == Counter([
        (2, "response", None, 2000), (2, "revisit", 2, 2000), (1, "revisit", 2, 2000), (None, "revisit", 2, 2000), (3, "response", None, 0),
        (3, "response", None, 0), (5, "response", None, 1200), (4, "revisit", 5, 1200), (6, "response", None, 3), (7, "response", None, 3),
        (8, "response", None, 5600)])
    # an index made by scanning the files says the same, and a selection reads only its own records
    again = warc.index_archives(spark, root, os.listdir(root.removeprefix("file:")))
    places = lambda df: sorted((r.file, r.offset, r.length, r.digest, r.record_id) for r in df.collect())
    assert places(again) == places(index)
    assert [r.page_id for r in warc.read_records(index.filter("page_id = 6"), root).collect()] == [6]
    empty = warc.write_archives(pages.limit(0), f"{root}-empty")
    assert warc.read_records(empty, f"{root}-empty").collect() == []


def test_ranges_join_close_places():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"file": ["a"] * 4 + ["b"], "offset": [0, 10, 40, 60, 0], "length": [10, 5, 20, 50, 7]})
    assert [x[:3] for x in warc.ranges([batch], 20, 1000)] == [("a", 0, 15), ("a", 40, 110), ("b", 0, 7)]
    assert [x[:3] for x in warc.ranges([batch], 100, 70)] == [("a", 0, 60), ("a", 60, 110), ("b", 0, 7)]


# --- mixing ---

def brute_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    left = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    budget, targets = 1.5 * sum(sizes.values()), {}
    while left:
        whole = sum(left.values())
        above = [k for k in left if budget * left[k] / whole > 2 * sizes[k]]
        for k in above or list(left):
            targets[k] = 2.0 * sizes[k] if above else budget * left[k] / whole
        if not above:
            break
        for k in above:
            budget -= targets[k]
            left.pop(k)
    return targets


def check_mix(df, gap):
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.select("doc_id", "source", "text").collect()]
    sizes, taken = Counter(), Counter()
    for _, source, size in rows:
        sizes[source] += size
    targets = brute_targets(sizes)
    got = mixing.mix(df).collect()
    assert sorted(map(repr, [(r.doc_id, r.source, r["size"]) for r in got])) == sorted(map(repr, rows))
    for r in got:
        taken[r.source] += r["size"] * r.copies
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
    assert all(abs(taken[s] - targets[s]) <= gap for s in targets)
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, got))
    want = Counter(repr((r.doc_id, r.source)) for r in got for _ in range(r.copies))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and Counter(repr((r.doc_id, r.source)) for r in mixed.collect()) == want


def test_mixing(documents, spark, monkeypatch):
    check_mix(documents, 20)  # ten documents a source
    monkeypatch.setattr(mixing, "PER_BUCKET", 3)  # several hash buckets a size
    copies = [(k % 7 if k % 3 else None, "same four words here", "hot", 1) for k in range(50)]
    rows = [(3, None, None, 1), (1, "a", None, 2), (None, "", None, 3), (2, "a b", "s", 4), (2, "a b", "s", 5), (2, "a b", "s", 5), (8, "q", "z", 1), *copies]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    check_mix(odd, 4)
    check_mix(odd.limit(0), 0)


def test_budget_fits_exactly_where_a_subset_does():
    import random

    draw = random.Random(4)
    for _ in range(300):
        sizes = sorted(draw.sample(range(1, 40), draw.randint(1, 6)))
        stock = [draw.randint(0, 4) for _ in sizes]
        sums = {0}
        for s, n in zip(sizes, stock):
            sums = {x + s * k for x in sums for k in range(n + 1)}
        budget = draw.randint(0, sum(s * n for s, n in zip(sizes, stock)) + 5)
        take = mixing._knapsack(sizes, stock, budget)
        assert all(0 <= t <= n for t, n in zip(take, stock))
        assert sum(s * int(t) for s, t in zip(sizes, take)) == min(sums, key=lambda x: (abs(x - budget), x))
        fitted = mixing.fit_budget(sizes, stock, budget)
        assert all(0 <= t <= n for t, n in zip(fitted, stock))
        assert abs(sum(s * int(t) for s, t in zip(sizes, fitted)) - min(budget, max(sums))) <= max(sizes)


def test_long_and_distinct_sizes_are_taken_in_proportion():
    import numpy as np

    assert list(mixing.fit_budget([150_000], [1], 140_000)) == [1]
    assert list(mixing.fit_budget([150_000], [1], 70_000)) == [0]
    for low, high in ((1000, 3000), (200_000, 200_800)):
        sizes, seen = np.arange(low, high), []
        for start in (0.0, 0.3, 0.9):
            take = mixing.fit_budget(sizes, np.ones(len(sizes)), int(sizes.sum()) * 2 // 5, start)
            seen.append(tuple(take))
            assert set(take) <= {0, 1} and (sizes * take).sum() == int(sizes.sum()) * 2 // 5
            parts = [p.mean() for p in np.array_split(take, 4)]
            assert max(parts) - min(parts) < 0.05
        assert len(set(seen)) == 3


# --- Jaccard join ---

def brute_components(rows, words=3, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for other, both in Counter(o for e in s for o in where[e]).items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                parent[find(k)] = find(other)
        for e in s:
            where[e].append(k)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return sorted(repr((i, len(sets[k]), min(ids[find(k)], default=None))) for k, (i, _) in enumerate(rows))


def planted():
    """Random texts with copies, near copies at all distances, chains, and near copies whose original is absent."""
    import random

    draw = random.Random(6)
    word = lambda: f"w{draw.randrange(5000)}"
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE Two"), (None, "one two"), (8, "É a b c"), (9, "é a b c")]
    for size in (8, 12, 25, 40, 70, 150, 300):
        base = [word() for _ in range(size)]
        rows += [(1000 + size, " ".join(base))] * 3
        for k in range(40):
            text = list(base)
            for _ in range(k % 8 * max(1, size // 70)):
                text[draw.randrange(len(text))] = word()
            rows.append((2000 + 100 * size + k, " ".join(text)))
        chain = [word() for _ in range(size)]
        for k in range(12):
            chain[(k * 7) % size] = word()
            rows.append((60_000 + 100 * size + k, " ".join(chain)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, documents, words, percent):
    for rows in (planted(), [tuple(r) for r in documents.select("doc_id", "text").collect()]):
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, hub string, fp int")
        got = jaccard_join.jaccard_components(df, words, percent)
        assert sorted(repr(tuple(r)) for r in got.collect()) == brute_components(rows, words, percent)
    assert jaccard_join.jaccard_components(df.limit(0), words, percent).collect() == []


def test_similar_sets_share_a_signature():
    import numpy as np

    draw = np.random.default_rng(1)
    enum = jaccard_join.PartEnum(90)
    pairs = 0
    for _ in range(3000):
        a = np.unique(draw.integers(0, 1 << 63, int(draw.integers(1, 400))).astype(np.uint64))
        few = max(1, len(a) // 9) + 1
        new = draw.integers(0, 1 << 63, int(draw.integers(0, few))).astype(np.uint64)
        b = np.unique(np.concatenate([a[int(draw.integers(0, few)) :], new]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 90 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            pairs += 1
            assert len(np.intersect1d(enum.of(a), enum.of(b)))
    assert pairs > 500


@pytest.mark.parametrize("percent", [90, 80])
def test_links_past_a_hub_equal_brute_force(spark, percent):
    """Members that link to the hub or not; e (1), which x and y alone lack, is the most frequent difference."""
    import random

    draw = random.Random(9)
    hub = frozenset(range(1, 101))
    groups = {0: [hub - {1}, hub - {1, 2, 3, 4, 5} | {201, 202, 203, 204, 205, 206}]}
    for h in range(1, 30):
        pools = draw.sample(sorted(hub), 14), range(300, 314)
        groups[h] = list({hub - set(draw.sample(pools[0], draw.randint(0, 14))) | set(draw.sample(pools[1], draw.randint(0, 14))) for _ in range(12)} - {hub})
    similar = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    rows = [(k, h, len(m), similar(m, hub), sorted(m ^ hub)) for h, ms in groups.items() for k, m in enumerate(ms)]
    found = spark.createDataFrame([(h * 100 + k, h, *rest) for k, h, *rest in rows], "fp long, hub long, size int, linked boolean, apart array<long>")
    want = {frozenset((h * 100 + i, h * 100 + j)) for h, ms in groups.items() for i, a in enumerate(ms) for j, b in enumerate(ms[:i])
            if similar(a, b) and not (similar(a, hub) and similar(b, hub))}
    assert {frozenset(r) for r in jaccard_join.residual_links(found, percent).collect()} == want
    assert percent < 90 or frozenset((0, 1)) in want


def near_group():
    """(fp, hub, size, linked, apart) of 150 members that do not link to their hub, each with four runs of the hub's elements replaced."""
    import random

    draw = random.Random(3)
    rows = []
    for k in range(150):
        gone = {e for at in draw.sample(range(1, 140), 4) for e in range(at, at + 5)}
        rows.append((k, 1000, 146, False, sorted(gone | set(range(10_000 + 100 * k, 10_000 + 100 * k + len(gone))))))
    return rows


def test_members_of_one_component_do_not_meet(spark):
    rows = near_group()
    found = spark.createDataFrame(rows, "fp long, hub long, size int, linked boolean, apart array<long>")
    sets = {r[0]: set(r[4]) for r in rows}
    similar = lambda a, b: 180 * len(sets[a] ^ sets[b]) <= 20 * 2 * 146
    links = {frozenset((a, b)) for a in sets for b in range(a) if similar(a, b)}
    assert {frozenset(r) for r in jaccard_join.residual_links(found, 80).collect()} == links
    joined = spark.createDataFrame([(k, 0) for k in range(1, 140)], "node long, component long")
    part = lambda k: 0 if k < 140 else k
    pairs = [(r.x, r.y) for r in jaccard_join.residual_pairs(found, 80, joined)[1].collect()]
    assert all(part(x) != part(y) for x, y in pairs) and len(pairs) < 1500
    got = {frozenset(r) for r in jaccard_join.residual_links(found, 80, joined).collect()}
    assert got == {frozenset(map(part, pair)) for pair in links if len({*map(part, pair)}) == 2}


def test_groups_with_nothing_to_find_and_elements_of_one_member_are_not_moved(spark, monkeypatch):
    rows = near_group()
    rows += [(2000 + k, 3000 + k, 146, False, list(range(1, 60))) for k in range(20)]  # groups of one
    rows += [(4000 + k, 5000, 146, k > 2, list(range(1, 60))) for k in range(5)]  # a group of one component
    found = spark.createDataFrame(rows, "fp long, hub long, size int, linked boolean, apart array<long>")
    joined = spark.createDataFrame([(4000 + k, 1) for k in range(5)], "node long, component long")
    written = []
    monkeypatch.setattr(jaccard_join, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    jaccard_join.residual_links(found, 80, joined)
    assert {r.hub for r in written[0].select("hub").distinct().collect()} == {1000}
    assert written[1].filter("e >= 10000").count() == 0


def test_one_document_of_each_component_stays(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row int")
    kept = jaccard_join.first_of_each(df)
    assert kept.columns == df.columns
    want = {lead for _, size, lead in map(literal_eval, brute_components(rows)) if size}
    got = [r.doc_id for r in kept.filter(F.coalesce("text", F.lit("")).rlike(r"\S")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert kept.filter(~F.coalesce("text", F.lit("")).rlike(r"\S")).count() == 4


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 50)])
def test_documents_that_stay_equal_brute_force(spark, documents, words, percent):
    for rows in (planted(), [tuple(r) for r in documents.select("doc_id", "text").collect()]):
        kept = jaccard_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
        want = {lead for _, size, lead in map(literal_eval, brute_components(rows, words, percent)) if size}
        got = [r.doc_id for r in kept.filter(F.coalesce("text", F.lit("")).rlike(r"\S")).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_common_passage_gives_unlike_documents_no_signature(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(300)) + " " + passage) for i in range(40)]
    rows += [(100 + i, f"d0w0 {i} " + rows[1][1]) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = materialize(jaccard_join.set_rows(docs, 5, 80, jaccard_join.Prefixes))
    found = jaccard_join.prefix_signatures(sets, 80).join(sets.select("fp", "doc_id"), "fp")
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == {1, 100, 101}


# --- pipeline ---

def test_pipeline_stages(spark, folder, documents):
    docs = documents.withColumn("_row", F.lit("x")).withColumn("size", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        path = f"{checkpoint_root(spark)}/test-{uuid.uuid4().hex}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and 0 < after.count()
        if name != "mixing":
            assert after.count() <= docs.count() and after.exceptAll(docs).count() == 0
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count()
    # nothing is left for the filters to find
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert found.filter("n_hit > 0").count() == 0


def test_pipeline_drops_a_copy_with_one_more_block(spark, folder):
    text = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(text)), (2, " ".join([f"licence{k}" for k in range(40)] + text)), (3, " ".join([f"x{k}" for k in range(100)] + text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()) == [1, 3]


def test_pipeline_of_nothing(spark, folder, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
