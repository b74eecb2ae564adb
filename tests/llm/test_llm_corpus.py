"""Source audit, clustering on bit planes and suffix-array removal: against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sentrylake.llm import plane_clusters, source_audit, suffix_dedup, toxicity, warc
from sentrylake.session import checkpoint_root


# --- suffix-array removal ---

def brute_spans(rows, length):
    """(doc_id, text) -> removed runs, by the definition; rows of one doc_id by the given order of texts."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        hit = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                hit[s : s + length] = True
            seen.add(data[s : s + length])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(int), [0]))))
        out.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])])
    return out


def words(rng, n, size=40):
    return " ".join("".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 9))) for _ in range(n)) if size else ""


def passages():
    rng = random.Random(3)
    shared = [words(rng, 60) for _ in range(4)]
    rows = [(1, words(rng, 80)), (2, None), (3, ""), (4, "a" * 900), (5, "ab" * 300 + "tail"), (6, "short"), (7, "x" * 99), (8, "x" * 100), (9, "x" * 101)]
    for i in range(10, 40):
        parts = [words(rng, rng.randint(1, 40)), rng.choice(shared), words(rng, rng.randint(1, 40))]
        if i % 3 == 0:
            parts += [rng.choice(shared)[rng.randint(0, 60):], parts[0]]
        rows.append((i, " ".join(parts)))
    rows += [(40, rows[15][1]), (41, rows[15][1]), (42, rows[15][1] + " more"), (43, "a" * 901), (44, "\0\x01\x7f" * 90), (45, "\0\x01\x7f" * 60)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"hot": 1, "block": 1, "chunk": 150}, {"block": 3000, "chunk": 101}])
def test_removed_runs(spark, limits):
    rows = passages()
    # a null id comes last; a row that repeats id and text is answered like the first
    given = [*rows, (None, rows[20][1] + " and its own end " + rows[21][1]), rows[12]]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in given], "doc_id long, text string, doc int, key string").repartition(5)
    want = {i: s for (i, _), s in zip(given, brute_spans(given[:-1], 100))}
    got = suffix_dedup.cut_repeats(docs, **limits).collect()
    assert len(got) == len(given)
    texts = dict(given)
    for row in got:
        data = (texts[row.doc_id] or "").encode()
        spans = [tuple(s) for s in row.spans]
        assert spans == want[row.doc_id], row.doc_id
        kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[b for b, _ in spans], len(data)]))
        assert (bytes(row.kept), row.n_bytes) == (kept, len(data))


def test_one_id_with_several_texts(spark):
    rng = random.Random(8)
    shared = words(rng, 80)
    rows = [(1, words(rng, 9) + shared), (1, words(rng, 5) + shared), (1, shared + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r.text.decode(): r.tie for r in suffix_dedup.document_rows(docs).collect()}
    rows.sort(key=lambda r: tie[r[1]])
    got = {bytes(r.kept): [tuple(s) for s in r.spans] for r in suffix_dedup.cut_repeats(docs).collect()}
    assert sorted(got.values()) == sorted(brute_spans(rows, 100)) and sum(map(bool, got.values())) == 2


def test_removal_from_an_empty_table_and_a_long_text(spark):
    assert suffix_dedup.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, body[:5000]), (2, body + body[1_000_000:1_000_300])], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.cut_repeats(docs).select("doc_id", "spans").collect()}
    assert got == {1: [], 2: [(0, 5000), (3_000_000, 3_000_300)]}


def test_suffix_order():
    rng = random.Random(4)
    for n, letters in ((1, "a"), (40, "a"), (300, "ab"), (2000, "abcd"), (500, "abé")):
        segments = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))).encode() for _ in range(n // 10 + 1)]
        text = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8)
        order = suffix_dedup.suffix_order(text, 40)
        assert sorted(order) == list(range(len(text)))
        strings = [text.tobytes()[i:].split(b"\0")[0] for i in order]
        assert strings == sorted(strings)


# --- toxicity of long texts, archives in many tasks ---

def test_length_alone_is_not_toxic(spark):
    model = {"": -8.2, "vile": 9.0, "nice": -2.0, "odd": 0.001}
    clean, nice = "Some neutral words here. " * 50_000, "A nice day. " * 50_000
    docs = spark.createDataFrame([(1, clean), (2, nice), (3, clean + "How vile! " + clean), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.predicted, len(r.offending)) for r in toxicity.score_toxicity(docs, model).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (0, 0)}


def test_archives_are_read_by_as_many_tasks_as_their_bytes_need(spark):
    rng = np.random.default_rng(3)
    long = [rng.integers(32, 127, 300_000, dtype=np.uint8).tobytes().decode() for _ in range(6)]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(long)], "page_id long, url string, html string")
    root = f"{checkpoint_root(spark)}/long-{len(long)}-{rng.integers(1 << 40)}"
    index = warc.write_archives(pages, root)
    records = warc.read_records(index, root, range_bytes=400_000, task_bytes=500_000)
    assert records.rdd.getNumPartitions() >= 3
    assert {r.page_id: bytes(r.payload).decode() for r in records.collect()} == dict(enumerate(long))


# --- bit planes ---

def test_dot_products_and_planes():
    rng = np.random.default_rng(5)
    for places in (2, 9, 25, 29):
        low = 1 << (places - 1)
        x, y = rng.integers(-low, low, (50, 64)), rng.integers(-low, low, (7, 64))
        a, b = plane_clusters.pack(x, places), plane_clusters.pack(y, places)
        assert (plane_clusters.unpack(a) == x).all()
        assert (plane_clusters.dot_products(a, b) == x @ y.T).all()


def brute_clusters(rows, count, rounds):
    kept = [(i, [math.floor(256 * v) for v in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:count]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[near(x)[1]].append(x)
        for k, xs in members.items():
            centroids[k] = [sum(c) // len(xs) for c in zip(*xs)]
    return sorted(repr((i, near(x)[1], near(x)[0])) for i, x in kept), centroids


def test_clusters(spark):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.4) + (i % 5))) for _ in range(64)]) for i in range(150)]
    rows += [rows[0], (7, rows[9][1]), (None, rows[3][1]), (500, None), (501, [0.5] * 63), (502, []), (503, [0.1] * 63 + [None]),
             (504, [float("nan")] + [0.0] * 63), (505, [float("inf")] * 64), (506, [-100.25] * 64), (507, [0.0] * 64)]
    schema = "vec_id long, embedding array<float>, cluster string, x int"
    vectors = spark.createDataFrame([(i, e, "c", 1) for i, e in rows], schema).repartition(3)
    for count in (40, 3):
        want, centers = brute_clusters(rows, count, 5)
        found, centroids = plane_clusters.cluster_vectors(vectors, count)
        assert sorted(repr(tuple(r)) for r in found.collect()) == want
        assert {r.cluster: r.centroid for r in centroids.collect()} == dict(enumerate(centers))
    few, _ = plane_clusters.cluster_vectors(vectors.filter("vec_id < 5"))
    assert {(r.vec_id, r.distance) for r in few.collect()} == {(i, 0) for i in range(5)}
    for part in plane_clusters.cluster_vectors(vectors.filter("vec_id = 501")):
        assert part.collect() == []
    with pytest.raises(Exception, match="2\\*\\*27"):
        plane_clusters.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>"))


# --- source audit ---

def brute_audit(rows, least=3, top=200):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for t, g, s in rows]
    df, counts = Counter(), defaultdict(Counter)
    for lang, source, found in docs:
        df.update({(lang, w) for w in found})
        counts[lang, source].update(found)
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    for lang in {g for g, _ in counts}:
        kept = {w for (g, w), n in df.items() if g == lang and n >= least}
        own = {s: Counter({w: n for w, n in c.items() if w in kept}) for (g, s), c in counts.items() if g == lang}
        total = sum(own.values(), Counter())
        p = {s: {w: share(c[w], sum(c.values()), len(kept)) for w in kept} for s, c in own.items()}
        q = {w: share(total[w], sum(total.values()), len(kept)) for w in kept}
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            pairs = sorted((-sum(gap(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in own if t != s)
            out += [(lang, s, "pair", t, -v, k + 1) for k, (v, _, t) in enumerate(pairs)]
            terms = sorted((-gap(p[s][w], q[w]), w.encode(), w) for w in kept if own[s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(terms[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(12)
    terms = [f"{a}{b}" for a in ("Alpha", "beta", "gÄm", "漢字", "𝒳y", "ÀB") for b in ("", "x", "yz", "q", "ю")]
    rows = [(" ".join(rng.choices(terms, range(1, len(terms) + 1), k=rng.randint(0, 30))) + " 1.5_z-", rng.choice(["en", "de", None]),
             rng.choice(["web", "Book", "ünx", None, ""])) for _ in range(80)]
    rows += [(None, "en", "web"), ("", "xx", "lone"), ("only once here", "yy", "a"), ("7 8", "yy", "b"), (" alphA\x00 BETA\x7fx ", "en", "Book"),
             ("long " * 300_000, "en", "web"), rows[0], rows[0]]
    return rows


def test_audit(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, count int, term string").repartition(4)
    got = lambda **k: sorted(tuple(r) for r in source_audit.audit_sources(docs, **k).collect())
    want = brute_audit(rows)
    assert got() == want
    assert got(held=9) == want  # sums passed on often
    assert got(terms=2) == brute_audit(rows, top=2)
    few = docs.limit(2)
    assert {r.value for r in source_audit.audit_sources(few).collect()} <= {0}
    assert source_audit.audit_sources(docs.limit(0)).collect() == []


def test_shared_terms_are_added_up_before_the_shuffle(spark):
    rows = [("en", s, f"alpha beta beta {s}") for s in "abc" for _ in range(3)]
    plan = source_audit.audit_sources(spark.createDataFrame(rows, "lang string, source string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "p_a#" in line]
