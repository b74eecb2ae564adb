"""Token counts, token output, secrets, line rules, classifiers: against brute force, libraries and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sentrylake.llm import line_rules, quality_model, secret_scan, token_counts, token_output, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and further columns with the operators' own names."""
    long = "word " * 60_000 + "z" * 50_000
    rows = [(1, None), (1, None), (None, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, " \n\t "), (4, long), (5, "é" * 3000 + " 日本 x")]
    return spark.createDataFrame([(i, t, k, "s", 0.5) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, n_words int, _key string, score double")


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def rows_of(df, *names):
    return sorted(map(repr, [tuple(r) for r in df.select(*names).collect()]))


PIECES = [" ", "  ", "\n", "a", "the", "'s", "'LL", "<|endoftext|>", "<|endo", "É", "日本", "12", "²", "\x1c", "\x85", "　", "🙂", "՘",
          "!", "...", "zzqx", "́", "\t", "İ", "ſ"]


def odd_strings(count, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 12))) for _ in range(count)]


def test_token_counts_equal_library(documents, odd):
    vocabulary = token_counts.read_vocabulary("byte_bpe_50k.json")
    library = tokenizer("byte_bpe_50k.json")
    for df, chunk in ((documents, token_counts.CHUNK), (odd, 1000)):
        want = sorted(repr((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)))
                      for i, t in df.select("doc_id", "text").collect())
        assert rows_of(token_counts.count_tokens(df, vocabulary, chunk), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.count_tokens(odd.limit(0), vocabulary).collect() == []


def test_transducer_maps_compose_at_any_cut():
    counter = token_counts.counter_of(token_counts.read_vocabulary("byte_bpe_50k.json"))
    library = tokenizer("byte_bpe_50k.json")
    for k, text in enumerate(odd_strings(3000, 3)):
        want, size = len(library.encode(text, add_special_tokens=False).ids), k % 6 + 1
        assert counter.of_text(text) == want, text
        assert counter.scan([counter.map_of(text[i : i + size]) for i in range(0, max(1, len(text)), size)]) == want, text


def test_transducer_restart_keeps_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 20)
    monkeypatch.setattr(token_counts, "MEMO", 5)
    counter = token_counts.SegmentCounts(token_counts.Transducer(token_counts.read_vocabulary("byte_bpe_50k.json")))
    library = tokenizer("byte_bpe_50k.json")
    for text in odd_strings(200, 4):
        assert counter.of_text(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_output_round_trip(documents, odd):
    library = tokenizer("word_bpe_49k.json")
    for df in (documents, odd):
        texts = df.select("doc_id", "text").collect()
        crcs = Counter()
        for i, t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids + [2]
            crcs[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        got = sorted(token_output.token_table(df).collect(), key=lambda r: r.start)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crcs
        assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]]).tolist()[:-1]
        order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert order == sorted(order)
    assert token_output.token_table(odd.limit(0)).collect() == []


def test_word_ids_equal_library_on_odd_strings():
    encoder, library = token_output.encoder_of(token_output.read_spec("word_bpe_49k.json")), tokenizer("word_bpe_49k.json")
    for text in odd_strings(3000, 5):
        assert np.frombuffer(encoder.of_text(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_have_set_encodings(documents, spark, tmp_path):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/ids"
    token_output.write_ids(documents, token_output.read_spec("word_bpe_49k.json"), path)
    file = max(pq.ParquetDataset(path).files, key=lambda f: pq.ParquetFile(f).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    found = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in found["doc_id"].encodings
    assert "RLE_DICTIONARY" in found["ids.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in found.values())
    plan = token_output.read_ids(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def brute_base(text):
    """The fixed patterns as written in the rule, failing matches dropped."""
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_base_spans(documents, odd, spark):
    tricky = spark.createDataFrame([
        (1, 'token=abc password: token:abcdefgh API_KEY = "x1y2z3w4v5"'), (2, "AKIAAKIA1234 AKIA" + "Q" * 12 + " AKIA" + "B" * 11),
        (3, "0" * 31 + " " + "ab" * 16 + "g" + "f" * 32), (4, "paſſword=12345678 toKen=123456789"),
    ], "doc_id long, text string")
    for df in (documents, odd, tricky):
        want = []
        for i, t in df.select("doc_id", "text").collect():
            base = brute_base(t or "")
            text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base)
            counts = Counter(k for _, k, _, _ in base)
            want.append(repr((i, counts[0], counts[1], counts[2], hashlib.sha256(text.encode()).hexdigest())))
        assert rows_of(secret_scan.scan_secrets(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)


def test_novelty_finds_random_strings_only():
    draw = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(draw.choice(letters) for _ in range(40))
    novelty = secret_scan.Novelty()
    text = f"the deploy bearer {key} is live. the cookie xxxxxxxxxxxxxxxx1111111111 is a placeholder. plain words here, the same key {key}"
    found = secret_scan.novel_spans(text, [], novelty)
    assert [text[a:b] for a, _, b in found] == [key, key]
    assert secret_scan.novel_spans("no context " + key, [], novelty) == []
    assert secret_scan.novel_spans(text, [(0, 0, len(text))], novelty) == []


def brute_rules(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = len(hit)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed)


def test_line_rules(documents, labels, odd):
    model = line_rules.train_lines(documents, labels)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (documents, odd):
        got = line_rules.apply_rules(df, model)
        assert rows_of(got, *names) == sorted(repr((i, *brute_rules(t or ""))) for i, t in df.select("doc_id", "text").collect())
        assert not [r for r in got.collect() if r.kept and r.base_failed]
    judged = line_rules.apply_rules(documents, model).join(labels, "doc_id").filter("not base_failed and quality is not null").collect()
    assert np.mean([r.kept == bool(r.quality) for r in judged]) > 0.95
    assert line_rules.apply_rules(odd.limit(0), model).collect() == []


def test_viterbi_equals_all_paths():
    from itertools import product

    draw = random.Random(7)
    weights = [[draw.uniform(-2, 2) for _ in line_rules.LINE_FEATURES] for _ in range(2)]
    moves = [[draw.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
    for n in range(1, 8):
        lines = [(draw.sample(range(len(line_rules.LINE_FEATURES)), 3), 5) for _ in range(n)]
        score = lambda path: sum(sum(weights[s][f] for f in on) for (on, _), s in zip(lines, path)) + sum(
            moves[a][b] for a, b in zip(path, path[1:]))
        best = max(product((0, 1), repeat=n), key=score)
        assert line_rules.viterbi(lines, weights, moves) == list(best)
        own, pairs = line_rules._marginals(lines, weights, moves)
        mass = {p: np.exp(score(p)) for p in product((0, 1), repeat=n)}
        total = sum(mass.values())
        assert own[0][1] == pytest.approx(sum(m for p, m in mass.items() if p[0]) / total)
        assert pairs[0, 1] == pytest.approx(sum(m * sum(x == (0, 1) for x in zip(p, p[1:])) for p, m in mass.items()) / total)


def auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1
    truth = np.array(truth)
    n = truth.sum()
    return (order[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def held_out_auc(spark, query, name, parts, out):
    folder = "/root/testdata/sf0.01"
    found = query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    kept = [r for r in found if r.held_out and r[name] is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == out) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    return auc([r.score for r in kept], [r[name] for r in kept])


def test_toxicity_on_held_out_labels(spark):
    assert held_out_auc(spark, toxicity.op4, "toxic", 5, 0) > 0.85


def test_quality_on_held_out_labels(spark):
    assert held_out_auc(spark, quality_model.op6, "quality", 3, 1) > 0.95


def test_classifiers_on_odd_rows(documents, labels, odd, spark):
    tox, qual = toxicity.train_toxicity(documents, labels), quality_model.train_quality(documents, labels)
    for scored in (toxicity.score_toxicity(odd, tox), quality_model.score_quality(odd, qual)):
        rows = scored.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score_toxicity(odd.filter("text is null"), tox).collect()} == {0.0}
    assert toxicity.score_toxicity(odd.limit(0), tox).collect() == []
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(odd, toxicity.train_toxicity(odd, no_labels)).count() == odd.count()
    assert quality_model.score_quality(odd, quality_model.train_quality(odd, no_labels)).count() == odd.count()


def test_toxicity_locates_the_sentence():
    texts = [f"calm words number{k} here. more calm text. " for k in range(200)]
    rows = [{"doc_id": k, "text": t + ("you utter blockhead friend. " if k % 2 else "") + "the end.", "toxic": k % 2} for k, t in enumerate(texts)]
    batch = toxicity.fit(iter(rows))
    model = dict(zip(batch["word"].to_pylist(), batch["weight"].to_pylist()))
    text = "calm words here. you utter blockhead friend. the end."
    bias = model[""]
    sums = [bias + sum(model.get(f, 0) for w in toxicity.words_of(text[a:b]) for f in toxicity.features_of(w)) for a, b in toxicity.sentences_of(text)]
    assert sums[1] > 0 > max(sums[0], sums[2])
