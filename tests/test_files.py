"""Files read in many blocks, and sampling by threshold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sentrylake.functions.scale import bottom_k_per_group
from sentrylake.operators import explore as E
from sentrylake.sources import readers as R


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_across_blocks(small_blocks, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in ("a.log", "b.log", "empty.log"):
        lines = ["x" * rng.randint(0, 90) + str(i) for i in range(0 if name == "empty.log" else 120)]
        (tmp_path / name).write_text("".join(line + "\n" for line in lines))
        want |= {(name, i + 1): line for i, line in enumerate(lines)}
    found = R.numbered_lines(small_blocks, str(tmp_path))
    assert found.select("file").rdd.getNumPartitions() >= 1
    assert small_blocks.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    rows = found.collect()
    assert {(r.file.split("/")[-1], r.line): r.value for r in rows} == want and len(rows) == len(want)
    assert all(r.sound for r in E.lineage_checks(found).collect())
    twice = found.unionAll(found.limit(1))
    assert [r.sound for r in E.lineage_checks(twice).collect()].count(0) == 1


def test_json_arrays_in_many_blocks(small_blocks, tmp_path):
    rng = random.Random(2)
    odd = ['plain', 'a "quoted" }{ brace', "back\\slash", 'end\\"', "}", "", "[,]"]
    want = []
    for name in ("one.json", "two.json"):
        rows = [{"n": i, "s": rng.choice(odd), "o": {"t": rng.choice(odd), "l": [{"u": rng.choice(odd)}]}} for i in range(60)]
        (tmp_path / name).write_text(json.dumps(rows, indent=rng.choice([None, 2])))
        want += rows
    (tmp_path / "none.json").write_text("[ ]\n")
    got = [json.loads(r.value) for r in R.json_array_objects(small_blocks, str(tmp_path)).collect()]
    key = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert key(got) == key(want)


def test_json_objects_longer_than_a_block(small_blocks, tmp_path):
    want = [{"n": i, "s": "}" * (i % 3) + 'x"{' * (40 * (i % 5) ** 2), "l": [{"u": j} for j in range(i % 7 * 10)]} for i in range(60)]
    (tmp_path / "one.json").write_text(json.dumps(want))
    found = R.json_array_objects(small_blocks, str(tmp_path))
    assert sorted((json.loads(r.value) for r in found.collect()), key=lambda o: o["n"]) == want
    # whole objects are not shuffled: only the parts that lie across blocks
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2


def test_formats_need_the_head_only(spark, tmp_path):
    texts = {"a.log": "\n\n  [1]", "b.log": "CEF:0|a|b|c|d|e|f|x=1\n" + "z" * 200_000, "c.jsonl": "?", "d": "", "e.log": "<34>Jan  1 00:00:07 h sshd[7]: hi"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    heads = {r.file.split("/")[-1]: r for r in R.file_heads(spark, str(tmp_path), 100).collect()}
    assert len(heads["b.log"].head) == 100 and heads["b.log"].bytes == len(texts["b.log"])
    got = {r.file.split("/")[-1]: r.format for r in R.detect_log_format(spark, str(tmp_path)).collect()}
    assert got == {"a.log": "json", "b.log": "cef", "c.jsonl": "json", "e.log": "syslog"}


def test_bottom_k_orders_the_cut_bucket_only(spark):
    rows = spark.range(4000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 != 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    for k in (0, 1, 40, 10_000):
        got = sorted((r.g or "", r.id) for r in bottom_k_per_group(rows, ["g"], "h", ["id"], k, digits=1).collect())
        by = {}
        for r in rows.collect():
            by.setdefault(r.g or "", []).append((r.h, r.id))
        assert got == sorted((g, i) for g, v in by.items() for _, i in sorted(v)[:k])
    plan = bottom_k_per_group(rows, ["g"], "h", ["id"], 65_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 3


def test_hosts_are_ranked_by_new_destinations(spark, make_events):
    edge = lambda t, s, d: {"event_type": "auth", "timestamp": t, "source_host": s, "destination_host": d}
    rows = [edge(10, "a", f"h{i}") for i in range(30)] + [edge(100, "a", f"h{i}") for i in range(30)]
    rows += [edge(100, "b", f"h{i}") for i in range(5)] + [edge(100, "b", "h0"), edge(10, "c", "h1"), edge(100, None, "h1"), edge(100, "d", None)]
    got = [tuple(r) for r in E.top_anomalous_hosts(make_events(rows), 50, 2).collect()]
    assert got == [("b", 5, 5, 6), ("a", 0, 30, 30)]


def test_formats_are_told_for_every_event(spark, folder):
    from sentrylake.plans.catalog import QUERIES

    rows = QUERIES["detect_log_format"](spark, folder)
    assert rows.select("event_id").distinct().count() == spark.read.parquet(f"{folder}/events.parquet").count()
