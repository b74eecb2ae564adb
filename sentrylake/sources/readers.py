"""Readers for delimited, JSON, syslog and CEF logs. All return string columns."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.text import keyword_ladder
from sentrylake.session import materialize

# --- fixed values: headerless layouts (field order) ---
LAYOUTS = {
    "auth": ["time", "src_user", "dst_user", "src_host", "dst_host", "auth_type", "logon_type", "activity", "result"],
    "process": ["time", "user", "host", "process", "action"],
    "dns": ["time", "src_host", "resolved_host"],
    "flow": ["time", "duration", "src_host", "src_port", "dst_host", "dst_port", "protocol", "packets", "bytes"],
    "labels": ["time", "user", "source_host", "destination_host"],
}
WHOLE = r"^\s*[+-]?\d+\s*$"


def text_lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def numbered_lines(spark: SparkSession, path, separator=None) -> DataFrame:
    """(file, line, value): every line with its number in its file, from 1.

    Splittable files are read in blocks by many tasks. Lines of a block come in
    order, so a block's count (one row a block) gives the number of its first
    line, and the place inside the block the rest; no file is one task's work.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), "value")
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return lines.join(blocks, ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value")


def split_headerless(lines: DataFrame, layout: str, column="value") -> DataFrame:
    """Typed rows of one headerless layout.

    Lines with too few fields or a time that is no whole number are dropped;
    extra fields are ignored.
    """
    names = LAYOUTS[layout]
    parts = F.split(F.trim(F.col(column)), ",")
    wide = lines.select(parts.alias("p")).filter(
        (F.size("p") >= len(names)) & F.element_at("p", 1).rlike(WHOLE)
    )
    fields = [F.col("p")[i].alias(n) for i, n in enumerate(names)]
    return wide.select(F.trim(F.col("p")[0]).try_cast("bigint").alias("time"), *fields[1:]).filter(
        F.col("time").isNotNull()
    )


def read_headerless_csv(spark: SparkSession, path, layout: str, partitions=None) -> DataFrame:
    """Headerless file(s); a gzip file is one task, so spread its rows afterwards."""
    lines = text_lines(spark, path)
    if partitions:
        lines = lines.repartition(partitions)
    return split_headerless(lines, layout)


def canonical_from_layout(rows: DataFrame, layout: str) -> DataFrame:
    """Canonical events of one headerless layout."""
    c, none = F.col, F.lit(None).cast("string")
    named = {
        "auth": dict(user=c("src_user"), source_user=c("src_user"), destination_user=c("dst_user"),
                     source_host=c("src_host"), destination_host=c("dst_host"), action=c("activity"),
                     details=F.concat_ws("|", "auth_type", "logon_type", "result")),
        "process": dict(user=c("user"), source_user=c("user"), source_host=c("host"), process=c("process"),
                        action=c("action"), details=F.concat(F.lit("process="), "process")),
        "dns": dict(source_host=c("src_host"), destination_host=c("resolved_host"), action=F.lit("DNS_QUERY"),
                    details=F.concat(F.lit("resolved="), "resolved_host")),
        "flow": dict(source_host=c("src_host"), destination_host=c("dst_host"), action=F.lit("NETWORK_FLOW"),
                     details=F.concat_ws("|", *[
                         F.concat(F.lit(f"{k}="), k)
                         for k in ("duration", "src_port", "dst_port", "protocol", "packets", "bytes")])),
        "labels": dict(user=c("user"), source_user=c("user"), source_host=c("source_host"),
                       destination_host=c("destination_host"), action=F.lit("LogOn"), details=F.lit("")),
    }[layout]
    label = layout == "labels"
    text = ["user", "source_user", "destination_user", "source_host", "destination_host", "process", "action", "details"]
    return rows.select(
        F.lit("redteam" if label else layout).alias("event_type"),
        c("time").alias("timestamp"),
        *[named.get(n, none).alias(n) for n in text],
        F.lit(int(label)).alias("is_redteam"),
    )


def time_range_scan(rows: DataFrame, start, end, ts="timestamp") -> DataFrame:
    """Half-open slice; adds the day bounds so day-partitioned tables are pruned."""
    cut = (F.col(ts) >= start) & (F.col(ts) < end)
    if "day" in rows.columns:
        cut = cut & F.col("day").between(start // V.DAY_SECONDS + 1, (end - 1) // V.DAY_SECONDS + 1)
    return rows.filter(cut)


def format_of(name, head):
    """The log format by file extension, else by the first characters of the text."""
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    text = F.ltrim(head)
    first_line = F.element_at(F.split(text, "\n"), 1)
    return (
        F.when(ext == "csv", "csv")
        .when(ext.isin("json", "jsonl", "ndjson"), "json")
        .when(text.startswith("{") | text.startswith("["), "json")
        .when(text.startswith("CEF:"), "cef")
        .when(first_line.rlike(V.SYSLOG_PATTERN), "syslog")
        .otherwise("csv")
    )


HEAD_BYTES = 1 << 16


def file_heads(spark: SparkSession, path, size=HEAD_BYTES) -> DataFrame:
    """(file, bytes, head): the first `size` bytes of every file; the rest is not read."""

    def read(batches):
        for batch in batches:
            heads = []
            for name in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as file:
                    heads.append(file.read(size).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.string())], ["file", "bytes", "head"])

    # the content column of the listing is not selected, so it is not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"))
    return files.mapInArrow(read, "file string, bytes long, head string")


def detect_log_format(spark: SparkSession, path) -> DataFrame:
    """(file, format) per file that is not empty, from its name and its first block: the first line that is not blank decides."""
    head = F.regexp_replace("head", r"^\s+", "")
    return file_heads(spark, path).select("file", format_of(F.element_at(F.split("file", "/"), -1), head).alias("format"))


def parse_csv_logs(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def parse_json_logs(lines: DataFrame, schema: str, column="value") -> DataFrame:
    """Objects of JSON lines; a line that holds a list adds its objects; bad lines are dropped.

    For files that are one JSON array each, see `json_array_objects`.
    """
    text = F.trim(F.col(column))
    many = F.from_json(text, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    one = F.from_json(text, f"struct<{schema}>", {"mode": "PERMISSIVE"})
    return (
        # inside brackets a line with anything after its value is malformed too
        lines.filter(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1)
        .select(
            F.explode(
                F.when(text.startswith("["), many).when(text.startswith("{"), F.array(one))
            ).alias("o")
        )
        .filter(F.col("o").isNotNull())
        .select("o.*")
    )


def read_json_logs(spark: SparkSession, path, schema: str, array_files=False) -> DataFrame:
    """Objects of JSON lines, or of files that hold one array each."""
    if array_files:
        return json_array_objects(spark, path).select(F.from_json("value", f"struct<{schema}>").alias("o")).select("o.*")
    return parse_json_logs(spark.read.text(path), schema)


def json_array_objects(spark: SparkSession, path) -> DataFrame:
    """(file, value): the objects of files that are one JSON array each, as texts; no file is held whole.

    Files are split after every closing brace. A piece opens and closes strings
    and braces, and what it does depends on whether it begins inside a string.
    Files are read in blocks by many tasks: a first pass sums up each block for
    both cases, so the block before tells (one row a block) in which state a
    block begins, and a second pass finds where the objects of the array end.
    Only the parts of objects that lie across blocks are moved to be put together.
    """
    plain = F.regexp_replace("value", r"\\.", "")  # without escapes
    opened = lambda text: F.length(text) - F.length(F.replace(text, F.lit("{")))
    outside = lambda text: F.regexp_replace(text, '"[^"]*(?:"|$)', "")
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        (F.length(plain) - F.length(F.replace(plain, F.lit('"')))).alias("_quotes"),
        opened(outside(plain)).alias("_open0"), opened(outside(F.regexp_replace(plain, '^[^"]*(?:"|$)', ""))).alias("_open1"), "value")
    totals = pieces.drop("value").mapInArrow(_block_totals, "file string, _block long, n long, quotes long, depth0 long, depth1 long")
    of_file = W.partitionBy("file").orderBy("_block")
    before = of_file.rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    starts = totals.withColumn("_inside", inside).withColumn("_change", F.when(F.col("_inside") == 1, F.col("depth1")).otherwise(F.col("depth0")))
    # what follows the last brace of a file closes nothing
    taken = F.col("n") - F.when(F.lead("_block").over(of_file).isNull(), 1).otherwise(0)
    starts = starts.select("file", "_block", "_inside", F.coalesce(F.sum("_change").over(before), F.lit(0)).alias("_depth"), taken.alias("_taken"))
    # one row a block; the pieces stay where and in the order in which they are read
    placed = pieces.join(F.broadcast(starts), ["file", "_block"], "left").select(*pieces.columns, "_inside", "_depth", "_taken")
    found = materialize(placed.mapInArrow(_block_objects, "file string, _block long, at long, value string, ends boolean"))
    inner = (F.col("at") > 0) & F.col("ends")
    order = W.partitionBy("file").orderBy("_block", "at").rowsBetween(W.unboundedPreceding, -1)
    parts = found.filter(~inner).withColumn("_object", F.coalesce(F.sum(F.col("ends").cast("int")).over(order), F.lit(0)))
    across = parts.groupBy("file", "_object").agg(F.sort_array(F.collect_list(F.struct("_block", "at", "value"))).alias("_parts"))
    across = across.select("file", F.array_join(F.transform("_parts", lambda p: p["value"]), "}").alias("value"))
    whole = found.filter(inner).select("file", "value").unionAll(across)
    return whole.select("file", F.regexp_replace(F.concat("value", F.lit("}")), r"^[\s,\[]*", "").alias("value"))


def _block_runs(batch):
    """(start, end, (file, block)) of the rows of each block in a batch of pieces."""
    file, block = batch.column(0), batch.column(1)
    n = batch.num_rows
    new = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
    cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    for a, z in zip(cuts, cuts[1:]):
        if a < z:
            yield a, z, (file[a].as_py(), block[a].as_py())


def _changes(quotes, open0, open1, inside):
    """Whether each piece ends inside a string, and its change of depth, for the first one's state."""
    after = (inside + np.cumsum(quotes)) % 2
    begins = (after + quotes) % 2
    return after, np.where(begins == 1, open1, open0) - (1 - after)


def _block_totals(batches):
    held = None
    row = lambda r: pa.RecordBatch.from_arrays(
        [pa.array([r[0]], pa.string()), *[pa.array([v], pa.int64()) for v in r[1:]]], ["file", "_block", "n", "quotes", "depth0", "depth1"])
    for batch in batches:
        numbers = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4)]
        for a, z, key in _block_runs(batch):
            if held is None or tuple(held[:2]) != key:
                if held is not None:
                    yield row(held)
                held = [*key, 0, 0, 0, 0]
            quotes, open0, open1 = [c[a:z] for c in numbers]
            for inside in (0, 1):
                held[4 + inside] += int(_changes(quotes, open0, open1, inside + held[3])[1].sum())
            held[2] += z - a
            held[3] += int(quotes.sum())
    if held is not None:
        yield row(held)


def _block_objects(batches):
    """(file, _block, at, value, ends): texts up to the end of each object, numbered in their block, and what is left behind the last end."""
    key, at, inside, depth, left, held = None, 0, 0, 0, 0, []
    for batch in batches:
        numbers = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4)]
        values, out = batch.column(5).to_pylist(), []
        for a, z, here in _block_runs(batch):
            if here != key:
                if held:
                    out.append((*key, at, "}".join(held), False))
                inside, depth, left = [batch.column(k)[a].as_py() for k in (6, 7, 8)]
                if left is None:
                    raise RuntimeError(f"{here} was split otherwise when it was read first")
                key, at, held = here, 0, []
            after, change = _changes(*[c[a:z] for c in numbers], inside)
            depths = depth + np.cumsum(change)
            inside, depth = int(after[-1]), int(depths[-1])
            stop = a + min(z - a, left)
            left -= stop - a
            ends = ((depths == 0) & (after == 0))[: stop - a]
            for end in (np.flatnonzero(ends) + a + 1).tolist():
                out.append((*key, at, "}".join(held + values[a:end]), True))
                a, at, held = end, at + 1, []
            held += values[a:stop]
        yield _object_rows(out)
    if held:
        yield _object_rows([(*key, at, "}".join(held), False)])


def _object_rows(rows):
    kinds = {"file": pa.string(), "_block": pa.int64(), "at": pa.int64(), "value": pa.string(), "ends": pa.bool_()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def parse_syslog(lines: DataFrame, column="value") -> DataFrame:
    """RFC 3164 lines; a line that does not match becomes `details` of type unknown."""
    line = F.trim(F.col(column))
    part = lambda i: F.regexp_extract(line, V.SYSLOG_PATTERN, i)
    ok = line.rlike(V.SYSLOG_PATTERN)
    pid = part(5)
    return lines.filter(line != "").select(
        F.when(ok, part(2)).alias("timestamp"),
        F.when(ok, part(3)).alias("source_host"),
        F.when(ok, part(4)).alias("process"),
        F.when(ok, F.when(pid != "", F.concat(F.lit("pid="), pid)).otherwise("")).alias("action"),
        F.when(ok, part(6)).otherwise(line).alias("details"),
        F.when(ok, infer_from_program(part(4))).otherwise("unknown").alias("event_type"),
    )


def parse_cef(lines: DataFrame, column="value") -> DataFrame:
    """CEF lines; lines that do not match are dropped."""
    line = F.trim(F.col(column))
    part = lambda i: F.regexp_extract(line, V.CEF_PATTERN, i)
    keys = F.regexp_extract_all("_ext", F.lit(V.CEF_PAIR_PATTERN), 1)
    values = F.regexp_extract_all("_ext", F.lit(V.CEF_PAIR_PATTERN), 2)
    rows = lines.filter(line.rlike(V.CEF_PATTERN)).select(
        *[part(i).alias(n) for i, n in enumerate(
            ["_vendor", "_product", "_version", "_sig", "_name", "_severity", "_ext"], start=1)]
    ).withColumns({"_k": keys, "_v": values})

    def last(*names):
        """The value of the first of `names` that occurs; its last occurrence."""
        found = [
            F.when(
                F.array_contains("_k", n),
                F.trim(F.element_at("_v", (F.size("_k") - F.array_position(F.reverse("_k"), n) + 1).cast("int"))),
            )
            for n in names
        ]
        return F.coalesce(*found, F.lit(""))

    return rows.select(
        infer_from_cef(F.col("_name"), F.col("_sig")).alias("event_type"),
        last("rt", "end", "start").alias("timestamp"),
        last("suser", "duser").alias("user"),
        last("suser").alias("source_user"),
        last("duser").alias("destination_user"),
        last("src", "shost").alias("source_host"),
        last("dst", "dhost").alias("destination_host"),
        last("sproc", "dproc").alias("process"),
        F.col("_name").alias("action"),
        F.format_string("vendor=%s|product=%s|severity=%s|sig=%s", "_vendor", "_product", "_severity", "_sig").alias("details"),
    )


def infer_from_program(program):
    return keyword_ladder(F.lower(program), V.PROGRAM_LADDER, V.PROGRAM_DEFAULT)


def infer_from_cef(name, signature):
    return keyword_ladder(F.lower(F.concat(name, signature)), V.CEF_LADDER, V.SECURITY_DEFAULT)


def infer_from_row(columns):
    return keyword_ladder(F.lower(F.concat_ws(" ", *columns)), V.ROW_LADDER, V.SECURITY_DEFAULT)


def merge_sources(*parts: DataFrame) -> DataFrame:
    """Union of the sources, range-partitioned and sorted by time."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.repartitionByRange("timestamp").sortWithinPartitions("timestamp")


def write_tables(df: DataFrame, path: str, format="parquet", by_day=False, mode="errorifexists") -> None:
    """Large tables: Parquet by day. Reports: CSV or JSON (arrays joined for CSV)."""
    if format == "csv":
        arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
        df = df.select(*[F.array_join(c, ";").alias(c) if c in arrays else F.col(c) for c in df.columns])
        df.write.mode(mode).option("header", True).csv(path)
        return
    if by_day:
        df = df.withColumn("day", (F.floor(F.col("timestamp") / V.DAY_SECONDS) + 1).cast("int"))
        writer = df.repartitionByRange("day", "timestamp").sortWithinPartitions("timestamp").write.partitionBy("day")
    else:
        writer = df.write
    writer.mode(mode).format(format).save(path)
