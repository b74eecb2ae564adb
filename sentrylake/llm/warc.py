"""WARC archives: index first, then coalesced byte-range reads.

Writing gives gzip-per-record archives in the shared folder, and with them the
index: file, offset, length, URL and digest of every record. Only index rows of
finished tasks count, so files that a lost attempt left behind are never read.
Reading takes any selection of index rows, sorts it by place, joins ranges that
lie close together into one request, and cuts the records out of it.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentrylake.llm.common import SLICE, bit_table, short_batches, with_maybe
from sentrylake.session import checkpoint_root, materialize

REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 64 << 20
LEVEL = 4
FILTER_BITS = 22
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, url string, digest string, record_id string, record_type string, page_id long, refers_to_id string"
_INDEX = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (c.split() for c in INDEX.split(", "))])
_CONTROL = re.compile("[\x00-\x20\x7f]")


def open_folder(root):
    """The file system of a folder and the path in it; `root` is a URI or an absolute path."""
    return fs.FileSystem.from_uri(root)


def record_of(row, record_id, refers_to_id):
    """The bytes of one WARC record of a page; a revisit has the HTTP header but no payload."""
    payload = b"" if refers_to_id else (row["html"] or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["size"]
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to_id else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if row["page_id"] is not None:
        head.append(f"Page-ID: {row['page_id']}")
    if refers_to_id:
        head += [f"WARC-Refers-To: <{refers_to_id}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}", "", "",
    ]
    return "\r\n".join(head).encode() + http + payload + b"\r\n\r\n"


def parse_record(data):
    """(header fields in lower case, payload) of the bytes of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def decide_records(pages, revisit_bytes=REVISIT_BYTES):
    """The pages with size, digest and, in groups of equal payloads, the leader's key; a null html is empty.

    Of equal payloads of at least `revisit_bytes`, the row with the largest
    page_id (null smallest; then the largest url) leads; of rows equal in these
    too, one does. Adds `leader` (key of the leading record, null outside
    groups) and `leads`.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html").withColumns({
        "size": F.octet_length(payload).cast("long"), "digest": F.sha1(payload), "_check": F.xxhash64(payload)})
    same = ["digest", "_check", "size"]
    counted = rows.filter(F.col("size") >= revisit_bytes).groupBy(*same, "page_id", "url").agg(F.count("*").alias("_n"))
    key = F.struct("page_id", "url", "_n")
    groups = materialize(
        counted.groupBy(*same).agg(F.max(key).alias("_lead"), F.sum("_n").alias("_all")).filter("_all > 1").drop("_all"))
    # most pages are in no group: they are told by a bit set and need no shuffle
    table = bit_table(groups.select(F.col("_check").alias("hash")), FILTER_BITS)
    rows = with_maybe(rows, F.col("_check"), table, FILTER_BITS)
    names = ["page_id", "url", "html", "size", "digest", "leader", "leads"]
    alone = rows.filter("not _maybe").withColumns({"leader": F.lit(None).cast("string"), "leads": F.lit(False)}).select(*names)
    found = rows.filter("_maybe").join(groups, same, "left")
    first = F.col("page_id").eqNullSafe(F.col("_lead.page_id")) & F.col("url").eqNullSafe(F.col("_lead.url"))
    name = F.md5(F.concat_ws("\n", "digest", F.col("_lead.page_id").cast("string"), "_lead.url"))
    found = found.withColumn("leader", F.when(F.col("_lead").isNotNull(), name))
    several = F.coalesce(F.col("_lead").isNotNull() & first & (F.col("_lead._n") > 1), F.lit(False))
    sure = found.filter(~several).withColumn("leads", F.coalesce(first & F.col("_lead").isNotNull(), F.lit(False))).select(*names)
    number = F.row_number().over(Window.partitionBy("leader").orderBy("page_id"))
    tied = found.filter(several).withColumn("leads", number == 1).select(*names)
    return alone.unionAll(sure).unionAll(tied)


def write_archives(pages, root, revisit_bytes=REVISIT_BYTES, file_bytes=FILE_BYTES):
    """Write a record for every page under `root`; returns the written index."""

    def write(batches):
        system, folder = open_folder(root)
        system.create_dir(folder, recursive=True)
        out = name = None
        offset = 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                index = []
                for row in batch.slice(start, SLICE).to_pylist():
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, offset = system.open_output_stream(f"{folder}/{name}", compression=None), 0
                    own = row["leader"] if row["leads"] else hashlib.md5(f"{name} {offset}".encode()).hexdigest()
                    refers = f"urn:uuid:{uuid.UUID(row['leader'])}" if row["leader"] and not row["leads"] else None
                    record_id = f"urn:uuid:{uuid.UUID(own)}"
                    member = zlib.compress(record_of(row, record_id, refers), LEVEL, 31)
                    out.write(member)
                    kind = "revisit" if refers else "response"
                    index.append((name, offset, len(member), row["url"], row["digest"], record_id, kind, row["page_id"], refers))
                    offset += len(member)
                    if offset >= file_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    short_batches(pages.sparkSession, "100")  # pages may be long
    return materialize(decide_records(pages, revisit_bytes).mapInArrow(write, INDEX))


_READ = "record_id string, record_type string, page_id long, refers_to_id string, url string, payload_bytes long, payload_digest string, payload binary"


def read_records(index, root, payloads=True, gap_bytes=GAP_BYTES, range_bytes=RANGE_BYTES, task_bytes=TASK_BYTES):
    """The records of the selected index rows, from the archives; a revisit has no payload of its own (null).

    Raises where a payload does not match the digest in its record.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in _READ.split(", "))])

    def cut(data, base, places):
        found = []
        for offset, length in places:
            fields, payload = parse_record(zlib.decompress(data[offset - base : offset - base + length], 31))
            whole = fields["warc-type"] == "response"
            digest = hashlib.sha1(payload).hexdigest() if whole else None
            stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            if whole and digest != stated:
                raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
            page = fields.get("page-id")
            found.append((
                fields["warc-record-id"][1:-1], fields["warc-type"], int(page) if page else None,
                fields["warc-refers-to"][1:-1] if not whole else None, fields.get("warc-target-uri"),
                len(payload) if whole else None, digest, payload if payloads and whole else None,
            ))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    def read(batches):
        system, folder = open_folder(root)
        for name, base, end, places in ranges(batches, gap_bytes, range_bytes):
            with system.open_input_file(f"{folder}/{name}") as file:
                file.seek(base)
                yield cut(file.read(end - base), base, places)

    places = index.select("file", "offset", "length")
    # index rows are short, so their own size says nothing: as many tasks as the archives' bytes need
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(total // task_bytes, min(total // range_bytes + 1, index.sparkSession.sparkContext.defaultParallelism))
    return places.repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, _READ)


def ranges(batches, gap_bytes, range_bytes):
    """Requests (file, start, end, [(offset, length)]) from rows sorted by place; gaps up to `gap_bytes` are read along."""
    name, base, end, places = None, 0, 0, []
    for batch in batches:
        for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            near = file == name and offset - end <= gap_bytes and offset + length - base <= range_bytes
            if places and not near:
                yield name, base, end, places
                places = []
            if not places:
                name, base = file, offset
            places.append((offset, length))
            end = offset + length
    if places:
        yield name, base, end, places


def index_archives(spark, root, names):
    """The index of gzip-per-record archives that came from elsewhere: one pass over each file, a record at a time."""

    def scan(batches):
        system, folder = open_folder(root)
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with system.open_input_stream(f"{folder}/{name}", compression=None) as file:
                yield from scan_members(file, name)

    return spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names))).mapInArrow(scan, INDEX)


def scan_members(file, name):
    offset, data = 0, file.read(1 << 20)
    while data:
        member, out, length = zlib.decompressobj(31), [], 0
        while not member.eof:
            out.append(member.decompress(data))
            length += len(data) - len(member.unused_data)
            data = member.unused_data or file.read(1 << 20)
            if not data and not member.eof:
                raise ValueError(f"{name} ends inside a record")
        fields, _ = parse_record(b"".join(out))
        page, refers = fields.get("page-id"), fields.get("warc-refers-to")
        row = (
            name, offset, length, fields.get("warc-target-uri"),
            base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), fields["warc-record-id"][1:-1],
            fields["warc-type"], int(page) if page else None, refers[1:-1] if refers else None,
        )
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX)], schema=_INDEX)
        offset += length


def resolve_revisits(records):
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take them from the response they name."""
    whole = records.filter("record_type = 'response'")
    target = whole.select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(target, "refers_to_id")
    return whole.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionAll(revisits.select(*names))


def op2(spark, folder):
    root = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(spark.read.parquet(f"{folder}/pages.parquet"), root)
    return resolve_revisits(materialize(read_records(index, root, payloads=False).drop("payload")))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS r FROM pages),
g AS (
  SELECT *, CAST(octet_length(encode(h)) AS BIGINT) AS n,
         row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r) AS k,
         first_value(page_id) OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r) AS lead FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND k > 1 THEN lead END AS refers_to
FROM g
"""
