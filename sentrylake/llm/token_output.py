"""Token ids as Parquet list columns.

Documents are dealt by ranges of doc_id, encoded in their range and written by
Spark's Parquet writer: one row per document with its ids, in ascending order
of doc_id over the files and inside them. Ids are dictionary-encoded (a vocabulary fits
a dictionary page), the ascending doc_id delta-encoded; row groups and pages have set sizes, and the page
indexes of the format let a reader fetch single documents, or the small
columns without any ids.
"""

import re
import uuid
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentrylake.llm.common import short_batches, texts_of
from sentrylake.llm.token_counts import byte_alphabet
from sentrylake.session import checkpoint_root

END = 2
MEMO = 250_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10

# white space ends a word for the tokenizer; it takes U+001C to U+001F, which Python calls white space too, for marks
_GAP = re.compile(r"[^\S\x1c-\x1f]+")
_MARK = re.compile("[\x1c-\x1f]")
# a special string may begin here, or a character beyond the plain ones
_OTHER = re.compile(r"<\||[^\x00-\u024f]")
# fixed values: the split of the word vocabulary, and the names of bytes in byte-level vocabularies
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BYTE_NAMES = byte_alphabet()


class PieceIds(dict):
    """Piece in lower case -> its ids as little-endian 32-bit integers, by the library's model; up to MEMO pieces."""

    def __init__(self, tokenizer):
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, piece):
        if len(self) >= MEMO:
            self.clear()
        if not piece.isascii() or not piece.isprintable():
            name = piece.encode().decode("latin-1").translate(_BYTE_NAMES)
        else:
            name = piece
        found = self[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(name)])
        return found


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit integers; up to MEMO words.

    Words are brought to lower case and split into pieces as the tokenizer file
    says: here where that is plain (letters up to U+024F, which are composed
    already and change case one by one), by the whole tokenizer elsewhere.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.pieces = tokenizer, PieceIds(tokenizer)

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        if _OTHER.search(word):
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            lowered, pieces = word.lower(), self.pieces
            if lowered.isalpha():
                found = pieces[lowered]
            elif lowered[:-1].isalpha() and lowered[-1] in ".,":
                found = pieces[lowered[:-1]] + pieces[lowered[-1]]
            else:
                found = b"".join(map(pieces.__getitem__, _PIECE.findall(lowered)))
        self[word] = found
        return found

    def of_text(self, text):
        """The ids of a text."""
        words = _GAP.split(text) if _MARK.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


_ENCODERS = {}


def encoder_of(spec):
    """The encoder of a tokenizer file, kept by the Python worker between tasks."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _ENCODERS[spec] = WordIds(tokenizer)
    return _ENCODERS[spec]


def encode_ids(documents, spec, end=END):
    """doc_id, ids: the ids of each whole text (null: empty) with `end` appended."""
    short_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(spec)
    tail = np.array([end], "<u4").tobytes()

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        encoder = encoder_of(shared.value)
        offsets, encoded = np.zeros(len(column) + 1, np.int32), bytearray()
        for k, text in enumerate(texts_of(column)):
            encoded += encoder.of_text(text)
            encoded += tail
            offsets[k + 1] = len(encoded) // 4
        values = pa.Array.from_buffers(pa.int32(), len(encoded) // 4, [None, pa.py_buffer(encoded)])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return documents.select("doc_id", ids("text").alias("ids"))


def write_ids(documents, spec, path, end=END):
    """Write the ids in ascending doc_id order (null first; equal ids in the order of their texts' hashes).

    Columns: doc_id, n_tokens, slice (the file, in order), ids.
    """
    order = ("doc_id", "_text")
    dealt = documents.select("doc_id", "text", F.xxhash64("text").alias("_text")).repartitionByRange(*order)
    sliced = dealt.sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())
    numbered = sliced.select(F.struct("doc_id", "slice").alias("doc_id"), "text")
    rows = encode_ids(numbered, spec, end).select(
        "doc_id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "doc_id.slice", "ids")
    (
        rows.write.option("parquet.writer.version", "PARQUET_2_0")  # delta encoding where no dictionary is kept
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", 1024).option("parquet.page.write-checksum.enabled", "true")
        .option("compression", "zstd").parquet(path)
    )


def read_ids(spark, path):
    """The written rows; select single columns to read only them."""
    return spark.read.schema("doc_id long, n_tokens long, slice int, ids array<int>").parquet(path)


def summarize_ids(spark, path):
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    @F.arrow_udf("struct<n:long,crc:long>")
    def measured(column: pa.Array) -> pa.Array:
        found = []
        for ids in column:
            data = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            found.append((len(data) // 4, crc32(data)))
        n, crc = zip(*found) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["n", "crc"])

    slices = read_ids(spark, path).groupBy("slice").agg(F.sum("n_tokens").alias("_n"))  # reads no ids
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rows = read_ids(spark, path).select(
        "doc_id", "slice", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"),
        measured("ids").alias("_m"))
    inside = Window.partitionBy("slice").orderBy("_file", "_row").rowsBetween(Window.unboundedPreceding, 0)
    total = rows.withColumn("_end", F.sum("_m.n").over(inside)).join(F.broadcast(offsets), "slice")  # one row a file
    return total.select(
        "doc_id", (F.col("_offset") + F.col("_end") - F.col("_m.n")).alias("start"), F.col("_m.n").alias("n_tokens"),
        F.col("_m.crc").alias("ids_crc32"))


def read_spec(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def token_table(documents):
    """Write the ids of documents to the shared folder, and the summary read back from there."""
    spark = documents.sparkSession
    path = f"{checkpoint_root(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(documents, read_spec("word_bpe_49k.json"), path)
    return summarize_ids(spark, path)


def op5(spark, folder):
    return token_table(spark.read.parquet(f"{folder}/documents.parquet"))
