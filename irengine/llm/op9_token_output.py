"""Operator 9, token-ID output: ORC stripes that hold each document's ids.

Documents are dealt out by doc_id in ranges and sorted, and each task encodes its range and writes it as ORC: integers run-length encoded, row indexes per stride,
a Bloom filter on doc_id, so that readers split a file by stripes and skip
stripes by metadata. The read side takes the ids from the files alone.

A text is cut by the vocabulary's own split into pre-tokens, which encode independently. They are looked up in a
worker's cache; what is not there goes to the library's model, in the byte alphabet that its pre-tokenizer would write it in. Texts
with characters outside the Latin range or with a special token's string are encoded whole by the library, so
that results are the library's in every case.

Null or empty text: the end id alone. Null doc_ids come first; equal doc_ids (and null ones) are
ordered by the first HEAD characters of their texts, nulls first, then as they are read, and the ranges are cut by these
as well, so that a repeated id is not one task's. Very long texts are encoded whole. Other columns, whatever their names, are ignored. An empty table writes and reads back no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from irengine.llm.common import as_ids, lean, materialise, scratch_path

END = 2
HEAD = 64  # characters of a text that order documents with one id
CACHE = 400_000  # pre-tokens in each of the two generations of a worker's cache
SLICE = 200  # texts whose ids are held at once
SCHEMA = "doc_id long, row long, n_tokens int, ids array<int>"
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
#: The vocabulary's own split, for texts of the characters below U+0250 only.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
ODD_ASCII = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
WHOLE = re.compile("[^\t\n\r -~¡-ɏ‐-‧‰-›€]|<\\|")
DOUBLE = re.compile("[ \t\n\r][ \t\n\r]")
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


_ENCODERS: dict[str, Encoder] = {}


def byte_alphabet() -> dict[int, str]:
    """Byte -> its character in the vocabulary: visible Latin-1 characters are themselves, the others follow one another from 256 on."""
    hidden = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 255 and x != 173)]
    return {x: chr(256 + hidden.index(x)) if x in hidden else chr(x) for x in range(256)}


class Encoder(dict):
    """Pre-token -> its ids as little-endian 32-bit integers; misses go to the library's model.

    A Python worker keeps its encoder for all tasks that it runs. The cache has two
    generations of at most CACHE entries: once the young one is full it becomes the
    old one, and what is met again moves back, so that frequent pre-tokens stay.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize, self.alphabet = self.library.model.tokenize, byte_alphabet()
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def __missing__(self, token: str) -> bytes:
        x = self.old.get(token)
        if x is None:
            written = token.encode().decode("latin-1").translate(self.alphabet)
            x = array("I", [t.id for t in self.tokenize(written)]).tobytes()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[token] = x
        return x

    def text(self, text: str) -> bytes:
        if "<|" in text or (ODD_ASCII if text.isascii() else WHOLE).search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, SPLIT.findall(text)))


def write_tokens(docs: DataFrame, path: str, model_path: str, end: int = END) -> None:
    """Write each document's ids with the end id, in ascending doc_id order, as ORC files under ``path``."""

    @lean
    def encode(batches):
        encoder = Encoder.of(model_path)
        tail = array("I", [end]).tobytes()
        row = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                data = [encoder.text(x or "") + tail for x in part.column("text").to_pylist()]
                sizes = np.array([len(x) // 4 for x in data], np.int32)
                values = pa.array(np.frombuffer(b"".join(data), "<i4"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                rows = pa.array(np.arange(row, row + len(data)))
                row += len(data)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, pa.array(sizes), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "row", "n_tokens", "ids"])

    # the sample that ranges are cut by holds these keys only, never whole texts
    keyed = as_ids(docs).withColumns({"head": F.left("text", F.lit(HEAD)), "salt": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "head", "salt").sortWithinPartitions("doc_id", "head", "salt").select("doc_id", "text")
    out = ordered.mapInArrow(encode, SCHEMA).withColumn("block", F.spark_partition_id())
    out.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    @lean
    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4").data
            off = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            arrays = [batch.column("doc_id"), batch.column("block"), batch.column("row"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "block", "row", "n_tokens", "ids_crc32"])

    files = spark.read.schema("doc_id long, row long, n_tokens int, ids array<int>, block int").orc(path)
    stats = materialise(files.select("doc_id", "block", "row", "ids").mapInArrow(digest, "doc_id long, block int, row long, n_tokens long, ids_crc32 long"), "token-stats")
    # prefix sums in two levels: over the blocks (one row per file), then within each block
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stats.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return stats.join(blocks, "block").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, model_path: str, path: str | None = None) -> DataFrame:
    """Write the files and return what is read back from them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    write_tokens(docs, path, model_path)
    return read_tokens(spark, path)


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document; stripes are skipped by row index and Bloom filter."""
    return spark.read.orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "ids")
