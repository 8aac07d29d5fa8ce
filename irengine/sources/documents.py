"""Readers and writers of document collections."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "url string, body string, text string"
PARAGRAPH_TRAIN = "Paragraph string, Sentences array<string>"
PARAGRAPH_TEST = "Paragraph string, Marks array<struct<Index:long,Pos:int,Mark:string,Label:boolean>>"
_FIELDS = {1: "url", 2: "body", 3: "text"}


# ---------------------------------------------------------------- framed messages
def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def parse_message(data: memoryview) -> dict[str, str | None]:
    """Fields 1 to 3 (url, body, text) of one protobuf message; other fields are skipped."""
    out: dict[str, str | None] = dict.fromkeys(_FIELDS.values())
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated message")
            if tag >> 3 in _FIELDS:
                out[_FIELDS[tag >> 3]] = bytes(data[at : at + size]).decode("utf-8", "replace")
            at += size
        elif kind == 0:
            _, at = _varint(data, at)
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")
    if out["url"] is None:
        raise ValueError("a message without a url")
    return out


def build_message(url: str, body: str | None = None, text: str | None = None) -> bytes:
    out = bytearray()
    for n, value in ((1, url), (2, body), (3, text)):
        if value is not None:
            raw = value.encode()
            size, length = len(raw), bytearray()
            while size > 127:
                length.append(size & 127 | 128)
                size >>= 7
            length.append(size)
            out += bytes([n << 3 | 2]) + length + raw
    return bytes(out)


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes, part by part; gzip is told by its first bytes, and may have several members."""
    packed = data[:2] == b"\x1f\x8b"
    unzip = zlib.decompressobj(31)
    for lo in range(0, len(data), step):
        part = data[lo : lo + step]
        while packed and part:
            yield unzip.decompress(part)
            part = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
        if not packed:
            yield part
    if packed:
        yield unzip.flush()


def frames(data: bytes) -> Iterator[memoryview]:
    """Messages of one file: a 4-byte little-endian length before each. Only one message and the part around it are held unzipped."""
    held = bytearray()
    for part in _inflated(data):
        held += part
        at = 0
        while at + 4 <= len(held):
            (size,) = struct.unpack_from("<i", held, at)
            if size < 0:
                raise ValueError("truncated frame")
            if at + 4 + size > len(held):
                break
            yield memoryview(bytes(held[at + 4 : at + 4 + size]))
            at += 4 + size
        del held[:at]
    if held:
        raise ValueError("truncated frame")


def frame(messages: list[bytes], compress: bool = False) -> bytes:
    raw = b"".join(struct.pack("<i", len(m)) + m for m in messages)
    return gzip.compress(raw) if compress else raw


def read_framed(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, pos, url, body, text) of files of framed messages, plain or gzipped.

    Spark itself reads the files, so any of its file systems will do; each file is one row
    for a worker, which yields documents in batches. The files, in order of path, are one stream.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[dict] = []
                for pos, m in enumerate(frames(bytes(content))):
                    rows.append({"file": path, "pos": pos, **parse_message(m)})
                    if len(rows) == 1_000:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInPandas(run, f"file string, pos long, {DOCUMENT}")


def with_doc_ids(docs: DataFrame) -> DataFrame:
    """Adds ``doc_id``, 1, 2, ... in order of (file, pos): offsets from per-file counts, no sort of all documents."""
    from pyspark.sql.window import Window

    sizes = docs.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return docs.join(base, "file").withColumn("doc_id", F.col("__base") + F.col("pos") + 1).drop("__base")


def lengths(docs: DataFrame) -> DataFrame:
    """(url, body_length, text_length); a missing field has length 0."""
    return docs.select("url", F.coalesce(F.length("body"), F.lit(0)).alias("body_length"), F.coalesce(F.length("text"), F.lit(0)).alias("text_length"))


# ---------------------------------------------------------------- text formats
def read_labelled_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, mark, url, html) of a tab-separated file with a header and base64 pages, plain or gzipped."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="id long, mark int, url string, html string", quote="")
    return rows.withColumn("html", F.decode(F.unbase64("html"), "UTF-8"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line, with the schema stated."""
    return spark.read.schema(schema).json(path)


def read_urls(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """(url) of a file with one URL per line, blanks cut, empty lines left out; in random order if a seed is given."""
    rows = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")
    return rows if seed is None else rows.orderBy(F.rand(seed))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): each file of a folder is one document."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.trim("value").alias("text"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(feature, cnt) of tab-separated lines; lines without a tab are skipped."""
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).where(F.contains(F.col("value"), F.lit("\t"))).select(parts[0].alias("feature"), F.try_to_number(F.trim(parts[1]), F.lit("999999999999")).cast("long").alias("cnt"))


# ---------------------------------------------------------------- sinks
def write_features(counts: DataFrame, path: str, least: int = 100) -> None:
    """feature<TAB>count by falling count, down to ``least``."""
    kept = counts.where(F.col("cnt") >= least).orderBy(F.desc("cnt"), "feature")
    kept.select(F.concat_ws("\t", "feature", F.col("cnt").cast("string"))).write.text(path)


def write_submission(scores: DataFrame, path: str, threshold: float) -> None:
    """CSV with a header: Id, Prediction (1 if score > threshold)."""
    scores.select(F.col("doc_id").alias("Id"), F.coalesce((F.col("score") > threshold).cast("int"), F.lit(0)).alias("Prediction")).write.csv(path, header=True)


def duplicate_lines(pairs: DataFrame, urls: DataFrame, slots: int = 20) -> DataFrame:
    """(url1, url2, measure) of similar pairs (id1, id2, n_same)."""
    u = urls.select("doc_id", "url")
    one, two = (u.select(F.col("doc_id").alias(f"id{i}"), F.col("url").alias(f"url{i}")) for i in (1, 2))
    return pairs.join(one, "id1").join(two, "id2").select("url1", "url2", (F.col("n_same") / slots).alias("measure"))
