"""Helpers shared by the operators: scratch tables, byte-level tokenising, label samples.

Text arrives as Arrow batches; the helpers view the UTF-8 buffer as one numpy
array and work on small byte chunks, so that memory is bounded by the chunk
(or by the single longest text) and no per-character Python runs.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irengine.sources.tables import read_table, shared_root

U64 = np.uint64
CHUNK_BYTES = 1 << 18
BATCH_ROWS = 1_000
BROADCAST_KEYS = 100_000  # narrow rows (labels, languages, ids of a sample) that may be broadcast; beyond it joins shuffle
_STATE: dict = {}


# ---------------------------------------------------------------- scratch tables
def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/irengine/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """:func:`discard` for tables that :func:`materialise` made."""
    for df in tables:
        discard(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


read = read_table


# ---------------------------------------------------------------- workers
def trim() -> None:
    """Give free memory of this Python process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def lean(run):
    """An Arrow function that gives its memory back to the system at its end: Python workers outlive their tasks."""

    @functools.wraps(run)
    def freed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return freed


# ---------------------------------------------------------------- byte chunks
def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offs, data = col.buffers()
    n = len(col)
    off = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes (a longer text stands alone)."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def code_points(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the UTF-8 texts of a chunk."""
    try:
        codes = np.frombuffer(b.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no UTF-8: each text by itself, with marks in their place
        texts = [b[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])
    before = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return codes, before[off]


def code_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of a string column, chunk by chunk."""
    raw, off = byte_view(col)
    for lo, hi in chunks(off, limit):
        yield lo, hi, *code_points(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(is_part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True that does not cross a text's border."""
    n = len(is_part)
    prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
    prev[1:], nxt[:-1] = is_part[:-1], is_part[1:]
    prev[off[:-1][off[:-1] < n]] = False
    last = off[1:] - 1
    nxt[last[last >= 0]] = False
    return np.flatnonzero(is_part & ~prev), np.flatnonzero(is_part & ~nxt) + 1


def space_words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    return spans(~_SPACE[b], off)


def white(codes: np.ndarray) -> np.ndarray:
    """Which code points are one of ``\\x20\\x09-\\x0D``."""
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes or code points; spans are in order and don't overlap.

    Every place adds a scrambled number of its own, made from the symbol and how far it stands
    from the span's start; no algebra over the symbols makes different spans meet by design.
    """
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    with np.errstate(over="ignore"):
        total = np.empty(len(starts), U64)
        lo = 0
        while lo < len(starts):  # a bounded number of symbols at a time, or one long span
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, "right")))
            hi = min(hi, len(starts))
            n = size[lo:hi]
            first = np.concatenate([[0], np.cumsum(n)])
            within = np.arange(first[-1]) - np.repeat(first[:-1], n)
            symbols = b[np.repeat(starts[lo:hi], n) + within].astype(U64)
            x = mix((symbols + U64(1)) * U64(0x9E6C63D0876A9A47) + within.astype(U64) * U64(0xD1B54A32D192ED03))
            run = np.zeros(len(x) + 1, U64)
            np.cumsum(x, out=run[1:])
            total[lo:hi] = run[first[1:]] - run[first[:-1]]
            lo = hi
        return mix(total + size.astype(U64) * U64(0xD6E8FEB86659FD93))


_LANES = [U64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(word_hash: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all 5-word windows: (hash, doc of window, index of its first word).

    ``first`` holds the index of each text's first word, with the total at the
    end. A text of 1 to 4 words has its whole sequence as its one window.
    """
    n = len(word_hash)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        if n >= 5:
            h = np.zeros(n - 4, U64)
            for j, lane in enumerate(_LANES):
                h += word_hash[j : n - 4 + j] * lane
            at = np.flatnonzero(doc[: n - 4] == doc[4:])
            h, d = mix(h[at] ^ U64(5)), doc[at]
        else:
            h, d, at = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < 5))
        if len(short):
            own = []
            for k in short:
                x = U64(0)
                for j, w in enumerate(word_hash[first[k] : first[k + 1]]):
                    x = x + w * _LANES[j]
                own.append(mix(np.array([x ^ U64(int(counts[k]) * 7919)], U64))[0])
            h = np.concatenate([h, np.array(own, U64)])
            d = np.concatenate([d, short])
            at = np.concatenate([at, first[short]])
    return h, d, at


def per_doc(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Index of the first span of each text, with the total at the end."""
    return np.searchsorted(starts, off, "left")


# ---------------------------------------------------------------- label samples
def learnable(col: str = "doc_id", mod: int = 3, held: int = 1) -> F.Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod != held, F.lit(False))


def pick(rows: DataFrame, key: str, most: int, budget: int) -> list[tuple]:
    """[(key, doc_id, th)]: for each value of ``key`` the rows of lowest hash, at most ``most`` of them and ``budget`` bytes.

    ``rows`` are (key, doc_id, th, size), each once. The row that crosses the budget still counts, so
    every key has one row at least. Counts per key come first; only rows whose hash lies in the range that
    holds about 2 * most + 40 of them reach the driver, which takes the first ones: no key is ever gathered in a task.
    """
    rows = materialise(rows.withColumn("u", F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 40))), "candidates")
    counts = rows.groupBy(key).agg((F.lit(1 << 40) * F.least(F.lit(1.0), F.lit(2.0 * most + 40) / F.count("*"))).alias("below"))
    few = counts.count() <= BROADCAST_KEYS
    near = rows.join(F.broadcast(counts) if few else counts, key).where(F.col("u") <= F.col("below")).select(key, "u", "doc_id", "th", "size").toArrow()
    forget(rows)
    out, held = [], {}
    for k, _, doc, th, size in sorted(zip(*(near.column(c).to_pylist() for c in near.column_names), strict=True)):
        n, before = held.get(k, (0, 0))
        if n < most and before < budget:
            out.append((k, doc, th))
            held[k] = (n + 1, before + size)
    return out


def sampled(docs: DataFrame, keys: DataFrame | None, key: str, most: int, budget: int) -> DataFrame:
    """(key, doc_id, th, text): a bounded training sample of whole texts, each (doc_id, text) once.

    ``keys`` are rows (doc_id, key), or None if ``docs`` has the column. Null texts are no candidates; texts of any length are. The
    sample is bounded by ``most`` rows and ``budget`` bytes for each value of ``key`` (plus the one text that crosses it).
    """
    texts = docs.where("text is not null").withColumn("th", F.xxhash64("text"))
    size = F.octet_length("text").cast("long").alias("size")
    if keys is None:
        rows = texts.select(key, "doc_id", "th", size).where("doc_id is not null").distinct()
    else:
        rows = texts.select("doc_id", "th", size).join(keys.distinct(), "doc_id").select(key, "doc_id", "th", "size").distinct()
    kind = rows.schema[key].dataType.simpleString()
    picked = pick(rows, key, most, budget)
    # narrow rows, at most ``most`` for each value of the key
    chosen = docs.sparkSession.createDataFrame(picked, f"{key} {kind}, doc_id long, th long")
    small = F.broadcast(chosen) if len(picked) <= BROADCAST_KEYS else chosen
    on = ["doc_id", "th"] if keys is not None else [key, "doc_id", "th"]
    return texts.join(small, on).groupBy(key, "doc_id", "th").agg(F.first("text").alias("text")).select(key, "doc_id", "th", "text")


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, budget: int) -> DataFrame:
    """(y, doc_id, th, text): the bounded sample of the learnable rows of both values of a label."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learnable())
    return sampled(as_ids(docs), y, "y", per_class, budget)


def as_ids(df: DataFrame) -> DataFrame:
    """Only the two columns that text operators use; other columns, whatever their names, stay out. doc_id is a whole number.

    Texts go to Python workers in Arrow batches of BATCH_ROWS rows, unless the session has a size of its own.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def only(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs``, with all their columns, for which ``judge`` of the text column (an Arrow array) says true."""
    as_ids(docs)  # sizes of batches

    @lean
    def run(batches):
        for batch in batches:
            yield batch.filter(judge(batch.column("text").cast(pa.string())))

    return docs.mapInArrow(run, docs.schema)


__all__ = [n for n in dir() if not n.startswith("_")] + ["T"]
