"""Near-duplicate documents by min-hashed word shingles."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irengine.functions.text import let, normalise, words
from irengine.sources.tables import shared_root

try:  # Python's own MD5 takes half the time of the library's on short inputs
    from _md5 import md5
except ImportError:
    from hashlib import md5

# The moduli of the 20 min-hash slots, in slot order.
MODULI = (1663, 1999, 2203, 2381, 2411, 2657, 2789, 2843, 2861, 2909, 2953, 3169, 3217, 3259, 3491, 3467, 3469, 3499, 3511, 27644437)
WIDTH = 5
SAME = 16  # equal slots of 20 that make a pair similar, i.e. more than 75 %


def shingles(text: Column, drop_last: bool = True) -> Column:
    """5-word shingles in order; by default the last one is left out, so a text needs 6 words."""

    def cut(w: Column) -> Column:
        last = F.size(w) - WIDTH - (1 if drop_last else 0)
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(WIDTH)]))).otherwise(F.array().cast("array<string>"))

    return let(words(normalise(text)), cut)


def md5_hash(s: Column) -> Column:
    """First 32 bits of MD5 as a long: any SQL engine computes the same."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long")


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32 bits, signed."""
    mask, h = 0xFFFFFFFF, seed
    whole = len(data) & ~3

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        return k * 0x1B873593 & mask

    for (k,) in np.frombuffer(data[:whole], "<u4").reshape(-1, 1).tolist():
        h ^= scramble(k)
        h = (h << 13 | h >> 19) & mask
        h = (h * 5 + 0xE6546B64) & mask
    if tail := data[whole:]:
        h ^= scramble(int.from_bytes(tail, "little"))
    h ^= len(data)
    for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * mul & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_many(items: list[bytes]) -> np.ndarray:
    """:func:`murmur3_32` of every item."""
    first = np.append(0, np.cumsum([len(x) for x in items])).astype(np.int64)
    return _murmur3_spans(np.frombuffer(b"".join(items), np.uint8), first[:-1], first[1:])


def _murmur3_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`murmur3_32` of spans of bytes: those of about one length together, so that a long one widens no others."""
    out, size = np.zeros(len(begin), np.int64), end - begin
    kinds = np.frexp(size)[1]
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        step = max(1, SPAN_BYTES // (int(size[rows].max()) + 4))
        for lo in range(0, len(rows), step):
            at = rows[lo : lo + step]
            out[at] = _murmur3_block(data, begin[at], size[at])
    return out


def _murmur3_block(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    width = int(size.max()) // 4 * 4 + 4
    k = np.arange(width)
    padded = np.append(data, np.uint8(0))
    blocks = np.where(k < size[:, None], padded[np.minimum(begin[:, None] + k, len(data))], np.uint8(0)).view("<u4")

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint32(by) | x >> np.uint32(32 - by)

    def scramble(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    with np.errstate(over="ignore"):
        h = np.zeros(len(begin), np.uint32)
        for j in range(width // 4):
            # a whole block turns the state, the last bytes (zeros after them) only enter it
            entered = h ^ scramble(blocks[:, j])
            rest = size - 4 * j
            h = np.where(rest >= 4, turned(entered, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(rest > 0, entered, h))
        h ^= size.astype(np.uint32)
        for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(mul)
        h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64)


def _md5_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`md5_hash` of spans of bytes."""
    raw = data.tobytes()
    digests = b"".join([md5(raw[x:y]).digest() for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64)


SPAN_BYTES = 1 << 18  # of spans that are hashed side by side
CHUNK_BYTES = 1 << 20  # of text in one step of a pass (or one longer text)
HASHES = {"md5": _md5_spans, "mmh3": _murmur3_spans}


def _shingle_hashes(words: pa.ListArray, hash_fn: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, firsts): of the shingles of each row of words, as :func:`shingles` has them. A shingle is a span of the words joined by blanks."""
    n = pc.list_value_length(words).to_numpy().astype(np.int64)
    flat = words.flatten()
    ends = np.cumsum(pc.binary_length(flat).to_numpy().astype(np.int64) + 1) - 1
    begins = np.append(0, ends + 1)[:-1]
    data = np.frombuffer(" ".join(flat.to_pylist()).encode(), np.uint8)
    many = np.maximum(n - WIDTH, 0)
    first = np.append(0, np.cumsum(many))
    at = np.repeat(np.append(0, np.cumsum(n))[:-1] - first[:-1], many) + np.arange(first[-1])
    return HASHES[hash_fn](data, begins[at], ends[at + WIDTH - 1]), first


def _by_words(docs: DataFrame, hash_fn: str, columns: str, rows) -> DataFrame:
    """One Arrow pass over (doc_id, words of the normalised text); ``rows`` maps (hashes, firsts) to (rows that stay, their columns)."""

    def run(batches):
        for batch in batches:
            ids, w = batch.column("doc_id"), batch.column("w")
            size = np.append(0, np.cumsum(pc.binary_length(w.flatten()).to_numpy().astype(np.int64) + 1))
            size = size[np.append(0, np.cumsum(pc.list_value_length(w).to_numpy()))]
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + CHUNK_BYTES, "right")) - 1)
                keep, column = rows(*_shingle_hashes(w.slice(lo, hi - lo), hash_fn))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep + lo)).cast(pa.int64()), column], ["doc_id", columns.split()[0]])
                lo = hi

    cut = docs.where("text is not null").select("doc_id", words(normalise(F.col("text"))).alias("w"))
    return cut.mapInArrow(run, f"doc_id long, {columns}")


def hashed_shingles(docs: DataFrame, hash_fn: str = "md5") -> DataFrame:
    """(doc_id, hs): hashes of a document's shingles in order; documents without any have an empty list, null texts stay out."""

    def rows(h, first):
        return np.arange(len(first) - 1), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h))

    return _by_words(docs, hash_fn, "hs array<long>", rows)


def signatures(docs: DataFrame, hash_fn: str = "md5") -> DataFrame:
    """(doc_id, sig): per slot the hash with the least residue, the first one of equals; too short documents have none.

    All slots of a run of documents come from passes over the array of its hashes, so a document is never exploded.
    """

    def rows(h, first):
        keep = np.flatnonzero(np.diff(first))
        begin, size = first[keep], np.diff(first)[keep]
        within = np.arange(len(h)) - np.repeat(begin, size)
        sig = np.zeros((len(keep), len(MODULI)), np.int64)
        for k, p in enumerate(MODULI if len(keep) else ()):
            # residue and place in one number, so that the least one is the first of the least residue
            best = np.minimum.reduceat(h % p << 32 | within, begin)
            sig[:, k] = h[begin + (best & 0xFFFFFFFF)]
        return keep, pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * len(MODULI), pa.int32()), pa.array(sig.reshape(-1)))

    return _by_words(docs, hash_fn, "sig array<long>", rows)


def classes(sigs: DataFrame) -> DataFrame:
    """(sig, class_id, n): documents with one signature, represented by the smallest id."""
    return sigs.groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))


def similar_classes(found: DataFrame, same: int = SAME) -> DataFrame:
    """(id1, id2, n_same): pairs of classes, id1 < id2, that agree in ``same`` slots or more.

    With at most 20 - same disagreements, one of 20 - same + 1 groups of slots agrees
    in full, so joining on whole groups finds every pair.
    """
    n = len(MODULI)
    parts = n - same + 1
    cuts = [round(i * n / parts) for i in range(parts + 1)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", a + 1, b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    rows = found.select("class_id", "sig", F.explode(keys).alias("key"))
    left, right = (rows.select("key", F.col("class_id").alias(f"id{i}"), F.col("sig").alias(f"s{i}")) for i in (1, 2))
    equal = F.aggregate(F.zip_with("s1", "s2", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    return left.join(right, "key").where("id1 < id2").select("id1", "id2", equal.cast("long").alias("n_same")).where(F.col("n_same") >= same).distinct()


def near_duplicate_pairs(docs: DataFrame, hash_fn: str = "md5") -> DataFrame:
    return similar_classes(classes(signatures(docs, hash_fn)))


def membership(docs: DataFrame, hash_fn: str = "md5") -> DataFrame:
    """(doc_id, class_id): equal signatures; together with the pairs it gives all similar documents.

    Signatures are needed twice, so they are made once and kept in the shared folder.
    """
    path = f"{shared_root(docs.sparkSession)}/irengine/signatures-{uuid.uuid4().hex}"
    signatures(docs, hash_fn).write.parquet(path)
    sigs = docs.sparkSession.read.parquet(path)
    return sigs.join(classes(sigs).select("sig", "class_id"), "sig").select("doc_id", "class_id")


def pair_jaccard(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: shared and all pairs of two pair sets (id1, id2), and their ratio."""
    a, b = (x.select(F.least("id1", "id2").alias("x"), F.greatest("id1", "id2").alias("y")).distinct() for x in (found, truth))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["x", "y"], "full_outer")
    return both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_both"), F.count("*").alias("n_any")).withColumn("jaccard", F.try_divide("n_both", "n_any"))
