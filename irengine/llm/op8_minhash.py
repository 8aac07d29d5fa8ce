"""Operator 8, near-duplicates: b-bit MinHash with confirmation on full shingle sets.

1. One Arrow pass computes, from the set of distinct 5-word shingles of each
   text: its size, a 128-bit key of the set, the low 8 bits of each of HASHES minima
   packed into one signature, and band keys of several minima each. The bands follow
   from the threshold (:func:`banding`): at 0.85 they are 36 of 7 minima, and a pair of that
   similarity shares none with probability 9e-7; at 0.80 they are 46 of 6, with 9e-7.
2. Documents with one key have equal sets: they are one class, represented by
   the smallest doc_id. All later steps see representatives only.
3. A band bucket links each member to its smallest member (never all pairs);
   the components of these links are candidate groups: every pair that shares
   a band lies in one group.
4. A group's members are dealt into blocks of about BLOCK rows, BLOCK_SHINGLES shingles and BLOCK_BYTES bytes of
   text by a hash; a few members, the leaders, are guests in every block of their group. In a block,
   signatures give collision-corrected similarities by counting equal packed bytes; pairs
   that could reach the threshold (4.5 standard errors of slack) and are not yet
   connected are confirmed on the full sets. Only a spanning forest of the confirmed
   links leaves the task. A group of one block is settled.
5. In groups of several blocks, the members of a band bucket that are still in different
   components are compared across blocks: those outside of the bucket's largest
   component with each other and with it, never the largest component with itself. A
   large group of near copies is one component by then, so its cost stays linear.
6. The components of all forests are the result; classes carry them to copies.

Null or empty text, or text without words: an empty set, linked with nothing
(component_id is its own doc_id, also for a second row with the same doc_id).
Rows with a null doc_id are returned with a null component and kept. Repeated
rows are equal sets; rows that share a doc_id but differ in text act as one
document with the links of all of them. Very long texts are walked whole. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irengine.llm.common import as_ids, byte_view, chunks, lean, LOWER, materialise, mix, per_doc, shingles, space_words, span_hashes, U64
from irengine.llm.components import connected_components

HASHES = 276
MISS = 1e-6  # a pair at the threshold shares no band with this probability at most
BITS = 8
BLOCK = 512  # members of a candidate group in one block,
BLOCK_SHINGLES = 4 << 20  # and shingles of theirs, so that long texts make small blocks,
BLOCK_BYTES = 32 << 20  # and bytes of their texts, as few shingles may stand in a long text: words of any length, repeated lines
LEADERS = 8  # members of a group that every block of it sees; fewer where they would fill more than half a block
SKETCH = "doc_id long, n_shingles long, n_bytes long, set_key binary, bands array<long>, signature binary"
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(1, 1 << 31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    b = LOWER[raw]
    ws, we = space_words(b, off)
    first = per_doc(ws, off)
    h, doc, _ = shingles(span_hashes(b, ws, we), first)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    at = np.searchsorted(doc, np.arange(len(off)))
    return [h[at[i] : at[i + 1]] for i in range(len(off) - 1)]


def minima(s: np.ndarray) -> np.ndarray:
    """The HASHES minima of a set under as many hash functions."""
    x = (s ^ (s >> U64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        h = x[i : i + 512, None] * _A
        h += _B
        np.minimum(out, h.min(0), out=out)
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands of HASHES minima that keep to MISS for a pair at the threshold, and as few of them as do."""
    t = percent / 100
    for rows in range(HASHES, 0, -1):
        for bands in range(1, HASHES // rows + 1):
            if (1 - t**rows) ** bands <= MISS:
                return bands, rows
    raise ValueError(f"{HASHES} minima are too few for a similarity of {t}")


def _band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys of (texts, HASHES) minima."""
    key = np.zeros((len(m), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key + m[:, r : bands * rows : rows].astype(U64) + U64(0x9E3779B97F4A7C15))
        key = mix(key ^ np.arange(1, bands + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


def sketches(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Step 1; bands and signature are null for an empty set."""
    shape = banding(percent)

    @lean
    def run(batches):
        for batch in batches:
            raw, off = byte_view(batch.column("text"))
            size, keys, bands, sigs = [], [], [], []
            for lo, hi in chunks(off):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    m = np.stack([minima(s) for s in sets])
                    k1 = [int(s.sum(dtype=U64)) for s in sets]
                    k2 = [int(mix(s ^ U64(0xABCDEF12345)).sum(dtype=U64)) for s in sets]
                    b = _band_keys(m, *shape)
                for i, s in enumerate(sets):
                    size.append(len(s))
                    keys.append(k1[i].to_bytes(8, "big") + k2[i].to_bytes(8, "big") + len(s).to_bytes(5, "big") if len(s) else None)
                    bands.append(b[i] if len(s) else None)
                    sigs.append(m[i].astype(np.uint8).tobytes() if len(s) else None)
            arrays = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "n_bytes", "set_key", "bands", "signature"])

    return docs.mapInArrow(run, SKETCH)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one signature with many: equal bytes, less those equal by chance."""
    same = (many == one).mean(1)
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def forest(ids: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, known: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the confirmed links between rows that ``known`` does not connect yet, of different sides if there are several."""
    n = len(ids)
    _, root = np.unique(known, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    t = percent / 100
    least = t - 4.5 * np.sqrt(t * (1 - t) / HASHES) / (1 - 1 / (1 << BITS))
    two = len(np.unique(side)) > 1
    out = []
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        later = later[(100 * sizes[later] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[later]) & (root[later] != root[i])]
        if two:
            later = later[side[later] != side[i]]
        if not len(later):
            continue
        later = later[estimate(sigs[i], sigs[later]) >= least]
        for j in later:
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                root[root == root[j]] = root[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def confirmed(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): forests of the confirmed links within each group of rows (keys, doc_id, signature, text, known, side).

    Sets are made anew from the texts, in the task that compares them.
    """

    def compare(_, table):
        table = table.take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable")))
        raw, off = byte_view(table.column("text"))
        sets = []
        for lo, hi in chunks(off):
            with np.errstate(over="ignore"):
                sets += shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        ids, known = table.column("doc_id").to_numpy(), table.column("known").to_numpy()
        if len(np.unique(ids)) == len(ids):
            sigs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
        else:  # rows that share an id: each text needs a signature of its own
            with np.errstate(over="ignore"):
                sigs = np.stack([minima(s).astype(np.uint8) for s in sets])
        found = forest(ids, sets, sigs, known, table.column("side").to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.select(*keys, "doc_id", "signature", "text", "known", "side").groupBy(*keys).applyInArrow(compare, "a long, b long")


def _share() -> Column:
    """Of a block that a text fills by its shingles or bytes."""
    return F.greatest(F.col("n_shingles") / BLOCK_SHINGLES, F.col("n_bytes") / BLOCK_BYTES)


def _in_blocks(groups: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Step 4: (links, nodes of groups with several blocks) from (node, component)."""
    leaders = [F.min_by("node", F.xxhash64(F.lit(i), "node")) for i in range(LEADERS)]
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(LEADERS)), 0.5 / F.max("share"))).cast("int")
    weighed = groups.join(reps.select(F.col("rep").alias("node"), _share().alias("share")), "node")
    sizes = weighed.groupBy("component").agg(F.count("*").alias("n"), F.sum("share").alias("shares"), F.slice(F.array(*leaders), F.lit(1), room).alias("leaders"))
    sizes = sizes.withColumn("k", F.ceil(F.greatest(F.col("n") / block, "shares")).cast("int"))
    dealt = groups.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    x = F.when(F.array_contains("leaders", F.col("node")), every).otherwise(F.array("mine"))
    dealt = dealt.join(reps.select(F.col("rep").alias("node"), "signature"), "node")
    dealt = materialise(dealt.select("node", "component", "k", x.alias("x"), "signature"), "minhash-dealt")
    rows = texts.join(dealt.withColumnRenamed("node", "doc_id"), "doc_id").select("component", F.explode("x").alias("x"), "doc_id", "signature", "text", F.col("doc_id").alias("known"), F.lit(0).alias("side"))
    return materialise(confirmed(rows, ["component", "x"], percent), "minhash-links"), dealt.where("k > 1").select("node").distinct()


def _across_blocks(links: DataFrame, large: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """Step 5: links between members of a band bucket that ``links`` leaves in different components."""
    known = connected_components(links).withColumnRenamed("component", "known")
    members = materialise(large.join(known, "node", "left").select("node", F.coalesce("known", "node").alias("known")), "minhash-known")
    own = reps.select(F.col("rep").alias("node"), "bands", "signature", _share().alias("share"))
    weight = F.greatest(F.lit(1.0), F.col("share") * block)  # of a text, so that ``block`` of them fill a block
    rows = members.join(own.drop("signature"), "node").select("node", "known", weight.alias("weight"), F.explode("bands").alias("band"))
    parts = rows.groupBy("band", "known").agg(F.sum("weight").alias("n"))
    buckets = parts.groupBy("band").agg(F.max(F.struct("n", "known")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    few, many = F.ceil((F.col("n") - F.col("main.n")) / block).cast("int"), F.ceil(F.col("main.n") / block).cast("int")
    buckets = buckets.select("band", F.col("main.known").alias("main"), few.alias("few"), many.alias("many"))
    met = rows.join(buckets, "band").withColumn("inside", F.col("known") == F.col("main"))
    # blocks 0 .. few - 1 hold the members outside of the largest component, the next ones those inside
    number = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("many")).otherwise(F.col("few"))).cast("int") + F.when(F.col("inside"), F.col("few")).otherwise(0)
    met = met.withColumn("side", number).join(own.drop("bands", "share"), "node")
    last = F.when(F.col("inside"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda y: F.struct(F.least("side", y).alias("x"), F.greatest("side", y).alias("y")))
    met = materialise(met.select(F.col("node").alias("doc_id"), "band", "known", "side", "signature", pairs.alias("pairs")), "minhash-open")
    work = texts.join(met, "doc_id").select("band", F.explode("pairs").alias("p"), "doc_id", "signature", "text", "known", "side").select("band", "p.x", "p.y", "doc_id", "signature", "text", "known", "side")
    return materialise(confirmed(work, ["band", "x", "y"], percent), "minhash-links")


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) of every row."""
    spark = docs.sparkSession
    docs = as_ids(docs)
    sk = materialise(sketches(docs, percent), "minhash")
    # classes of equal sets; the smallest id stands for each
    reps = sk.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("signature", "doc_id").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.min_by("n_bytes", "doc_id").alias("n_bytes"), F.count("*").alias("n"))
    reps = materialise(reps, "minhash-reps")
    # dealt by band once, for the smallest members and for the links to them
    rows = reps.select("rep", F.explode("bands").alias("band")).repartition("band")
    low = rows.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    links = rows.join(low, "band").where("rep <> a").select("a", F.col("rep").alias("b"))
    groups = materialise(connected_components(links), "minhash-groups")  # node, component

    texts = docs.where("text is not null")
    found, large = _in_blocks(groups, reps, texts, percent, block)
    if not large.isEmpty():
        found = found.union(_across_blocks(found, large, reps, texts, percent, block))
    comp = connected_components(found)
    classes = reps.select("set_key", "rep", "n").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "rep", "n", F.coalesce("component", "rep").alias("component_id"))
    # classes that say no more than "this document alone" are left out of the last join
    told = classes.where("n > 1 or component_id <> rep").select("set_key", "rep", "component_id")
    # documents without words meet nothing; a key of their own spreads them over the tasks
    key = F.coalesce("set_key", F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sk.select("doc_id", "n_shingles", key.alias("set_key")).join(told, "set_key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("rep", "doc_id").alias("class_id")
    )


def keep(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group of near copies.

    Every row counts by itself, whatever its doc_id: repeated rows are copies of one another, and rows that share a
    doc_id but not a text are two documents. Of a group the row with the smallest doc_id stays (nulls last; among
    equal ones the row that is read first). Rows without words stay.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    # rows of a plain scan have the same numbers whenever they are read; those of any other plan are written once
    if docs._jdf.queryExecution().optimizedPlan().nodeName() != "LogicalRelation":
        numbered = materialise(numbered, "minhash-rows")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), percent).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)
    first = numbered.select(row, "doc_id").join(found, row).groupBy("component_id").agg(F.min(order)[row].alias(row)).select(row)
    return numbered.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
