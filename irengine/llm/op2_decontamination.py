"""Operator 2, benchmark decontamination: spaced-seed hashing, in native DataFrame operations.

Words are lower-cased runs of letters and digits. A document overlaps a benchmark
item if, in one alignment of the two, some window of 13 consecutive item words
has at least 11 equal ones (shorter items: the whole item, all words equal). Items of
any length are searched; ``shortest`` leaves out those of fewer words, if wanted.

Two masks look at 6 of 8 and 6 of 9 word positions. Every window of 13 with at
most 2 substitutions has a place where one of the masks sees only equal words
(checked by enumeration in the tests), so joining masked hashes of documents and
items loses no overlap. Items of fewer than 8 words have a mask of their own length, all of whose places count. Each
hit gives an alignment, which is then verified word by word: a text's hits are
gathered first, the windows that they point at are cut out of its hashes, and only the windows meet the items.

The side of item hashes is broadcast only if it has at most BROADCAST_ROWS rows;
beyond that the join shuffles. The same holds for hits met again with their texts.

Null or empty text on either side: no overlap. Documents with equal text share
one search and are all reported, also with null or repeated doc_ids; repeated
item rows are one item. Items with a null item_id are not reported by :func:`decontaminate`, which has no name for them, but
:func:`clean` drops what holds them. Items without words are no items. Very long texts are searched whole. Other columns, whatever
their names, are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irengine.llm.common import BROADCAST_KEYS, as_ids, materialise

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, SUBSTITUTIONS, SHORTEST = 13, 2, 1
MASKED = 8  # words from which on an item is found by the masks
BROADCAST_ROWS = 200_000  # of (hash, item, place) or of (text, item, alignment): a few MB


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(h: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """array<struct<at, seed>>: the masked hashes of every place of every mask."""

    def masked(mask: tuple[int, ...]) -> Column:
        span = mask[-1] + 1
        at = F.when(F.size(h) >= span, F.sequence(F.lit(0), F.size(h) - span)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(repr(mask)), *[F.get(h, i + o) for o in mask]).alias("seed")))

    return F.concat(*[masked(mask) for mask in masks])


def seeds(df: DataFrame, masks: tuple[tuple[int, ...], ...], *keys: str) -> DataFrame:
    """(keys, at, seed) of a table with a column h of word hashes."""
    return df.select(*keys, F.explode(F.transform(F.array("h"), lambda h: _seeds(h, masks))[0]).alias("s")).select(*keys, "s.at", "s.seed")


def _best(window: Column, item: Column) -> Column:
    """Most equal words in a run of WINDOW places of two aligned lists."""
    equal = F.zip_with(window, item, lambda x, y: x.eqNullSafe(y).cast("int"))
    width = F.least(F.lit(WINDOW), F.size(item))

    def most(e: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(item) - width + 1)
        return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(e, s, width), F.lit(0), lambda a, x: a + x)))

    return F.transform(F.array(equal), most)[0]


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def overlaps(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(digest, item_id, matches) of every overlapping pair of a document text and an item; item_id may be null."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = items.select("item_id", digest(F.concat_ws(" ", F.col("item_id").cast("string"), F.lit("\n"), "text")).alias("item"), word_hashes(F.col("text")).alias("words"))
    items = materialise(items.withColumn("n", F.size("words")).where(F.col("n") >= max(shortest, 1)), "bench-items")
    # items of each short length have a mask of their own; there are MASKED - 1 lengths at most
    lengths = sorted(r.n for r in items.where(F.col("n") < MASKED).select("n").distinct().collect())
    whole = tuple(tuple(range(n)) for n in lengths)
    by_masks = seeds(items.where(F.col("n") >= MASKED).withColumnRenamed("words", "h"), MASKS, "item", "n")
    keys = by_masks.union(items.where(F.col("n") < MASKED).withColumnRenamed("words", "h").select("item", "n", F.lit(0).alias("at"), _whole_seed(lengths).alias("seed")))
    keys = materialise(keys.distinct(), "bench-seeds").withColumnRenamed("at", "place")
    texts = docs.where("text is not null").select(digest(F.col("text")).alias("digest"), "text")
    hashed = texts.select("digest", word_hashes(F.col("text")).alias("h"))
    small = keys.count() <= BROADCAST_ROWS
    shift = F.col("at") - F.col("place")
    hits = seeds(hashed, MASKS + whole, "digest").join(F.broadcast(keys) if small else keys, "seed")
    # a short item is found whole by any of its hits, so one is enough
    hits = hits.groupBy("digest", "item", "n", F.when(F.col("n") >= MASKED, shift).alias("own")).agg(F.min(shift).alias("shift"))
    wanted = materialise(hits.groupBy("digest").agg(F.collect_list(F.struct("item", "n", "shift")).alias("at")), "bench-hits")
    few = wanted.count() <= BROADCAST_KEYS
    found = texts.join(F.broadcast(wanted.select("digest")) if few else wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]).select("digest", word_hashes(F.col("text")).alias("h"))

    def window(h: Column, x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda q: F.get(h, q + x["shift"]))

    cut = found.join(wanted, "digest").select("digest", F.explode(F.transform("at", lambda x: F.struct(x["item"].alias("item"), window(F.col("h"), x).alias("window")))).alias("m")).select("digest", "m.*").distinct()
    met = cut.join(F.broadcast(items) if small else items, "item")
    allowed = F.when(F.col("n") >= WINDOW, SUBSTITUTIONS).otherwise(0)
    good = met.select("digest", "item_id", _best(F.col("window"), F.col("words")).alias("matches"), (F.least(F.lit(WINDOW), F.col("n")) - allowed).alias("least")).where("matches >= least")
    return materialise(good.groupBy("digest", "item_id").agg(F.max("matches").cast("long").alias("matches")), "bench-overlaps")


def _whole_seed(lengths: list[int]) -> Column:
    """The seed of a short item under the mask of its own length."""
    out = F.lit(None).cast("long")
    for n in lengths:
        out = F.when(F.col("n") == n, F.xxhash64(F.lit(repr(tuple(range(n)))), *[F.get("h", F.lit(o)) for o in range(n)])).otherwise(out)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, matches): one row for each document and named item that overlap."""
    docs = as_ids(docs)
    found = overlaps(docs, benchmark, shortest).where("item_id is not null")
    few = found.count() <= BROADCAST_ROWS
    tagged = docs.where("text is not null").select("doc_id", digest(F.col("text")).alias("digest"))
    return tagged.join(F.broadcast(found) if few else found, "digest").select("doc_id", "item_id", "matches")


def clean(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text overlaps no item."""
    found = overlaps(as_ids(docs), benchmark, shortest).select("digest").distinct()
    few = found.count() <= BROADCAST_ROWS
    # both sides named through their frames, so that columns of docs may have any names
    return docs.join(F.broadcast(found) if few else found, digest(docs["text"].cast("string")) == found["digest"], "left_anti")


ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null),
b as (select distinct item_id, text from benchmark where text is not null and item_id is not null),
i as (select row_number() over () as iid, item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from b),
bw as (select iid, item_id, len(w) as n, least({WINDOW}, len(w)) as width, unnest(w) as word, unnest(range(len(w))) as q from i where len(w) >= {SHORTEST}),
dw as (select rid, doc_id, unnest(w) as word, unnest(range(len(w))) as p from d),
m as (select rid, doc_id, iid, item_id, n, width, p - q as diag, q from dw join bw using (word)),
g as (select rid, iid, diag from m group by rid, iid, diag, n, width having count(*) >= width - (case when n >= {WINDOW} then {SUBSTITUTIONS} else 0 end)),
k as (select m.* from m join g using (rid, iid, diag)),
s as (select distinct rid, iid, diag, least(q, n - width) as s from k),
c as (select k.rid, k.doc_id, k.iid, k.item_id, k.n, k.width, k.diag, s.s, count(*) as c from s join k on s.rid = k.rid and s.iid = k.iid and s.diag = k.diag and k.q >= s.s and k.q < s.s + k.width group by all)
select doc_id, item_id, max(c)::bigint as matches from c where c >= width - (case when n >= {WINDOW} then {SUBSTITUTIONS} else 0 end) group by rid, doc_id, item_id"""
