"""Inverted index: postings, gaps, dictionary statistics, storage and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from irengine.functions import codecs
from irengine.functions.text import words
from irengine.sources.tables import discard


def postings(docs: DataFrame, text: str = "text", tokens=words) -> DataFrame:
    """(term, doc_id), once per term and document."""
    return docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).select("term", "doc_id")


def dictionary(posts: DataFrame) -> DataFrame:
    """(term, df, min_doc, max_doc)."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))


#: Documents that one posting block spans, so that a very common term is split over many rows and tasks.
BLOCK_DOCS = 1 << 16


def _block(block_docs: int) -> Column:
    return F.floor(F.col("doc_id") / block_docs).cast("long")


def with_gaps(posts: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(term, doc_id, gap): distance from the posting before; the first has its own 1-based document number.

    Gaps are taken inside blocks of document numbers; only the last number of each block
    passes through the window over a whole term, so that a very common term is never one task's.
    """
    lists = posts.withColumn("block", _block(block_docs)).groupBy("term", "block").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    ends = lists.select("term", "block", F.element_at("ids", -1).alias("end"))
    before = ends.select("term", "block", F.lag("end", 1, -1).over(Window.partitionBy("term").orderBy("block")).alias("before"))
    step = F.transform("ids", lambda x, i: F.struct(x.alias("doc_id"), (x - F.when(i == 0, F.col("before")).otherwise(F.get("ids", i - 1))).alias("gap")))
    return lists.join(before, ["term", "block"]).select("term", F.explode(step).alias("p")).select("term", "p.doc_id", "p.gap")


def posting_lists(posts: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(term, block, gaps): gap lists by blocks of document numbers; each list starts from its block's first number."""
    inside = F.sort_array(F.collect_list(F.col("doc_id") - F.col("block") * block_docs + 1))
    lists = posts.withColumn("block", _block(block_docs)).groupBy("term", "block").agg(inside.alias("ids"))
    step = F.transform("ids", lambda x, i: F.when(i == 0, x).otherwise(x - F.get("ids", i - 1)))
    return lists.select("term", "block", step.alias("gaps"))


def encode_postings(lists: DataFrame, codec: str) -> DataFrame:
    """(term, block, data)."""
    return lists.select("term", "block", codecs.encode(F.col("gaps"), codec).alias("data"))


def decode_postings(encoded: DataFrame, codec: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(term, doc_id) from encoded lists."""
    ids = encoded.select("term", "block", codecs.decode(F.col("data"), codec, running=True).alias("ids"))
    return ids.select("term", "block", F.explode("ids").alias("n")).select("term", (F.col("n") - 1 + F.col("block") * block_docs).alias("doc_id"))


def write_index(lists: DataFrame, path: str, codec: str = "varbyte") -> None:
    """Parquet sorted by term: row-group statistics and a Bloom filter take the place of a sorted dictionary.

    Sorting into ranges reads its input twice, once for their borders; so the lists are gathered and encoded
    once into a folder beside the index, from which they are sorted and which goes at the end.
    """
    spark, unsorted = lists.sparkSession, f"{path.rstrip('/')}-unsorted"
    encode_postings(lists, codec).write.parquet(unsorted)
    spark.read.parquet(unsorted).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.option("parquet.bloom.filter.enabled#term", "true").parquet(path)
    discard(spark, unsorted)


def read_terms(spark: SparkSession, path: str, terms: list[str], codec: str = "varbyte", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Postings of the given terms; the term filter reaches the Parquet scan."""
    return decode_postings(spark.read.parquet(path).where(F.col("term").isin(terms)), codec, block_docs)


def contains(numbers: DataFrame, probes: DataFrame, key: str = "value") -> DataFrame:
    """Rows of ``probes`` whose key occurs in ``numbers``."""
    return probes.join(numbers.select(key).distinct(), key, "left_semi")


def doc_info(docs: DataFrame) -> DataFrame:
    """(max_doc, n_docs): the universe of complements."""
    return docs.agg(F.max("doc_id").alias("max_doc"), F.count("*").alias("n_docs"))
