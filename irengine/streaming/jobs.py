"""Structured Streaming forms: an index that grows by batches, and quota admission with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from irengine.operators.index import postings


def index_stream(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the postings of arriving documents (doc_id, text) as one folder per batch.

    A batch that is run again after a failure replaces its own folder, so every document is indexed once.
    """

    def append(batch: DataFrame, number: int) -> None:
        postings(batch).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id) of all batches so far."""
    return spark.read.schema("term string, doc_id long, batch int").parquet(path).select("term", "doc_id")


def admit_stream(arrivals: DataFrame, quotas: dict[str, float], out_columns: str) -> DataFrame:
    """Rows of a stream (cluster, accepted, seq, ...) with ``admitted``: as :func:`irengine.operators.segments.admit`, with the used quota as state.

    Within a batch, rows of a cluster are taken in order of ``seq``. ``quotas`` has one entry per cluster.
    """
    names = [c.split()[0] for c in out_columns.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        accepted = rows["accepted"].fillna(False).astype(bool)
        rank = used + (~accepted).cumsum() - (~accepted)
        rows["admitted"] = accepted | (rank < quotas.get(key[0], 0))
        state.update((int(used + (rows["admitted"] & ~accepted).sum()),))
        yield rows[[*names, "admitted"]]

    return arrivals.groupBy("cluster").applyInPandasWithState(step, f"{out_columns}, admitted boolean", "used long", "append", GroupStateTimeout.NoTimeout)


def term_counts(docs: DataFrame) -> DataFrame:
    """Streaming (term, n): running occurrence counts, for update or complete output."""
    from irengine.functions.text import words

    return docs.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
