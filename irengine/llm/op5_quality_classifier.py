"""Operator 5, quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, of its word pairs and word triples, and of the 3- and
4-character grams of its words (each hashed to a bucket), followed by a softmax
over two labels. A triple is delexicalised: only which of its words are equal counts, so that repetition is
learnt from any words and found in unseen ones; triples of three different words say nothing and are left out. It is trained by stochastic gradient descent in numpy on a bounded
sample of SAMPLE_DOCS whole texts and SAMPLE_BYTES per label. Executors count the sample's buckets; only these
counts reach the driver. Prediction is linear in the mean, so the embedding and the output
layer fold into one number per bucket, and scoring is a gather and a sum over
whole texts.

Null or empty text, or text without a word: the score of the bias alone. Very long texts are
scored, and learnt from, whole. Repeated rows get equal scores (and are learnt from once), a score of exactly 0.5 is
label 1; other columns, whatever their names, are ignored. Without labelled rows of both kinds every score is 0.5. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irengine.llm.common import as_ids, trim, code_chunks, labelled, lean, mix, only, span_hashes, spans, U64, white

SAMPLE_DOCS = 1_500  # labelled documents of each kind that are learnt from
SAMPLE_BYTES = 6 << 20  # of their texts, of each kind; the text that crosses the bound still counts
BUCKETS_LOG2 = 17
DIM = 8
MAX_WEIGHT = 4.0  # of a training document, relative to balanced labels
SCHEMA = "doc_id long, score double, predicted int"
Bag = tuple[np.ndarray, np.ndarray]  # buckets of a text, and how often each occurs


def features(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of every word, word pair, word triple with equal words, and gram; a gram takes its word's borders along as spaces."""
    blank = white(codes)
    ws, we = spans(~blank, off)
    shift = U64(64 - BUCKETS_LOG2)
    words = span_hashes(codes, ws, we)
    text = np.searchsorted(off, ws, "right")
    pair = np.flatnonzero(text[1:] == text[:-1])
    triple = np.flatnonzero(text[2:] == text[:-2])
    x, y, z = words[triple], words[triple + 1], words[triple + 2]
    equal = (x == y) + 2 * (y == z) + 4 * (x == z)
    triple, equal = triple[equal > 0], equal[equal > 0]
    n = len(codes)
    symbol = np.where(blank, 32, codes).astype(U64)  # any white space reads as one kind of border, and so do a text's ends
    head, tail = off[:-1][off[:-1] < n], off[1:][off[1:] > 0] - 1

    def shifted(by: int) -> np.ndarray:
        """The symbol so many places on, within the text."""
        out = np.full(n, 32, U64)
        out[max(0, -by) : n - max(0, by)] = symbol[max(0, by) : n - max(0, -by)]
        for k in range(abs(by)):
            out[np.clip(head + k if by < 0 else tail - k, 0, n - 1)] = 32
        return out

    with np.errstate(over="ignore"):
        found = [words >> shift, mix(words[pair] * U64(3) + words[pair + 1]) >> shift, mix(equal.astype(U64) * U64(0xA24BAED4963EE407)) >> shift]
        at = [ws, ws[pair + 1], ws[triple + 2]]
        after = shifted(1)
        three = shifted(-1) * U64(0x9FB21C651E98DF25) + symbol * U64(0xC2B2AE3D27D4EB4F) + after * U64(0x165667B19E3779F9)
        four = three + shifted(2) * U64(0x27D4EB2F165667C5) + U64(0x2545F4914F6CDD1D)
        inside = symbol != 32
        for grams, ok in ((three, inside), (four, inside & (after != 32))):
            i = np.flatnonzero(ok)
            h = grams[i]
            found.append(((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)) >> shift)
            at.append(i)
    return np.concatenate(found).astype(np.int64), np.concatenate(at)


def sums(table: np.ndarray, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table over a text's features, and their number."""
    bucket, at = features(codes, off)
    doc = np.searchsorted(off, at, "right") - 1
    n = len(off) - 1
    return np.bincount(doc, table[bucket], n), np.bincount(doc, minlength=n)


def bags(col: pa.Array) -> list[Bag]:
    """The bag of each text of a column."""
    out: list[Bag] = []
    for lo, hi, codes, off in code_chunks(col):
        bucket, at = features(codes, off)
        doc = np.searchsorted(off, at, "right") - 1
        key, count = np.unique(doc << BUCKETS_LOG2 | bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(hi - lo + 1) << BUCKETS_LOG2)
        ids = (key & ((1 << BUCKETS_LOG2) - 1)).astype(np.int32)
        out += [(ids[a:b], count[a:b].astype(np.int32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def train(sample: list[tuple[Bag, int]], epochs: int = 6, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, float]:
    """(number per bucket, bias) of the log-odds of label 1."""
    table = np.zeros(1 << BUCKETS_LOG2, np.float32)
    if len({y for _, y in sample}) < 2:
        return table, 0.0
    y = np.array([y for _, y in sample])
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # the rarer label weighs more, within a bound that keeps steps small where it is very rare
    weight = np.minimum(np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()), MAX_WEIGHT)
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            lr = rate * (1 - step / steps)
            step += 1
            ids, counts = sample[i][0]
            share = counts.astype(np.float32) / max(1, int(counts.sum()))
            mean = share @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[i]
            grad = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # each vector moves by its own gradient, scaled up since a mean spreads it thin
            emb[ids] -= (lr * 50 * share)[:, None] * grad
    return emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def scores(col: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    """Probability of label 1 of each text of a column."""
    table, bias = model
    parts = [np.zeros(0)]
    for _, _, codes, off in code_chunks(col):
        s, n = sums(table, codes, off)
        parts.append(1 / (1 + np.exp(-np.clip(s / np.maximum(n, 1) + bias, -40, 40))))
    return np.concatenate(parts)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BUCKETS_LOG2 floats

    @lean
    def run(batches):
        for batch in batches:
            p = scores(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return as_ids(docs).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, with all their columns; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return only(docs, lambda text: pa.array(scores(text, shared.value) >= 0.5))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model learnt from a bounded sample of the labelled documents."""

    @lean
    def count(batches):
        for batch in batches:
            ids, counts = zip(*[(i.tobytes(), c.tobytes()) for i, c in bags(batch.column("text"))], strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("doc_id"), batch.column("th"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["y", "doc_id", "th", "ids", "counts"])

    table = labelled(docs, labels, "quality", SAMPLE_DOCS, SAMPLE_BYTES).mapInArrow(count, "y int, doc_id long, th long, ids binary, counts binary").toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "th", "y", "ids", "counts")), strict=True))
    del table
    model = train([((np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)), y) for _, _, y, i, c in rows])
    del rows
    trim()
    return model


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); held_out says that a row's label was never learnt from."""
    model = fit(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
