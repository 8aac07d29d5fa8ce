"""Term statistics and extractive summaries."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from irengine.functions import text as tx


def tf(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(doc_id, term, tf): share of the term among the document's tokens."""
    w = docs.select("doc_id", (tx.words(F.col("text")) if tokens is None else tokens).alias("w"))
    rows = w.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("term"))
    return rows.groupBy("doc_id", "term").agg((F.count("*") / F.first("n")).alias("tf"))


def idf(docs: DataFrame) -> DataFrame:
    """(term, idf): ln(N / df), documents being whatever the rows are."""
    df = docs.select(F.explode(F.array_distinct(tx.words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*")).scalar()
    return df.select("term", F.ln(n / F.col("df")).alias("idf"))


def tfidf_top(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, rank, term, tfidf): the k best terms of each document, ties by term."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "term")
    scored = tf(docs).join(idf(docs), "term").select("doc_id", "term", F.round(F.col("tf") * F.col("idf"), 9).alias("tfidf"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "rank", "term", "tfidf")


# ---------------------------------------------------------------- sentences of one document
def sentence_rows(docs: DataFrame, split=tx.sentences) -> DataFrame:
    """(doc_id, sent, sentence) with 0-based positions; blank sentences stay out."""
    rows = docs.select("doc_id", F.posexplode(split(F.col("text"))).alias("sent", "sentence"))
    return rows.where(F.trim("sentence") != "")


class SentenceGraphs:
    """TF-IDF vectors of the sentences of many documents, and the links between similar ones of a document.

    IDF is taken over the document's own sentences with words. Sentences of a document with equal words
    are one node with a multiplicity, so repeated lines don't make the graph quadratic. All nodes are numbered
    through, so that every step is one over whole arrays; similarities are made for blocks of rows of at most
    CELLS cells and products (or for a single row).
    """

    CELLS = 1 << 20

    def __init__(self, tokens: pa.ListArray, threshold: float) -> None:
        """``tokens``: for each document its sentences as lists of words; null ones stay out."""
        sentences = tokens.flatten()
        there = sentences.is_valid().to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
        #: document and position of each sentence
        self.doc = np.repeat(np.arange(len(tokens)), size)[there]
        self.sent = (np.arange(len(there)) - np.repeat(_firsts(size)[:-1], size))[there]
        sentences = sentences.filter(pa.array(there))
        n_words = pc.list_value_length(sentences).to_numpy()
        same = pc.binary_join(sentences, " ").dictionary_encode().indices.to_numpy().astype(np.int64)
        keys, first, self.node = np.unique(self.doc * (len(same) + 1) + same, return_index=True, return_inverse=True)
        self.times = np.bincount(self.node, minlength=len(keys))
        self.doc_of = self.doc[first]
        words = sentences.flatten().dictionary_encode()
        self._weigh(words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary)), _firsts(n_words)[first], n_words[first])
        self._link(threshold)

    def _weigh(self, terms: np.ndarray, n_terms: int, begin: np.ndarray, size: np.ndarray) -> None:
        """Entries of the normed vectors in the order of nodes: at, term (one number for each document and term) and x."""
        m = len(size)
        places = np.repeat(begin - _firsts(size)[:-1], size) + np.arange(size.sum())
        entry, count = np.unique(np.repeat(np.arange(m), size) * n_terms + terms[places], return_counts=True)
        at = entry // n_terms
        term = np.unique(self.doc_of[at] * n_terms + entry % n_terms, return_inverse=True)[1]
        df = np.bincount(term, self.times[at])[term] if len(term) else np.zeros(0)
        live = np.bincount(self.doc_of, self.times * (size > 0), minlength=1)[self.doc_of[at]]
        use = df < live
        at, term = at[use], term[use]
        w = count[use] / size[at] * np.log(live[use] / df[use])
        self.at, self.term, self.x = at, term, w / np.sqrt(np.bincount(at, w * w, m))[at]
        self.twin = (self.times > 1) & (np.bincount(at, minlength=m) > 0)

    def _link(self, threshold: float) -> None:
        """a, b: the links, a node with itself if it stands for several sentences with weights; best: the highest similarity to another sentence."""
        m = len(self.times)
        by_term = np.argsort(self.term, kind="stable")
        term_n = np.bincount(self.term)
        begin = _firsts(term_n)
        low = np.searchsorted(self.doc_of, self.doc_of, "left")  # first node of each node's document
        row = _firsts(np.searchsorted(self.doc_of, self.doc_of, "right") - low)  # first cell of each node's row
        entries = np.searchsorted(self.at, np.arange(m + 1))
        products = _firsts(term_n[self.term])[entries]
        self.best = np.zeros(m)
        a, b, lo = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
        while lo < m:
            hi = max(lo + 1, min(int(np.searchsorted(c, c[lo] + self.CELLS, "right")) - 1 for c in (row, products)))
            e = np.arange(entries[lo], entries[hi])
            n = term_n[self.term[e]]
            left = np.repeat(e, n)
            right = by_term[np.repeat(begin[self.term[e]] - _firsts(n)[:-1], n) + np.arange(len(left))]
            cell = row[self.at[left]] - row[lo] + self.at[right] - low[self.at[left]]
            sims = np.bincount(cell, self.x[left] * self.x[right], int(row[hi] - row[lo])).astype(float)
            own = np.arange(lo, hi)
            itself = row[own] - row[lo] + own - low[own]
            sims[itself] = self.twin[lo:hi]
            self.best[lo:hi] = np.maximum.reduceat(sims, row[lo:hi] - row[lo])
            sims[itself] = np.where(self.twin[lo:hi], np.inf, -np.inf)
            found = np.flatnonzero(sims > threshold)
            k = np.searchsorted(row, found + row[lo], "right") - 1
            a.append(k.astype(np.int32))
            b.append((found + row[lo] - row[k] + low[k]).astype(np.int32))
            lo = hi
        self.a, self.b = np.concatenate(a), np.concatenate(b)

    def degrees(self) -> np.ndarray:
        """Number of other sentences that each node is linked with."""
        return np.bincount(self.a, self.times[self.b], len(self.times)).astype(np.int64) - self.twin

    def walk(self, rounds: int | None, eps: float) -> np.ndarray:
        """Score of each node's sentences once a step p <- p M changes its document's (L2) by less than eps, or after ``rounds`` steps, if given."""
        m = len(self.times)
        if not m:
            return np.zeros(0)
        degree = self.degrees() + 1
        p = 1 / np.bincount(self.doc_of, self.times)[self.doc_of]
        a, b, goes_on = self.a, self.b, np.ones(int(self.doc_of[-1]) + 1, bool)
        for _ in itertools.count() if rounds is None else range(rounds):
            flow = p / degree
            mass = flow * self.times
            # own share, and for twins the shares of the others with equal words
            new = np.where(goes_on[self.doc_of], np.bincount(a, mass[b], m) - np.where(self.twin, flow, 0.0) + flow, p)
            change = np.sqrt(np.bincount(self.doc_of, self.times * (new - p) ** 2))
            p = new
            goes_on &= change >= eps
            if not goes_on.any():
                break
            kept = goes_on[self.doc_of[a]]
            if 2 * kept.sum() < len(a):
                a, b = a[kept], b[kept]
        return p


def _firsts(size: np.ndarray) -> np.ndarray:
    """Places at which spans of these sizes begin, with the total at the end."""
    return np.append(0, np.cumsum(size))


def _tokens(docs: DataFrame, split) -> DataFrame:
    """(doc_id, tokens): words of every sentence, from the JVM; blank sentences are null."""
    return docs.where("text is not null").select("doc_id", F.transform(split(F.col("text")), lambda s: F.when(F.trim(s) != "", tx.words(s))).alias("tokens"))


#: Words of documents whose graphs are made at once (or those of one longer document).
CHUNK_WORDS = 1 << 16


def _by_document(docs: DataFrame, split, columns: str, threshold: float, rows) -> DataFrame:
    """One pass over documents; ``rows`` maps their graphs to columns by node. Documents are never shuffled."""

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            inner = pc.fill_null(pc.list_value_length(tokens.flatten()), 0).to_numpy()
            n_words = _firsts(inner)[_firsts(pc.list_value_length(tokens).to_numpy())]
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(n_words, n_words[lo] + CHUNK_WORDS, "right")) - 1)
                g = SentenceGraphs(tokens.slice(lo, hi - lo), threshold)
                values = {name: pa.array(x[g.node]) for name, x in rows(g).items()} if len(g.doc) else {}
                if values:
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(g.doc + lo)).cast(pa.int64()), "sent": pa.array(g.sent, pa.int32()), **values})
                lo = hi

    return _tokens(docs, split).mapInArrow(run, f"doc_id long, sent int, {columns}")


def sentence_similarity(docs: DataFrame, threshold: float = 0.3, split=tx.sentences) -> DataFrame:
    """(doc_id, sent, n_similar, max_sim): sentences of the same document with a cosine above the threshold, and the best cosine."""
    return _by_document(docs, split, "n_similar long, max_sim double", threshold, lambda g: {"n_similar": g.degrees(), "max_sim": g.best})


def lexrank(docs: DataFrame, threshold: float = 0.3, rounds: int | None = None, eps: float = 1e-3, split=tx.sentences) -> DataFrame:
    """(doc_id, sent, score): random walk over the sentences of a document, linked where the cosine exceeds the threshold.

    Every sentence links to itself and rows of the matrix add up to 1, so the walk converges: it goes on until a step changes
    the scores by less than eps. With ``rounds`` and eps = 0 exactly so many steps are made.
    """
    return _by_document(docs, split, "score double", threshold, lambda g: {"score": g.walk(rounds, eps)})


def top_sentences(scores: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, rank, sent, score): exactly k best sentences, ties by position."""
    rounded = scores.select("doc_id", "sent", F.round("score", 9).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "sent")
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "rank", "sent", "score")


def summaries(docs: DataFrame, k: int = 3, threshold: float = 0.3, eps: float = 1e-3, split=tx.sentences) -> DataFrame:
    """(doc_id, rank, sent, sentence): the k best sentences of each document, best first."""
    top = top_sentences(lexrank(docs, threshold, eps=eps, split=split), k)
    return top.join(sentence_rows(docs, split), ["doc_id", "sent"]).select("doc_id", "rank", "sent", "sentence")
