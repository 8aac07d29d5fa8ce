"""Operator 3, token counts: a map-side two-tier lookup.

Tier 1 is a broadcast table of the pre-tokens that a bounded sample shows to be
frequent; tier 2 is a cache in each Python worker that encodes what tier 1
lacks. No pre-token is ever shuffled: the plan is one scan and one Arrow map.

A pre-token is a run of spaces with the text up to the next space. No piece of
the vocabulary holds the space mark after another character, so no merge
crosses that border and the counts of pre-tokens add up to the library's count.

Null or empty text: 0 bytes, 0 tokens. Very long texts are walked whole. Repeated rows are
counted independently, each its own; of merges with equal scores the library takes the left one, so ties can't differ.
Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irengine.llm.common import as_ids, lean

TOP = 32_768  # entries of tier 1, the bound of the broadcast
SAMPLE_DOCS = 2_000  # texts that tier 1 is chosen from; no influence on results
SAMPLE_CHARS = 20_000  # longer texts are not used for choosing tier 1
CACHE = 400_000  # entries of a worker's cache before it starts afresh
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

PRETOKEN = re.compile(" +[^ ]*")
_MODELS: dict = {}


def processor(path: str):
    """The library's model, loaded once in each Python process."""
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text; the leading space is the one that the model puts before every text."""
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    return PRETOKEN.findall(" " + text)


class Lengths(dict):
    """Pre-token -> number of tokens; what is absent is encoded and remembered."""

    def __init__(self, frequent: dict[str, int], path: str) -> None:
        super().__init__(frequent)
        self.frequent, self.model, self.tail = frequent, processor(path), {}

    def __missing__(self, token: str) -> int:
        if "\n" in token:  # a newline is a byte token of its own, and no merge crosses it
            head, *rest = token.split("\n")
            return self[head] + sum(1 + (self._bare(x) if x else 0) for x in rest)
        n = len(self.model.encode(token[1:])) if len(token) > 1 else 1
        if len(self) >= CACHE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        self[token] = n
        return n

    def _bare(self, word: str) -> int:
        """Tokens of a word that no space mark precedes."""
        n = self.tail.get(word)
        if n is None:
            if len(self.tail) >= CACHE // 4:
                self.tail.clear()
            n = self.tail[word] = len(self.model.encode("\n" + word)) - 2
        return n


def frequent_lengths(docs: DataFrame, path: str, top: int = TOP) -> dict[str, int]:
    """Tier 1: token counts of the ``top`` most frequent pre-tokens of a bounded sample."""
    rows = docs.select("text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).limit(SAMPLE_DOCS).collect()
    counts: Counter = Counter()
    for r in rows:
        counts.update(t for t in pretokens(r.text) if "\n" not in t)
    own = Lengths({}, path)
    return {t: own[t] for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    docs = as_ids(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path))

    @lean
    def count(batches):
        table = Lengths(shared.value, model_path)
        look = table.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(sum(map(look, pretokens(text))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(count, SCHEMA)
