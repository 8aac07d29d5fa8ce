"""Operator 7, language identification: prediction by partial matching over bytes.

For each language, counts of every context of 0 to 3 bytes and the byte after
it make a context tree (escape method C: after a context seen T times with D
distinct followers, a known follower has c / (T + D) and an escape D / (T + D)
leads to the context shorter by one byte; below order 0 all 256 bytes are equal).
A text's code length under each frozen tree decides, the shortest wins.

Trees are frozen before scoring, so the cost of every known 4-byte gram under all
languages is computed once and looked up in a hash table; only bytes whose
gram no language knows walk down the orders. Each language is learnt from at most
SAMPLE_DOCS whole texts of SAMPLE_BYTES in all; where there are so many languages that this would
pass TOTAL_DOCS or TOTAL_BYTES, each has an equal share of these, and one text at least. Every language is
learnt; tables are kept for GROUP languages at a time, so memory grows with the sample.

Null text, or text without a letter: ``und`` with score 0. Very long texts are walked, and learnt from, whole. Ties go to
the language first in alphabetical order. Repeated rows get equal results (and are learnt from once); other
columns, whatever their names, are ignored. Without anything to learn from, every text is ``und``. An
empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irengine.llm.common import as_ids, byte_view, chunks, lean, learnable, sampled

SAMPLE_DOCS = 600  # texts of each language that are learnt from
SAMPLE_BYTES = 4 << 20  # bytes of them; the text that crosses the bound still counts
TOTAL_DOCS, TOTAL_BYTES = 24_000, 32 << 20  # of all languages together
GROUP = 16  # languages whose costs share one table
ORDER = 3
SCHEMA = "doc_id long, lang_pred string, score double"
LETTER = re.compile(r"[^\W\d_]")


class Table:
    """Static hash table from integers to row numbers, in levels without collisions."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.levels, rows = [], np.arange(len(keys))
        salt = np.uint64(0x9E3779B97F4A7C15)
        while len(rows):
            shift = np.uint64(64 - bits)
            slot = ((keys[rows].astype(np.uint64) * salt) >> shift).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            key, row = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            key[slot[first]], row[slot[first]] = keys[rows[first]], rows[first]
            self.levels.append((salt, shift, key, row))
            rows = np.delete(rows, first)
            salt = np.uint64((int(salt) * 0xD1342543DE82EF95 & (2**64 - 1)) | 1)
            bits = max(8, bits - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it has none."""
        out = np.full(len(keys), -1, np.int32)
        todo = None
        for salt, shift, key, row in self.levels:
            own = keys if todo is None else keys[todo]
            slot = ((own.astype(np.uint64) * salt) >> shift).astype(np.int64)
            hit = key[slot] == own
            if todo is None:
                out[hit] = row[slot[hit]]
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = row[slot[hit]]
                todo = todo[~hit]
            if not len(todo):
                break
        return out


def grams(b: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of the n bytes that end at a position, with the first bytes of a text preceded by spaces; its text)."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    code = np.zeros(len(b), np.int64)
    at = np.arange(len(b)) - off[doc]
    for k in range(n - 1, -1, -1):
        x = np.full(len(b), 32, np.int64)
        if k < len(b):
            x[k:] = b[: len(b) - k]
        code = (code << 8) | np.where(at >= k, x, 32)
    return code, doc


class Trees:
    """Frozen trees of all languages. costs[n]: bits of the last byte of each known (n + 1)-gram after its n-byte context."""

    def __init__(self, langs: list[str], texts: list[list[str]]) -> None:
        self.langs, k = langs, len(langs)
        raw = [byte_view(pa.array(t, pa.string())) for t in texts]
        self.tables, self.costs, self.ctx, self.escape = [], [], [], []
        below = np.full((256, k), 8.0)
        for n in range(ORDER + 1):
            per = []
            for b, off in raw:
                per.append(np.unique(grams(b[off[0] : off[-1]], off - off[0], n + 1)[0], return_counts=True))
            keys = np.unique(np.concatenate([g for g, _ in per] + [np.zeros(0, np.int64)]))
            count = np.zeros((len(keys), k))
            for j, (g, c) in enumerate(per):
                count[np.searchsorted(keys, g), j] = c
            ctxs, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(ctxs), k)), np.zeros((len(ctxs), k))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                known = -np.log2(count / (total + kinds)[of])
            if n:
                shorter = self._lookup(n - 1, keys & ((1 << (8 * n)) - 1))
            else:
                shorter = below[keys]
            self.ctx.append(Table(ctxs))
            self.escape.append(escape)
            self.tables.append(Table(keys))
            self.costs.append(np.where(count > 0, known, escape[of] + shorter))

    def _lookup(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Bits of each (n + 1)-gram under every language, escaping as far as needed."""
        row = self.tables[n].find(keys)
        out = self.costs[n][np.maximum(row, 0)]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            c = self.ctx[n].find(keys[miss] >> 8)
            escape = np.where((c >= 0)[:, None], self.escape[n][np.maximum(c, 0)], 0.0)
            rest = self._lookup(n - 1, keys[miss] & ((1 << (8 * n)) - 1)) if n else np.full((len(miss), len(self.langs)), 8.0)
            out[miss] = escape + rest
        return out

    def bits(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each text under each language: (texts, languages)."""
        keys, doc = grams(b, off, ORDER + 1)
        cost = self._lookup(ORDER, keys)
        total = np.zeros((len(b) + 1, len(self.langs)))
        np.cumsum(cost, 0, out=total[1:])
        return total[off[1:]] - total[off[:-1]]


class Languages:
    """Trees of any number of languages, GROUP of them together."""

    def __init__(self, langs: list[str], texts: list[list[str]]) -> None:
        self.langs = langs
        self.groups = [Trees(langs[i : i + GROUP], texts[i : i + GROUP]) for i in range(0, len(langs), GROUP)]

    def bits(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.concatenate([g.bits(b, off) for g in self.groups], 1)


def learn(docs: DataFrame, per_lang: int = SAMPLE_DOCS, budget: int = SAMPLE_BYTES) -> Languages | None:
    """Trees of every language that a learnable row with a text has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & learnable("doc_id", 5, 0))
    n = rows.select(F.count_distinct("lang")).first()[0]
    if not n:
        return None
    picked = sampled(rows, None, "lang", max(1, min(per_lang, TOTAL_DOCS // n)), min(budget, TOTAL_BYTES // n)).select("lang", "doc_id", "th", "text").toArrow()
    by: dict[str, list[str]] = {}
    for lang, _, _, text in sorted(zip(*(picked.column(c).to_pylist() for c in ("lang", "doc_id", "th", "text")), strict=True)):
        by.setdefault(lang, []).append(text)
    return Languages(list(by), list(by.values())) if by else None


def identify(docs: DataFrame, trees: Languages | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; score is the posterior under equal priors, per byte-scaled lengths of at most 64 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    @lean
    def run(batches):
        model = shared.value
        for batch in batches:
            col = batch.column("text")
            raw, off = byte_view(col)
            pred, score = [], []
            for lo, hi in chunks(off, 1 << 18):
                b, o = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                if model is None or not len(b):
                    pred += ["und"] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                bits = model.bits(b, o)
                best = bits.argmin(1)
                size = np.maximum(np.diff(o), 1)
                d = (bits - bits.min(1, keepdims=True)) * (np.minimum(size, 64) / size)[:, None]
                p = 1 / np.exp2(-np.minimum(d, 1000)).sum(1)
                letter = ((b | 32) >= 97) & ((b | 32) <= 122)
                ascii_letter = np.concatenate([[0], np.cumsum(letter)])
                has = ascii_letter[o[1:]] > ascii_letter[o[:-1]]
                for i in range(hi - lo):
                    known = has[i] or (o[i + 1] > o[i] and LETTER.search(col[lo + i].as_py()) is not None)
                    pred.append(model.langs[best[i]] if known else "und")
                    score.append(float(p[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return as_ids(docs).mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
