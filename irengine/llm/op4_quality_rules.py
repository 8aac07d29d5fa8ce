"""Operator 4, quality rules: line labels from a linear-chain conditional random field.

Base statistics come from the whole text. The verdict comes from labelling the
sequence of lines as content or boilerplate by Viterbi decoding; a document is
kept if content lines hold at least half of its words.

The field's weights are trained here, from document labels only: lines of good
documents are content; lines of bad documents start as boilerplate and are
relabelled by the trained field once, so that clean lines of bad documents turn
into content. The sample is bounded by SAMPLE_DOCS whole texts and SAMPLE_BYTES per
label; executors turn its lines into features, and only these reach the driver.

Null or empty text, and text without a word: all counts 0, base_failed. Very long
texts are judged, and learnt from, whole. Ties of Viterbi go to content. Repeated rows are
judged independently (and learnt from once), other columns, whatever their names, are ignored. Without labelled rows
of both kinds the base rules alone decide. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from irengine.llm import crf
from irengine.llm.common import as_ids, trim, byte_view, chunks, labelled, lean, only, per_doc, shingles, space_words, span_hashes, spans

SAMPLE_DOCS = 1_200  # labelled documents of each kind that the field is trained on
SAMPLE_BYTES = 8 << 20  # of their texts, of each kind; the text that crosses the bound still counts
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate_lines long"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[0xC3] = 1
_SHOUT = np.zeros(256, np.int64)
_SHOUT[[ord("!"), ord("?")]] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
#: Cuts of each ratio; a feature says in which band the ratio lies.
CUTS = [(0.05, 0.2, 0.5), (0.15, 0.4, 0.7), (0.08, 0.3, 0.6), (0.1, 0.3), (0.2, 0.5, 0.8), (0.1, 0.3, 0.6), (2.5, 3.5, 8.0, 14.0), (0.5, 3.5, 8.5, 30.5), (0.5,)]
BASES = np.cumsum([0] + [len(c) + 1 for c in CUTS])
N_FEATS = int(BASES[-1])


class Chunk:
    """Statistics of the texts of one byte chunk, all from prefix sums and sorts."""

    def __init__(self, b: np.ndarray, off: np.ndarray) -> None:
        n = len(off) - 1
        cum = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        ws, we = space_words(b, off)
        first = per_doc(ws, off)
        self.n_words = np.diff(first)
        in_word = np.zeros(len(b) + 1, np.int64)
        np.add.at(in_word, ws, 1)
        np.add.at(in_word, we, -1)
        points = cum((np.cumsum(in_word[:-1]) > 0) & ((b & 0xC0) != 0x80))
        self.word_chars = points[off[1:]] - points[off[:-1]]
        symbols = cum(_SYMBOL[b])
        self.n_symbols = symbols[off[1:]] - symbols[off[:-1]]
        hashes = span_hashes(b, ws, we)
        covered = self._repeats(hashes, first, n)
        cov = cum(covered)
        self.n_repeat_words = cov[first[1:]] - cov[first[:-1]]

        ls, le = spans(b != 10, off)
        line_first = np.searchsorted(ws, ls, "left")
        line_end = np.searchsorted(ws, le, "left")
        live = line_end > line_first  # lines with a word
        ls, le, line_first, line_end = ls[live], le[live], line_first[live], line_end[live]
        self.lines = per_doc(ls, off)
        line_doc = np.repeat(np.arange(n), np.diff(self.lines))
        self.line_words = line_end - line_first
        lh = span_hashes(b, ls, le)
        order = np.lexsort((ls, lh, line_doc))
        dup = np.zeros(len(ls), bool)
        if len(ls) > 1:
            same = (lh[order][1:] == lh[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
            dup[order[1:][same]] = True
        dups = cum(dup)
        self.n_dup_lines = dups[self.lines[1:]] - dups[self.lines[:-1]]

        words = np.maximum(self.line_words, 1)
        over = lambda c: c[le] - c[ls]
        letters, size = np.maximum(over(cum(_LETTER[b])), 1), le - ls
        echo = np.zeros(len(hashes), np.int64)
        if len(hashes) > 1:
            echo[1:] = hashes[1:] == hashes[:-1]
        echoes = cum(echo)
        ratios = [
            over(symbols) / words, over(cum(_UPPER[b])) / letters, over(cum(_SHOUT[b])) / words, over(cum(_DIGIT[b])) / np.maximum(size, 1),
            (cov[line_end] - cov[line_first]) / words, (echoes[line_end] - echoes[line_first]) / words, (size - words + 1) / words, self.line_words.astype(float), dup.astype(float),
        ]
        self.feats = np.stack([BASES[i] + np.searchsorted(CUTS[i], r) for i, r in enumerate(ratios)], 1) if len(ls) else np.zeros((0, len(CUTS)), int)

    @staticmethod
    def _repeats(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """Words that lie in a 5-word window found twice or more in their text."""
        counts = np.diff(first)
        cover = np.zeros(len(hashes) + 1, np.int64)
        h, doc, at = shingles(hashes, first)
        long = counts[doc] >= 5
        h, doc, at = h[long], doc[long], at[long]
        if len(h) > 1:
            order = np.lexsort((h, doc))
            same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            np.add.at(cover, at[twice], 1)
            np.add.at(cover, at[twice] + 5, -1)
        return np.cumsum(cover[:-1]) > 0


def line_features(col: pa.Array) -> list[np.ndarray]:
    """(lines, features) of each text of a column."""
    raw, off = byte_view(col)
    out = []
    for lo, hi in chunks(off):
        c = Chunk(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        out += [c.feats[c.lines[i] : c.lines[i + 1]].astype(np.uint8) for i in range(hi - lo)]
    return out


def train(sample: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, list] | None:
    """Weights and transitions of the field from (line features, label) pairs; tag 1 is boilerplate. None if a label lacks."""
    if len({y for _, y in sample}) < 2:
        return None
    seqs, tags, bad = [], [], []
    for x, good in sample:
        for i in range(0, len(x), 64):
            seqs.append(x[i : i + 64])
            tags.append(np.full(len(seqs[-1]), 1 - good))
            bad.append(not good)
    if not seqs:
        return None
    w, a = crf.fit(seqs, tags, N_FEATS, epochs=8)
    u = [w[x].sum(1).tolist() for x in seqs]
    tags = [np.array(crf.viterbi(v, a.tolist())) if b else t for v, t, b in zip(u, tags, bad, strict=True)]
    w, a = crf.fit(seqs, tags, N_FEATS, epochs=8)
    return w, a.tolist()


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list] | None:
    """The field learnt from a bounded sample of the labelled documents."""

    @lean
    def lines(batches):
        for batch in batches:
            feats = [x.tobytes() for x in line_features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("doc_id"), batch.column("th"), pa.array(feats, pa.binary())], ["y", "doc_id", "th", "feats"])

    table = labelled(docs, labels, "quality", SAMPLE_DOCS, SAMPLE_BYTES).mapInArrow(lines, "y int, doc_id long, th long, feats binary").toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "th", "y", "feats")), strict=True))
    del table
    model = train([(np.frombuffer(f, np.uint8).reshape(-1, len(CUTS)), y) for _, _, y, f in rows])
    del rows
    trim()
    return model


def verdicts(col: pa.Array, model: tuple | None) -> dict[str, pa.Array]:
    """Statistics and verdict of each text of a column, by the names of SCHEMA."""
    raw, off = byte_view(col)
    cols: list[list] = [[] for _ in range(10)]
    for lo, hi in chunks(off):
        c = Chunk(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        failed = (c.n_words < 10) | (100 * c.n_repeat_words > 20 * c.n_words)
        share, bad_lines = np.ones(hi - lo), np.zeros(hi - lo, np.int64)
        if model is not None and len(c.feats):
            u = model[0][c.feats].sum(1).tolist()
            for i in range(hi - lo):
                s, e = int(c.lines[i]), int(c.lines[i + 1])
                tag = np.array(crf.viterbi(u[s:e], model[1]), bool)
                if e > s:
                    bad_lines[i] = tag.sum()
                    share[i] = c.line_words[s:e][~tag].sum() / c.line_words[s:e].sum()
        share[c.n_words == 0] = 0
        values = (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed, ~failed & (share >= 0.5), share, np.diff(c.lines), bad_lines)
        for k, v in enumerate(values):
            cols[k].append(v)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
    return {n: pa.array(np.concatenate(v) if v else np.zeros(0), k) for n, v, k in zip(names, cols, kinds, strict=True)}


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, model: tuple | None = None) -> DataFrame:
    """Statistics and verdict of every document (see SCHEMA)."""
    if model is None and labels is not None:
        model = fit(docs, labels)

    @lean
    def judge(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            found = verdicts(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(found[n] for n in names[1:])], names)

    return as_ids(docs).mapInArrow(judge, SCHEMA)


def keep(docs: DataFrame, model: tuple | None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; each row is judged by its own text."""
    return only(docs, lambda text: verdicts(text, model)["kept"])
