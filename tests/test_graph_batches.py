"""Sentence graphs of many documents at once."""

import random

import numpy as np
import pyarrow as pa

from irengine.operators import rank


def test_documents_together_as_alone(monkeypatch):
    rng = random.Random(5)
    docs = [[rng.choice((None, [rng.choice("abcdefgh") for _ in range(rng.randrange(5))])) for _ in range(rng.randrange(12))] for _ in range(30)]
    docs += [[], None, [None], [[]], [["a", "b"]] * 40 + [["c"]]]
    tokens = pa.array(docs, pa.list_(pa.list_(pa.string())))
    alone = [rank.SentenceGraphs(tokens.slice(k, 1), 0.3) for k in range(len(docs))]
    for cells in (1 << 20, 50):
        monkeypatch.setattr(rank.SentenceGraphs, "CELLS", cells)
        g = rank.SentenceGraphs(tokens, 0.3)
        assert list(zip(g.doc.tolist(), g.sent.tolist(), strict=True)) == [(k, int(i)) for k, a in enumerate(alone) for i in a.sent]
        assert g.degrees()[g.node].tolist() == [int(x) for a in alone for x in a.degrees()[a.node]]
        assert np.allclose(g.best[g.node], np.concatenate([a.best[a.node] for a in alone]))
        for rounds, eps in ((None, 1e-3), (60, 0.0)):
            assert np.allclose(g.walk(rounds, eps)[g.node], np.concatenate([a.walk(rounds, eps)[a.node] for a in alone]), atol=1e-12)
