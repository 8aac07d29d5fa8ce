"""Two-state linear-chain conditional random field over sparse indicator features."""

from __future__ import annotations

import numpy as np


def _messages(u: np.ndarray, a: np.ndarray, live: np.ndarray):
    """Forward and backward log messages of padded sequences; u: (B, T, 2), live: (B, T)."""
    n, t, _ = u.shape
    f, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    f[:, 0] = u[:, 0]
    for i in range(1, t):
        x = f[:, i - 1, :, None] + a[None]
        f[:, i] = np.where(live[:, i, None], np.logaddexp(x[:, 0], x[:, 1]) + u[:, i], f[:, i - 1])
    for i in range(t - 2, -1, -1):
        x = a[None] + (u[:, i + 1] + b[:, i + 1])[:, None, :]
        b[:, i] = np.where(live[:, i + 1, None], np.logaddexp(x[..., 0], x[..., 1]), 0)
    return f, b


def fit(seqs: list[np.ndarray], tags: list[np.ndarray], n_feats: int, epochs: int = 12, rate: float = 0.3, l2: float = 1e-4, batch: int = 256, seed: int = 7, chain: bool = True):
    """Weights (n_feats + 1, 2) and transitions (2, 2) by AdaGrad on the log-likelihood.

    A sequence is a (T, K) array of feature numbers; n_feats stands for "none". Without ``chain`` the
    transitions stay 0, so that every place is judged by itself. The gradients of a feature's two weights
    are opposite numbers, so one of them is kept.
    """
    rng = np.random.default_rng(seed)
    w, a = np.zeros(n_feats + 1), np.zeros((2, 2))
    gw, ga = np.full_like(w, 1e-6), np.full_like(a, 1e-6)
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    for _ in range(epochs):
        for g in (groups[i] for i in rng.permutation(len(groups))):
            t, k = max(len(seqs[i]) for i in g), seqs[g[0]].shape[1]
            if not t:
                continue
            x, y, live = np.full((len(g), t, k), n_feats, np.int32), np.zeros((len(g), t), int), np.zeros((len(g), t), bool)
            for r, i in enumerate(g):
                x[r, : len(seqs[i])], y[r, : len(seqs[i])], live[r, : len(seqs[i])] = seqs[i], tags[i], True
            odds = w[x].sum(2)
            u = np.stack([-odds, odds], 2)
            f, b = _messages(u, a, live) if chain else (u, 0 * u)
            z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])[:, None] if chain else np.logaddexp(u[..., 0], u[..., 1])
            d = (y - np.exp(f[..., 1] + b[..., 1] - z)) * live
            grad = np.bincount(x.reshape(-1), np.repeat(d.reshape(-1), k), n_feats + 1) / len(g) - l2 * w
            gw += grad**2
            w += rate * grad / np.sqrt(gw)
            w[n_feats] = 0
            if t > 1 and chain:
                pair = live[:, 1:]
                e = f[:, :-1, :, None] + a + (u[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, :, None, None]
                ta = -(np.exp(e) * pair[..., None, None]).sum((0, 1))
                np.add.at(ta, (y[:, :-1][pair], y[:, 1:][pair]), 1)
                ta = ta / len(g) - l2 * a
                ga += ta**2
                a += rate * ta / np.sqrt(ga)
    return np.stack([-w, w], 1), a


def viterbi(u: list[list[float]], a: list[list[float]]) -> list[int]:
    """Best tags of one sequence; ties go to tag 0."""
    if not u:
        return []
    s0, s1 = u[0]
    a00, a01, a10, a11 = a[0][0], a[0][1], a[1][0], a[1][1]
    back = []
    for u0, u1 in u[1:]:
        x0, y0, x1, y1 = s0 + a00, s1 + a10, s0 + a01, s1 + a11
        back.append((0 if x0 >= y0 else 1, 0 if x1 >= y1 else 1))
        s0, s1 = (x0 if x0 >= y0 else y0) + u0, (x1 if x1 >= y1 else y1) + u1
    tag = 0 if s0 >= s1 else 1
    out = [tag]
    for b in reversed(back):
        tag = b[tag]
        out.append(tag)
    return out[::-1]
