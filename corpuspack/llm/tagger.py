"""A character tagger in numpy: a bidirectional LSTM whose emissions a linear-chain CRF decodes.

Trained on short labelled windows by Adam on the exact negative log-likelihood (forward-backward), decoded by
Viterbi. Everything is seeded, so equal windows give equal weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def transitions_allowed(n_kinds: int) -> np.ndarray:
    """Tags are outside (0), then begin and inside of each kind (1 + 2k, 2 + 2k); inside follows its own kind only."""
    n = 1 + 2 * n_kinds
    allowed = np.ones((n, n), dtype=bool)
    for k in range(n_kinds):
        allowed[:, 2 + 2 * k] = False
        allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return allowed


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


@dataclass
class Tagger:
    """Weights: ``embed``; ``wx, wh, b`` of both directions; ``wo, bo`` to the tags; ``trans`` between tags."""

    weights: dict[str, np.ndarray]
    allowed: np.ndarray

    @classmethod
    def fresh(cls, n_symbols: int, n_kinds: int, embed: int = 12, hidden: int = 16, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        allowed = transitions_allowed(n_kinds)
        k = len(allowed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        w = {
            "embed": draw(n_symbols, embed) * np.float32(np.sqrt(n_symbols)) * np.float32(0.5), "wx": draw(2, embed, 4 * hidden), "wh": draw(2, hidden, 4 * hidden),
            "b": np.zeros((2, 1, 4 * hidden), np.float32), "wo": draw(2 * hidden, k), "bo": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32),
        }
        w["b"][..., hidden : 2 * hidden] = 1.0  # forget gates begin open
        return cls(w, allowed)

    def _forward(self, codes: np.ndarray):
        w = self.weights
        hidden = w["wh"].shape[1]
        n, t = codes.shape
        x = w["embed"][codes.T]  # time, window, embedding
        both = np.stack([x, x[::-1]])
        pre = (both.reshape(2, t * n, -1) @ w["wx"] + w["b"]).reshape(2, t, n, -1)
        h = np.zeros((2, n, hidden), np.float32)
        c = np.zeros_like(h)
        kept = []
        for s in range(t):
            z = pre[:, s] + h @ w["wh"]
            gates = _sigmoid(z[..., : 3 * hidden])
            g = np.tanh(z[..., 3 * hidden :])
            i, f, o = gates[..., :hidden], gates[..., hidden : 2 * hidden], gates[..., 2 * hidden :]
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            kept.append((gates, g, before, tc, h_before, h))
        hs = np.stack([k[5] for k in kept], axis=1)
        out = np.concatenate([hs[0], hs[1, ::-1]], axis=-1)
        return both, kept, out, out @ w["wo"] + w["bo"]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """``window, time, tag`` scores of windows of symbols."""
        return self._forward(codes)[3].transpose(1, 0, 2)

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient."""
        w = self.weights
        hidden = w["wh"].shape[1]
        n, t = codes.shape
        both, kept, out, scores = self._forward(codes)
        steps = np.where(self.allowed, np.exp(w["trans"]), 0.0)
        top = scores.max(axis=2, keepdims=True)
        e = np.exp(scores - top).astype(np.float64)
        alpha, scale = np.empty_like(e), np.empty((t, n, 1))
        first = self.allowed[0]  # a window begins like after an outside tag
        a = e[0] * first
        for s in range(t):
            if s:
                a = (a @ steps) * e[s]
            scale[s] = a.sum(axis=1, keepdims=True)
            a = a / scale[s]
            alpha[s] = a
        beta = np.ones_like(a)
        marginal = np.empty_like(e)
        d_trans = np.zeros_like(steps)
        for s in range(t - 1, -1, -1):
            marginal[s] = alpha[s] * beta
            if s:
                ahead = e[s] * beta / scale[s]
                d_trans += steps * (alpha[s - 1].T @ ahead)
                beta = ahead @ steps.T
        y = tags.T
        at, row = np.arange(t)[:, None], np.arange(n)[None, :]
        path = scores[at, row, y].sum() + w["trans"][y[:-1], y[1:]].sum()
        loss = (np.log(scale).sum() + top.sum() - path) / n
        np.add.at(d_trans, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        d_scores = marginal
        d_scores[at, row, y] -= 1.0
        d_scores = (d_scores / n).astype(np.float32)
        grads = {"trans": (np.where(self.allowed, d_trans, 0.0) / n).astype(np.float32)}
        flat = d_scores.reshape(t * n, -1)
        grads["wo"], grads["bo"] = out.reshape(t * n, -1).T @ flat, flat.sum(axis=0)
        d_out = (flat @ w["wo"].T).reshape(t, n, 2 * hidden)
        d_h_all = np.stack([d_out[..., :hidden], d_out[::-1, :, hidden:]])
        d_z = np.empty((2, t, n, 4 * hidden), np.float32)
        d_h, d_c = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
        d_wh = np.zeros_like(w["wh"])
        wh_back = w["wh"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            gates, g, before, tc, h_before, _ = kept[s]
            i, f, o = gates[..., :hidden], gates[..., hidden : 2 * hidden], gates[..., 2 * hidden :]
            d_h = d_h + d_h_all[:, s]
            d_c = d_c + d_h * o * (1.0 - tc * tc)
            z = d_z[:, s]
            z[..., :hidden] = d_c * g * i * (1.0 - i)
            z[..., hidden : 2 * hidden] = d_c * before * f * (1.0 - f)
            z[..., 2 * hidden : 3 * hidden] = d_h * tc * o * (1.0 - o)
            z[..., 3 * hidden :] = d_c * i * (1.0 - g * g)
            d_wh += h_before.transpose(0, 2, 1) @ z
            d_h = z @ wh_back
            d_c = d_c * f
        long = d_z.reshape(2, t * n, -1)
        grads["wh"] = d_wh
        grads["wx"] = both.reshape(2, t * n, -1).transpose(0, 2, 1) @ long
        grads["b"] = long.sum(axis=1, keepdims=True)
        d_both = (long @ w["wx"].transpose(0, 2, 1)).reshape(2, t, n, -1)
        d_x = d_both[0] + d_both[1, ::-1]
        grads["embed"] = np.zeros_like(w["embed"])
        np.add.at(grads["embed"], codes.T.ravel(), d_x.reshape(t * n, -1))
        return float(loss), grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 48, rate: float = 0.015, seed: int = 11) -> float:
        """Adam over shuffled batches with a falling rate; returns the last batch's loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        order, loss = np.zeros(0, np.int64), 0.0
        for step in range(1, steps + 1):
            if len(order) < min(batch, len(codes)):
                order = np.concatenate([order, rng.permutation(len(codes))])
            rows, order = order[:batch], order[batch:]
            loss, grads = self.gradient(codes[rows], tags[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            lower = rate * (1.0 - (step - 1) / steps) * min(1.0, 5.0 / (size + 1e-9)) ** 0.5
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.weights[k] = (self.weights[k] - lower * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def decode(self, scores: list[np.ndarray], cells: int = 1 << 21) -> list[np.ndarray]:
        """The best tag sequence (Viterbi) of each ``time, tag`` matrix; those of like length go together."""
        trans = np.where(self.allowed, self.weights["trans"], -1e9).astype(np.float32)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
        while order:
            longest = len(scores[order[-1]])
            width = max(1, min(len(order), cells // (longest * len(trans))))
            group, order = order[-width:], order[:-width]
            sizes = np.array([len(scores[i]) for i in group])
            e = np.zeros((longest, width, len(trans)), np.float32)
            for j, i in enumerate(group):
                e[: sizes[j], j] = scores[i]
            back = np.empty((longest, width, len(trans)), np.int8)
            best = np.where(self.allowed[0], e[0], -1e9)
            last = best.copy()
            for s in range(1, longest):
                ways = best[:, :, None] + trans
                back[s] = ways.argmax(axis=1)
                best = ways.max(axis=1) + e[s]
                ends = sizes == s + 1
                last[ends] = best[ends]
            tag = last.argmax(axis=1)
            tags = np.zeros((longest, width), np.int64)
            rows = np.arange(width)
            for s in range(longest - 1, -1, -1):
                tags[s] = tag
                if s:
                    tag = np.where(s < sizes, back[s, rows, tag], tag)
            for j, i in enumerate(group):
                out[i] = tags[: sizes[j], j]
        return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of the tagged stretches."""
    edge = np.flatnonzero(tags % 2 == 1)  # begin tags
    out = []
    for a in edge.tolist():
        inside, b = tags[a] + 1, a + 1
        while b < len(tags) and tags[b] == inside:
            b += 1
        out.append((int(tags[a] - 1) // 2, a, b))
    return out
