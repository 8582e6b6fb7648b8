"""A small convolutional network over bytes, in numpy: embedding, filters of several widths, max pooling, softmax."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided, sliding_window_view

DIM = 8
WIDTHS = (2, 3, 5)
FILTERS = 16


def _starts(n: int, length: int, step: int) -> np.ndarray:
    return np.append(np.arange(0, n - length, step), n - length) if n > length else np.zeros(1, np.int64)


def _cut(data: bytes, length: int, starts: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= length:
        out = np.zeros((1, length), np.uint8)
        out[0, : len(raw)] = raw
        return out
    return sliding_window_view(raw, length)[starts]


def cut_windows(data: bytes, length: int, step: int) -> np.ndarray:
    """Windows of `length` bytes every `step` bytes that cover all of data; the last one ends where data ends, and data shorter than a window is padded with zeros."""
    return _cut(data, length, _starts(len(data), length, step))


def some_windows(data: bytes, length: int, step: int, most: int, seed: int) -> np.ndarray:
    """At most `most` of these windows, chosen at random by `seed`."""
    starts = _starts(len(data), length, step)
    return _cut(data, length, starts[np.random.default_rng(seed & (1 << 63) - 1).permutation(len(starts))[:most]])


class ByteCNN:
    """classes logits of a window of bytes. Weights are float32 arrays, so that a model is small and the same everywhere."""

    def __init__(self, classes: int, widths: tuple = WIDTHS, filters: int = FILTERS, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters, self.dim = widths, filters, dim
        f32 = np.float32
        self.p = {"e": rng.normal(0, 0.5, (256, dim)).astype(f32), "v": rng.normal(0, 0.1, (len(widths) * filters, classes)).astype(f32), "b": np.zeros(classes, f32)}
        for w in widths:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters)).astype(f32)
            self.p[f"c{w}"] = np.zeros(filters, f32)

    def _patches(self, x: np.ndarray, w: int) -> np.ndarray:
        """(batch, places, w * dim) view of the embedded bytes under a filter of width w."""
        n, length, d = x.shape
        s = x.strides
        return as_strided(x, (n, length - w + 1, w * d), (s[0], s[1], s[2]))

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max-pooled, rectified filter outputs of windows (n, length) of bytes."""
        out = np.empty((len(windows), len(self.widths) * self.filters), np.float32)
        # a block's patches stay in the processor's cache
        step = max(1, 6000 // max(1, windows.shape[1]))
        for at in range(0, len(windows), step):
            x = self.p["e"][windows[at : at + step]]
            for i, w in enumerate(self.widths):
                patches = np.ascontiguousarray(self._patches(x, w)).reshape(-1, w * self.dim)
                z = (patches @ self.p[f"w{w}"]).reshape(len(x), -1, self.filters).max(1) + self.p[f"c{w}"]
                out[at : at + step, i * self.filters : (i + 1) * self.filters] = np.maximum(z, 0)
        return out

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return self.pooled(windows) @ self.p["v"] + self.p["b"]

    def gradients(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean weighted cross-entropy and its gradients; only the places that won the pooling pass any back."""
        x, parts = self.p["e"][windows], []
        for w in self.widths:
            patches = self._patches(x, w)
            z = patches @ self.p[f"w{w}"]
            top = z.argmax(1)
            parts.append((w, patches, top, np.take_along_axis(z, top[:, None], 1)[:, 0] + self.p[f"c{w}"]))
        h = np.maximum(np.hstack([m for *_, m in parts]), 0)
        out = h @ self.p["v"] + self.p["b"]
        out -= out.max(1, keepdims=True)
        prob = np.exp(out)
        prob /= prob.sum(1, keepdims=True)
        n = np.arange(len(target))
        loss = -float((np.log(prob[n, target] + 1e-9) * weight).mean())
        d = prob
        d[n, target] -= 1
        d *= weight[:, None] / len(target)
        g = {"v": h.T @ d, "b": d.sum(0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["v"].T) * (h > 0)
        for i, (w, patches, top, _) in enumerate(parts):
            own = dh[:, i * self.filters : (i + 1) * self.filters]
            won = patches[n[:, None], top]  # (n, filters, w * dim)
            g[f"w{w}"] = np.einsum("nf,nfk->kf", own, won)
            g[f"c{w}"] = own.sum(0)
            back = (own[:, :, None] * self.p[f"w{w}"].T[None]).reshape(-1, self.dim)
            places = windows[n[:, None, None], top[:, :, None] + np.arange(w)].ravel()
            for k in range(self.dim):
                g["e"][:, k] += np.bincount(places, back[:, k], 256)
        return loss, g

    def fit(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> ByteCNN:
        """Adam over shuffled batches, the same for the same input."""
        rng = np.random.default_rng(seed)
        weight = np.ones(len(target), np.float32) if weight is None else weight.astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, max(1, epochs * -(-len(target) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                _, g = self.gradients(windows[some], target[some], weight[some])
                step += 1
                lr = rate * (1 - 0.9 * step / steps) / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
                for k, v in g.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.001 * (v * v - s[k])
                    self.p[k] -= (lr * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
        return self
