"""Recurrent layers in numpy, with their gradients; sequences are time-major (T, B, D) and masked by (T, B)."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, params: Params, rate: float = 0.01, clip: float = 5.0):
        self.params, self.rate, self.clip, self.t = params, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, self.clip / (norm + 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence back to front, its padding left at the end; undoes itself."""
    t = np.arange(x.shape[0])[:, None]
    return x[np.where(t < lengths, lengths - 1 - t, t), np.arange(x.shape[1])]


def lstm(xw: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple | None]:
    """Hidden states for inputs that are already projected on the gates (input, forget, output, new)."""
    steps, batch, n = xw.shape[0], xw.shape[1], u.shape[0]
    h, c = np.zeros((batch, n), xw.dtype), np.zeros((batch, n), xw.dtype)
    hs, kept = np.zeros((steps, batch, n), xw.dtype), []
    for t in range(steps):
        a = xw[t] + h @ u
        gates, new = sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
        m = mask[t][:, None]
        c2 = gates[:, n : 2 * n] * c + gates[:, :n] * new
        th = np.tanh(c2)
        if keep:
            kept.append((h, c, gates, new, th))
        h, c = m * (gates[:, 2 * n :] * th) + (1 - m) * h, m * c2 + (1 - m) * c
        hs[t] = h
    return hs, (kept, mask, u) if keep else None


def lstm_back(dhs: np.ndarray, cache: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    kept, mask, u = cache
    n = u.shape[0]
    dxw, du = np.zeros((*dhs.shape[:2], 4 * n), dhs.dtype), np.zeros_like(u)
    dh, dc = np.zeros(dhs.shape[1:], dhs.dtype), np.zeros(dhs.shape[1:], dhs.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h0, c0, g, new, th = kept[t]
        m = mask[t][:, None]
        dh = dh + dhs[t]
        here, through = m * dh, (1 - m) * dh
        i, f, o = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
        dc2 = m * dc + here * o * (1 - th * th)
        da = np.concatenate([dc2 * new * i * (1 - i), dc2 * c0 * f * (1 - f), here * th * o * (1 - o), dc2 * i * (1 - new * new)], axis=1)
        dxw[t], dh, dc = da, through + da @ u.T, (1 - m) * dc + dc2 * f
        du += h0.T @ da
    return dxw, du


def gru(xw: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple | None]:
    """Hidden states for inputs that are already projected on the gates (update, reset, new)."""
    steps, batch, n = xw.shape[0], xw.shape[1], u.shape[0]
    h = np.zeros((batch, n), xw.dtype)
    hs, kept = np.empty((steps, batch, n), xw.dtype), []
    for t in range(steps):
        a = h @ u
        gates = sigmoid(xw[t][:, : 2 * n] + a[:, : 2 * n])
        new = np.tanh(xw[t][:, 2 * n :] + gates[:, n:] * a[:, 2 * n :])
        if keep:
            kept.append((h, gates, new, a[:, 2 * n :]))
        h = h + mask[t][:, None] * (1 - gates[:, :n]) * (new - h)
        hs[t] = h
    return hs, (kept, mask, u) if keep else None


def gru_back(dhs: np.ndarray, cache: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    kept, mask, u = cache
    n = u.shape[0]
    dxw, du = np.zeros((*dhs.shape[:2], 3 * n), dhs.dtype), np.zeros_like(u)
    dh = np.zeros(dhs.shape[1:], dhs.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h0, g, new, an = kept[t]
        z, r = g[:, :n], g[:, n:]
        dh = dh + dhs[t]
        here = mask[t][:, None] * dh
        dn = here * (1 - z) * (1 - new * new)
        dz, dr = here * (h0 - new) * z * (1 - z), dn * an * r * (1 - r)
        dxw[t] = np.concatenate([dz, dr, dn], axis=1)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        dh = dh - here * (1 - z) + da @ u.T
        du += h0.T @ da
    return dxw, du


def add_rows(table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """table[ids] += rows, where ids may repeat."""
    if len(ids):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        table[ids[first]] += np.add.reduceat(rows[order], first, axis=0)


class Runs:
    """Runs of ids of different sizes, one behind the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)

    def take(self, at: np.ndarray) -> Runs:
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return Runs(self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)], sizes)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Means of the table's rows that each run names; empty runs are 0."""
        out, full = np.zeros((len(self.sizes), table.shape[1]), table.dtype), self.sizes > 0
        if full.any():
            out[full] = np.add.reduceat(table[self.ids], self.starts[full], axis=0) / self.sizes[full][:, None]
        return out

    def means_back(self, dout: np.ndarray, table: np.ndarray) -> np.ndarray:
        grad = np.zeros_like(table)
        add_rows(grad, self.ids, np.repeat((dout / np.maximum(self.sizes, 1)[:, None]).astype(table.dtype), self.sizes, axis=0))
        return grad
