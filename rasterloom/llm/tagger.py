"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by gradients, decoding of batches of windows."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
MARKS = "@.+-_%() \n\"'=,:/#&"
PAD = 0


def classes() -> np.ndarray:
    """Character class of each code point below 128, and last that of all others."""
    out = np.full(129, 2)
    out[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 3
    out[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 4
    out[[ord(c) for c in "0123456789"]] = 5
    for k, c in enumerate(MARKS):
        out[ord(c)] = 6 + k
    out[128] = 1
    return out


CLASSES = 6 + len(MARKS)


def legal() -> np.ndarray:
    """Penalties of transitions: inside only follows begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, hidden: int = 16, width: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.hidden = hidden
        self.p = {
            "emb": draw(CLASSES, width), "win": draw(2, width, 4 * hidden), "rec": draw(2, hidden, 4 * hidden), "bias": np.zeros((2, 1, 1, 4 * hidden), np.float32),
            "out": draw(2 * hidden, TAGS), "shift": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32),
        }
        self.p["bias"][..., hidden : 2 * hidden] = 1  # remember at first
        self.fence = legal().astype(np.float32)

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (rows, time, tags). Both directions run as one batch, the second over reversed windows."""
        p, h = self.p, self.hidden
        emb = p["emb"][x]
        both = np.stack([emb, emb[:, ::-1]])
        pre = np.matmul(both.reshape(2, -1, emb.shape[2]), p["win"]).reshape(2, *x.shape, 4 * h) + p["bias"]
        state = np.zeros((2, len(x), h), np.float32)
        cell = np.zeros_like(state)
        hs = np.empty((2, *x.shape, h), np.float32)
        for t in range(x.shape[1]):
            z = pre[:, :, t] + state @ p["rec"]
            gate, new = sigmoid(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
            before, old = state, cell
            cell = gate[..., h : 2 * h] * cell + gate[..., :h] * new
            flat = np.tanh(cell)
            state = gate[..., 2 * h :] * flat
            hs[:, :, t] = state
            if keep is not None:
                keep.setdefault("steps", []).append((gate, new, old, flat, before))
        joined = np.concatenate([hs[0], hs[1][:, ::-1]], axis=2)
        if keep is not None:
            keep |= {"both": both, "joined": joined}
        return joined @ p["out"] + p["shift"]

    def paths(self, e: np.ndarray) -> np.ndarray:
        """Best tags of each row (Viterbi)."""
        move, n = self.p["move"] + self.fence, e.shape[1]
        score, back = e[:, 0] + self.fence[0], np.empty(e.shape, np.int8)
        for t in range(1, n):
            step = score[:, :, None] + move
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + e[:, t]
        out = np.empty(e.shape[:2], np.int8)
        out[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(e))
        for t in range(n - 1, 0, -1):
            out[:, t - 1] = back[rows, t, out[:, t]]
        return out

    def forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        move, n = self.p["move"] + self.fence, e.shape[1]
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + self.fence[0]
        for t in range(1, n):
            a[:, t] = logsum(a[:, t - 1, :, None] + move, 1) + e[:, t]
        for t in range(n - 2, -1, -1):
            b[:, t] = logsum(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        return a, b, logsum(a[:, -1], 1)

    def marginals(self, e: np.ndarray) -> np.ndarray:
        a, b, z = self.forward_backward(e)
        return np.exp(a + b - z[:, None, None])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y, and its gradients."""
        p, h, n = self.p, self.hidden, x.shape[1]
        keep: dict = {}
        e = self.emissions(x, keep)
        a, b, z = self.forward_backward(e)
        move = p["move"] + self.fence
        rows, times = np.arange(len(x))[:, None], np.arange(n)
        gold = e[rows, times, y].sum(axis=1) + move[y[:, :-1], y[:, 1:]].sum(axis=1)
        d_e = np.exp(a + b - z[:, None, None])
        d_e[rows, times, y] -= 1
        d_e /= len(x)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for t in range(1, n):
            g["move"] += np.exp(a[:, t - 1, :, None] + move + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.subtract.at(g["move"], (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g["move"] /= len(x)
        g["out"] = np.einsum("bth,btk->hk", keep["joined"], d_e)
        g["shift"] = d_e.sum(axis=(0, 1))
        d_joined = d_e @ p["out"].T
        d_hs = np.stack([d_joined[..., :h], d_joined[:, ::-1, h:]])
        d_pre = np.empty((2, *x.shape, 4 * h), np.float32)
        d_state = np.zeros((2, len(x), h), np.float32)
        d_cell = np.zeros_like(d_state)
        for t in range(n - 1, -1, -1):
            gate, new, old, flat, before = keep["steps"][t]
            d_state = d_state + d_hs[:, :, t]
            d_cell = d_cell + d_state * gate[..., 2 * h :] * (1 - flat * flat)
            d = np.concatenate([d_cell * new, d_cell * old, d_state * flat], axis=2) * gate * (1 - gate)
            d_pre[:, :, t] = d = np.concatenate([d, d_cell * gate[..., :h] * (1 - new * new)], axis=2)
            g["rec"] += np.matmul(before.transpose(0, 2, 1), d)
            d_state, d_cell = np.matmul(d, p["rec"].transpose(0, 2, 1)), d_cell * gate[..., h : 2 * h]
        flat_pre = d_pre.reshape(2, -1, 4 * h)
        g["bias"] = flat_pre.sum(axis=1).reshape(p["bias"].shape)
        g["win"] = np.matmul(keep["both"].reshape(2, -1, p["emb"].shape[1]).transpose(0, 2, 1), flat_pre)
        d_emb = np.matmul(d_pre, p["win"].transpose(0, 2, 1)[:, None])
        np.add.at(g["emb"], x, d_emb[0] + d_emb[1][:, ::-1])
        return float((z - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 48, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam, with a falling rate; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, g = self.gradients(x[pick], y[pick])
            losses.append(loss)
            size = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            for k in self.p:
                d = g[k] * min(1.0, 5.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                self.p[k] = (self.p[k] - rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses
