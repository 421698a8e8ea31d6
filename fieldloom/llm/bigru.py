"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words: a learned vector for each frequent word joined with the mean of learned
vectors of its character trigrams.  A window of words runs through one gated recurrent
layer in each direction, attention pools the states, and a logistic unit scores them.
"""

from __future__ import annotations

import numpy as np

WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8, 8, 12, 8
CHAR_BUCKETS = 4096
GATES = 3 * HIDDEN
F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams (of UTF-8 bytes, with marks at both ends) of all words, and how
    many each word has: at least one."""
    raw = [w.encode() for w in words]
    size = np.array([len(w) for w in raw])
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in raw), np.uint8).astype(np.uint32)
    first = np.cumsum(size + 2) - size - 2
    at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
    gram = flat[at] | flat[at + 1] << np.uint32(8) | flat[at + 2] << np.uint32(16)
    return ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), size


class BiGru:
    """The network's parameters, its scores and its training step."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: any other word
        inputs = WORD_SIZE + CHAR_SIZE

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(F32)

        self.p = {
            "word": draw(len(vocabulary) + 1, WORD_SIZE, scale=0.1),
            "char": draw(CHAR_BUCKETS, CHAR_SIZE, scale=0.3),
            "attend": draw(2 * HIDDEN, ATTENTION, scale=0.2),
            "attend_bias": np.zeros(ATTENTION, F32),
            "attend_out": draw(ATTENTION, scale=0.3),
            "out": draw(2 * HIDDEN, scale=0.3),
            "out_bias": np.zeros(1, F32),
        }
        for side in ("f", "b"):
            self.p[f"x_{side}"] = draw(inputs, GATES, scale=inputs**-0.5)
            self.p[f"x_bias_{side}"] = np.zeros(GATES, F32)
            self.p[f"h_{side}"] = draw(HIDDEN, GATES, scale=HIDDEN**-0.5)
            self.p[f"h_bias_{side}"] = np.zeros(GATES, F32)
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    # --- inputs ---------------------------------------------------------------------------

    def word_rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))

    def vectors(self, rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return np.concatenate([self.p["word"][rows], chars.astype(F32)], axis=1)

    def gates(self, vectors: np.ndarray, side: str) -> np.ndarray:
        """Input parts of the gates per word; the last row is padding, which keeps the state."""
        made = vectors @ self.p[f"x_{side}"] + self.p[f"x_bias_{side}"]
        pad = np.zeros((1, GATES), F32)
        pad[0, HIDDEN : 2 * HIDDEN] = 40
        return np.concatenate([made, pad])

    # --- forward --------------------------------------------------------------------------

    def run(self, gates: np.ndarray, windows: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States after every word of every window (windows x words x HIDDEN)."""
        n, width = windows.shape
        weights, bias = self.p[f"h_{side}"], self.p[f"h_bias_{side}"]
        states = np.empty((width, n, HIDDEN), F32)
        h = np.zeros((n, HIDDEN), F32)
        for t in range(width) if side == "f" else range(width - 1, -1, -1):
            x = gates[windows[:, t]]
            y = h @ weights + bias
            rz = x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN]
            np.negative(rz, out=rz)
            np.minimum(rz, 60, out=rz)
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, y, r, z, new))
            h = new + z * (h - new)
            states[t] = h
        return states

    def forward(self, vectors: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of every window; ``windows`` holds rows of ``vectors``, padding past the end."""
        pad = windows == len(vectors)
        sides = {}
        for side in ("f", "b"):
            steps = [] if keep is not None else None
            sides[side] = self.run(self.gates(vectors, side), windows, side, steps)
            if keep is not None:
                keep[side] = steps
        states = np.concatenate([sides["f"], sides["b"]], axis=2)  # words x windows x 2 HIDDEN
        look = np.tanh(states @ self.p["attend"] + self.p["attend_bias"])
        weight = look @ self.p["attend_out"]
        weight = np.where(pad.T, F32(-1e9), weight)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        if keep is not None:
            keep.update(states=states, look=look, weight=weight, pooled=pooled)
        return logit

    # --- training -------------------------------------------------------------------------

    def train_step(self, rows, grams, sizes, windows, labels, rate: float) -> float:
        """One step of Adam on the cross-entropy of a batch of windows."""
        p, keep = self.p, {}
        vectors = self.vectors(rows, grams, sizes)
        logit = self.forward(vectors, windows, keep)
        chance = sigmoid(logit)
        n = len(labels)
        d_logit = ((chance - labels) / n).astype(F32)
        g = {"out": keep["pooled"].T @ d_logit, "out_bias": np.array([d_logit.sum()], F32)}
        states, weight, look = keep["states"], keep["weight"], keep["look"]
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled
        g["attend_out"] = np.einsum("tna,tn->a", look, d_score)
        d_look = d_score[:, :, None] * p["attend_out"] * (1 - look * look)
        g["attend"] = np.einsum("tnh,tna->ha", states, d_look)
        g["attend_bias"] = d_look.sum(axis=(0, 1))
        d_states = d_states + d_look @ p["attend"].T
        d_vectors = np.zeros_like(vectors)
        for side, part in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[:, :, HIDDEN:])):
            d_vectors += self._back(side, part, keep[side], vectors, windows, g)
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], rows, d_vectors[:, :WORD_SIZE])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], grams, np.repeat(d_vectors[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0).astype(F32))
        self._adam(g, rate)
        return float(-np.mean(labels * np.log(chance + 1e-7) + (1 - labels) * np.log(1 - chance + 1e-7)))

    def _back(self, side, d_states, steps, vectors, windows, g) -> np.ndarray:
        weights = self.p[f"h_{side}"]
        d_weights, d_bias = np.zeros_like(weights), np.zeros(GATES, F32)
        d_gates = np.zeros((len(vectors) + 1, GATES), F32)
        carried = np.zeros((windows.shape[0], HIDDEN), F32)
        for t, h, y, r, z, new in reversed(steps):
            d = d_states[t] + carried
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (h - new) * z * (1 - z)
            d_r = d_new * y[:, 2 * HIDDEN :] * r * (1 - r)
            d_y = np.concatenate([d_r, d_z, d_new * r], axis=1)
            d_weights += h.T @ d_y
            d_bias += d_y.sum(axis=0)
            carried = d * z + d_y @ weights.T
            np.add.at(d_gates, windows[:, t], np.concatenate([d_r, d_z, d_new], axis=1))
        d_gates = d_gates[:-1]
        g[f"h_{side}"], g[f"h_bias_{side}"] = d_weights, d_bias
        g[f"x_{side}"], g[f"x_bias_{side}"] = vectors.T @ d_gates, d_gates.sum(axis=0)
        return d_gates @ self.p[f"x_{side}"].T

    def _adam(self, g: dict, rate: float) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        shrink = min(1.0, 1.0 / (norm + 1e-12))
        for k, v in g.items():
            m, s = self.moments[k]
            v = v * F32(shrink)
            m += F32(0.1) * (v - m)
            s += F32(0.001) * (v * v - s)
            ahead = m / F32(1 - 0.9**self.steps)
            self.p[k] -= F32(rate) * ahead / (np.sqrt(s / F32(1 - 0.999**self.steps)) + F32(1e-8))
