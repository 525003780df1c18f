"""Small models in numpy: boosted trees, hashed logistic regression and probability calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary gradient boosting of shallow regression trees on binned features (log loss)."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, l2: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.l2, self.bins = rounds, depth, rate, l2, bins
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        rate = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(n, self.base)
        nodes = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            p = sigmoid(score)
            g, h = y - p, p * (1 - p) + 1e-9
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(n, dtype=int)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if len(rows) == 0:
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * gs / (hs + self.l2)
                if node >= 2**self.depth - 1 or len(rows) < 4:
                    continue
                best, chosen = 1e-6, None
                for j in range(f):
                    size = len(cuts[j]) + 1
                    if size == 1:
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    gain[(hl < 1e-3) | (hs - hl < 1e-3)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, chosen = gain[k], (j, k)
                if chosen is None:
                    continue
                j, k = chosen
                feature[node], cut[node] = j, cuts[j][k]
                at[rows] = np.where(binned[rows, j] <= k, 2 * node + 1, 2 * node + 2)
            self.trees.append((feature, cut, value))
            score += value[at]
            if np.abs(g).max() < 1e-2:
                break
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                j = feature[at]
                inner = j >= 0
                right = x[every, np.maximum(j, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out


class HashedLogistic:
    """L2-regularised logistic regression on hashed sparse features, fitted by AdaGrad."""

    def __init__(self, bits: int = 16, l2: float = 1e-6, epochs: int = 8, rate: float = 0.5, batch: int = 256, seed: int = 7):
        self.size, self.l2, self.epochs, self.rate, self.batch, self.seed = 1 << bits, l2, epochs, rate, batch, seed
        self.w = np.zeros(self.size + 1, dtype=np.float32)

    @staticmethod
    def pack(rows: list) -> tuple[np.ndarray, np.ndarray]:
        """(indices, row starts) of lists or arrays of feature numbers."""
        starts = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum([len(r) for r in rows], out=starts[1:])
        if rows and isinstance(rows[0], np.ndarray):
            return np.concatenate(rows), starts
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(starts[-1]))
        return flat, starts

    def fit(self, rows: list, y: np.ndarray) -> HashedLogistic:
        w, seen = np.zeros(self.size + 1), np.full(self.size + 1, 1e-3)
        order = np.random.default_rng(self.seed)
        parts = max(1, len(rows) // min(self.batch, max(16, len(rows) // 40)))
        for _ in range(max(self.epochs, 400 // parts)):  # small samples get as many steps as larger ones
            for at in np.array_split(order.permutation(len(rows)), parts):
                if len(at) == 0:
                    continue
                flat, starts = self.pack([rows[i] for i in at])
                owner = np.repeat(np.arange(len(at)), np.diff(starts))
                s = np.bincount(owner, w[flat], len(at)) + w[-1]
                err = sigmoid(s) - y[at]
                gb = err.mean()
                if len(flat) > 50_000:  # dense steps are cheaper than sorting so many features
                    g = np.bincount(flat, err[owner], self.size + 1) / len(at) + self.l2 * w
                    g[-1] = 0.0
                    seen += g * g
                    w -= self.rate * g / np.sqrt(seen)
                else:
                    used, back = np.unique(flat, return_inverse=True)
                    g = np.bincount(back, err[owner], len(used)) / len(at) + self.l2 * w[used]
                    seen[used] += g * g
                    w[used] -= self.rate * g / np.sqrt(seen[used])
                seen[-1] += gb * gb
                w[-1] -= self.rate * gb / np.sqrt(seen[-1])
        self.w = w.astype(np.float32)
        return self

    def score(self, rows: list) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        flat, starts = self.pack(rows)
        owner = np.repeat(np.arange(len(rows)), np.diff(starts))
        return np.bincount(owner, self.w[flat], len(rows)) + self.w[-1]

    def score_sparse(self, feature: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` rows given as (feature, row) pairs."""
        return np.bincount(owner, self.w[feature], n) + self.w[-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def platt(score: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities (damped Newton steps, smoothed targets)."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        z = np.clip(a * score + b, -50, 50)
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-2 * (a - 1) ** 2)

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(steps):
        p = sigmoid(a * score + b)
        d, h = p - t, p * (1 - p) + 1e-6
        ga, gb = (d * score).sum() + 2e-2 * (a - 1), d.sum()
        haa, hab, hbb = (h * score * score).sum() + 2e-2, (h * score).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        da, db, size = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
        while size > 1e-4 and (a - size * da <= 0 or loss(a - size * da, b - size * db) > now):
            size /= 2
        if size <= 1e-4:
            break
        a, b = a - size * da, b - size * db
        before, now = now, loss(a, b)
        if before - now < 1e-9:
            break
    return float(a), float(b)


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float = 0.98) -> float:
    """The lowest threshold whose precision on held-out cases is reached; 0.5 where none is known."""
    if len(y) == 0 or y.max() == 0:
        return 0.5
    order = np.argsort(-probability, kind="stable")
    hits = np.cumsum(y[order])
    ok = hits / np.arange(1, len(y) + 1) >= precision
    last = int(np.flatnonzero(ok)[-1]) if ok.any() else 0
    low = probability[order[last]]
    below = probability[probability < low]
    return float((low + below.max()) / 2) if len(below) else float(min(low, 0.5))
