"""Two small text classifiers, trained on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each row of a ragged array (``at``: bounds); an empty row gives 0."""
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return c[at[1:]] - c[at[:-1]]


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton's method on softened labels."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    weight = np.broadcast_to(weight, t.shape)

    def loss(a: float, b: float) -> float:
        m = a * margin + b
        return float((weight * (np.logaddexp(0, m) - t * m)).sum() + 5e-4 * a * a)

    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w, off = weight * p * (1 - p) + 1e-9, weight * (p - t)
        g = np.array([(off * margin).sum() + 1e-3 * a, off.sum()])
        hess = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        now = loss(a, b)
        while loss(a - step[0], b - step[1]) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-6)), float(b)


class NaiveBayesSupportVectors:
    """Linear hinge loss over indicators scaled by naive-Bayes log-count ratios.

    Each row is scaled to unit length; the dual of the L1 hinge loss is solved
    by coordinate descent with box constraints (a class weight evens out the
    classes). Scores are a logistic curve over margins.
    """

    def __init__(self, dims: int, c: float = 1.0, alpha: float = 1.0, epochs: int = 30, seed: int = 7):
        self.dims, self.c, self.alpha, self.epochs, self.seed = dims, c, alpha, epochs, seed
        self.ratio = np.zeros(dims)
        self.weight = np.zeros(dims, np.float32)
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0

    def fit(self, idx: np.ndarray, at: np.ndarray, y: np.ndarray) -> NaiveBayesSupportVectors:
        n, size = len(y), np.diff(at)
        if n == 0 or y.min() == y.max():
            self.offset = 0.0 if n == 0 else (3.0 if y[0] else -3.0)
            return self
        row = np.repeat(np.arange(n), size)
        pos = self.alpha + np.bincount(idx[y[row] > 0], minlength=self.dims)
        neg = self.alpha + np.bincount(idx[y[row] == 0], minlength=self.dims)
        seen = (pos + neg) > 2 * self.alpha
        self.ratio = np.where(seen, np.log((pos / pos[seen].sum()) / (neg / neg[seen].sum())), 0)
        x = self.ratio[idx]
        norm = np.sqrt(np.maximum(_sums(x * x, at), 1e-12))
        x = x / norm[row]
        sign = np.where(y > 0, 1.0, -1.0)
        box = self.c * np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y == 0).sum()))
        w, bias, dual = np.zeros(self.dims), 0.0, np.zeros(n)
        rng = np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            moved = 0.0
            for i in rng.permutation(n):
                s = slice(at[i], at[i + 1])
                j, v = idx[s], x[s]
                grad = sign[i] * (w[j] @ v + bias) - 1
                new = min(max(dual[i] - grad / (2.0 if size[i] else 1.0), 0.0), box[i])
                if step := (new - dual[i]) * sign[i]:
                    w[j] += step * v
                    bias += step
                    moved = max(moved, abs(step))
                dual[i] = new
            if moved < 1e-3:
                break
        self.weight, self.bias = (w * self.ratio).astype(np.float32), bias
        self.slope, self.offset = calibrated(self.margin(idx, at), y)
        return self

    def margin(self, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
        norm = np.sqrt(_sums(self.ratio[idx] ** 2, at))
        return _sums(self.weight[idx], at) / np.where(norm > 0, norm, 1) + self.bias

    def score(self, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(idx, at) + self.offset, -30, 30)))


class FactorizationMachine:
    """Second-order factorization machine on hashed indicators, logistic loss, AdaGrad.

    margin = w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2).
    Every bucket that training rows hold learns; none is screened out. x_i is
    the scale of the bucket over the norm of the row's scales, where the scale
    is (g/(g + kappa))^2 + ``common`` * c/(c + ``often`` * rows), with g the
    log-likelihood ratio of the bucket's counts in the two classes and c its
    count: terms that mark a class weigh most, frequent terms that say nothing
    alone can still act in pairs, and rare ones can hardly be learned by heart.
    Scores are a logistic curve over margins, from rows that were left out of a
    first fit, with both classes weighing the same.
    """

    def __init__(self, dims: int, factors: int = 4, rate: float = 0.1, l2: float = 1e-4, l2v: float = 1e-3, epochs: int = 15, batch: int = 64, kappa: float = 20.0, common: float = 0.2, often: float = 0.05, seed: int = 11):
        self.dims, self.factors, self.rate, self.l2, self.l2v, self.epochs, self.batch = dims, factors, rate, l2, l2v, epochs, batch
        self.kappa, self.common, self.often, self.seed = kappa, common, often, seed
        self.scale, self.w, self.v = np.zeros(dims, np.float32), np.zeros(dims, np.float32), np.zeros((dims, factors), np.float32)
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0

    def _scales(self, idx: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(y)), np.diff(at))
        both = np.bincount(idx, minlength=self.dims).astype(float)
        pos = np.bincount(idx[y[row] > 0], minlength=self.dims).astype(float)
        g = np.zeros(self.dims)
        for own, share in ((pos, y.mean()), (both - pos, 1 - y.mean())):
            has = own > 0
            g[has] += 2 * own[has] * np.log(own[has] / (both[has] * share))
        g = np.maximum(g, 0)
        return ((g / (g + self.kappa)) ** 2 + self.common * both / (both + self.often * len(y))).astype(np.float32)

    def _x(self, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = self.scale[idx]
        norm = np.sqrt(np.maximum(_sums(s * s, at), 1e-12))
        return (s / np.repeat(norm, np.diff(at))).astype(np.float32)

    def margin(self, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = self._x(idx, at)
        out = self.bias + _sums(self.w[idx] * x, at)
        for f in range(self.factors):
            vx = self.v[idx, f] * x
            out += 0.5 * (_sums(vx, at) ** 2 - _sums(vx * vx, at))
        return out

    def score(self, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(idx, at) + self.offset, -30, 30)))

    def fit(self, idx: np.ndarray, at: np.ndarray, y: np.ndarray) -> FactorizationMachine:
        n = len(y)
        if n == 0 or y.min() == y.max():
            self.offset = 0.0 if n == 0 else (3.0 if y[0] else -3.0)
            return self
        self.scale = self._scales(idx, at, y)
        # Every third row of each class is left out of the first fit.
        left_out = np.zeros(n, bool)
        for c in (0, 1):
            left_out[np.flatnonzero((y > 0) == c)[2::3]] = True
        first = np.flatnonzero(~left_out)
        rest = np.flatnonzero(left_out) if (y[left_out] > 0).any() and (y[left_out] == 0).any() else np.arange(n)
        self._learn(*_rows(idx, at, first), y[first])
        self.slope, self.offset = calibrated(self.margin(*_rows(idx, at, rest)), y[rest], _even(y[rest]))
        self._learn(idx, at, y)
        return self

    def _learn(self, idx: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        n, factors, rng = len(y), self.factors, np.random.default_rng(self.seed)
        self.w, self.v, self.bias = np.zeros(self.dims, np.float32), rng.normal(0, 0.02, (self.dims, factors)).astype(np.float32), 0.0
        x, even = self._x(idx, at), _even(y)
        gw, gv, gb = np.full(self.dims, 1e-3, np.float32), np.full((self.dims, factors), 1e-3, np.float32), 1e-3
        order = rng.permutation(n)
        parts = [_Part(idx, at, x, order[k : k + self.batch]) for k in range(0, n, self.batch)]  # taken in another order each time
        for _ in range(self.epochs):
            for k in rng.permutation(len(parts)).tolist():
                p = parts[k]
                w, v = self.w[p.terms], self.v[p.terms]
                vx = v.take(p.term, axis=0) * p.x[:, None]
                total = p.by_row(vx)
                m = self.bias + p.by_row(w.take(p.term) * p.x) + 0.5 * ((total**2).sum(axis=1) - p.by_row((vx * vx).sum(axis=1)))
                d = ((1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[p.rows]) * even[p.rows]).astype(np.float32)
                dx = d.take(p.row) * p.x
                g = p.by_term(dx) + self.l2 * len(p.rows) * w
                gw[p.terms] += g * g
                self.w[p.terms] = w - self.rate * g / np.sqrt(gw[p.terms])
                g = p.by_term(dx[:, None] * (total.take(p.row, axis=0) - vx)) + self.l2v * len(p.rows) * v
                gv[p.terms] += g * g
                self.v[p.terms] = v - self.rate * g / np.sqrt(gv[p.terms])
                g = float(d.sum())
                gb += g * g
                self.bias -= self.rate * g / np.sqrt(gb)


class _Part:
    """Some rows and their terms, arranged once for sums by row and by term."""

    def __init__(self, idx: np.ndarray, at: np.ndarray, x: np.ndarray, rows: np.ndarray):
        self.rows = rows[at[rows + 1] > at[rows]]  # rows without terms say nothing
        take, bounds = _places(at, self.rows)
        self.x = x[take]
        self.row = np.repeat(np.arange(len(self.rows), dtype=np.int32), np.diff(bounds))
        self.terms, term = np.unique(idx[take], return_inverse=True)
        self.term = term.astype(np.int32)
        self._starts = bounds[:-1]

    def by_row(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self._starts, axis=0) if len(self.rows) else values[:0]

    def by_term(self, values: np.ndarray) -> np.ndarray:
        """Sums of a vector, or of each column of a table."""
        n = len(self.terms)
        if values.ndim == 1:
            return np.bincount(self.term, values, n).astype(np.float32)
        return np.stack([np.bincount(self.term, values[:, f], n) for f in range(values.shape[1])], axis=1).astype(np.float32)


def _even(y: np.ndarray) -> np.ndarray:
    """Weights by which both classes count the same."""
    n, pos = len(y), int((y > 0).sum())
    return np.where(y > 0, n / (2 * max(pos, 1)), n / (2 * max(n - pos, 1)))


def _places(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the elements of some ragged rows lie, and the bounds of those rows side by side."""
    size = at[rows + 1] - at[rows]
    bounds = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(at[rows] - bounds[:-1], size) + np.arange(bounds[-1]), bounds


def _rows(idx: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    take, bounds = _places(at, rows)
    return idx[take], bounds
