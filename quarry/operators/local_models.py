"""Estimators on matrices, for search tasks: ``fit(X, y)``, ``predict(X)``."""

from __future__ import annotations

import numpy as np

from quarry.operators.models import learning_rate
from quarry.operators.neighbours import Index, grouped


def _vote(rows: np.ndarray) -> np.ndarray:
    """Most frequent value of each row, the smallest of those that tie."""
    labels = np.unique(rows)
    parts = np.array_split(rows, rows.size * len(labels) // 20_000_000 + 1)
    return labels[np.concatenate([(part[:, :, None] == labels).sum(axis=1).argmax(axis=1) for part in parts])]


class Linear:
    def __init__(self, lr: float = 0.01, n_iter: int = 1000, lr_schedule: str = "constant", decay: float = 0.001):
        self.lr, self.n_iter, self.schedule, self.decay = lr, n_iter, lr_schedule, decay

    def fit(self, x, y):
        one = np.column_stack([x, np.ones(len(x))])
        gram, cross, w = one.T @ one, one.T @ y, np.zeros(one.shape[1])
        for t in range(self.n_iter):
            w = w - learning_rate(self.schedule, self.lr, self.decay, t) * 2 / len(x) * (gram @ w - cross)
        self.w = w

    def predict(self, x):
        return x @ self.w[:-1] + self.w[-1]


class Logistic(Linear):
    def fit(self, x, y):
        if len(np.unique(y)) > 2:
            raise ValueError("two classes only")
        one = np.column_stack([x, np.ones(len(x))])
        w = np.zeros(one.shape[1])
        for t in range(self.n_iter):
            p = 1 / (1 + np.exp(-np.clip(one @ w, -500, 500)))
            w = w - learning_rate(self.schedule, self.lr, self.decay, t) / len(x) * (one.T @ (p - y))
        self.w = w

    def predict(self, x):
        return (x @ self.w[:-1] + self.w[-1] >= 0).astype(float)


class Neighbours:
    def __init__(self, k: int = 5, task: str = "classification", metric: str = "euclidean"):
        self.k, self.task, self.metric = int(k), task, metric

    def fit(self, x, y):
        self.index, self.y = Index(x, self.metric, self.k), y

    def predict(self, x):
        near = self.y[self.index.nearest(x, self.k)[1]]
        return _vote(near) if self.task == "classification" else near.mean(axis=1)


class NaiveBayes:
    def __init__(self, smoothing: float = 1e-9):
        self.smoothing = smoothing

    def fit(self, x, y):
        self.c, n = np.unique(y, return_counts=True)
        self.prior = np.log(n / len(y))
        self.mean = np.array([x[y == c].mean(axis=0) for c in self.c])
        self.var = np.array([x[y == c].var(axis=0) for c in self.c]) + self.smoothing

    def predict(self, x):
        ll = self.prior - 0.5 * (np.log(2 * np.pi * self.var)[None] + (x[:, None] - self.mean) ** 2 / self.var).sum(axis=2)
        return self.c[ll.argmax(axis=1)]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different points in order, and each row's among them."""
    order, new = grouped(x)
    code = np.empty(len(x), np.int64)
    code[order] = np.cumsum(new) - 1
    return x[order[new]], code


def counted(code: np.ndarray, label: np.ndarray, points: int, classes: int) -> np.ndarray:
    """Rows of each point (lines) and class (columns)."""
    return np.bincount(code * classes + label, minlength=points * classes).reshape(points, classes).astype(float)


class Tree:
    def __init__(self, task: str = "classification", criterion: str = "gini", max_depth: int | None = 5, min_samples_split: int = 2):
        self.task, self.max_depth, self.min_samples_split = task, max_depth, min_samples_split

    def fit(self, x, y):
        self.classes = np.unique(y) if self.task == "classification" else None
        # Sums of these columns make impurities: class indicators, or y and its square.
        if self.classes is None:
            self.root = self._grow(x, np.column_stack([y, y * y]), 0)
        else:
            x, code = distinct(x)
            self.fit_counts(x, counted(code, np.searchsorted(self.classes, y), len(x), len(self.classes)), self.classes)

    def fit_counts(self, x, counts, classes):
        """Of different points and how many rows of each class each has: what all rows come to."""
        self.classes = classes
        self.root = self._grow(x, counts, 0)

    def _mass(self, sums, n):
        """n x impurity."""
        return n - (sums * sums).sum(axis=-1) / n if self.classes is not None else sums[..., 1] - sums[..., 0] ** 2 / n

    def _grow(self, x, t, depth):
        total = t.sum(axis=0)
        n = len(t) if self.classes is None else float(total.sum())
        leaf = self.classes[total.argmax()] if self.classes is not None else total[0] / n
        here = self._mass(total, n)
        if here <= 1e-12 * n or n < self.min_samples_split or (self.max_depth is not None and depth >= self.max_depth):
            return leaf
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, run = x[order, f], np.cumsum(t[order], axis=0)
            cut = np.flatnonzero(v[1:] != v[:-1])
            if len(cut):
                left = run[cut]
                m = cut + 1.0 if self.classes is None else left.sum(axis=1)
                gain = np.round((here - self._mass(left, m) - self._mass(total - left, n - m)) / n, 12)
                g = int(gain.argmax())
                if best is None or gain[g] > best[0]:
                    best = (gain[g], f, v[cut[g]])
        if best is None:
            return leaf
        _, f, at = best
        side = x[:, f] <= at
        return f, at, self._grow(x[side], t[side], depth + 1), self._grow(x[~side], t[~side], depth + 1)

    def predict(self, x):
        out = np.empty(len(x))

        def go(node, rows):
            if not isinstance(node, tuple):
                out[rows] = node
                return
            f, at, left, right = node
            side = x[rows, f] <= at
            go(left, rows[side])
            go(right, rows[~side])

        go(self.root, np.arange(len(x)))
        return out


class Forest:
    def __init__(self, n_trees: int = 100, task: str = "classification", max_depth: int | None = 5, min_samples_split: int = 2, random_state: int = 42):
        self.n_trees, self.task, self.options, self.seed = int(n_trees), task, (max_depth, min_samples_split), random_state

    def fit(self, x, y):
        rng, self.trees, known = np.random.default_rng(self.seed), [], {}
        classes = np.unique(y) if self.task == "classification" else None
        label = np.searchsorted(classes, y) if classes is not None else None
        for _ in range(self.n_trees):
            rows = rng.integers(0, len(x), len(x))
            columns = np.sort(rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False))
            tree = Tree(self.task, max_depth=self.options[0], min_samples_split=self.options[1])
            if classes is None:
                tree.fit(x[np.ix_(rows, columns)], y[rows])
            else:  # draws only change how often a point occurs
                own = tuple(columns.tolist())
                if own not in known:
                    if len(known) == 4:
                        known.clear()
                    known[own] = distinct(x[:, columns])
                points, code = known[own]
                counts = counted(code[rows], label[rows], len(points), len(classes))
                drawn = counts.any(axis=1)
                tree.fit_counts(points[drawn], counts[drawn], classes)
            self.trees.append((columns, tree))

    def predict(self, x):
        votes = np.column_stack([tree.predict(x[:, columns]) for columns, tree in self.trees])
        return _vote(votes) if self.task == "classification" else votes.mean(axis=1)
