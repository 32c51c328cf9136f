"""NumPy kernels of models that are fitted on a few rows at a time, as on the rows of two trails."""

from __future__ import annotations

import numpy as np


def _lasso_path(gram: np.ndarray, xy: np.ndarray, alphas: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Coefficients for each penalty, largest first, each from the one before, by accelerated soft thresholding."""
    step = 1.0 / max(np.linalg.norm(gram, 2), 1e-300)
    out, w = [], np.zeros(len(xy))
    for alpha in alphas:
        v, t = w, 1.0
        for _ in range(rounds):
            new = v - step * (gram @ v - xy)
            new = np.sign(new) * np.maximum(np.abs(new) - step * alpha, 0)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, t = new + (t - 1) / after * (new - w), after
            done = np.abs(new - w).max() <= 1e-6 * max(np.abs(new).max(), 1e-12)
            w = new
            if done:
                break
        out.append(w)
    return np.array(out)


def lasso_cv(x: np.ndarray, y: np.ndarray, folds: int = 3, penalties: int = 100, least: float = 1e-3) -> np.ndarray:
    """Coefficients of a lasso with intercept whose penalty has the least squared error over consecutive folds.

    Penalties fall from the one that leaves no feature to ``least`` of it, evenly on a log scale.
    """
    n = len(x)
    mean = lambda a: a - a.mean(axis=0)
    centred, target = mean(x), mean(y)
    top = np.abs(centred.T @ target).max() / n
    if top <= 0 or n < folds:
        return np.zeros(x.shape[1])
    alphas = top * np.logspace(0, np.log10(least), penalties)
    error = np.zeros(penalties)
    for held in np.array_split(np.arange(n), folds):
        fit = np.setdiff1d(np.arange(n), held)
        a, b = mean(x[fit]), mean(y[fit])
        w = _lasso_path(a.T @ a / len(fit), a.T @ b / len(fit), alphas)
        guess = (x[held] - x[fit].mean(axis=0)) @ w.T + y[fit].mean()
        error += ((guess - y[held][:, None]) ** 2).mean(axis=0)
    best = int(error.argmin())
    return _lasso_path(centred.T @ centred / n, centred.T @ target / n, alphas[: best + 1])[-1]


def _grown(x: np.ndarray, y: np.ndarray, tries: int, rng: np.random.Generator, gain: np.ndarray) -> None:
    """Grow a tree to pure leaves and add the impurity that each feature takes away to ``gain``."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        n, ones = len(at), y[at].sum()
        if n < 2 or ones in (0, n):
            continue
        best = (0.0, -1, 0.0)
        for j in rng.permutation(x.shape[1]):
            if tries <= 0 and best[1] >= 0:
                break
            tries -= 1
            order = np.argsort(x[at, j], kind="stable")
            v, left = x[at[order], j], np.cumsum(y[at[order]])[:-1]
            k = np.arange(1, n)
            drop = left**2 / k + (k - left) ** 2 / k + (ones - left) ** 2 / (n - k) + (n - k - ones + left) ** 2 / (n - k) - ones**2 / n - (n - ones) ** 2 / n
            drop = np.where(v[1:] > v[:-1], drop, -1.0)
            m = int(drop.argmax())
            if drop[m] > best[0] + 1e-12:
                best = (float(drop[m]), int(j), (v[m] + v[m + 1]) / 2)
        if best[1] < 0:
            continue
        gain[best[1]] += best[0]
        low = x[at, best[1]] <= best[2]
        todo += [at[low], at[~low]]
        tries = max(1, int(np.sqrt(x.shape[1])))


def forest_importances(x: np.ndarray, y: np.ndarray, trees: int = 100, seed: int = 99) -> np.ndarray:
    """Mean impurity decrease of each feature over bootstrap trees that try root-many features a split; sums to 1."""
    rng, out = np.random.default_rng(seed), np.zeros(x.shape[1])
    for _ in range(trees):
        rows, gain = rng.integers(0, len(x), len(x)), np.zeros(x.shape[1])
        _grown(x[rows], y[rows].astype(float), max(1, int(np.sqrt(x.shape[1]))), rng, gain)
        out += gain / gain.sum() if gain.sum() > 0 else 0.0
    return out / out.sum() if out.sum() > 0 else out


def forward_batch(within: np.ndarray, total: np.ndarray, n: np.ndarray, groups: int, k: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Forward selection by partial F for many pairs of scatter matrices at once: (columns, F), a row a pair.

    What is left of a candidate within groups and over all is swept by each feature that is taken.
    """
    size, p = within.shape[:2]
    eye, every = ridge * np.eye(p), np.arange(size)
    w, t = within + eye, total + eye
    taken, score = np.zeros((size, k), int), np.zeros((size, k))
    free = np.ones((size, p), bool)
    diagonal = np.arange(p)
    for step in range(k):
        df2 = np.maximum(n - groups - step, 1)
        r1, r0 = np.maximum(w[:, diagonal, diagonal], 1e-12), t[:, diagonal, diagonal]
        f = np.where(free, ((r0 - r1) / max(groups - 1, 1)) / (r1 / df2[:, None]), -np.inf)
        i = f.argmax(axis=1)
        taken[:, step], score[:, step] = i, f[every, i]
        free[every, i] = False
        for m in (w, t):
            row = m[every, i]
            m -= row[:, :, None] * (row / np.maximum(row[every, i], 1e-12)[:, None])[:, None, :]
    return taken, score


def forward_moments(within: np.ndarray, total: np.ndarray, n: int, groups: int, k: int, ridge: float = 1e-6) -> list[tuple[int, float]]:
    """``forward_batch`` of one pair."""
    taken, score = forward_batch(within[None], total[None], np.array([n]), groups, k, ridge)
    return [(int(i), float(f)) for i, f in zip(taken[0], score[0])]
