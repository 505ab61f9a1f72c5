"""Models in numpy: ridge, logistic, multinomial, angle regression, hidden Markov chains, splits of rows."""

from __future__ import annotations

import math

import numpy as np


def standardised(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s > 0, s, 1)


def ridge(x: np.ndarray, y: np.ndarray, l2: float, smooth: float = 0.0, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted, centred closed form: (X'WX / sum w + l2 I + smooth D'D)^-1 X'WY / sum w; coefficients and intercept."""
    w = np.ones(len(x)) if weight is None else weight
    y = y.reshape(len(x), -1)
    total = w.sum()
    mx, my = (w @ x) / total, (w @ y) / total
    xc, yc = x - mx, y - my
    d = np.diff(np.eye(x.shape[1]), axis=0)
    a = (xc * w[:, None]).T @ xc / total + l2 * np.eye(x.shape[1]) + smooth * d.T @ d
    b = np.linalg.solve(a, (xc * w[:, None]).T @ yc / total)
    return b, my - mx @ b


def torus_ridge(x: np.ndarray, y: np.ndarray, period: float, l2: float, smooth: float = 0.0) -> np.ndarray:
    """Angles by ridge regression on their cos and sin; predictions for x."""
    a = y * 2 * math.pi / period
    b, c = ridge(x, np.column_stack([np.cos(a), np.sin(a)]), l2, smooth)
    p = x @ b + c
    k = y.shape[1]
    return np.mod(np.arctan2(p[:, k:], p[:, :k]) * period / (2 * math.pi), period)


def huber_ridge(x: np.ndarray, y: np.ndarray, l2: float, delta: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Huber loss by reweighted ridge, the weight of a row by its whole residual."""
    w = np.ones(len(x))
    for _ in range(rounds):
        b, c = ridge(x, y, l2, weight=w)
        r = np.sqrt(((y.reshape(len(x), -1) - x @ b - c) ** 2).sum(axis=1))
        new = np.where(r <= delta, 1.0, delta / np.maximum(r, 1e-12))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return b, c


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def multinomial(x: np.ndarray, y: np.ndarray, classes: int, l2: float = 1e-3, smooth: float = 0.0, rounds: int = 300, rate: float = 0.5, weight: np.ndarray | None = None) -> np.ndarray:
    """Softmax regression by accelerated gradient steps; rows of the result are features and, last, the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(x)) if weight is None else weight
    w = w / w.sum()
    target = np.eye(classes)[y]
    d = np.zeros((max(x.shape[1] - 1, 0), a.shape[1]))
    if x.shape[1] > 1:
        d[:, : x.shape[1]] = np.diff(np.eye(x.shape[1]), axis=0)
    penalty = l2 * np.diag(np.r_[np.ones(x.shape[1]), 0.0]) + smooth * d.T @ d
    lipschitz = 0.5 * np.linalg.norm((a * w[:, None]).T @ a, 2) + np.linalg.norm(penalty, 2)
    b = prev = np.zeros((a.shape[1], classes))
    for i in range(rounds):
        v = b + (i / (i + 3)) * (b - prev)
        grad = (a * w[:, None]).T @ (softmax(a @ v) - target) + penalty @ v
        prev, b = b, v - grad * min(rate * 2, 1.0) / lipschitz
    return b


def predict_proba(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return softmax(np.column_stack([x, np.ones(len(x))]) @ b)


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    return float(-np.log(np.clip(p[np.arange(len(y)), y], 1e-12, 1)).mean())


def auc(y: np.ndarray, score: np.ndarray) -> float:
    from sonolith.functions.numeric import average_ranks

    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    return float((average_ranks(score)[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else math.nan


def gamma_glm(x: np.ndarray, y: np.ndarray, l2: float = 1e-6, rounds: int = 100) -> np.ndarray:
    """Gamma regression with log link, by reweighted least squares (unit weights for this link)."""
    a = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(a.shape[1])
    b[-1] = math.log(y.mean())
    reg = l2 * np.eye(a.shape[1])
    for _ in range(rounds):
        eta = np.clip(a @ b, -30, 30)
        mu = np.exp(eta)
        new = np.linalg.solve(a.T @ a + reg, a.T @ (eta + (y - mu) / mu))
        if np.abs(new - b).max() < 1e-10:
            return new
        b = new
    return b


def forward_selection(features: dict[str, np.ndarray], y: np.ndarray, folds: np.ndarray, classes: int, least_gain: float = 1e-4) -> list[tuple[str, float]]:
    """Features in the order that they lower the held-out log loss most, while they do."""

    def loss(names: list[str]) -> float:
        x = standardised(np.column_stack([features[n] for n in names]))
        parts = []
        for f in np.unique(folds):
            out = folds == f
            b = multinomial(x[~out], y[~out], classes, rounds=80)
            parts.append(log_loss(y[out], predict_proba(x[out], b)))
        return float(np.mean(parts))

    counts = np.bincount(y, minlength=classes) / len(y)
    best, chosen, out = float(-np.log(np.clip(counts[y], 1e-12, 1)).mean()), [], []
    while len(chosen) < len(features):
        tried = sorted((loss([*chosen, n]), n) for n in features if n not in chosen)
        if best - tried[0][0] < least_gain:
            break
        best = tried[0][0]
        chosen.append(tried[0][1])
        out.append((tried[0][1], best))
    return out


def paired_margin(actual: np.ndarray, null: np.ndarray, n_boot: int, seed: int, level: float = 0.95) -> tuple[float, float, float, float]:
    """Mean margin of paired folds, its bootstrap interval, and p (share of resampled means of 0 or less; 1 under two folds)."""
    margin = np.asarray(actual, float) - np.asarray(null, float)
    margin = margin[np.isfinite(margin)]
    if len(margin) < 2:
        return (float(margin.mean()) if len(margin) else math.nan, math.nan, math.nan, 1.0)
    means = margin[np.random.default_rng(seed).integers(0, len(margin), (n_boot, len(margin)))].mean(axis=1)
    low, high = np.percentile(means, [50 * (1 - level), 100 - 50 * (1 - level)])
    return float(margin.mean()), float(low), float(high), float((means <= 0).mean())


# hidden Markov chains


def _gaussian_log(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (((x[:, None, :] - mean[None]) ** 2 / var[None]) + np.log(2 * math.pi * var)[None]).sum(axis=2)


def forward_backward(log_start: np.ndarray, log_move: np.ndarray, log_emit: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, posteriors of states, and expected moves of one sequence."""
    n, k = log_emit.shape
    a = np.empty((n, k))
    a[0] = log_start + log_emit[0]
    for i in range(1, n):
        m = a[i - 1][:, None] + log_move
        top = m.max(axis=0)
        a[i] = top + np.log(np.exp(m - top).sum(axis=0)) + log_emit[i]
    b = np.zeros((n, k))
    for i in range(n - 2, -1, -1):
        m = log_move + (log_emit[i + 1] + b[i + 1])[None, :]
        top = m.max(axis=1)
        b[i] = top + np.log(np.exp(m - top[:, None]).sum(axis=1))
    top = a[-1].max()
    total = float(top + np.log(np.exp(a[-1] - top).sum()))
    moves = np.zeros((k, k))
    for i in range(n - 1):
        moves += np.exp(a[i][:, None] + log_move + (log_emit[i + 1] + b[i + 1])[None, :] - total)
    return total, np.exp(a + b - total), moves


def expected_states(start: np.ndarray, move: np.ndarray, log_emit: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, posteriors and expected moves of sequences of one length together: a step of all of them is one product.

    ``log_emit``: step, sequence, state. As forward_backward, but scaled at each step, which needs start and moves above 0.
    """
    n, _, k = log_emit.shape
    top = log_emit.max(axis=2, keepdims=True)
    emit = np.exp(log_emit - top)
    a, b, c = np.empty_like(emit), np.ones_like(emit), np.empty_like(top)
    ones = np.ones((k, 1))
    for i in range(n):
        v = (a[i - 1] @ move if i else start) * emit[i]
        np.matmul(v, ones, out=c[i])  # faster than a sum over few states
        np.divide(v, c[i], out=a[i])
    ahead, back = emit / c, move.T
    for i in range(n - 2, -1, -1):
        ahead[i + 1] *= b[i + 1]
        np.matmul(ahead[i + 1], back, out=b[i])
    moves = move * (a[:-1].reshape(-1, k).T @ ahead[1:].reshape(-1, k))
    return float((np.log(c) + top).sum()), a * b, moves


def likeliest_paths(log_start: np.ndarray, log_move: np.ndarray, log_emit: np.ndarray) -> np.ndarray:
    """States by step and sequence, as viterbi has them, of sequences of one length together."""
    n, s, k = log_emit.shape
    score, back = log_start + log_emit[0], np.zeros((n, s, k), dtype=np.int32)
    for i in range(1, n):
        m = score[:, None, :] + log_move.T
        back[i] = m.argmax(axis=2)
        score = m.max(axis=2) + log_emit[i]
    path, each = np.empty((n, s), dtype=int), np.arange(s)
    path[-1] = score.argmax(axis=1)
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, each, path[i]]
    return path


def viterbi(log_start: np.ndarray, log_move: np.ndarray, log_emit: np.ndarray) -> np.ndarray:
    """Likeliest states; the first of equal ones."""
    n, k = log_emit.shape
    score, back = log_start + log_emit[0], np.zeros((n, k), dtype=int)
    for i in range(1, n):
        m = score[:, None] + log_move
        back[i] = m.argmax(axis=0)
        score = m.max(axis=0) + log_emit[i]
    path = np.empty(n, dtype=int)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def fit_gaussian_hmm(sequences: list[np.ndarray], k: int, seed: int, rounds: int = 40) -> dict:
    """EM with diagonal normal emissions over sequences; also BIC and each sequence's states."""
    every = np.concatenate(sequences)
    sizes = np.array([len(x) for x in sequences])
    begins = np.cumsum(sizes) - sizes
    alike = [begins[sizes == n] + np.arange(n)[:, None] for n in np.unique(sizes[sizes > 0])]  # rows by step and sequence, for each length
    rng = np.random.default_rng(seed)
    mean = every[rng.choice(len(every), k, replace=False)]
    mean = mean[np.argsort(mean[:, 0], kind="stable")]
    var = np.tile(every.var(axis=0) + 1e-3, (k, 1))
    start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    last = -np.inf
    for _ in range(rounds):
        total, s0, m0, g = 0.0, np.zeros(k), np.zeros((k, k)), np.empty((len(every), k))
        emit = _gaussian_log(every, mean, var)
        for at in alike:
            ll, p, mv = expected_states(start, move, emit[at])
            total += ll
            s0 += p[0].sum(axis=0)
            m0 += mv
            g[at] = p
        if abs(total - last) < 1e-6:
            break
        last = total
        n = g.sum(axis=0) + 1e-9
        mean = g.T @ every / n[:, None]
        var = np.maximum(g.T @ every**2 / n[:, None] - mean**2, 1e-4)
        start = np.maximum(s0 / s0.sum(), 1e-8)
        move = np.maximum(m0 / m0.sum(axis=1, keepdims=True), 1e-8)
        move /= move.sum(axis=1, keepdims=True)
    d = every.shape[1]
    free = (k - 1) + k * (k - 1) + 2 * k * d
    found, emit = np.empty(len(every), dtype=int), _gaussian_log(every, mean, var)
    for at in alike:
        found[at] = likeliest_paths(np.log(start), np.log(move), emit[at])
    states = np.split(found, begins[1:])
    return {"loglik": last, "bic": -2 * last + free * math.log(len(every)), "mean": mean, "var": var, "move": move, "states": states}
