"""Ordered folds over series: recursions that no window frame expresses. Series run in parallel, each in order of its rows."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: str, step, schema: str) -> DataFrame:
    """step(frame in order) for each series, which holds one row per period: a series must fit into a task's memory, so bars and the
    like are folded, raw trades and events are aggregated first."""
    return df.groupBy(key).applyInPandas(lambda f: step(f.sort_values(order, kind="stable")), schema)


def ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean seeded with the first value."""
    out, last = np.empty(len(x)), np.nan
    for i, v in enumerate(x):
        last = v if i == 0 else alpha * v + (1 - alpha) * last
        out[i] = last
    return out


def rsi_wilder(x: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's index: means of the first n gains and losses, then smoothed."""
    out, d = np.full(len(x), np.nan), np.diff(x)
    if len(d) < n:
        return out
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    g, l = up[:n].mean(), down[:n].mean()  # noqa: E741
    for i in range(n, len(x)):
        if i > n:
            g, l = (g * (n - 1) + up[i - 1]) / n, (l * (n - 1) + down[i - 1]) / n  # noqa: E741
        out[i] = 100.0 if l == 0 else 100 - 100 / (1 + g / l)
    return out


def rsi_ewm(x: np.ndarray, n: int = 14) -> np.ndarray:
    """The index from exponential means with alpha 1/n."""
    d = np.diff(x)
    g, l = ema(np.maximum(d, 0), 1 / n), ema(np.maximum(-d, 0), 1 / n)  # noqa: E741
    return np.concatenate([[np.nan], np.where(l == 0, 100.0, 100 - 100 / (1 + g / np.where(l == 0, 1, l)))]) if len(x) else d


def rsi_first(x: np.ndarray, n: int = 14) -> float:
    """The index from the first n changes only."""
    d = np.diff(x)[:n]
    g, l = np.maximum(d, 0).mean(), np.maximum(-d, 0).mean()  # noqa: E741
    return 100.0 if l == 0 else float(100 - 100 / (1 + g / l))


def expanding_share(x: np.ndarray, least: int) -> np.ndarray:
    """The share of values so far at or under each; nothing before so many values."""
    held: list[float] = []
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        at = bisect.bisect_right(held, v)
        held.insert(at, v)
        if len(held) >= least:
            out[i] = (at + 1) / len(held)
    return out


def garch(r: np.ndarray, omega: float = 1e-5, alpha: float = 0.05, beta: float = 0.94) -> np.ndarray:
    """Conditional variance with fixed parameters, seeded with the whole variance."""
    out, v = np.empty(len(r)), float(np.var(r)) if len(r) else 0.0
    for i in range(len(r)):
        v = v if i == 0 else omega + alpha * r[i - 1] ** 2 + beta * v
        out[i] = v
    return out


def ewma_z(r: np.ndarray, lam: float = 0.94) -> np.ndarray:
    """Each value over the exponential deviation up to the one before."""
    out, v = np.full(len(r), np.nan), np.nan
    for i, x in enumerate(r):
        if i and v > 0:
            out[i] = x / np.sqrt(v)
        v = x * x if i == 0 else lam * v + (1 - lam) * x * x
    return out


def kalman(x: np.ndarray, q: float = 1e-3, r: float = 1e-1) -> np.ndarray:
    """A local level filter; missing values are only predicted."""
    out, level, p = np.full(len(x), np.nan), np.nan, 1.0
    for i, v in enumerate(x):
        if np.isnan(level):
            level = v
        elif not np.isnan(v):
            p += q
            k = p / (p + r)
            level, p = level + k * (v - level), (1 - k) * p
        else:
            p += q
        out[i] = level
    return out


def episodes(x: np.ndarray, n: int, gap: int) -> np.ndarray:
    """Greedy extremes: the largest rows, none within gap of one taken before."""
    taken: list[int] = []
    for i in np.argsort(-x, kind="stable"):
        if all(abs(int(i) - j) > gap for j in taken):
            taken.append(int(i))
        if len(taken) == n:
            break
    return np.isin(np.arange(len(x)), taken)


def hmm_filter(r: np.ndarray, states: int = 3, rounds: int = 20) -> np.ndarray:
    """Filtered state probabilities of a Gaussian hidden Markov model fitted by Baum-Welch, states by falling mean."""
    n = len(r)
    mu = np.quantile(r, (np.arange(states) + 0.5) / states)[::-1].copy()
    sd, a, pi = np.full(states, r.std() + 1e-9), np.full((states, states), 0.1 / max(1, states - 1)), np.full(states, 1 / states)
    np.fill_diagonal(a, 0.9)

    def forward() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.exp(-0.5 * ((r[:, None] - mu) / sd) ** 2) / sd + 1e-300
        f, c = np.empty((n, states)), np.empty(n)
        for t in range(n):
            p = (pi if t == 0 else f[t - 1] @ a) * b[t]
            c[t] = p.sum()
            f[t] = p / c[t]
        return f, b, c

    for _ in range(rounds):
        f, b, c = forward()
        back = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            back[t] = a @ (b[t + 1] * back[t + 1]) / c[t + 1]
        g = f * back
        g /= g.sum(axis=1, keepdims=True)
        xi = a * np.einsum("ti,tj->ij", f[:-1], b[1:] * back[1:] / c[1:, None])
        a, pi, w = xi / xi.sum(axis=1, keepdims=True), g[0], g.sum(axis=0)
        mu = (g * r[:, None]).sum(axis=0) / w
        sd = np.sqrt((g * (r[:, None] - mu) ** 2).sum(axis=0) / w) + 1e-6
    return forward()[0][:, np.argsort(-mu)]


def column(f: pd.DataFrame, name: str) -> np.ndarray:
    return f[name].to_numpy(dtype=float)
