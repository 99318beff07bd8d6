"""Small systems of the seasonal ARMA: lag sets, least squares from sums, recursion.

Nothing here sees a series: the sums come from grouped aggregates, and a forecast goes on
from the last values alone (as many as the longest lag).
"""

from __future__ import annotations

import numpy as np


def lag_set(order: int, seasonal: int, season: int) -> list[int]:
    """Lags of the product of an ordinary and a seasonal polynomial."""
    plain = range(order + 1)
    return sorted({i + season * j for i in plain for j in range(seasonal + 1)} - {0})


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares from its sums, with a tiny ridge so that short series stay solvable.

    Many systems of one size may come at once, along the first axis. A singular one gives NaN.
    """
    width = gram.shape[-1]
    if not width:
        return np.zeros(right.shape)
    scale = np.trace(gram, axis1=-2, axis2=-1) / width
    try:
        return np.linalg.solve(
            gram + (1e-6 * scale + 1e-9)[..., None, None] * np.eye(width), right[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if gram.ndim == 2:
            return np.full(right.shape, np.nan)
        return np.stack([solve(g, r) for g, r in zip(gram, right)])


def lagged_gram(first: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Sums of x[t-i] * x[t-j] over t >= start, for lags up to the length of ``first`` less 1.

    ``first`` holds the sums of x[t] * x[t-j]. One lag further on both sides is the same sum
    over rows moved by one, so an entry follows from the one above it to the left by the
    products that enter before the start (``head``, the values before it) and that leave at
    the end (``tail``, the last values of the series). Many series may come at once, along
    the first axis.
    """
    many = first.shape[-1]
    out = np.empty((*first.shape, many))
    out[..., 0, :] = out[..., :, 0] = first
    enter, leave = head[..., ::-1], tail[..., ::-1]
    for i in range(1, many):
        out[..., i, i:] = out[..., i:, i] = (
            out[..., i - 1, i - 1:-1] + enter[..., i - 1:i] * enter[..., i - 1:many - 1]
            - leave[..., i - 1:i] * leave[..., i - 1:many - 1]
        )
    return out


def stable(coefficients: np.ndarray, lags: list[int]) -> np.ndarray:
    """Pull explosive autoregressive roots back inside the unit circle."""
    if not lags:
        return coefficients
    polynomial = np.zeros(lags[-1] + 1)
    polynomial[0] = 1.0
    polynomial[lags] = -coefficients
    radius = np.abs(np.roots(polynomial)).max(initial=0.0)
    if radius < 0.99:
        return coefficients
    return coefficients * (0.99 / radius) ** np.array(lags)


def stable_rows(coefficients: np.ndarray, lags: list[int]) -> np.ndarray:
    """``stable`` of every row. Steps down the order (Schur-Cohn) tell which rows need it."""
    if not lags:
        return coefficients
    a = np.zeros((len(coefficients), lags[-1] + 1))
    a[:, 0] = 1.0
    a[:, lags] = -coefficients / 0.99 ** np.array(lags, float)
    explosive = np.zeros(len(a), bool)
    for order in range(lags[-1], 0, -1):
        last = a[:, order]
        explosive |= ~(np.abs(last) < 1)
        last = np.where(explosive, 0.0, last)[:, None]
        a[:, :order] = (a[:, :order] - last * a[:, order:0:-1]) / (1 - last * last)
    out = coefficients.copy()
    for row in np.flatnonzero(explosive & np.isfinite(coefficients).all(axis=1)):
        out[row] = stable(coefficients[row], lags)
    return out


def fit_from_sums(gram: np.ndarray, chosen: list[int], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, AIC) of the regressions of column 0 on the ``chosen`` columns, one per series."""
    left, right = gram[:, chosen][:, :, chosen], gram[:, chosen, 0]
    beta = solve(left, right)
    fitted = np.einsum("si,sij,sj->s", beta, left, beta, optimize=True)
    sse = gram[:, 0, 0] - 2 * (beta * right).sum(axis=1) + fitted
    return beta, n * np.log(np.maximum(sse, 1e-12) / n) + 2 * (len(chosen) + 1)


def go_on(
    x: np.ndarray, e: np.ndarray, phi: np.ndarray, ar: list[int], theta: np.ndarray, ma: list[int], steps: int
) -> np.ndarray:
    """The next values after the last ``x`` and shocks ``e`` of each series; future shocks are zero."""
    ahead = np.zeros((len(x), steps))
    x, e = np.concatenate([x, ahead], axis=1), np.concatenate([e, ahead], axis=1)
    ar, ma = np.array(ar, int), np.array(ma, int)
    for t in range(x.shape[1] - steps, x.shape[1]):
        x[:, t] = (phi * x[:, t - ar]).sum(axis=1) + (theta * e[:, t - ma]).sum(axis=1)
    return x[:, x.shape[1] - steps:]
