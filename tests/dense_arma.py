"""The same seasonal ARMA on one whole series in memory, to compare with."""

import numpy as np

from meterlens.functions.arma import lag_set, solve, stable


def _lagged(x, lags, start):
    columns = [x[start - k: len(x) - k] for k in lags]
    return np.column_stack(columns) if columns else np.empty((len(x) - start, 0))


def fit(y, order, seasonal, season, together=None):
    """Fitted model with AIC, or None when the series is too short for its lags.

    ``together`` lists the orders that share start and long autoregression with this one.
    """
    p, d, q = order
    w = np.diff(np.asarray(y, dtype=float), n=d)
    if len(w) < 8:
        return None
    seasons = min(1, len(w) // (3 * season))

    def lags(orders, place, times):
        return sorted({k for o in orders for k in lag_set(o[place], times * seasons, season)})

    ar, ma = lags([order], 0, seasonal[0]), lags([order], 2, seasonal[2])
    all_ar, all_ma = lags(together or [order], 0, seasonal[0]), lags(together or [order], 2, seasonal[2])
    mean = w.mean()
    x = w - mean
    reach = max([*all_ar, *all_ma, 1])
    long = min(reach + 2, len(x) // 3)
    design = _lagged(x, list(range(1, long + 1)), long)
    shocks = np.zeros(len(x))
    shocks[long:] = x[long:] - design @ solve(design.T @ design, design.T @ x[long:])
    start = min(reach + long, len(x) - len(all_ar) - len(all_ma) - 2)
    if start < reach:
        return None
    design = np.hstack([_lagged(x, ar, start), _lagged(shocks, ma, start)])
    beta = solve(design.T @ design, design.T @ x[start:])
    rest = x[start:] - design @ beta
    n = len(rest)
    return {
        "y": np.asarray(y, dtype=float), "x": x, "mean": mean, "d": d, "shocks": shocks, "ar": ar, "ma": ma,
        "phi": stable(beta[:len(ar)], ar), "theta": beta[len(ar):],
        "aic": n * np.log(max(float(rest @ rest), 1e-12) / n) + 2 * (len(beta) + 1),
    }


def forecast(model, steps):
    x, e = list(model["x"]), list(model["shocks"])
    for _ in range(steps):
        t = len(x)
        value = sum(c * x[t - k] for c, k in zip(model["phi"], model["ar"]))
        value += sum(c * e[t - k] for c, k in zip(model["theta"], model["ma"]))
        x.append(value)
        e.append(0.0)
    future = np.array(x[-steps:]) + model["mean"]
    if model["d"]:
        future = model["y"][-1] + np.cumsum(future)
    return np.maximum(future, 0.0)
