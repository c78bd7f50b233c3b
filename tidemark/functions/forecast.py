"""Small state-space models of one series, for use inside grouped tasks.

Each model gives arrays ``state`` and ``var`` over the data and the steps ahead. Missing values are NaN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Tolerances of the fit, and the longest piece of a level model.
TOLERANCE, STEP, ROUNDS = 1e-3, 1e-10, 200
PIECE = 2000
LONGEST_LAG = 2000


def minimise(f, x: float) -> float:
    """Quasi-Newton in one dimension: the inverse curvature is the secant's, steps are cut back until
    they fall far enough. It stops loosely, at a relative slope under TOLERANCE."""

    def slope(x: float, y: float) -> float:
        h = max(STEP, STEP * abs(x))
        z = x + h
        return (f(z) - y) / (z - x)

    y = f(x)
    g = slope(x, y)
    inverse = 1.0
    for _ in range(ROUNDS):
        if g == 0 or not math.isfinite(g):
            return x
        step = max(-100.0 * max(1.0, abs(x)), min(100.0 * max(1.0, abs(x)), -inverse * g))
        if step * g >= 0:
            step = -g
        part, new = 1.0, x
        while part > 1e-12:
            new = x + part * step
            y_new = f(new)
            if y_new <= y + 1e-4 * part * step * g:
                break
            low = y_new - y - part * step * g
            part *= min(0.5, max(0.1, -step * g * part / (2 * low))) if low > 0 and math.isfinite(low) else 0.5
        moved = new - x
        if abs(moved) / max(1.0, abs(new)) < 4 * STEP:
            return new
        x, y = new, f(new)
        before, g = g, slope(x, y)
        if abs(g) * max(1.0, abs(x)) / max(1.0, y) < TOLERANCE:
            return x
        if (g - before) * moved > 0:
            inverse = moved / (g - before)
    return x


@dataclass
class Fit:
    state: np.ndarray
    var: np.ndarray


def _level_pass(y: np.ndarray, q: float, keep: bool = False):
    """Kalman filter of a level with noise ratio q: (sum of v^2/f, sum of ln f[, levels, variances])."""
    a, p = float(y[0]), 1.0 + q
    squares = logs = 0.0
    levels, spread = [a], [p]
    for value in y[1:]:
        f = p + 1.0
        if value == value:
            v = value - a
            k = p / f
            a, p = a + k * v, k + q
            squares += v * v / f
            logs += math.log(f)
        else:
            p += q
            logs += math.log(f)
        if keep:
            levels.append(a)
            spread.append(p)
    return (squares, logs, levels, spread) if keep else (squares, logs)


def level(y: np.ndarray, ahead: int) -> Fit:
    """Local level; the forecast is flat and its variance grows by the level's noise."""
    y = np.asarray(y, float)
    first = int(np.argmax(~np.isnan(y))) if (~np.isnan(y)).any() else len(y)
    if first == len(y):
        raise ValueError("no valid data for the level model")
    own = y[first:]

    def cost(psi: float) -> float:
        squares, logs = _level_pass(own, math.exp(min(psi, 700.0)))
        return logs if squares == 0 else (len(own) - 1) * math.log(squares) + logs

    q = math.exp(min(minimise(cost, 1.0), 700.0))
    squares, _, levels, spread = _level_pass(own, q, keep=True)
    sigma = squares / max(1.0, len(own) - 1)
    raw = [(p + 1) * sigma for p in spread]
    raw += [raw[-1] + q * sigma * (i + 1) for i in range(ahead)]
    state = np.concatenate([np.full(first, np.nan), levels, np.full(ahead, levels[-1])])
    # Within the data the variance has one sigma more; so has the last one, on which the forecast's grows.
    return Fit(state, np.concatenate([np.full(first, np.nan), np.array(raw) + sigma]))


def level_in_pieces(y: np.ndarray, ahead: int) -> Fit:
    """Local level; over PIECE points each piece is fitted apart."""
    parts = max(1, len(y) // PIECE) if len(y) > PIECE else 1
    size = len(y) // parts
    fits = [level(y[i * size : (i + 1) * size if i < parts - 1 else len(y)], ahead if i == parts - 1 else 0) for i in range(parts)]
    return Fit(np.concatenate([f.state for f in fits]), np.concatenate([f.var for f in fits]))


def _trend_pass(y: np.ndarray, zeta: float, keep: bool = False):
    a0, a1 = float(y[1]), float(y[1] - y[0])
    p0, p1, p2, p3 = 5 + 2 * zeta, 3 + zeta, 3 + zeta, 2 + zeta
    squares = logs = 0.0
    states, spread = [], []
    for value in y[2:]:
        if value == value:
            f = p0 + 1
            x1, x2 = p0 + p2, p1 + p3
            k0, k1 = x1 / f, p2 / f
            v = value - a0 - a1
            a0, a1 = a0 + a1 + v * k0, a1 + v * k1
            rest = 1 - k0
            p0, p1, p2, p3 = x1 * rest + x2 + zeta, x2 - x1 * k1, p2 * rest + p3, p3 - p2 * k1
            squares += v * v / f
        else:
            a0, p0 = a0 + a1, p0 + zeta
            f = p0 + 1
        logs += math.log(f) if f > 0 else math.inf
        if keep:
            states.append(a0)
            spread.append(p0)
    return (squares, logs, states, spread, a1, p0) if keep else (squares, logs)


def trend(y: np.ndarray, ahead: int) -> Fit:
    """Local linear trend from the first two points; the forecast goes on with the last slope."""
    y = np.asarray(y, float)
    if len(y) < 2:
        raise ValueError("the trend model needs 2 data points")

    def cost(psi: float) -> float:
        squares, logs = _trend_pass(y, math.exp(min(psi, 700.0)))
        return logs if squares == 0 else (len(y) - 2.0) * math.log(squares) + logs

    zeta = math.exp(min(minimise(cost, 1.0), 700.0))
    squares, _, states, spread, slope, last = _trend_pass(y, zeta, keep=True)
    epsilon = squares / (len(y) - 2) if len(y) > 2 else squares
    state = np.array([y[0], y[1], *states, *([0.0] * ahead)])
    for i in range(len(y), len(state)):
        state[i] = state[i - 1] + slope
    raw = [epsilon * (1 + zeta), epsilon * (5 + 2 * zeta), *[(p + 2) * epsilon for p in spread]]
    raw += [raw[-1] + zeta * epsilon * (i + 1) for i in range(ahead)]
    n = len(y)
    var = np.array([raw[i] if i < n - 2 else (last + 1) * epsilon + (i - n + 3) * zeta * epsilon for i in range(n + ahead)])
    out = Fit(state, var)
    out.raw = np.array(raw)
    return out


def periodic(y: np.ndarray, period: int, ahead: int) -> Fit:
    """One level model per phase of the period; gaps in the first period are filled in straight lines."""
    y = np.array(y, float)
    for i in range(min(period, len(y))):
        if np.isnan(y[i]):
            j = i + 1
            while j < len(y) and np.isnan(y[j]):
                j += 1
            right = y[j] if j < len(y) else y[i - 1]
            left = y[i - 1] if i else right
            y[i:j] = [left + (right - left) * (k + 1) / (j - i + 1) for k in range(j - i)]
    total = len(y) + ahead
    state, var, raw = np.full(total, np.nan), np.full(total, np.nan), np.full(total, np.nan)
    for phase in range(min(period, len(y))):
        own = y[phase::period]
        steps = len(range(phase, total, period)) - len(own)
        fit = level(own, steps)
        state[phase::period], var[phase::period] = fit.state, fit.var
        raw[phase::period] = fit.var
    out = Fit(state, var)
    out.raw = raw
    return out


def find_period(y: np.ndarray) -> int:
    """The lag of the highest peak of the autocorrelation over the longest stretch without gaps; -1 for none."""
    ok = ~np.isnan(y)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
    if not len(edges):
        return 1
    lengths = edges[1::2] - edges[0::2]
    k = int(np.argmax(lengths))
    x = y[edges[0::2][k] : edges[1::2][k]]
    if len(x) <= 1:
        return 1
    x = x - x.mean()
    var = float(x @ x)
    if var == 0:
        return -1
    lags = min(len(x) - 1, LONGEST_LAG)
    cor = np.array([1.0, *[float(x[: len(x) - i] @ x[i:]) / var for i in range(1, lags + 1)]])
    best, at = 0.0, -1
    for i in range(1, len(cor) - 1):
        if cor[i] > cor[i - 1] and cor[i] > cor[i + 1] and cor[i] > best + 0.01:
            best, at = cor[i], i
    return at if best > 0.01 else -1


def combined(y: np.ndarray, period: int, ahead: int) -> Fit:
    """Trend and periodic levels, each weighted by the other's variance; the trend alone without a period."""
    one = trend(y, ahead)
    if period < 2 or len(y) < period:
        return Fit(one.state, one.raw)
    two = periodic(y, period, ahead)
    p2 = np.maximum.accumulate(np.where(np.isnan(two.raw), -np.inf, two.raw))
    p1, total = one.raw, one.raw + p2
    k = np.where(total > 0, p1 / np.where(total > 0, total, 1.0), 0.5)
    usable = np.isfinite(p2) & ~np.isnan(two.state)
    return Fit(np.where(usable, one.state + k * (two.state - one.state), one.state), np.where(usable, (1 - k) * p1, p1))


def fit(algorithm: str, y: np.ndarray, period: int, ahead: int) -> Fit:
    """``algorithm``: LL, LLT, LLP or LLP5."""
    if algorithm in ("LLP", "LLP5") and period <= 0:
        period = find_period(np.asarray(y, float))
    if algorithm == "LL":
        return level_in_pieces(y, ahead)
    if algorithm == "LLT":
        return trend(y, ahead)
    if algorithm == "LLP":
        return periodic(y, max(period, 1), ahead)
    return combined(y, period, ahead)
