"""Distribution functions on arrays: incomplete beta and gamma, F and t quantiles, chi-square tail."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_beta(a, b) -> np.ndarray:
    return _lgamma(a) + _lgamma(b) - _lgamma(np.add(a, b))


def betainc(a, b, x, scale=None) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz); scale: log_beta(a, b), if it is known."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    scale = log_beta(a, b) if scale is None else scale
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - scale) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def _beta_inverse(a, b, target, guess) -> np.ndarray:
    """Where betainc(a, b, x) reaches the target: Newton steps from a guess, kept within a bracket that every step narrows."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, guess)))
    low, high = np.zeros(a.shape), np.ones(a.shape)
    x = np.clip(x, 1e-12, 1 - 1e-12)
    scale = log_beta(a, b)
    for _ in range(100):
        off = betainc(a, b, x, scale) - target
        low, high = np.where(off < 0, x, low), np.where(off < 0, high, x)
        with np.errstate(all="ignore"):
            newton = x - off / np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - scale)
        new = np.where((newton > low) & (newton < high), newton, (low + high) / 2)
        done = np.all(np.abs(new - x) <= 1e-13 * new)  # the next step would be below the last digits
        x = new
        if done:
            break
    return x


def f_ppf(p: float, d1, d2) -> np.ndarray:
    """The quantile of the F distribution."""
    d1, d2 = np.broadcast_arrays(np.asarray(d1, float), np.asarray(d2, float))
    a, b = d1 / 2, d2 / 2
    # The usual normal approximation of a beta quantile as the first guess.
    z = NormalDist().inv_cdf(p)
    with np.errstate(all="ignore"):
        u, v = 1 / (2 * a - 1), 1 / (2 * b - 1)
        h, w = 2 / (u + v), (z * z - 3) / 6
        w = z * np.sqrt(h + w) / h - (v - u) * (w + 5 / 6 - 2 / (3 * h))
        guess = a / (a + b * np.exp(-2 * w))
    x = _beta_inverse(a, b, p, np.where((a > 1) & (b > 1) & np.isfinite(guess), guess, 0.5))
    return d2 * x / (d1 * (1 - x))


def t_ppf(p: float, df) -> np.ndarray:
    """The quantile of Student's t for p >= 0.5."""
    df = np.asarray(df, float)
    z = NormalDist().inv_cdf(p)
    guess = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    x = _beta_inverse(df / 2, 0.5, 2 * (1 - p), df / (df + guess**2))
    return np.sqrt(df * (1 - x) / x)


def chi2_sf(x: float, df: float) -> float:
    """The upper tail of chi-square: the series below the mean, the continued fraction above."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = y + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = num * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h
