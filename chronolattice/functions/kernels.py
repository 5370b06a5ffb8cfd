"""Numeric kernels that Spark lacks, as Arrow-batched pandas UDFs over numpy.

Series of one length in a batch are stacked and transformed together.  Null
series give null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = T.ArrayType(T.DoubleType())


def by_length(values: pd.Series, f: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """Applies ``f`` (rows x n -> rows x m) to the stacked series of each length."""
    out: list[np.ndarray | None] = [None] * len(values)
    groups: dict[int, list[int]] = {}
    for k, v in enumerate(values):
        if v is not None:
            groups.setdefault(len(v), []).append(k)
    for n, rows in groups.items():
        if n == 0:
            found = [np.zeros(0)] * len(rows)
        else:
            found = f(np.array([values.iloc[k] for k in rows], np.float64))
        for k, r in zip(rows, found):
            out[k] = r
    return pd.Series(out, index=values.index, dtype=object)


def interleave(z: np.ndarray) -> np.ndarray:
    out = np.empty((z.shape[0], 2 * z.shape[1]))
    out[:, 0::2], out[:, 1::2] = z.real, z.imag
    return out


@F.pandas_udf(_DOUBLES)
def _dft(series: pd.Series) -> pd.Series:
    return by_length(series, lambda x: interleave(np.fft.fft(x, axis=1)))


@F.pandas_udf(_DOUBLES)
def _inverse_dft(series: pd.Series) -> pd.Series:
    return by_length(series, lambda x: np.fft.ifft(x[:, 0::2] + 1j * x[:, 1::2], axis=1).real)


def dft(series: Column) -> Column:
    """Unnormalised complex transform, real and imaginary parts in turn."""
    return _dft(series)


def inverse_dft(series: Column) -> Column:
    """Real part of the inverse transform (with 1/n)."""
    return _inverse_dft(series)


def log10_periodogram(series: Column, offset: float = 0.0) -> Column:
    """log10 of the periodogram plus ``offset``, in one pass over the series."""

    @F.pandas_udf(_DOUBLES)
    def run(values: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.log10(np.abs(np.fft.fft(x, axis=1)) ** 2 / x.shape[1] + offset)

        return by_length(values, one)

    return run(series)


def _daubechies(taps: int) -> np.ndarray:
    """Scaling filter of ``taps`` coefficients by spectral factorisation (minimum phase)."""
    from math import comb

    p = taps // 2
    # Roots in z of P((2 - z - 1/z) / 4), those inside the unit circle.
    poly = np.zeros(1)
    base = np.array([-0.25, 0.5, -0.25])
    term = np.ones(1)
    for k in range(p):
        poly = np.polyadd(np.pad(poly, (0, 0)), comb(p - 1 + k, k) * np.pad(term, (0, p - 1 - k)))
        term = np.convolve(term, base)
    roots = np.roots(poly) if p > 1 else np.zeros(0)
    h = np.ones(1)
    for r in roots[np.abs(roots) < 1]:
        h = np.convolve(h, [1, -r])
    for _ in range(p):
        h = np.convolve(h, [1, 1])
    h = h.real
    return h * np.sqrt(2) / h.sum()


def wavelet_filter(name: str) -> np.ndarray:
    """Scaling filter by name: ``haar``, or ``d4`` .. ``d20`` (also ``daubechies 4`` ..) by number of taps."""
    key = name.lower().replace("daubechies", "d").replace(" ", "").replace("(", "").replace(")", "")
    if key in ("haar", "d2"):
        return np.array([1.0, 1.0]) / np.sqrt(2)
    if key.startswith("d") and key[1:].isdigit() and int(key[1:]) % 2 == 0 and 2 < int(key[1:]) <= 20:
        return _daubechies(int(key[1:]))
    raise ValueError(f"unknown wavelet {name!r}")


def pyramid(x: np.ndarray, h: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Periodic wavelet transform of rows whose length is a power of two; smooth part first."""
    n = x.shape[1]
    if n & (n - 1):
        raise ValueError(f"a wavelet transform needs a power of two, not {n} values")
    g = h[::-1] * (-1.0) ** np.arange(len(h))
    x = x.copy()
    sizes = [n >> k for k in range(n.bit_length() - 1) if n >> k >= 2]
    for m in reversed(sizes) if inverse else sizes:
        at = (2 * np.arange(m // 2)[:, None] + np.arange(len(h))) % m
        if inverse:
            smooth, detail, y = x[:, : m // 2], x[:, m // 2 : m], np.zeros((len(x), m))
            for t in range(len(h)):
                y[:, at[:, t]] += smooth * h[t] + detail * g[t]
            x[:, :m] = y
        else:
            parts = x[:, :m][:, at]
            x[:, :m] = np.concatenate((parts @ h, parts @ g), axis=1)
    return x


def dwt(series: Column, name: str, inverse: bool = False) -> Column:
    h = wavelet_filter(name)

    @F.pandas_udf(_DOUBLES)
    def run(values: pd.Series) -> pd.Series:
        return by_length(values, lambda x: pyramid(x, h, inverse))

    return run(series)


def linear_at(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Piecewise linear through the sorted nodes, going on in the end segments' direction outside."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    if len(x) < 2:
        return np.full(len(new), y[0] if len(y) else np.nan)
    k = np.clip(np.searchsorted(x, new, side="right") - 1, 0, len(x) - 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return y[k] + (y[k + 1] - y[k]) * (new - x[k]) / (x[k + 1] - x[k])


def cubic_at(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Natural cubic spline through the sorted nodes; an error outside them."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    if not len(new):
        return np.zeros(0)
    if len(x) < 2 or new.min() < x[0] or new.max() > x[-1]:
        raise ValueError("cubic interpolation outside of the series")
    n, h = len(x), np.diff(x)
    m = np.zeros(n)
    if n > 2:
        slope = np.diff(y) / h
        c, d = np.zeros(n), np.zeros(n)
        for k in range(1, n - 1):
            w = 2 * (h[k - 1] + h[k]) - h[k - 1] * c[k - 1]
            c[k] = h[k] / w
            d[k] = (6 * (slope[k] - slope[k - 1]) - h[k - 1] * d[k - 1]) / w
        for k in range(n - 2, 0, -1):
            m[k] = d[k] - c[k] * m[k + 1]
    k = np.clip(np.searchsorted(x, new, side="right") - 1, 0, n - 2)
    a, b = (x[k + 1] - new) / h[k], (new - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6


def interpolated(xs: Column, ys: Column, new: Column | Sequence[float], cubic: bool = False) -> Column:
    """Values at new abscissae: one constant list, or a column of lists."""
    at = cubic_at if cubic else linear_at
    if isinstance(new, Column):

        @F.pandas_udf(_DOUBLES)
        def each(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([None if a is None or b is None or c is None else at(np.asarray(a, float), np.asarray(b, float), np.asarray(c, float)) for a, b, c in zip(x, y, n)], dtype=object)

        return each(xs, ys, new)
    points = np.asarray(list(new), float)

    @F.pandas_udf(_DOUBLES)
    def constant(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else at(np.asarray(a, float), np.asarray(b, float), points) for a, b in zip(x, y)], dtype=object)

    return constant(xs, ys)


#: Values of series that a task transforms at a time.
VALUES_AT_A_TIME = 500_000


def _periodograms_at(z: np.ndarray, step: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Periodograms of rows of one length at new frequencies, as :func:`linear_at` of their non-negative half."""
    n = z.shape[1]
    half = -(-n // 2)
    f = np.fft.fft(z, axis=1)[:, :half]
    y, x = (f.real * f.real + f.imag * f.imag) / n, np.arange(half) / (n * step[:, None])
    out, row = np.empty((len(z), len(new))), np.arange(len(z))
    for c, p in enumerate(new):
        if half < 2:
            out[:, c] = y[:, 0]
            continue
        k = np.clip((x <= p).sum(1) - 1, 0, half - 2)
        low = x[row, k]
        out[:, c] = y[row, k] + (y[row, k + 1] - y[row, k]) * (p - low) / (x[row, k + 1] - low)
    return out


def periodogram_at(series: Column, step: Column, new: Sequence[float]) -> Column:
    """Transform, periodogram and its values at constant frequencies in one pass: a task keeps one Python worker and a strip of its batch."""
    points = np.asarray(list(new), float)

    @F.pandas_udf(_DOUBLES)
    def run(values: pd.Series, steps: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(values)
        groups: dict[int, list[int]] = {}
        for k, (v, s) in enumerate(zip(values, steps)):
            if v is not None:
                if len(v) and s > 0:
                    groups.setdefault(len(v), []).append(k)
                else:
                    out[k] = np.full(len(points), np.nan)
        for n, rows in groups.items():
            strip = max(1, VALUES_AT_A_TIME // n)
            for at in range(0, len(rows), strip):
                own = rows[at : at + strip]
                for k, r in zip(own, _periodograms_at(np.array([values.iloc[k] for k in own], np.float64), steps.iloc[own].to_numpy(float), points)):
                    out[k] = r
        return pd.Series(out, index=values.index, dtype=object)

    return run(series, step.cast("double"))
