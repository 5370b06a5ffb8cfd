"""Series kernels as Column expressions: they stay in the JVM and fuse into one projection.

Conventions: a null series gives null, an empty one an empty series.  What all
elements need (a mean, a size) reaches a lambda by :func:`beside`, never by
capture: Spark evaluates a captured expression anew for every element, and
cannot plan a Python UDF over nested or capturing lambdas.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY, NAN = float("inf"), float("nan")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(series: Column) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda a, x: a + x)


def mean(series: Column) -> Column:
    return F.try_divide(total(series), F.size(series))


def beside(series: Column, value: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(element, value)`` of every element, ``value`` evaluated once per row."""
    return F.zip_with(series, F.array_repeat(value, F.size(series)), f)


def deviation(series: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(mean(F.transform(beside(series, mean(series), lambda x, m: x - m), lambda d: d * d)))


def indices(series: Column) -> Column:
    """0 .. n-1, empty for an empty series."""
    return F.transform(series, lambda x, i: i)


def centered(series: Column | str) -> Column:
    s = _col(series)
    return beside(s, mean(s), lambda x, m: x - m)


def z_normalized(series: Column | str, epsilon: float) -> Column:
    """(x - mean) / population deviation; zeros where the deviation is under ``epsilon``."""
    s = _col(series)
    return beside(centered(s), deviation(s), lambda x, d: F.when(d < epsilon, 0.0).otherwise(F.try_divide(x, d)))


def scaled(series: Column | str, epsilon: float) -> Column:
    """x / population deviation, not centred; zeros where the deviation is under ``epsilon``."""
    s = _col(series)
    return beside(s, deviation(s), lambda x, d: F.when(d < epsilon, 0.0).otherwise(F.try_divide(x, d)))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN for a zero divisor, as in IEEE arithmetic."""
    return F.when(b != 0, F.try_divide(a, b)).when((a > 0) & ~F.isnan(a), INFINITY).when(a < 0, -INFINITY).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(NAN)


def sum_normalized(series: Column | str) -> Column:
    s = _col(series)
    return beside(s, total(s), ieee_divide)


def log10(series: Column | str, offset: float = 0.0) -> Column:
    """log10(x + offset): -Infinity at 0, NaN below."""
    one = lambda x: F.when(x + offset > 0, F.log10(x + offset)).when(x + offset == 0, -INFINITY).when(x.isNull(), F.lit(None)).otherwise(NAN)
    return F.transform(_col(series), one)


def weighted(series: Column | str, weights: Sequence[float] | Column) -> Column:
    """Element-wise product; the longer side is cut to the shorter."""
    s = _col(series)
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(float(x)) for x in weights])
    n = F.least(F.size(s), F.size(w))
    return F.zip_with(F.slice(s, F.lit(1), n), F.slice(w, F.lit(1), n), lambda x, y: x * y)


def periodogram(dft: Column | str) -> Column:
    """(re^2 + im^2) / n of an interleaved transform of n points."""
    d = _col(dft)
    power = F.zip_with(F.filter(d, lambda x, i: i % 2 == 0), F.filter(d, lambda x, i: i % 2 == 1), lambda re, im: re * re + im * im)
    return beside(power, F.size(d) / 2, lambda x, n: F.try_divide(x, n))


def frequencies(series: Column | str, step: Column | str | float) -> Column:
    """Frequencies of the transform's bins: 0, positive ones, then negative ones; ``i / (n step)``."""
    s = _col(series)
    dt = F.lit(float(step)) if isinstance(step, (int, float)) else _col(step)
    shared = F.struct(F.size(s).alias("n"), dt.cast("double").alias("dt"))
    return beside(indices(s), shared, lambda i, c: F.try_divide(F.when(i < F.ceil(c["n"] / 2), i).otherwise(i - c["n"]).cast("double"), c["n"] * c["dt"]))


def low_pass(dft: Column | str, keep: int) -> Column:
    """Zero outside the first ``keep`` and the last ``keep - 1`` entries."""
    d = _col(dft)
    n, tail = F.size(d), max(keep - 1, 0)
    cut = F.concat(F.slice(d, F.lit(1), F.lit(keep)), F.array_repeat(F.lit(0.0), n - keep - tail), F.slice(d, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)))
    return F.when(n <= keep + tail, d).otherwise(cut)


def nullified(series: Column | str, hit: Callable[[Column], Column]) -> Column:
    """0 where ``hit(index)`` holds."""
    return F.transform(_col(series), lambda x, i: F.when(hit(i), F.lit(0).cast("double")).otherwise(x))


def nullified_slice(series: Column | str, start: int, quantity: int) -> Column:
    return nullified(series, lambda i: (i >= start) & (i < start + quantity))


def one_hot(category: Column | str, n: int) -> Column:
    """Binary code of floor(category), counted from 0; an error out of range."""
    c = F.floor(_col(category))
    code = beside(F.sequence(F.lit(0), F.lit(n - 1)), c, lambda i, k: F.when(i == k, 1.0).otherwise(0.0))
    return F.when((c < 0) | (c >= n), F.raise_error(F.concat(F.lit("category out of range: "), c.cast("string")))).when(c.isNotNull(), code)


def element(values: Column | str, index: Column | str) -> Column:
    """Element counted from 0, null out of range."""
    return F.get(_col(values), _col(index).cast("int"))


def relative_ratio(deviant: Column | str, referent: Column | str, ieee: bool = False) -> Column:
    """(deviant - referent) / referent; for a referent of 0 null, or infinities and NaN as in IEEE arithmetic."""
    divide = ieee_divide if ieee else F.try_divide
    return divide(_col(deviant) - _col(referent), _col(referent).cast("double"))


def same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("series differ in length")))


def euclidean(a: Column | str, b: Column | str, squared: bool = True) -> Column:
    x, y = _col(a), _col(b)
    d = F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return same_length(x, y, d if squared else F.sqrt(d))


def weighted_euclidean(a: Column | str, b: Column | str, weights: Sequence[float]) -> Column:
    """Sum of w (x - y)^2."""
    x, y = _col(a), _col(b)
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), w, lambda d, v: d * v), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of places that differ."""
    x, y = _col(a), _col(b)
    return same_length(x, y, F.aggregate(F.zip_with(x, y, lambda p, q: (p != q).cast("double")), F.lit(0.0), lambda s, v: s + v))


def prototype_distance(a: Column | str, b: Column | str, matrix: Sequence[Sequence[float]]) -> Column:
    """Sum over positions of ``matrix[a_i][b_i]``, for vectors of cluster labels."""
    x, y = _col(a), _col(b)
    m = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.get(F.get(m, p.cast("int")), q.cast("int"))), F.lit(0.0), lambda s, v: s + v)


def first_step(values: Column | str) -> Column:
    v = _col(values)
    return F.get(v, F.lit(1)) - F.get(v, F.lit(0))
