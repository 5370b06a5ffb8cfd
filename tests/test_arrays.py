import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolattice.functions import arrays, kernels
from chronolattice.operators.series_set import SeriesSet

SERIES = [[1.0, 2.0, 4.0, 8.0], [3.0, 3.0, 3.0], [5.0], [], None, [-1.0, 0.0, 1.0, 2.0, -2.0, 0.5, 7.0]]


@pytest.fixture(scope="module")
def data(spark):
    return SeriesSet(spark.createDataFrame([(i, s) for i, s in enumerate(SERIES)], "id long, series array<double>"))


def column(d, name):
    return [r[name] for r in d.df.orderBy("id").collect()]


def check(got, f):
    for g, s in zip(got, SERIES):
        if s is None:
            assert g is None
        else:
            np.testing.assert_allclose(np.array(g, float), np.array(f(np.array(s)), float), atol=1e-9)


def test_normalisations(data):
    d = data.add_centered("c", "series").add_z_normalized("z", "series", 1e-9).add_scaled("s", "series", 1e-9)
    check(column(d, "c"), lambda x: x - x.mean() if len(x) else x)
    check(column(d, "z"), lambda x: np.zeros(len(x)) if len(x) == 0 or x.std() < 1e-9 else (x - x.mean()) / x.std())
    check(column(d, "s"), lambda x: np.zeros(len(x)) if len(x) == 0 or x.std() < 1e-9 else x / x.std())


def test_transform_and_back(data):
    d = data.add_dft("f", "series").add_inverse_dft("b", "f").add_dft_periodogram("p", "f").add_dft_frequencies("q", "series", 0.5).add_log10_dft_periodogram("l", "series", 1.0)
    check(column(d, "b"), lambda x: x)
    check(column(d, "p"), lambda x: np.abs(np.fft.fft(x)) ** 2 / len(x) if len(x) else x)
    check(column(d, "q"), lambda x: np.fft.fftfreq(len(x), 0.5) if len(x) else x)
    check(column(d, "l"), lambda x: np.log10(np.abs(np.fft.fft(x)) ** 2 / len(x) + 1) if len(x) else x)


def test_parseval(data):
    d = data.where("size(series) > 0").add_dft("f", "series").add_dft_periodogram("p", "f")
    for r in d.df.collect():
        assert sum(r.p) == pytest.approx(sum(x * x for x in r.series))


def test_log10_limits(spark):
    df = spark.createDataFrame([([0.0, -1.0, 10.0],)], "s array<double>")
    got = df.select(arrays.log10("s").alias("l")).first().l
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2] == pytest.approx(1.0)


def test_sum_normalised_with_zero_sum(spark):
    got = spark.createDataFrame([([1.0, -1.0, 0.0],)], "s array<double>").select(arrays.sum_normalized("s").alias("l")).first().l
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])


@pytest.mark.parametrize("keep", [0, 1, 2, 3, 9])
def test_low_pass(data, keep):
    d = data.add_low_pass("l", "series", keep)
    check(column(d, "l"), lambda x: [v if i < keep or i > len(x) - keep else 0.0 for i, v in enumerate(x)])


def test_selection_kernels(data):
    d = data.add_weighted("w", "series", [2.0, 0.0]).add_nullified_slice("n", "series", 1, 2).add_nullified("e", "series", lambda i: i % 2 == 1)
    check(column(d, "w"), lambda x: x[:2] * np.array([2.0, 0.0])[: len(x[:2])])
    check(column(d, "n"), lambda x: [0.0 if 1 <= i < 3 else v for i, v in enumerate(x)])
    check(column(d, "e"), lambda x: [0.0 if i % 2 else v for i, v in enumerate(x)])


def test_one_hot_and_element(spark):
    df = spark.createDataFrame([(2, [7, 8, 9])], "c int, a array<int>")
    r = df.select(arrays.one_hot("c", 4).alias("h"), arrays.element("a", "c").alias("e"), arrays.relative_ratio(F.lit(3.0), F.lit(2.0)).alias("r"), arrays.relative_ratio(F.lit(3.0), F.lit(0.0)).alias("z")).first()
    assert r.h == [0, 0, 1, 0] and r.e == 9 and r.r == 0.5 and r.z is None
    with pytest.raises(Exception, match="out of range"):
        df.select(arrays.one_hot("c", 2)).collect()


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>")
    r = df.select(arrays.euclidean("a", "b").alias("q"), arrays.euclidean("a", "b", False).alias("d"), arrays.weighted_euclidean("a", "b", [1, 0.5]).alias("w"), arrays.hamming("a", "b").alias("h")).first()
    assert (r.q, r.d, r.w, r.h) == (25.0, 5.0, 17.0, 2.0)
    with pytest.raises(Exception, match="differ in length"):
        df.select(arrays.euclidean(F.col("a"), F.array(F.lit(1.0)))).collect()


@pytest.mark.parametrize("name", ["haar", "d4", "d8", "d20"])
def test_wavelets_are_orthogonal(name):
    x = np.random.default_rng(0).normal(size=(3, 32))
    h = kernels.wavelet_filter(name)
    y = kernels.pyramid(x, h)
    np.testing.assert_allclose(kernels.pyramid(y, h, inverse=True), x, atol=1e-9)
    np.testing.assert_allclose((y**2).sum(), (x**2).sum())
    with pytest.raises(ValueError):
        kernels.pyramid(x[:, :6], h)


def test_interpolation():
    x, y = np.array([2.0, 0.0, 1.0]), np.array([4.0, 0.0, 1.0])
    np.testing.assert_allclose(kernels.linear_at(x, y, np.array([-1.0, 0.5, 1.5, 3.0])), [-1.0, 0.5, 2.5, 7.0])
    np.testing.assert_allclose(kernels.cubic_at(np.arange(4.0), np.array([0, 1, 0, 1.0]), np.array([0.5, 1.5, 2.5])), [0.75, 0.5, 0.25])
    with pytest.raises(ValueError):
        kernels.cubic_at(x, y, np.array([3.0]))


def test_per_row_interpolation(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0], [0.0, 2.0, 0.0], [0.5, 1.5]), (None, [1.0], [0.0])], "x array<double>, y array<double>, n array<double>")
    rows = df.select(kernels.interpolated(F.col("x"), F.col("y"), F.col("n")).alias("l"), kernels.interpolated(F.col("x"), F.col("y"), F.col("n"), cubic=True).alias("c")).collect()
    assert rows[0].l == [1.0, 1.0] and rows[0].c == pytest.approx([1.375, 1.375]) and rows[1].l is None


def test_kernels_chain_without_barriers(data):
    d = data.where("size(series) > 1").add_z_normalized("z", "series", 1e-9).add_dft("f", "z").add_low_pass("k", "f", 2).add_inverse_dft("b", "k").add_dft_periodogram("p", "k").add_log10("l", "p", 1.0)
    assert len(d.select("l").collect()) == 3


def test_periodograms_at_equal_one_by_one(spark):
    rng = np.random.default_rng(8)
    sizes = [1, 2, 3, 8, 8, 8, 13, 20, 20]
    rows = [(i, rng.normal(size=n).tolist(), 0.5 + i % 3) for i, n in enumerate(sizes)] + [(90, [], 1.0), (91, None, 1.0)]
    at = [0.05, 0.11, 0.4, 3.0]
    df = spark.createDataFrame(rows, "id long, v array<double>, s double")
    got = {r.id: r.p for r in df.select("id", kernels.periodogram_at(F.col("v"), F.col("s"), at).alias("p")).collect()}
    for i, v, s in rows[: len(sizes)]:
        half = -(-len(v) // 2)
        y = np.abs(np.fft.fft(v)[:half]) ** 2 / len(v)
        np.testing.assert_allclose(got[i], kernels.linear_at(np.arange(half) / (len(v) * s), y, np.array(at)), rtol=1e-9, atol=1e-12)
    assert got[91] is None and all(v is None or v != v for v in got[90])
