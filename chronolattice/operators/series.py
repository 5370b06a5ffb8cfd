"""Row-wise series operations: each appends one column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolattice.functions import arrays, kernels

from .base import SERIES


class SeriesOps:
    def add_dft(self, out: str, source: str = SERIES):
        return self.with_column(out, kernels.dft(self.column(source)))

    def add_inverse_dft(self, out: str, source: str):
        return self.with_column(out, kernels.inverse_dft(self.column(source)))

    def add_dft_periodogram(self, out: str, dft: str):
        return self.with_column(out, arrays.periodogram(self.column(dft)))

    def add_dft_frequencies(self, out: str, source: str, step: str | float):
        return self.with_column(out, arrays.frequencies(self.column(source), step if isinstance(step, (int, float)) else self.column(step)))

    def add_log10_dft_periodogram(self, out: str, source: str, offset: float = 0.0):
        return self.with_column(out, kernels.log10_periodogram(self.column(source), offset))

    def add_dwt(self, out: str, source: str, wavelet: str = "haar"):
        return self.with_column(out, kernels.dwt(self.column(source), wavelet))

    def add_inverse_dwt(self, out: str, source: str, wavelet: str = "haar"):
        return self.with_column(out, kernels.dwt(self.column(source), wavelet, inverse=True))

    def add_euclidean_distance(self, out: str, a: str, b: str, squared: bool = True):
        return self.with_column(out, arrays.euclidean(self.column(a), self.column(b), squared))

    def add_relative_ratio(self, out: str, deviant: str, referent: str, ieee: bool = False):
        return self.with_column(out, arrays.relative_ratio(self.column(deviant), self.column(referent), ieee))

    def add_low_pass(self, out: str, dft: str, keep: int):
        return self.with_column(out, arrays.low_pass(self.column(dft), keep))

    def _interpolated(self, out: str, xs: str, ys: str, new: str | Sequence[float], cubic: bool):
        return self.with_column(out, kernels.interpolated(self.column(xs), self.column(ys), self.column(new) if isinstance(new, str) else new, cubic))

    def add_linear_interpolation(self, out: str, xs: str, ys: str, new: str | Sequence[float]):
        return self._interpolated(out, xs, ys, new, False)

    def add_cubic_interpolation(self, out: str, xs: str, ys: str, new: str | Sequence[float]):
        return self._interpolated(out, xs, ys, new, True)

    def add_log10(self, out: str, source: str, offset: float = 0.0):
        return self.with_column(out, arrays.log10(self.column(source), offset))

    def add_scaled(self, out: str, source: str, epsilon: float):
        return self.with_column(out, arrays.scaled(self.column(source), epsilon))

    def add_centered(self, out: str, source: str):
        return self.with_column(out, arrays.centered(self.column(source)))

    def add_weighted(self, out: str, source: str, weights: Sequence[float]):
        return self.with_column(out, arrays.weighted(self.column(source), weights))

    def add_z_normalized(self, out: str, source: str, epsilon: float):
        return self.with_column(out, arrays.z_normalized(self.column(source), epsilon))

    def add_sum_normalized(self, out: str, source: str):
        return self.with_column(out, arrays.sum_normalized(self.column(source)))

    def add_categorical_coding(self, out: str, source: str, categories: int):
        return self.with_column(out, arrays.one_hot(self.column(source), categories))

    def add_flatten(self, out: str, source: str):
        return self.with_column(out, F.flatten(self.column(source)))

    def add_nullified(self, out: str, source: str, hit: Callable[[Column], Column]):
        return self.with_column(out, arrays.nullified(self.column(source), hit))

    def add_nullified_slice(self, out: str, source: str, start: int, quantity: int):
        return self.with_column(out, arrays.nullified_slice(self.column(source), start, quantity))

    def add_element_at(self, out: str, source: str, index: str):
        return self.with_column(out, arrays.element(self.column(source), self.column(index)))

    def add_vector(self, out: str, source: str):
        return self.with_column(out, array_to_vector(self.column(source)))

    def add_array_from_vector(self, out: str, source: str):
        return self.with_column(out, vector_to_array(self.column(source)))

    def add_vector_assembly(self, out: str, sources: Sequence[str]):
        return self._of(VectorAssembler(inputCols=list(sources), outputCol=out).transform(self.df))
