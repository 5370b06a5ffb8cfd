"""Deferred steps over series sets, and pipelines of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolattice.functions import arrays, kernels
from chronolattice.operators.base import SERIES, SIMULATION_ID, TIME_STEP, VARIABLE
from chronolattice.operators.distances import prototypes
from chronolattice.operators.evaluation import davies_bouldin
from chronolattice.operators.series_set import SeriesSet


class Step:
    """A function of a series set; steps add up to pipelines."""

    def __call__(self, data: SeriesSet) -> SeriesSet:
        raise NotImplementedError

    def __add__(self, other: Step) -> Pipeline:
        return Pipeline([*self._parts(), *other._parts()])

    def _parts(self) -> list[Step]:
        return [self]


class Pipeline(Step):
    def __init__(self, steps: Sequence[Step]) -> None:
        self.steps = list(steps)

    def __call__(self, data: SeriesSet) -> SeriesSet:
        return reduce(lambda d, step: step(d), self.steps, data)

    def _parts(self) -> list[Step]:
        return self.steps


@dataclass
class FunctionStep(Step):
    function: Callable[[SeriesSet], SeriesSet]

    def __call__(self, data: SeriesSet) -> SeriesSet:
        return self.function(data)


@dataclass
class InterpolatedFourierVectorization(Step):
    """z-normalises, transforms, and reads every periodogram at common frequencies: multiples of the mean frequency step."""

    out: str = "fourier"
    source: str = SERIES
    step_column: str = TIME_STEP
    epsilon: float = 1e-9
    points: int | None = None

    def __call__(self, data: SeriesSet) -> SeriesSet:
        d = data.add_z_normalized("fourier_z", self.source, self.epsilon).add_dft_frequencies("fourier_freq", self.source, self.step_column)
        # The non-negative half in ascending order.
        x = F.slice("fourier_freq", F.lit(1), F.ceil(F.size("fourier_freq") / 2).cast("int"))
        row = d.df.select(x.alias("x")).agg(F.avg(arrays.first_step("x")).alias("step"), F.min(F.array_max("x")).alias("top"), F.max(F.size("x")).alias("n")).first()
        n = self.points or (row.n or 1)
        xs = [i * row.step for i in range(1, n) if i * row.step <= row.top] if row.step else []
        d = d.with_column(self.out, kernels.periodogram_at(F.col("fourier_z"), d.column(self.step_column), xs))
        return d.drop("fourier_z", "fourier_freq")


@dataclass
class Log10Scale(Step):
    """Scale, log10(x + 1), ML vector."""

    out: str
    source: str
    epsilon: float = 1e-9

    def __call__(self, data: SeriesSet) -> SeriesSet:
        return data.add_scaled("log_scaled", self.source, self.epsilon).add_log10("log_values", "log_scaled", 1.0).add_vector(self.out, "log_values").drop("log_scaled", "log_values")


@dataclass
class PCAStep(Step):
    """Optional scaling, components, scaling, weights by the root of the explained variance."""

    out: str
    source: str
    k: int
    threshold: float = 0.0
    scale: bool = True
    model: object = field(default=None, compare=False)

    def __call__(self, data: SeriesSet) -> SeriesSet:
        d = data.add_column_scaled("pca_scaled", self.source, True, True) if self.scale else data.with_column("pca_scaled", data.column(self.source))
        d, self.model = d.add_pca_with_model("pca_raw", "pca_scaled", self.k, self.threshold)
        d = d.add_column_scaled("pca_unit", "pca_raw", True, False).add_array_from_vector("pca_array", "pca_unit")
        d = d.add_weighted("pca_weighted", "pca_array", np.sqrt(self.model.explained).tolist()).add_vector(self.out, "pca_weighted")
        return d.drop("pca_scaled", "pca_raw", "pca_unit", "pca_array", "pca_weighted")


@dataclass
class FlattenVectorize(Step):
    columns: Sequence[tuple[str, str]]

    def __call__(self, data: SeriesSet) -> SeriesSet:
        for out, source in self.columns:
            data = data.with_column(f"{out}_flat", F.flatten(data.column(source))).add_vector(out, f"{out}_flat").drop(f"{out}_flat")
        return data


@dataclass
class MixtureStep(Step):
    """Gaussian mixtures of several sizes: a label column ``<out>_<k>`` for each."""

    out: str
    source: str
    ks: Sequence[int]
    max_iterations: int = 100
    runs: int = 1
    seed: int = 0

    def __call__(self, data: SeriesSet) -> SeriesSet:
        for k in self.ks:
            data, _ = data.add_mixture(f"{self.out}_{k}", self.source, k, self.max_iterations, runs=self.runs, seed=self.seed)
        return data


@dataclass
class AutoMixtureStep(Step):
    out: str
    source: str
    ks: Sequence[int]
    seed: int = 0

    def __call__(self, data: SeriesSet) -> SeriesSet:
        return data.add_auto_mixture(self.out, self.source, self.ks, seed=self.seed)[0]


@dataclass
class SOMStep(Step):
    out: str
    source: str
    height: int
    width: int
    max_iterations: int = 20
    seed: int = 0

    def __call__(self, data: SeriesSet) -> SeriesSet:
        return data.add_som(self.out, self.source, self.height, self.width, self.max_iterations, self.seed)[0]


@dataclass
class AutoSOMStep(Step):
    out: str
    source: str
    sizes: Sequence[tuple[int, int]]
    seed: int = 0

    def __call__(self, data: SeriesSet) -> SeriesSet:
        return data.add_auto_som(self.out, self.source, self.sizes, seed=self.seed)[0]


@dataclass
class GroupScenarios(Step):
    """Multivariate rows by simulation, in the order of the variables' names; vectors become arrays, columns can be renamed."""

    vectors: Sequence[str] = ()
    renamed: Sequence[tuple[str, str]] = ()

    def __call__(self, data: SeriesSet) -> SeriesSet:
        for v in self.vectors:
            data = data.with_column_renamed(v, f"{v}_vector").add_array_from_vector(v, f"{v}_vector").drop(f"{v}_vector")
        data = data.group(data.decorator(SIMULATION_ID), data.decorator(VARIABLE))
        for old, new in self.renamed:
            data = data.with_column_renamed(old, new)
        return data


@dataclass
class PrototypeScaling(Step):
    """Multidimensional scaling of label sequences by the distances of the labels' prototypes."""

    out: str
    labels: str
    centres: np.ndarray
    k: int
    threshold: float = 0.0
    model: object = field(default=None, compare=False)

    def __call__(self, data: SeriesSet) -> SeriesSet:
        c = np.asarray(self.centres, float)
        between = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
        d, self.model = data.add_mds_with_model("mds_raw", self.labels, self.k, prototypes(between), self.threshold)
        d = d.add_vector("mds_vector", "mds_raw").add_column_scaled("mds_unit", "mds_vector", True, False).add_array_from_vector("mds_array", "mds_unit")
        return d.add_weighted(self.out, "mds_array", np.sqrt(self.model.explained).tolist()).drop("mds_raw", "mds_vector", "mds_unit", "mds_array")


@dataclass
class ClusteringEvaluation(Step):
    """Saves the contingency of decorators and clusters and notes the Davies-Bouldin index; passes the set on."""

    cluster: str
    representation: str
    folder: str | None = None
    davies_bouldin: float | None = field(default=None, compare=False)
    contingency: DataFrame | None = field(default=None, compare=False)

    def __call__(self, data: SeriesSet) -> SeriesSet:
        self.contingency = data.contingency_map_scalar("decorator", "value", "cluster", "frequency", "decorators", self.cluster)
        rows = data.df.select(data._arrays(self.representation).alias("x"), F.col(self.cluster).alias("c"))
        self.davies_bouldin = davies_bouldin(rows, "x", "c").first()[0]
        if self.folder:
            self.contingency.write.mode("overwrite").parquet(f"{self.folder}/contingency")
            data.df.sparkSession.createDataFrame([(self.davies_bouldin,)], "davies_bouldin double").coalesce(1).write.mode("overwrite").csv(f"{self.folder}/davies_bouldin", header=True)
        return data


@dataclass
class PartitionStep(Step):
    n: int

    def __call__(self, data: SeriesSet) -> SeriesSet:
        return data.repartition(self.n)


class PersistStep(Step):
    def __call__(self, data: SeriesSet) -> SeriesSet:
        return data.persist()


class GlobalUnpersist(Step):
    def __call__(self, data: SeriesSet) -> SeriesSet:
        data.df.sparkSession.catalog.clearCache()
        return data
