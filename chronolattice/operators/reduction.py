"""Scaling of features, principal components and multidimensional scaling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .distances import DistanceSet, MatrixDistance, euclidean, mirrored, over_blocks, packed, pairwise, summaries

#: Points up to which scaling solves the eigenproblem on the driver.
DRIVER_POINTS = 3000


@dataclass
class Components:
    """Loadings (features x components) and shares of variance; eigenvalues where they are known."""

    loadings: np.ndarray
    explained: np.ndarray
    eigenvalues: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None


def needed(shares: np.ndarray, threshold: float, most: int) -> int:
    """Number of leading shares that reach the threshold, ``most`` if none does or it is 0."""
    if threshold <= 0:
        return most
    reached = np.flatnonzero(np.cumsum(shares) >= threshold - 1e-12)
    return int(reached[0]) + 1 if len(reached) else most


def moments(df: DataFrame, array_col: str, shift: np.ndarray | float = 0.0) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and sum of outer products of an array column (less ``shift``), summed in each task."""

    def partial(frames):
        n, s, q = 0, 0.0, 0.0
        for f in frames:
            x = np.array([v for v in f["x"] if v is not None], float)
            if len(x):
                x = x - shift
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    rows = df.select(F.col(array_col).alias("x")).mapInPandas(partial, "n long, s array<double>, q array<double>").collect()
    n = sum(r.n for r in rows)
    if not n:
        return 0, np.zeros(0), np.zeros((0, 0))
    s = np.sum([r.s for r in rows], axis=0)
    return n, s, np.sum([r.q for r in rows], axis=0).reshape(len(s), len(s))


def double_centred(distances: DataFrame) -> DataFrame:
    """(id1, id2, b): -d^2 / 2 less row and column means plus the overall mean, of a symmetric distance set."""
    b = distances.select("id1", "id2", (F.col("distance") * F.col("distance") * -0.5).alias("b"))
    means = b.groupBy("id1").agg(F.avg("b").alias("m"))
    overall = means.agg(F.avg("m").alias("overall"))
    out = b.join(means, "id1").join(means.select(F.col("id1").alias("id2"), F.col("m").alias("m2")), "id2").crossJoin(F.broadcast(overall))
    return out.select("id1", "id2", (F.col("b") - F.col("m") - F.col("m2") + F.col("overall")).alias("b"))


def centred_rows(df: DataFrame, id_col: str, vector_col: str, distance: MatrixDistance, rows: int) -> DataFrame:
    """:func:`double_centred` of the distances of a set's rows; the means are joined to the rows, not to the pairs."""
    half = lambda d: -0.5 * (d * d)
    means = summaries(df, id_col, vector_col, distance, rows, half).select(F.col("id").alias("mean_id"), (F.col("total") / F.col("n")).alias("m"))
    overall = means.agg(F.avg("m")).first()[0]
    slim = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    blocks = packed(slim.join(means, F.col("id") == F.col("mean_id")), "id", "x", rows, ["m"])
    kind = df.schema[id_col].dataType.simpleString()

    def cell(x, y):
        yield from mirrored(x, y, distance, lambda d, r, x, y: half(d) - x[4]["m"][r][:, None] - y[4]["m"][None] + overall)

    return over_blocks(blocks, blocks, cell, f"id1 {kind}, id2 {kind}, distance double", True).withColumnRenamed("distance", "b")


@dataclass
class Scaling:
    """Coordinates by id, shares of variance and stress of a multidimensional scaling."""

    ids: list
    coordinates: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    stress: float


def classical_scaling(distances: DistanceSet, k: int, threshold: float = 0.0, runs: int = 1, noise: float = 0.0, seed: int = 0, additive: bool = False) -> Scaling:
    """Classical scaling. Negative eigenvalues carry no variance.

    ``runs`` with ``noise``: the diagonal is shifted by a random share of the least
    positive distance and the run of least stress kept.  ``additive`` adds the
    constant that makes the distances Euclidean.  Up to ``DRIVER_POINTS`` points
    the eigenproblem is solved by numpy; beyond, by a block Krylov method of which
    Spark does the products.  A shift of the diagonal changes no eigenvector, so
    there ``runs`` and ``noise`` need no work; ``additive`` is refused.
    """
    ids = [r[0] for r in distances.df.select("id1").distinct().orderBy("id1").collect()]
    n = len(ids)
    k = min(k, n)
    if not n:
        return Scaling([], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    if n > DRIVER_POINTS:
        return _distributed_scaling(distances, ids, k, threshold, seed, additive)
    d = distances.to_matrix()
    if additive:
        d = d + _additive_constant(d) * (1 - np.eye(n))
    b = -0.5 * d**2
    b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    least = d[d > 0].min() if (d > 0).any() else 0.0
    best = None
    for _ in range(max(1, runs)):
        shift = rng.random() * least * noise
        values, vectors = np.linalg.eigh(b + shift * np.eye(n))
        values, vectors = values[::-1] - shift, vectors[:, ::-1]
        positive = np.maximum(values, 0.0)
        shares = positive**2 / max((values**2).sum(), 1e-300)
        keep = needed(shares[:k], threshold, k)
        x = vectors[:, :keep] * np.sqrt(positive[:keep])
        fitted = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)) if n <= 1500 else np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in x])
        stress = float((np.triu(fitted - d) ** 2).sum())
        if best is None or stress < best.stress:
            best = Scaling(ids, x, positive[:k], shares[:k], stress)
    return best


def _distributed_scaling(distances: DistanceSet, ids: list, k: int, threshold: float, seed: int, additive: bool) -> Scaling:
    """Classical scaling of which no task or driver holds all distances."""
    n, place = len(ids), {v: x for x, v in enumerate(ids)}
    if additive:
        raise ValueError(f"the additive constant of {n} points; at most {DRIVER_POINTS} fit")
    listed = distances.df.groupBy("id1").agg(F.array_sort(F.collect_list(F.struct("id2", "distance"))).alias("r")).select("id1", F.transform("r", lambda x: x["distance"]).alias("r"))

    def stacked(part):
        part = list(part)
        if part:
            yield np.array([place[r.id1] for r in part]), np.array([r.r for r in part], float)

    rows = listed.rdd.mapPartitions(stacked).persist(StorageLevel.MEMORY_AND_DISK)

    def product(x: np.ndarray) -> np.ndarray:
        x, out = x - x.mean(0), np.empty_like(x)
        for at, y in rows.map(lambda b: (b[0], -0.5 * (b[1] ** 2 @ x))).collect():
            out[at] = y
        return out - out.mean(0)

    try:
        values, vectors = largest_eigenpairs(product, n, k, seed)
    finally:
        rows.unpersist()
    values = np.maximum(values, 0.0)
    norm = double_centred(distances.df).agg(F.sum(F.col("b") * F.col("b"))).first()[0]
    shares = values**2 / max(norm, 1e-300)
    keep = needed(shares, threshold, k)
    x = vectors[:, :keep] * np.sqrt(values[:keep])

    def off(batches):
        for b in batches:
            one, two = (b[c].map(place).to_numpy(int) for c in ("id1", "id2"))
            upper = one < two
            fitted = np.sqrt(((x[one[upper]] - x[two[upper]]) ** 2).sum(1))
            yield pd.DataFrame({"s": [float(((fitted - b["distance"].to_numpy(float)[upper]) ** 2).sum())]})

    stress = distances.df.select("id1", "id2", "distance").mapInPandas(off, "s double").agg(F.sum("s")).first()[0]
    return Scaling(ids, x, values, shares, float(stress))


class EuclideanScaling:
    """The scaling of Euclidean distances of vectors, without the distances.

    The doubly centred matrix is X X' of the centred vectors, so its eigenvalues are
    those of X' X and the coordinates are projections.  ``ids`` and ``coordinates``
    are collected, and ``stress`` (over all pairs, in blocks) computed, when asked for.
    """

    def __init__(self, df: DataFrame, vector_col: str, k: int, threshold: float = 0.0) -> None:
        self.df, self.vector = df, vector_col
        n, s, _ = moments(df, vector_col)
        self.mean = s / n
        _, _, q = moments(df, vector_col, self.mean)
        values, vectors = np.linalg.eigh(q)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        more, k = max(0, min(k, n) - len(values)), min(k, n)
        values, vectors = np.pad(values, (0, more)), np.pad(vectors, ((0, 0), (0, more)))
        shares = values**2 / max((values**2).sum(), 1e-300)
        self.eigenvalues, self.explained = values[:k], shares[:k]
        self.loadings = vectors[:, : needed(self.explained, threshold, k)]

    def project(self, array):
        mean, loadings = self.mean, self.loadings

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(v: pd.Series) -> pd.Series:
            out, there = np.full(len(v), None, dtype=object), np.flatnonzero(v.notna())
            if len(there):
                for at, row in zip(there, (np.array(v.iloc[there].tolist(), float) - mean) @ loadings):
                    out[at] = row
            return pd.Series(out)

        return run(array)

    @cached_property
    def _rows(self) -> list:
        return self.df.where(F.col(self.vector).isNotNull()).select("id", self.project(F.col(self.vector)).alias("x")).orderBy("id").collect()

    @property
    def ids(self) -> list:
        return [r.id for r in self._rows]

    @property
    def coordinates(self) -> np.ndarray:
        return np.array([r.x for r in self._rows], float).reshape(len(self._rows), -1)

    @cached_property
    def stress(self) -> float:
        """Squared differences of fitted and given distances, of each pair once; in each task two blocks."""
        both = self.df.where(F.col(self.vector).isNotNull()).select("id", F.concat(F.col(self.vector), self.project(F.col(self.vector))).alias("both"))
        d, f = len(self.mean), euclidean(False)
        off = lambda x, y: (f(x[:, :d], y[:, :d]) - f(x[:, d:], y[:, d:])) ** 2
        return float(summaries(both, "id", "both", off, both.count()).agg(F.sum("total")).first()[0] / 2)


def largest_eigenpairs(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, seed: int = 0, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """The k largest (not largest absolute) eigenvalues of a symmetric n x n operator and their vectors.

    The block Krylov space grows until the residuals of the k pairs are within the
    tolerance of the largest absolute eigenvalue, or it is the whole space.
    """
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, k + 4))))[0]
    v, bv = np.empty((n, 0)), np.empty((n, 0))
    while True:
        image = product(block)
        v, bv = np.hstack((v, block)), np.hstack((bv, image))
        small = v.T @ bv
        values, s = np.linalg.eigh((small + small.T) / 2)
        scale = max(np.abs(values).max(), 1e-300)
        values, s = values[::-1][:k], s[:, ::-1][:, :k]
        vectors = v @ s
        if v.shape[1] >= n or np.linalg.norm(bv @ s - vectors * values, axis=0).max() <= tolerance * scale:
            return values, vectors
        for _ in range(2):
            image = image - v @ (v.T @ image)
        u, size, _ = np.linalg.svd(image, full_matrices=False)
        block = u[:, size > 1e-12 * scale][:, : n - v.shape[1]]
        block = block - v @ (v.T @ block)
        if not block.shape[1]:
            return values, vectors
        block = np.linalg.qr(block)[0]


def _additive_constant(d: np.ndarray) -> float:
    """Least constant that makes distances Euclidean: the largest eigenvalue of a 2n x 2n matrix."""
    n = len(d)
    j = np.eye(n) - 1 / n
    top = np.linalg.eigvals(np.block([[np.zeros((n, n)), 2 * j @ (-0.5 * d**2) @ j], [-np.eye(n), -4 * j @ (-0.5 * d) @ j]]))
    return float(max(0.0, top.real.max()))


class ReductionOps:
    def _vector(self, name: str) -> DataFrame:
        """The set's rows with the column as an ML vector."""
        if isinstance(self.schema[name].dataType, T.ArrayType):
            return self.df.withColumn(name, array_to_vector(self.column(name)))
        return self.df

    def _array(self, name: str):
        return self.column(name) if isinstance(self.schema[name].dataType, T.ArrayType) else vector_to_array(self.column(name))

    def add_column_scaled(self, out: str, source: str, scale: bool = True, center: bool = False):
        """Feature-wise scaling of a vector column by the sample deviation, optionally centred."""
        model = StandardScaler(inputCol=source, outputCol=out, withStd=scale, withMean=center).fit(self.df)
        return self._of(model.transform(self.df))

    def add_pca(self, out: str, source: str, k: int, threshold: float = 0.0):
        return self.add_pca_with_model(out, source, k, threshold)[0]

    def add_pca_with_model(self, out: str, source: str, k: int, threshold: float = 0.0):
        """Projection (of uncentred rows) on k components, or on as many as reach the share of variance; one fit."""
        model = PCA(k=k, inputCol=source, outputCol=out).fit(self.df)
        shares, pc = np.array(model.explainedVariance), model.pc.toArray()
        keep = needed(shares, threshold, k)
        df = model.transform(self.df)
        if keep < k:
            df = df.withColumn(out, array_to_vector(F.slice(vector_to_array(out), 1, keep)))
        return self._of(df), Components(pc[:, :keep], shares[:keep])

    def add_pca_detailed(self, out: str, source: str, correlation: bool = False, k: int | None = None, threshold: float = 0.0, cos2: str | None = None, contribution: str | None = None):
        """Components of the covariance or correlation matrix (centred projection); optionally each row's squared cosines and contributions."""
        n, s, q = moments(self.df.withColumn("pca_input", self._array(source)), "pca_input")
        mean = s / n
        cov = q / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-300)) if correlation else np.ones(len(mean))
        values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        shares = values / max(values.sum(), 1e-300)
        keep = needed(shares, threshold, min(k or len(values), len(values)))
        model = Components(vectors[:, :keep], shares[:keep], values[:keep], mean, scale)
        loadings, kept = model.loadings, values[:keep]

        def project(v: pd.Series) -> pd.DataFrame:
            z = (np.array(v.tolist(), float).reshape(len(v), -1) - mean) / scale
            x = z @ loadings
            size = (z * z).sum(1, keepdims=True)
            return pd.DataFrame({"x": list(x), "cos2": list(np.divide(x * x, size, out=np.zeros_like(x), where=size > 0)), "part": list(x * x / np.maximum(n * kept, 1e-300))})

        f = F.pandas_udf(project, T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("x", "cos2", "part")]))
        df = self.df.withColumn("pca_all", f(self._array(source))).withColumn(out, F.col("pca_all.x"))
        for name, part in ((cos2, "cos2"), (contribution, "part")):
            if name:
                df = df.withColumn(name, F.col(f"pca_all.{part}"))
        return self._of(df.drop("pca_all")), model

    def pca_correlation_circle(self, pca: str, features: str) -> DataFrame:
        """(feature, axis, corr): Pearson correlation of every feature with every component (null for a constant one), from one pass of sums."""
        row = self.df.select(F.size(self._array(pca)).alias("p")).first()
        n, s, q = moments(self.df.select(F.concat(self._array(pca), self._array(features)).alias("both")), "both")
        found, n_p = [], row.p if row else 0
        if n:
            c = q / n - np.outer(s / n, s / n)
            spread = np.sqrt(np.maximum(np.diag(c), 0.0))
            found = [(i - n_p, j, float(c[i, j] / (spread[i] * spread[j])) if spread[i] * spread[j] > 0 else None) for i in range(n_p, len(s)) for j in range(n_p)]
        return self.df.sparkSession.createDataFrame(found, "feature int, axis int, corr double")

    def add_mds(self, out: str, source: str, k: int, distance: MatrixDistance | None = None, threshold: float = 0.0, runs: int = 1, noise: float = 0.0, seed: int = 0, additive: bool = False):
        return self.add_mds_with_model(out, source, k, distance, threshold, runs, noise, seed, additive)[0]

    def add_mds_with_model(self, out: str, source: str, k: int, distance: MatrixDistance | None = None, threshold: float = 0.0, runs: int = 1, noise: float = 0.0, seed: int = 0, additive: bool = False):
        base = self.df.select("id", source).persist()
        try:
            n = base.count()
            if n > DRIVER_POINTS and distance is None and not additive:
                model = EuclideanScaling(self.df.select("id", self._array(source).alias(source)), source, k, threshold)
                return self.with_column(out, model.project(self._array(source))), model
            model = classical_scaling(DistanceSet(pairwise(base, "id", source, distance or euclidean(False), True, n), n), k, threshold, runs, noise, seed, additive)
        finally:
            base.unpersist()
        coordinates = self.df.sparkSession.createDataFrame([(i, x.tolist()) for i, x in zip(model.ids, model.coordinates)], T.StructType([T.StructField("mds_id", self.schema["id"].dataType), T.StructField(out, T.ArrayType(T.DoubleType()))]))
        return self._of(self.df.join(coordinates, self.df["id"] == coordinates["mds_id"], "left").drop("mds_id")), model


