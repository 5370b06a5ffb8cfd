"""Estimation by SEM-Gibbs or variational EM, over Spark or, for small data, in one process."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolattice.functions.probability import log_sum_exp

from .model import BlockModel, averaged, icl, maximised, random_sums, row_log_weights, row_weights, sums_of, sweep

#: Rows up to which the data are worked on in the driver process, by the same kernel.
LOCAL_ROWS = 20_000


def row_id(key: Column, cells: Column) -> Column:
    """A number for each row from its key, of any type, and its cells: repeated keys of different cells differ."""
    return F.xxhash64(key, cells)


class ConvergenceError(RuntimeError):
    """No start led to a model without empty clusters."""


class Matrix:
    """Rows (rid, cells: array<array<double>>) of equal shape."""

    def __init__(self, df: DataFrame, rid: str = "rid", cells: str = "cells") -> None:
        self.df = df.select(F.col(rid).cast("long").alias("rid"), F.col(cells).alias("cells")).persist()
        self.n = self.df.count()
        first = self.df.first()
        if first is None:
            raise ValueError("co-clustering of no rows")
        self.p, self.d = len(first.cells), len(first.cells[0])
        self.local = None
        if self.n <= LOCAL_ROWS:
            rows = self.df.orderBy("rid").collect()
            self.local = np.array([r.rid for r in rows]), np.array([r.cells for r in rows], float)

    def close(self) -> None:
        self.df.unpersist()

    @staticmethod
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for f in frames:
            if len(f):
                yield f["rid"].to_numpy(), np.array([[list(c) for c in row] for row in f["cells"]], float)

    def total(self, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """Sums of ``kernel(cells, ids)`` over all rows: one row per task reaches the driver."""
        if self.local is not None:
            return kernel(self.local[1], self.local[0])

        def run(frames):
            held = None
            for ids, x in Matrix.batches(frames):
                got = kernel(x, ids)
                held = got if held is None else {k: held[k] + v for k, v in got.items()}
            if held is not None:
                yield pd.DataFrame({"sums": [pickle.dumps(held)]})

        out: dict[str, np.ndarray] = {}
        for row in self.df.mapInPandas(run, "sums binary").toLocalIterator():
            for k, v in pickle.loads(bytes(row.sums)).items():
                out[k] = out[k] + v if k in out else v
        return out

    def row_labels(self, model: BlockModel, columns: np.ndarray) -> DataFrame:
        """(rid, labels): the rows' most likely cluster in each column cluster."""

        def run(frames):
            for ids, x in Matrix.batches(frames):
                t = row_weights(row_log_weights(model, model.log_density(x), columns), ids, "best", ())
                yield pd.DataFrame({"rid": ids, "labels": t.argmax(2).astype(np.int32).tolist()})

        return self.df.mapInPandas(run, "rid long, labels array<int>")


@dataclass
class CoClustering:
    """What an estimation returns. Row labels are a DataFrame (rid, labels: one per column cluster)."""

    model: BlockModel
    row_labels: DataFrame
    col_partition: np.ndarray
    log_likelihood: list[float]
    icl: list[float]
    converged: bool


@dataclass(frozen=True)
class BlockEstimator:
    """``sizes``: (K,) * L row clusters per column cluster; equal ones in the plain model."""

    sizes: tuple[int, ...] = (2, 2)
    conditional: bool = False
    functional: bool = False
    max_iterations: int = 10
    burn_in: int = 10
    full_covariance: bool = True
    tolerance: float = 1e-2
    seed: int = 0
    max_axes: int = 5
    #: Iteration after which the functional variants refresh their axes: "always", "never" or a number.
    refresh_loadings: int | str = "always"
    sweeps: int = 3
    ridge: float = 0.0
    initial_model: BlockModel | None = None
    initial_columns: np.ndarray | None = None
    #: The likelihood as the sum of densities only, and the penalty of the conditional model times L.
    literal: bool = False

    @classmethod
    def plain(cls, k: int = 2, l: int = 2, **options) -> BlockEstimator:  # noqa: E741
        return cls(sizes=(k,) * l, **options)

    @classmethod
    def conditional_on(cls, sizes: tuple[int, ...] = (2, 2), **options) -> BlockEstimator:
        return cls(sizes=tuple(sizes), conditional=True, **options)

    @classmethod
    def functional_plain(cls, k: int = 1, l: int = 1, **options) -> BlockEstimator:  # noqa: E741
        return cls(sizes=(k,) * l, functional=True, **({"max_iterations": 20, "burn_in": 20} | options))

    @classmethod
    def functional_conditional(cls, sizes: tuple[int, ...] = (1,), **options) -> BlockEstimator:
        return cls(sizes=tuple(sizes), conditional=True, functional=True, **({"tolerance": 1e-3, "refresh_loadings": 5} | options))

    def __post_init__(self) -> None:
        if not self.sizes or min(self.sizes) < 1 or self.max_iterations < 1 or self.burn_in < 0:
            raise ValueError("cluster and iteration counts must be positive, burn-in not negative")
        if not self.conditional and len(set(self.sizes)) > 1:
            raise ValueError("the plain model has one number of row clusters")

    def _refresh(self, iteration: int) -> bool:
        after = {"always": 0, "never": float("inf")}.get(self.refresh_loadings, self.refresh_loadings)
        return iteration >= after

    def _maximised(self, sums, columns, old, iteration, soft=False) -> BlockModel:
        return maximised(sums, columns, list(self.sizes), self.conditional, self.full_covariance, self.max_axes if self.functional else None, old, self._refresh(iteration), soft, self.ridge)

    def _draw_columns(self, model: BlockModel, cols: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        with np.errstate(divide="ignore"):
            logs = cols + np.log(model.col_props)
        p = np.exp(logs - log_sum_exp(logs, axis=1)[:, None])
        pick = np.minimum((p.cumsum(1) < rng.random(len(p))[:, None]).sum(1), p.shape[1] - 1)
        return np.eye(p.shape[1])[pick]

    def _start(self, data: Matrix, init: str, rng: np.random.Generator, seed: int) -> tuple[BlockModel, np.ndarray]:
        n_cols, init = len(self.sizes), init.lower()
        if init not in ("randompartition", "kmeans", "funlbm"):
            raise ValueError(f"no start {init}: randomPartition, kmeans or FunLBM")
        if init == "funlbm" and self.initial_columns is None:
            return self._functional_start(data, seed)
        if self.initial_columns is not None:
            columns = np.eye(n_cols)[np.asarray(self.initial_columns)]
        elif init == "kmeans":
            return self._kmeans_start(data, rng)
        else:
            columns = np.eye(n_cols)[rng.permutation(np.arange(data.p) % n_cols)]
        if self.initial_model is not None:
            return self.initial_model, columns
        sizes, conditional = list(self.sizes), self.conditional
        return self._maximised(data.total(lambda x, ids: random_sums(x, ids, sizes, conditional, columns, (seed, 0))), columns, None, 0), columns

    def _functional_start(self, data: Matrix, seed: int) -> tuple[BlockModel, np.ndarray]:
        """From a plain functional model of as many column clusters, each with the most row clusters asked for."""
        plain = BlockEstimator.functional_plain(max(self.sizes), len(self.sizes), seed=seed, max_iterations=self.max_iterations, burn_in=self.burn_in, ridge=self.ridge)
        found = plain.run(data)
        model, columns = found.model, np.eye(len(self.sizes))[found.col_partition]
        most, sizes, conditional = max(self.sizes), np.array(self.sizes), self.conditional

        def sums(x: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
            labels = row_weights(row_log_weights(model, model.log_density(x), columns), ids, "best", ()).argmax(2)
            return sums_of(x, np.eye(most)[(labels % sizes) if conditional else labels], columns)

        return self._maximised(data.total(sums), columns, None, 0), columns

    def _kmeans_start(self, data: Matrix, rng: np.random.Generator, most: int = 2000) -> tuple[BlockModel, np.ndarray]:
        """K-means of the columns, then of the rows in each column cluster, on a bounded sample of rows."""
        rows = data.df.orderBy(F.xxhash64(F.lit(int(rng.integers(1 << 30))), "rid")).limit(most).collect()
        x = np.array([r.cells for r in rows], float)
        col_labels = _lloyd(x.transpose(1, 0, 2).reshape(data.p, -1), len(self.sizes), rng)
        labels = []
        for c, k in enumerate(self.sizes):
            own = x[:, col_labels == c] if self.conditional else x
            labels.append(_lloyd(own.reshape(len(x), -1), k, rng) if self.conditional or c == 0 else labels[0])
        columns = np.eye(len(self.sizes))[col_labels]
        return self._maximised(sums_of(x, np.eye(max(self.sizes))[np.stack(labels, axis=1)], columns), columns, None, 0), columns

    def _likelihood(self, sums: dict, columns: np.ndarray, model: BlockModel) -> float:
        if self.literal:
            return float(sums["densities"])
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(model.col_props > 0, np.log(model.col_props), 0.0)
        return float(sums["ll"] + (columns * logs).sum())

    def _sem(self, data: Matrix, init: str, seed: int) -> tuple:
        rng = np.random.default_rng(seed)
        model, columns = self._start(data, init, rng, seed)
        lls, models, partitions, converged = [], [], [], False
        for it in range(self.burn_in + self.max_iterations):
            for s in range(self.sweeps):
                got = data.total(lambda x, ids, m=model, c=columns, k=(seed, it, s): sweep(x, ids, m, c, "sample", k))
                columns = self._draw_columns(model, got["cols"], rng)
            got = data.total(lambda x, ids, m=model, c=columns, k=(seed, it, self.sweeps): sweep(x, ids, m, c, "sample", k))
            model = self._maximised(got, columns, model, it)
            lls.append(self._likelihood(data.total(lambda x, ids, m=model, c=columns: sweep(x, ids, m, c, "best")), columns, model))
            models.append(model)
            partitions.append(columns)
            if len(lls) > 2 and all(abs(lls[-1] - lls[-1 - k]) < self.tolerance for k in (1, 2)):
                converged = True
                break
        if not converged and len(models) > self.burn_in + 1 and all((partitions[-1] == p).all() for p in partitions[self.burn_in :]):
            model = averaged(models[self.burn_in :])
            lls.append(self._likelihood(data.total(lambda x, ids: sweep(x, ids, model, columns, "best")), columns, model))
        return model, columns, lls, converged

    def _variational(self, data: Matrix, init: str, seed: int) -> tuple:
        if self.conditional or self.functional:
            raise ValueError("variational EM is for the plain model")
        rng = np.random.default_rng(seed)
        model, columns = self._start(data, init, rng, seed)
        columns = np.maximum(columns, 1e-8)
        columns /= columns.sum(1, keepdims=True)
        lls, converged = [], False
        for it in range(self.burn_in + self.max_iterations):
            for _ in range(self.sweeps):
                got = data.total(lambda x, ids, m=model, c=columns: sweep(x, ids, m, c, "soft"))
                logs = got["cols"] + np.log(np.maximum(model.col_props, 1e-300))
                columns = np.exp(logs - log_sum_exp(logs, axis=1)[:, None])
            got = data.total(lambda x, ids, m=model, c=columns: sweep(x, ids, m, c, "soft"))
            model = self._maximised(got, columns, model, it, soft=True)
            got = data.total(lambda x, ids, m=model, c=columns: sweep(x, ids, m, c, "soft"))
            lls.append(self._likelihood(got, columns, model) - float((columns * np.log(np.maximum(columns, 1e-300))).sum()))
            if len(lls) > 2 and all(abs(lls[-1] - lls[-1 - k]) < self.tolerance for k in (1, 2)):
                converged = True
                break
        return model, np.eye(columns.shape[1])[columns.argmax(1)], lls, converged

    def run(self, data: Matrix | DataFrame, method: str = "SEMGibbs", init: str = "randomPartition", runs: int = 1, tries: int = 10, rid: str = "rid", cells: str = "cells") -> CoClustering:
        """The best of ``runs`` starts by last log-likelihood; a start with empty clusters is tried anew up to ``tries`` times."""
        step = {"SEMGibbs": self._sem, "VariationalEM": self._variational}[method]
        matrix = data if isinstance(data, Matrix) else Matrix(data, rid, cells)
        best = None
        for r in range(runs):
            for t in range(tries):
                try:
                    got = step(matrix, init, self.seed + 1000 * r + t)
                except np.linalg.LinAlgError:
                    continue
                if best is None or got[2][-1] > best[2][-1]:
                    best = got
                break
        if best is None:
            raise ConvergenceError(f"no start of {runs} x {tries} kept all clusters filled")
        model, columns, lls, converged = best
        criteria = [icl(model, x, matrix.n, matrix.p, self.literal) for x in lls]
        return CoClustering(model, matrix.row_labels(model, columns), columns.argmax(1), lls, criteria, converged)

    def with_sizes(self, *sizes: int) -> BlockEstimator:
        return replace(self, sizes=tuple(sizes))


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """K-means++ and Lloyd's algorithm on a small matrix; labels."""
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(rounds):
        labels = np.array([((x - m) ** 2).sum(1) for m in c]).argmin(0)
        c = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
    return labels
