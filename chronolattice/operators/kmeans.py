"""K-means of an array column over all rows: one pass of per-task sums for each round."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0.0)
    return d.argmin(1), d.min(1)


@dataclass
class KMeansModel:
    """Centres, and the sum of squared distances before each round."""

    centres: np.ndarray
    inertia: list[float] = field(default_factory=list)

    def assign(self, df: DataFrame, source: str, out: str) -> DataFrame:
        """``df`` with the number of the nearest centre (the first of equally near ones; null for a null array)."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(column: pd.Series) -> pd.Series:
            known = column.notna()
            labels = pd.Series([None] * len(column), dtype="Int32", index=column.index)
            if known.any():
                labels[known] = _nearest(np.array(column[known].tolist(), float), centres)[0].astype(np.int32)
            return labels

        return df.withColumn(out, nearest(F.col(source)))


@dataclass(frozen=True)
class KMeans:
    """``init``: "random" rows or "k-means++"; ``centres`` starts from given ones instead.

    What reaches the driver is one row per task and round.  Random choices hash
    the values with the seed, so they do not depend on partitions.  Null arrays are
    left out; fewer different rows than clusters give as many centres.
    """

    k: int = 2
    iterations: int = 20
    seed: int = 0
    init: str = "k-means++"
    centres: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.k < 1 or self.iterations < 0 or self.init not in ("random", "k-means++"):
            raise ValueError("k of 1 and more, no negative iterations, init random or k-means++")

    def _start(self, rows: DataFrame) -> np.ndarray:
        if self.centres is not None:
            return np.array(self.centres, float)
        order = rows.dropDuplicates(["x"]).orderBy(F.xxhash64(F.lit(self.seed), "x"))
        first = [r.x for r in order.limit(self.k if self.init == "random" else 1).collect()]
        if not first:
            raise ValueError("k-means of no rows")
        centres = np.array(first, float)
        while len(centres) < self.k:
            held = centres

            def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                best = None
                for f in frames:
                    if len(f):
                        x = np.array(f["x"].tolist(), float)
                        d = _nearest(x, held)[1]
                        wait = np.where(d > 0, -np.log(f["u"].to_numpy()) / np.maximum(d, 1e-300), np.inf)
                        j = int(wait.argmin())
                        if np.isfinite(wait[j]) and (best is None or wait[j] < best[0]):
                            best = float(wait[j]), x[j].tolist()
                if best:
                    yield pd.DataFrame({"wait": [best[0]], "x": [best[1]]})

            # The least of exponential waits whose rates are the squared distances is a draw in proportion to them.
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(len(centres)), "x"), 11) + 0.5) * F.lit(2.0**-53)
            found = rows.withColumn("u", u).select("x", "u").mapInPandas(draw, "wait double, x array<double>").orderBy("wait").first()
            if found is None:
                break
            centres = np.vstack((centres, found.x))
        return centres

    def fit(self, df: DataFrame, source: str) -> KMeansModel:
        rows = df.where(F.col(source).isNotNull()).select(F.col(source).cast("array<double>").alias("x"))
        model = KMeansModel(self._start(rows))
        for _ in range(self.iterations):
            centres = model.centres

            def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total, n, cost = np.zeros_like(centres), np.zeros(len(centres)), 0.0
                for f in frames:
                    if len(f):
                        x = np.array(f["x"].tolist(), float)
                        label, d = _nearest(x, centres)
                        np.add.at(total, label, x)
                        n += np.bincount(label, minlength=len(centres))
                        cost += float(d.sum())
                yield pd.DataFrame({"total": [total.ravel().tolist()], "n": [n.tolist()], "cost": [cost]})

            found = rows.mapInPandas(sums, "total array<double>, n array<double>, cost double").collect()
            n = np.sum([r.n for r in found], axis=0)
            total = np.sum([r.total for r in found], axis=0).reshape(centres.shape)
            model.inertia.append(float(sum(r.cost for r in found)))
            model.centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
            if np.array_equal(model.centres, centres):
                break
        return model
