"""Seeded synthetic block data: series for every (observation, feature), a prototype per block plus Gaussian noise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Prototype = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def sine(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return 1 + 0.5 * np.sin(4 * np.pi * t)


def sigmoid(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Its centre and height are drawn anew for every series."""
    centre, height = rng.normal(0.6, 0.02), rng.normal(1, 0.02)
    return height / (1 + np.exp(-20 * (t - centre)))


def rectangle(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return ((t >= 0.3) & (t < 0.6)).astype(float)


def morlet(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    u = 10 * (t - 0.5)
    return np.exp(-(u**2) / 2) * np.cos(5 * u)


def gaussian(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return 1.5 * np.exp(-((t - 0.5) ** 2) / (2 * 0.1**2))


def double_gaussian(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.exp(-((t - 0.2) ** 2) / (2 * 0.1**2)) + np.exp(-((t - 0.7) ** 2) / (2 * 0.1**2))


def shifted_sine(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return 0.3 + 0.3 * np.sin(2 * np.pi * t)


def sine_rectangle(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    wave = 0.5 * np.sin(2 * np.pi * t)
    return np.where((t >= 0.3) & (t < 0.6), 2 + wave, -1 + wave)


PROTOTYPES: dict[str, Prototype] = {f.__name__: f for f in (sine, sigmoid, rectangle, morlet, gaussian, double_gaussian, shifted_sine, sine_rectangle)}

_SCHEMA = "timeFrom double, timeTo double, timeGranularity double, decorators map<string,string>, series array<double>, id long, trueFeatureCluster int, trueSeriesCluster int"


def conditional_clusters(spark: SparkSession, prototypes: Sequence[Sequence[Prototype | str]], variance: float, rows: Sequence[Sequence[int]], columns: Sequence[int], mixing: float = 0.0, length: int = 100, seed: int = 0) -> DataFrame:
    """``prototypes[l][k]`` for column cluster l and its row cluster k; ``rows[l]`` are the sizes of l's row clusters.

    With probability ``mixing`` a cell comes from block (l + 1, k + 1) instead.
    """
    chosen = [[PROTOTYPES[p] if isinstance(p, str) else p for p in row] for row in prototypes]
    labels = [np.repeat(np.arange(len(r)), r) for r in rows]
    n, features = len(labels[0]), np.repeat(np.arange(len(columns)), columns)
    if any(len(x) != n for x in labels):
        raise ValueError("row clusters of different column clusters differ in total size")
    p = len(features)

    def run(frames):
        t = (np.arange(length) + 1) / length
        for f in frames:
            out = []
            for cell in f["id"]:
                i, j = divmod(int(cell), p)
                rng = np.random.default_rng((seed, i, j))
                c, k = int(features[j]), int(labels[features[j]][i])
                a, b = c, k
                if rng.random() < mixing:
                    a = (c + 1) % len(chosen)
                    b = (k + 1) % len(chosen[a])
                x = chosen[a][b](t, rng) + rng.normal(0, np.sqrt(variance), length)
                out.append((t[0], t[-1], 1.0 / length, {"simulationId": str(i), "varName": str(j)}, x.tolist(), int(cell), c, k))
            yield pd.DataFrame(out, columns=["timeFrom", "timeTo", "timeGranularity", "decorators", "series", "id", "trueFeatureCluster", "trueSeriesCluster"])

    return spark.range(n * p).mapInPandas(run, _SCHEMA)


def clusters(spark: SparkSession, prototypes: Sequence[Sequence[Prototype | str]], variance: float, rows: Sequence[int], columns: Sequence[int], mixing: float = 0.0, length: int = 100, seed: int = 0) -> DataFrame:
    """The same with one partition of the rows."""
    return conditional_clusters(spark, prototypes, variance, [list(rows)] * len(columns), columns, mixing, length, seed)
