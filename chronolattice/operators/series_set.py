"""The fluent series set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from chronolattice.sources import readers, writers

from .aggregation import AggregationOps
from .base import Relational
from .clustering import ClusteringOps
from .coclustering.ops import CoClusteringOps
from .distances import DistanceOps
from .evaluation import EvaluationOps
from .reduction import ReductionOps
from .series import SeriesOps


class SeriesSet(Relational, SeriesOps, AggregationOps, DistanceOps, ReductionOps, ClusteringOps, EvaluationOps, CoClusteringOps):
    """Series, one per row, with every operation of the engine as a method that returns a new set."""

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SeriesSet:
        return cls(readers.load(spark, folder))

    @classmethod
    def build(cls, df: DataFrame, decorators: Mapping[str, str] | None = None, time: str = "time") -> SeriesSet:
        return cls(readers.build(df, decorators, time))

    @classmethod
    def read_scenario(cls, spark: SparkSession, path: str, format: str = "csv", decorators: Mapping[str, str] | None = None) -> SeriesSet:
        return cls(readers.read_scenario(spark, path, format, decorators))

    @classmethod
    def read_scenarios(cls, spark: SparkSession, paths: Sequence[str], format: str = "csv", **options) -> SeriesSet:
        return cls(readers.read_scenarios(spark, paths, format, **options))

    @classmethod
    def read_scenario_folder(cls, spark: SparkSession, folder: str, format: str = "csv", **options) -> SeriesSet:
        return cls(readers.read_scenario_folder(spark, folder, format, **options))

    @classmethod
    def read_wide(cls, raw: DataFrame, **options) -> SeriesSet:
        return cls(readers.read_wide(raw, **options))

    @classmethod
    def from_points(cls, df: DataFrame, **options) -> SeriesSet:
        return cls(readers.from_points(df, **options))

    @classmethod
    def from_events(cls, events: DataFrame) -> SeriesSet:
        return cls(readers.events_as_series(events))

    def save(self, folder: str, overwrite: bool = False) -> None:
        writers.save(self.df, folder, overwrite)

    def save_csv(self, path: str, header: bool = True, overwrite: bool = False) -> None:
        writers.save_csv(self.df, path, header, overwrite)
