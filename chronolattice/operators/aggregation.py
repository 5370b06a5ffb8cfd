"""Grouping into multivariate rows, column statistics, decorators and contingency tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolattice.functions import arrays, maps

from .base import DECORATORS, GROUP_KEY, IN_GROUP_KEY, SIMULATION_ID, SIMULATION_NAME


def barycenters(df: DataFrame, coordinates: str, cluster: str) -> DataFrame:
    """cluster, barycenter: element-wise mean of the members' vectors, summed map-side per element."""
    each = df.select(F.col(cluster).alias("cluster"), F.posexplode(coordinates).alias("place", "value"))
    means = each.groupBy("cluster", "place").agg(F.avg("value").alias("mean"))
    return means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("all")).select("cluster", F.transform("all", lambda x: x["mean"]).alias("barycenter"))


class AggregationOps:
    def decorator(self, name: str) -> Column:
        return F.element_at(self.df[DECORATORS], name)

    def group(self, key: Column | str, in_key: Column | str):
        """One row per key: every column becomes an array in the order of the in-group key, compared as text.

        The key and the ordering keys are ``gkey`` and ``inGKey``; ids are new.
        """
        key = self.resolved(key) if isinstance(key, str) else key
        in_key = self.resolved(in_key) if isinstance(in_key, str) else in_key
        names = [c for c in self.df.columns if c not in (GROUP_KEY, IN_GROUP_KEY)]
        rows = self.df.select(key.alias(GROUP_KEY), F.struct(in_key.cast("string").alias("k"), F.monotonically_increasing_id().alias("n"), F.struct(*[self.column(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row")).alias("member"))
        # Maps cannot be compared: members are sorted by key and input order alone.
        sorted_ = rows.groupBy(GROUP_KEY).agg(F.collect_list("member").alias("members")).withColumn("members", F.array_sort("members", lambda a, b: F.when((a["k"] < b["k"]) | (a["k"].isNotNull() & b["k"].isNull()), -1).when((a["k"] > b["k"]) | (a["k"].isNull() & b["k"].isNotNull()), 1).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)))
        field = lambda i: lambda m: m["row"][f"c{i}"]
        out = [F.transform("members", field(i)).alias(c) for i, c in enumerate(names)]
        return self._of(sorted_.select(GROUP_KEY, F.transform("members", lambda m: m["k"]).alias(IN_GROUP_KEY), *out), True)

    def map_decorator_groups(self, names: Sequence[str], function: Callable, schema: str) -> DataFrame:
        """``function`` (pandas DataFrame -> pandas DataFrame) of the rows of each tuple of decorator values."""
        keyed = self.df
        for n in names:
            keyed = keyed.withColumn(f"group_{n}", self.decorator(n))
        return keyed.groupBy(*[f"group_{n}" for n in names]).applyInPandas(function, schema)

    def mean_by_decorators(self, names: Sequence[str], column: str) -> DataFrame:
        return self.df.groupBy(*[self.decorator(n).alias(n) for n in names]).agg(F.avg(self.column(column)).alias("mean"))

    def aggregate_by_key(self, key: Column, value: Column, zero, add: Callable, combine: Callable):
        """Generic fold per key (partial in each task, then across): an RDD of (key, result)."""
        rows = self.df.select(key.alias("k"), value.alias("v")).rdd.map(lambda r: (r.k, r.v))
        return rows.aggregateByKey(zero, add, combine)

    def aggregate_by_key_then_map(self, key: Column, value: Column, zero, add: Callable, combine: Callable, finish: Callable):
        return self.aggregate_by_key(key, value, zero, add, combine).mapValues(finish)

    def mean_by_key(self, key: Column, value: Column) -> DataFrame:
        return self.df.groupBy(key.alias("key")).agg(F.avg(value).alias("mean"))

    def column_mean(self, column: str) -> float | None:
        return self.df.agg(F.avg(self.column(column))).first()[0]

    def column_deviation(self, column: str) -> float | None:
        """Sample standard deviation."""
        return self.df.agg(F.stddev_samp(self.column(column))).first()[0]

    def column_quantiles(self, column: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75), error: float = 0.0) -> list[float]:
        """Quantiles that are values of the column; exact for error 0."""
        return self.df.approxQuantile(column, list(quantiles), error)

    def first_steps(self, column: str) -> DataFrame:
        """Per row the second element less the first."""
        return self.df.select(arrays.first_step(self.column(column)).alias("step"))

    def series_length(self, column: str) -> int | None:
        row = self.df.select(F.size(self.column(column))).first()
        return row[0] if row else None

    def to_matrix(self, column: str, order: str = "id") -> np.ndarray:
        """An array column on the driver, rows in the order of ``order``; for small sets."""
        return np.array([r[0] for r in self.df.orderBy(order).select(self.column(column)).collect()], float)

    def map_keys(self, column: str) -> list[str]:
        return sorted(r[0] for r in self.df.select(F.explode(F.map_keys(self.column(column)))).distinct().collect())

    def decorator_names(self) -> list[str]:
        return self.map_keys(DECORATORS)

    def decorator_domain(self, name: str) -> list[str]:
        """Different values of a decorator."""
        return sorted(r[0] for r in self.df.select(self.decorator(name).alias("v")).where("v is not null").distinct().collect())

    def add_warning_decorators(self, warnings: DataFrame, scenario: str = "scenario_id", name: str = "scenario_name", warning: str = "warning_name", indicator: str = "indicator_name", value: str = "value"):
        """Decorators ``warning::indicator`` -> value and the scenario's name, from a long table of warnings."""
        items = F.array_sort(F.collect_list(F.concat_ws("::", warning, indicator, F.col(value).cast("string"))))
        per = warnings.groupBy(F.col(scenario).cast("string").alias("w_scenario")).agg(F.min(name).alias("w_name"), items.alias("w_items"))
        joined = self.df.join(per, self.decorator(SIMULATION_ID) == per["w_scenario"], "left")
        named = F.when(F.col("w_name").isNotNull(), F.create_map(F.lit(SIMULATION_NAME), F.col("w_name").cast("string")))
        out = joined.withColumn(DECORATORS, maps.with_warnings(maps.merged(F.col(DECORATORS), named), F.col("w_items")))
        return self._of(out.drop("w_scenario", "w_name", "w_items"))

    def add_metadata_decorators(self, metadata: DataFrame, left: Column, right: str, names: Sequence[str] | None = None):
        """Columns of ``metadata`` as decorators; rows without a match keep theirs."""
        names = list(names or [c for c in metadata.columns if c != right])
        packed = metadata.select(F.col(right).cast("string").alias("m_key"), maps.map_of(names).alias("m_map"))
        joined = self.df.join(packed, left.cast("string") == packed["m_key"], "left")
        return self._of(joined.withColumn(DECORATORS, maps.merged(F.col(DECORATORS), F.col("m_map"))).drop("m_key", "m_map"))

    def add_metadata_text_decorators(self, metadata: DataFrame, id_column: str = "Test Case "):
        """The older form: metadata travel as ``k::v##k::v`` text, joined on the simulation id."""
        names = [c for c in metadata.columns if c != id_column]
        text = F.concat_ws("##", *[F.concat_ws("::", F.lit(c), F.col(f"`{c}`").cast("string")) for c in names])
        packed = metadata.select(F.col(f"`{id_column}`").cast("string").alias("m_key"), text.alias("m_text"))
        joined = self.df.join(packed, self.decorator(SIMULATION_ID) == packed["m_key"], "left")
        return self._of(joined.withColumn(DECORATORS, maps.with_metadata(F.col(DECORATORS), F.col("m_text"))).drop("m_key", "m_text"))

    def contingency_map_scalar(self, out_key: str, out_value: str, out_scalar: str, out_count: str, map_column: str, scalar: str) -> DataFrame:
        each = self.df.select(F.explode(self.column(map_column)).alias(out_key, out_value), self.column(scalar).alias(out_scalar))
        return each.groupBy(out_key, out_value, out_scalar).agg(F.count(F.lit(1)).alias(out_count))

    def contingency_scalars(self, out_a: str, out_b: str, out_count: str, a: str, b: str) -> DataFrame:
        return self.df.groupBy(self.column(a).alias(out_a), self.column(b).alias(out_b)).agg(F.count(F.lit(1)).alias(out_count))

    def contingency_maps(self, out: Sequence[str], out_count: str, a: str, b: str) -> DataFrame:
        """Counts of (key of a, value of a, key of b, value of b)."""
        each = self.df.select(F.explode(self.column(a)).alias(out[0], out[1]), self.column(b).alias("other")).select(out[0], out[1], F.explode("other").alias(out[2], out[3]))
        return each.groupBy(*out).agg(F.count(F.lit(1)).alias(out_count))

    def clustering_barycenters(self, coordinates: str, cluster: str) -> DataFrame:
        return barycenters(self.df, coordinates, cluster)
