"""Sources: saved sets, scenario files, wide raw tables."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolattice.functions import maps
from chronolattice.operators.base import DECORATORS, PLAN_ID, SERIES, SIMULATION_ID, TIME_FROM, TIME_STEP, TIME_TO, VARIABLE

UNIVARIATE = [TIME_FROM, TIME_TO, TIME_STEP, DECORATORS, SERIES]


def folder_files(folder: str, directories: bool = False) -> list[str]:
    """Paths in a local folder, sorted."""
    with os.scandir(folder) as entries:
        return sorted(e.path for e in entries if directories or e.is_file())


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A saved set."""
    return spark.read.parquet(folder)


def _numeric(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.IntegerType, T.LongType, T.FloatType)) and f.name not in but]


def unpivoted(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long form: keys, name, value (double)."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]))
    return df.select(*keys, cells.alias("cell")).select(*keys, "cell.name", "cell.value")


def series_rows(long: DataFrame, keys: Sequence[str], time: Column, value: Column, decorators: Column, mean_step: bool = False, tie: Column | None = None) -> DataFrame:
    """One series per key from long rows: values in time order, first and last time, step.

    The step is the first one, or the mean one.  Null values stay null values.
    """
    point = F.struct(time.cast("double").alias("t"), *([tie.alias("n")] if tie is not None else []), value.cast("double").alias("v"))
    grouped = long.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))
    at = lambda k: F.get("points", k)["t"]
    last = at(F.size("points") - 1)
    step = F.try_divide(last - at(F.lit(0)), F.size("points") - 1) if mean_step else at(F.lit(1)) - at(F.lit(0))
    return grouped.select(*keys, at(F.lit(0)).alias(TIME_FROM), last.alias(TIME_TO), step.alias(TIME_STEP), decorators.alias(DECORATORS), F.transform("points", lambda p: p["v"]).alias(SERIES))


def build(df: DataFrame, decorators: Mapping[str, str] | None = None, time: str = "time") -> DataFrame:
    """One series per numeric column (the time too) of a wide table; the mean step."""
    long = unpivoted(df.withColumn("build_time", F.col(f"`{time}`").cast("double")), ["build_time"], _numeric(df))
    fixed = [e for k, v in (decorators or {}).items() for e in (F.lit(k), F.lit(v))]
    rows = series_rows(long, ["name"], F.col("build_time"), F.col("value"), F.create_map(*fixed, F.lit(VARIABLE), F.col("name")), mean_step=True)
    return rows.select(*UNIVARIATE)


def transposed(df: DataFrame, time: str = "time") -> DataFrame:
    """(name, values) of the numeric columns, values in time order."""
    return build(df, {}, time).select(F.element_at(DECORATORS, VARIABLE).alias("name"), F.col(SERIES).alias("values"))


def _scenario_rows(spark: SparkSession, paths: str | list[str], format: str) -> DataFrame:
    return spark.read.format(format).options(inferSchema=True, sep="\t", header=True, nullValue="null").load(paths).where("time > 0")


def read_scenario(spark: SparkSession, path: str, format: str = "csv", decorators: Mapping[str, str] | None = None) -> DataFrame:
    """One tab-separated file: header, ``null`` for null, rows of time 0 or less left out."""
    return build(_scenario_rows(spark, path, format), decorators)


def read_scenarios(spark: SparkSession, paths: Sequence[str], format: str = "csv", scenario_pattern: str = r"^[^_]*_([^_.]*)", decorators: Mapping[str, str] | None = None) -> DataFrame:
    """Several files in one read; the scenario id is the pattern's group in the file's name."""
    raw = _scenario_rows(spark, list(paths), format)
    numeric = _numeric(raw)
    raw = raw.withColumn("scenario", F.regexp_extract(F.col("_metadata.file_name"), scenario_pattern, 1)).withColumn("build_time", F.col("time").cast("double"))
    long = unpivoted(raw, ["scenario", "build_time"], numeric)
    fixed = [e for k, v in (decorators or {}).items() for e in (F.lit(k), F.lit(v))]
    rows = series_rows(long, ["scenario", "name"], F.col("build_time"), F.col("value"), F.create_map(*fixed, F.lit(SIMULATION_ID), F.col("scenario"), F.lit(VARIABLE), F.col("name")), mean_step=True)
    return rows.select(*UNIVARIATE)


def read_scenario_folder(spark: SparkSession, folder: str, format: str = "csv", decorators: Mapping[str, str] | None = None, most: int | None = None) -> DataFrame:
    """All files of a folder, or the first ``most`` by name."""
    files = folder_files(folder)
    return read_scenarios(spark, files[:most] if most is not None else files, format, decorators=decorators)


def read_wide(raw: DataFrame, metadata: DataFrame | None = None, warnings: DataFrame | None = None, variables: Sequence[str] | None = None, scenario: str = "scenarioId", plan: str = "simulationPlanId", time: str = "time", metadata_id: str = "_id", warnings_id: str = "scenario_id") -> DataFrame:
    """One series per scenario and variable of a wide table, with metadata and (wide) warnings as decorators."""
    names = list(variables or _numeric(raw, (scenario, plan, time)))
    keyed = raw.select(F.col(scenario).cast("string").alias("s"), F.col(plan).cast("string").alias("p"), F.col(time).cast("double").alias("t"), *[F.col(f"`{n}`") for n in names])
    long = unpivoted(keyed, ["s", "p", "t"], names)
    decorators = F.create_map(F.lit(SIMULATION_ID), F.col("s"), F.lit(PLAN_ID), F.col("p"), F.lit(VARIABLE), F.col("name"))
    rows = series_rows(long, ["s", "p", "name"], F.col("t"), F.col("value"), decorators)
    for table, key in ((metadata, metadata_id), (warnings, warnings_id)):
        if table is not None:
            others = [c for c in table.columns if c != key]
            entries = F.create_map(*[e for c in others for e in (F.lit(c.replace(".", "::")), F.col(f"`{c}`").cast("string"))])
            more = table.select(F.col(key).cast("string").alias("k"), F.map_filter(entries, lambda _, v: v.isNotNull()).alias("m"))
            rows = rows.join(more, rows["s"] == more["k"], "left").withColumn(DECORATORS, maps.merged(F.col(DECORATORS), F.col("m"))).drop("k", "m")
    return rows.select(*UNIVARIATE)


def from_points(df: DataFrame, simulation: str = "simulation", variable: str = "variable", times: str = "times", values: str = "values") -> DataFrame:
    """Series from rows (simulation, variable, times, values); the first step."""
    t = F.col(times)
    return df.select(
        F.get(t, F.lit(0)).alias(TIME_FROM), F.get(t, F.size(t) - 1).alias(TIME_TO), (F.get(t, F.lit(1)) - F.get(t, F.lit(0))).alias(TIME_STEP),
        F.create_map(F.lit(SIMULATION_ID), F.col(simulation).cast("string"), F.lit(VARIABLE), F.col(variable).cast("string")).alias(DECORATORS), F.col(values).alias(SERIES),
    )


def read_sparse_text(spark: SparkSession, path: str) -> DataFrame:
    """(line, values) of a text file of ``"k:v;k:v"`` lines under a header; the values in order."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("line > 0 and length(value) > 1")
    body = F.expr("substring(value, 2, length(value) - 2)")
    return lines.select("line", F.transform(F.split(body, ";"), lambda p: F.element_at(F.split(p, ":"), -1).cast("double")).alias("values"))


def events_as_series(events: DataFrame) -> DataFrame:
    """Series of an event table: one per user and event type, in time order."""
    rows = series_rows(events, ["user_id", "event_type"], F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6), F.col("value"), F.create_map(F.lit(SIMULATION_ID), F.col("user_id").cast("string"), F.lit(VARIABLE), F.col("event_type")), tie=F.col("event_id"))
    return rows.select(*UNIVARIATE)
