"""Sinks: parquet, flat CSV, small driver files, co-clustering results."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "error"


def save(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    df.write.option("compression", "gzip").mode(_mode(overwrite)).parquet(folder)


def flattened(df: DataFrame, map_keys: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Columns that CSV can hold: arrays joined by ``;`` (inner ones by ``:``), maps as a column per key."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            keys = (map_keys or {}).get(f.name)
            if keys is None:
                keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(c))).distinct().collect())
            out += [F.element_at(c, k).cast("string").alias(f"{f.name}_{k}") for k in keys]
        elif isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            one = (lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ":")) if isinstance(inner, T.ArrayType) else (lambda x: x.cast("string"))
            out.append(F.array_join(F.transform(c, one), ";").alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(*out)


def save_csv(df: DataFrame, path: str, header: bool = True, overwrite: bool = False) -> None:
    flattened(df).write.mode(_mode(overwrite)).csv(path, header=header)


def write_rows(path: str, header: Sequence[str] | None, rows: Iterable[Sequence], append: bool = False) -> None:
    """A small local CSV file."""
    with open(path, "a" if append else "w", newline="") as f:
        w = csv.writer(f)
        if header:
            w.writerow(header)
        w.writerows(rows)


def with_serial(rows: Iterable[Sequence]) -> list[list]:
    """Rows with a serial number from 1 in front."""
    return [[k, *r] for k, r in enumerate(rows, 1)]


def write_matrix(path: str, matrix: Sequence[Sequence], with_header: bool = True) -> None:
    """Header ``id,0,1,..`` (unless left out) and numbered rows; strings, integers or floats."""
    rows = [list(r) for r in matrix]
    write_rows(path, ["id", *range(len(rows[0]))] if with_header and rows else None, with_serial(rows))


def _joined(values) -> str:
    return ":".join(map(repr, map(float, values)))


def write_model(model, path: str) -> None:
    """A line for each block: clusters, proportions, mean, covariance, and the axes and centre of functional models."""
    header = ["id", "rowCluster", "colCluster", "rowProportion", "colProportion", "meanListDV", "cov", *(["loadings", "centerings"] if model.functional else [])]
    rows = []
    for c, size in enumerate(model.sizes):
        for k in range(size):
            row = [len(rows), k, c, float(model.row_props[c, k]), float(model.col_props[c]), _joined(model.means[c, k]), _joined(model.covariances[c, k].ravel())]
            rows.append(row + ([_joined(model.loadings[c][k].ravel()), _joined(model.means[c, k])] if model.functional else []))
    write_rows(path, header, rows)


def coclustering_cells(result, grouped: DataFrame, key: str, source: str, series: str | None = None) -> DataFrame:
    """(rowId, var, rowCluster, colCluster, vector[, series]) of every cell."""
    columns = F.array(*[F.lit(int(c)) for c in result.col_partition])
    base = grouped.select(F.xxhash64(F.col(key), F.col(source)).alias("rid"), F.col(key).cast("string").alias("rowId"), F.posexplode(source).alias("var", "vector"), *([F.col(series).alias("all_series")] if series else []))
    labelled = base.join(result.row_labels.dropDuplicates(["rid"]), "rid").withColumn("colCluster", F.get(columns, F.col("var")))
    cells = labelled.select("rowId", "var", F.get("labels", F.col("colCluster")).alias("rowCluster"), "colCluster", F.array_join(F.transform("vector", lambda x: x.cast("string")), ":").alias("vector"), *([F.array_join(F.transform(F.get("all_series", F.col("var")), lambda x: x.cast("string")), ":").alias("series")] if series else []))
    return cells


def write_coclustering(result, grouped: DataFrame, key: str, source: str, folder: str, series: str | None = None) -> None:
    """``model.csv`` beside a folder ``dataAndCluster`` of the cells."""
    import os

    os.makedirs(folder, exist_ok=True)
    write_model(result.model, os.path.join(folder, "model.csv"))
    coclustering_cells(result, grouped, key, source, series).write.mode("overwrite").csv(os.path.join(folder, "dataAndCluster"))
