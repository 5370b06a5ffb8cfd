"""Forms of a co-clustered matrix as DataFrames: cells, rows, columns, labels and memberships, and how one becomes another.

Cells are rows (row, column, value); labels of rows and columns are tables of their
own, or, in the conditional model, one array of labels per row, a label for each
column cluster.  Joins with labels are left to Spark's size checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gathered(cells: DataFrame, key: str, order: str, out: str) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("value"))))
    return cells.groupBy(key).agg(held.alias("held")).select(key, F.transform("held", lambda c: c["value"]).alias(out))


def rows_of_cells(cells: DataFrame) -> DataFrame:
    """(row, cells): the values of each row in the order of the columns."""
    return _gathered(cells, "row", "column", "cells")


def columns_of_cells(cells: DataFrame) -> DataFrame:
    """(column, cells): the values of each column in the order of the rows."""
    return _gathered(cells, "column", "row", "cells")


def cells_of_rows(rows: DataFrame) -> DataFrame:
    """(row, column, value) of (row, cells); columns are numbered from 0."""
    return rows.select("row", F.posexplode("cells").alias("column", "value"))


def with_row_labels(cells: DataFrame, row_labels: DataFrame) -> DataFrame:
    """Cells, or whole rows, with what ``row_labels`` (row, ..) has on their row; rows without are left out."""
    return cells.join(row_labels, "row")


def with_labels(cells: DataFrame, row_labels: DataFrame, column_labels: DataFrame) -> DataFrame:
    """Cells with row_cluster of (row, row_cluster) and column_cluster of (column, column_cluster); memberships likewise."""
    return cells.join(row_labels, "row").join(column_labels, "column")


def with_conditional_labels(cells: DataFrame, row_labels: DataFrame, column_labels: DataFrame) -> DataFrame:
    """The same with (row, labels): a row's cluster depends on the cluster of the column."""
    found = with_labels(cells, row_labels, column_labels)
    return found.withColumn("row_cluster", F.get("labels", F.col("column_cluster"))).drop("labels")


def row_labels_of(cells: DataFrame) -> DataFrame:
    """(row, row_cluster) of labelled cells."""
    return cells.select("row", "row_cluster").distinct()


def column_labels_of(cells: DataFrame) -> DataFrame:
    """(column, column_cluster) of labelled cells."""
    return cells.select("column", "column_cluster").distinct()


def conditional_row_labels_of(cells: DataFrame) -> DataFrame:
    """(row, labels): a label for each column cluster, in order, of cells labelled by the conditional model."""
    pairs = F.array_sort(F.collect_set(F.struct("column_cluster", "row_cluster")))
    return cells.groupBy("row").agg(pairs.alias("pairs")).select("row", F.transform("pairs", lambda p: p["row_cluster"]).alias("labels"))


def memberships_of(cells: DataFrame, key: str, probabilities: str) -> DataFrame:
    """(key, probabilities) of cells that carry memberships."""
    return cells.select(key, probabilities).distinct()


def most_likely(probabilities: Column | str) -> Column:
    """Number of the largest probability, the first of equal ones."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def soft_label(label: Column | str, k: int, floor: float = 1e-8) -> Column:
    """Memberships near one-hot: 1 at the label, ``floor`` elsewhere, adding up to 1."""
    one = F.col(label) if isinstance(label, str) else label
    total = 1.0 + (k - 1) * floor
    return F.array(*[F.when(one == j, F.lit(1.0 / total)).otherwise(F.lit(floor / total)) for j in range(k)])


def block_sizes(cells: DataFrame) -> DataFrame:
    """(row_cluster, column_cluster, n) of labelled cells."""
    return cells.groupBy("row_cluster", "column_cluster").agg(F.count(F.lit(1)).alias("n"))


def row_proportions(sizes: DataFrame, conditional: bool = False) -> DataFrame:
    """Share of each row cluster in all cells, or, ``conditional``, in those of its column cluster."""
    if not conditional:
        sizes = sizes.groupBy("row_cluster").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("column_cluster") if conditional else Window.partitionBy()
    keys = ["column_cluster", "row_cluster"] if conditional else ["row_cluster"]
    return sizes.select(*keys, (F.col("n") / F.sum("n").over(whole)).alias("proportion"))


def column_proportions(sizes: DataFrame) -> DataFrame:
    """Share of each column cluster in all cells."""
    each = sizes.groupBy("column_cluster").agg(F.sum("n").alias("n"))
    return each.select("column_cluster", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("proportion"))
