"""The series set: an immutable wrapper around one DataFrame, a series per row.

Univariate rows have ``decorators`` (map<string,string>), ``timeFrom``,
``timeTo``, ``timeGranularity`` (double), ``series`` (array<double>) and ``id``;
any other columns may be there.  Every operation returns a new set.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, DECORATORS, SERIES = "id", "decorators", "series"
TIME_FROM, TIME_TO, TIME_STEP = "timeFrom", "timeTo", "timeGranularity"
SIMULATION_ID, SIMULATION_NAME, PLAN_ID, VARIABLE = "simulationId", "simulationName", "planId", "varName"
GROUP_KEY, IN_GROUP_KEY = "gkey", "inGKey"


def escape(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def unescape(name: str) -> str:
    return name[1:-1].replace("``", "`") if len(name) > 1 and name[0] == name[-1] == "`" else name


class Relational:
    """Selections, filters, joins and the other relational operations."""

    df: DataFrame

    def __init__(self, df: DataFrame, force_ids: bool = False) -> None:
        if force_ids and ID in df.columns:
            df = df.drop(ID)
        self.df = df if ID in df.columns else df.withColumn(ID, F.monotonically_increasing_id())

    def _of(self, df: DataFrame, force_ids: bool = False):
        return type(self)(df, force_ids)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema

    @cached_property
    def _count(self) -> int:
        return self.df.count()

    def count(self) -> int:
        """Number of rows, counted once."""
        return self._count

    def column(self, name: str) -> Column:
        return self.df[escape(unescape(name))]

    def resolved(self, name: str) -> Column:
        """The column of that name or else the decorator, under that name."""
        plain = unescape(name)
        if plain in self.df.columns:
            return self.df[escape(plain)]
        return F.element_at(self.df[DECORATORS], plain).alias(plain)

    def select(self, *names: str | Sequence[str]):
        flat = [n for x in names for n in ([x] if isinstance(x, str) else x)]
        return self._of(self.df.select(*[self.resolved(n) for n in flat]))

    def select_columns(self, *columns: Column | Sequence[Column]):
        return self._of(self.df.select(*[c for x in columns for c in ([x] if isinstance(x, Column) else x)]))

    def drop(self, *names: str):
        return self._of(self.df.drop(*names))

    def with_column(self, name: str, column: Column):
        return self._of(self.df.withColumn(name, column))

    def with_column_renamed(self, old: str, new: str):
        return self._of(self.df.withColumnRenamed(old, new))

    def add_constant(self, out: str, value: Any):
        lit = F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)
        return self.with_column(out, lit)

    def add_function_column(self, out: str, inputs: str | Sequence[str], function):
        """``function`` of columns: a Column expression builder, a UDF or a pandas UDF."""
        names = [inputs] if isinstance(inputs, str) else inputs
        return self.with_column(out, function(*[self.column(n) for n in names]))

    def where(self, condition: Column | str):
        return self._of(self.df.where(condition))

    def filter_decorator(self, name: str, value: str):
        return self.where(F.element_at(self.df[DECORATORS], name) == value)

    def order_by(self, *names: str | Column):
        return self._of(self.df.orderBy(*names))

    def limit(self, n: int):
        return self._of(self.df.limit(n))

    def sample(self, fraction: float, seed: int = 0):
        return self._of(self.df.sample(fraction, seed))

    def union(self, other: Relational):
        """All rows of both, by position, with new ids."""
        return self._of(self.df.drop(ID).union(other.df.drop(ID)), True)

    def regenerate_ids(self):
        return self._of(self.df, True)

    def repartition(self, n: int | str | Column, *columns: str | Column):
        return self._of(self.df.repartition(n, *columns))

    def coalesce(self, n: int):
        return self._of(self.df.coalesce(n))

    def persist(self):
        self.df.persist()
        return self

    def unpersist(self):
        self.df.unpersist()
        return self

    def take(self, n: int) -> list:
        return self.df.take(n)

    def collect(self) -> list:
        return self.df.collect()

    def show(self, n: int = 20) -> None:
        self.df.show(n)

    def left_join(self, other: DataFrame, condition: Column | str | Sequence[str]):
        return self._of(self.df.join(other, condition, "left"))

    def transform(self, step):
        """``step(self)``: chains functions and pipeline steps."""
        return step(self)
