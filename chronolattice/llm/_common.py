"""Helpers shared by the operators: scratch tables, table reading, row packing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables written by this process, by application id.
_SCRATCH: dict[str, list[str]] = {}
#: Own folders in local mode, by application id.
_OWN: dict[str, str] = {}
#: Most rows of a table that is broadcast for a join; above, Spark's own checks decide.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; where that is unset, one of our own, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="chronolattice-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind ``df`` are of no use any more; collecting garbage in
    the driver lets Spark's cleaner delete them now instead of half an hour later.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def discard(*tables: DataFrame) -> None:
    """Delete the scratch tables behind these results of :func:`materialise`, once all that reads them is written."""
    for df in tables:
        known = _SCRATCH.get(df.sparkSession.sparkContext.applicationId, [])
        if df.scratch_path in known:
            known.remove(df.scratch_path)
            _delete(df.sparkSession, df.scratch_path)


def redealt(name: str) -> Column:
    """The column, computed anew: a join deals its table out again, and AQE may then split the other side's hot keys.

    Spark splits a join's partition only if both sides come straight from an exchange,
    which the result of an aggregation by the same key does not.
    """
    return F.col(name).bitwiseXOR(F.lit(0).cast("long")).alias(name)


def among(df: DataFrame, keys: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` joined with ``keys`` (a written table) by one column; ``keys`` is sent to all tasks if counted to be small.

    ``rows`` is the count to go by if the keys' rows are lists.
    """
    rows = keys.count() if rows is None else rows
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, name)


def mark(spark: SparkSession) -> int:
    """Number of scratch tables so far, for :func:`release`."""
    return len(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete this application's scratch tables from number ``since`` on, but those with the label ``keep``.

    Call it once the results that read them are written.
    """
    tables = _SCRATCH.get(spark.sparkContext.applicationId, [])
    for p in tables[since:]:
        if keep is None or not p.rpartition("/")[2].startswith(f"{keep}-"):
            _delete(spark, p)
            tables.remove(p)


def give_back(*broadcasts: Broadcast) -> None:
    """Called at the end of a Python task: the worker lives on, but its free memory, and these values' copies, go back.

    A value that is used again is read anew from the executor's copy.
    """
    for b in broadcasts:
        vars(b).pop("_value", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` in one struct, so that working columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: Iterable[str], name: str = "row") -> list[Column]:
    return [df[name].getField(c).alias(c) for c in columns]


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; orders like the source by code point, null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), source))
