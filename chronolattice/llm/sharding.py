"""Sharding by a k-d tree over document metadata (DataFrame functions only).

Every node is split at the weighted median (by bytes; a node of an odd number
of shards at the matching quantile) along its widest metadata axis, until each
leaf is one shard.  Widths are relative to the axis's extent over all rows.
Medians are exact to a 30-bit key and distributed: two passes, each a map-side
histogram of at most 32,768 bins per node, of which one row per node is kept.
The key is the axis value followed by a hash of the document id, the text and
the row's place in the files, so a value, an id or a group of equal texts that
holds any share of the rows is split too: the law is ``bytes``, and groups are
kept together by no law but ``key``.  Only slim rows (id, size, axes) pass between
the levels, never texts.

Axes: a string's first six bytes read as a number, a number as it is; null
lies lowest.  Edge cases.  Null text: size 1.  Rows that repeat an id and a text
are dealt out one by one.  An empty table gives an empty result.  Slots are
gapless from 0 in each shard, counted in (shard, hash bucket) groups of which
no task gets a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, materialise

BITS = 15
BINS = 1 << BITS
SLOT_BUCKETS = 1024


def axis_of(docs: DataFrame, name: str) -> Column:
    c = docs[name]
    if isinstance(docs.schema[name].dataType, T.StringType):
        return F.coalesce(F.conv(F.hex(F.rpad(F.substring(F.encode(c, "utf-8"), 1, 6), 6, F.lit(b"\x00"))), 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(c.cast("double"), F.lit(-1.0))


def _cut(start: Column, goal: Column) -> Column:
    """In the sorted bins, the last one before which no more than ``goal`` lies: struct<total, bin, before, within>."""
    first = F.struct(start.alias("total"), F.lit(0).alias("bin"), start.alias("before"), F.lit(0).cast("long").alias("within"))
    return F.aggregate(
        F.col("bins"), first,
        lambda a, x: F.when(a["total"] <= goal, F.struct((a["total"] + x["bytes"]).alias("total"), x["bin"].alias("bin"), a["total"].alias("before"), x["bytes"].alias("within"))).otherwise(F.struct((a["total"] + x["bytes"]).alias("total"), a["bin"].alias("bin"), a["before"].alias("before"), a["within"].alias("within"))),
    )


def _histogram(rows: DataFrame, bin_: Column) -> DataFrame:
    bins = rows.groupBy("node", bin_.cast("int").alias("bin")).agg(F.sum("size").alias("bytes"))
    return bins.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("bin", "bytes"))).alias("bins"))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, axes: Sequence[str], leaves: int) -> DataFrame:
    """doc_id, size, text_crc32, axes, tie, and the root they start in: node 0 with ``leaves`` shards."""
    text = docs[text_col]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    names = [a for a in axes if a in docs.columns]
    values = F.array(*[axis_of(docs, a) for a in names], F.log2(size.cast("double")))
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(7), docs[id_col], text, F.monotonically_increasing_id()), 64 - BITS).cast("int")
    crc = F.crc32(F.coalesce(text, F.lit("")))
    return docs.select(docs[id_col].alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), values.alias("axes", metadata={"names": [*names, "size"]}), tie.alias("tie"), F.lit(0).alias("node"), F.lit(leaves).alias("leaves"))


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", axes: Sequence[str] = ("lang", "source")) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Give the number of shards, or ``target_bytes`` for as many as the total needs.
    """
    written = rows = materialise(keyed_rows(docs, id_col, text_col, axes, 0 if shards is None else shards), "kd-rows")
    n = len(rows.schema["axes"].metadata["names"])
    extent = [f(F.col("axes")[k]).alias(f"{name}{k}") for k in range(n) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    whole = rows.agg(F.sum("size").alias("total"), *extent).first()
    if shards is None:
        shards = max(1, -(-(whole["total"] or 0) // target_bytes))
        rows = rows.withColumn("leaves", F.lit(shards))
    spans = [max((whole[f"hi{k}"] or 0) - (whole[f"lo{k}"] or 0), 0) for k in range(n)]
    for _ in range(max(0, shards - 1).bit_length()):
        open_ = rows.where("leaves > 1")
        state = open_.groupBy("node").agg(F.sum("size").alias("total"), F.max("leaves").alias("of"), *extent)
        widths = F.array(*[(F.col(f"hi{k}") - F.col(f"lo{k}")) / F.lit(float(spans[k]) or 1.0) for k in range(n)])
        state = state.select("node", F.floor(F.col("total") * F.floor(F.col("of") / 2) / F.col("of")).cast("long").alias("goal"), (F.array_position(widths, F.array_max(widths)) - 1).cast("int").alias("axis"), F.array(*[F.col(f"lo{k}") for k in range(n)]).alias("los"), widths.alias("widths"))
        state = materialise(state.select("node", "goal", "axis", F.get("los", F.col("axis")).alias("lo"), (F.get("widths", F.col("axis")) * F.get(F.array(*[F.lit(float(s)) for s in spans]), F.col("axis"))).alias("span")), "kd-state")
        place = F.when(F.col("span") > 0, F.least(F.floor((F.get("axes", F.col("axis")) - F.col("lo")) / F.when(F.col("span") > 0, F.col("span")) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
        keyed = open_.join(state, "node").withColumn("high", place)
        first = _histogram(keyed, F.col("high")).join(state, "node").select("node", _cut(F.lit(0).cast("long"), F.col("goal")).alias("cut"))
        first = materialise(first.select("node", F.col("cut.bin").alias("high_cut"), F.col("cut.before").alias("before")), "kd-cut")
        second = _histogram(keyed.join(first, "node").where("high = high_cut"), F.col("tie")).join(first, "node").join(state.select("node", "goal"), "node")
        second = second.withColumn("cut", _cut(F.col("before"), F.col("goal")))
        after = (F.col("goal") - F.col("cut.before")) > (F.col("cut.before") + F.col("cut.within") - F.col("goal"))
        cuts = materialise(second.select("node", "high_cut", (F.col("cut.bin") + after.cast("int")).alias("low_cut")), "kd-cut")
        joined = rows.join(state, "node", "left").join(cuts, "node", "left").withColumn("high", place)
        left = F.coalesce((F.col("high") < F.col("high_cut")) | ((F.col("high") == F.col("high_cut")) & (F.col("tie") < F.col("low_cut"))), F.lit(True))
        half = F.floor(F.col("leaves") / 2).cast("int")
        moved = joined.select("doc_id", "size", "text_crc32", "axes", "tie", (F.col("node") + F.when((F.col("leaves") > 1) & ~left, half).otherwise(0)).alias("node"), F.when(F.col("leaves") == 1, F.lit(1)).when(left, half).otherwise(F.col("leaves") - half).alias("leaves"))
        rows = materialise(moved, "kd-rows")
        discard(written, state, first, cuts)
        written = rows
    return slots(rows)


def slots(rows: DataFrame) -> DataFrame:
    """Adds gapless slots in each node, and names it shard."""
    rows = rows.withColumn("bucket", F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", "tie"), 64 - (SLOT_BUCKETS - 1).bit_length()).cast("int"))
    counts = rows.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("node", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("node", "bucket").orderBy("doc_id", "text_crc32", "size")
    out = rows.join(starts, ["node", "bucket"]).withColumn("slot", F.col("start") + F.row_number().over(inside) - 1)
    return out.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), F.col("slot").cast("long").alias("slot"))
