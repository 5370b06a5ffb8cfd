"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time 0..1, piecewise linear
between knots.  Its integral is the source's weight; water-filling turns the
weights into target sizes that stop at ``max_repeats`` times the source's size.
The documents of a source lie in a pseudo-random order, one epoch after
another; the mix takes that stream up to the target.  A document's training
position is the time at which the source's cumulative demand reaches it, found
by inverting the integral, and the result is range-sorted by position.

Running sums never gather a source in one task: documents fall into ``BUCKETS``
buckets by hash inside their source, bucket totals are summed map-side, and
only (source, bucket) groups are ordered.  The table of sources has one row
each, that of buckets ``BUCKETS`` rows per source at most.

Edge cases.  Null source: a source of its own, ordered last.  Null or empty
text: size 0, never taken.  Empty table: empty result.  Rows that repeat an id
are documents of their own; ties in the order fall by size, then by text hash.
The last document that a target reaches is cut at a word, so that the words
taken from a source are its target, rounded.  Columns of the input are kept
apart in a struct and cannot clash with working columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, packed, source_key, unpacked, word_count

Schedule = Sequence[tuple[float, float]]
#: By rank of the source, repeating: integrals 3, 1 and 2. The first fades out, the third comes late.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 5.0)))
SHARE = 1.5
MAX_REPEATS = 2
BUCKETS = 1024
SEED = "curriculum"


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:]))


def time_of(fraction: Column, schedule: Schedule) -> Column:
    """The time at which this fraction of the schedule's integral is reached."""
    want, total, found, pieces = fraction * integral(schedule), 0.0, None, []
    for (t0, a), (t1, b) in zip(schedule, schedule[1:]):
        rest, slope = F.greatest(want - F.lit(total), F.lit(0.0)), (b - a) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(a * a) + rest * (2 * slope), F.lit(0.0)))
        pieces.append((total, F.lit(t0) + F.coalesce(F.try_divide(rest * 2.0, root + F.lit(a)), F.lit(0.0))))
        total += (t1 - t0) * (a + b) / 2
    found = pieces[0][1]
    for start, at in pieces[1:]:
        found = F.when(want > start, at).otherwise(found)
    return F.least(found, F.lit(1.0))


def order_hash(id_col: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, schedules: Sequence[Schedule], share: float, max_repeats: int) -> DataFrame:
    """From (src, source_size), one row per source: src, source_size, kind (its schedule), target."""
    everything = Window.partitionBy(F.lit(0))
    weight = F.lit(None).cast("double")
    for k, s in enumerate(schedules):
        weight = F.when(F.col("kind") == k, F.lit(float(integral(s)))).otherwise(weight)
    t = sizes.withColumn("kind", (F.row_number().over(everything.orderBy("src")) - 1) % len(schedules))
    t = t.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = everything.orderBy("ratio", "src")
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("capped")) / F.col("open"))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return t.select("src", "source_size", "kind", F.round(target, 6).alias("target"))


def allocate(docs: DataFrame, id_col: str, source_col: str, size: Column, tie: Column, schedules: Sequence[Schedule], share: float, max_repeats: int) -> DataFrame:
    """Rows of ``docs`` in a struct ``row`` with size, source_size, target and copies: array<struct<copy, words, position>>."""
    order = order_hash(docs[id_col])
    bucket = F.floor(F.conv(F.substring(order, 1, 4), 16, 10).cast("int") / (65536 // BUCKETS)).cast("int")
    keyed = docs.select(packed(docs), size.alias("size"), source_key(docs[source_col]).alias("src"), order.alias("order"), bucket.alias("bucket"), tie.alias("tie"))
    sums = materialise(keyed.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-sums")
    by_source = targets(sums.groupBy("src").agg(F.sum("bucket_size").alias("source_size")), schedules, share, max_repeats)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(by_source, "src").drop("bucket_size")
    inside = Window.partitionBy("src", "bucket").orderBy("order", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(starts, ["src", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    limit = F.floor(F.col("target") + 0.5).cast("long")

    def copy(k: int) -> Column:
        words = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), limit - F.col("source_size") * k) - F.col("start")).cast("long")
        fraction = F.coalesce(F.try_divide((F.col("source_size") * k + F.col("start")).cast("double") + words / F.lit(2.0), F.col("target")), F.lit(0.0))
        at = time_of(fraction, schedules[0])
        for n, s in enumerate(schedules[1:], 1):
            at = F.when(F.col("kind") == n, time_of(fraction, s)).otherwise(at)
        return F.struct(F.lit(k).alias("copy"), words.alias("words"), F.round(at, 9).alias("position"))

    copies = F.filter(F.array(*[copy(k) for k in range(max_repeats)]), lambda c: c["words"] > 0)
    return placed.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document, no texts: doc_id, size, source_size, target, taken, first_position (null if not taken), in training order."""
    slim = materialise(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), F.xxhash64(docs[text_col]).alias("tie")), "mix-sizes")
    out = allocate(slim, "doc_id", "source", slim["size"], slim["tie"], schedules, share, max_repeats)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    out = out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.get("copies", F.lit(0))["position"].alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def cut(text: Column, words: Column) -> Column:
    """The text up to the end of its first ``words`` words."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, max_repeats: int = MAX_REPEATS, length_col: str | None = "n_chars") -> DataFrame:
    """The mixed corpus itself, in training order: a row of ``docs`` for each copy taken.

    A copy that the target cuts has its text cut at a word and ``length_col``, if there is one, set anew.
    """
    out = allocate(docs, id_col, source_col, word_count(docs[text_col]), F.xxhash64(docs[text_col]), schedules, share, max_repeats)
    out = out.select("row", "size", F.explode("copies").alias("taken"))
    text = F.col("row").getField(text_col)
    partial = F.col("taken.words") < F.col("size")
    fixed = {text_col: F.when(partial, cut(text, F.col("taken.words"))).otherwise(text)}
    if length_col in docs.columns:
        length = F.col("row").getField(length_col)
        fixed[length_col] = F.when(partial, F.length(fixed[text_col]).cast(docs.schema[length_col].dataType)).otherwise(length)
    sorted_ = out.orderBy(F.col("taken.position"), F.col("row").getField(id_col), "taken.copy")
    return sorted_.select(*[fixed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def oracle(schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> str:
    """``mix_plan`` in DuckDB SQL, without positions."""
    weights = " ".join(f"WHEN {k} THEN {float(integral(s))}" for k, s in enumerate(schedules))
    taken = " + ".join(f"greatest(0, least(start + size, tgt - {k} * source_size) - start)" for k in range(max_repeats))
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 'a' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, text FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % {len(schedules)} {weights} END AS weight FROM s),
c AS (SELECT *, source_size * {float(max_repeats)} AS cap, source_size * {float(max_repeats)} / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * CAST({share} AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT src, source_size, round(least(cap, coalesce((SELECT max(level) FROM l WHERE level <= ratio) * weight, cap)), 6) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target, CAST(floor(t.target + 0.5) AS BIGINT) AS tgt,
             coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size, d.text
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.src = t.src)
SELECT doc_id, size, source_size, target, CAST({taken} AS BIGINT) AS taken FROM p"""
