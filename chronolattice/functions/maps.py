"""Column expressions on metadata maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "map<string,string>"


def or_empty(m: Column) -> Column:
    return F.coalesce(m, F.create_map().cast(_EMPTY))


def merged(base: Column, over: Column) -> Column:
    """Both maps' entries, those of ``over`` where a key is in both; a null map is empty."""
    a, b = or_empty(base), or_empty(over)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def with_warnings(base: Column, items: Column) -> Column:
    """Adds ``name::indicator::value`` items as ``name::indicator`` -> value; shorter items are passed over, the last of a key counts."""
    parts = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.split(s, "::")), lambda p: F.size(p) > 2)
    entries = F.transform(parts, lambda p: F.struct(F.concat_ws("::", F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("key"), F.get(p, F.lit(2)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return merged(base, F.map_from_entries(last))


def with_metadata(base: Column, text: Column) -> Column:
    """Adds the entries of ``k::v##k::v``; a null text leaves the map as it is."""
    return F.when(text.isNull(), base).otherwise(merged(base, F.str_to_map(text, F.lit("##"), F.lit("::"))))


def map_of(columns: list[str]) -> Column:
    """Columns as a string map, name -> value."""
    return F.create_map(*[e for c in columns for e in (F.lit(c), F.col(f"`{c}`").cast("string"))])
