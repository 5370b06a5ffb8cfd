"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

Edge cases.  A null URL or one without ``://`` has empty host and path, fits no
rule and is judged by its text alone (null: allowed).  Matching is on the URL
with A-Z lower-cased.  A term counts only between characters other than
``[a-z0-9]``; repeats of one term count once.  Rows are judged one by one, so
repeated rows, empty tables and extra columns need no care.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of these rejects a URL.
STRICT = ("adult", "porn", "xxx", "casino", "viagra", "pills", "escort", "spam", "malware", "phishing", "warez", "betting")
#: These reject together: two different ones or more.
SOFT = ("cheap", "free", "win", "bets", "ads", "track", "farm", "bonus", "loan", "loans", "dating", "sexy", "poker", "jackpot", "deal", "deals", "crack", "torrent", "clickbait", "popup")
MIN_SOFT = 2
#: (verdict, host, path prefix): a rule fits its host and all subdomains; the longest wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #``, path from there up to ``? #``; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, on, prefix in reversed(ordered):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(on + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for n, (term, kind) in enumerate([*((t, "strict") for t in strict), *((t, "soft") for t in soft)]):
        a.add_word(term, (n, len(term), kind == "strict"))
    a.make_automaton()
    return a


_BETWEEN = frozenset(string.ascii_lowercase + string.digits)


def hits(a: ahocorasick.Automaton, url: str | None) -> tuple[int, int]:
    """Numbers of different strict and soft terms in a lower-cased URL."""
    strict, soft = set(), set()
    for end, (n, length, is_strict) in a.iter(url or ""):
        before, after = end - length, end + 1
        if (before < 0 or url[before] not in _BETWEEN) and (after >= len(url) or url[after] not in _BETWEEN):
            (strict if is_strict else soft).add(n)
    return len(strict), len(soft)


def vocabulary_hits(pages: DataFrame, id_col: str, lowered: Column, keep: Sequence[Column], strict: Sequence[str], soft: Sequence[str]) -> DataFrame:
    """``keep`` columns beside ``strict_hits`` and ``soft_hits``; a narrow pass with one automaton per task."""
    cols = pages.select(lowered.alias("lowered"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[1:]) + ", strict_hits int, soft_hits int"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for b in batches:
            found = [hits(a, u) for u in b.column(0).to_pylist()]
            out = [b.column(i) for i in range(1, b.num_columns)] + [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names[1:], "strict_hits", "soft_hits"])

    return cols.mapInArrow(judge, schema)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, min_soft: int = MIN_SOFT, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: id, url, host, path, rule, strict_hits, soft_hits, verdict."""
    host, path = host_and_path(pages[url_col])
    found = vocabulary_hits(pages, id_col, lower_ascii(pages[url_col]), [pages[id_col].alias("page_id"), pages[url_col].alias("url"), host.alias("host"), path.alias("path")], strict, soft)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    bad = (F.col("strict_hits") >= 1) | (F.col("soft_hits") >= min_soft)
    verdict = F.coalesce(rule.getField("verdict"), F.when(bad, "block").otherwise("allow"))
    return found.select("page_id", "url", "host", "path", rule.getField("rule").alias("rule"), "strict_hits", "soft_hits", verdict.alias("verdict"))


def oracle(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, min_soft: int = MIN_SOFT, rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same verdicts in DuckDB SQL."""

    def count(terms: Sequence[str]) -> str:
        return " + ".join(f"CAST(coalesce(regexp_matches(lowered, '(^|[^a-z0-9]){t}([^a-z0-9]|$)', 's'), false) AS INTEGER)" for t in terms)

    cases = "".join(
        f" WHEN (host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '{prefix}') THEN '{verdict} {on}{prefix}'"
        for verdict, on, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    )
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH split AS (
  SELECT page_id, translate(url, '{upper}', '{lower}') AS lowered,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM split),
parts AS (
  SELECT page_id, lowered, translate(raw_host, '{upper}', '{lower}') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM hosts),
hit AS (
  SELECT *, {count(strict)} AS strict_hits, {count(soft)} AS soft_hits, CASE{cases} ELSE NULL END AS fit FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
       substr(fit, strpos(fit, ' ') + 1) AS rule,
       coalesce(substr(fit, 1, strpos(fit, ' ') - 1), CASE WHEN strict_hits >= 1 OR soft_hits >= {min_soft} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits
FROM hit"""
