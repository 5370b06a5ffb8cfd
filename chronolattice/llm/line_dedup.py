"""Line deduplication within one edit (DataFrame functions only).

A line is its white-space-separated words; blank lines stay.  A line goes if an
earlier line (by document id, then line number) is equal, or within one edit of
it; the earliest stays.  Whether the earlier line goes itself does not matter, so
the result depends on no order of work.

The edit bound is one token inserted, deleted or replaced, of a kind that leaves
at least four fifths of the longer line: with ``FEWEST`` (5) words and more a
token is a word, with fewer a character of the line (words joined by a blank),
if there are at least ``FEWEST`` of those.  Below five characters one edit would
leave less than that, and only equal lines go.

Near lines are found by their deletion neighbourhood: each line emits, as a
hashed key, every variant with one token deleted, and itself.  Lines that share
a variant at the same place differ by one replacement; a variant equal to a
whole line is a deletion or insertion.  Keys are joined by minima per key, so a
key that any number of lines share emits no pairs; what a line meets is verified
token by token.

All of this works on different lines, each taken once.  Only those that can have
a partner emit variants: one edit leaves one half of a line intact, so lines of
which no half (of fitting place and length) occurs in another line are left out
first.  That filter is exact.  Variant keys are exclusive ors of 64-bit
place-dependent token hashes, so all of a line's take linear time and no length
overflows.

Edge cases.  Null text: returned as it is, no lines.  Rows that repeat id and
text count as one document and get one result.  A null id is latest.  Texts and
lines of any length are taken whole.  An empty table gives an empty result.
Input columns are kept apart in a struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import among, discard, materialise, packed, redealt, unpacked

#: Tokens of the longer line, of which one may differ.
FEWEST = 5
WORD, CHARACTER = 0, 1


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def characters(words: Column) -> Column:
    return F.split(F.array_join(words, " "), "")


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def document_key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col, text)


def once(column: Column) -> Column:
    """The same values behind a generator: Spark computes them once, not anew in every expression that uses them."""
    return F.explode(F.array(column))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("doc_key").alias("key"), F.col("line_no").alias("line"))


def halves(tokens: Column, n: Column, kind: Column) -> list[Column]:
    """Keys of a line's halves: as one of n tokens, and as one that has lost a token of n + 1."""

    def pair(of: Column) -> list[Column]:
        cut = F.shiftright(of, 1)
        rest = of - cut
        return [F.xxhash64(kind, F.lit(1), of, F.slice(tokens, F.lit(1), cut)), F.xxhash64(kind, F.lit(2), of, F.slice(tokens, n - rest + 1, rest))]

    return pair(n) + pair(n + 1)


def _hashed(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(7), words).alias("h2")]


def _all_lines(docs: DataFrame) -> DataFrame:
    """Lines with words of docs (doc_id, doc_key, text): doc_id, doc_key, line_no, h1, h2, halves."""
    lines = docs.select("doc_id", "doc_key", F.posexplode(text_lines(F.col("text"))).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^ \t\x0b\x0c\r]")).select("doc_id", "doc_key", "line_no", once(line_words(F.col("line"))).alias("words"))
    # Four words meet five as words, and others as characters.
    n, m = F.size("words"), F.size("tokens")
    kind = F.when(n >= FEWEST, F.lit(WORD)).otherwise(F.lit(CHARACTER))
    as_words = F.when(n == FEWEST - 1, F.array(*halves(F.col("words"), n, F.lit(WORD))[2:]))
    tokens = F.when(n >= FEWEST, F.col("words")).otherwise(characters(F.col("words")))
    lines = lines.select("doc_id", "doc_key", "line_no", *_hashed(F.col("words")), kind.alias("kind"), as_words.alias("as_words"), once(tokens).alias("tokens"))
    own = F.when(m >= FEWEST - 1, F.array(*halves(F.col("tokens"), m, F.col("kind"))))
    lines = lines.select("doc_id", "doc_key", "line_no", "h1", "h2", "as_words", once(own).alias("own"))
    return lines.select("doc_id", "doc_key", "line_no", "h1", "h2", F.coalesce(F.concat("own", "as_words"), "own", "as_words").alias("halves"))


def _variants(lines: DataFrame) -> DataFrame:
    """h1, h2, first, kind, m, key, i: a row for each deleted token i (m tokens left) and one for the whole line (i = -1, m = n)."""
    n = F.size("words")
    kinds = [F.when(n >= FEWEST - 1, F.struct(F.lit(WORD).alias("kind"), F.col("words").alias("tokens"))), F.when(n < FEWEST, F.struct(F.lit(CHARACTER).alias("kind"), characters(F.col("words")).alias("tokens")))]
    each = lines.select("h1", "h2", "first", F.explode(F.array_compact(F.array(*kinds))).alias("of")).withColumn("n", F.size("of.tokens")).where(F.col("n") >= FEWEST - 1)
    token = lambda shift: F.xxhash64("token", F.col("i") + shift)
    each = each.repartition("h1", "h2").select("h1", "h2", "first", "of.kind", "n", F.posexplode("of.tokens").alias("i", "token"))
    each = each.select("h1", "h2", "first", "kind", "n", "i", token(0).alias("here"), token(-1).alias("shifted"))
    line = Window.partitionBy("h1", "h2", "kind").orderBy("i")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = each.select("*", F.bit_xor("here").over(upto).alias("here_upto"), F.bit_xor("shifted").over(upto).alias("shifted_upto"), F.bit_xor("here").over(whole).alias("here_all"), F.bit_xor("shifted").over(whole).alias("shifted_all"))
    key = F.col("here_upto").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("shifted_all")).bitwiseXOR(F.col("shifted_upto"))
    deleted = F.when(F.col("n") >= FEWEST, F.struct((F.col("n") - 1).alias("m"), key.alias("key"), F.col("i").alias("i")))
    itself = F.when(F.col("i") == 0, F.struct(F.col("n").alias("m"), F.col("here_all").alias("key"), F.lit(-1).alias("i")))
    return sums.select("h1", "h2", "first", "kind", F.explode(F.array_compact(F.array(deleted, itself))).alias("v")).select("h1", "h2", "first", "kind", "v.m", "v.key", "v.i")


def within_one_edit(a: Column, b: Column) -> Column:
    same = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True).cast("int")
    p = F.when(same == 0, F.size(a)).otherwise(same - 1)
    tail = lambda w, skip: F.slice(w, p + 1 + skip, F.size(w) + 1)
    return F.when(same == 0, F.lit(True)).when(F.size(a) == F.size(b), tail(a, 1) == tail(b, 1)).when(F.size(a) == F.size(b) + 1, tail(a, 1) == tail(b, 0)).when(F.size(a) + 1 == F.size(b), tail(a, 0) == tail(b, 1)).otherwise(F.lit(False))


def _candidate_texts(docs: DataFrame, different: DataFrame) -> DataFrame:
    """h1, h2, first, words of the different lines that share a half with another one."""
    half = different.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(redealt("half"))
    able = materialise(half.join(shared, "half", "left_semi").select("h1").distinct(), "line-able")
    firsts = materialise(among(different.select("h1", "h2", "first"), able, "h1"), "line-firsts")
    wanted = firsts.groupBy(F.col("first.key").alias("doc_key"), F.col("first.id").alias("own_id")).agg(F.collect_list("first.line").alias("numbers"))
    part = among(docs, materialise(wanted, "line-wanted"), "doc_key", firsts.count())
    part = part.where(F.col("doc_id").eqNullSafe(F.col("own_id"))).select("doc_id", "doc_key", "numbers", once(text_lines(F.col("text"))).alias("lines"))
    part = part.select("doc_id", "doc_key", "lines", F.explode("numbers").alias("line_no")).select("doc_id", "doc_key", "line_no", F.get("lines", F.col("line_no")).alias("line"))
    part = part.select(_place().alias("first"), once(line_words(F.col("line"))).alias("words")).select("first", "words", *_hashed(F.col("words")))
    texts = materialise(part.dropDuplicates(["h1", "h2"]), "line-texts")
    discard(able, firsts)
    return texts


def near_lines(docs: DataFrame, different: DataFrame) -> DataFrame:
    """h1, h2 of the different lines of which an earlier one is within the edit bound."""
    texts = _candidate_texts(docs, different)
    of, first = ["kind", "m", "key"], F.col("first")
    v = materialise(_variants(texts), "line-variants")
    of_key = v.groupBy(*of).agg(F.min(F.when(F.col("i") < 0, first)).alias("whole"), F.min(F.when(F.col("i") >= 0, first)).alias("deleted"), F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b")
    met = materialise(v.join(of_key.select("kind", "m", redealt("key"), "whole", "deleted"), of), "line-met")
    discard(v)
    replaced = met.where("i >= 0").groupBy(*of, "i").agg(F.min("first").alias("replaced"))
    met = met.join(replaced.select("kind", "m", redealt("key"), "i", "replaced"), [*of, "i"], "left")
    partners = F.when(F.col("i") < 0, F.array("deleted")).otherwise(F.array("replaced", "whole"))
    found = met.select("h1", "h2", "kind", "first", F.explode(partners).alias("partner")).where("partner < first").select("h1", "h2", "kind", "partner").distinct()
    one = texts.select("h1", "h2", F.col("words").alias("a"))
    two = texts.select(F.col("first").alias("partner"), F.col("words").alias("b"))
    found = found.join(one, ["h1", "h2"]).join(two, "partner")
    alike = F.when(F.col("kind") == WORD, within_one_edit(F.col("a"), F.col("b"))).otherwise(within_one_edit(F.col("x"), F.col("y")))
    found = found.withColumn("x", once(characters(F.col("a")))).withColumn("y", once(characters(F.col("b"))))
    return found.where(alike).select("h1", "h2").distinct()


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all input columns), doc_id, and the numbers of the lines that go (null: none)."""
    text = docs[text_col]
    whole = docs.select(packed(docs), docs[id_col].alias("doc_id"), document_key(docs[id_col], text).alias("doc_key"))
    slim = docs.where(text.isNotNull()).select(docs[id_col].alias("doc_id"), document_key(docs[id_col], text).alias("doc_key"), text.alias("text"))
    lines = materialise(_all_lines(slim), "lines")
    different = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times"), F.any_value("halves").alias("halves"))
    different = materialise(different, "line-different")
    near = materialise(near_lines(slim, different), "line-near")
    repeated = different.where("times > 1").select("h1", "h2", "first")
    known = repeated.unionByName(near.withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType)))
    gone = lines.drop("halves").join(known, ["h1", "h2"]).where(F.col("first").isNull() | (F.col("first") != _place()))
    gone = gone.groupBy(F.col("doc_id").alias("own_id"), F.col("doc_key").alias("own_key")).agg(F.collect_set("line_no").alias("gone"))
    gone = materialise(gone, "lines-gone")
    discard(lines, different, near)
    return whole.join(gone, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("doc_key") == F.col("own_key")), "left").select("row", "doc_id", "gone")


def _with_rest(judged: DataFrame, text_col: str) -> DataFrame:
    """Adds ``rest``, what is left of the text."""
    text = F.col("row").getField(text_col)
    judged = judged.select("*", once(F.when(F.col("gone").isNotNull(), text_lines(text))).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return judged.withColumn("rest", F.when(F.col("gone").isNull(), text).otherwise(rest)).drop("lines")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lines_gone, chars_kept, text_md5 of what is left (null for a null text)."""
    out = _with_rest(_judged(docs, id_col, text_col), text_col)
    return out.select("doc_id", F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).alias("lines_gone"), F.length("rest").cast("long").alias("chars_kept"), F.md5("rest").alias("text_md5"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; documents of which no word is left go.

    ``length_col``, if there is one, is set anew for texts that change.
    """
    out = _with_rest(_judged(docs, id_col, text_col), text_col)
    out = out.where(F.col("gone").isNull() | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    fixed = {text_col: F.col("rest")}
    if length_col in docs.columns:
        fixed[length_col] = F.when(F.col("gone").isNull(), F.col("row").getField(length_col)).otherwise(F.length("rest").cast(docs.schema[length_col].dataType))
    return out.select(*[fixed[c].alias(c) if c in fixed else e for c, e in zip(docs.columns, unpacked(out, docs.columns))])


def oracle(fewest: int = FEWEST) -> str:
    """``line_report`` in DuckDB SQL, for unique ids; variants are compared as whole texts."""
    return f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i AS line_no, list_filter(string_split(translate(ls[i], chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda w: w <> '') AS words
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
p AS (SELECT doc_id, line_no, words, array_to_string(words, ' ') AS line, CAST(doc_id AS HUGEINT) * 10000000 + line_no AS pos FROM l WHERE len(words) > 0),
d AS (SELECT line, any_value(words) AS words, min(pos) AS first FROM p GROUP BY line),
v AS (SELECT line, first, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS cut, len(words) AS n, 'word' AS kind
      FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM d WHERE len(words) >= {fewest})
      UNION ALL
      SELECT line, first, i, substring(line, 1, i - 1) || substring(line, i + 1) AS cut, length(line) AS n, 'character' AS kind
      FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM d WHERE len(words) < {fewest} AND length(line) >= {fewest})),
near AS (
  SELECT v.line FROM v JOIN (SELECT kind, n, i, cut, min(first) AS least FROM v GROUP BY kind, n, i, cut) g ON v.kind = g.kind AND v.n = g.n AND v.i = g.i AND v.cut = g.cut WHERE g.least < v.first
  UNION SELECT v.line FROM v JOIN d ON v.cut = d.line WHERE d.first < v.first
  UNION SELECT d.line FROM d JOIN v ON v.cut = d.line WHERE v.first < d.first),
gone AS (SELECT p.doc_id, list(p.line_no) AS gone FROM p JOIN d ON p.line = d.line LEFT JOIN near ON near.line = p.line
         WHERE near.line IS NOT NULL OR p.pos <> d.first GROUP BY p.doc_id),
r AS (SELECT x.doc_id, coalesce(len(gone), 0) AS lines_gone,
             CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string([y FOR y, i IN string_split(text, chr(10)) IF NOT list_contains(gone, i)], chr(10)), '') END AS rest
      FROM documents x LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(lines_gone AS INTEGER) AS lines_gone, CAST(length(rest) AS BIGINT) AS chars_kept, md5(rest) AS text_md5 FROM r"""
