"""Licence scan: canonical digests of whole texts and of lines, hash-joined to known ones.

The canonical form is lower case, without copyright lines (those that begin with "copyright",
"(c)", "©" or "all rights reserved"), with blanks for everything but letters and digits, and one
spelling of words that have several. Its SHA-256 is compared: a document's whole text, and each
of its lines, since notices stand in documents of their own text. A match is equality of the
whole canonical text, so a changed word is no match.

Null, empty and blank texts and lines have no canonical form and match nothing. Repeated rows
match alike, as do texts that are known under several names (one row each). Other columns are
ignored. Built-in functions only; the join's kind is left to the optimiser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.llm.licence_texts import EQUIVALENT, KNOWN

_COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n©(]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
_OTHER = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Array of the canonical lines of a text, an empty string for a line without letters or digits."""
    plain = F.regexp_replace(F.lower(text), _COPYRIGHT, r"$1")
    padded = F.concat(F.lit(" "), F.replace(F.regexp_replace(plain, _OTHER, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, word in EQUIVALENT:
        padded = F.replace(padded, F.lit(f" {other} "), F.lit(f" {word} "))
    return F.transform(F.split(padded, "\n"), F.trim)


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_licences(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence) of known texts (name, text)."""
    rows = spark.createDataFrame(known or KNOWN, "licence string, text string")
    return rows.select(F.sha2(whole(canonical_lines(F.col("text"))), 256).alias("digest"), "licence").distinct()


def matches(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, scope, line, licence): ``scope`` is text (line -1) or line (its place from 0)."""
    lines = docs.select(F.col("doc_id").cast("long"), canonical_lines(F.col("text").cast("string")).alias("lines"))
    entry = lambda scope, line, form: F.struct(F.lit(scope).alias("scope"), line.alias("line"), form.alias("form"))
    forms = F.concat(F.array(entry("text", F.lit(-1), whole(F.col("lines")))), F.transform("lines", lambda x, i: entry("line", i, x)))
    forms = lines.select("doc_id", F.explode(forms).alias("f")).where("f.form <> ''")
    return forms.select("doc_id", "f.scope", "f.line", F.sha2("f.form", 256).alias("digest")).join(known, "digest").select("doc_id", "scope", "line", "licence")


def duckdb_sql() -> str:
    """The same scan of the table ``documents`` as SQL, with the known texts as values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    padded = f"' ' || replace(regexp_replace(regexp_replace(lower(t), {quote(_COPYRIGHT)}, '\\1', 'g'), {quote(_OTHER)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for other, word in EQUIVALENT:
        padded = f"replace({padded}, ' {other} ', ' {word} ')"
    lines = f"list_transform(string_split({padded}, chr(10)), lambda x: trim(x))"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN)
    return f"""
WITH canon AS (SELECT doc_id, {lines} AS ls FROM (SELECT doc_id, text AS t FROM documents)),
forms AS (
  SELECT doc_id, 'text' AS scope, -1 AS line, list_aggregate(list_filter(ls, lambda x: x <> ''), 'string_agg', ' ') AS form FROM canon
  UNION ALL
  SELECT doc_id, 'line', CAST(i - 1 AS INTEGER), ls[i] FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM canon)),
known AS (
  SELECT DISTINCT licence, list_aggregate(list_filter({lines}, lambda x: x <> ''), 'string_agg', ' ') AS form
  FROM (VALUES {values}) AS v(licence, t))
SELECT doc_id, scope, line, licence FROM forms JOIN known USING (form) WHERE form <> ''"""
