"""Near-duplicate lines: a segment-partition edit join with built-in functions only.

Two lines are linked when their edit distance is at most ``EDITS`` = 1. A line is cut into
``EDITS`` + 1 = 2 segments; two linked lines share one of them unchanged, in front of or behind
the edit. A line offers its own two segments (indexed by its length) and, for partners that are
one character shorter, the substrings that lie where their segments would lie. Pairs that share
an entry are verified by a banded bit-parallel edit distance.

A segment that more than ``BUCKET`` different lines share (a template) is not expanded into
pairs: the part outside the segment is cut into ``FAN`` pieces, lines that agree in all pieces
but one meet again, and so on, until a bucket is small or the open piece is one character, where
all members are linked to the first. That is exact at any bucket size.

Lines are split at line feeds and compared without leading and trailing blanks. Lines of fewer
than ``MIN_CHARS`` characters take no part and stay. Of each class of linked lines the first
occurrence stays (by document id, null first, then place); the others are dropped. A document is
an id and a text: rows that repeat both share their result. Null texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesight.llm.common import components, small
from sitesight.workspace import keep

EDITS = 1
MIN_CHARS = 20
BUCKET, FAN = 64, 8


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    line = F.trim("raw")
    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .select("doc_id", "text_key", "pos", line.alias("line"))
        .where(F.length("line") >= min_chars)
        .withColumn("id", F.xxhash64("line"))
    )


def _left(s: str, n: Column) -> Column:
    return F.substring(s, F.lit(1), n)


def _right(s: str, n: Column) -> Column:
    return F.when(n > 0, F.substring(F.col(s), F.length(s) - n + 1, n)).otherwise("")


def _half_keys() -> Column:
    """Own segments 0 and 1, then the substrings to probe for lines one character shorter."""
    keys = []
    for shorter in (0, 1):
        m = F.length("line") - shorter
        h = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(m, F.lit(0), _right("line", m - h)), F.xxhash64(m, F.lit(1), _left("line", h))]
    return F.array(*keys)


def within_one_edit(a: Column, b: Column) -> Column:
    """Banded bit-parallel test; ``a`` is not longer than ``b``, and at most one character shorter.

    Three bits stand for the diagonals -1, 0, +1; ``s`` packs those reached without an edit
    (low bits) and with at most one (high bits). A step takes one character of ``b``.
    """
    x, y = F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0)), F.regexp_extract_all(b, F.lit("(?s)."), F.lit(0))
    # one row per character of b with its neighbours in a, so that the lambda holds no array
    behind = F.slice(F.concat(F.array(F.lit(None).cast("string")), x), 1, F.size(y))
    rows = F.arrays_zip(y.alias("c"), behind.alias("d0"), x.alias("d1"), F.slice(x, 2, F.size(y)).alias("d2"))

    def step(s: Column, row: Column) -> Column:
        band = sum((F.when(row[f"d{k}"] == row["c"], F.lit(1 << k)).otherwise(0) for k in range(3)), F.lit(0))
        d0, d1 = s.bitwiseAND(7), F.shiftright(s, 3)
        free = d0.bitwiseAND(band)
        one = d1.bitwiseAND(band).bitwiseOR(d0).bitwiseOR(F.shiftright(d0, 1)).bitwiseOR(F.shiftleft(free, 1)).bitwiseAND(7)
        return free + F.shiftleft(one, 3)

    reached = F.aggregate(rows, F.lit(0b110_010), step, lambda s: s.bitwiseOR(F.shiftright(s, 3)))
    return F.call_function("shiftright", reached, F.length(a) - F.length(b) + 1).bitwiseAND(1) == 1


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (key, id, own) that share a key, at least one by its own segment."""
    left = rows.where("own").select("key", F.col("id").alias("a"))
    right = rows.select("key", F.col("id").alias("b"), F.col("own").alias("own_b"))
    return left.join(right, "key").where("a < b or (not own_b and a <> b)").select("a", "b")


def _met(rows: DataFrame) -> DataFrame:
    """(key, size) of the keys under which different lines meet, one of them by an own segment."""
    found = rows.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.max("own").alias("o"), F.count("*").alias("size"))
    return found.where("x < y and o").select("key", "size")


def _refined(rows: DataFrame) -> list[DataFrame]:
    """Pairs from large buckets; rows (key, id, own, m, rest): ``rest`` is the part not yet compared, ``m`` its length in the shorter partner."""
    out = []
    while not rows.isEmpty():
        single = rows.where("m <= 1")
        centre = single.where("own").groupBy("key").agg(F.min("id").alias("b"))
        out.append(single.where("own").join(centre, "key").where("id <> b").select(F.col("id").alias("a"), "b"))
        chars = single.withColumn("c", F.explode(F.when(F.col("own"), F.array("rest")).otherwise(
            F.array(F.substring("rest", 1, 1), F.substring("rest", 2, 1)))))
        centre = chars.where("own").groupBy("key", "c").agg(F.min("id").alias("b"))
        out.append(chars.where("not own").join(centre, ["key", "c"]).where("id <> b").select(F.col("id").alias("a"), "b"))
        n = F.least(F.lit(FAN), F.col("m"))
        cut = rows.where("m > 1").withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
        cut = cut.withColumn("p", F.floor(F.col("i") * F.col("m") / F.col("n")).cast("int")).withColumn(
            "e", F.floor((F.col("i") + 1) * F.col("m") / F.col("n")).cast("int"))
        back = F.col("m") - F.col("e")
        cut = cut.select(
            F.xxhash64("key", "i", _left("rest", F.col("p")), _right("rest", back)).alias("key"), "id", "own",
            (F.col("e") - F.col("p")).alias("m"),
            F.substring(F.col("rest"), F.col("p") + 1, F.length("rest") - F.col("p") - back).alias("rest"),
        )
        cut = keep(cut, "cut")
        met = keep(_met(cut), "met")
        out.append(_pairs(cut.join(met.where(F.col("size") <= BUCKET), "key", "left_semi")))
        rows = keep(cut.join(met.where(F.col("size") > BUCKET), "key", "left_semi"), "open")
    return out


def linked_lines(docs: DataFrame, lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b): ids of lines of ``docs`` within one edit of each other, enough of them to join every class."""
    entries = lines.select(F.posexplode("keys").alias("slot", "key"), "id")
    entries = entries.select("key", "id", (F.col("slot") < 2).alias("own"), (F.col("slot") % 2).alias("i"))
    met = keep(_met(entries), "met")
    rows = keep(entries.join(small(met.select("key")), "key", "left_semi").distinct(), "entries")
    size = keep(rows.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    ids = keep(rows.select("id").distinct(), "ids")
    texts = _lines(docs, min_chars).select("id", "line").join(small(ids), "id", "left_semi")
    texts = keep(texts.groupBy("id").agg(F.min("line").alias("line")), "lines")

    pairs = _pairs(rows.join(size.where(F.col("size") <= BUCKET), "key", "left_semi"))
    large = rows.join(size.where(F.col("size") > BUCKET), "key", "left_semi")
    m = F.length("line") - (~F.col("own")).cast("int")
    h = F.floor(m / 2).cast("int")
    opened = large.join(texts, "id").select(
        "key", "id", "own", F.when(F.col("i") == 0, h).otherwise(m - h).alias("m"),
        F.when(F.col("i") == 0, _left("line", F.length("line") - (m - h))).otherwise(F.substring(F.col("line"), h + 1, F.length("line"))).alias("rest"),
    )
    for more in _refined(keep(opened, "open")):
        pairs = pairs.unionByName(more)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    swap = F.length("la") > F.length("lb")
    both = both.select("a", "b", F.when(swap, F.col("lb")).otherwise(F.col("la")).alias("s"), F.when(swap, F.col("la")).otherwise(F.col("lb")).alias("t"))
    return both.where((F.length("t") - F.length("s") <= EDITS) & within_one_edit(F.col("s"), F.col("t"))).select("a", "b")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``n_lines`` and ``dropped``, the sorted places of lines to drop.

    Columns of ``docs`` with these two names are replaced.
    """
    docs = docs.drop("n_lines", "dropped")
    narrow = _lines(docs, min_chars).select("doc_id", "text_key", "pos", "id", _half_keys().alias("keys"))
    lines = keep(narrow, "line-keys")
    labels = components(linked_lines(docs, lines, min_chars))
    places = ["doc_id", "text_key", "pos"]
    classed = lines.select(*places, "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    first = classed.groupBy(F.coalesce("label", "id").alias("class")).agg(F.min(F.struct(*places)).alias("f")).select("f.*")
    same = [lines["text_key"] == first["text_key"], lines["pos"] == first["pos"], lines["doc_id"].eqNullSafe(first["doc_id"])]
    gone = lines.select(*places).join(first, same, "left_anti").groupBy(*places[:2]).agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    gone = keep(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key"), "dropped"), "gone")
    text = F.col("text").cast("string")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    return (
        docs.withColumn("n_lines", n_lines)
        .join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_key")), "left")
        .withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
        .drop("__gone_id", "__gone_key")
    )


def kept_text(text: str = "text") -> Column:
    """The text without its dropped lines; null texts stay null."""
    lines = F.split(F.col(text), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("dropped"))
    return F.when(F.size("dropped") == 0, F.col(text)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
