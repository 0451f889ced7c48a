"""Personal data: base patterns, and identifiers that bootstrapped contexts add. Built-in functions only.

Base spans are the leftmost non-overlapping matches of four expressions, less those that fail a
test (parts of an address, Luhn, number of digits). They are seeds. A fifth kind, ``secret``, has
seeds and no base spans: quoted literals of 20 or more letters and digits that follow ``=`` or ``:``.

An identifier-like token (it holds a digit or ``@``) is an instance. Its patterns are the two words
before it, the one before it, that one with the token's shape (``00-000`` is ``0-0``), and the word
after it, all within ``CONTEXT`` characters and not beyond the tokens beside it. Seeds have
confidence 1 for their kind. In each of ``ROUNDS`` rounds a pattern's score for a kind is the
summed confidence of its instances over their number plus one; patterns with at least ``SUPPORT``
confident instances and a score of ``SCORE`` are held, and an instance's confidence becomes the
chance that one of its held patterns is right. Tokens outside base spans that stand in a held
pattern of their kind, and whose confidence reaches ``SCORE``, are added as spans; the kind of the
best pattern wins, equal ones go to the kind listed first.

A null text is empty, a table without rows gives none. Rows that repeat id and text share their
result. Texts are read whole: positions are running sums over blocks and tokens meet spans in one
sorted pass, so the work on a text grows with its length. Positions are code points, ends are
exclusive. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesight.workspace import keep

ROUNDS, SUPPORT, SCORE, CONTEXT = 3, 5, 0.6, 64
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Elements of a block of running sums.
BLOCK = 64

# The base expressions. A match can only begin at a run's start or where the last match ended, and
# runs are taken whole; both leave the matches as they are and keep the scan linear.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_SECRET = r"^[\"'](?=[^\"']*[A-Za-z])(?=[^\"']*[0-9])[A-Za-z0-9_+/=-]{20,}[\"']"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(sizes: Column, levels: int = 3) -> Column:
    """Running sums of an array that is not empty: in blocks, after the running sums of the blocks' totals.

    An array that grows by one element is copied each time; only blocks and the topmost level do so.
    """
    none = F.array().cast("array<int>")
    grown = lambda block: F.aggregate(block, none, lambda a, v: F.concat(a, F.array(v + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
    if levels == 0:
        return grown(sizes)
    last = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: grown(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    total = lambda block: F.get(block, F.size(block) - 1)
    after = lambda block, end: F.transform(block, lambda v: v + end - total(block))
    return _with(cut, lambda blocks: F.flatten(F.zip_with(blocks, _with(F.transform(blocks, total), lambda t: _running(t, levels - 1)), after)))


def _found(text: Column, expression: str) -> Column:
    """Array of (start, end, gap, match, next): ``gap`` and ``next`` are the ends of the text between matches."""

    def placed(x: Column) -> Column:
        sizes = F.transform(x["matches"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))
        near = lambda side, i: F.call_function(side, F.get(x["gaps"], i), F.lit(CONTEXT))
        span = lambda ends: lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), near("right", i).alias("gap"), m.alias("match"), near("left", i + 1).alias("next"))
        some = _with(_with(sizes, lambda v: _running(v)), lambda ends: F.transform(x["matches"], span(ends)))
        return F.when(F.size(x["matches"]) > 0, some).otherwise(F.array().cast("array<struct<start:int,end:int,gap:string,match:string,next:string>>"))

    return _with(F.struct(F.split(text, expression, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("matches")), placed)


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, end, match) of the base matches of one kind that pass its test."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    size = lambda m: F.length(digits(m))
    hint, expression, good = {
        "email": (F.contains(text, F.lit("@")), _EMAIL, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), _IP, lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)),
        "card": (text.rlike(r"[0-9][\x20-]?[0-9]"), _CARD, lambda m: size(m).between(16, 19) & F.call_function("luhn_check", digits(m))),
        "phone": (F.contains(text, F.lit("+")), _PHONE, lambda m: size(m).between(8, 15)),
    }[kind]
    found = _found(text, expression)
    found = found if good is None else F.filter(found, lambda x: good(x["match"]))
    plain = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match")))
    return F.when(hint, plain).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, one array of spans for each kind, tokens): one row for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    tokens = F.when(F.col("text").rlike("[0-9@]"), _found(F.col("text"), _TOKEN)).otherwise(F.array().cast("array<struct<start:int,end:int,gap:string,match:string,next:string>>"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), *[_spans(F.col("text"), k).alias(k) for k in KINDS], tokens.alias("tokens"))


def occurrences(base: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, instance, kind, patterns): identifier-like tokens outside base spans and those that begin one.

    Kind is null but for seeds; a base seed's instance is the span's text. One sorted pass over a text's
    tokens and spans finds which spans begin in a token and which reach into it.
    """
    rows = base.where("size(tokens) > 0").dropDuplicates(["doc_id", "text_key"])
    tokens = rows.select("doc_id", "text_key", F.explode("tokens").alias("t")).select("doc_id", "text_key", F.lit(0).alias("o"), "t.*")
    numbered = lambda o: lambda s: F.struct(F.lit(o).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))
    spans = F.concat(*[F.transform(k, numbered(o + 1)) for o, k in enumerate(KINDS)])
    spans = rows.select("doc_id", "text_key", F.explode(spans).alias("s")).select("doc_id", "text_key", "s.*")
    so_far = Window.partitionBy("doc_id", "text_key").orderBy("start", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_token = F.col("o") == 0
    here = F.last(F.when(is_token, F.struct("start", "end")), ignorenulls=True).over(so_far)
    reach = F.max(F.when(~is_token, F.col("end"))).over(so_far)
    rows = tokens.unionByName(spans, allowMissingColumns=True).withColumns({"here": here, "reach": reach})
    rows = rows.where(is_token | (F.col("start") < F.col("here.end")))
    own = lambda c: F.max(F.when(is_token, F.col(c))).alias(c)
    rows = rows.groupBy("doc_id", "text_key", F.col("here.start").alias("start")).agg(
        *[own(c) for c in ("end", "gap", "match", "next")], F.max(is_token & (F.col("reach") > F.col("start"))).alias("inside"),
        F.min(F.when(~is_token, F.struct("o", "start", "end", "match"))).alias("seed"))
    lead = F.length("match") - F.length(F.regexp_replace("match", r"^[^\p{L}\p{N}+@]+", ""))
    core = F.regexp_replace(F.regexp_replace("match", r"^[^\p{L}\p{N}+@]+", ""), r"[^\p{L}\p{N}]+$", "")
    secret = F.when(F.col("match").rlike(_SECRET) & F.col("gap").rlike(r"[=:]\s*$"), "secret")
    kind = F.when(F.col("seed").isNotNull(), F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("seed.o") - 1)).otherwise(F.when(~F.coalesce("inside", F.lit(False)), secret))
    rows = rows.where("(seed is not null or not coalesce(inside, false))").select(
        "doc_id", "text_key", (F.col("start") + lead).alias("start"), F.col("end").alias("stop"), "gap", "next", core.alias("core"), "seed", kind.alias("kind")).where("core <> ''")
    lower = lambda c, p: F.lower(F.trim(F.regexp_replace(F.regexp_extract(c, p, 0), r"\s+", " ")))
    two, one = lower("gap", r"(?<!\S)\S++\s++\S++\s*+$"), lower("gap", r"(?<!\S)\S++\s*+$")
    whole = F.col("seed").isNull() | (F.col("seed.end") <= F.col("stop"))
    right = F.when(whole, lower("next", r"^\s*+\S++(?=\s)"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("seed.match", "core"), "[0-9]+", "0"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    named = lambda mark, *parts: F.when(parts[0] != "", F.concat(F.lit(mark), *parts))
    patterns = F.array_compact(F.array(named("2 ", two), named("1 ", one), named("s ", one, F.lit(" "), F.call_function("left", shape, F.lit(CONTEXT))), named("> ", right)))
    return rows.select("doc_id", "text_key", "start", (F.col("start") + F.length("core")).alias("end"), F.coalesce("seed.match", "core").alias("instance"), "kind", patterns.alias("patterns"))


def discovered(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, score: float = SCORE) -> DataFrame:
    """(doc_id, text_key, kind, start, end): tokens that are no base spans, by the scores of their patterns."""
    each = found.select("doc_id", "text_key", "start", "end", "instance", "kind", F.explode("patterns").alias("pattern"))
    edges = keep(each.select("pattern", "instance").distinct(), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = keep(found.where("kind is not null").select("instance", "kind").distinct().withColumn("conf", F.lit(1.0)), "seeds")
    held, conf = None, seeds
    for _ in range(rounds):
        scored = edges.join(conf, "instance").groupBy("pattern", "kind").agg(F.sum("conf").alias("s"), F.sum((F.col("conf") >= score).cast("int")).alias("k"))
        scored = scored.where(F.col("k") >= support).join(sizes, "pattern").withColumn("score", F.col("s") / (F.col("n") + 1)).where(F.col("score") >= score)
        held = keep(scored.select("pattern", "kind", "score"), "patterns")
        chance = 1 - F.exp(F.sum(F.log(1 - F.col("score"))))
        new = edges.join(held, "pattern").groupBy("instance", "kind").agg(chance.alias("conf"))
        conf = keep(seeds.union(new).groupBy("instance", "kind").agg(F.max("conf").alias("conf")), "confidence")
    sure = conf.where(F.col("conf") >= score).select("instance", "kind")
    hits = each.where("kind is null or kind = 'secret'").drop("kind").join(held, "pattern").join(sure, ["instance", "kind"])
    rank = F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), F.col("kind"))
    best = hits.groupBy("doc_id", "text_key", "start", "end").agg(F.max_by("kind", F.struct("score", -rank)).alias("kind"))
    return best.select("doc_id", "text_key", "kind", "start", "end")


def _of_kind(order: int, kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(order).alias("o"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans, n_added, n_spans) of each row of ``docs``; counts of kinds are of base spans."""
    base = keep(base_spans(docs), "base")
    more = discovered(keep(occurrences(base), "tokens"))
    order = F.array(*[F.lit(k) for k in ALL_KINDS])
    item = F.struct(F.array_position(order, F.col("kind")).cast("int").alias("o"), "start", "end", "kind")
    more = more.groupBy("doc_id", "text_key").agg(F.collect_set(item).alias("added"))
    more = keep(more.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "added"), "added")
    rows = base.drop("tokens").join(more, base["doc_id"].eqNullSafe(more["_d"]) & (base["text_key"] == more["_t"]), "left")
    own = F.concat(*[_of_kind(i + 1, k) for i, k in enumerate(KINDS)])
    added = F.coalesce("added", F.array().cast("array<struct<o:int,start:int,end:int,kind:string>>"))
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(own), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(own, added))).alias("spans"), F.size(added).cast("long").alias("n_added"),
        (F.size(own) + F.size(added)).cast("long").alias("n_spans"))
