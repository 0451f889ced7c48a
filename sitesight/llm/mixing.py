"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources, in code-point order with null last, weigh 5, 2, 1, 5, ... and share all
   words; none gets more than ``REPEAT`` times what it has, and the excess goes to the others by
   weight.
2. Copies: every document of a source is taken as often as its target holds the whole source;
   the rest is filled with documents in hash order. Of the last ``ADJUST`` that fit and the next
   ``ADJUST`` that do not, those are taken that bring the source nearest to its target.
3. Blocks: the copies of a source are dealt by hash to a quota of blocks of about
   ``BLOCK_WORDS`` words, which lie in a permuted order.
4. Tree: the vector of block quotas is split between the halves of the output shards by a
   multivariate-hypergeometric draw, and so on down to single shards. Every node keeps its exact
   share, so the shards together hold each source's quota, and their block ranges are disjoint.
5. Each shard orders its rows by hash.

All draws are functions of the seed and of row keys. Sizes are words ``[^\\x20\\x09-\\x0D]+``; a
null text has 0. Rows that repeat id, source and text are one unit and share their takes. An
empty table, or one without words, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesight.workspace import keep

WEIGHTS = (5, 2, 1)
REPEAT = 3
BLOCK_WORDS, SHARD_WORDS = 65_536, 1_048_576
ADJUST = 64
_SPREAD = 2_147_483_647  # a prime above every block count, so that it permutes positions


def word_count(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def units(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each different (doc_id, source, text), with its size and how many rows repeat it."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text, text.isNull()).alias("text_key"), word_count(text).alias("size"))
    rows = rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("repeats"))
    return rows.withColumn("words", F.col("size") * F.col("repeats")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "text_key"))


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size, n_units, target): one row for each source of ``units``."""
    per = rows.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n_units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    per = per.withColumn("most", F.lit(float(repeat)) * F.col("source_size"))
    # sources reach their most in the order of most/weight; the first that does not fixes the rate
    reach = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = reach.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("rate", left / share).withColumn("open", F.col("rate") <= F.col("most") / F.col("weight"))
    rate = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("m"), F.col("source").isNull().alias("n"), "source", "rate"))).over(every)["rate"]
    target = F.when(F.col("open"), rate * F.col("weight")).otherwise(F.col("most"))
    return per.select("source", "source_size", "n_units", F.least(target, F.col("most")).alias("target"))


def _per_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.withColumnRenamed("source", "_s")
    return rows.join(named, rows["source"].eqNullSafe(named["_s"])).drop("_s")


def nearest_sum(words: np.ndarray, want: float) -> np.ndarray:
    """Which of ``words`` together come nearest to ``want``; sums are compared in 2^20 steps at most."""
    step = max(1, -(-int(words.sum()) // 2**20))
    sums = [1]  # bit k: a sum of k steps can be reached with the words so far
    for w in words:
        sums.append(sums[-1] | sums[-1] << int(w) // step)
    goal = max(0, round(want / step))
    below = (sums[-1] & ((1 << goal + 1) - 1)).bit_length() - 1
    above = sums[-1] >> goal
    above = goal + (above & -above).bit_length() - 1 if above else below
    at = above if abs(above * step - want) < abs(below * step - want) else below
    chosen = np.zeros(len(words), bool)
    for k in range(len(words) - 1, -1, -1):
        if not sums[k] >> at & 1:
            chosen[k] = True
            at -= int(words[k]) // step
    return chosen


def _adjusted(placed: DataFrame) -> DataFrame:
    """(source, doc_id, text_key, now): ``part`` anew for the units on either side of each source's border."""
    gap = placed.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("part"), F.col("words")).otherwise(0))).alias("gap"))
    order = Window.partitionBy("source", "part").orderBy(F.when(F.col("part"), -F.col("upto")).otherwise(F.col("upto")), "h", "doc_id", "text_key")
    near = placed.where("close and words > 0").select("source", F.col("doc_id").cast("string"), "text_key", "h", "words", "part", "upto")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ADJUST)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "n"])
        words = pdf["words"].to_numpy()
        now = nearest_sum(words, float(pdf["gap"].iloc[0]) + words[pdf["part"].to_numpy(bool)].sum())
        return pdf[["source", "doc_id", "text_key"]].assign(now=now)

    # ids go as text, since pandas would make floats of whole numbers beside a null
    chosen = _per_source(near, gap).groupBy("source").applyInPandas(choose, "source string, doc_id string, text_key long, now boolean")
    return chosen.withColumn("doc_id", F.col("doc_id").cast("long"))


def takes(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and ``times``, how often the mix takes each unit."""
    rows = _per_source(rows, sources)
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    u = F.col("h") / F.lit(2.0**64) + 0.5
    # as many slices as a slice has rows, so neither window below grows faster than the root of a source
    rows = keep(rows.withColumn("slice", F.floor(u * F.ceil(F.sqrt("n_units")))), "units")
    slices = rows.groupBy("source", "slice").agg(F.sum("words").alias("w"), F.first("rest").alias("rest"), F.first("n_units").alias("n"))
    ahead = F.sum("w").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    border = F.max(F.when(F.col("ahead") <= F.col("rest"), F.col("slice"))).over(Window.partitionBy("source"))
    close = F.abs(F.col("slice") - border) <= F.ceil(F.lit(ADJUST) / F.sqrt("n"))
    slices = slices.select(F.col("source").alias("_s"), F.col("slice").alias("_k"), "ahead", close.alias("close"))
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("words").over(inside)).join(slices, rows["source"].eqNullSafe(slices["_s"]) & (F.col("slice") == F.col("_k")))
    placed = placed.withColumn("upto", F.col("ahead") + F.col("upto")).withColumn("part", F.col("upto") <= F.col("rest"))
    placed = keep(placed.drop("_s", "_k", "ahead", "slice"), "prefix")
    best = keep(_adjusted(placed), "adjusted").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "now")
    hit = placed["source"].eqNullSafe(best["_s"]) & placed["doc_id"].eqNullSafe(best["_d"]) & (placed["text_key"] == best["_t"])
    placed = placed.join(best, hit, "left").withColumn("part", F.coalesce("now", "part")).drop("_s", "_d", "_t", "now", "upto", "close")
    return placed.withColumn("times", F.col("whole") + F.col("part").cast("long")).drop("whole", "rest", "part", "n_units")


def split_tree(quotas: DataFrame, shards: int, seed: int = 0, fan: int = 64) -> DataFrame:
    """(source, shard, low, n): how many blocks each shard draws of each source, from position ``low``.

    ``quotas``: (source, n), one row for each source. A node's draw takes its whole vector of
    quotas, so one task holds one row for each source; a level halves its ranges of shards until
    they are ``fan`` times narrower, and the nodes of a level are separate tasks.
    """

    def halves(rng, low, high, at, n, total, out, width):
        if high - low <= width:
            out.append((low, high, at, n))
            return
        middle = (low + high) // 2
        edge = lambda k: k * total // shards
        take = int(edge(middle) - edge(low))
        left = rng.multivariate_hypergeometric(n, take, method="marginals")
        halves(rng, low, middle, at, left, total, out, width)
        halves(rng, middle, high, at + left, n - left, total, out, width)

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        low, high, total = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), int(pdf["total"].iloc[0])
        rng, out = np.random.default_rng([seed, low, high]), []
        halves(rng, low, high, pdf["low"].to_numpy(), pdf["n"].to_numpy(), total, out, max(1, (high - low) // fan))
        return pd.concat([pdf.assign(lo=a, hi=b, low=at, n=n) for a, b, at, n in out]).query("n > 0")

    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    names = quotas.select("source", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.lit(0).cast("long").alias("low"), F.col("n").cast("long"), total.cast("long").alias("total"))
    width = shards
    while width > 1:
        names = names.groupBy("lo", "hi").applyInPandas(node, names.schema)
        width = max(1, width // fan)
        if shards > fan:
            names = keep(names, "tree")
    return names.select("source", F.col("lo").alias("shard"), "low", "n")


def placements(taken: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, source, text_key, size, repeats, copy, shard, place): a row for each time a unit is taken."""
    sizes = keep(taken.where("times > 0").groupBy("source").agg(F.ceil(F.sum(F.col("times") * F.col("words")) / block_words).alias("n")).where("n > 0"), "quotas")
    blocks = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, blocks * block_words // shard_words)
    drawn = split_tree(sizes, shards, seed)
    # every block of a shard's range is a row of its own, so the join below is on single blocks
    drawn = drawn.select(F.col("source").alias("_s"), "shard", F.explode(F.expr("sequence(low, low + n - 1)")).alias("_b"))
    copies = _per_source(taken.where("times > 0 and words > 0"), sizes).withColumn("copy", F.explode(F.expr("sequence(1, times)")))
    block = F.pmod(F.xxhash64("h", "copy"), F.col("n"))
    copies = copies.withColumn("block", F.pmod(block * _SPREAD + F.pmod(F.xxhash64(F.lit(seed), "source"), F.col("n")), F.col("n")))
    rows = copies.join(drawn, copies["source"].eqNullSafe(drawn["_s"]) & (F.col("block") == F.col("_b")))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "h", "copy"), "doc_id", "text_key", "copy")
    return rows.withColumn("place", F.row_number().over(order)).select("doc_id", "source", "text_key", "size", "repeats", "source_size", "target", "copy", "shard", "place")


def mix(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The units of ``docs`` with their sizes, targets and ``times``, and the placements of their copies."""
    rows = keep(units(docs, seed), "units")
    taken = keep(takes(rows, keep(source_targets(rows), "targets")), "taken")
    return taken, placements(taken, seed)


def per_document(docs: DataFrame, seed: int = 0) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target and ``taken``, the words of its placements."""
    taken, placed = mix(docs, seed)
    words = placed.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_key").alias("_t")).agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    same = taken["doc_id"].eqNullSafe(words["_d"]) & taken["source"].eqNullSafe(words["_s"]) & (taken["text_key"] == words["_t"])
    rows = taken.join(words, same, "left").withColumn("_n", F.explode(F.expr("sequence(1, repeats)")))
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double"), F.coalesce("taken", F.lit(0)).alias("taken"), "source", F.coalesce("copies", F.lit(0)).alias("copies"))


def mixed_corpus(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: the columns of ``docs`` for every copy, with copy, shard and place (which replace columns of these names)."""
    docs = docs.drop("copy", "shard", "place")
    _, placed = mix(docs, seed)
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__text", F.xxhash64(text, text.isNull()))
    at = keep(placed.select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("text_key").alias("__key"), "copy", "shard", "place"), "placed")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__text") == F.col("__key"))
    return keyed.join(at, same).drop("__text", "__doc", "__source", "__key")
