"""Operators on a long draws table: keys, ``chain``, ``draw`` (1, 2, ... per chain), ``value``.

``keys`` names what a posterior belongs to, for example ``["param"]`` or
``["param", "region", "municipality", "site_id"]``. Leaving ``chain`` out pools the chains.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sitesight.functions.scalars import half_even, interval_text, ratio
from sitesight.operators.ordering import (
    SLICE_ROWS,
    cumulative,
    quantiles_of,
    row_numbers,
    running_sum,
    same_keys,
)
from sitesight.workspace import keep, only_reads, spread_by

def arrays_to_long(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per array element; its position becomes ``draw``."""
    return df.select(*keys, F.posexplode(column).alias("_pos", "value")).select(
        *keys, (F.col("_pos") + 1).cast("bigint").alias("draw"), F.col("value").cast("double").alias("value")
    )


def columns_to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (row, column); the column name becomes ``param``."""
    return df.unpivot(list(keys), list(columns), "param", "value")


def params(draws: DataFrame, key: str = "param") -> DataFrame:
    return draws.select(key).distinct()


def only_params(draws: DataFrame, names: Sequence[str], key: str = "param") -> DataFrame:
    return draws.where(F.col(key).isin(list(names)))


def thin(draws: DataFrame, burn: int = 0, every: int = 1) -> DataFrame:
    """Drop the first ``burn`` draws of each chain, keep every ``every``-th, renumber."""
    after = F.col("draw") - burn
    return draws.where((after > 0) & (after % every == 0)).withColumn("draw", F.floor(after / every).cast("bigint"))


def moments(draws: DataFrame, keys: Sequence[str], sample: bool = False) -> DataFrame:
    """Mean and standard deviation; ``sample`` divides by n - 1."""
    sd = F.stddev_samp if sample else F.stddev_pop
    return draws.groupBy(*keys).agg(F.avg("value").alias("mean"), sd("value").alias("sd"))


#: Positions of one bucket in which the two ends of intervals meet.
BUCKET = 32


def hdi_of(placed: DataFrame, keys: Sequence[str], mass: float, lo: str = "hdi_lo", hi: str = "hdi_hi") -> DataFrame:
    """``hdi`` from a (kept) table of ``ordering.cumulative``.

    Only the first n - k positions can begin an interval and only the last n - k can end one. A value
    that begins one looks for the value k positions on: both are dealt to buckets of ``BUCKET``
    positions, so the join spreads over (key, bucket) whatever the size of a key, and the narrowest
    pair is a map-side combined minimum.
    """
    keys = list(keys)
    reach = F.least(F.floor(F.col("total") * F.lit(float(mass))), F.col("total") - 1)
    start = F.col("upto") - F.col("n") + 1
    low = placed.where(start <= F.col("total") - reach).select(*keys, F.col("v").alias("_a"), (start + reach).alias("_at"))
    low = low.withColumn("_bucket", F.floor((F.col("_at") - 1) / BUCKET))
    first, last = (F.floor((p - 1) / BUCKET) for p in (F.greatest(start, reach + 1), F.col("upto")))
    high = placed.where(F.col("upto") > reach).select(
        *keys, F.col("v").alias("_b"), start.alias("_from"), F.col("upto").alias("_to"), F.explode(F.sequence(first, last)).alias("_bucket")
    )
    found = same_keys(low, high, [*keys, "_bucket"]).where("_at between _from and _to")
    best = found.groupBy(*keys).agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("w"), F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("_best"))
    return best.select(*keys, F.col("_best.a").alias(lo), F.col("_best.b").alias(hi))


def placed_values(draws: DataFrame, keys: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The distinct values of each key with their counts and positions, written once for several uses."""
    return keep(cumulative(draws, list(keys), "value", slice_rows), "placed")


def hdi(
    draws: DataFrame, keys: Sequence[str], mass: float, lo: str = "hdi_lo", hi: str = "hdi_hi", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Shortest interval that holds ``mass`` of the draws of a key.

    With the draws in order and ``k = floor(mass * n)`` it is the pair (x[i], x[i+k]) of
    least width, the lowest pair on ties. Null values do not count.
    """
    return hdi_of(placed_values(draws, keys, slice_rows), keys, mass, lo, hi)


#: Draws of whole keys that one task sorts.
TASK_DRAWS = 2_000_000


def summary_of_blocks(blocks: DataFrame, keys: Sequence[str], n_draws: int, mass: float = 0.95, sample_sd: bool = False) -> DataFrame:
    """``posterior_summary`` of draws that come in arrays: ``value`` is an array, and a key has one or more rows.

    For keys with a bounded number of draws each, as chains * draws, of which there may be any number.
    The arrays are shuffled once and a key's draws are sorted as one array. ``n_draws``, about the
    number of all draws, says over how many tasks.
    """
    keys = list(keys)
    holes = blocks.schema["value"].dataType.containsNull
    known = blocks.select(*keys, (F.filter("value", lambda v: v.isNotNull()) if holes else F.col("value")).alias("_x"))
    met = spread_by(known, n_draws, TASK_DRAWS, *keys).groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("_x"))).alias("_x"))
    n = F.size("_x")
    mean = F.aggregate("_x", F.lit(0.0), lambda total, v: total + v) / n
    reach = F.least(F.floor(n * F.lit(float(mass))).cast("int"), n - 1)
    ends = [F.slice("_x", start, n - reach) for start in (F.lit(1), reach + 1)]
    pairs = F.zip_with(*ends, lambda a, b: F.struct((b - a).alias("w"), a.alias("a"), b.alias("b")))
    placed = met.where(n > 0).select(*keys, "_x", mean.alias("mean"), F.array_min(pairs).alias("_best"))
    squares = F.aggregate("_x", F.lit(0.0), lambda total, v: total + (v - F.col("mean")) * (v - F.col("mean")))
    sd = F.sqrt(F.try_divide(squares, n - 1) if sample_sd else squares / n)
    return placed.select(*keys, "mean", sd.alias("sd"), F.col("_best.a").alias("hdi_lo"), F.col("_best.b").alias("hdi_hi"))


def _packed(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, value): known draws of a key that lie near each other, as one array of ``n``. Nothing is shuffled."""
    keys = list(keys)
    rows = draws.where("value is not null").select(*keys, "value")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for k in keys:
                own = batch.column(k).dictionary_encode(null_encoding="encode")
                if code.max() > 1 << 31:
                    code = np.unique(code, return_inverse=True)[1]
                code = code * len(own.dictionary) + own.indices.to_numpy()
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            if len(np.unique(code[starts])) < len(starts):  # some key has more than one run
                order = np.argsort(code, kind="stable")
                batch, code = batch.take(pa.array(order)), code[order]
                starts = np.flatnonzero(np.diff(code, prepend=-1))
            ends = np.append(starts[1:], len(code)).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.append(np.int32(0), ends), batch.column("value"))
            shown = [batch.column(k).take(pa.array(starts)) for k in keys]
            yield pa.RecordBatch.from_arrays([*shown, pa.array(ends - starts, pa.int32()), lists], [*keys, "n", "value"])

    schema = rows.select(*keys).schema.add("n", IntegerType()).add("value", ArrayType(rows.schema["value"].dataType, False))
    return rows.mapInArrow(pack, schema)


def posterior_summary(
    draws: DataFrame, keys: Sequence[str], mass: float = 0.95, sample_sd: bool = False, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Mean, standard deviation and highest-density interval per key.

    Draws are made once: they are packed into arrays where they lie and written. A key with at most
    ``slice_rows`` draws is sorted as one array; the draws of a larger one are placed in slices.
    """
    keys = list(keys)
    ends = [*keys, "hdi_lo", "hdi_hi"]
    packed = keep(_packed(draws, keys), "packed")
    unpacked = lambda t: t.select(*keys, F.explode("value").alias("value"))
    sizes = packed.groupBy(*keys).agg(F.sum("n").alias("_n"))
    n_draws, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if most <= slice_rows:
        found = summary_of_blocks(packed, keys, n_draws, mass).select(*ends)
    else:
        large = keep(sizes.where(F.col("_n") > slice_rows), "large_keys")
        small = summary_of_blocks(same_keys(packed, large, keys, "left_anti"), keys, n_draws, mass).select(*ends)
        found = small.unionByName(hdi(unpacked(same_keys(packed, large, keys, "left_semi")), keys, mass, slice_rows=slice_rows))
    return same_keys(moments(draws if only_reads(draws) else unpacked(packed), keys, sample_sd), found, keys)


# The quantiles of a standard chain summary.
SUMMARY_QUANTILES = {"q2_5": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q97_5": 0.975}


def quantile_summary(draws: DataFrame, keys: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Mean, sample standard deviation and five quantiles per key."""
    return same_keys(
        moments(draws, keys, sample=True),
        quantiles_of(cumulative(draws, keys, "value", slice_rows), keys, SUMMARY_QUANTILES),
        list(keys),
    )


def approximate_quantiles(draws: DataFrame, keys: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """The five quantiles from a mergeable sketch: one pass, no ordering."""
    return draws.groupBy(*keys).agg(
        *[F.percentile_approx("value", F.lit(p), F.lit(accuracy)).alias(n) for n, p in SUMMARY_QUANTILES.items()]
    )


def ranks_of_quantiles(draws: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, quantile, asked, n, below, at_most): the shares of draws below and not above each quantile in ``found``.

    ``found`` has a row per key and the columns of ``SUMMARY_QUANTILES``. One aggregate with a fixed number of
    counters per key; null draws are left out.
    """
    names = list(SUMMARY_QUANTILES)
    counters = [F.count_if(F.col("value") < F.col(n)).alias(f"below_{n}") for n in names]
    counters += [F.count_if(F.col("value") <= F.col(n)).alias(f"at_most_{n}") for n in names]
    counted = draws.where("value is not null").select(*keys, "value").join(found.select(*keys, *names), list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), *counters)
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("quantile"), F.lit(p).alias("asked"), (F.col(f"below_{n}") / F.col("n")).alias("below"), (F.col(f"at_most_{n}") / F.col("n")).alias("at_most"))
        for n, p in SUMMARY_QUANTILES.items()
    ]))
    return counted.select(*keys, "n", rows.alias("_q")).select(*keys, "_q.quantile", "_q.asked", "n", "_q.below", "_q.at_most")


def neighbour_pairs(draws: DataFrame, key: str) -> DataFrame:
    """(better, worse): each key with the next lower one by mean."""
    means = keep(draws.groupBy(key).agg(F.bround(F.avg("value"), 9).alias("_m")), "means")
    placed = keep(row_numbers(means, [], ["-_m", key], "_pos"), "placed")
    return placed.select(F.col(key).alias("better"), (F.col("_pos") + 1).alias("_pos")).join(
        placed.select(F.col(key).alias("worse"), "_pos"), "_pos"
    ).select("better", "worse")


def prob_greater(draws: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Share of paired draws in which the first key of a pair exceeds the second.

    ``pairs`` has columns ``better`` and ``worse``: the comparisons that are asked for.
    Each draw is tagged with the comparisons it takes part in and the two values of a
    comparison meet in one aggregate on (pair, chain, draw); no draw is joined to a draw.
    """
    roles = keep(
        pairs.select(
            "better", "worse",
            F.explode(
                F.array(
                    F.struct(F.col("better").alias("_who"), F.lit(True).alias("_first")),
                    F.struct(F.col("worse").alias("_who"), F.lit(False).alias("_first")),
                )
            ).alias("_r"),
        ).select("better", "worse", "_r._who", "_r._first"),
        "pairs",
    )
    met = (
        draws.join(roles, draws[key] == roles["_who"])
        .groupBy("better", "worse", "chain", "draw")
        .agg(
            F.max(F.when(F.col("_first"), F.col("value"))).alias("_a"),
            F.max(F.when(~F.col("_first"), F.col("value"))).alias("_b"),
        )
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    )
    return met.groupBy("better", "worse").agg(
        F.count(F.lit(1)).alias("draws"), F.avg((F.col("_a") > F.col("_b")).cast("double")).alias("prob")
    )


def estimates_on_rows(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Input rows with the posterior mean and interval beside the raw rate."""
    joined = rows.join(keep(summary, "summary"), list(keys), "left")
    return joined.withColumn("raw_rate", ratio(F.col("successes"), F.col("tests")))


def parameter_report(draws: DataFrame, keys: Sequence[str], mass: float = 0.94, digits: int = 3) -> DataFrame:
    """Report line per key: rounded mean and sd, interval as text."""
    s = posterior_summary(draws, keys, mass, sample_sd=True)
    return s.select(
        *keys,
        half_even(F.col("mean"), digits).alias("mean"),
        half_even(F.col("sd"), digits).alias("std_dev"),
        interval_text(F.col("hdi_lo"), F.col("hdi_hi"), digits).alias("hdi_interval"),
    )


def forest(draws: DataFrame, keys: Sequence[str], mass: float = 0.94, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Point, quartiles and interval per key, lowest mean first."""
    keys = list(keys)
    placed = placed_values(draws, keys, slice_rows)
    box = quantiles_of(placed, keys, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    whole = same_keys(moments(draws, keys), hdi_of(placed, keys, mass), keys)
    return same_keys(whole, box, keys).orderBy("mean", *keys)


def histogram(draws: DataFrame, keys: Sequence[str], bins: int = 20, mass: float = 0.95) -> DataFrame:
    """Counts per equal-width bin of each key, with the key's interval."""
    keys = list(keys)
    limits = keep(
        same_keys(
            draws.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")),
            hdi(draws, keys, mass),
            keys,
        ),
        "limits",
    )
    width = F.col("_hi") - F.col("_lo")
    spot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("value") - F.col("_lo"), width) * bins))
    )
    return (
        same_keys(draws, limits, keys)
        .groupBy(*keys, "hdi_lo", "hdi_hi", "_lo", "_hi", spot.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "bin", (F.col("_lo") + F.col("bin") * width / bins).alias("bin_from"), "n", "hdi_lo", "hdi_hi")
    )


def rank_histogram(
    draws: DataFrame, keys: Sequence[str], bins: int = 20, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """How evenly the chains share the pooled ranks: counts per (key, chain, rank bin)."""
    keys = list(keys)
    one = draws.select(*keys, "chain", "draw", "value").withColumn("_one", F.lit(1))
    placed = running_sum(one, keys, ["value", "chain", "draw"], "_one", "_rn", "_n", slice_rows)
    return (
        placed.withColumn("bin", F.floor((F.col("_rn") - 1) * bins / F.col("_n")).cast("bigint"))
        .groupBy(*keys, "chain", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def trace_series(
    draws: DataFrame, keys: Sequence[str], every: int = 1, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Value and running mean by draw and chain; ``every`` thins the shown points only."""
    rows = draws.select(*keys, "chain", "draw", "value")
    summed = running_sum(rows, [*keys, "chain"], ["draw"], "value", "_sum", slice_rows=slice_rows)
    return summed.withColumn("running_mean", F.col("_sum") / F.col("draw")).where(F.col("draw") % every == 0).drop("_sum")
