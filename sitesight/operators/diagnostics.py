"""Convergence and size diagnostics of chains: R-hat, effective size, draws needed, DIC.

Chains are cut into blocks of consecutive draws. A block also carries the few draws of
its neighbour that a lag reaches into, so a chain of any length is many bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesight.functions.scalars import log_binomial, logit, normal_quantile
from sitesight.functions.special import f_quantile
from sitesight.operators.draws import hdi_of, placed_values
from sitesight.operators.ordering import SLICE_ROWS, quantiles, quantiles_of, running_sum, same_keys
from sitesight.workspace import keep

BLOCK = 1 << 15


def rhat(draws: DataFrame, keys: Sequence[str], split: bool = False) -> DataFrame:
    """Potential scale reduction from the chain means and variances.

    ``split`` treats the halves of a chain as chains of their own, which also shows drift.
    """
    keys = list(keys)
    part = [*keys, "chain"]
    if split:
        length = keep(draws.groupBy(*part).agg(F.max("draw").alias("_len")), "length")
        draws = same_keys(draws, length, part).withColumn(
            "_half", (F.col("draw") > F.floor(F.col("_len") / 2)).cast("int")
        )
        part = [*part, "_half"]
    chains = draws.groupBy(*part).agg(
        F.avg("value").alias("_m"), F.var_samp("value").alias("_v"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    return (
        chains.groupBy(*keys)
        .agg(F.avg("_v").alias("_w"), F.var_samp("_m").alias("_b"), F.avg("_n").alias("_n"))
        .withColumn(
            "rhat",
            F.sqrt(F.try_divide((F.col("_n") - 1) / F.col("_n") * F.col("_w") + F.col("_b"), F.col("_w"))),
        )
        .select(*keys, "rhat")
    )


def rhat_limits(draws: DataFrame, keys: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Scale reduction corrected for the degrees of freedom of the pooled variance, and its upper limit.

    The variance of the pooled variance comes from the chains' variances and means and how they vary
    together; the limit takes the ratio of between- and within-chain variance at the upper end of its
    F distribution.
    """
    keys = list(keys)
    chains = draws.where("value is not null").groupBy(*keys, "chain").agg(
        F.avg("value").alias("_x"), F.var_samp("value").alias("_v"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    facts = chains.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.avg("_n").alias("n"), F.avg("_v").alias("w"), F.var_samp("_x").alias("b"),
        F.var_samp("_v").alias("vv"), F.avg("_x").alias("x"), F.covar_samp("_v", F.col("_x") * F.col("_x")).alias("vx2"), F.covar_samp("_v", "_x").alias("vx"),
    )
    m, n, w, b = (F.col(c) for c in ("m", "n", "w", "b"))
    scale = 1 + 1 / m
    pooled = (n - 1) / n * w + scale * b
    noise = (
        F.pow(n - 1, F.lit(2.0)) * F.col("vv") / m + F.pow(scale * n * b, F.lit(2.0)) * F.try_divide(F.lit(2.0), m - 1)
        + 2 * (n - 1) * scale * (n / m) * (F.col("vx2") - 2 * F.col("x") * F.col("vx"))
    ) / (n * n)
    df = F.try_divide(2 * pooled * pooled, noise)
    adjust = F.coalesce(F.try_divide(df + 3, df + 1), F.lit(1.0))

    @F.pandas_udf("double")
    def limit(d1: pd.Series, d2: pd.Series) -> pd.Series:
        ok = (d1 > 0) & (d2 > 0)
        return pd.Series(f_quantile((1 + confidence) / 2, d1.where(ok, 1.0), d2.where(ok, 1.0))).where(ok)

    share = F.try_divide(scale * b, w)
    return facts.select(
        *keys, (m - 1).alias("df_between"), F.try_divide(2 * w * w * m, F.col("vv")).alias("df_within"),
        F.sqrt(adjust * ((n - 1) / n + share)).alias("rhat_adjusted"), ((n - 1) / n).alias("_fixed"), share.alias("_random"), adjust.alias("_adjust"),
    ).withColumn(
        "rhat_upper", F.sqrt(F.col("_adjust") * (F.col("_fixed") + limit("df_between", "df_within") * F.col("_random")))
    ).drop("_fixed", "_random", "_adjust")


def rhat_multivariate(draws: DataFrame, keys: Sequence[str], names: Sequence[str], of: str = "param") -> DataFrame:
    """Scale reduction of the worst linear combination of the parameters ``names`` (values of column ``of``).

    Draws of one (chain, draw) meet in one row; covariances are summed in the tasks, so what comes
    together for a key is one small matrix for each chain. Draws that lack a parameter do not count.
    """
    keys, names = list(keys), list(names)
    p, spots = len(names), [f"_x{k}" for k in range(len(names))]
    rows = draws.where(F.col(of).isin(names)).groupBy(*keys, "chain", "draw").agg(
        *[F.max(F.when(F.col(of) == name, F.col("value"))).alias(x) for name, x in zip(names, spots)]
    ).dropna(subset=spots)
    covariances = [F.covar_samp(spots[i], spots[j]) for i in range(p) for j in range(p)]
    chains = rows.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(x) for x in spots]).alias("_m"), F.array(*covariances).alias("_c"))

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = len(pdf), float(pdf["_n"].mean())
        within = np.mean([np.asarray(c, dtype=float).reshape(p, p) for c in pdf["_c"]], axis=0)
        value = None
        if m > 1 and np.isfinite(within).all() and np.linalg.matrix_rank(within) == p:
            between = np.cov(np.stack(pdf["_m"].to_numpy()).astype(float), rowvar=False).reshape(p, p)
            half = np.linalg.inv(np.linalg.cholesky(within))
            value = float(np.sqrt((n - 1) / n + (1 + 1 / m) * np.linalg.eigvalsh(half @ between @ half.T)[-1]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "chains": [m], "rhat_multivariate": [value]})

    types = dict(draws.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["chains int", "rhat_multivariate double"])
    return chains.withColumn("_all", F.lit(0)).groupBy("_all", *keys).applyInPandas(reduce, schema)


def _blocks(draws: DataFrame, size: int, reach: int, at: str = "draw") -> DataFrame:
    """Every draw in its block, and the first ``reach`` draws of a block also in the one before."""
    home = F.floor((F.col(at) - 1) / size)
    offset = (F.col(at) - 1) % size
    homes = F.when((offset < reach) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    return draws.withColumn("_home", home).withColumn("_block", F.explode(homes))


def _lag_products(names: Sequence[str], keys: Sequence[str], whole: bool):
    """Sums of x[t] * x[t + lag] over one block, by the product of the spectra of the block and of it with the next.

    A block sends the lags up to four times the one where its own positive pairs end, or all it has if
    ``whole``; lags that some block of a chain did not send are not used.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        own = int((pdf["_home"] == pdf["_block"]).sum())
        n, length = len(pdf), float(pdf["_length"].iloc[0])
        have = int(pdf["_reach"].iloc[0])
        size = 1 << (own + n - 1).bit_length()
        out = []
        for k, name in enumerate(names):
            x = pdf[name].to_numpy()
            spectrum = np.fft.rfft(x[:own], size).conj() * np.fft.rfft(x, size)
            sums = np.zeros(have)  # beyond the end of a chain there is nothing to add
            sums[: min(have, n)] = np.fft.irfft(spectrum, size)[: min(have, n)]
            reach = have
            if not whole and sums[0] > 0:
                even = sums[: have // 2 * 2].reshape(-1, 2).sum(axis=1)
                ended = np.flatnonzero(even < 0)
                reach = min(have, 8 * int(ended[0]) + 64) if len(ended) else have
            out.append(pd.DataFrame({"series": np.int32(k), "lag": np.arange(reach, dtype=np.int64), "s": sums[:reach] / length}))
        table = pd.concat(out, ignore_index=True)
        for c in keys:
            table[c] = [pdf[c].iloc[0]] * len(table)
        return table[[*keys, "series", "lag", "s"]]

    return run


def _chain_stats(draws: DataFrame, part: Sequence[str], names: Sequence[str]) -> DataFrame:
    aggregates = [f(n).alias(f"{tag}_{n}") for n in names for f, tag in ((F.avg, "m"), (F.var_samp, "v"), (F.min, "lo"), (F.max, "hi"))]
    return keep(draws.groupBy(*part).agg(F.count(F.lit(1)).alias("_length"), *aggregates), "chains")


def _key_facts(chains: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """What the effective size of a key needs of all its chains: numbers, lengths, spread of the means, constant columns."""
    each = [F.struct(F.var_samp(f"m_{n}").alias("between"), F.min(f"lo_{n}").eqNullSafe(F.max(f"hi_{n}")).alias("flat")) for n in names]
    return chains.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_chains"), F.avg("_length").alias("_n"), F.sum("_length").alias("_total"),
        F.max("_length").alias("_longest"), F.collect_list("_length").alias("_lengths"), F.array(*each).alias("_each"),
    )


def _effective(draws: DataFrame, chains: DataFrame, facts: DataFrame, keys: list[str], part: list[str], names: list[str], block: int, whole: bool) -> DataFrame:
    """(keys, series, ess, done): null and not done where the positive pairs have not ended among the lags all blocks sent.

    Chains may differ in length: the total is the sum of their draws, the scale their mean length, and a
    lag that a chain is too short for adds 0 for it.
    """
    reach = F.least(F.lit(block), F.col("_longest")).alias("_reach")
    centres = same_keys(chains, facts.select(*keys, "_longest"), keys).select(*part, "_length", reach, *[f"m_{n}" for n in names])
    centred = same_keys(draws, centres, part).select(
        *part, "_at", "_length", "_reach", *[(F.col(n) - F.col(f"m_{n}")).alias(n) for n in names]
    )
    blocked = _blocks(centred, block, block, "_at")
    types = dict(draws.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["series int", "lag bigint", "s double"])
    sent = blocked.groupBy(*part, "_block").applyInPandas(_lag_products(names, keys, whole), schema)
    sums = sent.groupBy(*keys, "series", "lag").agg(F.sum("s").alias("_s"), F.count(F.lit(1)).alias("_sent"))
    rows = same_keys(sums, facts, keys).withColumn("_own", F.element_at("_each", F.col("series") + 1))
    n_blocks = F.aggregate("_lengths", F.lit(0).cast("bigint"), lambda t, n: t + F.ceil(n / F.lit(block)))
    by_lag = Window.partitionBy(*keys, "series").orderBy("lag")
    acov = F.col("_s") / F.col("_chains")
    zero = F.first(acov).over(by_lag)
    above = zero * F.try_divide(F.col("_n"), F.col("_n") - 1) - acov
    rho = F.when((F.col("lag") == 0) | F.col("_own.flat"), F.lit(1.0)).otherwise(1 - F.try_divide(above, zero + F.coalesce(F.col("_own.between"), F.lit(0.0))))
    # the lags of a key are some hundreds, so these windows are small
    ahead = F.lead("_rho").over(by_lag)
    pairs = rows.where(F.col("_sent") == n_blocks).withColumn("_rho", rho).withColumn("_p", F.col("_rho") + ahead)
    pairs = pairs.where("lag % 2 = 0 and _p is not null")
    ended = F.max((F.col("_p") < 0).cast("int")).over(by_lag)
    summed = (
        pairs.withColumn("_ended", ended)
        .withColumn("_low", F.min("_p").over(by_lag))
        .groupBy(*keys, "series")
        .agg(
            F.sum(F.when(F.col("_ended") == 0, F.col("_low"))).alias("_sum"), F.max("_ended").alias("_done"), F.max("lag").alias("_last"),
            *[F.first(c).alias(c) for c in ("_total", "_longest", "_own")],
        )
    )
    done = F.col("_own.flat") | (F.col("_done") == 1) | (F.col("_last") + 3 >= F.col("_longest"))
    ess = F.when(F.col("_own.flat"), F.col("_total").cast("double")).otherwise(F.try_divide(F.col("_total").cast("double"), 2 * F.col("_sum") - 1))
    return summed.select(*keys, "series", F.when(done, ess).alias("ess"), F.coalesce(done, F.lit(False)).alias("done"))


def effective_sizes(draws: DataFrame, keys: Sequence[str], part: Sequence[str], names: Sequence[str], chains: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Effective sample size of each column in ``names``, over all chains of a key (initial monotone positive pairs).

    ``part`` are the keys and what tells chains apart, ``_at`` counts the draws of a chain from 1. A block
    and the next one give all lags up to the block's size in one pass. Keys whose pairs have not ended by
    then are done again with larger blocks until every key has ended, so no lag is cut off. A column that
    is constant over a key has as many effective draws as draws; a key whose chains all have one draw has null.
    """
    keys, part, names = list(keys), list(part), list(names)
    chains = _chain_stats(draws, part, names) if chains is None else chains
    facts = keep(_key_facts(chains, keys, names), "keys")
    todo, whole, parts = draws, False, []
    while True:
        found = keep(_effective(todo, chains, facts, keys, part, names, block, whole), "ess")
        parts.append(found.withColumn("_round", F.lit(len(parts))))
        still = found.where("not done").select(*keys).distinct()
        if still.isEmpty():
            break
        todo, whole, block = keep(same_keys(todo, still, keys), "open_chains"), True, block * 4
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    own = lambda k, c: F.when(F.col("series") == k, F.col(c))
    wide = every.groupBy(*keys).agg(*[F.max_by(own(k, "ess"), own(k, "_round")).alias(n) for k, n in enumerate(names)])
    return same_keys(facts.select(*keys), wide, keys, "left")


def effective_size(draws: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Effective sample size over all chains of a key, as ``ess``."""
    keys = list(keys)
    rows = draws.where("value is not null").select(*keys, "chain", F.col("draw").alias("_at"), F.col("value").alias("ess"))
    return effective_sizes(rows, keys, [*keys, "chain"], ["ess"], block=block)


#: Strides that one pass tries.
STRIDES = 8


def _moves(state: DataFrame, part: list[str], strides: range, block: int) -> DataFrame:
    """(part, stride, z0, z1, z2, n): moves of the two-state chain thinned by each stride, the second null at its end."""
    reach = 2 * (strides.stop - 1)
    w = Window.partitionBy(*part, "_block").orderBy("draw")
    steps = [F.struct(F.lit(k).alias("stride"), F.lead("_z", k).over(w).alias("z1"), F.lead("_z", 2 * k).over(w).alias("z2")) for k in strides]
    rows = _blocks(state, max(block, reach), reach).withColumn("_steps", F.array(*steps)).where("_home = _block")
    rows = rows.select(*part, "draw", F.col("_z").alias("z0"), F.explode("_steps").alias("_s")).select(*part, "draw", "z0", "_s.*")
    return rows.where("z1 is not null and (draw - 1) % stride = 0").groupBy(*part, "stride", "z0", "z1", "z2").agg(F.count(F.lit(1)).alias("n"))


def _first_order(moves: DataFrame, part: list[str]) -> DataFrame:
    """For each stride whether the thinned chain passes as one of first order, and its moves.

    G-squared of the triples against independence of both ends given the middle is compared with the
    penalty of its two further parameters (BIC).
    """
    cell = lambda a, b, c: F.sum(F.when((F.col("z0") == a) & (F.col("z1") == b) & (F.col("z2") == c), F.col("n")).otherwise(0))
    pair = lambda a, b: F.sum(F.when((F.col("z0") == a) & (F.col("z1") == b), F.col("n")).otherwise(0))
    bits = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    table = moves.groupBy(*part, "stride").agg(
        F.sum("n").alias("_pairs"), *[cell(*x).cast("double").alias("_{}{}{}".format(*x)) for x in bits],
        *[pair(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)],
    )
    g2 = F.lit(0.0)
    for a, b, c in bits:
        here = F.col(f"_{a}{b}{c}")
        left, right = F.col(f"_{a}{b}0") + F.col(f"_{a}{b}1"), F.col(f"_0{b}{c}") + F.col(f"_1{b}{c}")
        middle = sum((F.col(f"_{x}{b}{y}") for x in (0, 1) for y in (0, 1)), F.lit(0.0))
        g2 = g2 + F.when(here > 0, 2 * here * F.log(F.try_divide(here * middle, left * right))).otherwise(0.0)
    passes = g2 < 2 * F.log(F.greatest(F.col("_pairs") - 1, F.lit(1)).cast("double"))
    return table.select(*part, "stride", passes.alias("_passes"), "_pairs", "n00", "n01", "n10", "n11")


def draws_needed(
    draws: DataFrame,
    keys: Sequence[str],
    q: float = 0.025,
    r: float = 0.005,
    s: float = 0.95,
    eps: float = 0.001,
    block: int = BLOCK,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Burn-in and draws needed to know quantile ``q`` to within ``r`` with probability ``s``.

    The indicator of being at or below the quantile is taken as a two-state chain, thinned by the
    smallest stride (``thin``) at which it passes as a chain of first order. Moves of the thinned chain
    give the answer in closed form. Strides are tried eight at a time, for the chains that have not
    passed yet, until a chain has; one that is too short for that has null.
    """
    part = [*keys, "chain"]
    rows = draws.where("value is not null").select(*part, "draw", "value")
    bounds = keep(quantiles(rows, part, "value", {"_u": q}, slice_rows), "bounds")
    state = same_keys(rows, bounds, part).withColumn("_z", (F.col("value") <= F.col("_u")).cast("int")).select(*part, "draw", "_z")
    state, found, first = keep(state, "states"), [], 1
    while True:
        tried = keep(_first_order(_moves(state, part, range(first, first + STRIDES), block), part), "tried")
        # thinned to fewer than three draws a chain cannot pass or fail
        settled_ = tried.groupBy(*part).agg(
            F.min(F.when(F.col("_passes") & (F.col("_pairs") > 1), F.col("stride"))).alias("thin"), F.max("_pairs").alias("_most"), F.count(F.lit(1)).alias("_tried")
        )
        settled_ = keep(settled_, "strides")
        kept = same_keys(tried, settled_, part).where("stride = thin")
        found.append(kept.select(*part, "thin", "n00", "n01", "n10", "n11"))
        todo = settled_.where(F.col("thin").isNull() & (F.col("_tried") == STRIDES) & (F.col("_most") > 1))
        if todo.isEmpty():
            break
        state, first = keep(same_keys(state, todo.select(*part), part), "states"), first + STRIDES
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    counts = same_keys(bounds.select(*part), counts, part, "left")
    al = F.try_divide(F.col("n01").cast("double"), F.col("n00") + F.col("n01"))
    be = F.try_divide(F.col("n10").cast("double"), F.col("n10") + F.col("n11"))
    z = normal_quantile(F.lit((s + 1) / 2))
    al_, be_ = F.col("_alpha"), F.col("_beta")
    return (
        counts.withColumn("_alpha", al)
        .withColumn("_beta", be)
        .select(
            *part, "thin", "n00", "n01", "n10", "n11",
            (F.col("thin") * F.ceil(
                F.try_divide(F.log(F.try_divide(eps * (al_ + be_), F.greatest(al_, be_))), F.log(F.abs(1 - al_ - be_)))
            )).alias("burn_in"),
            (F.col("thin") * F.ceil(F.try_divide((2 - al_ - be_) * al_ * be_ * z * z, F.pow(al_ + be_, F.lit(3)) * (r * r)))).alias("needed"),
            F.ceil(F.lit(q * (1 - q) / (r * r)) * z * z).alias("least"),
        )
        .withColumn("dependence", F.try_divide((F.col("burn_in") + F.col("needed")).cast("double"), F.col("least")))
    )


def _rank_table(placed: DataFrame, keys: list[str], slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """For each distinct value its normal scores, plain and folded, and what a key's draws are measured against.

    A value's rank is the average of its positions; scores are normal quantiles of (rank - 3/8) / (n + 1/4).
    Folded values are distances from the exact median.
    """
    score = lambda upto, n: normal_quantile((upto - n + (n + 1) / 2 - 0.375) / (F.col("total") + 0.25))
    limits = quantiles_of(placed, keys, {"_low": 0.05, "_mid": 0.5, "_high": 0.95})
    means = placed.groupBy(*keys).agg((F.sum(F.col("v") * F.col("n")) / F.first("total")).alias("_mean"))
    centre = keep(same_keys(limits, means, keys), "centre")
    away = same_keys(placed, centre, keys).withColumn("_away", F.abs(F.col("v") - F.col("_mid")))
    folded = running_sum(away.groupBy(*keys, "_away").agg(F.sum("n").alias("_n")), keys, ["_away"], "_n", "_upto", slice_rows=slice_rows)
    table = same_keys(away, folded, [*keys, "_away"]).select(
        *keys, "v", score(F.col("upto"), F.col("n")).alias("z"), score(F.col("_upto"), F.col("_n")).alias("folded")
    )
    return table, centre


def scored_draws(draws: DataFrame, keys: Sequence[str], slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Draws of half chains with the columns that rank diagnostics need, and the table of placed values.

    Columns: ``x`` the draw, ``square`` its squared distance from the key's mean, ``z`` and ``folded`` its
    normal scores, ``low`` and ``high`` whether it is at or below the key's 5 % and 95 % quantiles. Draws of
    a chain are numbered 1, 2, ...; its second half begins after floor(length / 2).
    """
    keys = list(keys)
    rows = draws.where("value is not null").select(*keys, "chain", "draw", "value")
    placed = placed_values(rows, keys, slice_rows)
    table, centre = _rank_table(placed, keys, slice_rows)
    length = rows.groupBy(*keys, "chain").agg(F.floor(F.max("draw") / 2).alias("_cut"))
    halved = same_keys(rows, length, [*keys, "chain"]).withColumn("_half", (F.col("draw") > F.col("_cut")).cast("int"))
    known = same_keys(same_keys(halved, table.withColumnRenamed("v", "value"), [*keys, "value"]), centre, keys)
    return keep(
        known.select(
            *keys, "chain", "_half", (F.col("draw") - F.col("_half") * F.col("_cut")).alias("_at"), F.col("value").alias("x"),
            F.pow(F.col("value") - F.col("_mean"), F.lit(2.0)).alias("square"), "z", "folded",
            (F.col("value") <= F.col("_low")).cast("double").alias("low"), (F.col("value") <= F.col("_high")).cast("double").alias("high"),
        ),
        "scored",
    ), placed


def _scale_reduction(chains: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """R-hat of each column in ``names`` (column to result) from the statistics of its chains."""
    aggregates = [F.avg("_length").cast("double").alias("_n")]
    for c in names:
        aggregates += [F.avg(f"v_{c}").alias(f"_w_{c}"), F.var_samp(f"m_{c}").alias(f"_b_{c}")]
    n = F.col("_n")
    return chains.groupBy(*keys).agg(*aggregates).select(
        *keys, *[F.sqrt(F.try_divide((n - 1) / n * F.col(f"_w_{c}") + F.col(f"_b_{c}"), F.col(f"_w_{c}"))).alias(out) for c, out in names.items()]
    )


def rank_rhat(draws: DataFrame, keys: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rank-normalised split R-hat: the larger of that of the normal scores and that of the folded ones.

    Scores do not need finite variances, and folding shows chains that differ in scale.
    """
    keys = list(keys)
    scored, _ = scored_draws(draws, keys, slice_rows)
    chains = _chain_stats(scored, [*keys, "chain", "_half"], ["z", "folded"])
    both = _scale_reduction(chains, keys, {"z": "rhat_bulk", "folded": "rhat_folded"})
    return both.withColumn("rhat_rank", F.greatest("rhat_bulk", "rhat_folded"))


def full_summary(draws: DataFrame, keys: Sequence[str], mass: float = 0.94, slice_rows: int = SLICE_ROWS, block: int = BLOCK) -> DataFrame:
    """Mean, sd, interval, errors of mean and sd, effective sizes and R-hat per key.

    ``ess`` is that of the mean, ``ess_bulk`` that of the normal scores, ``ess_tail`` the smaller of those of
    the 5 % and 95 % quantiles, all over half chains; ``rhat`` is the split form, ``rhat_rank`` the
    rank-normalised one. One table of placed values gives interval, ranks and limits, one pass over
    the half chains all effective sizes.
    """
    keys = list(keys)
    scored, placed = scored_draws(draws, keys, slice_rows)
    part, names = [*keys, "chain", "_half"], ["x", "square", "z", "folded", "low", "high"]
    chains = _chain_stats(scored, part, names)
    sizes = effective_sizes(scored, keys, part, ["x", "square", "z", "low", "high"], chains, block)
    reduction = _scale_reduction(chains, keys, {"x": "rhat", "z": "_bulk", "folded": "_folded"})
    spread = scored.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.avg("square").alias("_m2"), F.avg(F.col("square") * F.col("square")).alias("_m4"))
    out = spread
    for other in (hdi_of(placed, keys, mass), sizes, reduction):
        out = same_keys(out, other, keys, "left")
    error = F.sqrt(F.try_divide(F.greatest(F.col("_m4") - F.col("_m2") * F.col("_m2"), F.lit(0.0)), F.col("square")))
    return out.select(
        *keys, "mean", "sd", "hdi_lo", "hdi_hi", F.col("x").alias("ess"), F.col("z").alias("ess_bulk"), F.least("low", "high").alias("ess_tail"),
        "rhat", F.greatest("_bulk", "_folded").alias("rhat_rank"), (F.col("sd") / F.sqrt("x")).alias("mcse_mean"),
        F.try_divide(error, 2 * F.sqrt("_m2")).alias("mcse_sd"),
    )


def dic(site_draws: DataFrame, sites: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Deviance information criterion of site rates against their counts.

    ``p_d`` is half the variance of the deviance over draws. Log-likelihoods add up per
    (chain, draw) on the map side before they are shuffled. Without ``sites`` the draws bring
    their tests and successes, and nothing but those sums is shuffled.
    """
    if sites is not None:
        site_draws = site_draws.join(sites.select(*keys, "tests", "successes"), list(keys))
    term = log_binomial(F.col("successes"), F.col("tests"), F.col("value"))
    deviance = (
        site_draws.groupBy("chain", "draw")
        .agg((-2 * F.sum(term)).alias("_d"))
    )
    return deviance.agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg("_d").alias("mean_deviance"),
        (F.var_samp("_d") / 2).alias("p_d"),
    ).withColumn("dic", F.col("mean_deviance") + F.col("p_d"))


def dic_models(models: dict[str, DataFrame], sites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per model, best first: mean deviance, penalty from pairs of chains, and their sum.

    The penalty of a site is half the expected symmetric divergence between the binomials of two chains
    at the same draw, which is tests * (p - q) * (logit p - logit q) for rates p and q. A site's
    draws of all chains meet in one group of (site, draw), and pairs are formed inside it. Draws that
    lie by site (``workspace.by_size`` on the keys) are joined and paired in place.
    """
    keys = list(keys)
    counts = sites.select(*keys, "tests", "successes")
    out = None
    for name, site_draws in models.items():
        known = site_draws.select(*keys, "chain", "draw", "value").join(counts, keys)
        deviance = -2 * log_binomial(F.col("successes"), F.col("tests"), F.col("value"))
        fit = known.groupBy("chain", "draw").agg(F.sum(deviance).alias("_d")).agg(F.count(F.lit(1)).alias("draws"), F.avg("_d").alias("mean_deviance"))
        # over chains, the sum of (p - q)(x - y) for pairs is m * sum(p x) - sum(p) * sum(x)
        x = logit(F.least(F.greatest(F.col("value"), F.lit(1e-12)), F.lit(1 - 1e-12)))
        met = known.withColumn("_x", x).groupBy("draw", *keys).agg(
            F.first("tests").alias("_t"), F.count(F.lit(1)).alias("_m"), F.sum(F.col("value") * F.col("_x")).alias("_px"), F.sum("value").alias("_p"), F.sum("_x").alias("_sx")
        )
        pairs = F.col("_m") * (F.col("_m") - 1) / 2
        divergence = F.try_divide(F.col("_t") * (F.col("_m") * F.col("_px") - F.col("_p") * F.col("_sx")), 2 * pairs)
        penalty = met.groupBy("draw").agg(F.sum(divergence).alias("_j")).agg(F.avg("_j").alias("penalty"))
        one = fit.where("draws > 0").crossJoin(penalty).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("dic", F.col("mean_deviance") + F.col("penalty")).orderBy("dic", "model")


def settled(summary: DataFrame, rhat_limit: float = 1.01, ess_limit: float = 100.0) -> DataFrame:
    """Mark the keys that meet the convergence goal: rank-normalised R-hat, bulk and tail effective size."""
    ok = (F.col("rhat_rank") < rhat_limit) & (F.col("ess_bulk") > ess_limit) & (F.col("ess_tail") > ess_limit)
    return summary.withColumn("converged", F.coalesce(ok, F.lit(False)))


