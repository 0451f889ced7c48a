"""Draws from a fitted grid posterior, seeded and repeatable.

One (chain, draw) uses the same precisions for every region, the same region mean for all
its municipalities and the same municipality mean for all its sites, so draws of
different groups may be compared pairwise. A row's random numbers come from a hash of
its keys: a task that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sitesight.functions.special import beta_draws, pick, uniforms
from sitesight.operators.grid_posterior import (
    Posterior,
    cell_edges,
    likelihood_of,
    noise_nodes,
    per_row,
    prior_of_means,
    prior_of_regions,
    schema_of,
)
from sitesight.workspace import keep, spread, spread_by, stored

BATCH = 512
#: Draws of a site in one array, and site draws that one task makes.
BLOCK, TASK_DRAWS = 50, 2_000_000


def _picks(log_weights_of, n: int, u: np.ndarray) -> np.ndarray:
    """Picks for n draws, a few hundred weight rows at a time."""
    parts = [pick(log_weights_of(slice(i, i + BATCH)), u[i : i + BATCH]) for i in range(0, n, BATCH)]
    return np.concatenate(parts)


def _hyper(fitted: Posterior, chains: int, draws: int, seed: int) -> DataFrame:
    """Per period the grid positions of the shared precisions, one array entry per draw."""
    model, period = fitted.model, fitted.period
    n = chains * draws
    n_p = len(model.municipality_precision) if model.shared_municipality_precision else 1
    n_h = prior_of_regions(model)[0].shape[1]
    rows = fitted.totals.withColumn("seed_id", F.xxhash64(F.lit(seed), F.lit("hyper"), *period))

    def row_of(row):
        t = np.asarray(row.t)
        u = uniforms(np.arange(n, dtype=np.uint64) + np.uint64(row.seed_id % 2**64), 0)
        at = _picks(lambda part: np.broadcast_to(t, (len(u[part]), len(t))), n, u)
        s, rest = np.divmod(at, n_p * n_h)
        p, h = np.divmod(rest, n_h)
        return (*[getattr(row, k) for k in period], s, p, h)

    names = ["s_ix", "p_ix", "h_ix"]
    return keep(
        rows.mapInPandas(
            per_row(row_of, [*period, *names]), schema_of(rows, period, [f"{c} array<int>" for c in names])
        ),
        "hyper_draws",
    )


def _shared_draws(fitted: Posterior, hyper: DataFrame, draws: int) -> DataFrame:
    """Long draws of what all groups share: precisions, and the top level's mean and concentration."""
    model, period = fitted.model, fitted.period

    def picked(points, ix):
        values = F.array(*[F.lit(float(x)) for x in points])
        return F.transform(ix, lambda i: F.element_at(values, i + 1))

    columns = {"phi_site": picked(model.site_precision.points, F.col("s_ix"))}
    if model.shared_municipality_precision:
        columns["phi_mun"] = picked(model.municipality_precision.points, F.col("p_ix"))
    if model.top is not None:
        g, c = model.top
        columns["global_mean"] = picked(np.repeat(g.points, len(c)), F.col("h_ix"))
        columns["global_concentration"] = picked(np.tile(c.points, len(g)), F.col("h_ix"))
    tables = [_long(hyper.select(*period, x.alias("_v")), period, "_v", name, draws) for name, x in columns.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _region_draws(fitted: Posterior, hyper: DataFrame, n: int, seed: int) -> DataFrame:
    model, period = fitted.model, fitted.period
    keys = [*period, "region"]
    n_a, n_s = len(model.region_mean), len(model.site_precision)
    prior_a, _ = prior_of_regions(model)
    rows = fitted.regions.select(*keys, "r", F.xxhash64(F.lit(seed), F.lit("region"), *keys).alias("seed_id"))
    if period:
        rows = rows.join(hyper, period)
    else:
        one = hyper.select(F.struct("*")).scalar()
        rows = rows.withColumn("_h", one).select("*", "_h.*").drop("_h")

    def row_of(row):
        s, p, h = (np.asarray(getattr(row, c)) for c in ("s_ix", "p_ix", "h_ix"))
        r = np.asarray(row.r).reshape(n_s, -1, n_a)
        ids = np.arange(n, dtype=np.uint64) + np.uint64(row.seed_id % 2**64)
        at = _picks(lambda part: r[s[part], p[part]] + prior_a.T[h[part]], n, uniforms(ids, 0))
        low, high = model.region_range
        value = low + (high - low) * (at + uniforms(ids, 1)) / n_a
        return (*[getattr(row, k) for k in keys], s, p, at, value)

    return keep(
        spread(rows, *keys).mapInPandas(
            per_row(row_of, [*keys, "s_ix", "p_ix", "a_ix", "a"]),
            schema_of(rows, keys, ["s_ix array<int>", "p_ix array<int>", "a_ix array<int>", "a array<double>"]),
        ),
        "region_draws",
    )


def _municipality_draws(fitted: Posterior, regions: DataFrame, n: int, seed: int) -> DataFrame:
    model, keys = fitted.model, fitted.keys
    n_m, n_s, n_a = model.mean_cells, len(model.site_precision), len(model.region_mean)
    n_p = len(model.municipality_precision)
    own = np.asarray(model.municipality_precision.log_prior)
    precisions = np.asarray(model.site_precision.points)
    rows = fitted.cells.select(
        *keys, "m_low", "m_high", "ll", F.xxhash64(F.lit(seed), F.lit("municipality"), *keys).alias("seed_id")
    ).join(regions.drop("a"), [*fitted.period, "region"])

    def row_of(row):
        edges = cell_edges(row.m_low, row.m_high, n_m)
        ll = likelihood_of(row, n_s, n_m)
        s, p, a = (np.asarray(getattr(row, c)) for c in ("s_ix", "p_ix", "a_ix"))
        prior = prior_of_means(model, edges).reshape(n_m, n_p, n_a)
        if model.shared_municipality_precision:
            weights = lambda part: ll[s[part]] + prior[:, p[part], a[part]].T
        else:
            mixed = np.logaddexp.reduce(prior + own[None, :, None], axis=1)
            weights = lambda part: ll[s[part]] + mixed[:, a[part]].T
        ids = np.arange(n, dtype=np.uint64) + np.uint64(row.seed_id % 2**64)
        at = _picks(weights, n, uniforms(ids, 0))
        m = edges[at] + uniforms(ids, 1) * (edges[1] - edges[0])
        return (*[getattr(row, k) for k in keys], m, precisions[s])

    return keep(
        spread(rows, *keys).mapInPandas(
            per_row(row_of, [*keys, "m", "s"]), schema_of(rows, keys, ["m array<double>", "s array<double>"])
        ),
        "municipality_draws",
    )


def _site_blocks(sites: DataFrame, fitted: Posterior, municipalities: DataFrame, n: int, seed: int, carry: Sequence[str]) -> DataFrame:
    """(keys, site_id, carry, block, value): the draws of each site in arrays of ``BLOCK``, in order.

    The join is a left one, so that it is the municipalities' arrays that are broadcast, if any side is.
    """
    model, keys = fitted.model, fitted.keys
    z, log_w = noise_nodes(model)
    step = z[1] - z[0]
    places = [*keys, "site_id"]
    shown = [*places, *carry, "block"]
    rows = stored(sites.select(*places, "tests", "successes", *carry), "draw_sites")
    block = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK))).alias("block")
    cut = [F.slice(c, F.col("block") * BLOCK + 1, BLOCK).alias(c) for c in ("m", "s")]
    blocks = (
        spread_by(rows, rows.count() * n, TASK_DRAWS, *places)
        .join(municipalities.select(*keys, "m", "s", block).select(*keys, "block", *cut), keys, "left")
        .withColumn(
            "_id",
            F.transform(
                F.sequence(F.lit(0), F.size("m") - 1),
                lambda i: F.xxhash64(F.lit(seed), F.lit("site"), *places, i + F.col("block") * BLOCK),
            ),
        )
    )

    def drawn(ids, k, n, m, s):
        if model.link == "beta":
            return beta_draws(ids, m * s + k, (1 - m) * s + n - k)
        centre = np.log(m / (1 - m))
        scale = np.sqrt(s)

        def weights(part):
            x = centre[part, None] + scale[part, None] * z
            return log_w - k[part, None] * np.logaddexp(0, -x) - (n - k)[part, None] * np.logaddexp(0, x)

        node = z[_picks(weights, len(ids), uniforms(ids, 0))]
        return 1 / (1 + np.exp(-(centre + scale * (node + (uniforms(ids, 1) - 0.5) * step))))

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("block").is_valid())  # sites whose municipality has no draws
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                flat = lambda c: part.column(c).flatten().to_numpy()
                size = pc.list_value_length(part.column("m")).to_numpy()
                each = lambda c: np.repeat(part.column(c).to_numpy(zero_copy_only=False).astype(float), size)
                value = drawn(flat("_id").astype(np.uint64), each("successes"), each("tests"), flat("m"), flat("s"))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(value))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in shown], lists], [*shown, "value"])

    return blocks.mapInArrow(rates, blocks.select(shown).schema.add("value", ArrayType(DoubleType(), False)))


def _site_draws(blocks: DataFrame, columns: list[str], draws: int) -> DataFrame:
    at = F.col("block") * BLOCK + F.col("_in")
    return blocks.select(*columns, "block", F.posexplode("value").alias("_in", "value")).select(
        F.lit("site_rate").alias("param"), *columns,
        (F.floor(at / draws) + 1).cast("int").alias("chain"), (at % draws + 1).cast("bigint").alias("draw"), "value",
    )


def _long(df: DataFrame, keys: list[str], array: str, param: str, draws: int) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("_at", "value")).select(
        F.lit(param).alias("param"), *keys,
        (F.floor(F.col("_at") / draws) + 1).cast("int").alias("chain"),
        (F.col("_at") % draws + 1).cast("bigint").alias("draw"),
        F.col("value").cast("double").alias("value"),
    )


def posterior_draws(
    sites: DataFrame, fitted: Posterior, chains: int = 4, draws: int = 1000, seed: int = 1, carry: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Long draw tables: ``shared`` parameters, ``region_mean``, ``municipality_mean`` and ``site_rate``.

    Arrays of ``chains * draws`` numbers travel per region and municipality; the site
    table, which is the large one, is made row by row where it is read. ``carry`` names columns
    of ``sites`` that the site draws keep.
    """
    if not fitted.model.by_region:
        sites = sites.withColumn("region", F.lit("all"))
    n = chains * draws
    hyper = _hyper(fitted, chains, draws, seed)
    regions = _region_draws(fitted, hyper, n, seed)
    municipalities = _municipality_draws(fitted, regions, n, seed)
    blocks = _site_blocks(sites, fitted, municipalities, n, seed, carry)
    return {
        "shared": _shared_draws(fitted, hyper, draws),
        "region_mean": _long(regions, [*fitted.period, "region"], "a", "region_mean", draws),
        "municipality_mean": _long(municipalities, fitted.keys, "m", "municipality_mean", draws),
        "site_rate": _site_draws(blocks, [*fitted.keys, "site_id", *carry], draws),
    }


def site_blocks(
    sites: DataFrame, fitted: Posterior, chains: int = 4, draws: int = 1000, seed: int = 1, carry: Sequence[str] = ()
) -> DataFrame:
    """The draws of ``site_rate`` in arrays of at most ``BLOCK``: (keys, site_id, block, value)."""
    if not fitted.model.by_region:
        sites = sites.withColumn("region", F.lit("all"))
    n = chains * draws
    regions = _region_draws(fitted, _hyper(fitted, chains, draws, seed), n, seed)
    return _site_blocks(sites, fitted, _municipality_draws(fitted, regions, n, seed), n, seed, carry)


def one_table(tables: dict[str, DataFrame]) -> DataFrame:
    """All parameters as one draws table; keys above a row's level are null."""
    out = None
    for t in tables.values():
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
