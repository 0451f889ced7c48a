"""The grid posterior against full enumeration and planted truth."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesight.functions.special import beta_draws, log_beta, log_beta_mass, log_gamma, uniforms
from sitesight.operators import draws as D
from sitesight.operators import grid_posterior as P
from sitesight.operators import model_spec as M
from sitesight.operators import sampling as S
from tests.planted import planted_small, site_rows


def enumerate_posterior(rows, model, ranges):
    """Sum over every combination of grid cells of all groups: the plain definition."""
    regions = sorted({r[0] for r in rows})
    muns = sorted({(r[0], r[1]) for r in rows})
    n_m = model.mean_cells
    edges = {m: P.cell_edges(*ranges[m], n_m) for m in muns}
    mids = {m: (e[1:] + e[:-1]) / 2 for m, e in edges.items()}
    a_pts = np.asarray(model.region_mean.points)
    mean = {m: 0.0 for m in muns}
    region_mean = {r: 0.0 for r in regions}
    total = 0.0
    for (si, s), (pi, p) in itertools.product(
        enumerate(model.site_precision.points), enumerate(model.municipality_precision.points)
    ):
        hyper = np.exp(model.site_precision.log_prior[si] + model.municipality_precision.log_prior[pi])
        per_region, details = {}, {}
        for r in regions:
            acc = np.exp(np.asarray(model.region_mean.log_prior))
            parts = {}
            for m in [x for x in muns if x[0] == r]:
                mid = mids[m]
                ll = np.zeros(n_m)
                for row in [x for x in rows if (x[0], x[1]) == m]:
                    n, k = row[3], row[4]
                    ll += log_beta(k + mid * s, n - k + (1 - mid) * s) - log_beta(mid * s, (1 - mid) * s)
                prior = np.exp(log_beta_mass(edges[m], a_pts * p, (1 - a_pts) * p))
                parts[m] = (np.exp(ll)[:, None] * prior, (np.exp(ll) * mid)[:, None] * prior)
                acc = acc * parts[m][0].sum(axis=0)
            per_region[r], details[r] = acc, parts
        z = {r: v.sum() for r, v in per_region.items()}
        weight = hyper * np.prod(list(z.values()))
        total += weight
        for r in regions:
            region_mean[r] += weight * (per_region[r] @ a_pts) / z[r]
            for m, (plain, moment) in details[r].items():
                mean[m] += weight * (per_region[r] * moment.sum(axis=0) / plain.sum(axis=0)).sum() / z[r]
    return {k: v / total for k, v in mean.items()}, {k: v / total for k, v in region_mean.items()}


def test_matches_enumeration(spark):
    sites, _, _ = planted_small(spark, sites=6, municipalities=2, tests=(3, 30))
    model = M.three_level(4, mean_cells=40, region_mean=M.beta(2, 2, 20))
    fitted = P.fit_on_grid(sites, model)
    rows = [tuple(r) for r in sites.collect()]
    mun = fitted.municipalities.collect()
    ranges = {(r["region"], r["municipality"]): (r["m_low"], r["m_high"]) for r in mun}
    want, want_region = enumerate_posterior(rows, model, ranges)
    for r in mun:
        assert np.isclose(r["mean_mun"], want[(r["region"], r["municipality"])], atol=1e-9)
    for r in fitted.regions.collect():
        assert np.isclose(r["mean_region"], want_region[r["region"]], atol=1e-9)


def test_planted_truth_is_covered(spark):
    sites, means, thetas = planted_small(spark, sites=40, municipalities=4)
    fitted = P.fit(sites, M.three_level(8))
    mun = fitted.municipalities.collect()
    assert sum(r["lo_mun"] <= means[r["municipality"]] <= r["hi_mun"] for r in mun) >= len(mun) - 1
    rows = P.site_posterior(sites, fitted).toPandas()
    inside = [lo <= thetas[i] <= hi for i, lo, hi in zip(rows["site_id"], rows["lo_site"], rows["hi_site"])]
    assert 0.90 <= np.mean(inside) <= 0.99
    raw = rows["successes"] / rows["tests"]
    between = (rows["mean_site"] - raw) * (rows["mean_mun"] - raw) >= -1e-9
    assert between.mean() > 0.97
    ends = fitted.precision.first()
    assert ends["phi_site_ends"] < 1e-3
    assert 4 < ends["phi_site"] < 25


def test_more_tests_narrower_interval(spark):
    rows = [("r", "city", i, 50, 37 + i % 2) for i in range(20)]
    rows += [("r", "city", 100, 5, 2), ("r", "city", 101, 100, 85)]
    sites = site_rows(spark, rows)
    out = P.site_posterior(sites, P.fit(sites, M.fixed_precision())).toPandas().set_index("site_id")
    a, b = out.loc[100], out.loc[101]
    assert b["hi_site"] - b["lo_site"] < a["hi_site"] - a["lo_site"]
    assert 0.4 < a["mean_site"] < 0.75 and 0.77 <= b["lo_site"] + 0.02 and b["hi_site"] <= 0.92


def test_no_tests_gives_the_prior(spark):
    sites = site_rows(spark, [("r", "empty", 1, 0, 0), ("r", "empty", 2, 0, 0), ("r", "full", 3, 40, 20)])
    fitted = P.fit(sites, M.fixed_precision())
    rows = {r["site_id"]: r for r in P.site_posterior(sites, fitted).collect()}
    mun = {r["municipality"]: r for r in fitted.municipalities.collect()}
    assert len(rows) == 3
    assert np.isclose(rows[1]["mean_site"], mun["empty"]["mean_mun"], atol=1e-9)
    assert np.isclose(mun["empty"]["mean_mun"], fitted.regions.first()["mean_region"], atol=5e-3)


def test_finer_grid_same_mean(spark):
    sites, _, _ = planted_small(spark)
    one = P.fit_on_grid(sites, M.fixed_precision(mean_cells=60)).municipalities.toPandas().set_index("municipality")
    two = P.fit_on_grid(sites, M.fixed_precision(mean_cells=120)).municipalities.toPandas().set_index("municipality")
    assert np.abs(one["mean_mun"] - two["mean_mun"]).max() < 1e-3


def test_large_counts_are_resolved(spark):
    rows = [("r", "big", i, 2_000_000, 1_333_333 + 50 * (i % 3)) for i in range(30)]
    sites = site_rows(spark, rows + [("r", "small", 99, 10, 5)])
    fitted = P.refit(sites, P.fit(sites, M.Model(M.fixed(1e6), M.fixed(100.0))))
    big = fitted.municipalities.where("municipality = 'big'").first()
    # 30 sites of precision 1e6: the mean's sd is close to sqrt(p(1-p)/3e7).
    assert abs(big["mean_mun"] - 0.66669) < 4e-4
    assert abs(big["sd_mun"] / (0.6667 * 0.3333 * (1 / 1e6 + 1 / 2e6) / 30) ** 0.5 - 1) < 0.05


@pytest.mark.parametrize("build", [M.logit_normal, M.logit_normal_revised])
def test_logit_normal_recovers(spark, build):
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for j, m in enumerate((0.35, 0.6, 0.8)):
        for i in range(60):
            theta = 1 / (1 + np.exp(-(np.log(m / (1 - m)) + rng.normal() * 0.6)))
            rows.append(("r", f"m{j}", 100 * j + i, 80, int(rng.binomial(80, theta))))
            truth[100 * j + i] = theta
    sites = site_rows(spark, rows)
    fitted = P.fit(sites, build(5, mean_cells=80))
    mun = {r["municipality"]: r["mean_mun"] for r in fitted.municipalities.collect()}
    assert abs(mun["m0"] - 0.35) < 0.06 and abs(mun["m1"] - 0.6) < 0.06 and abs(mun["m2"] - 0.8) < 0.06
    out = P.site_posterior(sites, fitted).collect()
    assert 0.88 <= np.mean([r["lo_site"] <= truth[r["site_id"]] <= r["hi_site"] for r in out]) <= 1.0


def test_periods_equal_separate_fits(spark):
    from pyspark.sql import functions as F

    a, _, _ = planted_small(spark, seed=1)
    b, _, _ = planted_small(spark, seed=2)
    model = M.three_level(4, mean_cells=40, region_mean=M.beta(2, 2, 20))
    both = a.withColumn("month", F.lit(1)).unionByName(b.withColumn("month", F.lit(2)))
    joint = P.fit_on_grid(both, model, ["month"]).municipalities.toPandas()
    for month, table in ((1, a), (2, b)):
        alone = P.fit_on_grid(table, model).municipalities.toPandas().set_index("municipality")["mean_mun"]
        mine = joint[joint["month"] == month].set_index("municipality")["mean_mun"]
        assert np.allclose(alone.sort_index(), mine.sort_index(), atol=1e-10)


@pytest.mark.parametrize("build", [M.three_level, M.own_precision, M.hyper_prior])
def test_draws_agree_with_grid(spark, build):
    sites, _, _ = planted_small(spark)
    fitted = P.fit(sites, build(6))
    tables = S.posterior_draws(sites, fitted, chains=2, draws=1500, seed=3)
    rates = D.moments(tables["site_rate"], ["site_id"]).toPandas().set_index("site_id").sort_index()
    exact = P.site_posterior(sites, fitted).toPandas().set_index("site_id").sort_index()
    assert (np.abs(rates["mean"] - exact["mean_site"]) < 5 * exact["sd_site"] / np.sqrt(3000)).all()
    assert np.allclose(rates["sd"], exact["sd_site"], rtol=0.12)
    mun = D.moments(tables["municipality_mean"], ["municipality"]).toPandas().set_index("municipality").sort_index()
    want = fitted.municipalities.toPandas().set_index("municipality").sort_index()
    assert (np.abs(mun["mean"] - want["mean_mun"]) < 5 * want["sd_mun"] / np.sqrt(3000) + 1e-4).all()
    region = D.moments(tables["region_mean"], ["region"]).toPandas().set_index("region").sort_index()
    want_r = fitted.regions.toPandas().set_index("region").sort_index()
    assert (np.abs(region["mean"] - want_r["mean_region"]) < 5 * want_r["sd_region"] / np.sqrt(3000) + 1e-4).all()


def test_draws_repeat(spark):
    sites, _, _ = planted_small(spark)
    fitted = P.fit(sites, M.fixed_precision())
    key = ["site_id", "chain", "draw"]
    one = S.posterior_draws(sites, fitted, 2, 50, seed=9)["site_rate"].toPandas().sort_values(key)
    two = S.posterior_draws(sites.repartition(5), fitted, 2, 50, seed=9)["site_rate"].toPandas().sort_values(key)
    assert np.array_equal(one["value"].to_numpy(), two["value"].to_numpy())


def test_site_draws_in_blocks(spark):
    """Blocks hold the long table's draws in order, the last one what is left; columns are carried, repeated sites stay."""
    sites, _, _ = planted_small(spark)
    fitted = P.fit_on_grid(sites, M.fixed_precision())
    more = sites.unionByName(sites.limit(1)).withColumn("tag", F.col("site_id") * 2)
    more = more.unionByName(more.limit(1).withColumn("region", F.lit(None).cast("string")))
    blocks = S.site_blocks(more, fitted, 2, 60, seed=9, carry=["tag"])
    long = S.posterior_draws(sites, fitted, 2, 60, seed=9)["site_rate"].toPandas().sort_values(["site_id", "chain", "draw"])
    found = blocks.toPandas().sort_values(["site_id", "block"])
    assert len(found) == 3 * (sites.count() + 1) and sorted({len(v) for v in found["value"]}) == [20, 50]
    assert (found["tag"] == 2 * found["site_id"]).all()
    once = found.drop_duplicates(["region", "municipality", "site_id", "block"])
    assert np.array_equal(np.concatenate(list(once["value"])), long["value"].to_numpy())


def test_pairs_are_solved_in_many_tasks(spark, monkeypatch):
    """A municipality's pairs are few bytes and much work: shares of them run in tasks of their own."""
    rows = [("r", "m", 1000 * n + k, n, k) for n in range(60, 80) for k in range(20, 50)] + [("r", "o", 1, 9, 4), ("r", "m", 1, 60, 20)]
    sites = site_rows(spark, rows)
    fitted = P.fit_on_grid(sites, M.fixed_precision(mean_cells=40, region_mean=M.beta(2, 2, 10)))
    whole = P.site_posterior(sites, fitted).toPandas().set_index(["municipality", "site_id"]).sort_index()
    files = {}

    def keep(df, name="step"):
        files[name] = kept(df, name)
        return files[name]

    kept = P.keep
    monkeypatch.setattr(P, "keep", keep)
    monkeypatch.setattr(P, "SHARE_PAIRS", 20)
    cut = P.site_posterior(sites, fitted).toPandas().set_index(["municipality", "site_id"]).sort_index()
    assert len(files["site_pairs"].inputFiles()) > 10
    assert len(cut) == len(rows) and np.allclose(cut[["mean_site", "sd_site"]], whole[["mean_site", "sd_site"]])
    assert np.allclose(cut[["lo_site", "hi_site"]], whole[["lo_site", "hi_site"]], atol=4e-3)  # the cells are those of the share


def test_numeric_helpers():
    from math import lgamma

    x = np.array([0.01, 0.3, 1, 2.5, 8, 77.7, 3e5])
    assert np.allclose(log_gamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    u = uniforms(np.arange(100_000, dtype=np.uint64), 4)
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    for a, b in ((0.3, 0.8), (2.0, 5.0), (40.0, 3.0)):
        d = beta_draws(np.arange(200_000, dtype=np.uint64), np.full(200_000, a), np.full(200_000, b))
        assert abs(d.mean() - a / (a + b)) < 0.004
        assert abs(d.var() - a * b / ((a + b) ** 2 * (a + b + 1))) < 0.002
    mass = np.exp(log_beta_mass(np.linspace(0, 1, 201), [0.05, 2.0], [0.05, 3.0])).sum(axis=0)
    assert np.allclose(mass, 1, atol=0.03)


def test_many_sites_of_a_logit_model(spark):
    """The truth lies inside the interval however many sites there are, and nothing lies on the ends."""
    rng = np.random.default_rng(5)
    theta = 1 / (1 + np.exp(-(np.log(0.9 / 0.1) + rng.normal(size=6000) * 1.5)))
    rows = [("r", "m", i, 80, int(k)) for i, k in enumerate(rng.binomial(80, theta))]
    mun = P.fit(site_rows(spark, rows), M.logit_normal(6, mean_cells=60)).municipalities.first()
    assert mun["lo_mun"] <= 0.9 <= mun["hi_mun"] and mun["edge_mass"] < 1e-3
    assert mun["hi_mun"] - mun["lo_mun"] < 0.03


def test_many_municipalities_resolve_the_region(spark):
    rng = np.random.default_rng(6)
    means = rng.beta(0.6 * 100, 0.4 * 100, size=2000)
    rows = [("r", f"m{j}", j, 4000, int(rng.binomial(4000, m))) for j, m in enumerate(means)]
    model = M.Model(M.fixed(1e5), M.fixed(100.0), mean_cells=60)
    region = P.fit(site_rows(spark, rows), model).regions.first()
    want = np.sqrt(0.6 * 0.4 / 101 / 2000)
    assert abs(region["sd_region"] / want - 1) < 0.08 and abs(region["mean_region"] - 0.6) < 4 * want


@pytest.mark.parametrize("variance", [0.01, 1.0, 25.0])
def test_noise_variance_is_found_beyond_the_axis(spark, variance):
    """The axis of the noise variance reaches as far as the posterior does, on either side."""
    rng = np.random.default_rng(int(variance * 100))
    rows = []
    for j in range(6):
        x = np.log(0.6 / 0.4) + rng.normal() * 0.2 + np.sqrt(variance) * rng.normal(size=80)
        rows += [("r", f"m{j}", 100 * j + i, 40, int(k)) for i, k in enumerate(rng.binomial(40, 1 / (1 + np.exp(-x))))]
    fitted = P.fit(site_rows(spark, rows), M.logit_normal(5, mean_cells=50))
    model = fitted.model
    w = np.exp(np.asarray(fitted.totals.first()["t"])).reshape(len(model.site_precision), -1).sum(axis=1)
    points = np.asarray(model.site_precision.points)
    ends = fitted.precision.first()
    assert ends["phi_site_ends"] < 2e-3 and ends["phi_mun_ends"] < 2e-3
    cdf = np.cumsum(w / w.sum())
    step = points[1] / points[0]
    assert points[np.searchsorted(cdf, 0.025)] / step <= variance <= points[min(np.searchsorted(cdf, 0.975), len(points) - 1)] * step


def test_widened_axis_keeps_its_prior():
    axis = M.gamma(1.0, 0.1, 0.002, 10.0, 8)
    wide = M.widened(axis, True, True)
    x, y = np.log(axis.points), np.log(wide.points)
    at = [int(np.argmin(np.abs(y - v))) for v in x]
    assert np.allclose(y[at], x) and np.allclose(np.diff(np.array(wide.log_prior)[at]), np.diff(axis.log_prior))
    assert wide.points[0] <= axis.points[0] / 30 and wide.points[-1] >= axis.points[-1] * 30 and M.widened(M.fixed(2.0), True, True) == M.fixed(2.0)


@pytest.mark.parametrize("top", [60, 3000])
def test_site_products_match_single_sites(top):
    """Batched means, sds and intervals against one mixture at a time, for few and for very many tests."""
    rng = np.random.default_rng(top)
    model = M.three_level(5, mean_cells=40)
    mid = np.linspace(0.3, 0.8, 40)
    w = rng.dirichlet(np.full(200, 0.3))
    n = rng.integers(0, top, 70)
    k = rng.binomial(n, rng.uniform(0.05, 0.95, 70))
    got = P._beta_sites(model, w, mid, n, k, 0.95)
    s = np.repeat(model.site_precision.points, 40)
    for row, n_, k_ in zip(got, n, k):
        a, b = np.tile(mid, 5) * s + k_, (1 - np.tile(mid, 5)) * s + n_ - k_
        mean = w @ (a / (a + b))
        sd = np.sqrt(w @ (a * (a + 1) / ((a + b) * (a + b + 1))) - mean**2)
        used = w > w.max() * 1e-12
        want = P._beta_interval(w[used], a[used], b[used], mean, sd, 0.95)
        assert np.allclose(row[:2], [mean, sd], rtol=1e-9)
        assert np.allclose(row[2:], want, atol=0.01 * sd + 2 * 18 * sd / P.SITE_CELLS)


def test_shared_draws_agree_with_the_grid(spark):
    """Precisions and the top level are parameters of the draws table and agree with their marginals."""
    sites, _, _ = planted_small(spark)
    fitted = P.fit_on_grid(sites, M.hyper_prior(6, 6, mean_cells=40, region_mean=M.beta(2, 2, 20)))
    want = {r["param"]: r for r in P.shared_parameters(fitted).collect()}
    got = D.moments(S.posterior_draws(sites, fitted, 2, 2000, seed=4)["shared"], ["param"]).collect()
    assert {r["param"] for r in got} == set(want) == {"phi_site", "phi_mun", "global_mean", "global_concentration"}
    for r in got:
        assert abs(r["mean"] - want[r["param"]]["mean"]) < 5 * want[r["param"]]["sd"] / np.sqrt(4000) + 1e-9
        assert want[r["param"]]["lo"] < want[r["param"]]["mean"] < want[r["param"]]["hi"]


def test_last_edge_of_a_range_is_its_end():
    """A range such as (0.0577, 1) must not end a rounding below 1, where its last cell would lose its end."""
    low = 0.05768453559846298
    assert low + (1.0 - low) * 40 / 40 < 1.0
    assert P.cell_edges(low, 1.0, 40)[-1] == 1.0


def test_a_month_of_the_tables_matches_enumeration(spark, sf_dir):
    """One month of the joint monthly fit against the plain definition, cell by cell."""
    from sitesight.plans import model_queries as Q
    from sitesight.plans.shared_tables import site_month

    month = "1999-04-01"
    sites = site_month(spark, sf_dir).where(f"month = '{month}'").select("region", "municipality", "site_id", "tests", "successes")
    fitted = Q._monthly(spark, sf_dir)
    mun = fitted.municipalities.where(f"month = '{month}'").collect()
    ranges = {(r["region"], r["municipality"]): (r["m_low"], r["m_high"]) for r in mun}
    want, want_region = enumerate_posterior([tuple(r) for r in sites.collect()], Q.MONTHLY, ranges)
    assert len(want) == len(mun) and all(np.isclose(r["mean_mun"], want[(r["region"], r["municipality"])], atol=1e-9) for r in mun)
    for r in fitted.regions.where(f"month = '{month}'").collect():
        assert np.isclose(r["mean_region"], want_region[r["region"]], atol=1e-9)
