"""Draw operators against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitesight.operators import diagnostics as G
from sitesight.operators import draws as D


def numpy_hdi(x, mass):
    x = np.sort(x)
    k = int(np.floor(mass * len(x)))
    width = x[k:] - x[: len(x) - k]
    i = int(np.argmin(width))
    return x[i], x[i + k]


def numpy_ess(chains):
    m, n = chains.shape
    centred = chains - chains.mean(axis=1, keepdims=True)
    acov = np.array([(centred[:, : n - t] * centred[:, t:]).sum(axis=1).mean() / n for t in range(n)])
    mean_var = acov[0] * n / (n - 1)
    var_plus = acov[0] + (chains.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    rho = 1 - (mean_var - acov) / var_plus
    rho[0] = 1.0
    total, low = 0.0, np.inf
    for k in range(n // 2):
        p = rho[2 * k] + rho[2 * k + 1]
        if p < 0:
            break
        low = min(low, p)
        total += low
    return m * n / (2 * total - 1)


@pytest.fixture(scope="module")
def chains(spark):
    """Autocorrelated chains of three parameters, one with far more draws."""
    rng = np.random.default_rng(11)
    rows, raw = [], {}
    for param, phi, n in (("a", 0.0, 200), ("b", 0.9, 600), ("hot", 0.97, 3000)):
        x = np.zeros((3, n))
        for c in range(3):
            for t in range(1, n):
                x[c, t] = phi * x[c, t - 1] + rng.normal()
        raw[param] = x
        rows += [(param, c, t + 1, float(x[c, t])) for c in range(3) for t in range(n)]
    pdf = pd.DataFrame(rows, columns=["param", "chain", "draw", "value"]).astype({"chain": "int32"})
    return spark.createDataFrame(pdf), raw


@pytest.mark.parametrize("slice_rows", [10**6, 700, 64])
def test_hdi_forms_agree(chains, slice_rows):
    df, raw = chains
    got = D.hdi(df, ["param"], 0.94, slice_rows=slice_rows).toPandas().set_index("param")
    for p, x in raw.items():
        assert np.allclose(got.loc[p], numpy_hdi(x.ravel(), 0.94))


def test_hdi_holds_its_mass(chains):
    df, raw = chains
    got = D.hdi(df, ["param"], 0.95).toPandas().set_index("param")
    for p, x in raw.items():
        lo, hi = got.loc[p]
        assert ((x >= lo) & (x <= hi)).mean() >= 0.95
        assert hi - lo <= np.diff(np.quantile(x, [0.025, 0.975], method="inverted_cdf"))[0] + 1e-12


@pytest.mark.parametrize("block", [1 << 15, 50, 128])
def test_effective_size(chains, block):
    df, raw = chains
    got = G.effective_size(df, ["param"], block).toPandas().set_index("param")["ess"]
    for p, x in raw.items():
        assert np.isclose(got[p], numpy_ess(x))


def test_rhat(chains):
    df, raw = chains
    got = G.rhat(df, ["param"]).toPandas().set_index("param")["rhat"]
    for p, x in raw.items():
        n = x.shape[1]
        w, b = x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
        assert np.isclose(got[p], np.sqrt(((n - 1) / n * w + b) / w))


def test_draws_needed_counts_moves_once(chains):
    df, raw = chains
    for block in (4096, 37):
        got = G.draws_needed(df, ["param"], block=block).toPandas()
        for row in got.itertuples():
            x = raw[row.param][row.chain]
            z = (x <= np.quantile(x, 0.025)).astype(int)[:: row.thin]  # the moves are those of the thinned chain
            assert row.n00 + row.n01 + row.n10 + row.n11 == len(z) - 1
            assert row.n01 == ((z[:-1] == 0) & (z[1:] == 1)).sum()


def test_prob_greater(chains, spark):
    df, raw = chains
    pairs = spark.createDataFrame([("a", "b"), ("hot", "a")], "better string, worse string")
    got = D.prob_greater(df, pairs, "param").toPandas().set_index("better")
    assert np.isclose(got.loc["a", "prob"], (raw["a"] > raw["b"][:, :200]).mean())
    assert got.loc["hot", "draws"] == 600


def test_thin_renumbers(chains):
    df, _ = chains
    got = D.thin(df.where("param = 'a' and chain = 0"), burn=50, every=5).orderBy("draw").toPandas()
    assert got["draw"].tolist() == list(range(1, 31))


def test_trace_running_mean(chains):
    df, raw = chains
    got = D.trace_series(df, ["param"], slice_rows=500).where("param = 'hot' and chain = 1").orderBy("draw").toPandas()
    x = raw["hot"][1]
    assert np.allclose(got["running_mean"], np.cumsum(x) / np.arange(1, len(x) + 1))


def test_rank_histogram_is_whole(chains):
    df, raw = chains
    got = D.rank_histogram(df, ["param"], 10, slice_rows=500).toPandas()
    assert got["n"].sum() == sum(x.size for x in raw.values())
    per_bin = got[got["param"] == "hot"].groupby("bin")["n"].sum()
    assert (per_bin == 900).all()


def test_histogram_counts(chains):
    df, raw = chains
    got = D.histogram(df, ["param"], 15).toPandas()
    for p, x in raw.items():
        counts, _ = np.histogram(x.ravel(), 15)
        mine = got[got["param"] == p].set_index("bin")["n"].reindex(range(15), fill_value=0)
        assert np.abs(mine.to_numpy() - counts).sum() <= 2


def test_dic(spark):
    rng = np.random.default_rng(5)
    sites = spark.createDataFrame([(1, 10, 4), (2, 30, 30), (3, 8, 0)], "site_id int, tests bigint, successes bigint")
    theta = rng.beta(2, 2, (2, 40, 3))
    rows = [(s + 1, c, t + 1, float(theta[c, t, s])) for c in range(2) for t in range(40) for s in range(3)]
    draws = spark.createDataFrame(rows, "site_id int, chain int, draw int, value double")
    got = G.dic(draws, sites, ["site_id"]).first()
    from math import comb

    n, k = np.array([10, 30, 8]), np.array([4, 30, 0])
    choose = np.array([comb(a, b) for a, b in zip(n, k)], dtype=float)
    dev = -2 * np.log(choose * theta**k * (1 - theta) ** (n - k)).sum(axis=2).ravel()
    assert np.isclose(got["mean_deviance"], dev.mean()) and np.isclose(got["p_d"], dev.var(ddof=1) / 2)


def numpy_scores(x):
    """Normal scores of pooled average ranks."""
    from statistics import NormalDist

    flat = x.ravel()
    order = np.sort(flat)
    rank = (np.searchsorted(order, flat, "left") + np.searchsorted(order, flat, "right") + 1) / 2
    return np.array([NormalDist().inv_cdf((r - 0.375) / (len(flat) + 0.25)) for r in rank]).reshape(x.shape)


def halves(x):
    cut = x.shape[1] // 2
    return np.concatenate([x[:, :cut], x[:, cut: 2 * cut]])


def numpy_rhat(x):
    n, w, b = x.shape[1], x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
    return np.sqrt(((n - 1) / n * w + b) / w)


def chain_rows(spark, raw):
    rows = [(p, c, t + 1, float(v)) for p, x in raw.items() for c in range(x.shape[0]) for t, v in enumerate(x[c])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["param", "chain", "draw", "value"]).astype({"chain": "int32"}))


def test_rank_rhat(spark):
    """Heavy tails, chains that differ in scale only, ties, and chains that agree."""
    rng = np.random.default_rng(21)
    raw = {
        "same": rng.normal(size=(4, 400)), "cauchy": rng.standard_cauchy((4, 400)) + np.array([[0], [0], [0], [2.5]]),
        "scale": rng.normal(size=(4, 400)) * np.array([[1], [1], [1], [6]]), "ties": rng.integers(0, 4, (4, 400)).astype(float),
    }
    got = G.rank_rhat(chain_rows(spark, raw), ["param"], slice_rows=300).toPandas().set_index("param")
    for p, x in raw.items():
        want = numpy_rhat(halves(numpy_scores(x))), numpy_rhat(halves(numpy_scores(np.abs(x - np.median(x)))))
        assert np.allclose(got.loc[p, ["rhat_bulk", "rhat_folded"]].astype(float), want, atol=1e-7)
    plain = G.rhat(chain_rows(spark, raw), ["param"], split=True).toPandas().set_index("param")["rhat"]
    assert got.loc["cauchy", "rhat_rank"] > 1.05 and got.loc["scale", "rhat_rank"] > 1.05 > plain["scale"]
    assert got.loc["same", "rhat_rank"] < 1.01 and got.loc["ties", "rhat_rank"] < 1.02


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_full_summary(chains, block):
    df, raw = chains
    got = G.full_summary(df, ["param"], 0.94, slice_rows=900, block=block).toPandas().set_index("param")
    for p, x in raw.items():
        row, two = got.loc[p], halves(x)
        ess, bulk = numpy_ess(two), numpy_ess(halves(numpy_scores(x)))
        tail = min(numpy_ess(halves((x <= np.quantile(x, q)).astype(float))) for q in (0.05, 0.95))
        square = (x - x.mean()) ** 2
        error = np.sqrt((np.mean(square**2) - np.mean(square) ** 2) / numpy_ess(halves(square))) / (2 * np.sqrt(square.mean()))
        assert np.allclose([row["ess"], row["ess_bulk"], row["ess_tail"]], [ess, bulk, tail], rtol=1e-6)
        assert np.allclose([row["mean"], row["sd"], row["mcse_mean"], row["mcse_sd"]], [x.mean(), x.std(ddof=1), x.std(ddof=1) / np.sqrt(ess), error], rtol=1e-6)
        assert np.allclose([row["hdi_lo"], row["hdi_hi"]], numpy_hdi(x.ravel(), 0.94)) and row["rhat"] == pytest.approx(numpy_rhat(two))


def test_effective_size_of_odd_chains(spark):
    """Constant values, one draw a chain, chains of different length, null values and repeated values."""
    raw = {"flat": np.full((2, 50), 3.0), "single": np.ones((3, 1))}
    df = chain_rows(spark, raw).unionByName(spark.createDataFrame([("nulls", 0, 1, None)], "param string, chain int, draw long, value double"))
    rng = np.random.default_rng(2)
    uneven = [("uneven", c, t + 1, float(v)) for c, n in ((0, 40), (1, 300)) for t, v in enumerate(rng.normal(size=n))]
    df = df.unionByName(spark.createDataFrame(uneven, "param string, chain int, draw long, value double"))
    got = G.effective_size(df, ["param"], block=32).toPandas().set_index("param")["ess"]
    assert got["flat"] == 100 and np.isnan(got["single"]) and "nulls" not in got.index and 150 < got["uneven"] < 700


def test_effective_size_of_a_slow_chain(spark):
    """A million draws with autocorrelation 0.99: theory says n (1 - a) / (1 + a)."""
    n, a = 1_000_000, 0.99
    noise = np.random.default_rng(7).normal(size=n + 2000)
    weights = a ** np.arange(2000)
    x = np.fft.irfft(np.fft.rfft(noise, 1 << 21) * np.fft.rfft(weights, 1 << 21), 1 << 21)[2000: n + 2000]
    pdf = pd.DataFrame({"param": "slow", "chain": np.int32(0), "draw": np.arange(1, n + 1), "value": x})
    got = G.effective_size(spark.createDataFrame(pdf), ["param"]).first()["ess"]
    assert abs(got / (n * (1 - a) / (1 + a)) - 1) < 0.05


def test_rhat_limits(chains):
    """The corrected factor against its plain form, and the F quantile against published table values."""
    from sitesight.functions.special import f_quantile

    assert np.allclose(f_quantile(0.975, [3, 3, 1, 10], [10, 120, 5, 10]), [4.8256, 3.2269, 10.0070, 3.7168], atol=2e-4)
    df, raw = chains
    got = G.rhat_limits(df, ["param"]).toPandas().set_index("param")
    for p, x in raw.items():
        m, n = x.shape
        s2, means = x.var(axis=1, ddof=1), x.mean(axis=1)
        w, b = s2.mean(), n * means.var(ddof=1)
        cov = lambda u, v: np.cov(u, v)[0, 1]
        var_w, var_b = s2.var(ddof=1) / m, 2 * b**2 / (m - 1)
        cov_wb = n / m * (cov(s2, means**2) - 2 * means.mean() * cov(s2, means))
        v = (n - 1) / n * w + (1 + 1 / m) * b / n
        var_v = ((n - 1) ** 2 * var_w + (1 + 1 / m) ** 2 * var_b + 2 * (n - 1) * (1 + 1 / m) * cov_wb) / n**2
        d = 2 * v**2 / var_v
        adjust, fixed, ratio = (d + 3) / (d + 1), (n - 1) / n, (1 + 1 / m) * b / n / w
        upper = fixed + f_quantile(0.975, m - 1, 2 * w**2 / var_w) * ratio
        assert np.allclose(got.loc[p, ["rhat_adjusted", "rhat_upper"]].astype(float), [np.sqrt(adjust * (fixed + ratio)), np.sqrt(adjust * upper)])


@pytest.mark.parametrize("p", [2, 3, 5])
def test_rhat_multivariate(spark, p):
    rng = np.random.default_rng(p)
    x = rng.normal(size=(4, 150, p)) @ rng.normal(size=(p, p)) + rng.normal(size=(4, 1, p)) * 0.3
    raw = {f"v{k}": x[:, :, k] for k in range(p)}
    got = G.rhat_multivariate(chain_rows(spark, raw), [], list(raw)).first()
    within = np.mean([np.cov(c, rowvar=False) for c in x], axis=0)
    between = np.cov(x.mean(axis=1), rowvar=False)
    worst = np.linalg.eigvals(np.linalg.solve(within, between)).real.max()
    assert got["chains"] == 4 and got["rhat_multivariate"] == pytest.approx(np.sqrt(149 / 150 + 1.25 * worst), abs=1e-9)
    each = G.rhat(chain_rows(spark, raw), ["param"]).agg({"rhat": "max"}).first()[0]
    assert got["rhat_multivariate"] >= each - 1e-9


def plain_thin(z, limit=60):
    """Smallest stride at which the thinned 0/1 series passes as a first-order chain, and its moves."""
    for k in range(1, limit):
        y = z[::k]
        if len(y) < 3:
            return None
        n = np.zeros((2, 2, 2))
        np.add.at(n, (y[:-2], y[1:-1], y[2:]), 1)
        want = n.sum(axis=2)[:, :, None] * n.sum(axis=0)[None] / np.maximum(n.sum(axis=(0, 2)), 1)[None, :, None]
        g2 = 2 * sum(n[i] * np.log(n[i] / want[i]) for i in np.ndindex(2, 2, 2) if n[i] > 0)
        if g2 < 2 * np.log(max(len(y) - 2, 1)):
            moves = np.zeros((2, 2), int)
            np.add.at(moves, (y[:-1], y[1:]), 1)
            return k, moves
    return None


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_thinning(spark, block):
    """Chains whose indicator needs no thinning, a few steps, and more than one pass of strides; one too short to say."""
    rng = np.random.default_rng(12)
    noise = rng.normal(size=(2, 6040))
    raw = {"free": noise[:, :2000], "few": sum(noise[:, k: 4000 + k] for k in range(5)), "slow": np.sin(2 * np.pi * np.arange(6000) / 53) + 0.1 * noise[:, :6000], "short": noise[:, :3]}
    got = G.draws_needed(chain_rows(spark, raw), ["param"], q=0.2, block=block).toPandas()
    assert len(got) == 8
    for row in got.itertuples():
        x = raw[row.param][row.chain]
        want = plain_thin((x <= np.quantile(x, 0.2)).astype(int))
        if want is None:
            assert np.isnan(row.thin)
        else:
            assert row.thin == want[0] and [[row.n00, row.n01], [row.n10, row.n11]] == want[1].tolist()
    assert got[got["param"] == "slow"]["thin"].max() > 8 > got[got["param"] == "free"]["thin"].max()


def test_dic_models(spark):
    """The better rates win; the penalty is half the mean symmetric divergence of chain pairs."""
    rng = np.random.default_rng(4)
    n, k = np.array([40, 60, 20]), np.array([10, 45, 9])
    sites = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(n, k))], "site_id int, tests bigint, successes bigint")
    theta = {"good": rng.beta(k + 1, n - k + 1, (3, 30, 3)), "flat": rng.beta(2, 2, (3, 30, 3))}
    frames = {
        name: spark.createDataFrame([(i, c, t + 1, float(x[c, t, i])) for c in range(3) for t in range(30) for i in range(3)], "site_id int, chain int, draw int, value double")
        for name, x in theta.items()
    }
    got = G.dic_models(frames, sites, ["site_id"]).collect()
    assert [r["model"] for r in got] == ["good", "flat"]
    for r in got:
        x = theta[r["model"]]
        lo = np.log(x / (1 - x))
        pairs = [(n * (x[a] - x[b]) * (lo[a] - lo[b])).sum(axis=1).mean() / 2 for a, b in ((0, 1), (0, 2), (1, 2))]
        assert r["penalty"] == pytest.approx(np.mean(pairs)) and r["dic"] == pytest.approx(r["mean_deviance"] + r["penalty"])


def test_summary_of_blocks(spark):
    """Draws in arrays give the summary of the same draws in rows: several blocks a key, nulls, repeats, null keys."""
    rng = np.random.default_rng(3)
    rows = [(k, b, [round(float(v), 1) for v in rng.normal(size=13)]) for k in ("a", "b", None) for b in range(4)]
    rows += [("a", 0, rows[0][2]), ("b", 4, [None, 2.0, None]), ("gone", 0, [None]), ("one", 0, [0.25]), ("none", 0, None)]
    blocks = spark.createDataFrame(rows, "k string, block int, value array<double>")
    plain = blocks.select("k", F.explode("value").alias("value"))
    for sample in (False, True):
        want = {r[0]: r[1:] for r in D.posterior_summary(plain, ["k"], 0.9, sample).collect()}
        got = {r[0]: r[1:] for r in D.summary_of_blocks(blocks, ["k"], 10, 0.9, sample).collect()}
        assert set(got) == set(want) == {"a", "b", None, "one"}
        for k in want:
            assert got[k] == pytest.approx(want[k])


def test_blocks_are_sorted_in_bounded_parts(spark, monkeypatch):
    """As many tasks as the number of draws needs, and one shuffle of them."""
    monkeypatch.setattr(D, "TASK_DRAWS", 10)
    blocks = spark.range(100).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("value"))
    plan = D.summary_of_blocks(blocks, ["id"], 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 100), REPARTITION_BY_NUM" in plan


def test_dic_of_draws_with_counts(spark):
    """Draws that bring their counts give what joined counts give, and are not joined."""
    sites = spark.createDataFrame([(i, 5 + i, i) for i in range(5)], "site_id int, tests bigint, successes bigint")
    draws = spark.range(200).select(
        (F.col("id") % 5).cast("int").alias("site_id"), (F.col("id") % 2).cast("int").alias("chain"), F.floor(F.col("id") / 10).alias("draw"),
        (F.abs(F.sin("id")) * 0.9 + 0.05).alias("value"),
    )
    alone = G.dic(draws.join(sites, "site_id").localCheckpoint())
    assert alone.first() == pytest.approx(G.dic(draws, sites, ["site_id"]).first())
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()
