"""Queries do the whole job that they are named for, on rows made here."""

import pandas as pd
import pytest

from sitesight.operators import draws as D
from sitesight.operators import grid_posterior as P
from sitesight.operators import model_spec as M
from sitesight.plans import model_oracles as O
from sitesight.plans import model_queries as Q
from sitesight.plans.oracles import rs
from sitesight.plans.shared_tables import site_month
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Four places in two regions, twelve sites, two months; one place has successes only."""
    d = tmp_path_factory.mktemp("made")
    rows = range(240)
    tables = {
        "region": {"r_regionkey": [0, 1], "r_name": ["R0", "R1"]},
        "nation": {"n_nationkey": range(4), "n_regionkey": [0, 0, 1, 1], "n_name": [f"N{i}" for i in range(4)]},
        "customer": {"c_custkey": range(12), "c_nationkey": [i % 4 for i in range(12)]},
        "orders": {"o_orderkey": range(80), "o_custkey": [i * 5 % 12 for i in range(80)]},
        "lineitem": {
            "l_orderkey": [i % 80 for i in rows],
            "l_shipdate": pd.to_datetime([f"2024-0{1 + i // 80 % 2}-15" for i in rows]),
            "l_returnflag": ["R" if i * 7 % 10 < 3 and i % 80 * 5 % 4 != 1 else "N" for i in rows],
        },
    }
    for name, columns in tables.items():
        pd.DataFrame(columns).to_parquet(f"{d}/{name}.parquet", coerce_timestamps="us")
    return str(d)


def test_months_are_fitted_on_the_whole_grids(spark, made):
    """Ten points of each precision, a hundred cells of each mean, as ``three_level`` has them, in the job and its SQL."""
    got = Q.QUERIES["posterior_by_month"](spark, made)
    assert compare(got, connect(made), Q.ORACLES["posterior_by_month"]) is None
    whole = P.fit_on_grid(site_month(spark, made), M.three_level(), ["month"]).municipalities
    want = {(r.month, r.municipality): (r.mean_mun, r.sd_mun) for r in whole.collect()}
    found = {(r.month, r.municipality): (r.mean_mun, r.sd_mun) for r in got.collect()}
    assert len(found) == 8 and found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("n", [2, 3])
def test_inner_products_give_the_sums_of_joined_rows(made, n):
    """The SQL of the whole grids is that of the small ones with lists."""
    model = M.three_level(n, mean_cells=20, region_mean=M.beta(2, 2, 6))
    con = connect(made)
    rows = con.execute(O.full_month_sql(model)).fetchall()
    plain = con.execute(O.month_sql(model, f"SELECT month, region, municipality, {rs('mean_mun', 'sd_mun')} FROM mun")).fetchall()
    assert len(rows) == 8 and sorted(rows) == sorted(plain)


def test_site_draws_are_summarised_by_the_named_operators(spark, made, monkeypatch):
    """All levels are drawn as long tables, and the sites' draws go through ``posterior_summary``."""
    tables, seen = [], []
    drawn, summary = Q.sampling.posterior_draws, Q.draws.posterior_summary
    monkeypatch.setattr(Q.sampling, "posterior_draws", lambda *a, **k: tables.append(drawn(*a, **k)) or tables[-1])
    monkeypatch.setattr(Q.draws, "posterior_summary", lambda rows, *a, **k: seen.append(rows) or summary(rows, *a, **k))
    got = {r.site_id: r for r in Q.QUERIES["posterior_draws"](spark, made).collect()}
    assert len(tables) == len(seen) == 1 and set(tables[0]) == {"shared", "region_mean", "municipality_mean", "site_rate"}
    assert seen[0].columns == ["param", "region", "municipality", "site_id", "chain", "draw", "value"]
    long = seen[0].toPandas()
    assert len(got) == 12 and len(long) == 12 * 500 and not long.duplicated(["site_id", "chain", "draw"]).any()
    for site, x in long.groupby("site_id")["value"]:
        x = sorted(x)
        low = min(range(25), key=lambda i: x[i + 475] - x[i])
        want = (sum(x) / 500, pd.Series(x).std(ddof=0), x[low], x[low + 475])
        assert tuple(got[site])[3:] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("sample", [False, True])
@pytest.mark.parametrize("slice_rows", [1000, 30, 3])
def test_summaries_of_keys_of_any_size(spark, slice_rows, sample):
    """Keys in one array and keys in slices: the rows of ``moments`` and ``hdi``, with null keys, null draws and mixed order."""
    rows = [(None if i % 7 == 3 else f"k{i % 7}", i % 2, i, None if i % 11 == 0 or i % 7 == 5 else (i * 37 % 101) / 8) for i in range(300)]
    rows += [("one", 0, 1, 2.5), ("hole", 1, 1, None), ("odd", 0, 1, float("nan")), ("odd", 0, 2, 1.0)]
    long = spark.createDataFrame(rows, "k string, g int, draw int, value double").repartition(3, "draw")
    plain = D.same_keys(D.moments(long, ["k", "g"], sample), D.hdi(long, ["k", "g"], 0.8), ["k", "g"])
    got, want = ({(r.k, r.g): tuple(r)[2:] for r in t.collect()} for t in (D.posterior_summary(long, ["k", "g"], 0.8, sample, slice_rows), plain))
    assert got.keys() == want.keys() and len(got) == 14 and ("hole", 1) not in got
    assert all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)
    assert D.posterior_summary(long.where("k = 'none'"), ["k", "g"], 0.8, sample, slice_rows).count() == 0
