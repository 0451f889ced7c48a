"""Readers, writers, checks, scalar helpers and edge cases."""

import datetime as dt
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sitesight.functions import scalars as C
from sitesight.operators import checks, facts, kpi, shrinkage
from sitesight.sources import tables as T
from sitesight.workspace import scratch_dir
from tests.planted import site_rows

EDGE = [
    ("r1", "a", 1, 0, 0),
    ("r1", "a", 2, 10, 5),
    ("r1", "a", 3, 12, 7),
    ("r1", "solo", 4, 9, 9),
    ("r2", "a", 5, 20, 4),
    ("r2", "b", 6, 20, 4),
    ("r2", "b", 6, 30, 3),
]


@pytest.fixture(scope="module")
def edge(spark):
    return site_rows(spark, EDGE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_half_even(spark):
    values = [one(spark, C.successes_from_rate(F.lit(5), F.lit(r))) for r in (0.5, 0.1, 0.3, 0.7)]
    assert values == [2, 0, 2, 4]


def test_month_labels(spark):
    got = [one(spark, C.month_from_label(F.lit(t))) for t in ("out/24", "dez/24", "mar/25", "xyz/25")]
    assert got == [dt.date(2024, 10, 1), dt.date(2024, 12, 1), dt.date(2025, 3, 1), None]
    assert one(spark, C.month_label(F.lit(dt.date(2025, 2, 1)))) == "fev/25"


def test_interval_text(spark):
    rows = [(0.421, 0.513), (0.38, 0.4764)]
    assert [one(spark, C.interval_text(F.lit(a), F.lit(b))) for a, b in rows] == ["[0.421, 0.513]", "[0.38, 0.476]"]


def test_log_gamma_column(spark):
    for x in (0.01, 0.5, 3.0, 40.5, 3e5):
        assert math.isclose(one(spark, C.log_gamma(F.lit(x))), math.lgamma(x), rel_tol=1e-12, abs_tol=1e-11)


def test_normal_quantile(spark):
    from statistics import NormalDist

    for p in (0.001, 0.02, 0.3, 0.5, 0.975, 0.9999):
        assert math.isclose(one(spark, C.normal_quantile(F.lit(p))), NormalDist().inv_cdf(p), rel_tol=1e-7, abs_tol=1e-8)


def test_logit_round_trip(spark):
    assert math.isclose(one(spark, C.inverse_logit(C.logit(F.lit(0.3)))), 0.3)


def test_parameter_index(spark):
    assert one(spark, C.parameter_index(F.lit("theta[17]"))) == 17


def test_checks(edge):
    assert {r["municipality"] for r in checks.split_municipalities(edge).collect()} == {"a"}
    assert [(r["site_id"], r["rows"]) for r in checks.repeated_sites(edge).collect()] == [(6, 2)]


def test_shrinkage_edges(edge):
    mun = shrinkage.municipality_estimates(edge)
    est = {(r["site_id"], r["tests"]): r for r in shrinkage.site_estimates(edge, mun).collect()}
    assert len(est) == len(EDGE)
    empty = est[(1, 0)]
    assert math.isclose(empty["mean_site"], empty["mean_mun"])
    solo = est[(4, 9)]
    assert math.isclose(solo["phi_site"], 20.0) and solo["mean_site"] < 1.0


def test_priorities_with_ties_and_single_site(edge):
    rows = shrinkage.site_estimates(edge, shrinkage.municipality_estimates(edge))
    ranked = kpi.prioritise_by_share(rows)
    assert ranked.count() == len(EDGE)
    assert checks.rank_violations(ranked, kpi.MUNICIPALITY).first()["violations"] == 0
    solo = kpi.with_impact(rows).where("municipality = 'solo'").first()
    assert solo["failures_norm"] == 0.0 and solo["impact"] == 0.0


def test_small_slices_give_same_lists(edge):
    rows = shrinkage.site_estimates(edge, shrinkage.municipality_estimates(edge))
    for fn in (kpi.prioritise_by_share, kpi.prioritise_by_impact, kpi.cumulative_impact, kpi.lift_worst_share):
        lists = [
            sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in out.collect())
            for out in (fn(rows), fn(rows, slice_rows=16))
        ]
        assert lists[0] == lists[1]


def test_attach_by_site_keeps_fan_out(edge):
    est = edge.select("site_id").distinct().withColumn("mean_site", F.lit(0.5))
    assert facts.attach_by_site(est, edge, ["tests"]).count() == len(EDGE)


def test_site_lists_are_split(spark):
    sites = site_rows(spark, [("r", "m", i, 1, 1) for i in range(25)])
    lists = facts.site_lists(sites, per_list=10, slice_rows=17).orderBy("part").collect()
    assert [r["n_sites"] for r in lists] == [10, 10, 5]
    assert [s for r in lists for s in r["sites"]] == list(range(25))


def test_first_per_group_skips_nulls(spark):
    df = spark.createDataFrame([("g", 1, None), ("g", 2, "x")], "k string, o int, v string")
    assert facts.first_per_group(df, ["k"], ["o"], ["o", "v"]).first()[1:] == (1, "x")


def test_required_columns_and_conditional_column(edge):
    with pytest.raises(T.MissingColumns):
        T.require_columns(edge, ["nope"])
    assert T.add_if_absent(edge, "tests", F.lit(1)) is edge
    assert "new" in T.add_if_absent(edge, "new", F.lit(1)).columns


def test_site_table_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("82", "X", "S1", 5, 0.5), ("83", "Y", "S2", 7, None)], T.SITE_SCHEMA)
    for fmt in ("parquet", "csv"):
        T.write_result(raw, f"{tmp_path}/{fmt}/Export", fmt)
        back = T.read_site_table(spark, f"{tmp_path}/{fmt}", fmt=fmt, sheet="Export")
        assert sorted(map(str, back.collect())) == sorted(map(str, raw.collect()))
    ready = {r["site_id"]: r for r in T.with_successes(back).collect()}
    assert ready["S1"]["successes"] == 2 and ready["S2"]["successes"] is None
    raw.createOrReplaceTempView("site_view")
    assert T.read_site_table(spark, table="site_view").count() == 2


def test_result_folder_union(spark, tmp_path):
    spark.createDataFrame([("a", 1.0)], "municipality string, mean double").write.parquet(f"{tmp_path}/m1")
    spark.createDataFrame([("b", 2.0, "x")], "municipality string, mean double, note string").write.parquet(f"{tmp_path}/m2")
    got = T.read_result_folder(spark, str(tmp_path))
    assert got.count() == 2 and {"note", "source_file"} <= set(got.columns)
    assert got.select("source_file").distinct().count() == 2


def test_month_partitions(spark, tmp_path, edge):
    T.write_result(edge.withColumn("month", F.lit(dt.date(2025, 4, 1))), f"{tmp_path}/out")
    assert [p.name for p in tmp_path.joinpath("out").iterdir() if p.name.startswith("month=")] == ["month=2025-04-01"]


def test_levels_and_draws_round_trip(spark, tmp_path, edge):
    levels = {"site": edge, "municipality": edge.groupBy("municipality").count()}
    T.write_levels(levels, str(tmp_path))
    back = T.read_levels(spark, str(tmp_path), ["site", "municipality"])
    assert back["site"].count() == len(EDGE)
    draws = spark.createDataFrame(
        [("mu", "r", None, None, 0, 1, 0.5), ("theta", "r", "m", "s", 1, 1, 0.7)], T.DRAW_SCHEMA
    )
    T.write_draws(draws, f"{tmp_path}/fit", observed=edge)
    one_param = T.read_draws(spark, f"{tmp_path}/fit", ["mu"])
    assert one_param.count() == 1
    assert "PartitionFilters: [isnotnull" in one_param._jdf.queryExecution().toString() or one_param.first()["param"] == "mu"


def test_guarded_write(spark, tmp_path, edge):
    assert T.guarded_write(edge, edge, f"{tmp_path}/ok") == len(EDGE)
    assert T.read_published(spark, f"{tmp_path}/ok").count() == len(EDGE)
    with pytest.raises(T.RowCountMismatch):
        T.guarded_write(edge.limit(3), edge, f"{tmp_path}/bad")
    with pytest.raises(FileNotFoundError):
        T.read_published(spark, f"{tmp_path}/bad")
    assert checks.row_counts(edge.limit(3), edge).first()["equal"] is False


@pytest.mark.parametrize("step", ["write", "count", "point", "clean"])
def test_a_crash_between_steps_loses_nothing(spark, tmp_path, edge, monkeypatch, step):
    """Whatever step fails, readers see one whole version; the next publish works."""
    path, first = f"{tmp_path}/table", edge.limit(4)
    T.guarded_write(first, first, path)
    reader = T.read_published(spark, path)

    def crash(*_):
        raise RuntimeError("lost")

    broken = edge.withColumn("site_id", F.when(F.rand() >= 0, F.raise_error(F.lit("lost")).cast("bigint"))) if step == "write" else edge
    if step == "point":
        monkeypatch.setattr(T, "_point_to", crash)
    if step == "clean":
        monkeypatch.setattr(T, "_without_old_versions", crash)
    with pytest.raises(Exception, match="lost|rows for"):
        T.guarded_write(broken, first if step == "count" else edge, path)
    monkeypatch.undo()
    assert T.read_published(spark, path).count() == (len(EDGE) if step == "clean" else 4) and reader.count() == 4
    T.guarded_write(edge, edge, path)
    assert T.read_published(spark, path).count() == len(EDGE)


def test_old_versions_go(spark, tmp_path, edge):
    for n in (1, 2, 3, 4):
        T.guarded_write(edge.limit(n), edge.limit(n), f"{tmp_path}/t")
    assert len([x for x in tmp_path.joinpath("t").iterdir() if x.name.startswith("version-")]) == 2
    assert T.read_published(spark, f"{tmp_path}/t").count() == 4


def fake_session(setting, master, by_code=None):
    context = SimpleNamespace(
        getConf=lambda: {"spark.checkpoint.dir": setting}, getCheckpointDir=lambda: by_code,
        master=master, applicationId="app-1",
    )
    return SimpleNamespace(sparkContext=context)


def test_scratch_folder_follows_the_session():
    assert scratch_dir(fake_session("hdfs://a/b/", "yarn")) == "hdfs://a/b/app-1"
    assert scratch_dir(fake_session(None, "yarn", "s3a://c/d")) == "s3a://c/d/app-1"
    with pytest.raises(RuntimeError):
        scratch_dir(fake_session(None, "yarn"))
    own = scratch_dir(fake_session(None, "local[2]"))
    assert own == scratch_dir(fake_session(None, "local[2]"))


def test_lost_table_is_built_again(spark):
    import os

    from sitesight.workspace import kept_once

    first = kept_once(spark, "here", "numbers", lambda: spark.range(5))
    for f in first.inputFiles():
        os.remove(f.removeprefix("file://"))
    assert kept_once(spark, "here", "numbers", lambda: spark.range(6)).count() == 6
