"""Plans of the main queries: what reaches the scan, what is shuffled, what is broadcast."""

import pytest

from sitesight.operators import facts, kpi
from sitesight.plans import site_queries as Q
from sitesight.plans.registry import QUERIES
from sitesight.plans.shared_tables import build_site_fact, draws_fact, site_fact


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(facts.in_region(site_fact(spark, sf_dir), "ASIA").select("site_id"))
    assert "EqualTo(region,ASIA)" in text and "tests" not in text.split("ReadSchema")[1]
    text = plan(facts.in_list(site_fact(spark, sf_dir), ["NATION_3", "NATION_4"]))
    assert "In(municipality" in text


def test_fact_reads_few_columns_and_combines_early(spark, sf_dir):
    text = plan(build_site_fact(spark, sf_dir))
    assert "struct<l_orderkey:bigint,l_returnflag:string>" in text
    assert "partial_count" in text and "partial_sum" in text


@pytest.mark.parametrize(
    "name",
    ["failures_share_rank", "prioritisation_share", "impact_by_municipality", "cumulative_impact",
     "below_municipality", "pooled_rate_rollup", "shrunk_rates", "monthly_sites"],
)
def test_no_single_partition(name, spark, sf_dir):
    assert "SinglePartition" not in plan(QUERIES[name](spark, sf_dir))


def test_parents_attach_without_a_shuffle(spark, sf_dir):
    text = plan(kpi.with_failure_share(Q.estimates(spark, sf_dir)))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_parents_too_large_to_broadcast_are_shuffled(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        text = plan(Q.estimates(spark, sf_dir))
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bottom_k_limits_before_the_shuffle(spark, sf_dir):
    assert plan(kpi.worst_municipalities(Q.municipalities(spark, sf_dir))).count("WindowGroupLimit") == 2


def test_top_n_takes_ordered(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(kpi.target_impact_top(Q.estimates(spark, sf_dir), 10))


def test_no_products_of_tables(spark, sf_dir):
    for name in ("impact_global", "budget_share", "prob_greater", "posterior_three_level", "improved_municipalities"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_draw_filter_reaches_the_scan(spark, sf_dir):
    assert "PushedFilters: [In(param" in plan(draws_fact(spark, sf_dir).where("param in ('click', 'view')"))


def test_large_tables_are_dealt_by_their_rows(spark, monkeypatch, tmp_path):
    """Line items in as many tasks as their number needs, whatever the session's partitions; the same counts."""
    from sitesight import workspace
    from sitesight.plans import shared_tables as T

    spark.range(1, 401).toDF("l_orderkey").selectExpr(
        "nullif(l_orderkey % 90, 7) as l_orderkey", "timestamp'2024-01-15' + make_interval(0, int(l_orderkey % 3)) as l_shipdate",
        "case when l_orderkey % 5 = 0 then 'R' when l_orderkey % 5 = 1 then null else 'N' end as l_returnflag",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(92).selectExpr("id % 80 as o_orderkey").selectExpr("o_orderkey", "nullif(o_orderkey % 9, 4) as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(13).selectExpr("id % 10 as c_custkey").selectExpr("c_custkey", "c_custkey % 2 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).toDF("n_nationkey").selectExpr("n_nationkey", "0 as n_regionkey", "string(n_nationkey) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("select 0 as r_regionkey, 'R' as r_name").write.parquet(f"{tmp_path}/region.parquet")
    for build, exchanges in ((T.build_site_month, 2), (T.build_site_fact, 1)):
        plain = sorted(build(spark, str(tmp_path)).collect(), key=str)
        with monkeypatch.context() as m:
            m.setattr(workspace, "TASK_ROWS", 10)
            dealt = build(spark, str(tmp_path))
            assert dealt._jdf.queryExecution().executedPlan().toString().count(", 40), REPARTITION_BY_NUM") == exchanges
            assert plain and sorted(dealt.collect(), key=str) == plain


def test_draws_of_models_are_made_by_site(spark, monkeypatch):
    """Draws at fixed steps lie by site: they are joined and paired without a shuffle of their own."""
    from sitesight import workspace
    from sitesight.operators import diagnostics
    from sitesight.plans import draw_queries as Q

    rows = [("r", f"m{i % 3}", i, 20 + i, 3 + i, 0.2, 0.3) for i in range(40)] * 2
    sites = spark.createDataFrame(rows, "region string, municipality string, site_id long, tests long, successes long, mean_mun double, mean_site double")
    plain = diagnostics.dic_models(Q._fixed_draws(sites, spark), sites, Q.SITE_KEYS).collect()
    monkeypatch.setattr(workspace, "TASK_ROWS", 100)
    dealt = diagnostics.dic_models(Q._fixed_draws(sites, spark), sites, Q.SITE_KEYS)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(draw#" in plan
    assert not any("Exchange hashpartitioning(draw" in line and "site_id" in line for line in plan.splitlines())
    for a, b in zip(dealt.collect(), plain, strict=True):
        assert a.model == b.model and tuple(a)[1:] == pytest.approx(tuple(b)[1:])
