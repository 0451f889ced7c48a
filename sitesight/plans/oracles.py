"""Independent SQL for the registered queries, as ANSI as the checks allow."""

from __future__ import annotations

SITE = """
site_fact AS (
  SELECT r_name AS region, n_name AS municipality, c_custkey AS site_id,
         CAST(count(*) AS BIGINT) AS tests,
         CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS successes,
         sum(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*) AS rate
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3
)"""

MONTH = """
site_month AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         r_name AS region, n_name AS municipality, c_custkey AS site_id,
         CAST(count(*) AS BIGINT) AS tests,
         CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS successes,
         sum(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*) AS rate
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4
)"""


def _rho(g: str, n: str, k: str, n2: str, k2n: str, default: float) -> str:
    below = f"({n} - {n2} / nullif({n}, 0) - ({g} - 1))"
    p = f"({k} / nullif({n}, 0))"
    raw = f"((({k2n} - {k} * {p}) / nullif({p} * (1 - {p}), 0) - ({g} - 1)) / nullif({below}, 0))"
    return (
        f"CASE WHEN {raw} IS NULL OR {below} <= 0 THEN {1.0 / (default + 1)!r} "
        f"ELSE greatest(0.0001, least(0.99, {raw})) END"
    )


def estimates_ctes(source: str, period: str = "") -> str:
    """CTEs mun_sums, mun_raw, region_sums, region_est, mun_est and est over a site table."""
    p = f"{period}, " if period else ""
    on = " AND ".join(f"a.{c} = b.{c}" for c in ([period] if period else []) + ["region"])
    on_mun = on + " AND a.municipality = b.municipality"
    ap = f"a.{period}, " if period else ""
    return f"""
mun_sums AS (
  SELECT {p}region, municipality,
         sum(CASE WHEN tests > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS g,
         sum(tests)::DOUBLE AS n, sum(successes)::DOUBLE AS k,
         sum(tests::DOUBLE * tests) AS n2,
         sum(successes::DOUBLE * successes / tests) AS k2n,
         count(*)::BIGINT AS n_sites,
         min(tests - successes)::BIGINT AS min_failures, max(tests - successes)::BIGINT AS max_failures
  FROM {source} GROUP BY {p}region, municipality
),
mun_raw AS (
  SELECT {p}region, municipality, n_sites, min_failures, max_failures,
         n::BIGINT AS tests_mun, k::BIGINT AS successes_mun,
         1 / ({_rho('g', 'n', 'k', 'n2', 'k2n', 20)}) - 1 AS phi_site
  FROM mun_sums
),
region_sums AS (
  SELECT {p}region,
         sum(CASE WHEN tests_mun > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS g,
         sum(tests_mun)::DOUBLE AS n, sum(successes_mun)::DOUBLE AS k,
         sum(tests_mun::DOUBLE * tests_mun) AS n2,
         sum(successes_mun::DOUBLE * successes_mun / tests_mun) AS k2n
  FROM mun_raw GROUP BY {p}region
),
region_base AS (
  SELECT {p}region, n::BIGINT AS tests_region, k::BIGINT AS successes_region, k / n AS mean_region,
         1 / ({_rho('g', 'n', 'k', 'n2', 'k2n', 100)}) - 1 AS phi_mun,
         sqrt(k / n * (1 - k / n) / (n + 1)) AS sd_region
  FROM region_sums
),
region_est AS (
  SELECT *, greatest(0.0, mean_region - 1.96 * sd_region) AS lo_region,
         least(1.0, mean_region + 1.96 * sd_region) AS hi_region
  FROM region_base
),
mun_mean AS (
  SELECT a.*, b.tests_region, b.successes_region, b.mean_region, b.phi_mun, b.sd_region, b.lo_region, b.hi_region,
         (a.successes_mun + b.mean_region * b.phi_mun) / (a.tests_mun + b.phi_mun) AS mean_mun
  FROM mun_raw a JOIN region_est b ON {on}
),
mun_sd AS (SELECT *, sqrt(mean_mun * (1 - mean_mun) / (tests_mun + phi_mun + 1)) AS sd_mun FROM mun_mean),
mun_est AS (
  SELECT *, greatest(0.0, mean_mun - 1.96 * sd_mun) AS lo_mun, least(1.0, mean_mun + 1.96 * sd_mun) AS hi_mun
  FROM mun_sd
),
site_mean AS (
  SELECT {ap}a.site_id, a.tests, a.successes, a.rate, b.* {f'EXCLUDE ({period})' if period else ''},
         (a.successes + b.mean_mun * b.phi_site) / (a.tests + b.phi_site) AS mean_site
  FROM {source} a JOIN mun_est b ON {on_mun}
),
site_sd AS (SELECT *, sqrt(mean_site * (1 - mean_site) / (tests + phi_site + 1)) AS sd_site FROM site_mean),
est AS (
  SELECT *, greatest(0.0, mean_site - 1.96 * sd_site) AS lo_site,
         least(1.0, mean_site + 1.96 * sd_site) AS hi_site, tests - successes AS failures
  FROM site_sd
)"""


W_SITE = f"WITH {SITE}\n"
W_EST = f"WITH {SITE},\n{estimates_ctes('site_fact')}\n"
W_MONTH = f"WITH {MONTH},\n{estimates_ctes('site_month', 'month')}\n"


#: Label of the column month; fixed values: the abbreviations of the months.
MONTH_LABEL = (
    "['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(month)]"
    " || '/' || lpad(CAST(year(month) % 100 AS VARCHAR), 2, '0') AS month_label"
)


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round_even({expr}, {digits}) AS {name or expr}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


BANDS = """
site_bands AS (
  SELECT r_name AS region, 'tax ' || CAST(CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS VARCHAR) AS municipality, c_custkey AS site_id,
         count(*)::BIGINT AS tests,
         sum(CASE WHEN floor(l_discount * 100 + 0.5) + floor(l_tax * 100 + 0.5) <= 9 THEN 1 ELSE 0 END)::BIGINT AS successes,
         avg(CASE WHEN floor(l_discount * 100 + 0.5) + floor(l_tax * 100 + 0.5) <= 9 THEN 1.0::DOUBLE ELSE 0.0 END) AS rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3
)"""
W_BANDS = f"WITH {BANDS},\n{estimates_ctes('site_bands')}\n"


IMPACT = (
    "round_even((1 - mean_site) * (failures - min_failures) / (max_failures - min_failures + 1e-8), 9)"
)

SITE_SQL: dict[str, str] = {
    "site_fact": W_SITE + f"SELECT region, municipality, site_id, tests, successes, {r('rate')} FROM site_fact",
    "filter_region": W_SITE + "SELECT site_id, tests, successes FROM site_fact WHERE region = 'ASIA'",
    "filter_municipality": W_SITE
    + "SELECT site_id, tests, successes FROM site_fact WHERE municipality = 'NATION_7'",
    "filter_in_list": W_SITE
    + "SELECT municipality, site_id, tests FROM site_fact WHERE municipality IN ('NATION_3', 'NATION_11', 'NATION_20')",
    "filter_in_table": W_SITE
    + """SELECT municipality, site_id, tests FROM site_fact
         WHERE municipality IN (SELECT n_name FROM nation WHERE n_regionkey = 2)""",
    "filter_like": W_SITE
    + "SELECT municipality, site_id, tests FROM site_fact WHERE municipality LIKE '%NATION_1%'",
    "derive_successes": W_SITE
    + """SELECT site_id, tests, CAST(round_even(tests * round_even(rate, 2), 0) AS BIGINT) AS successes
         FROM site_fact""",
    "group_summary": W_SITE
    + """SELECT region, municipality, count(*)::BIGINT AS n_sites, sum(tests)::BIGINT AS tests,
                sum(successes)::BIGINT AS successes, count(DISTINCT tests)::BIGINT AS distinct_tests,
                max(tests)::BIGINT AS max_tests, """
    + f"{r('avg(rate)', 'mean_rate')}, {r('stddev_pop(rate)', 'sd_pop')}, {r('stddev_samp(rate)', 'sd_samp')}"
    + " FROM site_fact GROUP BY region, municipality",
    "group_municipality": W_SITE
    + f"""SELECT municipality, count(*)::BIGINT AS n_sites, {r('avg(rate)', 'mean_rate')}
         FROM site_fact GROUP BY municipality""",
    "distinct_groups": W_SITE + "SELECT DISTINCT region, municipality FROM site_fact",
    "group_counts": W_SITE
    + """SELECT count(DISTINCT region)::BIGINT AS regions, count(DISTINCT municipality)::BIGINT AS municipalities,
                count(*)::BIGINT AS sites, max(tests)::BIGINT AS max_tests FROM site_fact""",
    "pooled_rate": W_SITE
    + f"""SELECT region, municipality, sum(tests)::BIGINT AS tests, sum(successes)::BIGINT AS successes,
         {r('sum(successes)::DOUBLE / sum(tests)', 'pooled_rate')} FROM site_fact GROUP BY region, municipality""",
    "pooled_rate_rollup": W_SITE
    + f"""SELECT region, municipality, site_id,
         CAST(grouping(region) * 4 + grouping(municipality) * 2 + grouping(site_id) AS INTEGER) AS level,
         sum(tests)::BIGINT AS tests, sum(successes)::BIGINT AS successes,
         {r('sum(successes)::DOUBLE / sum(tests)', 'rate')}
         FROM site_fact GROUP BY ROLLUP (region, municipality, site_id)""",
    "raw_rates": W_SITE
    + f"""SELECT site_id, {r('successes::DOUBLE / nullif(tests, 0)', 'raw_rate')} FROM site_fact""",
    "group_codes": W_SITE
    + """SELECT region, municipality, site_id,
         dense_rank() OVER (ORDER BY region, municipality)::BIGINT AS group_id FROM site_fact""",
    "category_codes": W_SITE
    + """, m AS (SELECT DISTINCT municipality FROM site_fact), g AS (SELECT DISTINCT region FROM site_fact)
         SELECT s.site_id, s.municipality, s.region, mc.mun_idx, rc.region_idx FROM site_fact s
         JOIN (SELECT municipality, (row_number() OVER (ORDER BY municipality) - 1)::BIGINT AS mun_idx FROM m) mc
           ON s.municipality = mc.municipality
         JOIN (SELECT region, (row_number() OVER (ORDER BY region) - 1)::BIGINT AS region_idx FROM g) rc
           ON s.region = rc.region""",
    "site_row_index": W_SITE
    + """SELECT region, municipality, site_id,
         row_number() OVER (ORDER BY region, municipality, site_id)::BIGINT AS site_index FROM site_fact""",
    "municipality_region_map": W_SITE
    + "SELECT municipality, arg_min(region, site_id) AS region FROM site_fact GROUP BY municipality",
    "site_lists": W_SITE
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY region, municipality ORDER BY site_id) AS pos FROM site_fact)
         SELECT region, municipality, CAST((pos - 1) // 1000 AS BIGINT) AS part, count(*)::BIGINT AS n_sites,
                string_agg(CAST(site_id AS VARCHAR), ',' ORDER BY site_id) AS sites
         FROM p GROUP BY 1, 2, 3""",
    "failures": W_SITE + "SELECT site_id, tests - successes AS failures FROM site_fact",
    "failures_share_rank": W_EST
    + f"""SELECT region, municipality, site_id, failures, {r('failures::DOUBLE / tests_mun', 'failure_share')},
         row_number() OVER (PARTITION BY region, municipality ORDER BY failures DESC, site_id)::BIGINT AS rank
         FROM est""",
    "impact_by_municipality": W_EST
    + f"""SELECT region, municipality, site_id, failures,
         {r('(failures - min_failures) / (max_failures - min_failures + 1e-8)', 'failures_norm')},
         {r(IMPACT, 'impact', 9)} FROM est""",
    "impact_rank": W_EST
    + f"""SELECT region, municipality, site_id,
         row_number() OVER (PARTITION BY region, municipality ORDER BY {IMPACT} DESC, site_id)::BIGINT AS rank
         FROM est""",
    "impact_global": W_EST
    + """, lim AS (SELECT min(failures) AS lo, max(failures) AS hi FROM est),
         imp AS (SELECT region, municipality, site_id, failures,
                 round_even((1 - mean_site) * (failures - lo) / (hi - lo + 1e-8), 9) AS impact FROM est, lim)
         SELECT region, municipality, site_id, round_even(impact, 9) AS impact,
                dense_rank() OVER (ORDER BY impact DESC)::BIGINT AS rank FROM imp""",
    "cumulative_impact": W_EST
    + f""", i AS (SELECT region, municipality, site_id, mean_mun, {IMPACT} AS impact FROM est),
         c AS (SELECT *, sum(impact) OVER (PARTITION BY region, municipality ORDER BY impact DESC, site_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS impact_cum FROM i)
         SELECT region, municipality, site_id, {rs('impact', 'impact_cum', digits=9)},
                {r('impact_cum / mean_mun', 'gain')} FROM c""",
    "potential_gain": W_EST
    + f"""SELECT region, municipality, site_id, failures,
         {r('greatest(1 - mean_site, 0) * failures / tests_mun * 100', 'gain_percent')} FROM est""",
    "shrunk_rates": W_EST
    + f"SELECT region, municipality, site_id, {rs('mean_site', 'sd_site', 'lo_site', 'hi_site')} FROM est",
    "municipality_rates": W_EST
    + f"""SELECT region, municipality, n_sites, tests_mun, successes_mun,
         {rs('phi_site', 'phi_mun', 'mean_mun', 'sd_mun', 'lo_mun', 'hi_mun', 'mean_region', 'sd_region')} FROM mun_est""",
    "method_comparison": W_EST
    + f"""SELECT region, municipality, site_id, tests, successes, {r('rate', 'raw_rate')},
         {r('successes_mun::DOUBLE / tests_mun', 'pooled_rate')}, {rs('mean_site', 'lo_site', 'hi_site')},
         {r('hi_site - lo_site', 'width')} FROM est""",
    "prioritisation_share": W_EST
    + f"""SELECT region, municipality, site_id, {rs('lo_site', 'mean_site', 'hi_site', 'lo_mun', 'mean_mun', 'hi_mun')},
         failures, tests, successes, {r('failures::DOUBLE / tests_mun', 'failure_share')}, {r(IMPACT, 'impact', 9)},
         row_number() OVER (PARTITION BY region, municipality ORDER BY failures DESC, site_id)::BIGINT AS rank
         FROM est""",
    "prioritisation_impact": W_EST
    + f""", lim AS (SELECT min(failures) AS lo, max(failures) AS hi FROM est),
         imp AS (SELECT est.*, round_even((1 - mean_site) * (failures - lo) / (hi - lo + 1e-8), 9) AS impact FROM est, lim)
         SELECT region, municipality, site_id,
         {rs('lo_site', 'mean_site', 'hi_site', 'lo_mun', 'mean_mun', 'hi_mun')}, failures, tests, successes,
         {r('impact', digits=9)}, dense_rank() OVER (ORDER BY impact DESC)::BIGINT AS rank FROM imp""",
    "below_municipality": W_EST
    + f"SELECT region, municipality, site_id, {rs('mean_site', 'hi_site', 'mean_mun')} FROM est WHERE hi_site < mean_mun",
    "below_target": W_EST
    + f"SELECT region, municipality, site_id, {rs('mean_site', 'lo_site', 'hi_site')} FROM est WHERE hi_site < 0.8",
    "plus_two_points": W_EST
    + f"""SELECT region, municipality, site_id, {rs('mean_site', 'hi_site', 'mean_mun')} FROM est
         WHERE hi_site < mean_mun + 0.02""",
    "outlier_bands": W_BANDS
    + f"""SELECT region, municipality, {rs('mean_mun', 'lo_mun', 'hi_mun', 'mean_region')},
         CASE WHEN lo_mun > mean_region THEN 'high' ELSE 'low' END AS side FROM mun_est
         WHERE lo_mun > mean_region OR hi_mun < mean_region""",
    "critical_site_bands": W_BANDS
    + f"""SELECT region, municipality, site_id, {rs('mean_site', 'hi_site')},
         CASE WHEN hi_site < mean_mun THEN 'below municipality' ELSE 'below limit' END AS reason
         FROM est WHERE hi_site < mean_mun OR hi_site < 0.6""",
    "check_hierarchy_bands": f"WITH {BANDS}\n"
    + """SELECT municipality, count(DISTINCT region)::BIGINT AS regions FROM site_bands
         GROUP BY municipality HAVING count(DISTINCT region) > 1""",
    "check_unique_site_bands": f"WITH {BANDS}\n"
    + "SELECT site_id, count(*)::BIGINT AS rows FROM site_bands GROUP BY site_id HAVING count(*) > 1",
    "critical_sites": W_EST
    + f"""SELECT region, municipality, site_id, {rs('mean_site', 'hi_site')},
         CASE WHEN hi_site < mean_mun THEN 'below municipality' ELSE 'below limit' END AS reason
         FROM est WHERE hi_site < mean_mun OR hi_site < 0.6""",
    "target_impact": W_EST
    + f"SELECT region, municipality, site_id, {r('tests * (0.8 - mean_site)', 'target_impact')} FROM est",
    "target_impact_top": W_EST
    + f"""SELECT region, municipality, site_id, tests, {rs('mean_site', 'lo_site', 'hi_site')},
         {r('tests * (0.8 - mean_site)', 'target_impact')} FROM est
         ORDER BY round_even(tests * (0.8 - mean_site), 9) DESC, site_id, region, municipality LIMIT 10""",
    "worst_municipality": W_EST
    + f"""SELECT region, municipality, {rs('mean_mun', 'lo_mun', 'hi_mun')} FROM mun_est
         QUALIFY row_number() OVER (PARTITION BY region ORDER BY round_even(mean_mun, 9), municipality) <= 1""",
    "worst_region": W_EST
    + f"""SELECT region, {rs('mean_region', 'lo_region', 'hi_region')} FROM region_est
         ORDER BY round_even(mean_region, 9), region LIMIT 1""",
    "outlier_municipalities": W_EST
    + f"""SELECT region, municipality, {rs('mean_mun', 'lo_mun', 'hi_mun', 'mean_region')},
         CASE WHEN lo_mun > mean_region THEN 'high' ELSE 'low' END AS side FROM mun_est
         WHERE lo_mun > mean_region OR hi_mun < mean_region""",
    "what_if_worst_decile": W_EST
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round_even(mean_site, 9), site_id, municipality) AS pos,
                count(*) OVER (PARTITION BY region) AS n FROM est)
         SELECT region, CAST(sum(CASE WHEN pos <= floor(n * 0.1) THEN 1 ELSE 0 END) AS BIGINT) AS sites_lifted,
         round_even(sum(tests * mean_site) / sum(tests), 6) AS rate_before,
         round_even(sum(tests * CASE WHEN pos <= floor(n * 0.1) THEN greatest(mean_site, mean_region)
                                ELSE mean_site END) / sum(tests), 6) AS rate_after
         FROM p GROUP BY region""",
    "budget_share": W_EST
    + """, need AS (SELECT region, sum(greatest(tests * (0.8 - mean_site), 0)) AS need FROM est GROUP BY region)
         SELECT region, round_even(need, 4) AS need, round_even(need / (SELECT sum(need) FROM need), 6) AS share
         FROM need""",
    "volume_extremes": W_EST
    + """, med AS (SELECT quantile_cont(mean_site, 0.5) AS m FROM est)
         SELECT municipality, site_id, tests, round_even(mean_site, 6) AS mean_site,
                round_even(abs(mean_site - m), 6) AS distance,
                concat(CAST(site_id AS VARCHAR), ', ', municipality) AS label
         FROM est, med
         ORDER BY tests DESC, round_even(abs(mean_site - m), 9) DESC, site_id LIMIT 15""",
    "volume_against_rate": W_EST
    + """, med AS (SELECT quantile_cont(mean_site, 0.5) AS m FROM est),
         top AS (SELECT region, municipality, site_id, concat(CAST(site_id AS VARCHAR), ', ', municipality) AS label FROM est, med
                 ORDER BY tests DESC, round_even(abs(mean_site - m), 9) DESC, site_id LIMIT 15)
         SELECT region, municipality, site_id, tests, round_even(mean_site, 6) AS mean_site, label
         FROM est LEFT JOIN top USING (region, municipality, site_id)""",
    "median_rate": W_EST
    + f"SELECT region, {r('quantile_cont(mean_site, 0.5)', 'median')} FROM est GROUP BY region",
    "management_report": W_EST
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round_even(mean_mun, 9) DESC, municipality DESC) AS hi_pos,
                row_number() OVER (PARTITION BY region ORDER BY round_even(mean_mun, 9), municipality) AS lo_pos FROM mun_est)
         SELECT '1 region' AS section, region, region AS subject, round_even(mean_region, 6) AS value,
                '[' || round_even(lo_region, 3) || ', ' || round_even(hi_region, 3) || ']' AS interval FROM region_est
         UNION ALL SELECT '2 best municipality', region, municipality, round_even(mean_mun, 6),
                '[' || round_even(lo_mun, 3) || ', ' || round_even(hi_mun, 3) || ']' FROM b WHERE hi_pos = 1
         UNION ALL SELECT '3 worst municipality', region, municipality, round_even(mean_mun, 6),
                '[' || round_even(lo_mun, 3) || ', ' || round_even(hi_mun, 3) || ']' FROM b WHERE lo_pos = 1
         UNION ALL SELECT '4 critical site', region, CAST(site_id AS VARCHAR), round_even(mean_site, 6),
                '[' || round_even(lo_site, 3) || ', ' || round_even(hi_site, 3) || ']' FROM est
                WHERE hi_site < mean_mun""",
    "check_rank": W_EST
    + """, f AS (SELECT region, municipality, min(rn) AS lowest FROM (
            SELECT region, municipality, row_number() OVER (PARTITION BY region, municipality ORDER BY failures DESC, site_id) AS rn
            FROM est) GROUP BY 1, 2)
         SELECT count(*)::BIGINT AS groups, sum(CASE WHEN lowest <> 1 THEN 1 ELSE 0 END)::BIGINT AS violations FROM f""",
    "check_rowcount": W_EST
    + """SELECT (SELECT count(*) FROM est)::BIGINT AS result_rows, (SELECT count(*) FROM site_fact)::BIGINT AS source_rows,
         (SELECT count(*) FROM est) = (SELECT count(*) FROM site_fact) AS equal""",
    "check_hierarchy": W_SITE
    + """SELECT municipality, count(DISTINCT region)::BIGINT AS regions FROM site_fact
         GROUP BY municipality HAVING count(DISTINCT region) > 1""",
    "check_unique_site": W_SITE
    + "SELECT site_id, count(*)::BIGINT AS rows FROM site_fact GROUP BY site_id HAVING count(*) > 1",
    "check_unique_site_month": f"WITH {MONTH}\n"
    + "SELECT site_id, count(*)::BIGINT AS rows FROM site_month GROUP BY site_id HAVING count(*) > 1",
    "summary_with_counts": W_EST
    + f"""SELECT s.region, s.municipality, s.site_id, {rs('mean_site', 'sd_site')}, s.tests, s.successes
         FROM est JOIN site_fact s ON est.region = s.region AND est.municipality = s.municipality
          AND est.site_id = s.site_id""",
    "attach_tests_inner": W_EST
    + f"SELECT est.site_id, {r('mean_site')}, s.tests FROM est JOIN site_fact s ON est.site_id = s.site_id",
    "attach_tests_left": W_EST
    + f"""SELECT c_custkey AS site_id, c_mktsegment AS segment, s.tests FROM customer
         LEFT JOIN site_fact s ON c_custkey = s.site_id""",
    "first_row_per_group": W_EST
    + """SELECT region, municipality, arg_min(site_id, site_id) AS site_id, arg_min(tests, site_id) AS tests
         FROM est GROUP BY region, municipality""",
    "group_preview": W_SITE
    + """SELECT region, municipality, site_id, tests FROM site_fact
         QUALIFY row_number() OVER (PARTITION BY region, municipality ORDER BY site_id) <= 3""",
    "labelled_month": W_SITE + "SELECT site_id, tests, 'out/24' AS month_label FROM site_fact",
    "month_labels": f"WITH {MONTH}\n"
    + """SELECT DISTINCT month,
         ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(month)]
           || '/' || lpad(CAST(year(month) % 100 AS VARCHAR), 2, '0') AS month_label FROM site_month""",
    "guarded_ratio": W_EST
    + f"""SELECT site_id, {r('successes::DOUBLE / nullif(failures, 0)', 'odds')},
         {r('failures / (max_failures - min_failures + 1e-8)', 'guarded')} FROM est""",
    "logit_rates": W_EST
    + f"""SELECT site_id, {r('ln(mean_site / (1 - mean_site))', 'logit')},
         {r('1 / (1 + exp(-ln(mean_site / (1 - mean_site))))', 'back')} FROM est""",
    "log_likelihood_terms": W_SITE
    + f"""SELECT site_id, {r('lgamma(tests + 0.5)', 'log_gamma')},
         {r('lgamma(successes + 2) + lgamma(tests - successes + 2) - lgamma(tests + 4)', 'log_beta')}
         FROM site_fact""",
    "param_index": W_SITE
    + """, named AS (SELECT 'rate[' || site_id || ']' AS name, tests FROM site_fact)
         SELECT name, CAST(regexp_extract(name, '\\[(\\d+)\\]', 1) AS INTEGER) AS idx, tests FROM named""",
    "posterior_semi": W_SITE
    + """, est AS (SELECT municipality FROM site_fact GROUP BY 1 HAVING sum(tests) > 2400)
         SELECT site_id, municipality FROM site_fact WHERE municipality IN (SELECT municipality FROM est)""",
    "posterior_anti": W_SITE
    + """, est AS (SELECT municipality FROM site_fact GROUP BY 1 HAVING sum(tests) > 2400)
         SELECT site_id, municipality FROM site_fact WHERE municipality NOT IN (SELECT municipality FROM est)""",
    "monthly_rates": W_MONTH
    + f"SELECT month, region, municipality, tests_mun, {rs('mean_mun', 'lo_mun', 'hi_mun', digits=9)} FROM mun_est",
    "monthly_sites": W_MONTH
    + f"SELECT month, region, municipality, site_id, {rs('mean_site', 'lo_site', 'hi_site', digits=9)} FROM est",
    "panel_union": W_MONTH
    + f"""SELECT DISTINCT region, municipality, {rs('lo_mun', 'mean_mun', 'hi_mun', digits=9)}, month FROM mun_est""",
    "improved_municipalities": W_MONTH
    + """, e AS (SELECT min(month) AS f, max(month) AS l FROM mun_est)
         SELECT a.region, a.municipality, round_even(a.lo_mun, 9) AS lo_mun, round_even(b.mean_mun, 9) AS mean_first
         FROM mun_est a JOIN mun_est b ON a.region = b.region AND a.municipality = b.municipality, e
         WHERE a.month = e.l AND b.month = e.f AND a.lo_mun > b.mean_mun""",
    "month_series": W_MONTH
    + """, e AS (SELECT min(month) AS f, max(month) AS l FROM mun_est),
         chosen AS (SELECT a.region, a.municipality FROM mun_est a JOIN mun_est b ON a.region = b.region AND a.municipality = b.municipality, e
                    WHERE a.month = e.l AND b.month = e.f AND a.mean_mun > b.mean_mun)
         SELECT region, municipality, month, round_even(lo_mun, 9) AS lo_mun, round_even(mean_mun, 9) AS mean_mun,
                round_even(hi_mun, 9) AS hi_mun FROM mun_est SEMI JOIN chosen USING (region, municipality)""",
}
