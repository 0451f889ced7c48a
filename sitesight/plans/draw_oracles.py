"""Independent SQL for the draw queries."""

from __future__ import annotations

from sitesight.plans.oracles import MONTH, MONTH_LABEL, W_EST, W_SITE, r, rs

DRAWS = """
numbered AS (
  SELECT event_type AS param, CAST(user_id % 4 AS INTEGER) AS chain,
         row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id)::BIGINT AS draw, value
  FROM events
),
draws_fact AS (SELECT param, chain, draw, value FROM numbered)"""

W = f"WITH {DRAWS}\n"


def hdi_cte(source: str, keys: str, mass: float, name: str = "hdi") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_ranked AS (
  SELECT {keys}, value AS v, row_number() OVER (PARTITION BY {keys} ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY {keys}) AS n FROM {source}
),
{name} AS (
  SELECT {a_keys}, a.v AS hdi_lo, b.v AS hdi_hi
  FROM {name}_ranked a JOIN {name}_ranked b
    ON {on} AND b.rn = a.rn + CAST(floor(a.n * {mass}::DOUBLE) AS BIGINT)
  QUALIFY row_number() OVER (PARTITION BY {a_keys} ORDER BY b.v - a.v, a.rn) = 1
)"""


#: Rates at fixed steps around three estimates of each site.
_DRAWN = (
    W_EST
    + """, steps AS (SELECT CAST(i % 3 AS INTEGER) AS chain, CAST(i // 3 + 1 AS INTEGER) AS draw FROM (SELECT unnest(range(0, 60)) AS i)),
base AS (SELECT e.*, model, CASE model WHEN 'own' THEN (successes + 1)::DOUBLE / (tests + 2) WHEN 'municipality' THEN mean_mun ELSE mean_site END AS guess
         FROM est e CROSS JOIN (SELECT unnest(['own', 'municipality', 'shrunk']) AS model)),
drawn AS (SELECT *, least(greatest(guess + sqrt(guess * (1 - guess) / (tests + 20)) * sin(site_id + 17 * chain + 31 * draw), 0.001), 0.999) AS p
          FROM base CROSS JOIN steps)"""
)
_H94 = W.rstrip() + "," + hdi_cte("draws_fact", "param", 0.94)
_H95 = W.rstrip() + "," + hdi_cte("draws_fact", "param", 0.95)
_SUM95 = f"""SELECT d.param, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'sd')},
 {r('any_value(hdi_lo)', 'hdi_lo')}, {r('any_value(hdi_hi)', 'hdi_hi')}
 FROM draws_fact d JOIN hdi h ON d.param = h.param GROUP BY d.param"""
_QUANTILES = W + f"""SELECT param, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')},
 {r('quantile_cont(value, 0.025)', 'q2_5')}, {r('quantile_cont(value, 0.25)', 'q25')},
 {r('quantile_cont(value, 0.5)', 'q50')}, {r('quantile_cont(value, 0.75)', 'q75')},
 {r('quantile_cont(value, 0.975)', 'q97_5')} FROM draws_fact GROUP BY param"""


def rhat_cte(split: bool) -> str:
    half = (
        """SELECT d.param, d.chain, CASE WHEN draw > floor(len / 2) THEN 1 ELSE 0 END AS half, value
           FROM draws_fact d JOIN (SELECT param, chain, max(draw) AS len FROM draws_fact GROUP BY 1, 2) l
             ON d.param = l.param AND d.chain = l.chain"""
        if split
        else "SELECT param, chain, 0 AS half, value FROM draws_fact"
    )
    return f"""
halves AS ({half}),
chain_stats AS (SELECT param, chain, half, avg(value) AS m, var_samp(value) AS v, count(*)::DOUBLE AS n
                FROM halves GROUP BY 1, 2, 3),
rhats AS (SELECT param, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat
          FROM chain_stats GROUP BY 1)"""


ESS = """
mu AS (SELECT param, chain, avg(value) AS m, count(*) AS n FROM draws_fact GROUP BY 1, 2),
x AS (SELECT d.param, d.chain, d.draw, d.value - m AS x, n FROM draws_fact d JOIN mu
      ON d.param = mu.param AND d.chain = mu.chain),
acov AS (SELECT a.param, a.chain, l.lag, sum(a.x * b.x) / any_value(a.n) AS c, any_value(a.n) AS n
         FROM x a CROSS JOIN (SELECT unnest(range(0, 65)) AS lag) l
         JOIN x b ON a.param = b.param AND a.chain = b.chain AND b.draw = a.draw + l.lag GROUP BY 1, 2, 3),
macov AS (SELECT param, lag, avg(c) AS a FROM acov GROUP BY 1, 2),
btw AS (SELECT param, coalesce(var_samp(m), 0) AS b, count(*) AS chains, avg(n) AS n, sum(n) AS total FROM mu GROUP BY 1),
rho AS (SELECT q.param, q.lag, total, CASE WHEN q.lag = 0 THEN 1.0::DOUBLE
          ELSE 1 - (z.a * n / (n - 1) - q.a) / (z.a + CASE WHEN chains > 1 THEN b ELSE 0 END) END AS rho
        FROM macov q JOIN macov z ON q.param = z.param AND z.lag = 0 JOIN btw ON q.param = btw.param),
pairs AS (SELECT param, lag // 2 AS k, sum(rho) AS p, any_value(total) AS total
          FROM rho GROUP BY 1, 2 HAVING count(*) = 2),
mono AS (SELECT *, min(p) OVER (PARTITION BY param ORDER BY k) AS low FROM pairs),
ess AS (SELECT param, any_value(total)::DOUBLE / (2 * sum(CASE WHEN low >= 0 THEN low ELSE 0 END) - 1) AS ess
        FROM mono GROUP BY 1)"""

# Coefficients of Acklam's rational approximation to the normal quantile (published).
_C = "-7.784894002430293e-03 -3.223964580411365e-01 -2.400758277161838 -2.549732539343734 4.374664141464968 2.938163982698783".split()
_D = "7.784695709041462e-03 3.224671290700398e-01 2.445134137142996 3.754408661907416 1".split()
_A = "-3.969683028665376e+01 2.209460984245205e+02 -2.759285104469687e+02 1.383577518672690e+02 -3.066479806614716e+01 2.506628277459239".split()
_B = "-5.447609879822406e+01 1.615858368580409e+02 -1.556989798598866e+02 6.680131188771972e+01 -1.328068155288572e+01 1".split()


def polynomial(coefficients: list[str], x: str) -> str:
    n = len(coefficients)
    return "(" + " + ".join(f"({c})::DOUBLE * pow({x}, {n - 1 - k})" for k, c in enumerate(coefficients)) + ")"


def normal_score(p: str) -> str:
    tail = lambda x: f"{polynomial(_C, x)} / {polynomial(_D, x)}"
    return f"""CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 0.97575 THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')}
        ELSE ({p} - 0.5) * {polynomial(_A, f'pow({p} - 0.5, 2)')} / {polynomial(_B, f'pow({p} - 0.5, 2)')} END"""


#: Half chains with normal scores, plain and folded, tail indicators and squared distances.
SCORED = f"""
lim AS (SELECT param, avg(value) AS mean, median(value) AS mid, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95,
               count(*) AS n FROM draws_fact GROUP BY 1),
len AS (SELECT param, chain, max(draw) AS len FROM draws_fact GROUP BY 1, 2),
half AS (SELECT d.param, d.chain * 2 + CASE WHEN draw > floor(len / 2) THEN 1 ELSE 0 END AS chain, draw, value, abs(value - mid) AS away, mean, q05, q95, lim.n
         FROM draws_fact d JOIN len ON d.param = len.param AND d.chain = len.chain JOIN lim ON d.param = lim.param),
ranked AS (SELECT *, avg(rn) OVER (PARTITION BY param, value) AS r, avg(fn) OVER (PARTITION BY param, away) AS f FROM (
             SELECT *, row_number() OVER (PARTITION BY param ORDER BY value) AS rn, row_number() OVER (PARTITION BY param ORDER BY away) AS fn FROM half)),
shares AS (SELECT *, (r - 0.375) / (n + 0.25) AS p, (f - 0.375) / (n + 0.25) AS pf FROM ranked),
scored AS (SELECT param, chain, row_number() OVER (PARTITION BY param, chain ORDER BY draw) AS draw, value AS x, pow(value - mean, 2) AS square,
             {normal_score('p')} AS z, {normal_score('pf')} AS folded,
             CASE WHEN value <= q05 THEN 1.0::DOUBLE ELSE 0.0 END AS low, CASE WHEN value <= q95 THEN 1.0::DOUBLE ELSE 0.0 END AS high FROM shares)"""


def reduction_cte(name: str, column: str) -> str:
    return f"""{name} AS (SELECT param, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM (
        SELECT param, chain, avg({column}) AS m, var_samp({column}) AS v, count(*)::DOUBLE AS n FROM scored GROUP BY 1, 2) GROUP BY 1)"""


def size_cte(column: str) -> str:
    """Effective size of a column over half chains, from lags up to 64 (the test tables end long before)."""
    q = column
    return f"""
mu_{q} AS (SELECT param, chain, avg({q}) AS m, count(*) AS n FROM scored GROUP BY 1, 2),
x_{q} AS (SELECT d.param, d.chain, d.draw, d.{q} - m AS x, n FROM scored d JOIN mu_{q} USING (param, chain)),
a_{q} AS (SELECT a.param, l.lag, a.chain, sum(a.x * b.x) / any_value(a.n) AS c FROM x_{q} a CROSS JOIN (SELECT unnest(range(0, 65)) AS lag) l
          JOIN x_{q} b ON a.param = b.param AND a.chain = b.chain AND b.draw = a.draw + l.lag GROUP BY 1, 2, 3),
c_{q} AS (SELECT param, lag, avg(c) AS a FROM a_{q} GROUP BY 1, 2),
b_{q} AS (SELECT param, coalesce(var_samp(m), 0) AS b, avg(n) AS n, sum(n)::DOUBLE AS total FROM mu_{q} GROUP BY 1),
r_{q} AS (SELECT c.param, c.lag, total, CASE WHEN c.lag = 0 THEN 1.0::DOUBLE ELSE 1 - (z.a * n / (n - 1) - c.a) / (z.a + b) END AS rho
          FROM c_{q} c JOIN c_{q} z ON c.param = z.param AND z.lag = 0 JOIN b_{q} ON c.param = b_{q}.param),
p_{q} AS (SELECT param, lag // 2 AS k, sum(rho) AS p, any_value(total) AS total FROM r_{q} GROUP BY 1, 2 HAVING count(*) = 2),
l_{q} AS (SELECT *, min(p) OVER (PARTITION BY param ORDER BY k) AS low FROM p_{q}),
ess_{q} AS (SELECT param, any_value(total) / (2 * sum(CASE WHEN low >= 0 THEN low ELSE 0 END) - 1) AS e FROM l_{q} GROUP BY 1)"""


DRAW_SQL: dict[str, str] = {
    "draws_fact": W + f"SELECT param, chain, draw, {r('value')} FROM draws_fact",
    "draws_arrays_long": f"""SELECT vec_id, pos::BIGINT AS draw, {r('embedding[pos]::DOUBLE', 'value')}
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""",
    "draws_columns_long": W_SITE
    + """SELECT site_id, 'tests' AS param, tests AS value FROM site_fact
         UNION ALL SELECT site_id, 'successes', successes FROM site_fact""",
    "draws_thin": W
    + f"""SELECT param, chain, ((draw - 100) // 5)::BIGINT AS draw, {r('value')} FROM draws_fact
         WHERE draw > 100 AND (draw - 100) % 5 = 0""",
    "draws_pool": W
    + f"SELECT param, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'sd')} FROM draws_fact GROUP BY param",
    "draws_by_chain": W
    + f"""SELECT param, chain, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}
         FROM draws_fact GROUP BY param, chain""",
    "param_list": W + "SELECT DISTINCT param FROM draws_fact",
    "param_filter": W + f"SELECT param, chain, draw, {r('value')} FROM draws_fact WHERE param IN ('click', 'view')",
    "hdi_94": f"{_H94}\nSELECT param, {rs('hdi_lo', 'hdi_hi')} FROM hdi",
    "hdi_95": f"{_H95}\nSELECT param, {rs('hdi_lo', 'hdi_hi')} FROM hdi",
    "hdi_spread": f"{_H95}\nSELECT param, {rs('hdi_lo', 'hdi_hi')} FROM hdi",
    "hdi_municipality": f"WITH {MONTH},\nrates AS (SELECT region, municipality, rate AS value FROM site_month),"
    + hdi_cte("rates", "region, municipality", 0.95)
    + f"\nSELECT region, municipality, {rs('hdi_lo', 'hdi_hi')} FROM hdi",
    "draws_summary": f"{_H95}\n{_SUM95}",
    "quantile_summary": _QUANTILES,
    "quantile_spread": _QUANTILES,
    "rhat": f"{W.rstrip()},{rhat_cte(False)}\nSELECT param, {r('rhat')} FROM rhats",
    "rhat_split": f"{W.rstrip()},{rhat_cte(True)}\nSELECT param, {r('rhat')} FROM rhats",
    "effective_size": f"{W.rstrip()},{ESS}\nSELECT param, {r('ess')} FROM ess",
    "draws_needed": W.rstrip()
    + """,
u AS (SELECT param, chain, quantile_cont(value, 0.025) AS u FROM draws_fact GROUP BY 1, 2),
z AS (SELECT d.param, d.chain, d.draw, CASE WHEN value <= u THEN 1 ELSE 0 END AS z
      FROM draws_fact d JOIN u ON d.param = u.param AND d.chain = u.chain),
m AS (SELECT a.param, a.chain, k AS thin, a.z AS z0, b.z AS z1, c.z AS z2 FROM z a CROSS JOIN (SELECT unnest(range(1, 25)) AS k) s
      JOIN z b ON a.param = b.param AND a.chain = b.chain AND b.draw = a.draw + k
      LEFT JOIN z c ON a.param = c.param AND a.chain = c.chain AND c.draw = a.draw + 2 * k WHERE (a.draw - 1) % k = 0),
n3 AS (SELECT param, chain, thin, z0, z1, z2, count(*)::DOUBLE AS n FROM m WHERE z2 IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6),
g AS (SELECT param, chain, thin, 2 * sum(n * ln(n * mid / (l * rr))) AS g2 FROM (
        SELECT *, sum(n) OVER (PARTITION BY param, chain, thin, z1) AS mid, sum(n) OVER (PARTITION BY param, chain, thin, z0, z1) AS l,
               sum(n) OVER (PARTITION BY param, chain, thin, z1, z2) AS rr FROM n3) GROUP BY 1, 2, 3),
t AS (SELECT param, chain, thin,
        sum(CASE WHEN z0 = 0 AND z1 = 0 THEN 1 ELSE 0 END)::BIGINT AS n00,
        sum(CASE WHEN z0 = 0 AND z1 = 1 THEN 1 ELSE 0 END)::BIGINT AS n01,
        sum(CASE WHEN z0 = 1 AND z1 = 0 THEN 1 ELSE 0 END)::BIGINT AS n10,
        sum(CASE WHEN z0 = 1 AND z1 = 1 THEN 1 ELSE 0 END)::BIGINT AS n11, count(*) AS pairs FROM m GROUP BY 1, 2, 3),
best AS (SELECT t.* FROM t JOIN g USING (param, chain, thin) WHERE pairs > 1 AND g2 < 2 * ln(greatest(pairs - 1, 1))
         QUALIFY row_number() OVER (PARTITION BY param, chain ORDER BY thin) = 1),
ab AS (SELECT *, n01::DOUBLE / nullif(n00 + n01, 0) AS al, n10::DOUBLE / nullif(n10 + n11, 0) AS be FROM best),
f AS (SELECT *, thin * ceil(ln(0.001::DOUBLE * (al + be) / greatest(al, be)) / nullif(ln(abs(1 - al - be)), 0))::BIGINT AS burn_in,
        thin * ceil((2 - al - be) * al * be * 1.959963984540054::DOUBLE ** 2 / ((al + be) ** 3 * 0.005::DOUBLE ** 2))::BIGINT AS needed,
        ceil(0.025::DOUBLE * 0.975 / (0.005::DOUBLE ** 2) * 1.959963984540054::DOUBLE ** 2)::BIGINT AS least FROM ab)
"""
    + f"""SELECT param, chain, thin::INTEGER AS thin, n00, n01, n10, n11, burn_in, needed, least,
         {r('(burn_in + needed)::DOUBLE / least', 'dependence')} FROM f""",
    "rhat_limits": W.rstrip()
    + f""",
c AS (SELECT param, chain, avg(value) AS x, var_samp(value) AS v, count(*)::DOUBLE AS n FROM draws_fact GROUP BY 1, 2),
k AS (SELECT param, count(*)::DOUBLE AS m, avg(n) AS n, avg(v) AS w, avg(n) * var_samp(x) AS b, var_samp(v) / count(*) AS var_w,
        2 * pow(avg(n) * var_samp(x), 2) / (count(*) - 1) AS var_b,
        avg(n) / count(*) * (covar_samp(v, x * x) - 2 * avg(x) * covar_samp(v, x)) AS cov_wb FROM c GROUP BY 1),
p AS (SELECT *, (n - 1) / n * w + (1 + 1 / m) * b / n AS pooled,
        (pow(n - 1, 2) * var_w + pow(1 + 1 / m, 2) * var_b + 2 * (n - 1) * (1 + 1 / m) * cov_wb) / (n * n) AS var_p FROM k)
SELECT param, {r('m - 1', 'df_between')}, {r('2 * w * w / var_w', 'df_within')},
  {r('sqrt((2 * pooled * pooled / var_p + 3) / (2 * pooled * pooled / var_p + 1) * pooled / w)', 'rhat_adjusted')} FROM p""",
    "rhat_multivariate": W.rstrip()
    + f""",
x AS (SELECT a.chain, a.value AS a, b.value AS b FROM draws_fact a JOIN draws_fact b
      ON a.param = 'click' AND b.param = 'view' AND a.chain = b.chain AND a.draw = b.draw),
c AS (SELECT chain, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS vaa, var_samp(b) AS vbb, covar_samp(a, b) AS vab FROM x GROUP BY 1),
k AS (SELECT count(*) AS m, avg(n) AS n, avg(vaa) AS waa, avg(vbb) AS wbb, avg(vab) AS wab,
        var_samp(ma) AS baa, var_samp(mb) AS bbb, covar_samp(ma, mb) AS bab FROM c),
e AS (SELECT *, (wbb * baa - 2 * wab * bab + waa * bbb) / (waa * wbb - wab * wab) AS tr, (baa * bbb - bab * bab) / (waa * wbb - wab * wab) AS det FROM k)
SELECT m::INTEGER AS chains, {r('sqrt((n - 1) / n + (1 + 1.0::DOUBLE / m) * (tr / 2 + sqrt(tr * tr / 4 - det)))', 'rhat_multivariate')} FROM e""",
    "quantile_sketch_ranks": W
    + """SELECT param, quantile, true AS within FROM (SELECT DISTINCT param FROM draws_fact)
CROSS JOIN (SELECT unnest(['q2_5', 'q25', 'q50', 'q75', 'q97_5']) AS quantile)""",
    "dic_fixed": _DRAWN
    + f""", dev AS (SELECT chain, draw, -2 * sum(lgamma(tests + 1) - lgamma(successes + 1) - lgamma(tests - successes + 1)
             + successes * ln(p) + (tests - successes) * ln(1 - p)) AS d FROM drawn WHERE model = 'shrunk' GROUP BY 1, 2)
SELECT count(*) AS draws, {r('avg(d)', 'mean_deviance', 5)}, {r('var_samp(d) / 2', 'p_d', 5)}, {r('avg(d) + var_samp(d) / 2', 'dic', 5)} FROM dev""",
    "dic_models": _DRAWN
    + """,
dev AS (SELECT model, avg(d) AS mean_deviance, count(*) AS draws FROM (
          SELECT model, chain, draw, -2 * sum(lgamma(tests + 1) - lgamma(successes + 1) - lgamma(tests - successes + 1)
             + successes * ln(p) + (tests - successes) * ln(1 - p)) AS d FROM drawn GROUP BY 1, 2, 3) GROUP BY 1),
pen AS (SELECT model, avg(j) AS penalty FROM (
          SELECT a.model, a.draw, sum(a.tests * (a.p - b.p) * (ln(a.p / (1 - a.p)) - ln(b.p / (1 - b.p))) / 2) / 3 AS j
          FROM drawn a JOIN drawn b ON a.model = b.model AND a.region = b.region AND a.municipality = b.municipality
            AND a.site_id = b.site_id AND a.draw = b.draw AND a.chain < b.chain GROUP BY 1, 2) GROUP BY 1)
"""
    + f"""SELECT model, draws::BIGINT AS draws, {r('mean_deviance', digits=5)}, {r('penalty', digits=5)}, {r('mean_deviance + penalty', 'dic', digits=5)}
FROM dev JOIN pen USING (model)""",
    "rank_rhat": f"{W.rstrip()},{SCORED},{reduction_cte('bulk', 'z')},{reduction_cte('fold', 'folded')}"
    + f"""\nSELECT param, {r('bulk.rhat', 'rhat_bulk')}, {r('fold.rhat', 'rhat_folded')}, {r('greatest(bulk.rhat, fold.rhat)', 'rhat_rank')}
         FROM bulk JOIN fold USING (param)""",
    "full_summary": f"{_H94},{SCORED},{reduction_cte('plain', 'x')},{reduction_cte('bulk', 'z')},{reduction_cte('fold', 'folded')},"
    + ",".join(size_cte(c) for c in ("x", "square", "z", "low", "high"))
    + f""",
moments AS (SELECT param, avg(x) AS mean, stddev_samp(x) AS sd, avg(square) AS m2, avg(square * square) AS m4 FROM scored GROUP BY 1)
SELECT param, {rs('mean', 'sd', 'hdi_lo', 'hdi_hi')}, {r('ess_x.e', 'ess')}, {r('ess_z.e', 'ess_bulk')}, {r('least(ess_low.e, ess_high.e)', 'ess_tail')},
  {r('plain.rhat', 'rhat')}, {r('greatest(bulk.rhat, fold.rhat)', 'rhat_rank')}, {r('sd / sqrt(ess_x.e)', 'mcse_mean')},
  {r('sqrt((m4 - m2 * m2) / ess_square.e) / (2 * sqrt(m2))', 'mcse_sd')},
  coalesce(greatest(bulk.rhat, fold.rhat) < 1.01 AND ess_z.e > 100 AND least(ess_low.e, ess_high.e) > 100, false) AS converged
FROM moments JOIN hdi USING (param) JOIN plain USING (param) JOIN bulk USING (param) JOIN fold USING (param) JOIN ess_x USING (param)
  JOIN ess_square USING (param) JOIN ess_z USING (param) JOIN ess_low USING (param) JOIN ess_high USING (param)""",
    "prob_greater": W.rstrip()
    + f""",
m AS (SELECT param, round_even(avg(value), 9) AS m FROM draws_fact GROUP BY 1),
p AS (SELECT param AS better, lead(param) OVER (ORDER BY m DESC, param) AS worse FROM m)
SELECT better, worse, count(*)::BIGINT AS draws,
  {r('avg(CASE WHEN a.value > b.value THEN 1.0 ELSE 0.0 END)', 'prob')}
FROM p JOIN draws_fact a ON a.param = better JOIN draws_fact b
  ON b.param = worse AND a.chain = b.chain AND a.draw = b.draw
GROUP BY better, worse""",
    "estimates_on_rows": f"""{_H95},
s AS (SELECT d.param, avg(value) AS mean, any_value(hdi_lo) AS hdi_lo, any_value(hdi_hi) AS hdi_hi
      FROM draws_fact d JOIN hdi h ON d.param = h.param GROUP BY 1),
e AS (SELECT event_type AS param, CAST(ts AS DATE) AS day, count(*)::BIGINT AS tests,
        sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS successes FROM events GROUP BY 1, 2)
SELECT e.param, day, tests, successes, {r('successes::DOUBLE / tests', 'raw_rate')},
       {rs('mean', 'hdi_lo', 'hdi_hi')} FROM e LEFT JOIN s ON e.param = s.param""",
    "region_month_report": f"WITH {MONTH},\nrates AS (SELECT region, month, rate AS value FROM site_month),"
    + hdi_cte("rates", "region, month", 0.94)
    + """
SELECT q.region AS parameter, round_even(avg(value), 3) AS mean, round_even(stddev_samp(value), 3) AS std_dev,
  '[' || round_even(any_value(hdi_lo), 3) || ', ' || round_even(any_value(hdi_hi), 3) || ']' AS hdi_interval,
  """
    + MONTH_LABEL.replace("(month)", "(q.month)")
    + """
FROM rates q JOIN hdi h ON q.region = h.region AND q.month = h.month GROUP BY q.region, q.month""",
    "months_parsed": f"WITH {MONTH}\n"
    + """SELECT DISTINCT ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(month)]
           || '/' || lpad(CAST(year(month) % 100 AS VARCHAR), 2, '0') AS label, 
         month AS parsed, month
         FROM site_month""",
    "forest": f"""{_H94}
SELECT d.param, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'sd')},
 {r('any_value(hdi_lo)', 'hdi_lo')}, {r('any_value(hdi_hi)', 'hdi_hi')}, {r('quantile_cont(value, 0.25)', 'q25')},
 {r('quantile_cont(value, 0.5)', 'q50')}, {r('quantile_cont(value, 0.75)', 'q75')}
FROM draws_fact d JOIN hdi h ON d.param = h.param GROUP BY d.param""",
    "posterior_histogram": f"""{_H95},
lim AS (SELECT param, min(value) AS lo, max(value) AS hi FROM draws_fact GROUP BY 1),
b AS (SELECT d.param, lo, hi, least(19, floor((value - lo) / (hi - lo) * 20))::BIGINT AS bin
      FROM draws_fact d JOIN lim ON d.param = lim.param)
SELECT b.param, bin, {r('any_value(lo + bin * (hi - lo) / 20)', 'bin_from')}, count(*)::BIGINT AS n,
 {r('any_value(hdi_lo)', 'hdi_lo')}, {r('any_value(hdi_hi)', 'hdi_hi')}
FROM b JOIN hdi h ON b.param = h.param GROUP BY b.param, bin""",
    "rank_histogram": W.rstrip()
    + """,
p AS (SELECT param, chain, row_number() OVER (PARTITION BY param ORDER BY value, chain, draw) AS rn,
        count(*) OVER (PARTITION BY param) AS n FROM draws_fact)
SELECT param, chain, floor((rn - 1) * 20 / n)::BIGINT AS bin, count(*)::BIGINT AS n FROM p GROUP BY 1, 2, 3""",
    "trace_series": W
    + f"""SELECT param, chain, draw, {r('ln(1 + value)', 'value')},
         {r('avg(ln(1 + value)) OVER (PARTITION BY param, chain ORDER BY draw)', 'running_mean')} FROM draws_fact""",
}
