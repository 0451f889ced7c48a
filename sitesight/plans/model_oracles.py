"""Independent SQL for the hierarchical models.

The likelihood is summed site by site with the engine's own log-gamma, and every integral
is a join over grid tables, so it shares neither the histogram form nor the array algebra
of the job it checks.
"""

from __future__ import annotations

from sitesight.operators.model_spec import Model
from sitesight.plans.oracles import MONTH, SITE, r, rs


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _mass(m: str, low: str, high: str, cells: int, index: str, alpha: str, beta: str) -> str:
    """Log mass of Beta(alpha, beta) in a grid cell; end cells integrate their end."""
    w = f"(({high} - {low}) / {cells})"
    left = (
        f"CASE WHEN {index} = 0 AND {low} <= 0 THEN ({alpha}) * ln({w}) - ln({alpha}) "
        f"ELSE ln({w}) * CASE WHEN {index} = {cells - 1} AND {high} >= 1 THEN 0 ELSE 1 END + ({alpha} - 1) * ln({m}) END"
    )
    right = (
        f"CASE WHEN {index} = {cells - 1} AND {high} >= 1 THEN ({beta}) * ln({w}) - ln({beta}) "
        f"ELSE ({beta} - 1) * ln(1 - {m}) END"
    )
    return f"({left}) + ({right}) - (lgamma({alpha}) + lgamma({beta}) - lgamma({alpha} + {beta}))"


def grid_ctes(model: Model, source: str, period: str = "") -> str:
    """CTEs reg (regions), mun (municipalities) and wgt (weights of (s, m) per municipality)."""
    pk = [period] if period else []
    region = "region" if model.by_region else "'all'"
    keys, rkeys = [*pk, "region", "municipality"], [*pk, "region"]
    k, rk = ", ".join(keys), ", ".join(rkeys)
    on = lambda a, b, names: " AND ".join(f"{a}.{n} = {b}.{n}" for n in names) or "true"
    pick = lambda a, names: ", ".join(f"{a}.{n}" for n in names)
    by = lambda names: ", ".join(names)
    n_m, n_a = model.mean_cells, len(model.region_mean)
    low_s = min(model.site_precision.points)
    axis = lambda x: [(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x.points, x.log_prior))]
    if model.top is None:
        top_rows = [(0, 0.0, 0.0, 0.0)]
        prior_a = "a.lp"
    else:
        g, c = model.top
        top_rows = [
            (i * len(c) + j, gp * cp + model.offset, (1 - gp) * cp + model.offset, gl + cl)
            for i, (gp, gl) in enumerate(zip(g.points, g.log_prior))
            for j, (cp, cl) in enumerate(zip(c.points, c.log_prior))
        ]
        prior_a = _mass("a.a", "0", "1", n_a, "a.ai", "h.al", "h.be")
    own = not model.shared_municipality_precision
    alpha, beta = f"(a.a * p.p + {model.offset})", f"((1 - a.a) * p.p + {model.offset})"
    own_e = f""",
e AS (SELECT {k}, si, 0 AS pi, ai, any_value(top) AS top,
        max(v + lp) + ln(sum(exp(v + lp - vm))) AS v
      FROM (SELECT e0.*, p.lp, max(v + p.lp) OVER (PARTITION BY {k}, si, ai) AS vm FROM e0 JOIN p_axis p ON e0.pi = p.pi)
      GROUP BY {k}, si, ai)"""
    e_name = "e0" if own else "e"
    p_prior = "0" if own else "p.lp"
    p_join = "" if own else "JOIN p_axis p ON z.pi = p.pi"
    match_p = "" if own else "AND e.pi = w.pi"
    own_p = "+ p.lp" if own else ""
    joint_p = "j.pi = e.pi AND j.ai = e.ai"
    t_part = f"PARTITION BY {period}" if period else ""
    return f"""
{_values('s_axis', 'si, s, lp', axis(model.site_precision))},
{_values('p_axis', 'pi, p, lp', axis(model.municipality_precision))},
{_values('a_axis', 'ai, a, lp', axis(model.region_mean))},
{_values('h_axis', 'hi, al, be, lp', top_rows)},
src AS (SELECT * REPLACE ({region} AS region) FROM {source}),
sums AS (SELECT {k}, sum(tests)::DOUBLE AS n, sum(successes)::DOUBLE AS ok, sum(tests::DOUBLE * tests) AS n2
         FROM src GROUP BY {k}),
half AS (SELECT *, (ok + 1) / (n + 2) AS p0,
           8 * sqrt((ok + 1) / (n + 2) * (1 - (ok + 1) / (n + 2)) / (n + 2)
             * greatest(1.0, 1 + coalesce(n2 / nullif(n, 0) - 1, 0) / (1 + {low_s!r}::DOUBLE))) AS hw FROM sums),
rng AS (SELECT {k}, greatest(0.0, p0 - hw) AS lo, least(1.0, p0 + hw) AS hi FROM half),
cell AS (SELECT {pick('rng', keys)}, lo, hi, si, s, mi, lo + (hi - lo) * (mi + 0.5::DOUBLE) / {n_m} AS m
         FROM rng CROSS JOIN s_axis CROSS JOIN (SELECT unnest(range(0, {n_m})) AS mi) g),
ll AS (SELECT {pick('c', keys)}, si, mi, any_value(s) AS s, any_value(m) AS m, any_value(lo) AS lo, any_value(hi) AS hi,
         sum(lgamma(successes + m * s) + lgamma(tests - successes + (1 - m) * s) - lgamma(tests + s)
             - lgamma(m * s) - lgamma((1 - m) * s) + lgamma(s)) AS v
       FROM src x JOIN cell c ON {on('x', 'c', keys)} GROUP BY {pick('c', keys)}, si, mi),
lt AS (SELECT *, max(v) OVER (PARTITION BY {k}, si) AS top FROM ll),
w AS (SELECT {pick('c', keys)}, mi, pi, ai, {_mass('c.m', 'c.lo', 'c.hi', n_m, 'c.mi', alpha, beta)} AS v
      FROM (SELECT DISTINCT {k}, mi, m, lo, hi FROM cell) c CROSS JOIN p_axis p CROSS JOIN a_axis a),
{e_name} AS (SELECT {pick('l', keys)}, si, pi, ai, any_value(top) AS top,
        any_value(top) + ln(sum(exp(l.v - l.top + w.v))) AS v
      FROM lt l JOIN w ON {on('l', 'w', keys)} AND l.mi = w.mi GROUP BY {pick('l', keys)}, si, pi, ai)
{own_e if own else ''},
reg_sum AS (SELECT {rk}, si, pi, ai, sum(v) AS v FROM e GROUP BY {rk}, si, pi, ai),
pa AS (SELECT a.ai, a.a, h.hi, {prior_a} AS v FROM a_axis a CROSS JOIN h_axis h),
z0 AS (SELECT {pick('r', rkeys)}, si, pi, hi, r.v + pa.v AS v,
         max(r.v + pa.v) OVER (PARTITION BY {pick('r', rkeys)}, si, pi, hi) AS vm
       FROM reg_sum r JOIN pa ON r.ai = pa.ai),
z AS (SELECT {rk}, si, pi, hi, any_value(vm) + ln(sum(exp(v - vm))) AS v FROM z0 GROUP BY {rk}, si, pi, hi),
t0 AS (SELECT {by([*(f'z.{c}' for c in pk), 'z.si', 'z.pi', 'z.hi'])}, sum(z.v) + any_value(s.lp) + any_value({p_prior}) + any_value(h.lp) AS v
       FROM z JOIN s_axis s ON z.si = s.si JOIN h_axis h ON z.hi = h.hi {p_join}
       GROUP BY {by([*(f'z.{c}' for c in pk), 'z.si', 'z.pi', 'z.hi'])}),
t1 AS (SELECT *, max(v) OVER ({t_part}) AS vm FROM t0),
t AS (SELECT {by([*pk, 'si', 'pi', 'hi'])}, v - vm - ln(sum(exp(v - vm)) OVER ({t_part})) AS v FROM t1),
j0 AS (SELECT {pick('r', rkeys)}, r.si, r.pi, r.ai, pa.a, r.v + t.v - z.v + pa.v AS v
       FROM reg_sum r JOIN pa ON r.ai = pa.ai
       JOIN z ON {on('r', 'z', rkeys)} AND r.si = z.si AND r.pi = z.pi AND z.hi = pa.hi
       JOIN t ON {on('r', 't', pk)} AND r.si = t.si AND r.pi = t.pi AND t.hi = pa.hi),
j AS (SELECT {rk}, si, pi, ai, any_value(a) AS a, max(v) + ln(sum(exp(v - vm))) AS v
      FROM (SELECT *, max(v) OVER (PARTITION BY {rk}, si, pi, ai) AS vm FROM j0) GROUP BY {rk}, si, pi, ai),
reg AS (SELECT {rk}, sum(exp(v) * a) / sum(exp(v)) AS mean_region,
          sqrt(sum(exp(v) * a * a) / sum(exp(v)) - (sum(exp(v) * a) / sum(exp(v))) ** 2 + 1.0::DOUBLE / (12 * {n_a} * {n_a})) AS sd_region
        FROM j GROUP BY {rk}),
odds AS (SELECT {pick('e', keys)}, e.si, e.pi, e.ai, j.v - e.v AS v, max(j.v - e.v) OVER (PARTITION BY {pick('e', keys)}, e.si) AS vm
         FROM e JOIN j ON {on('e', 'j', rkeys)} AND j.si = e.si AND {joint_p}),
back AS (SELECT {pick('e', keys)}, e.si, w.mi, any_value(e.vm) + ln(sum(exp(e.v - e.vm + w.v {own_p}))) AS v
         FROM odds e JOIN w ON {on('e', 'w', keys)} AND e.ai = w.ai {match_p}
         JOIN p_axis p ON w.pi = p.pi GROUP BY {pick('e', keys)}, e.si, w.mi),
raw AS (SELECT {pick('l', keys)}, l.s, l.m, l.v + b.v AS v, max(l.v + b.v) OVER (PARTITION BY {pick('l', keys)}) AS vm
        FROM lt l JOIN back b ON {on('l', 'b', keys)} AND l.si = b.si AND l.mi = b.mi),
wgt AS (SELECT {k}, s, m, exp(v - vm) / sum(exp(v - vm)) OVER (PARTITION BY {k}) AS w FROM raw),
mun0 AS (SELECT {k}, sum(w * m) AS mean_mun FROM wgt GROUP BY {k}),
mun AS (SELECT {pick('g', keys)}, any_value(mean_mun) AS mean_mun, sqrt(sum(w * (m - mean_mun) ** 2)) AS sd_mun
        FROM wgt g JOIN mun0 u ON {on('g', 'u', keys)} GROUP BY {pick('g', keys)})"""


def municipality_sql(model: Model) -> str:
    return f"WITH {SITE},{grid_ctes(model, 'site_fact')}\nSELECT region, municipality, {rs('mean_mun', 'sd_mun')} FROM mun"


def region_sql(model: Model) -> str:
    return f"WITH {SITE},{grid_ctes(model, 'site_fact')}\nSELECT region, {rs('mean_region', 'sd_region')} FROM reg"


def site_sql(model: Model) -> str:
    return (
        f"WITH {SITE},{grid_ctes(model, 'site_fact')}\n"
        f"""SELECT x.region, x.municipality, site_id, {r('sum(w * (m * s + successes) / (s + tests))', 'mean_site')},
        {r('sqrt(sum(w * (m * s + successes) * (m * s + successes + 1) / ((s + tests) * (s + tests + 1))) - sum(w * (m * s + successes) / (s + tests)) ** 2)', 'sd_site')}
        FROM src x JOIN wgt g ON x.region = g.region AND x.municipality = g.municipality
        GROUP BY x.region, x.municipality, site_id"""
    )


def shared_sql(model: Model) -> str:
    """Mean and sd of the precisions and, with a top level, of its mean and concentration."""
    parts = [("phi_site", "a.s", "s_axis a ON t.si = a.si"), ("phi_mun", "a.p", "p_axis a ON t.pi = a.pi")]
    if model.top is not None:
        parts += [("global_mean", "a.al / (a.al + a.be)", "h_axis a ON t.hi = a.hi"), ("global_concentration", "a.al + a.be", "h_axis a ON t.hi = a.hi")]
    selects = [
        f"""SELECT '{name}' AS param, {r(f'sum(exp(t.v) * ({x})) / sum(exp(t.v))', 'mean')},
        {r(f'sqrt(greatest(sum(exp(t.v) * ({x}) ** 2) / sum(exp(t.v)) - (sum(exp(t.v) * ({x})) / sum(exp(t.v))) ** 2, 0))', 'sd')} FROM t JOIN {join}"""
        for name, x, join in parts
    ]
    return f"WITH {SITE},{grid_ctes(model, 'site_fact')}\n" + "\nUNION ALL ".join(selects)


YEAR = """
site_year AS (
  SELECT CAST(year(month) AS INTEGER) AS year, region, municipality, site_id,
         sum(tests)::BIGINT AS tests, sum(successes)::BIGINT AS successes
  FROM site_month GROUP BY 1, 2, 3, 4
)"""


def year_region_sql(model: Model) -> str:
    return (
        f"WITH {MONTH},{YEAR},{grid_ctes(model, 'site_year', 'year')}\n"
        f"SELECT year, region, {rs('mean_region', 'sd_region')} FROM reg"
    )


def year_municipality_sql(model: Model) -> str:
    return (
        f"WITH {MONTH},{YEAR},{grid_ctes(model, 'site_year', 'year')}\n"
        f"SELECT year, region, municipality, {rs('mean_mun', 'sd_mun')} FROM mun"
    )


def month_sql(model: Model, select: str) -> str:
    return f"WITH {MONTH},{grid_ctes(model, 'site_month', 'month')}\n{select}"


def full_month_sql(model: Model) -> str:
    """Municipalities of each month on fine grids: the integrals of ``grid_ctes`` with lists in place of joined rows.

    For models with shared precisions, regions and no top level. A month's municipality has the number
    ``k``, its region ``rk``; cells of (precision, region mean) have the position ``pos``. The log-likelihood
    is summed site by site, as there; sums over cells are inner products of two lists.
    """
    n_m, n_a = model.mean_cells, len(model.region_mean)
    axis = lambda x: [(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x.points, x.log_prior))]
    low_s = min(model.site_precision.points)

    def mass(x: str) -> str:
        left = f"CASE WHEN c.i = 0 AND c.lo <= 0 THEN {x}.al * ln(c.w) - ln({x}.al) ELSE ln(c.w) * CASE WHEN c.i = {n_m - 1} AND c.hi >= 1 THEN 0 ELSE 1 END + ({x}.al - 1) * ln(c.m) END"
        right = f"CASE WHEN c.i = {n_m - 1} AND c.hi >= 1 THEN {x}.be * ln(c.w) - ln({x}.be) ELSE ({x}.be - 1) * ln(1 - c.m) END"
        return f"exp({left} + {right} - {x}.lb)"

    log = lambda x: f"CASE WHEN {x} > 0 THEN ln({x}) ELSE '-Infinity'::DOUBLE END"
    return f"""WITH {MONTH},
{_values('s_axis', 'si, s, lp', axis(model.site_precision))},
{_values('p_axis', 'pi, p, lp', axis(model.municipality_precision))},
{_values('a_axis', 'ai, a, lp', axis(model.region_mean))},
pa AS (SELECT pi * {n_a} + ai AS pos, pi, ai, a * p AS al, (1 - a) * p AS be, lgamma(a * p) + lgamma((1 - a) * p) - lgamma(p) AS lb
       FROM p_axis CROSS JOIN a_axis),
pas AS (SELECT list({{'al': al, 'be': be, 'lb': lb}} ORDER BY pos) AS pas FROM pa),
sums AS (SELECT month, region, municipality, sum(tests)::DOUBLE AS n, sum(successes)::DOUBLE AS ok, sum(tests::DOUBLE * tests) AS n2
         FROM site_month GROUP BY month, region, municipality),
half AS (SELECT *, (ok + 1) / (n + 2) AS p0,
           8 * sqrt((ok + 1) / (n + 2) * (1 - (ok + 1) / (n + 2)) / (n + 2)
             * greatest(1.0, 1 + coalesce(n2 / nullif(n, 0) - 1, 0) / (1 + {low_s!r}::DOUBLE))) AS hw FROM sums),
rng AS MATERIALIZED (SELECT row_number() OVER (ORDER BY month, region, municipality) AS k, dense_rank() OVER (ORDER BY month, region) AS rk,
          month, region, municipality, greatest(0.0, p0 - hw) AS lo, least(1.0, p0 + hw) AS hi FROM half),
cell AS MATERIALIZED (SELECT k, i, lo + (hi - lo) * (i + 0.5::DOUBLE) / {n_m} AS m, (hi - lo) / {n_m} AS w, lo, hi
         FROM rng CROSS JOIN (SELECT unnest(range(0, {n_m})) AS i) g),
cells AS (SELECT k, list({{'i': i, 'm': m, 'w': w, 'lo': lo, 'hi': hi}} ORDER BY i) AS cs FROM cell GROUP BY k),
ll AS (SELECT k, si, i, sum(lgamma(successes + m * s) + lgamma(tests - successes + (1 - m) * s) - lgamma(tests + s)
             - lgamma(m * s) - lgamma((1 - m) * s) + lgamma(s)) AS v
       FROM site_month x JOIN rng USING (month, region, municipality) JOIN cell USING (k) CROSS JOIN s_axis GROUP BY k, si, i),
lik AS MATERIALIZED (SELECT k, si, max(v) AS top, list(v ORDER BY i) AS v FROM ll GROUP BY k, si),
by_pos AS (SELECT k, pos, list_transform(cs, lambda c: {mass('pa')}) AS w FROM cells CROSS JOIN pa),
e0 AS (SELECT l.k, si, pos, top, list_inner_product(list_transform(l.v, lambda x: exp(x - top)), w) AS v
       FROM by_pos b JOIN lik l ON l.k = b.k),
e AS MATERIALIZED (SELECT k, rk, si, pos, top + {log('v')} AS v FROM e0 JOIN rng USING (k)),
reg_sum AS MATERIALIZED (SELECT rk, si, pos, pi, a.lp AS lp, sum(v) AS v FROM e JOIN pa USING (pos) JOIN a_axis a USING (ai) GROUP BY rk, si, pos, pi, a.lp),
z AS MATERIALIZED (SELECT rk, si, pi, any_value(vm) + ln(sum(exp(v - vm))) AS v
      FROM (SELECT rk, si, pi, v + lp AS v, max(v + lp) OVER (PARTITION BY rk, si, pi) AS vm FROM reg_sum) GROUP BY rk, si, pi),
t0 AS (SELECT month, si, pi, sum(z.v) + any_value(s.lp) + any_value(p.lp) AS v
       FROM z JOIN (SELECT DISTINCT rk, month FROM rng) USING (rk) JOIN s_axis s USING (si) JOIN p_axis p USING (pi) GROUP BY month, si, pi),
t1 AS (SELECT *, max(v) OVER (PARTITION BY month) AS vm FROM t0),
t AS (SELECT month, si, pi, v - vm - ln(sum(exp(v - vm)) OVER (PARTITION BY month)) AS v FROM t1),
j AS (SELECT r.rk, r.si, r.pos, r.v + r.lp + t.v - z.v AS v
      FROM reg_sum r JOIN z ON r.rk = z.rk AND r.si = z.si AND r.pi = z.pi
      JOIN (SELECT DISTINCT rk, month FROM rng) d ON d.rk = r.rk JOIN t ON t.month = d.month AND t.si = r.si AND t.pi = r.pi),
odds AS (SELECT e.k, e.si, list(CASE WHEN isfinite(e.v) AND isfinite(j.v) THEN j.v - e.v ELSE '-Infinity'::DOUBLE END ORDER BY e.pos) AS v
         FROM e JOIN j ON e.rk = j.rk AND e.si = j.si AND e.pos = j.pos GROUP BY e.k, e.si),
odd AS MATERIALIZED (SELECT o.k, l.v AS ll, vm, list_transform(o.v, lambda x: exp(x - vm)) AS v
        FROM (SELECT *, list_max(v) AS vm FROM odds) o JOIN lik l ON l.k = o.k AND l.si = o.si),
by_cell AS (SELECT k, i, m, list_transform(pas, lambda x: {mass('x')}) AS w FROM cell c CROSS JOIN pas),
raw0 AS (SELECT o.k, c.m, o.ll[c.i + 1] + o.vm AS v, list_inner_product(o.v, c.w) AS dot FROM by_cell c JOIN odd o ON o.k = c.k),
raw AS (SELECT k, m, v + {log('dot')} AS v FROM raw0),
wgt AS (SELECT k, m, exp(v - max(v) OVER (PARTITION BY k)) AS w FROM raw),
mun0 AS (SELECT k, sum(w) AS total, sum(w * m) / sum(w) AS mean_mun FROM wgt GROUP BY k),
mun AS (SELECT k, any_value(mean_mun) AS mean_mun, sqrt(sum(w * (m - mean_mun) ** 2) / any_value(total)) AS sd_mun FROM wgt JOIN mun0 USING (k) GROUP BY k)
SELECT month, region, municipality, {rs('mean_mun', 'sd_mun')} FROM mun JOIN rng USING (k)"""
