"""SQL of the models: principal components, inverse covariances and the whole detector over the trace fixture.

Components come from powers of the covariance: squared again and again, a matrix becomes the projection on its first
component, which is taken out before the next one is looked for.  A matrix is one row with a list of rows; it is symmetric,
so the product of rows i and j is the element of its square.  Inverses come from Gauss-Jordan steps, which a positive
matrix takes without pivots.
"""

from __future__ import annotations

#: Squarings for a component; so a component that is smaller by a ten-thousandth is gone.
SQUARINGS = 18
COMPONENTS, FEATURES = 10, 24


def _squared(name: str, before: str) -> str:
    product = "list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c)))"
    trace = f"list_sum(list_transform(range(1, {FEATURES + 1}), lambda i: m[i][i]))"
    return f"""{name}q AS MATERIALIZED (SELECT {product} AS m FROM {before}),
{name} AS MATERIALIZED (SELECT list_transform(m, lambda r: list_transform(r, lambda x: x / t)) AS m FROM (SELECT m, {trace} AS t FROM {name}q) z)"""


def components(rows: str) -> str:
    """CTEs ``mu`` (k, v), ``nn`` (n) and ``co`` (e, lambda, v): mean, count and components of the table ``rows`` (chip, k, v)."""
    parts = [
        f"nn AS MATERIALIZED (SELECT count(DISTINCT chip) AS n FROM {rows})",
        f"mu AS MATERIALIZED (SELECT k, avg(v) AS v FROM {rows} GROUP BY k)",
        f"cl AS MATERIALIZED (SELECT t.chip AS chip, list(t.v - mu.v ORDER BY t.k) AS x FROM {rows} t JOIN mu ON t.k = mu.k GROUP BY t.chip)",
        f"cx AS MATERIALIZED (SELECT i, j, sum(x[i] * x[j]) / (SELECT n - 1 FROM nn) AS v FROM cl CROSS JOIN (SELECT range AS i FROM range(1, {FEATURES + 1})) a CROSS JOIN (SELECT range AS j FROM range(1, {FEATURES + 1})) b GROUP BY i, j)",
        "a1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cx GROUP BY i) z)",
    ]
    for e in range(1, COMPONENTS + 1):
        trace = f"list_sum(list_transform(range(1, {FEATURES + 1}), lambda i: m[i][i]))"
        parts.append(f"p{e}_0 AS MATERIALIZED (SELECT list_transform(m, lambda r: list_transform(r, lambda x: x / t)) AS m FROM (SELECT m, {trace} AS t FROM a{e}) z)")
        parts += [_squared(f"p{e}_{s}", f"p{e}_{s - 1}") for s in range(1, SQUARINGS + 1)]
        # The column of the largest diagonal element, as a unit vector.
        diagonal = f"list_transform(range(1, {FEATURES + 1}), lambda i: m[i][i])"
        parts.append(f"u{e} AS MATERIALIZED (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM (SELECT m[list_position({diagonal}, list_max({diagonal}))] AS r FROM p{e}_{SQUARINGS}) z)")
        parts.append(f"v{e} AS MATERIALIZED (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l, m FROM u{e} CROSS JOIN a{e})")
        parts.append(f"a{e + 1} AS MATERIALIZED (SELECT list_transform(range(1, {FEATURES + 1}), lambda i: list_transform(range(1, {FEATURES + 1}), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM v{e})")
    union = " UNION ALL ".join(f"SELECT {e} AS e, l, v FROM v{e}" for e in range(1, COMPONENTS + 1))
    # A sample of n vectors has n - 1 components; what would come after them is noise.
    parts.append(f"co AS MATERIALIZED (SELECT e, CASE WHEN e <= n - 1 THEN l ELSE 0e0 END AS l, CASE WHEN e <= n - 1 THEN v ELSE list_transform(range({FEATURES}), lambda x: 0e0) END AS v FROM ({union}) z CROSS JOIN nn)")
    return ",\n".join(parts)


def projected(name: str, rows: str) -> str:
    """The CTE ``name`` (chip, y): the vectors of ``rows`` (chip, x), of which the mean was taken, in components."""
    return f"{name} AS MATERIALIZED (SELECT t.chip AS chip, list(list_dot_product(t.x, co.v) ORDER BY co.e) AS y FROM {rows} t CROSS JOIN co GROUP BY t.chip)"


def inverse(name: str, rows: str, ridge: str) -> str:
    """The CTE ``name`` (m): the inverse of the covariance of ``rows`` (y) with the ridge."""
    size = f"range(1, {COMPONENTS + 1})"
    parts = [
        f"{name}n AS MATERIALIZED (SELECT i, j, CASE WHEN count(y) > 1 THEN (sum(y[i] * y[j]) - sum(y[i]) * sum(y[j]) / count(y)) / (count(y) - 1) ELSE 0e0 END + CASE WHEN i = j THEN {ridge} ELSE 0e0 END AS v FROM (SELECT range AS i FROM {size}) a CROSS JOIN (SELECT range AS j FROM {size}) b LEFT JOIN {rows} ON true GROUP BY i, j)",
        f"{name}0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) || list_transform({size}, lambda c: CASE WHEN c = i THEN 1e0 ELSE 0e0 END) AS r FROM {name}n GROUP BY i) z)",
    ]
    for p in range(1, COMPONENTS + 1):
        step = f"list_transform({size}, lambda i: CASE WHEN i = {p} THEN q ELSE list_transform(range(1, {2 * COMPONENTS + 1}), lambda j: m[i][j] - m[i][{p}] * q[j]) END)"
        parts.append(f"{name}{p} AS MATERIALIZED (SELECT {step} AS m FROM (SELECT m, list_transform(m[{p}], lambda x: x / m[{p}][{p}]) AS q FROM {name}{p - 1}) z)")
    parts.append(f"{name} AS MATERIALIZED (SELECT list_transform(m, lambda r: r[{COMPONENTS + 1}:{2 * COMPONENTS}]) AS m FROM {name}{COMPONENTS})")
    return ",\n".join(parts)


def _gap(a: str, b: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: {a}[i] - {b}[i])"


def _length(a: str, b: str) -> str:
    return f"sqrt(list_dot_product({_gap(a, b)}, {_gap(a, b)}))"


def _mahalanobis(a: str, b: str, inverse_: str) -> str:
    return f"sqrt(greatest(0e0, list_dot_product({_gap(a, b)}, list_transform({inverse_}, lambda r: list_dot_product(r, {_gap(a, b)})))))"


def detector(fit: str, classes: str = "cluster") -> str:
    """CTEs up to ``vd``: the verdict of each validation chip; ``classes`` as in ``fit_detector``.

    ``fit`` has CTEs ``ft`` (chip, label, k, v: all chips), ``tf`` (the same of training chips), ``ce`` (k, v0, v1, n_iter: both centres),
    ``me`` (chip, u: memberships of the first cluster) and ``en`` (chip, e: raw energies).
    """
    cls = "CASE WHEN (CASE WHEN u >= 1 - u THEN 0 ELSE 1 END) = t THEN 1 ELSE 0 END" if classes == "cluster" else "al.label"
    return f"""{fit},
eg AS MATERIALIZED (SELECT sum(u * u * e) / sum(u * u) AS e0, sum((1 - u) * (1 - u) * e) / sum((1 - u) * (1 - u)) AS e1 FROM me JOIN en ON me.chip = en.chip),
ro AS MATERIALIZED (SELECT CASE WHEN e0 >= e1 THEN 0 ELSE 1 END AS t FROM eg),
cg AS MATERIALIZED (SELECT list(CASE WHEN t = 1 THEN v0 ELSE v1 END ORDER BY k) AS g, list(CASE WHEN t = 1 THEN v1 ELSE v0 END ORDER BY k) AS m FROM ce CROSS JOIN ro),
{components("tf")},
ml AS MATERIALIZED (SELECT list(v ORDER BY k) AS mu FROM mu),
al AS MATERIALIZED (SELECT chip, any_value(label) AS label, list(v ORDER BY k) AS x FROM ft GROUP BY chip),
az AS MATERIALIZED (SELECT chip, {_gap("x", "mu")} AS x FROM al CROSS JOIN ml UNION ALL SELECT -1, {_gap("g", "mu")} FROM cg CROSS JOIN ml UNION ALL SELECT -2, {_gap("m", "mu")} FROM cg CROSS JOIN ml),
{projected("pc", "az")},
cc AS MATERIALIZED (SELECT (SELECT y FROM pc WHERE chip = -1) AS gp, (SELECT y FROM pc WHERE chip = -2) AS mp),
tc AS MATERIALIZED (SELECT me.chip AS chip, y, {cls} AS cls FROM me JOIN pc ON me.chip = pc.chip JOIN al ON me.chip = al.chip CROSS JOIN ro),
y0 AS MATERIALIZED (SELECT y FROM tc WHERE cls = 0), y1 AS MATERIALIZED (SELECT y FROM tc WHERE cls = 1),
{inverse("ig", "y0", "1e-6")},
{inverse("it", "y1", "1e-6")},
gd AS MATERIALIZED (SELECT var_pop(ed) + 1e-6 AS v1, var_pop(md) + 1e-6 AS v2 FROM (SELECT {_length("y", "gp")} AS ed, {_mahalanobis("y", "gp", "ig.m")} AS md FROM y0 CROSS JOIN cc CROSS JOIN ig) z),
hh AS MATERIALIZED (SELECT -(v1 / (v1 + v2)) * log2(v1 / (v1 + v2)) AS h1, -(v2 / (v1 + v2)) * log2(v2 / (v1 + v2)) AS h2 FROM gd),
wt AS MATERIALIZED (SELECT h1 / (h1 + h2) AS w1, h2 / (h1 + h2) AS w2 FROM hh),
ds AS MATERIALIZED (
  SELECT al.chip AS chip, label, {_length("al.x", "g")} AS ed_g, {_length("al.x", "cg.m")} AS ed_t, {_mahalanobis("y", "gp", "ig.m")} AS md_g, {_mahalanobis("y", "mp", "it.m")} AS md_t
  FROM al JOIN pc ON al.chip = pc.chip CROSS JOIN cg CROSS JOIN cc CROSS JOIN ig CROSS JOIN it WHERE NOT EXISTS (SELECT 1 FROM me WHERE me.chip = al.chip)
),
fd AS MATERIALIZED (SELECT *, w1 * ed_g + w2 * md_g AS fd_g, w1 * ed_t + w2 * md_t AS fd_t FROM ds CROSS JOIN wt),
vd AS MATERIALIZED (SELECT chip, label, ed_g, ed_t, md_g, md_t, fd_g, fd_t, fd_g / (fd_t + 1e-12) AS r_fd, CASE WHEN fd_g / (fd_t + 1e-12) >= 1 THEN 1 ELSE 0 END AS predicted FROM fd)"""
