"""DuckDB oracle for the Holt fit: the same grid, refinement, closed-form
initial state and recursion as ``operators.models.holt_fit``, written as
recursive CTEs with the floating-point operations in the same order, so the
chosen (alpha, beta) and the forecasts agree to the last bit."""

from __future__ import annotations

#: The grid, stated on its own: the oracle doesn't take it from the engine.
ALPHAS = [round(k / 20, 2) for k in range(1, 21)]
BETAS = [round(k / 20, 2) for k in range(21)]
FINE = [round(k / 200, 3) for k in range(-10, 11)]


def _values(rows):
    return ", ".join("(" + ", ".join(rows_) + ")" for rows_ in rows)


def _grid_values():
    return _values([(str(i), str(j), f"CAST('{float(a)!r}' AS DOUBLE)", f"CAST('{float(b)!r}' AS DOUBLE)")
                    for i, a in enumerate(ALPHAS) for j, b in enumerate(BETAS)])


def _fine_values():
    return _values([(str(i), str(j), f"CAST('{float(a)!r}' AS DOUBLE)", f"CAST('{float(b)!r}' AS DOUBLE)")
                    for i, a in enumerate(FINE) for j, b in enumerate(FINE)])


def _fit(p: str, hist: str, cells: str) -> str:
    """Recursive SSE accumulation over ``cells``(entity, category, ci, cj, a, b)."""
    g0 = "(y.value - (r.c0 + r.d0))"
    g1 = "(r.c1 + r.d1)"
    g2 = "(r.c2 + r.d2)"
    return f""",
{p}_rec(entity, category, ci, cj, a, b, k, c0, c1, c2, d0, d1, d2, s00, s01, s02, s11, s12, s22) AS (
  SELECT entity, category, ci, cj, a, b, 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE),
         CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE),
         CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  FROM {cells}
  UNION ALL
  SELECT r.entity, r.category, r.ci, r.cj, r.a, r.b, r.k + 1,
    (r.c0 + r.d0) + r.a * {g0}, (r.c1 + r.d1) - r.a * {g1}, (r.c2 + r.d2) - r.a * {g2},
    r.d0 + (r.a * r.b) * {g0}, r.d1 - (r.a * r.b) * {g1}, r.d2 - (r.a * r.b) * {g2},
    r.s00 + {g0} * {g0}, r.s01 + {g0} * {g1}, r.s02 + {g0} * {g2},
    r.s11 + {g1} * {g1}, r.s12 + {g1} * {g2}, r.s22 + {g2} * {g2}
  FROM {p}_rec r JOIN {hist} y ON y.entity = r.entity AND y.category = r.category AND y.i = r.k),
{p}_end AS (
  SELECT r.*, s11 * s22 - s12 * s12 AS det FROM {p}_rec r
  JOIN {p}_n n ON n.entity = r.entity AND n.category = r.category AND r.k = n.n),
{p}_sol AS (
  SELECT *, CASE WHEN det <> 0 THEN (s01 * s22 - s02 * s12) / det ELSE 0.0 END AS l0,
            CASE WHEN det <> 0 THEN (s02 * s11 - s01 * s12) / det ELSE 0.0 END AS t0 FROM {p}_end),
{p}_sse AS (
  SELECT *, s00 - 2 * l0 * s01 - 2 * t0 * s02 + l0 * l0 * s11 + 2 * l0 * t0 * s12 + t0 * t0 * s22 AS sse
  FROM {p}_sol),
{p}_best AS (
  SELECT entity, category, arg_min(struct_pack(a := a, b := b, l0 := l0, t0 := t0),
                                   struct_pack(s := CASE WHEN isfinite(sse) THEN sse ELSE 'inf'::DOUBLE END,
                                               i := ci, j := cj)) AS w
  FROM {p}_sse GROUP BY 1, 2)"""


def holt_sql(p: str, hist: str, h: int = 5) -> str:
    """CTEs ending in ``{p}``(entity, category, step, f, lo, hi) for every
    series of ``hist``(entity, category, i, value) with at least 4 points;
    shorter series are not covered (the caller adds naive drift)."""
    return f""",
{p}_n AS (SELECT entity, category, count(*) AS n FROM {hist} GROUP BY 1, 2 HAVING count(*) >= 4),
{p}_g1 AS (SELECT * FROM (VALUES {_grid_values()}) v(ci, cj, a, b)),
{p}_c1 AS (SELECT n.entity, n.category, g.ci, g.cj, g.a, g.b FROM {p}_n n, {p}_g1 g)""" \
        + _fit(f"{p}_x1", hist, f"{p}_c1").replace(f"{p}_x1_n", f"{p}_n") + f""",
{p}_g2 AS (SELECT * FROM (VALUES {_fine_values()}) v(ci, cj, fa, fb)),
{p}_c2 AS (SELECT b.entity, b.category, g.ci, g.cj,
                  least(greatest(b.w.a + g.fa, CAST('0.005' AS DOUBLE)), CAST(1 AS DOUBLE)) AS a,
                  least(greatest(b.w.b + g.fb, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS b
           FROM {p}_x1_best b, {p}_g2 g)""" \
        + _fit(f"{p}_x2", hist, f"{p}_c2").replace(f"{p}_x2_n", f"{p}_n") + f""",
{p}_run(entity, category, k, alpha, beta, lv, tr, e) AS (
  SELECT entity, category, 0, w.a, w.b, w.l0, w.t0, CAST(NULL AS DOUBLE) FROM {p}_x2_best
  UNION ALL
  SELECT r.entity, r.category, r.k + 1, r.alpha, r.beta,
         (r.lv + r.tr) + r.alpha * (y.value - (r.lv + r.tr)),
         r.tr + (r.alpha * r.beta) * (y.value - (r.lv + r.tr)),
         y.value - (r.lv + r.tr)
  FROM {p}_run r JOIN {hist} y ON y.entity = r.entity AND y.category = r.category AND y.i = r.k),
{p}_fin AS (
  SELECT r.entity, r.category, r.alpha, r.beta, r.lv, r.tr,
         (SELECT stddev_pop(e) FROM {p}_run q WHERE q.entity = r.entity AND q.category = r.category
            AND q.k > 0) AS sd
  FROM {p}_run r JOIN {p}_n n ON n.entity = r.entity AND n.category = r.category AND r.k = n.n),
{p}_x AS (SELECT entity, category, CAST(s.step AS INTEGER) AS step, lv + s.step * tr AS f,
                 1.28 * sd * sqrt(s.step) AS sp FROM {p}_fin, range(1, {h + 1}) s(step)),
{p} AS (SELECT entity, category, step, f, f - sp AS lo, f + sp AS hi FROM {p}_x)"""
