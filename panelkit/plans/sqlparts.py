"""DuckDB SQL fragments for the oracles (panels as CTEs)."""

PANEL_A = """
pa_cells AS (
  SELECT n.n_name AS entity, r.r_name AS region, c.c_mktsegment AS category,
         year(o.o_orderdate) * 4 + quarter(o.o_orderdate) - 1 AS q,
         sum(CAST(o.o_totalprice AS DECIMAL(20,2))) AS v
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3, 4),
pa_bounds AS (SELECT min(q) AS q0, max(q) AS q1 FROM pa_cells),
pa_series AS (SELECT DISTINCT entity, region, category FROM pa_cells),
pa_periods AS (SELECT unnest(range(q0, q1 + 1)) AS q, q0 FROM pa_bounds),
panel AS (
  SELECT s.entity, s.region, s.category, CAST(p.q - p.q0 AS INTEGER) AS t,
         CAST(p.q // 4 AS VARCHAR) || '/Q' || CAST(p.q % 4 + 1 AS VARCHAR) AS period_label,
         CAST(coalesce(c.v, 0) AS DOUBLE) AS value
  FROM pa_series s CROSS JOIN pa_periods p
  LEFT JOIN pa_cells c ON c.entity = s.entity AND c.category = s.category AND c.q = p.q)
"""

PANEL_B = """
pb_cells AS (
  SELECT user_id AS entity, 'ALL' AS region, 'events' AS category,
         CAST(ts AS DATE) - DATE '1970-01-01' AS q,
         sum(CAST(value AS DECIMAL(20,2))) AS v
  FROM events GROUP BY 1, 2, 3, 4),
pb_bounds AS (SELECT min(q) AS q0, max(q) AS q1 FROM pb_cells),
pb_series AS (SELECT DISTINCT entity, region, category FROM pb_cells),
pb_periods AS (SELECT unnest(range(q0, q1 + 1)) AS q, q0 FROM pb_bounds),
panel_b AS (
  SELECT s.entity, s.region, s.category, CAST(p.q - p.q0 AS INTEGER) AS t,
         strftime(DATE '1970-01-01' + CAST(p.q AS INTEGER), '%Y/%m/%d') AS period_label,
         CAST(coalesce(c.v, 0) AS DOUBLE) AS value
  FROM pb_series s CROSS JOIN pb_periods p
  LEFT JOIN pb_cells c ON c.entity = s.entity AND c.q = p.q)
"""


def with_panel(body: str, b: bool = False, recursive: bool = False) -> str:
    """Prefix ``body`` (which may start with more CTEs: ``, x AS (...)``
    followed by a final SELECT) with the panel CTEs."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + (PANEL_B if b else PANEL_A) + body


def dsum(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(20,2))) AS DOUBLE)"
