"""SQL text builders for the DuckDB oracles (mirrors of the Spark plans).

Only string building lives here; the oracles run in DuckDB on the same
parquet files, outside Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from ..functions.labels import COHORT_PLOT_LABELS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_text(s: str) -> str:
    """A string literal; newlines become chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join(q(p) for p in parts)


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def case_map(col: str, mapping: Mapping[str, str]) -> str:
    whens = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {sql_text(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


def plot_label(col: str, mapping: Mapping[str, str] = COHORT_PLOT_LABELS) -> str:
    return case_map(col, mapping)


def size_label(label_expr: str, n_expr: str, sep: str = " ") -> str:
    return (f"concat_ws({q(sep)}, coalesce({label_expr}, 'NA'), chr(10) || '(n=', "
            f"coalesce(CAST({n_expr} AS VARCHAR), 'NA'), ')')")


def floor_expr(col: str, floor: float) -> str:
    return f"(CASE WHEN {col} = 0 THEN {floor!r} ELSE {col} END)"


def log2_expr(col: str) -> str:
    # Spark's log2 is ln(x)/ln(2); written the same way here.
    return f"(CASE WHEN {col} > 0 THEN ln({col}) / ln(2) END)"


def col_name(a: str) -> str:
    return "a_" + "".join(ch if ch.isalnum() else "_" for ch in a).lower()


def panel_cte(name: str, group: str, panel: Sequence[str], cutoff: float,
              source: str = "assay", detected: str = "detected") -> str:
    """Complete-case subjects with the count of analytes above the cutoff."""
    cols = ",\n    ".join(f"max(CASE WHEN antigen = {q(a)} THEN value END) AS {col_name(a)}"
                          for a in panel)
    nn = " AND ".join(f"{col_name(a)} IS NOT NULL" for a in panel)
    hits = " + ".join(f"CAST({col_name(a)} > {cutoff!r} AS INTEGER)" for a in panel)
    return f""", {name}_wide AS (
  SELECT lab_id, {group},
    {cols}
  FROM {source}
  WHERE {group} IS NOT NULL AND antigen IN {in_list(panel)}
  GROUP BY lab_id, {group}
), {name} AS (
  SELECT lab_id, {group}, CAST({hits} AS BIGINT) AS {detected}
  FROM {name}_wide WHERE {nn}
)"""


def mid_rank_expr(partition: str, value: str) -> str:
    """Average rank of ``value`` inside ``partition`` (ties get the mean)."""
    p = f"PARTITION BY {partition}" if partition else ""
    tie = f"PARTITION BY {partition + ', ' if partition else ''}{value}"
    return (f"(rank() OVER ({p} ORDER BY {value}) + "
            f"(count(*) OVER ({tie}) - 1) / 2.0)")


def _erf_series(n_terms: int = 70) -> list[float]:
    import math
    return [(-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(n_terms)]


def erfc_expr(x: str, depth: int = 60) -> str:
    """erfc(x) for a column x >= 0 as plain SQL arithmetic (no erf in the
    oracle engine): Taylor series of erf up to 3, continued fraction above.
    Absolute error below 1e-13 against a library erfc, far under the 6th
    decimal the results are compared at."""
    coeffs = _erf_series()
    h = repr(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        h = f"({h}) * ({x}) * ({x}) + ({c!r})"
    taylor = f"(1.0 - 1.1283791670955126 * ({x}) * ({h}))"
    cf = f"({x})"
    for k in range(depth, 0, -1):
        cf = f"(({x}) + {k / 2!r} / {cf})"
    tail = f"(exp(-({x}) * ({x})) / 1.7724538509055159 / {cf})"
    return f"(CASE WHEN ({x}) <= 3.0 THEN {taylor} ELSE {tail} END)"


def normal_p_expr(z: str) -> str:
    """Two-sided normal p of a z column, NULL when z is NULL."""
    return (f"(CASE WHEN {z} IS NOT NULL THEN "
            f"least(1.0, {erfc_expr(f'(abs({z}) / sqrt(2.0))')}) END)")


def exact_ranksum_ctes(tests: str) -> str:
    """CTEs ``ways`` and ``tails`` for the exact rank-sum p of the table
    ``tests`` (columns n1, n2, exact).  ways: how many orders of m + n values
    give the first sample the statistic w, one value more a step; tails: the
    shares of orders with at most and at least w."""
    most = lambda c: f"(SELECT max({c}) FROM {tests} WHERE exact)"
    return f""", ways(m, n, w, k) AS (
  SELECT 0, 0, 0, CAST(1 AS DOUBLE)
  UNION ALL
  SELECT m, n, w, sum(k) FROM (
    SELECT m + 1 AS m, n, w + n AS w, k FROM ways
    UNION ALL SELECT m, n + 1 AS n, w, k FROM ways)
  WHERE m <= {most('n1')} AND n <= {most('n2')}
  GROUP BY m, n, w
), tails AS (
  SELECT m, n, w, sum(k) OVER lo / sum(k) OVER mn AS low, sum(k) OVER hi / sum(k) OVER mn AS high
  FROM ways
  WINDOW mn AS (PARTITION BY m, n), lo AS (PARTITION BY m, n ORDER BY w),
         hi AS (PARTITION BY m, n ORDER BY w DESC)
)"""


def ranksum_p_expr(z: str, stat: str) -> str:
    """p of a rank-sum row joined to ``tails``: exact where allowed."""
    return (f"CASE WHEN exact THEN CASE WHEN n1 > 0 AND n2 > 0 THEN least(1.0, 2 * CASE WHEN "
            f"{stat} > n1 * n2 / 2.0 THEN high ELSE low END) END ELSE {normal_p_expr(z)} END")


def adjusted_expr(p: str) -> str:
    """Bonferroni over all rows of the result."""
    return f"(CASE WHEN {p} IS NOT NULL THEN least(1.0, {p} * count({p}) OVER ()) END)"


def signif_expr(p: str) -> str:
    return (f"CASE WHEN {p} <= 0.0001 THEN '****' WHEN {p} <= 0.001 THEN '***' "
            f"WHEN {p} <= 0.01 THEN '**' WHEN {p} <= 0.05 THEN '*' "
            f"WHEN {p} <= 1.0 THEN 'ns' END")


def _beta_cf(a: str, b: str, x: str, depth: int = 120) -> str:
    """Continued fraction of the incomplete beta, evaluated from the bottom."""
    expr = "1.0"
    for k in range(depth, 0, -1):
        if k % 2:
            m = (k - 1) // 2
            d = f"(-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + {2 * m}) * ({a} + {2 * m + 1})))"
        else:
            m = k // 2
            d = f"({m} * ({b} - {m}) * {x} / (({a} + {2 * m - 1}) * ({a} + {2 * m})))"
        expr = f"(1.0 + {d} / {expr})"
    return f"(1.0 / {expr})"


def correlation_p_cte(src: str, r: str, n: str, name: str = "cp") -> str:
    """CTE ``name``: every column of ``src`` plus ``p``, the two-sided p of a
    correlation from t = r sqrt((n-2)/(1-r^2)) with n-2 degrees of freedom
    (regularised incomplete beta, as the Spark side computes it)."""
    a, b, x = "pa", "0.5", "px"
    front = (f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln(greatest({x}, 1e-300))"
             f" + {b} * ln(greatest(1.0 - {x}, 1e-300)))")
    direct = f"({front} * {_beta_cf(a, b, x)} / {a})"
    mirror = f"(1.0 - {front} * {_beta_cf(b, a, '(1.0 - ' + x + ')')} / {b})"
    return f""", {name}_t AS (
  SELECT *, CASE WHEN {r} IS NOT NULL AND {n} >= 3 AND abs({r}) < 1.0 THEN
                 (CAST({n} AS DOUBLE) - 2.0)
                   / ((CAST({n} AS DOUBLE) - 2.0)
                      + pow({r} * sqrt((CAST({n} AS DOUBLE) - 2.0) / (1.0 - {r} * {r})), 2))
            END AS px,
         (CAST({n} AS DOUBLE) - 2.0) / 2.0 AS pa
  FROM {src}
), {name} AS (
  SELECT * EXCLUDE (px, pa),
         CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL
              WHEN abs({r}) >= 1.0 THEN 0.0
              WHEN px >= 1.0 THEN 1.0
              WHEN px <= 0.0 THEN 0.0
              WHEN px < (pa + 1.0) / (pa + 2.5) THEN least(1.0, {direct})
              ELSE least(1.0, {mirror}) END AS p
  FROM {name}_t
)"""


def num_text(x: str, digits: int) -> str:
    """R-style short number text: round, then drop trailing zeros."""
    t = f"printf('%.{digits}f', round({x}, {digits}) + 0.0)"
    t = f"regexp_replace({t}, '(\\.\\d*?)0+$', '\\1')"
    return f"regexp_replace({t}, '\\.$', '')"


def stat_label_expr(r: str, p: str, coef: str, r_digits: int = 2, p_digits: int = 3) -> str:
    floor = 10.0 ** (-p_digits)
    return (f"('{coef} = ' || {num_text(r, r_digits)} || ', ' || "
            f"CASE WHEN {p} < {floor!r} THEN 'p < {floor:g}' "
            f"ELSE 'p = ' || {num_text(p, p_digits)} END)")
