"""Query registry: every implemented query with its DuckDB oracle.

``QUERIES[key](spark, sf_dir) -> DataFrame``; ``ORACLES[key]`` is the SQL
text DuckDB runs on the same parquet tables, written independently of the
Spark plan (windows and self-joins where Spark uses distributed histograms;
series and continued fractions where Spark calls library distributions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import (ANALYTE_LOCALIZED_NAMES, ANALYTE_SHORT_NAMES,
                                COHORT_GERMAN_LABELS, CONTROLS, EXPOSED_SERONEGATIVE,
                                NONCONTROL4, PANEL3, PANEL3_LOCALIZED, PANEL4,
                                PCR_SEROPOSITIVE, PLOT_FLOOR, SEROPOSITIVE3, TEST_FLOOR)
from ..operators import stats as S
from ..operators.stats import all_pairs
from ..sources.fixture import FIXTURE_CUTOFF, LINE_TO_RAW_LABEL
from ..sources.fixture_sql import with_fixture
from . import batch
from . import operator_tables as T
from . import reports as R
from .context import Inputs, Tables
from .sqltext import (adjusted_expr, case_map, col_name, erfc_expr, exact_ranksum_ctes, floor_expr, in_list,
                      correlation_p_cte, erfc_expr, log2_expr, mid_rank_expr, normal_p_expr, panel_cte,
                      plot_label, ranksum_p_expr, signif_expr, size_label,
                      stat_label_expr)
from .sqltext import q as sq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        BUILDERS[key] = fn
        QUERIES[key] = lambda spark, sf_dir, _fn=fn: _fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


CUT = FIXTURE_CUTOFF


# --------------------------------------------------------------- Figure 3 --

def _detection_sql(group: str, panel, with_sizes: bool = True, source: str = "assay",
                   labels=None, prefix: str = "") -> str:
    sql = panel_cte("panel", group, panel, CUT, source=source)
    sql += f""", dist AS (
  SELECT {group}, detected, count(*) AS n FROM panel GROUP BY 1, 2
)"""
    if not with_sizes:
        return with_fixture(prefix + sql + f"""
SELECT {group}, detected, n,
       round(n / sum(n) OVER (PARTITION BY {group}) * 100.0, 6) AS prop
FROM dist""")
    sql += f""", sizes AS (
  SELECT {group}, count(*) AS n_ind FROM panel GROUP BY 1
)
SELECT d.{group}, d.detected, d.n,
       round(d.n / sum(d.n) OVER (PARTITION BY d.{group}) * 100.0, 6) AS prop,
       s.n_ind, CAST(d.detected AS VARCHAR) AS detected_level,
       {size_label(plot_label('d.' + group, labels) if labels else plot_label('d.' + group), 's.n_ind')} AS group_label
FROM dist d LEFT JOIN sizes s ON d.{group} IS NOT DISTINCT FROM s.{group}"""
    return with_fixture(prefix + sql)


@register("fig3a_distribution", _detection_sql("group5", PANEL3))
def q_fig3a_distribution(inp):
    return R.fig3a_distribution(inp)


@register("regrouped_fig3a_distribution", _detection_sql("group5b", PANEL3))
def q_regrouped_fig3a(inp):
    return R.fig3a_distribution(inp, "group5b")


@register("fig3a_localized", _detection_sql(
    "group5", PANEL3_LOCALIZED, source="assay_de", labels=COHORT_GERMAN_LABELS,
    prefix=f""", assay_de AS (
  SELECT r.lab_id, {case_map('r.antigen_raw', ANALYTE_LOCALIZED_NAMES)} AS antigen,
         r.value, s.group5
  FROM assay_raw r LEFT JOIN subject s ON r.lab_id = s.lab_id
)"""))
def q_fig3a_localized(inp):
    return R.fig3a_localized(inp)


@register("fig3b_distribution", _detection_sql("group5", PANEL4, with_sizes=False))
def q_fig3b_distribution(inp):
    return R.fig3b_distribution(inp)


@register("regrouped_fig3b_distribution", _detection_sql("group5b", PANEL4, with_sizes=False))
def q_regrouped_fig3b_distribution(inp):
    return R.fig3b_distribution(inp, "group5b")


def _strip_sql(group: str, panel, detected: str = "n", sizes: bool = True) -> str:
    sql = panel_cte("panel", group, panel, CUT, detected=detected)
    if not sizes:
        return with_fixture(sql + f"""
SELECT lab_id, {group}, {detected},
       row_number() OVER (PARTITION BY {group} ORDER BY {detected}, lab_id) AS position
FROM panel""")
    sql += f""", sizes AS (SELECT {group}, count(*) AS n_ind FROM panel GROUP BY 1)
SELECT p.lab_id, p.{group}, p.{detected},
       row_number() OVER (PARTITION BY p.{group} ORDER BY p.{detected}, p.lab_id) AS position,
       s.n_ind, {size_label(plot_label('p.' + group), 's.n_ind')} AS group_label
FROM panel p LEFT JOIN sizes s ON p.{group} IS NOT DISTINCT FROM s.{group}"""
    return with_fixture(sql)


@register("fig3b_strip", _strip_sql("group5", PANEL4))
def q_fig3b_strip(inp):
    return R.fig3b_strip(inp)


@register("regrouped_fig3b_strip", _strip_sql("group5b", PANEL4))
def q_regrouped_fig3b_strip(inp):
    return R.fig3b_strip(inp, "group5b")


@register("subject_rank_strip", _strip_sql("group5", PANEL3, detected="detected", sizes=False))
def q_subject_rank_strip(inp):
    return T.subject_rank_strip(inp)


def _contingency_cte(group: str) -> str:
    return f""", per AS (
  SELECT lab_id, {group}, CAST(sum(CAST(value > {CUT!r} AS INTEGER)) AS BIGINT) AS detected
  FROM assay
  WHERE {group} IS NOT NULL AND antigen IN {in_list(PANEL4)} AND value IS NOT NULL
  GROUP BY 1, 2
), dist AS (SELECT {group}, detected, count(*) AS n FROM per GROUP BY 1, 2),
binned AS (
  SELECT {group},
         CASE WHEN detected IN (0, 1) THEN 'Less than 2'
              WHEN detected IN (2, 3, 4) THEN 'More than 2' END AS detected_bin,
         CAST(sum(n) AS BIGINT) AS n2
  FROM dist WHERE {group} IN {in_list([CONTROLS, EXPOSED_SERONEGATIVE])}
  GROUP BY 1, 2
), contingency AS (
  SELECT {group},
         max(CASE WHEN detected_bin = 'Less than 2' THEN n2 END) AS less_than_2,
         max(CASE WHEN detected_bin = 'More than 2' THEN n2 END) AS more_than_2
  FROM binned GROUP BY 1
)"""


def _chi2_sql(row_cte: str, with_p: bool = False) -> str:
    """Yates chi-square over a CTE ``cells(a, b, c, d)``."""
    ea = "((a + b) * (a + c) / n)"
    eb = "((a + b) * (b + d) / n)"
    ec = "((c + d) * (a + c) / n)"
    ed = "((c + d) * (b + d) / n)"
    y = f"least(0.5, abs(a - {ea}), abs(b - {eb}), abs(c - {ec}), abs(d - {ed}))"
    terms = " + ".join(f"pow(abs({o} - {e}) - {y}, 2) / {e}"
                       for o, e in (("a", ea), ("b", eb), ("c", ec), ("d", ed)))
    pcol = (", round(CASE WHEN x IS NOT NULL THEN "
            + erfc_expr("sqrt(greatest(x, 0.0) / 2.0)") + " END, 6) AS p") if with_p else ""
    return row_cte + f""", cellsd AS (
  SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c,
         CAST(d AS DOUBLE) AS d, CAST(a + b + c + d AS DOUBLE) AS n,
         a AS ai, b AS bi, c AS ci, d AS di
  FROM cells
), chi AS (
  SELECT ai, bi, ci, di, {terms} AS x FROM cellsd
)
SELECT ai AS a, bi AS b, ci AS c, di AS d, CAST(ai + bi + ci + di AS BIGINT) AS n,
       round(x, 6) AS chi2, CAST(1 AS BIGINT) AS df{pcol}
FROM chi"""


def _chi2_assay_sql(group: str, with_p: bool = False) -> str:
    cells = _contingency_cte(group) + f""", cells AS (
  SELECT CAST(coalesce(max(CASE WHEN {group} = 'Controls' THEN less_than_2 END), 0) AS BIGINT) AS a,
         CAST(coalesce(max(CASE WHEN {group} = 'Controls' THEN more_than_2 END), 0) AS BIGINT) AS b,
         CAST(coalesce(max(CASE WHEN {group} = 'Exposed Seronegative' THEN less_than_2 END), 0) AS BIGINT) AS c,
         CAST(coalesce(max(CASE WHEN {group} = 'Exposed Seronegative' THEN more_than_2 END), 0) AS BIGINT) AS d
  FROM contingency
)"""
    return with_fixture(_chi2_sql(cells, with_p))


@register("contingency_2x2", with_fixture(_contingency_cte("group5") + "\nSELECT * FROM contingency"))
def q_contingency(inp):
    return R.contingency(inp)


@register("regrouped_contingency_2x2",
          with_fixture(_contingency_cte("group5b") + "\nSELECT * FROM contingency"))
def q_regrouped_contingency(inp):
    return R.contingency(inp, "group5b")


@register("chi_square_yates", _chi2_assay_sql("group5"))
def q_chi_square_yates(inp):
    return R.chi_square(inp)


@register("regrouped_chi_square_yates", _chi2_assay_sql("group5b"))
def q_regrouped_chi_square_yates(inp):
    return R.chi_square(inp, "group5b")


@register("fig3_chi_square", _chi2_assay_sql("group5", True))
def q_fig3_chi_square(inp):
    return R.chi_square(inp, with_p=True)


@register("regrouped_fig3_chi_square", _chi2_assay_sql("group5b", True))
def q_regrouped_fig3_chi_square(inp):
    return R.chi_square(inp, "group5b", with_p=True)


_LABEL_CELLS = """, cells AS (
  SELECT count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS a,
         count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS b,
         count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS c,
         count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS d
  FROM labels
)""".replace(", cells AS", "WITH cells AS", 1)


@register("chi_square_labels", _chi2_sql(""", cells AS (
  SELECT count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS a,
         count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS b,
         count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS c,
         count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS d
  FROM labels
)""".replace(", cells AS", "WITH cells AS", 1)))
def q_chi_square_labels(inp):
    return T.chi_square_labels(inp)


@register("chi_square_labels_pvalue", _chi2_sql(_LABEL_CELLS, True))
def q_chi_square_labels_pvalue(inp):
    return T.chi_square_labels(inp, with_p=True)


def _status_sql(cohort: str | None) -> str:
    where = f"WHERE group5 = '{cohort}'" if cohort else ""
    return with_fixture(panel_cte("panel", "group5", PANEL4, CUT) + f"""
SELECT sero_igg, count(*) AS n FROM subject
WHERE lab_id IN (SELECT lab_id FROM panel {where})
GROUP BY 1""")


@register("status_in_cohort", _status_sql("PCR+ Seronegative"))
def q_status_in_cohort(inp):
    return R.status_in_cohort(inp)


@register("semi_join_status_counts", _status_sql(None))
def q_semi_join_status_counts(inp):
    return R.status_in_cohort(inp, cohort=None)


# --------------------------------------------------------------- Figure 2 --

def _zero_split_sql(groups) -> str:
    gf = f"AND group5 IN {in_list(groups)}" if groups else ""
    return with_fixture(f""", s AS (
  SELECT antigen, {plot_label('group5')} AS group_label, value AS raw_value
  FROM assay WHERE antigen IN {in_list(PANEL4)} {gf} AND value IS NOT NULL
), sss AS (
  SELECT antigen, group_label, raw_value = 0 AS zero, count(*) AS n FROM s GROUP BY 1, 2, 3
), ss AS (
  SELECT antigen, group_label, count(*) AS n_ind FROM s GROUP BY 1, 2
)
SELECT sss.antigen, sss.group_label, sss.zero, sss.n, ss.n_ind
FROM sss LEFT JOIN ss ON sss.antigen IS NOT DISTINCT FROM ss.antigen
 AND sss.group_label IS NOT DISTINCT FROM ss.group_label""")


@register("fig2a_counts", _zero_split_sql([CONTROLS, PCR_SEROPOSITIVE]))
def q_fig2a_counts(inp):
    return R.fig2a_counts(inp)


@register("fig2c_counts", _zero_split_sql(None))
def q_fig2c_counts(inp):
    return R.fig2c_counts(inp)


def _median_log2_sql(where: str, keys: str) -> str:
    return with_fixture(f""", s AS (
  SELECT {keys}, {floor_expr('value', PLOT_FLOOR)} AS v
  FROM assay WHERE antigen IN {in_list(PANEL4)} AND {where} AND value IS NOT NULL
), r AS (
  SELECT {keys}, v,
         row_number() OVER (PARTITION BY {keys} ORDER BY v) AS k,
         count(*) OVER (PARTITION BY {keys}) AS n
  FROM s
)
SELECT {keys},
       round(pow(2, (ln(max(CASE WHEN k = (n + 1) // 2 THEN v END)) / ln(2)
                  + ln(max(CASE WHEN k = n // 2 + 1 THEN v END)) / ln(2)) / 2), 6) AS median
FROM r GROUP BY ALL""")


@register("fig2b_medians", _median_log2_sql(f"group5 IN {in_list(SEROPOSITIVE3)}", "antigen"))
def q_fig2b_medians(inp):
    return R.fig2_medians(inp, SEROPOSITIVE3, by_group=False)


@register("fig2c_medians", _median_log2_sql("group5 IS NOT NULL", "antigen, group5"))
def q_fig2c_medians(inp):
    return R.fig2_medians(inp, None)


@register("median_log2", with_fixture(f""", s AS (
  SELECT antigen, group5, {floor_expr('value', PLOT_FLOOR)} AS v
  FROM assay WHERE antigen IN {in_list(PANEL4)}
   AND group5 IN {in_list([CONTROLS, PCR_SEROPOSITIVE])} AND value IS NOT NULL
), r AS (
  SELECT antigen, group5, v,
         row_number() OVER (PARTITION BY antigen, group5 ORDER BY v) AS k,
         count(*) OVER (PARTITION BY antigen, group5) AS n
  FROM s
)
SELECT antigen, group5,
       round(pow(2, (ln(max(CASE WHEN k = (n + 1) // 2 THEN v END)) / ln(2)
                  + ln(max(CASE WHEN k = n // 2 + 1 THEN v END)) / ln(2)) / 2), 6) AS median
FROM r GROUP BY 1, 2"""))
def q_median_log2(inp):
    return R.fig2_medians(inp)


_S3 = f"group5 IN {in_list(SEROPOSITIVE3)}"


@register("analyte_label", with_fixture(f""", s AS (
  SELECT antigen, value AS raw_value FROM assay
  WHERE {_S3} AND antigen IN {in_list(PANEL4)} AND value IS NOT NULL
), sss AS (SELECT antigen, raw_value = 0 AS zero, count(*) AS n FROM s GROUP BY 1, 2),
ni AS (SELECT antigen, count(*) AS n_ind FROM s GROUP BY 1)
SELECT sss.antigen, sss.zero, sss.n, ni.n_ind,
       {size_label('sss.antigen', 'ni.n_ind', '')} AS antigen_label
FROM sss LEFT JOIN ni ON sss.antigen IS NOT DISTINCT FROM ni.antigen"""))
def q_analyte_label(inp):
    return R.analyte_sizes(inp)


@register("median_by_analyte", with_fixture(f"""
SELECT antigen, round(median({floor_expr('value', PLOT_FLOOR)}), 6) AS median
FROM assay WHERE {_S3} AND antigen IN {in_list(PANEL4)} AND value IS NOT NULL
GROUP BY 1"""))
def q_median_by_analyte(inp):
    return R.median_by_analyte(inp)


def _pairs_cte() -> str:
    cols = ",\n    ".join(f"max(CASE WHEN antigen = {sq(a)} THEN lv END) AS {col_name(a)}"
                          for a in sorted(PANEL4))
    unions = "\n  UNION ALL ".join(
        f"SELECT lab_id, {sq(a)} AS group1, {sq(b)} AS group2, {col_name(a)} - {col_name(b)} AS d FROM w"
        for a, b in all_pairs(PANEL4))
    return f""", t AS (
  SELECT lab_id, antigen, ln({floor_expr('value', TEST_FLOOR)}) / ln(2) AS lv
  FROM assay WHERE {_S3} AND antigen IN {in_list(PANEL4)}
), w AS (
  SELECT lab_id,
    {cols}
  FROM t GROUP BY lab_id
), pairs AS (
  {unions}
), nz AS (
  SELECT group1, group2, d, abs(d) AS ad FROM pairs WHERE d IS NOT NULL AND d <> 0
), rk AS (
  SELECT group1, group2, d, {mid_rank_expr('group1, group2', 'ad')} AS r FROM nz
), tie AS (
  SELECT group1, group2, sum(t * t * t - t) AS ties
  FROM (SELECT group1, group2, ad, CAST(count(*) AS DOUBLE) AS t FROM nz GROUP BY 1, 2, 3)
  GROUP BY 1, 2
), agg AS (
  SELECT group1, group2, CAST(count(*) AS DOUBLE) AS n,
         sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS v
  FROM rk GROUP BY 1, 2
), zer AS (
  SELECT group1, group2, count(CASE WHEN d = 0 THEN 1 END) AS zeros
  FROM pairs WHERE d IS NOT NULL GROUP BY 1, 2
), sraw AS (
  SELECT agg.group1, agg.group2, n, v, ties, zer.zeros,
         ((v - n * (n + 1) / 4.0) - sign(v - n * (n + 1) / 4.0) * 0.5)
           / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z
  FROM agg JOIN tie ON agg.group1 = tie.group1 AND agg.group2 = tie.group2
           JOIN zer ON agg.group1 = zer.group1 AND agg.group2 = zer.group2
), srt AS (
  SELECT group1, group2, CAST(n AS BIGINT) AS n, round(v, 6) AS statistic, round(z, 6) AS z
  FROM sraw
)"""


@register("signed_rank_pairs", with_fixture(_pairs_cte() + "\nSELECT * FROM srt"))
def q_signed_rank_pairs(inp):
    return R.signed_rank_pairs(inp)


_PICKED = [("M", "NC"), ("NC", "SCT"), ("M", "SNT")]


@register("selected_comparisons", with_fixture(_pairs_cte() + "\nSELECT * FROM srt WHERE "
                                                + " OR ".join(f"(group1 = {sq(a)} AND group2 = {sq(b)})"
                                                              for a, b in _PICKED)))
def q_selected_comparisons(inp):
    return R.signed_rank_pairs(inp, pairs=_PICKED)  # the others are not tested at all


@register("fig2b_tests", with_fixture(_pairs_cte() + f""", pv AS (
  SELECT *, {normal_p_expr('z')} AS p FROM sraw
), adj AS (
  SELECT *, {adjusted_expr('p')} AS p_adj FROM pv
), s AS (
  SELECT antigen FROM assay
  WHERE {_S3} AND antigen IN {in_list(PANEL4)} AND value IS NOT NULL
), lab AS (
  SELECT antigen, {size_label('antigen', 'count(*)', '')} AS antigen_label FROM s GROUP BY 1
)
SELECT adj.group1, adj.group2, l1.antigen_label AS group1_label, l2.antigen_label AS group2_label,
       CAST(n AS BIGINT) AS n, CAST(zeros AS BIGINT) AS zeros, round(v, 6) AS statistic,
       round(z, 6) AS z, (n < 50 AND ties = 0 AND zeros = 0) AS exact,
       round(p, 6) AS p, round(p_adj, 6) AS p_adj, {signif_expr('p_adj')} AS p_adj_signif
FROM adj LEFT JOIN lab l1 ON adj.group1 = l1.antigen LEFT JOIN lab l2 ON adj.group2 = l2.antigen"""))
def q_fig2b_tests(inp):
    return R.signed_rank_pairs(inp, with_p=True)


@register("paired_analyte_differences", with_fixture(
    _pairs_cte() + "\nSELECT lab_id, group1, group2, round(d, 6) AS d FROM pairs WHERE d IS NOT NULL"))
def q_paired_analyte_differences(inp):
    return T.paired_analyte_differences(inp)


# --------------------------------------------------------------- Figure 4 --

_TITRES = """, titres AS (
  SELECT lab_id, roche, TRY_CAST(igg_raw AS DOUBLE) AS igg FROM subject
)"""


def _loglog_cte(titre: str) -> str:
    return _TITRES + f""", pts AS (
  SELECT a.antigen, {log2_expr('t.' + titre)} AS lx,
         {log2_expr(floor_expr('a.value', TEST_FLOOR))} AS ly
  FROM assay a LEFT JOIN titres t ON a.lab_id = t.lab_id
  WHERE a.{_S3} AND a.antigen IN {in_list(PANEL4)}
)"""


def _pearson_sql(titre: str) -> str:
    return with_fixture(_loglog_cte(titre) + """
SELECT antigen, count(CASE WHEN lx IS NOT NULL AND ly IS NOT NULL THEN 1 END) AS n,
       round(corr(ly, lx), 6) AS r
FROM pts GROUP BY 1""")


def _regression_sql(cte: str, y: str, x: str) -> str:
    return with_fixture(cte + f"""
SELECT antigen, CAST(regr_count({y}, {x}) AS BIGINT) AS n,
       round(regr_slope({y}, {x}), 6) AS slope,
       round(regr_intercept({y}, {x}), 6) AS intercept
FROM pts GROUP BY 1""")


@register("pearson_log_log", _pearson_sql("roche"))
def q_pearson_log_log(inp):
    return R.pearson_log_log(inp)


@register("regression_log_log", _regression_sql(_loglog_cte("roche"), "ly", "lx"))
def q_regression_log_log(inp):
    return R.regression_log_log(inp)


@register("pearson_titre2", _pearson_sql("igg"))
def q_pearson_titre2(inp):
    return R.pearson_log_log(inp, "igg")


@register("regression_titre2", _regression_sql(_loglog_cte("igg"), "ly", "lx"))
def q_regression_titre2(inp):
    return R.regression_log_log(inp, "igg")


def _fig4a_sql(titre: str) -> str:
    return with_fixture(_loglog_cte(titre) + """, cor AS (
  SELECT antigen, count(CASE WHEN lx IS NOT NULL AND ly IS NOT NULL THEN 1 END) AS n,
         corr(ly, lx) AS r, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept
  FROM pts GROUP BY 1
)""" + correlation_p_cte("cor", "r", "n") + f"""
SELECT antigen, n, round(r, 6) AS r, round(p, 6) AS p, round(slope, 6) AS slope,
       round(intercept, 6) AS intercept, {stat_label_expr('r', 'p', 'R')} AS label
FROM cp""")


@register("fig4a_correlation", _fig4a_sql("roche"))
def q_fig4a_correlation(inp):
    return R.fig4a_correlation(inp)


@register("fig4a_titre2", _fig4a_sql("igg"))
def q_fig4a_titre2(inp):
    return R.fig4a_correlation(inp, "igg")


def _spearman_sql(group: str, groups, titre: str, pooled: bool) -> str:
    part = "" if pooled else group
    sel = "" if pooled else f"{group}, "
    gb = "" if pooled else "GROUP BY 1"
    return with_fixture(panel_cte("panel", group, PANEL4, CUT, detected="n") + _TITRES + f""", pts AS (
  SELECT p.{group}, CAST(p.n AS DOUBLE) AS x, t.{titre} AS y
  FROM panel p LEFT JOIN titres t ON p.lab_id = t.lab_id
  WHERE p.{group} IN {in_list(groups)} AND t.{titre} > 0
), rk AS (
  SELECT {sel}{mid_rank_expr(part, 'x')} AS rx, {mid_rank_expr(part, 'y')} AS ry FROM pts
)
SELECT {sel}count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk {gb}""")


@register("spearman_by_group", _spearman_sql("group5", SEROPOSITIVE3, "roche", False))
def q_spearman_by_group(inp):
    return R.spearman_table(inp)


@register("spearman_overall", _spearman_sql("group5", SEROPOSITIVE3, "roche", True))
def q_spearman_overall(inp):
    return R.spearman_table(inp, pooled=True)


@register("regrouped_spearman_by_group", _spearman_sql("group5b", NONCONTROL4, "roche", False))
def q_regrouped_spearman(inp):
    return R.spearman_table(inp, "group5b", NONCONTROL4, "roche")


@register("regrouped_spearman_igg", _spearman_sql("group5b", NONCONTROL4, "igg", False))
def q_regrouped_spearman_igg(inp):
    return R.spearman_table(inp, "group5b", NONCONTROL4, "igg")


def _fig4b_sql(group: str, groups, titre: str, cols: str | None = None) -> str:
    cols = cols or f"grp AS \"group\", n, round(rho, 6) AS rho, round(p, 6) AS p, " \
                   f"{stat_label_expr('rho', 'p', 'rho')} AS label"
    return with_fixture(panel_cte("panel", group, PANEL4, CUT, detected="n") + _TITRES + f""", pts AS (
  SELECT p.{group} AS grp, CAST(p.n AS DOUBLE) AS x, t.{titre} AS y
  FROM panel p LEFT JOIN titres t ON p.lab_id = t.lab_id
  WHERE p.{group} IN {in_list(groups)} AND t.{titre} > 0
), rk AS (
  SELECT grp, {mid_rank_expr('grp', 'x')} AS rx, {mid_rank_expr('grp', 'y')} AS ry FROM pts
), rk_all AS (
  SELECT {mid_rank_expr('', 'x')} AS rx, {mid_rank_expr('', 'y')} AS ry FROM pts
), rho AS (
  SELECT grp, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY 1
  UNION ALL
  SELECT 'all' AS grp, count(*) AS n, corr(rx, ry) AS rho FROM rk_all
)""" + correlation_p_cte("rho", "rho", "n") + f"""
SELECT {cols} FROM cp""")


@register("fig4b_spearman", _fig4b_sql("group5", SEROPOSITIVE3, "roche"))
def q_fig4b_spearman(inp):
    return R.fig4b_spearman(inp)


@register("regrouped_fig4b", _fig4b_sql("group5b", NONCONTROL4, "roche"))
def q_regrouped_fig4b(inp):
    return R.fig4b_spearman(inp, "group5b", NONCONTROL4, "roche")


@register("regrouped_fig4c", _fig4b_sql("group5b", NONCONTROL4, "igg"))
def q_regrouped_fig4c(inp):
    return R.fig4b_spearman(inp, "group5b", NONCONTROL4, "igg")


# -------------------------------------------------------------- Figure S1 --

_WT = f""", wt AS (
  SELECT lab_id, sero_igg, antigen, {floor_expr('value', PLOT_FLOOR)} AS value
  FROM assay WHERE group5 = 'PCR+ Seronegative' AND antigen IN {in_list(PANEL4)}
   AND TRY_CAST(igg_raw AS DOUBLE) IS NOT NULL
)"""


def _rank_sum_sql(src_cte: str, stratum: str, group: str, g1: str, g2: str) -> str:
    return src_cte + f""", src AS (
  SELECT * FROM wt WHERE {group} IN ({sq(g1)}, {sq(g2)}) AND value IS NOT NULL
), rk AS (
  SELECT {stratum}, {group}, {mid_rank_expr(stratum, 'value')} AS r FROM src
), tie AS (
  SELECT {stratum}, sum(t * t * t - t) AS ties
  FROM (SELECT {stratum}, value, CAST(count(*) AS DOUBLE) AS t FROM src GROUP BY 1, 2)
  GROUP BY 1
), agg AS (
  SELECT {stratum},
         CAST(count(CASE WHEN {group} = {sq(g1)} THEN 1 END) AS DOUBLE) AS n1,
         CAST(count(CASE WHEN {group} = {sq(g2)} THEN 1 END) AS DOUBLE) AS n2,
         sum(CASE WHEN {group} = {sq(g1)} THEN r ELSE 0 END) AS r1
  FROM rk GROUP BY 1
), w AS (
  SELECT agg.{stratum}, n1, n2, r1 - n1 * (n1 + 1) / 2 AS stat, ties
  FROM agg JOIN tie ON agg.{stratum} = tie.{stratum}
), rsraw AS (
  SELECT {stratum}, {sq(g1)} AS group1, {sq(g2)} AS group2, n1, n2, stat, ties,
         ((stat - n1 * n2 / 2) - sign(stat - n1 * n2 / 2) * 0.5)
           / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z
  FROM w
), rse AS (
  SELECT *, (n1 < 50 AND n2 < 50 AND ties = 0) AS exact FROM rsraw
){exact_ranksum_ctes('rse')}, rsp AS (
  SELECT rse.*, {ranksum_p_expr('z', 'stat')} AS p
  FROM rse LEFT JOIN tails ON exact AND m = n1 AND n = n2 AND w = stat
), rsa AS (
  SELECT *, {adjusted_expr('p')} AS p_adj FROM rsp
)
SELECT {stratum}, group1, group2, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       round(stat, 6) AS statistic, round(z, 6) AS z{{extra}}
FROM rsa"""


_P_COLS = (", exact, round(p, 6) AS p, round(p_adj, 6) AS p_adj, "
           + signif_expr("p_adj") + " AS p_adj_signif")
_S1_SQL = _rank_sum_sql(_WT, "antigen", "sero_igg", "Negative", "Positive")


def _with_cols(sql: str, extra: str = "", select: str | None = None) -> str:
    sql = sql.replace("{extra}", extra)
    if select is not None:
        head, _, _ = sql.rpartition("SELECT ")
        sql = head + select + "\nFROM rsa"
    return sql


@register("rank_sum_by_stratum", with_fixture(_with_cols(_S1_SQL)))
def q_rank_sum_by_stratum(inp):
    return R.rank_sum_by_stratum(inp)


@register("figS1_rank_sum", with_fixture(_with_cols(_S1_SQL, (
    ", exact, round(p, 6) AS p, " + signif_expr("p") + " AS p_signif, round(p_adj, 6) AS p_adj, "
    + signif_expr("p_adj") + " AS p_adj_signif"))))
def q_figS1_rank_sum(inp):
    return R.rank_sum_by_stratum(inp, with_p=True)


@register("n_per_panel", with_fixture(_WT + """
SELECT antigen, sero_igg, count(value) AS n FROM wt GROUP BY 1, 2"""))
def q_n_per_panel(inp):
    return R.n_per_panel(inp)


@register("mid_rank", with_fixture(_WT + f"""
SELECT lab_id, antigen, value,
       CASE WHEN value IS NOT NULL THEN {mid_rank_expr('antigen', 'value')} END AS mid_rank
FROM wt"""))
def q_mid_rank(inp):
    return T.mid_rank(inp)


_EVENTS = """WITH RECURSIVE wt AS (
  SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, value
  FROM events
)"""


_EV_SQL = _rank_sum_sql(_EVENTS, "event_type", "half", "even", "odd")


@register("rank_sum_events", _with_cols(_EV_SQL))
def q_rank_sum_events(inp):
    return T.rank_sum_events(inp)


@register("rank_sum_events_pvalues", _with_cols(_EV_SQL, _P_COLS))
def q_rank_sum_events_pvalues(inp):
    return T.rank_sum_events(inp, with_p=True)


# --------------------------------------------------------------- kinetics --

_KIN = f""", kin AS (
  SELECT lab_id, antigen, group5, {floor_expr('value', TEST_FLOOR)} AS value,
         CAST(date_diff('day', test_date, visit_date) AS INTEGER) AS days
  FROM assay WHERE antigen IN {in_list(PANEL4)} AND group5 IS NOT NULL AND group3 = 'PCR+'
)"""


@register("kinetics_points", with_fixture(_KIN + f"""
SELECT lab_id, antigen, group5, days, value, round({log2_expr('value')}, 6) AS log2_value
FROM kin WHERE days > 100"""))
def q_kinetics_points(inp):
    return R.kinetics_points(inp)


@register("regression_kinetics", _regression_sql(_KIN + f""", pts AS (
  SELECT antigen, CAST(days AS DOUBLE) AS x, {log2_expr('value')} AS y FROM kin WHERE days > 100
)""", "y", "x"))
def q_regression_kinetics(inp):
    return R.regression_kinetics(inp)


# ------------------------------------------------ operator-level queries ---

def _analyte_cols(src_col: str, value: str, names, labels=None) -> str:
    labels = labels or names
    return ",\n    ".join(f'max(CASE WHEN {src_col} = {sq(a)} THEN {value} END) AS "{n}"'
                          for a, n in zip(names, labels))


_ANALYTES6 = T.ANALYTES6
_RAW6 = T.RAW6


@register("preview", with_fixture("""
SELECT lab_id, group3, roche, sero_roche, sero_igg, test_date, group5, group5b,
       TRY_CAST(igg_raw AS DOUBLE) AS igg
FROM subject ORDER BY lab_id LIMIT 6"""))
def q_preview(inp):
    return T.preview(inp)


@register("wide_to_long", with_fixture(f""", w AS (
  SELECT lab_id,
    {_analyte_cols('antigen', 'value', _ANALYTES6)}
  FROM assay_long WHERE antigen IS NOT NULL GROUP BY lab_id
)
""" + "\nUNION ALL ".join(f'SELECT lab_id, {sq(a)} AS antigen, "{a}" AS value FROM w'
                          for a in _ANALYTES6)))
def q_wide_to_long(inp):
    return T.wide_to_long(inp)


@register("rename_analytes", with_fixture(f"""
SELECT lab_id,
    {_analyte_cols('antigen_raw', 'value', _RAW6, _ANALYTES6)}
FROM assay_raw WHERE antigen_raw IN {in_list(_RAW6)} GROUP BY lab_id"""))
def q_rename_analytes(inp):
    return T.rename_analytes(inp)


@register("recode_antigen", with_fixture("""
SELECT lab_id, antigen_raw, """ + case_map("antigen_raw", dict(zip(_RAW6, _ANALYTES6))) +
                                          " AS antigen FROM assay_raw"))
def q_recode_antigen(inp):
    return T.recode_antigen(inp)


@register("localized_labels", with_fixture("""
SELECT lab_id, antigen_raw, """ + case_map("antigen_raw", ANALYTE_LOCALIZED_NAMES) +
                                            " AS antigen FROM assay_raw"))
def q_localized_labels(inp):
    return T.recode_antigen(inp, localized=True)


_COMBINED = """CASE WHEN sero_roche = 'Positive' OR sero_igg = 'Positive' THEN 'Positive'
            WHEN sero_roche = 'Negative' AND sero_igg = 'Negative' THEN 'Negative' END"""


@register("combined_status", with_fixture(f"""
SELECT lab_id, sero_roche, sero_igg, {_COMBINED} AS sero_combined FROM subject"""))
def q_combined_status(inp):
    return T.combined_status(inp)


@register("regroup_cohort", with_fixture(f"""
SELECT lab_id, group3, {_COMBINED} AS sero_combined, group5b FROM subject"""))
def q_regroup_cohort(inp):
    return T.regroup_cohort(inp)


@register("binned_detection", with_fixture(f""", per AS (
  SELECT lab_id, group5, CAST(sum(CAST(value > {CUT!r} AS INTEGER)) AS BIGINT) AS detected
  FROM assay WHERE group5 IS NOT NULL AND antigen IN {in_list(PANEL4)} AND value IS NOT NULL
  GROUP BY 1, 2
), dist AS (SELECT group5, detected, count(*) AS n FROM per GROUP BY 1, 2)
SELECT group5, CASE WHEN detected IN (0, 1) THEN 'Less than 2'
                    WHEN detected IN (2, 3, 4) THEN 'More than 2' END AS detected_bin,
       CAST(sum(n) AS BIGINT) AS n2
FROM dist GROUP BY 1, 2"""))
def q_binned_detection(inp):
    return T.binned_detection(inp)


@register("floor_zeros", with_fixture(f"""
SELECT lab_id, antigen, value, {floor_expr('value', PLOT_FLOOR)} AS value_plot,
       {floor_expr('value', TEST_FLOOR)} AS value_test
FROM assay_long"""))
def q_floor_zeros(inp):
    return T.floor_zeros(inp)


@register("threshold_flag", with_fixture(f"""
SELECT lab_id, antigen, value, CAST(value > {CUT!r} AS INTEGER) AS flag FROM assay_long"""))
def q_threshold_flag(inp):
    return T.threshold_flag(inp)


@register("threshold_label", with_fixture(f"""
SELECT lab_id, antigen, CASE WHEN value > {CUT!r} THEN 'Above' WHEN value <= {CUT!r} THEN 'Below' END AS label
FROM assay_long"""))
def q_threshold_label(inp):
    return T.threshold_label(inp)


@register("zero_split", with_fixture("""
SELECT antigen, value = 0 AS zero, count(*) AS n FROM assay_long
WHERE antigen IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2"""))
def q_zero_split(inp):
    return T.zero_split(inp)


_SPREAD4 = f"""
SELECT lab_id, group5,
    {_analyte_cols('antigen', 'value', PANEL4)}
FROM assay WHERE group5 IS NOT NULL AND antigen IN {in_list(PANEL4)}
GROUP BY lab_id, group5"""


@register("complete_case", with_fixture(f""", w AS ({_SPREAD4})
SELECT *, CASE WHEN {' OR '.join(f'"{a}" IS NULL' for a in PANEL4)} THEN 'remove' ELSE 'keep' END
       AS complete
FROM w"""))
def q_complete_case(inp):
    return T.complete_case(inp)


@register("spread_analytes", with_fixture(_SPREAD4))
def q_spread_analytes(inp):
    return T.spread_analytes(inp)


@register("gather_analytes", with_fixture(f""", w AS ({_SPREAD4})
""" + "\nUNION ALL ".join(f'SELECT lab_id, group5, {sq(a)} AS antigen, "{a}" AS value FROM w'
                          for a in PANEL4)))
def q_gather_analytes(inp):
    return T.gather_analytes(inp)


@register("complete_case_long", with_fixture(f""", w AS ({_SPREAD4}), c AS (
  SELECT * FROM w WHERE {' AND '.join(f'"{a}" IS NOT NULL' for a in PANEL4)}
)
""" + "\nUNION ALL ".join(f'SELECT lab_id, group5, {sq(a)} AS antigen, "{a}" AS value FROM c'
                          for a in PANEL4)))
def q_complete_case_long(inp):
    return T.complete_case_long(inp)


@register("spread_duplicates", """
SELECT l_orderkey AS lab_id,
       CASE l_linenumber WHEN 1 THEN 'Capsid sub x5' WHEN 2 THEN 'Membrane sub x5'
            WHEN 3 THEN 'SCT sub x5' WHEN 4 THEN 'SNT sub x5'
            WHEN 5 THEN 'grün sbu x5' WHEN 6 THEN 'yellow sub x5'
            WHEN 7 THEN 'unlisted sub x5' END AS antigen_raw,
       count(*) AS n
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q_spread_duplicates(inp):
    return T.spread_duplicates(inp)


@register("text_to_number", with_fixture("""
SELECT lab_id, TRY_CAST(igg_raw AS DOUBLE) AS igg FROM subject"""))
def q_text_to_number(inp):
    return T.text_to_number(inp)


@register("cohort_label", with_fixture(panel_cte("panel", "group5", PANEL3, CUT) + f"""
SELECT group5, count(*) AS n_ind, {size_label(plot_label('group5'), 'count(*)')} AS group_label
FROM panel GROUP BY 1"""))
def q_cohort_label(inp):
    return T.cohort_label(inp)


@register("log2_values", with_fixture(f"""
SELECT lab_id, antigen, round({log2_expr(floor_expr('value', TEST_FLOOR))}, 6) AS log2_value
FROM assay_long"""))
def q_log2_values(inp):
    return T.log2_values(inp)


@register("days_since_test", with_fixture("""
SELECT lab_id, antigen, CAST(date_diff('day', test_date, visit_date) AS INTEGER) AS days
FROM assay"""))
def q_days_since_test(inp):
    return T.days_since_test(inp)


@register("detected_count_zero_filled", with_fixture(panel_cte("panel", "group5", PANEL4, CUT,
                                                               detected="n") + """
SELECT lab_id, group5, n FROM panel"""))
def q_detected_count_zero_filled(inp):
    return T.detected_count_zero_filled(inp)


@register("percent_of_group", with_fixture(f""", per AS (
  SELECT lab_id, group5, CAST(sum(CAST(value > {CUT!r} AS INTEGER)) AS BIGINT) AS detected
  FROM assay WHERE group5 IS NOT NULL AND antigen IN {in_list(PANEL4)} AND value IS NOT NULL
  GROUP BY 1, 2
), dist AS (SELECT group5, detected, count(*) AS n FROM per GROUP BY 1, 2)
SELECT group5, detected, n, round(n / sum(n) OVER (PARTITION BY group5) * 100.0, 6) AS prop
FROM dist"""))
def q_percent_of_group(inp):
    return T.percent_of_group(inp)


@register("filter_membership", with_fixture(f"""
SELECT lab_id, antigen, group5, value FROM assay
WHERE {_S3} AND antigen IN {in_list(PANEL4)}"""))
def q_filter_membership(inp):
    return T.filter_membership(inp)


@register("filter_not_null", with_fixture("""
SELECT lab_id, antigen, value FROM assay_long WHERE antigen IS NOT NULL AND value IS NOT NULL"""))
def q_filter_not_null(inp):
    return T.filter_not_null(inp)


@register("attach_cohort_size", with_fixture(f""", per AS (
  SELECT lab_id, group5, CAST(sum(CAST(value > {CUT!r} AS INTEGER)) AS BIGINT) AS detected
  FROM assay WHERE antigen IN {in_list(PANEL4)} AND value IS NOT NULL GROUP BY 1, 2
), dist AS (SELECT group5, detected, count(*) AS n FROM per GROUP BY 1, 2),
sizes AS (SELECT group5, count(*) AS n_ind FROM per GROUP BY 1)
SELECT d.group5, d.detected, d.n, s.n_ind
FROM dist d LEFT JOIN sizes s ON d.group5 IS NOT DISTINCT FROM s.group5"""))
def q_attach_cohort_size(inp):
    return T.attach_cohort_size(inp)


@register("attach_titre", with_fixture(panel_cte("panel", "group5", PANEL4, CUT, detected="n")
                                       + _TITRES + """
SELECT p.lab_id, p.group5, p.n, t.roche, t.igg
FROM panel p LEFT JOIN titres t ON p.lab_id = t.lab_id"""))
def q_attach_titre(inp):
    return T.attach_titre(inp)


@register("count_by_group", with_fixture("""
SELECT antigen, group5, count(*) AS n FROM assay
WHERE antigen IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2"""))
def q_count_by_group(inp):
    return T.count_by_group(inp)


@register("detected_per_subject", with_fixture(panel_cte("panel", "group5", PANEL3, CUT) + """
SELECT lab_id, group5, detected FROM panel"""))
def q_detected_per_subject(inp):
    return T.detected_per_subject(inp)


@register("detection_distribution", with_fixture(panel_cte("panel", "group5", PANEL3, CUT) + """
SELECT group5, detected, count(*) AS n, CAST(detected AS VARCHAR) AS detected_level
FROM panel GROUP BY 1, 2"""))
def q_detection_distribution(inp):
    return T.detection_distribution(inp)


_LABELS = f""", w AS ({_SPREAD4}), c AS (
  SELECT * FROM w WHERE {' AND '.join(f'"{a}" IS NOT NULL' for a in PANEL4)}
), lng AS (
""" + "\n  UNION ALL ".join(f'SELECT lab_id, group5, "{a}" AS value FROM c' for a in PANEL4) + f"""
), lab AS (
  SELECT lab_id, group5, CASE WHEN value > {CUT!r} THEN 'Above' WHEN value <= {CUT!r} THEN 'Below' END AS label
  FROM lng
), counts AS (
  SELECT lab_id, group5, label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY 1, 2, 3
)"""


@register("label_counts", with_fixture(_LABELS + "\nSELECT * FROM counts"))
def q_label_counts(inp):
    return T.label_counts(inp)


@register("label_counts_wide", with_fixture(_LABELS + """
SELECT lab_id, group5, max(CASE WHEN label = 'Above' THEN n END) AS "Above",
       max(CASE WHEN label = 'Below' THEN n END) AS "Below"
FROM counts GROUP BY 1, 2"""))
def q_label_counts_wide(inp):
    return T.label_counts_wide(inp)


def _size_sql(panel) -> str:
    return with_fixture(panel_cte("panel", "group5", panel, CUT) + """
SELECT group5, count(*) AS n_ind FROM panel GROUP BY 1""")


@register("cohort_size_k3", _size_sql(PANEL3))
def q_cohort_size_k3(inp):
    return T.cohort_size(inp, PANEL3)


@register("cohort_size_k4", _size_sql(PANEL4))
def q_cohort_size_k4(inp):
    return T.cohort_size(inp, PANEL4)


_LINE_ANALYTE = case_map("l_linenumber", {
    line: ANALYTE_SHORT_NAMES[raw] for line, raw in LINE_TO_RAW_LABEL.items()
    if raw in ANALYTE_SHORT_NAMES})


@register("category_order", f"""
WITH f AS (
  SELECT {_LINE_ANALYTE} AS antigen, l_linenumber, min(l_orderkey) AS first_position
  FROM lineitem GROUP BY 2)
SELECT antigen, first_position,
       row_number() OVER (ORDER BY first_position, l_linenumber) AS level,
       row_number() OVER (ORDER BY first_position DESC, l_linenumber DESC) AS level_rev
FROM f WHERE antigen IS NOT NULL""")
def q_category_order(inp):
    return T.category_order(inp)


@register("category_pairs", with_fixture(f""", c AS (
  SELECT DISTINCT antigen FROM assay_long WHERE antigen IN {in_list(PANEL4)}
)
SELECT a.antigen AS group1, b.antigen AS group2 FROM c a JOIN c b ON a.antigen < b.antigen"""))
def q_category_pairs(inp):
    return T.category_pairs(inp)


# ------------------------------------------- inference helpers (I3, I4, I9) --

@register("bonferroni", with_fixture(_with_cols(
    _S1_SQL, select="SELECT antigen, group1, group2, exact, round(p, 6) AS p, "
                    "round(p_adj, 6) AS p_adj")))
def q_bonferroni(inp):
    return R.rank_sum_by_stratum(inp, with_p=True).select(
        "antigen", "group1", "group2", "exact", "p", "p_adj")


@register("significance", with_fixture(_with_cols(_S1_SQL, select=(
    "SELECT antigen, group1, group2, exact, round(p, 6) AS p, " + signif_expr("p") + " AS p_signif, "
    "round(p_adj, 6) AS p_adj, " + signif_expr("p_adj") + " AS p_adj_signif"))))
def q_significance(inp):
    return R.rank_sum_by_stratum(inp, with_p=True).select(
        "antigen", "group1", "group2", "exact", "p", "p_signif", "p_adj", "p_adj_signif")


@register("stat_label", _fig4b_sql("group5", SEROPOSITIVE3, "roche"))
def q_stat_label(inp):
    return R.fig4b_spearman(inp).select("group", "n", "rho", "p", "label")


@register("subject_summary", with_fixture(f""", w AS (
  SELECT lab_id, group5,
    max(CASE WHEN antigen = 'M' THEN value END) AS m,
    max(CASE WHEN antigen = 'NC' THEN value END) AS nc,
    max(CASE WHEN antigen = 'SCT' THEN value END) AS sct,
    max(CASE WHEN antigen = 'SNT' THEN value END) AS snt
  FROM assay WHERE group5 IS NOT NULL AND antigen IN {in_list(PANEL4)}
  GROUP BY lab_id, group5
)
SELECT *,
  (nc IS NOT NULL AND m IS NOT NULL AND sct IS NOT NULL) AS complete_k3,
  CASE WHEN nc IS NOT NULL AND m IS NOT NULL AND sct IS NOT NULL THEN
    CAST(CAST(nc > {CUT!r} AS INTEGER) + CAST(m > {CUT!r} AS INTEGER)
         + CAST(sct > {CUT!r} AS INTEGER) AS BIGINT) END AS detected_k3,
  (nc IS NOT NULL AND m IS NOT NULL AND sct IS NOT NULL AND snt IS NOT NULL) AS complete_k4,
  CASE WHEN nc IS NOT NULL AND m IS NOT NULL AND sct IS NOT NULL AND snt IS NOT NULL THEN
    CAST(CAST(nc > {CUT!r} AS INTEGER) + CAST(m > {CUT!r} AS INTEGER)
         + CAST(sct > {CUT!r} AS INTEGER) + CAST(snt > {CUT!r} AS INTEGER) AS BIGINT) END
    AS detected_k4
FROM w"""))
def q_subject_summary(inp):
    return T.subject_summary(inp)


@register("fig3_detection_tables", with_fixture(
    panel_cte("p3", "group5", PANEL3, CUT) + panel_cte("p4", "group5", PANEL4, CUT) + """, per AS (
  SELECT 'k3' AS panel, group5, detected FROM p3
  UNION ALL
  SELECT 'k4' AS panel, group5, detected FROM p4
), dist AS (SELECT panel, group5, detected, count(*) AS n FROM per GROUP BY 1, 2, 3)
SELECT panel, group5, detected, n, CAST(sum(n) OVER (PARTITION BY panel, group5) AS BIGINT) AS n_ind,
       round(n / sum(n) OVER (PARTITION BY panel, group5) * 100.0, 6) AS prop
FROM dist"""))
def q_fig3_detection_tables(inp):
    return R.fig3_detection_tables(inp)


# ------------------------------------------------ missing values, exact p --

@register("nan_as_missing", f"""
WITH a AS (
  SELECT l_orderkey, {_LINE_ANALYTE} AS antigen,
         max(CASE WHEN l_tax < 0.08 AND l_partkey % 5 <> 0
                  THEN l_extendedprice * l_discount END) AS value
  FROM lineitem GROUP BY 1, 2)
SELECT antigen, count(*) AS n_rows, count(value) AS n, count(value) AS n_flagged,
       count(CASE WHEN value > {CUT!r} THEN 1 END) AS n_above, round(max(value), 6) AS largest
FROM a WHERE antigen IS NOT NULL GROUP BY 1""")
def q_nan_as_missing(inp):
    return T.nan_as_missing(inp)


@register("rank_sum_small_strata", f"""
WITH RECURSIVE
src AS (
  SELECT o_custkey, o_orderstatus = 'F' AS first_sample, o_totalprice AS v FROM orders
  WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL),
ranked AS (
  SELECT *, {mid_rank_expr('o_custkey', 'v')} AS r,
         count(*) OVER (PARTITION BY o_custkey, v) AS c FROM src),
tests AS (
  SELECT o_custkey, count(*) FILTER (first_sample) AS n1, count(*) FILTER (NOT first_sample) AS n2,
         coalesce(sum(r) FILTER (first_sample), 0) AS r1, sum(c * c - 1.0) AS ties
  FROM ranked GROUP BY 1),
stat AS (
  SELECT *, CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS statistic,
         (n1 < 50 AND n2 < 50 AND ties = 0) AS exact,
         CAST(n1 AS DOUBLE) AS a, CAST(n2 AS DOUBLE) AS b
  FROM tests),
zs AS (
  SELECT *, CASE WHEN a > 0 AND b > 0 AND a + b > 1
                      AND a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1))) > 0
                 THEN (statistic - a * b / 2 - sign(statistic - a * b / 2) * 0.5)
                      / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) END AS z
  FROM stat){exact_ranksum_ctes('stat')}
SELECT o_custkey, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, statistic, exact,
       round({ranksum_p_expr('z', 'statistic')}, 6) AS p
FROM zs LEFT JOIN tails ON exact AND m = n1 AND n = n2 AND w = statistic""")
def q_rank_sum_small_strata(inp):
    return T.rank_sum_small_strata(inp)


@register("spearman_small_strata", f"""
WITH RECURSIVE
src AS (
  SELECT o_custkey, o_totalprice AS x, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS y
  FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL),
ranked AS (
  SELECT o_custkey, {mid_rank_expr('o_custkey', 'x')} AS rx, {mid_rank_expr('o_custkey', 'y')} AS ry,
         greatest(count(*) OVER (PARTITION BY o_custkey, x),
                  count(*) OVER (PARTITION BY o_custkey, y)) AS c
  FROM src),
sums AS (
  SELECT o_custkey, count(*) AS n, max(c) > 1 AS tied, sum((rx - ry) * (rx - ry)) AS s,
         sum(rx * ry) - count(*) * avg(rx) * avg(ry) AS xy,
         sum(rx * rx) - count(*) * avg(rx) * avg(rx) AS xx,
         sum(ry * ry) - count(*) * avg(ry) * avg(ry) AS yy
  FROM ranked GROUP BY o_custkey),
rhos AS (
  SELECT o_custkey, n, tied, s, CASE WHEN xx > 0 AND yy > 0 THEN xy / sqrt(xx * yy) END AS rho
  FROM sums),
orders_of(n, k, taken, s, ways) AS (
  SELECT n, 0, 0, 0, CAST(1 AS DOUBLE) FROM range(2, 10) t(n)
  UNION ALL
  SELECT n, k + 1, taken | (1 << j), s + (k - j) * (k - j), sum(ways)
  FROM orders_of, range(9) r(j)
  WHERE k < n AND j < n AND taken & (1 << j) = 0
  GROUP BY 1, 2, 3, 4),
counted AS (SELECT n, s, sum(ways) AS ways FROM orders_of WHERE k = n GROUP BY n, s),
tails AS (
  SELECT n, s, sum(ways) OVER lo / sum(ways) OVER al AS low, sum(ways) OVER hi / sum(ways) OVER al AS high
  FROM counted
  WINDOW al AS (PARTITION BY n), lo AS (PARTITION BY n ORDER BY s),
         hi AS (PARTITION BY n ORDER BY s DESC)),
series AS (
  SELECT *, 1.0 / n AS b, (6 * (least(s, mean * 2 - s) + 1) / (n * (n * n - 1.0)) - 1) * sqrt(n - 1.0) AS z,
         z * z AS w
  FROM (SELECT *, (n * n * n - n) / 6.0 AS mean FROM rhos WHERE n > 9 AND NOT tied)),
edge AS (
  SELECT o_custkey, least(1, greatest(0, 2 * (
    CASE WHEN z <= 0 THEN {erfc_expr('(abs(z) / sqrt(2.0))')} / 2
         ELSE 1 - {erfc_expr('(abs(z) / sqrt(2.0))')} / 2 END
    - exp(-w / 2) * z * b * (
        0.2274 + 0.2531 * b + 0.1745 * b * b
        + w * (-0.0758 + 0.1033 * b + 0.3932 * b * b)
        - w * w * b * (0.0879 + 0.0151 * b)
        + w * w * w * b * (0.0072 - 0.0831 * b)
        + w * w * w * w * b * b * (0.0131 - 0.00046 * w))))) AS p
  FROM series){correlation_p_cte('rhos', 'rho', 'n')}
SELECT cp.o_custkey, CAST(cp.n AS BIGINT) AS n, round(rho, 6) AS rho, tied,
       round(CASE WHEN rho IS NULL OR cp.n < 2 THEN NULL
                  WHEN tied OR cp.n >= 1290 THEN cp.p
                  WHEN cp.n > 9 THEN edge.p
                  ELSE least(1, 2 * least(low, high)) END, 6) AS p
FROM cp LEFT JOIN edge USING (o_custkey) LEFT JOIN tails ON cp.n = tails.n AND cp.s = tails.s""")
def q_spearman_small_strata(inp):
    return T.spearman_small_strata(inp)


@register("category_order_by_file", """
WITH f AS (
  SELECT c_mktsegment, min(p) AS first_position
  FROM (SELECT c_mktsegment, row_number() OVER () - 1 AS p FROM customer) GROUP BY 1)
SELECT c_mktsegment, first_position, row_number() OVER (ORDER BY first_position) AS level,
       row_number() OVER (ORDER BY first_position DESC) AS level_rev
FROM f""")
def q_category_order_by_file(inp):
    return T.category_order_by_file(inp)


@register("preview_by_file", """
SELECT p_partkey, p_brand, p_size, row_index
FROM (SELECT *, row_number() OVER () - 1 AS row_index FROM part) WHERE row_index < 6""")
def q_preview_by_file(inp):
    return T.preview_by_file(inp)


@register("study_distributions", " UNION ALL ".join(
    f"SELECT {sq(name)} AS name, {group} AS cohort, detected, n, prop FROM ({ORACLES[name]})"
    for name, group in (("fig3a_distribution", "group5"), ("fig3b_distribution", "group5"),
                        ("regrouped_fig3a_distribution", "group5b"),
                        ("regrouped_fig3b_distribution", "group5b"))))
def q_study_distributions(inp):
    return batch.distributions(inp.spark, inp)
