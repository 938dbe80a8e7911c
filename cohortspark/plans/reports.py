"""Named result tables: the data behind each figure and table of the study.

Each function takes an input (:class:`Inputs` for the test tables,
:class:`StudyInputs` for assay data) and parameters such as the group column,
and returns a lazy DataFrame: no job runs while it is built.  Cutoff, floors
and panels are the input's ``parameters``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.labels import (ANALYTE_LOCALIZED_NAMES, BIN_HIGH, BIN_LOW,
                                COHORT_GERMAN_LABELS, COHORT_PLOT_LABELS, CONTROLS,
                                DETECTION_BINS, EXPOSED_SERONEGATIVE, NEGATIVE,
                                PCR_SERONEGATIVE, PCR_SEROPOSITIVE, POSITIVE, SEROPOSITIVE3)
from ..operators import cohort as K
from ..operators import stats as S
from ..operators import summary as M
from ..operators.joins import semi_join
from .context import Tables, r6


# ------------------------------------------------------------ Figure 3 -----

def detection_table(inp: Tables, group: str = "group5", panel: Sequence[str] | None = None,
                    cutoff: float | None = None, labels=COHORT_PLOT_LABELS,
                    mapping=None, with_sizes: bool = True) -> DataFrame:
    """% of complete-case subjects by number of detected analytes (Fig. 3A/3B
    tables): (group, detected, n, prop[, n_ind, detected_level, group_label])."""
    panel = inp.parameters.panel3 if panel is None else panel
    cutoff = inp.parameters.cutoff if cutoff is None else cutoff
    panel_df = inp.panel(group, panel, cutoff, mapping=mapping)
    dist = K.percent_of_group(K.distribution(panel_df, group, "detected"), group,
                              total="n_ind" if with_sizes else None)
    dist = dist.withColumn("prop", r6("prop"))
    if not with_sizes:
        return dist
    # the complete-case cohort size (the study's separately computed n.ind,
    # joined back by group) is the group total of this distribution: it comes
    # out of the same small window, with no second scan and no join
    out = dist
    return (out.withColumn("detected_level", F.col("detected").cast("string"))
            .withColumn("group_label", C.size_label(C.relabel(group, labels), "n_ind", " ")))


def fig3a_distribution(inp: Tables, group: str = "group5") -> DataFrame:
    return detection_table(inp, group)


def fig3a_localized(inp: Tables) -> DataFrame:
    return detection_table(inp, "group5", inp.parameters.panel3_localized, labels=COHORT_GERMAN_LABELS,
                           mapping=ANALYTE_LOCALIZED_NAMES)


def fig3b_distribution(inp: Tables, group: str = "group5") -> DataFrame:
    return detection_table(inp, group, inp.parameters.panel4, with_sizes=False)


def fig3b_strip(inp: Tables, group: str = "group5") -> DataFrame:
    """Per complete subject: detected count, cohort size, facet label and the
    subject's position in its facet ordered by count (Fig. 3B strip)."""
    per = inp.panel(group, inp.parameters.panel4, inp.parameters.cutoff, detected="n")
    out = M.rank_strip(per, group, "n", "lab_id", size="n_ind")
    return out.select(*per.columns, "position", "n_ind", C.size_label(
        C.relabel(group, COHORT_PLOT_LABELS), "n_ind", " ").alias("group_label"))


def contingency(inp: Tables, group: str = "group5",
                groups: Sequence[str] = (CONTROLS, EXPOSED_SERONEGATIVE)) -> DataFrame:
    """Subjects per group x detection bin, no complete-case step (E11):
    (group, less_than_2, more_than_2)."""
    per = inp.detected_any(group, inp.parameters.panel4, inp.parameters.cutoff)
    dist = K.distribution(per, group, "detected").filter(F.col(group).isin(list(groups)))
    binned = K.binned_sums(dist, group, "detected", DETECTION_BINS, name="n2")
    return binned.groupBy(group).agg(
        F.max(F.when(F.col("detected_bin") == BIN_LOW, F.col("n2"))).alias("less_than_2"),
        F.max(F.when(F.col("detected_bin") == BIN_HIGH, F.col("n2"))).alias("more_than_2"))


def chi_square(inp: Tables, group: str = "group5",
               groups: Sequence[str] = (CONTROLS, EXPOSED_SERONEGATIVE),
               with_p: bool = False) -> DataFrame:
    """Yates chi-square of the 2x2 contingency table (rows = groups)."""
    g1, g2 = groups
    t = contingency(inp, group, groups)
    cell = lambda g, c: F.coalesce(F.max(F.when(F.col(group) == g, F.col(c))), F.lit(0)).cast("bigint")
    row = t.agg(cell(g1, "less_than_2").alias("a"), cell(g1, "more_than_2").alias("b"),
                cell(g2, "less_than_2").alias("c"), cell(g2, "more_than_2").alias("d"))
    out = S.chi_square_yates(row, "a", "b", "c", "d")
    out = out.select("a", "b", "c", "d", (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("n"),
                     "chi2", "df")
    if with_p:
        out = S.add_chi2_pvalue(out).withColumn("p", r6("p"))
    return out.withColumn("chi2", r6("chi2"))


def status_in_cohort(inp: Tables, group: str = "group5",
                     cohort: str | None = PCR_SERONEGATIVE) -> DataFrame:
    """Serostatus (titre 2) counts among complete-case subjects of one cohort
    (semi join back to the subject table)."""
    per = inp.panel(group, inp.parameters.panel4, inp.parameters.cutoff)
    if cohort is not None:
        per = per.filter(F.col(group) == cohort)
    subj = semi_join(inp.subject(), per, ["lab_id"])
    return M.count_by(subj, ["sero_igg"])


# ------------------------------------------------------------ Figure 2 -----

def _floored(inp: Tables, groups: Sequence[str] | None) -> DataFrame:
    """Panel values with zeros at the plot floor, of some cohorts or all rows."""
    a = inp.assay().filter(F.col("antigen").isin(list(inp.parameters.panel4)))
    if groups is not None:
        a = a.filter(F.col("group5").isin(list(groups)))
    return (a.withColumn("raw_value", F.col("value"))
            .withColumn("value", C.floor_zeros("value", inp.parameters.plot_floor))
            .filter(F.col("value").isNotNull()))


def zero_split_table(inp: Tables, groups: Sequence[str] | None) -> DataFrame:
    """Counts behind Fig. 2A/2C: (antigen, group_label, zero, n, n_ind); the
    panel's size is the sum of its two counts."""
    s = _floored(inp, groups).withColumn(
        "group_label", C.relabel("group5", COHORT_PLOT_LABELS))
    return M.with_group_total(M.zero_counts(s, ["antigen", "group_label"], "raw_value"),
                              ["antigen", "group_label"], "n", "n_ind")


def fig2a_counts(inp: Tables) -> DataFrame:
    return zero_split_table(inp, [CONTROLS, PCR_SEROPOSITIVE])


def fig2c_counts(inp: Tables) -> DataFrame:
    return zero_split_table(inp, None)


def fig2_medians(inp: Tables, groups: Sequence[str] | None = (CONTROLS, PCR_SEROPOSITIVE),
                 by_group: bool = True) -> DataFrame:
    """Medians drawn on the log2 axis of Fig. 2A (per analyte x cohort),
    2B (per analyte over the three seropositive/PCR+ cohorts) and 2C (per
    analyte x cohort, all cohorts; subjects without a cohort are not drawn)."""
    s = _floored(inp, list(groups) if groups else None)
    if groups is None:
        s = s.filter(F.col("group5").isNotNull())
    keys = ["antigen", "group5"] if by_group else ["antigen"]
    m = M.median_log2(s, keys, "value")
    return m.select(*keys, r6("median").alias("median"))


def analyte_sizes(inp: Tables) -> DataFrame:
    """Fig. 2B x-axis: (antigen, zero, n, n_ind, antigen_label)."""
    s = _floored(inp, SEROPOSITIVE3)
    out = M.with_group_total(M.zero_counts(s, ["antigen"], "raw_value"), ["antigen"], "n",
                             "n_ind")
    return out.withColumn("antigen_label", C.size_label("antigen", "n_ind", ""))


def median_by_analyte(inp: Tables) -> DataFrame:
    s = _floored(inp, SEROPOSITIVE3)
    m = M.median_exact(s, ["antigen"], "value")
    return m.select("antigen", r6("median").alias("median"))


def signed_rank_pairs(inp: Tables, with_p: bool = False,
                      pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Paired signed-rank test of every analyte pair (Fig. 2B), or of the named
    ``pairs`` alone, on log2 of values with zeros at the test floor.  With p-values, the pairs are named as
    on the figure's axis ("M\n(n=123)"), from one table of analyte sizes."""
    panel = inp.parameters.panel4
    pairs = S.all_pairs(panel) if pairs is None else pairs
    a = inp.assay().filter(F.col("group5").isin(SEROPOSITIVE3)
                           & F.col("antigen").isin(sorted({x for p in pairs for x in p})))
    a = a.withColumn("lv", F.log2(C.floor_zeros("value", inp.parameters.test_floor)))
    out = S.signed_rank(S.paired_differences(a, "lab_id", "antigen", "lv", pairs))
    if not with_p:
        return out.select("group1", "group2", "n", r6("statistic").alias("statistic"),
                          r6("z").alias("z"))
    # as many tests as the panel has pairs
    out = S.add_rank_pvalue(out, n1="n", n2=None, few=True)
    out = S.add_significance(S.bonferroni(out, "p", few=True), "p_adj", "p_adj_signif")
    # all labels in one row of a map: both names of a pair are looked up in it
    sizes = a.filter(F.col("value").isNotNull()).groupBy("antigen").agg(F.count("*").alias("n_ind"))
    labels = sizes.agg(F.map_from_entries(F.collect_list(F.struct(
        "antigen", C.size_label("antigen", "n_ind", ""))))).scalar()
    out = out.withColumn("__labels", labels)
    return out.select(
        "group1", "group2", *(F.try_element_at("__labels", F.col(g)).alias(f"{g}_label")
                              for g in ("group1", "group2")), "n", "zeros",
        r6("statistic").alias("statistic"), r6("z").alias("z"), "exact", r6("p").alias("p"),
        r6("p_adj").alias("p_adj"), "p_adj_signif")


# ------------------------------------------------------------ Figure 4 -----

def _log_titre_points(inp: Tables, titre: str) -> DataFrame:
    a = inp.assay().filter(F.col("group5").isin(SEROPOSITIVE3)
                           & F.col("antigen").isin(list(inp.parameters.panel4)))
    x = C.to_number("igg_raw") if titre == "igg" else F.col(titre)
    return a.select("antigen", "group5", C.safe_log2(x).alias("lx"),
                    C.safe_log2(C.floor_zeros("value", inp.parameters.test_floor)).alias("ly"))


def pearson_log_log(inp: Tables, titre: str = "roche") -> DataFrame:
    pts = _log_titre_points(inp, titre)
    return S.pearson(pts, ["antigen"], "lx", "ly").select("antigen", "n", r6("r").alias("r"))


def regression_log_log(inp: Tables, titre: str = "roche") -> DataFrame:
    f = S.fit_line(_log_titre_points(inp, titre), ["antigen"], "lx", "ly")
    return f.select("antigen", "n", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


def fig4a_correlation(inp: Tables, titre: str = "roche") -> DataFrame:
    line = S.linear_association(_log_titre_points(inp, titre), ["antigen"], "lx", "ly")
    out = S.stat_label(S.add_correlation_pvalue(line, "r"), "r", "p", "R")
    return out.select("antigen", "n", r6("r").alias("r"), r6("p").alias("p"),
                      r6("slope").alias("slope"), r6("intercept").alias("intercept"), "label")


def detected_with_titre(inp: Tables, group: str, groups: Sequence[str], titre: str) -> DataFrame:
    """Complete-case (4 analytes) subjects with their detected count and a
    titre: the points of Fig. 4B/4C."""
    a = inp.assay()
    per = K.subject_panel(a, "lab_id", group, "antigen", "value", inp.parameters.panel4,
                          inp.parameters.cutoff, detected="n")
    per = per.filter(F.col(group).isin(list(groups)))
    t = inp.titres().select("lab_id", F.col(titre).alias("titre"))
    out = per.join(t, "lab_id", "left")
    # the titre is drawn on a log2 axis: non-positive titres are not drawn
    return out.filter(F.col("titre") > 0).withColumn("x", F.col("n").cast("double"))


def spearman_table(inp: Tables, group: str = "group5", groups=SEROPOSITIVE3,
                   titre: str = "roche", pooled: bool = False) -> DataFrame:
    pts = detected_with_titre(inp, group, groups, titre)
    keys = [] if pooled else [group]
    out = S.spearman(pts.select(group, "x", "titre"), keys, "x", "titre",
                     levels=range(len(inp.parameters.panel4) + 1))
    return out.select(*keys, "n", r6("rho").alias("rho"))


def fig4b_spearman(inp: Tables, group: str = "group5", groups=SEROPOSITIVE3,
                   titre: str = "roche") -> DataFrame:
    pts = detected_with_titre(inp, group, groups, titre).select(group, "x", "titre")
    # per-group and pooled coefficients in one ranking pass: every point stands
    # in its group and in one more stratum (scope 'all', group NULL)
    both = pts.select(F.explode(F.array(
        F.struct(F.lit("group").alias("scope"), F.col(group).alias("group")),
        F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("group")))).alias("s"),
        "x", "titre").select("s.scope", "s.group", "x", "titre")
    out = S.spearman(both, ["scope", "group"], "x", "titre",
                     levels=range(len(inp.parameters.panel4) + 1))
    out = out.withColumn("group", F.coalesce("group", F.lit("all"))).drop("scope")
    out = S.stat_label(S.add_spearman_pvalue(out), "rho", "p", "rho")
    return out.select("group", "n", r6("rho").alias("rho"), r6("p").alias("p"), "label")


# ----------------------------------------------------------- Figure S1 -----

def rank_sum_points(inp: Tables) -> DataFrame:
    """Rows of Fig. S1: PCR+ Seronegative, 4 analytes, titre 2 present,
    zeros floored at 0.01."""
    a = inp.assay().filter((F.col("group5") == PCR_SERONEGATIVE) & F.col("antigen").isin(list(inp.parameters.panel4)))
    a = a.withColumn("igg", C.to_number("igg_raw")).filter(F.col("igg").isNotNull())
    return a.select("lab_id", "sero_igg", "igg", "antigen",
                    C.floor_zeros("value", inp.parameters.plot_floor).alias("value"))


def rank_sum_by_stratum(inp: Tables, with_p: bool = False) -> DataFrame:
    t = S.rank_sum(rank_sum_points(inp), ["antigen"], "sero_igg", "value", (NEGATIVE, POSITIVE))
    if with_p:
        t = S.add_rank_pvalue(t, few=True)  # a test per analyte of the panel
        t = S.add_significance(t, "p", "p_signif")
        t = S.bonferroni(t, "p", few=True)
        t = S.add_significance(t, "p_adj", "p_adj_signif")
        return t.select("antigen", "group1", "group2", "n1", "n2",
                        r6("statistic").alias("statistic"), r6("z").alias("z"), "exact",
                        r6("p").alias("p"), "p_signif", r6("p_adj").alias("p_adj"), "p_adj_signif")
    return t.select("antigen", "group1", "group2", "n1", "n2",
                    r6("statistic").alias("statistic"), r6("z").alias("z"))


def n_per_panel(inp: Tables) -> DataFrame:
    return M.n_per_panel(rank_sum_points(inp), ["antigen", "sero_igg"], "value")


# ------------------------------------------------------------- kinetics ----

def kinetics_points(inp: Tables) -> DataFrame:
    a = inp.assay().filter(F.col("antigen").isin(list(inp.parameters.panel4)) & F.col("group5").isNotNull()
                           & (F.col("group3") == "PCR+"))
    a = a.withColumn("value", C.floor_zeros("value", inp.parameters.test_floor)) \
        .withColumn("days", C.days_between("visit_date", "test_date"))
    return a.filter(F.col("days") > 100).select(
        "lab_id", "antigen", "group5", "days", "value",
        r6(C.safe_log2("value")).alias("log2_value"))


def regression_kinetics(inp: Tables) -> DataFrame:
    a = inp.assay().filter(F.col("antigen").isin(list(inp.parameters.panel4)) & F.col("group5").isNotNull()
                           & (F.col("group3") == "PCR+"))
    a = a.withColumn("ly", C.safe_log2(C.floor_zeros("value", inp.parameters.test_floor))) \
        .withColumn("days", C.days_between("visit_date", "test_date").cast("double"))
    f = S.fit_line(a.filter(F.col("days") > 100), ["antigen"], "days", "ly")
    return f.select("antigen", "n", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


def fig3_detection_tables(inp: Tables, group: str = "group5") -> DataFrame:
    """Both Figure 3 tables (3 and 4 analytes) from ONE per-subject
    aggregation: the summary carries each panel's completeness and count, so
    the assay table is scanned and shuffled once for both distributions."""
    from pyspark.sql import Window
    summ = K.subject_summary(inp.assay(), "lab_id", group, "antigen", "value",
                             {"k3": inp.parameters.panel3, "k4": inp.parameters.panel4},
                             inp.parameters.cutoff)
    per = summ.select(group, F.explode(F.array(
        F.struct(F.lit("k3").alias("panel"), F.col("detected_k3").alias("detected")),
        F.struct(F.lit("k4").alias("panel"), F.col("detected_k4").alias("detected")))).alias("__p")) \
        .select(group, "__p.panel", "__p.detected").filter(F.col("detected").isNotNull())
    dist = per.groupBy("panel", group, "detected").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("panel", group)  # a distribution table: tiny
    return (dist.withColumn("n_ind", F.sum("n").over(w))
            .withColumn("prop", r6(F.col("n") / F.col("n_ind") * F.lit(100.0))))
