"""One small query per operator of the inventory (scalar, filter, reshape,
join, aggregate, window and ordering operators), each run over the whole
assay tables so its work grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.labels import (ANALYTE_LOCALIZED_NAMES, ANALYTE_SHORT_NAMES,
                                COHORT_PLOT_LABELS, COHORT_RULES, DETECTION_BINS, SEROPOSITIVE3)
from ..operators import cohort as K
from ..operators import reshape as H
from ..operators import stats as S
from ..operators import summary as M
from ..operators.joins import rename_checked
from ..operators.ranks import mid_ranks
from ..sources import fixture, io
from ..sources.fixture import LINE_TO_RAW_LABEL, _map_int
from .context import Inputs, r6
from .reports import rank_sum_points

ANALYTES6 = list(ANALYTE_SHORT_NAMES.values())
RAW6 = list(ANALYTE_SHORT_NAMES.keys())


# ------------------------------------------------------ sources, A ---------

def preview(inp: Inputs, n: int = 6) -> DataFrame:
    """First rows of the subject table by key (``head``)."""
    s = inp.subject().withColumn("igg", C.to_number("igg_raw")).drop("igg_raw")
    return s.orderBy("lab_id").limit(n)


def wide_to_long(inp: Inputs) -> DataFrame:
    wide = H.spread(inp.assay_long().filter(F.col("antigen").isNotNull()),
                    ["lab_id"], "antigen", "value", ANALYTES6)
    return H.gather(wide, ["lab_id"], ANALYTES6, "antigen", "value")


# ------------------------------------------------------ projections, B -----

def rename_analytes(inp: Inputs) -> DataFrame:
    raw = inp.assay_raw()
    wide = H.spread(raw.filter(F.col("antigen_raw").isin(RAW6)), ["lab_id"],
                    "antigen_raw", "value", RAW6)
    return rename_checked(wide, ANALYTE_SHORT_NAMES)


def recode_antigen(inp: Inputs, localized: bool = False) -> DataFrame:
    mapping = ANALYTE_LOCALIZED_NAMES if localized else ANALYTE_SHORT_NAMES
    return inp.assay_raw().select("lab_id", "antigen_raw",
                                  C.recode("antigen_raw", mapping).alias("antigen"))


def combined_status(inp: Inputs) -> DataFrame:
    return inp.subject().select("lab_id", "sero_roche", "sero_igg",
                                C.combine_status("sero_roche", "sero_igg").alias("sero_combined"))


def regroup_cohort(inp: Inputs) -> DataFrame:
    s = inp.subject().withColumn("sero_combined", C.combine_status("sero_roche", "sero_igg"))
    return s.select("lab_id", "group3", "sero_combined",
                    C.assign_cohort("group3", "sero_combined", COHORT_RULES).alias("group5b"))


def binned_detection(inp: Inputs) -> DataFrame:
    per = K.detected_any(inp.assay(), "lab_id", "group5", "antigen", "value", inp.parameters.panel4,
                         inp.parameters.cutoff)
    return K.binned_sums(K.distribution(per, "group5", "detected"), "group5", "detected",
                         DETECTION_BINS, name="n2")


def floor_zeros(inp: Inputs) -> DataFrame:
    a = inp.assay_long()
    return a.select("lab_id", "antigen", "value",
                    C.floor_zeros("value", inp.parameters.plot_floor).alias("value_plot"),
                    C.floor_zeros("value", inp.parameters.test_floor).alias("value_test"))


def threshold_flag(inp: Inputs) -> DataFrame:
    return inp.assay_long().select("lab_id", "antigen", "value",
                                   C.flag_above("value", inp.parameters.cutoff).alias("flag"))


def threshold_label(inp: Inputs) -> DataFrame:
    return inp.assay_long().select("lab_id", "antigen",
                                   C.label_above("value", inp.parameters.cutoff).alias("label"))


def zero_split(inp: Inputs) -> DataFrame:
    a = inp.assay_long().filter(F.col("antigen").isNotNull() & F.col("value").isNotNull())
    return M.zero_counts(a, ["antigen"], "value")


def complete_case(inp: Inputs) -> DataFrame:
    a = inp.assay().filter(F.col("group5").isNotNull() & F.col("antigen").isin(list(inp.parameters.panel4)))
    wide = H.spread(a, ["lab_id", "group5"], "antigen", "value", inp.parameters.panel4)
    missing = None
    for c in inp.parameters.panel4:
        m = F.col(c).isNull()
        missing = m if missing is None else missing | m
    return wide.withColumn("complete", F.when(missing, F.lit("remove")).otherwise(F.lit("keep")))


def text_to_number(inp: Inputs) -> DataFrame:
    return inp.subject().select("lab_id", C.to_number("igg_raw").alias("igg"))


def cohort_label(inp: Inputs) -> DataFrame:
    sizes = K.cohort_sizes(inp.assay(), "lab_id", "group5", "antigen", "value", inp.parameters.panel3)
    return sizes.withColumn("group_label",
                            C.size_label(C.relabel("group5", COHORT_PLOT_LABELS), "n_ind", " "))


def log2_values(inp: Inputs) -> DataFrame:
    a = inp.assay_long()
    return a.select("lab_id", "antigen",
                    r6(C.safe_log2(C.floor_zeros("value", inp.parameters.test_floor))).alias("log2_value"))


def days_since_test(inp: Inputs) -> DataFrame:
    a = inp.assay()
    return a.select("lab_id", "antigen", C.days_between("visit_date", "test_date").alias("days"))


def detected_count_zero_filled(inp: Inputs) -> DataFrame:
    return K.detected_zero_filled(inp.assay(), "lab_id", "group5", "antigen", "value",
                                  inp.parameters.panel4, inp.parameters.cutoff)


def percent_of_group(inp: Inputs) -> DataFrame:
    per = K.detected_any(inp.assay(), "lab_id", "group5", "antigen", "value", inp.parameters.panel4,
                         inp.parameters.cutoff)
    dist = K.percent_of_group(K.distribution(per, "group5", "detected"), "group5")
    return dist.withColumn("prop", r6("prop"))


# ------------------------------------------------------ filters, C ---------

def filter_membership(inp: Inputs) -> DataFrame:
    a = inp.assay().filter(F.col("group5").isin(SEROPOSITIVE3) & F.col("antigen").isin(list(inp.parameters.panel4)))
    return a.select("lab_id", "antigen", "group5", "value")


def filter_not_null(inp: Inputs) -> DataFrame:
    a = inp.assay_long()
    return a.filter(F.col("antigen").isNotNull() & F.col("value").isNotNull()) \
        .select("lab_id", "antigen", "value")


# ------------------------------------------------------ joins, D -----------

def attach_cohort_size(inp: Inputs) -> DataFrame:
    """Distribution with group sizes, the NULL group included."""
    a = inp.assay().filter(F.col("antigen").isin(list(inp.parameters.panel4)) & F.col("value").isNotNull())
    per = a.groupBy("lab_id", "group5").agg(
        F.sum(C.flag_above("value", inp.parameters.cutoff)).cast("bigint").alias("detected"))
    return M.with_group_total(K.distribution(per, "group5", "detected"), ["group5"], "n", "n_ind")


def attach_titre(inp: Inputs) -> DataFrame:
    per = detected_count_zero_filled(inp)
    return per.join(inp.titres(), "lab_id", "left")


def paired_analyte_differences(inp: Inputs) -> DataFrame:
    a = inp.assay().filter(F.col("group5").isin(SEROPOSITIVE3) & F.col("antigen").isin(list(inp.parameters.panel4)))
    a = a.withColumn("lv", F.log2(C.floor_zeros("value", inp.parameters.test_floor)))
    p = S.paired_differences(a, "lab_id", "antigen", "lv", S.all_pairs(inp.parameters.panel4))
    return p.select("lab_id", "group1", "group2", r6("d").alias("d"))


# ------------------------------------------------------ aggregates, E ------

def count_by_group(inp: Inputs) -> DataFrame:
    a = inp.assay().filter(F.col("antigen").isNotNull() & F.col("value").isNotNull())
    return M.count_by(a, ["antigen", "group5"])


def detected_per_subject(inp: Inputs) -> DataFrame:
    return K.subject_panel(inp.assay(), "lab_id", "group5", "antigen", "value", inp.parameters.panel3,
                           inp.parameters.cutoff)


def detection_distribution(inp: Inputs) -> DataFrame:
    d = K.distribution(detected_per_subject(inp), "group5", "detected")
    return d.withColumn("detected_level", F.col("detected").cast("string"))


def label_counts(inp: Inputs) -> DataFrame:
    cc = H.complete_cases(inp.assay().filter(F.col("group5").isNotNull()),
                          ["lab_id", "group5"], "antigen", "value", inp.parameters.panel4)
    lab = cc.withColumn("label", C.label_above("value", inp.parameters.cutoff)) \
        .filter(F.col("label").isNotNull())
    return K.label_counts(lab, ["lab_id", "group5"], "label")


def label_counts_wide(inp: Inputs) -> DataFrame:
    return H.spread(label_counts(inp), ["lab_id", "group5"], "label", "n", ["Above", "Below"])


def cohort_size(inp: Inputs, panel) -> DataFrame:
    return K.cohort_sizes(inp.assay(), "lab_id", "group5", "antigen", "value", panel)


# ------------------------------------------------------ windows, G ---------

def subject_rank_strip(inp: Inputs) -> DataFrame:
    per = detected_per_subject(inp)
    return M.rank_strip(per, "group5", "detected", "lab_id")


def mid_rank(inp: Inputs) -> DataFrame:
    pts = rank_sum_points(inp).select("lab_id", "antigen", "value")
    return mid_ranks(pts, ["antigen"], "value")


# ------------------------------------------------------ ordering, F --------

def category_order(inp: Inputs) -> DataFrame:
    """Analytes in the order of their first row (subject, then line), forward
    and reversed."""
    li = inp.table("lineitem").select(
        F.col("l_orderkey").alias("lab_id"), "l_linenumber",
        C.recode(_map_int("l_linenumber", LINE_TO_RAW_LABEL), ANALYTE_SHORT_NAMES)
        .alias("antigen")).filter(F.col("antigen").isNotNull())
    place = ["lab_id", "l_linenumber"]
    back = M.category_order(li, "antigen", place, reverse=True, name="level_rev")
    return M.category_order(li, "antigen", place).join(
        back.drop("first_position"), "antigen")


def category_order_by_file(inp: Inputs) -> DataFrame:
    """Market segments in the order of their first row in the data, forward and
    reversed: the place is the row's own, not a key's."""
    rows = io.read_positioned(inp.spark, f"{inp.sf_dir.rstrip('/')}/customer.parquet",
                              "c_mktsegment string")
    place = dict(category="c_mktsegment", position=["file_path", "row_index"],
                 slice_by="row_index")
    back = M.category_order(rows, **place, reverse=True, name="level_rev")
    return M.category_order(rows, **place).join(back.drop("first_position"), "c_mktsegment")


def preview_by_file(inp: Inputs, n: int = 6) -> DataFrame:
    """The first rows of the parts as they stand in the data (``head``)."""
    rows = io.read_positioned(inp.spark, f"{inp.sf_dir.rstrip('/')}/part.parquet",
                              "p_partkey long, p_brand string, p_size int")
    return rows.orderBy("file_path", "row_index").limit(n).drop("file_path")


def category_pairs(inp: Inputs) -> DataFrame:
    return S.category_pairs(inp.assay_long(), "antigen", inp.parameters.panel4)


# ------------------------------------------------------ reshape, H ---------

def spread_analytes(inp: Inputs) -> DataFrame:
    a = inp.assay().filter(F.col("group5").isNotNull() & F.col("antigen").isin(list(inp.parameters.panel4)))
    return H.spread(a, ["lab_id", "group5"], "antigen", "value", inp.parameters.panel4)


def spread_duplicates(inp: Inputs) -> DataFrame:
    """(subject, raw label) keys that occur more than once in the raw rows:
    what the duplicate guard of ``spread`` would reject.  Counted on the
    integer line number, labelled afterwards."""
    li = inp.table("lineitem").select(F.col("l_orderkey").alias("lab_id"), "l_linenumber")
    dup = H.duplicate_keys(li, ["lab_id", "l_linenumber"])
    return dup.select("lab_id", _map_int("l_linenumber", LINE_TO_RAW_LABEL)
                      .alias("antigen_raw"), "n")


def gather_analytes(inp: Inputs) -> DataFrame:
    return H.gather(spread_analytes(inp), ["lab_id", "group5"], inp.parameters.panel4, "antigen", "value")


def complete_case_long(inp: Inputs) -> DataFrame:
    a = inp.assay().filter(F.col("group5").isNotNull())
    return H.complete_cases(a, ["lab_id", "group5"], "antigen", "value", inp.parameters.panel4)


# ------------------------------------------------------ tests at scale -----

def chi_square_labels(inp: Inputs, with_p: bool = False) -> DataFrame:
    lab = inp.table("labels")
    cnt = lambda q, t: F.count(F.when((F.col("quality") == q) & (F.col("toxic") == t),
                                      F.lit(1))).alias(f"c{q}{t}")
    row = lab.agg(cnt(0, 0), cnt(0, 1), cnt(1, 0), cnt(1, 1))
    out = S.chi_square_yates(row, "c00", "c01", "c10", "c11")
    out = out.select(F.col("c00").alias("a"), F.col("c01").alias("b"), F.col("c10").alias("c"),
                     F.col("c11").alias("d"),
                     (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")).alias("n"),
                     "chi2", "df")
    if with_p:
        out = S.add_chi2_pvalue(out).withColumn("p", r6("p"))
    return out.withColumn("chi2", r6("chi2"))


def rank_sum_events(inp: Inputs, with_p: bool = False) -> DataFrame:
    ev = inp.table("events").withColumn(
        "half", F.when(F.col("user_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")))
    t = S.rank_sum(ev, ["event_type"], "half", "value", ("even", "odd"))
    if with_p:
        t = S.add_rank_pvalue(t)
        t = S.bonferroni(t, "p")  # event types come from the data: no window over all
        t = S.add_significance(t, "p_adj", "p_adj_signif")
        return t.select("event_type", "group1", "group2", "n1", "n2",
                        r6("statistic").alias("statistic"), r6("z").alias("z"), "exact",
                        r6("p").alias("p"), r6("p_adj").alias("p_adj"), "p_adj_signif")
    return t.select("event_type", "group1", "group2", "n1", "n2",
                    r6("statistic").alias("statistic"), r6("z").alias("z"))


def subject_summary(inp: Inputs) -> DataFrame:
    """Per-subject table behind Figures 3A/3B/4B."""
    return K.subject_summary(inp.assay(), "lab_id", "group5", "antigen", "value",
                             {"k3": inp.parameters.panel3, "k4": inp.parameters.panel4}, inp.parameters.cutoff,
                             names={"NC": "nc", "M": "m", "SCT": "sct", "SNT": "snt"})


def nan_as_missing(inp: Inputs) -> DataFrame:
    """Some values of the test table are NaN before they are taken in: they are
    missing in counts, flags, labels and the per-subject panel."""
    li = fixture.scan(inp.spark, inp.sf_dir, "lineitem")
    li = io.nan_to_null(li.withColumn("l_extendedprice", F.when(
        F.col("l_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))))
    a = fixture.assay_raw_of(li).select(
        "lab_id", C.recode("antigen_raw", ANALYTE_SHORT_NAMES).alias("antigen"), "value")
    cutoff = inp.parameters.cutoff
    return a.filter(F.col("antigen").isNotNull()).groupBy("antigen").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n"),
        F.count(C.flag_above("value", cutoff)).alias("n_flagged"),
        F.count(F.when(C.label_above("value", cutoff) == "Above", 1)).alias("n_above"),
        r6(F.max("value")).alias("largest"))


def rank_sum_small_strata(inp: Inputs) -> DataFrame:
    """Rank-sum test of order values between two order states for every
    customer: many small samples, mostly without ties, so p is exact."""
    t = S.rank_sum(inp.table("orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ("F", "O"))
    t = S.add_rank_pvalue(t)  # sizes that occur are counted once each
    return t.select("o_custkey", "n1", "n2", "statistic", "exact", r6("p").alias("p"))


def spearman_small_strata(inp: Inputs) -> DataFrame:
    """Rank correlation of an order's value with its date for every customer:
    many small samples, mostly without ties, so p comes from counted orders."""
    orders = inp.table("orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01")))
    t = S.add_spearman_pvalue(S.spearman(orders, ["o_custkey"], "o_totalprice", "day"))
    return t.select("o_custkey", "n", r6("rho").alias("rho"), "tied", r6("p").alias("p"))
