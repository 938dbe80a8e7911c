"""Statistical tests and associations.

Design: everything heavy (pairing, ranking, sums of ranks, tie sizes) is
DataFrame work that ends in **one row per test**; only that row goes on to
the p-value (:mod:`cohortspark.functions.pvalues`).

Rank tests follow the usual definitions (R's ``wilcox.test``):

* signed-rank: differences d = x - y per subject, zeros dropped, mid-ranks of
  |d|, V = sum of ranks with d > 0; normal approximation with tie term
  sum(t^3 - t)/48 and continuity 0.5; exact when n < 50 without ties/zeros.
* rank-sum: W = rank sum of the first sample - n1(n1+1)/2; normal
  approximation with tie term and continuity 0.5; exact when both samples
  are below 50 and there are no ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import pvalues as P
from .joins import join_null_safe
from .ranks import ranked_histogram
from .reshape import spread_columns


# ------------------------------------------------------------ pairing (D4) --

def paired_differences(df: DataFrame, id_col: str, key: str, value: str,
                       pairs: Sequence[tuple[str, str]],
                       out: str = "d") -> DataFrame:
    """(id, group1, group2, x, y, d) for every subject and requested pair of
    keys where both values exist.  One aggregation by subject, then one
    narrow explode of the pairs (no self-join)."""
    keys = sorted({k for p in pairs for k in p})
    cols = {k: f"__v{i}" for i, k in enumerate(keys)}
    wide = (df.filter(F.col(key).isin(keys))
            .groupBy(id_col).agg(*spread_columns(key, value, keys, [cols[k] for k in keys])))
    structs = [F.struct(F.lit(a).alias("group1"), F.lit(b).alias("group2"),
                        F.col(cols[a]).alias("x"), F.col(cols[b]).alias("y"))
               for a, b in pairs]
    long = wide.select(id_col, F.explode(F.array(*structs)).alias("__p"))
    return (long.select(id_col, "__p.group1", "__p.group2", "__p.x", "__p.y")
            .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
            .withColumn(out, F.col("x") - F.col("y")))


def all_pairs(categories: Sequence[str]) -> list[tuple[str, str]]:
    """Unordered pairs (a, b) with a < b, in sorted order."""
    cats = sorted(set(categories))
    return [(a, b) for i, a in enumerate(cats) for b in cats[i + 1:]]


def category_pairs(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """All unordered pairs of the categories present in ``col`` (I10).

    The categories are limited to ``allowed`` (a parameter list), so the set
    gathered into one row is bounded by the parameter, not by the data."""
    cats = (df.filter(F.col(col).isin(list(allowed)))
            .agg(F.sort_array(F.collect_set(col)).alias("c")))
    pairs = F.expr("flatten(transform(sequence(0, size(c) - 1), i -> "
                   "transform(slice(c, i + 2, size(c)), b -> named_struct('group1', c[i], 'group2', b))))")
    return (cats.filter(F.size("c") >= 2)
            .select(F.explode(pairs).alias("p")).select("p.group1", "p.group2"))


# ------------------------------------------------------- signed rank (I1) --

def signed_rank(pairs_df: DataFrame, strata: Sequence[str] = ("group1", "group2"),
                d: str = "d") -> DataFrame:
    """One row per stratum: n, statistic (V), z, exact flag, ties, zeros."""
    strata = list(strata)
    src = pairs_df.filter(F.col(d).isNotNull()).withColumn("__abs", F.abs(F.col(d)))
    ranked = ranked_histogram(src, strata, "__abs",
                              counts={"c_pos": F.col(d) > 0})
    nz = F.col("__abs") > 0
    agg = ranked.groupBy(*strata).agg(
        F.sum(F.when(nz, F.col("c")).otherwise(F.lit(0))).alias("n"),
        F.sum(F.when(~nz, F.col("c")).otherwise(F.lit(0))).alias("zeros"),
        F.sum(F.col("c_pos") * F.col("mid_rank")).alias("__rpos"),
        F.sum("c_pos").alias("__npos"),
        F.sum(F.when(nz, F.pow(F.col("c").cast("double"), 3) - F.col("c"))
              .otherwise(F.lit(0.0))).alias("ties"))
    n = F.col("n").cast("double")
    v = F.col("__rpos") - F.col("zeros") * F.col("__npos")
    centre = F.col("statistic") - n * (n + 1) / 4.0
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    # no non-zero difference (or all tied): z is undefined -> NULL, not an error
    out = (agg.withColumn("statistic", v.cast("double"))
           .withColumn("z", F.try_divide(centre - F.signum(centre) * 0.5, sigma))
           .withColumn("exact", (F.col("n") < 50) & (F.col("ties") == 0) & (F.col("zeros") == 0)))
    return out.select(*strata, F.col("n").cast("bigint").alias("n"), "statistic", "z",
                      "exact", F.col("ties").cast("double").alias("ties"),
                      F.col("zeros").cast("bigint").alias("zeros"))


# ---------------------------------------------------------- rank sum (I2) --

def rank_sum(df: DataFrame, strata: Sequence[str], group: str, value: str,
             levels: tuple[str, str]) -> DataFrame:
    """Two-sample rank-sum test per stratum: (strata, group1, group2, n1, n2,
    statistic (W), z, exact, ties)."""
    strata = list(strata)
    g1, g2 = levels
    src = df.filter(F.col(group).isin([g1, g2]) & F.col(value).isNotNull())
    ranked = ranked_histogram(src, strata, value, counts={"c1": F.col(group) == g1})
    agg = ranked.groupBy(*strata).agg(
        F.sum("c1").alias("n1"), F.sum("c").alias("__n"),
        F.sum(F.col("c1") * F.col("mid_rank")).alias("__r1"),
        F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"))
    n1 = F.col("n1").cast("double")
    n2 = F.col("n2").cast("double")
    nn = n1 + n2
    centre = F.col("statistic") - n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((nn + 1) - F.try_divide(F.col("ties"), nn * (nn - 1))))
    # all values tied, or an empty sample: z is undefined -> NULL
    out = (agg.withColumn("n2", F.col("__n") - F.col("n1"))
           .withColumn("statistic", F.col("__r1") - n1 * (n1 + 1) / 2.0)
           .withColumn("z", F.try_divide(centre - F.signum(centre) * 0.5, sigma))
           .withColumn("exact", (F.col("n1") < 50) & (F.col("n2") < 50) & (F.col("ties") == 0)))
    return out.select(*strata, F.lit(g1).alias("group1"), F.lit(g2).alias("group2"),
                      F.col("n1").cast("bigint").alias("n1"),
                      F.col("n2").cast("bigint").alias("n2"),
                      "statistic", "z", "exact", F.col("ties").cast("double").alias("ties"))


# --------------------------------------------------- p-values, I3, I4 -----

def add_rank_pvalue(tests: DataFrame, n1: str = "n1", n2: str | None = "n2",
                    name: str = "p", few: bool = False) -> DataFrame:
    """Attach the two-sided p of each rank-test row (exact or normal);
    without ``n2`` it is a signed-rank test.  ``few`` tests, whose number a
    parameter sets, are planned once; of many, each pair of sizes is counted
    once."""
    return P.add_rank_test_p(tests, "exact", "statistic", n1, n2, "z", name, few)


def bonferroni(tests: DataFrame, p: str = "p", family: Sequence[str] = (),
               name: str = "p_adj", few: bool = False) -> DataFrame:
    """min(1, p * m), m = number of non-NULL p in the family.

    The family is counted apart and joined back, so that no task holds all
    tests; a family of ``few`` tests, whose number a parameter sets, is counted
    by a window, so that the tests are planned and run once.
    """
    if few:
        counted = tests.withColumn("__m", F.count(p).over(Window.partitionBy(*family)))
    else:
        sizes = tests.groupBy(*family).agg(F.count(p).alias("__m"))
        counted = (join_null_safe(tests, sizes, family, "inner") if family
                   else tests.withColumn("__m", sizes.scalar()))
    # least() skips NULLs: guard so an undefined p stays undefined
    return counted.withColumn(name, F.when(
        F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("__m")))).drop("__m")


def add_significance(tests: DataFrame, p: str = "p", name: str | None = None) -> DataFrame:
    return tests.withColumn(name or f"{p}_signif", C.significance(p))


# ---------------------------------------------------------- chi-square (I5) --

def chi_square_yates(counts: DataFrame, a: str, b: str, c: str, d: str,
                     name: str = "chi2") -> DataFrame:
    """Pearson chi-square with Yates' continuity correction on a 2x2 table
    held as four count columns per row ([[a, b], [c, d]])."""
    A, B, Cc, D = (F.col(x).cast("double") for x in (a, b, c, d))
    n = A + B + Cc + D
    cells = [(A, A + B, A + Cc), (B, A + B, B + D), (Cc, Cc + D, A + Cc), (D, Cc + D, B + D)]
    exp = [(o, F.try_divide(r * s, n)) for o, r, s in cells]
    yates = F.least(F.lit(0.5), *[F.abs(o - e) for o, e in exp])
    stat = None
    for o, e in exp:
        # an empty row or column gives an undefined statistic (NULL)
        term = F.try_divide(F.pow(F.abs(o - e) - yates, 2), e)
        stat = term if stat is None else stat + term
    return counts.withColumn(name, stat).withColumn("df", F.lit(1).cast("bigint"))


def add_chi2_pvalue(df: DataFrame, stat: str = "chi2", name: str = "p") -> DataFrame:
    return P.add_chi2_df1_p(df, stat, name)


# ------------------------------------------------- association (I6-I9) -----

def linear_association(df: DataFrame, keys: Sequence[str], x: str, y: str,
                       name: str = "r") -> DataFrame:
    """(keys..., n, r, slope, intercept) in one aggregation, over rows where
    both x and y are present."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.groupBy(*keys).agg(F.count(F.when(both, F.lit(1))).alias("n"),
                                F.covar_samp(x, y).alias("__cov"),
                                F.var_samp(F.when(both, F.col(x))).alias("__vx"),
                                F.var_samp(F.when(both, F.col(y))).alias("__vy"),
                                F.regr_slope(y, x).alias("slope"),
                                F.regr_intercept(y, x).alias("intercept"))
    # r = cov / (sd_x sd_y); a constant x or y gives NULL (R: NA), no error
    r = F.try_divide(F.col("__cov"), F.sqrt(F.col("__vx") * F.col("__vy")))
    return out.select(*keys, "n", r.alias(name), "slope", "intercept")


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str,
            name: str = "r") -> DataFrame:
    """(keys..., n, r) over rows where both x and y are present."""
    return linear_association(df, keys, x, y, name).drop("slope", "intercept")


def _rho(sums: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys..., n, rho, tied) from n and the sums of products of mid-ranks,
    centred on the mean rank (n + 1) / 2."""
    n = F.col("n").cast("double")
    centre = n * (n + 1) * (n + 1) / 4
    # all ranks tied: undefined, not an error
    rho = F.try_divide(F.col("__xy") - centre,
                       F.sqrt((F.col("__xx") - centre) * (F.col("__yy") - centre)))
    return sums.select(*keys, "n", rho.alias(name), "tied")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "rho",
             levels: Sequence[float] | None = None) -> DataFrame:
    """Spearman's rho per group: Pearson on mid-ranks (ties averaged).

    Returns (keys..., n, rho, tied); ``tied`` says whether any value of x or of
    y stands twice in the group.

    ``levels`` names the few values that x can have (such as a count of
    analytes): then y is ranked once, with the points of each level counted
    beside every value, and the mid-rank of a level follows from the levels'
    totals.  Other values of x are not allowed and raise.

    Without levels the points are first folded to (keys, x, y, number of
    points); everything after works on those weights.  Each variable is ranked
    from the fold and joined back to it once.
    """
    keys = list(keys)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    if levels is not None:
        levels = sorted(float(v) for v in levels)
        known = F.col(x).cast("double").isin(levels)
        pts = df.filter(both).select(*keys, F.when(known, F.col(x).cast("double")).otherwise(
            F.raise_error(F.lit(f"a value of {x} is not among the levels"))).alias("__x"),
            F.col(y).cast("double").alias("__y"))
        ranked = ranked_histogram(pts, keys, "__y", counts={
            f"__c{i}": F.col("__x") == v for i, v in enumerate(levels)})
        c, r = F.col("c"), F.col("mid_rank")
        sums = ranked.groupBy(*keys).agg(
            F.sum(c).alias("n"), F.sum(c * r * r).alias("__yy"), F.max(c).alias("__most"),
            *(F.sum(f"__c{i}").cast("double").alias(f"__n{i}") for i in range(len(levels))),
            *(F.sum(F.col(f"__c{i}") * r).alias(f"__s{i}") for i in range(len(levels))))
        before, xy, xx, most = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("__most")
        for i in range(len(levels)):
            size = F.col(f"__n{i}")
            rank = before + (size + 1) / 2
            xy, xx = xy + rank * F.col(f"__s{i}"), xx + size * rank * rank
            before, most = before + size, F.greatest(most, size)
        return _rho(sums.select(*keys, "n", "__yy", xy.alias("__xy"), xx.alias("__xx"),
                                (most > 1).alias("tied")), keys, name)
    fold = (df.filter(both)
            .select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
            .groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__w")))
    ranks = [ranked_histogram(fold, keys, v, weight="__w")
             .select(*keys, v, F.col("mid_rank").alias(f"__r{v}"), F.col("c").alias(f"__c{v}"))
             for v in ("__x", "__y")]
    j = join_null_safe(join_null_safe(fold, ranks[0], [*keys, "__x"], "inner"),
                       ranks[1], [*keys, "__y"], "inner")
    w, rx, ry = F.col("__w"), F.col("__r__x"), F.col("__r__y")
    return _rho(j.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * rx * ry).alias("__xy"), F.sum(w * rx * rx).alias("__xx"),
        F.sum(w * ry * ry).alias("__yy"),
        (F.max(F.greatest("__c__x", "__c__y")) > 1).alias("tied")), keys, name)


def add_correlation_pvalue(df: DataFrame, r: str, n: str = "n",
                           name: str = "p") -> DataFrame:
    """p from t = r sqrt((n-2)/(1-r^2)), df = n-2 (Pearson)."""
    return P.add_correlation_p(df, r, n, name)


def add_spearman_pvalue(df: DataFrame, rho: str = "rho", n: str = "n", tied: str = "tied",
                        name: str = "p") -> DataFrame:
    """p of Spearman's rho: from the distribution of the sum of squared rank
    differences without ties (below 1,290 points), else from t."""
    return P.add_spearman_p(df, rho, n, tied, name)


def fit_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line y ~ x per group: (keys..., n, slope, intercept)."""
    return df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"),
                                 F.regr_slope(y, x).alias("slope"),
                                 F.regr_intercept(y, x).alias("intercept"))


def _num_text(c, digits: int):
    # R prints round(x, k) without trailing zeros: 0.3, not 0.30
    t = F.format_number(F.round(c, digits), digits)
    t = F.regexp_replace(t, ",", "")
    t = F.regexp_replace(t, r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(t, r"\.$", "")


def stat_label(df: DataFrame, r: str, p: str, coef_name: str = "R",
               r_digits: int = 2, p_digits: int = 3, name: str = "label") -> DataFrame:
    """Correlation label text: 'R = 0.21, p = 0.001' / 'p < 0.001' (I9)."""
    p_floor = 10.0 ** (-p_digits)
    p_txt = F.when(F.col(p) < p_floor, F.lit(f"p < {p_floor:g}")) \
        .otherwise(F.concat(F.lit("p = "), _num_text(F.col(p), p_digits)))
    return df.withColumn(name, F.concat(F.lit(f"{coef_name} = "), _num_text(F.col(r), r_digits),
                                        F.lit(", "), p_txt))


def select_pairs(tests: DataFrame, pairs: Sequence[tuple[str, str]],
                 g1: str = "group1", g2: str = "group2") -> DataFrame:
    """Pick test rows by their (group1, group2) names instead of by position."""
    cond = None
    for a, b in pairs:
        e = (F.col(g1) == a) & (F.col(g2) == b)
        cond = e if cond is None else cond | e
    return tests.filter(cond)
