"""Statistical operators: goldens from FIXTURES.md §3 and textbook values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import pvalues as P
from cohortspark.operators import stats as S

# --- FIXTURES §3.4: Figure S1 pixel rows (smaller row = larger value) -------
S1 = {
    "M": ([272, 314, 347, 400, 421] + [921] * 6, [178, 195, 254, 283, 287, 921], 10, 0.01912),
    "NC": ([300, 334, 386, 402, 409] + [921] * 6, [209, 262, 376, 400, 415, 431], 15, 0.07221),
    "SCT": ([200, 281, 322, 333, 375] + [921] * 6, [233, 256, 262, 313, 316, 921], 15, 0.06838),
    "SNT": ([297, 299, 312, 366] + [921] * 3, [205, 260, 264, 308, 382], 6, 0.07202),
}


def test_rank_sum_golden_figure_s1(spark):
    rows = []
    for ag, (neg, pos, _, _) in S1.items():
        rows += [(ag, "Negative", -float(v)) for v in neg]
        rows += [(ag, "Positive", -float(v)) for v in pos]
    df = spark.createDataFrame(rows, "antigen string, sero string, value double")
    t = S.rank_sum(df, ["antigen"], "sero", "value", ("Negative", "Positive"))
    t = S.add_rank_pvalue(t)
    got = {r.antigen: r for r in t.collect()}
    for ag, (neg, pos, w, p) in S1.items():
        assert got[ag].n1 == len(neg) and got[ag].n2 == len(pos)
        assert got[ag].statistic == w
        assert not got[ag].exact
        assert abs(got[ag].p - p) < 5e-6, (ag, got[ag].p, p)


def test_chi_square_yates_golden(spark):
    df = spark.createDataFrame([(81, 77, 4, 13), (81, 72, 4, 9)], "a long, b long, c long, d long")
    t = S.add_chi2_pvalue(S.chi_square_yates(df, "a", "b", "c", "d")).collect()
    assert abs(t[0].chi2 - 3.681816) < 1e-6 and abs(t[0].p - 0.055009) < 1e-6
    assert abs(t[1].chi2 - 1.553586) < 1e-6 and abs(t[1].p - 0.212607) < 1e-6


def _signed_rank_bruteforce(x, y):
    d = np.asarray(x) - np.asarray(y)
    zeros = int((d == 0).sum())
    d = d[d != 0]
    n = len(d)
    r = pd.Series(np.abs(d)).rank(method="average").to_numpy()
    v = r[d > 0].sum()
    _, counts = np.unique(np.abs(d), return_counts=True)
    ties = float((counts.astype(float) ** 3 - counts).sum())
    zc = v - n * (n + 1) / 4
    sigma = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (zc - np.sign(zc) * 0.5) / sigma
    return n, v, z, zeros


def test_signed_rank_against_bruteforce(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(5, 2, 300), 1)
    y = np.round(x + rng.normal(0.3, 1, 300), 1)
    y[:10] = x[:10]  # zero differences
    rows = [(i, "A", float(a)) for i, a in enumerate(x)] + [(i, "B", float(b)) for i, b in enumerate(y)]
    df = spark.createDataFrame(rows, "lab_id long, k string, v double")
    pairs = S.paired_differences(df, "lab_id", "k", "v", [("A", "B")])
    got = S.signed_rank(pairs).collect()[0]
    n, v, z, zeros = _signed_rank_bruteforce(x, y)
    assert got.n == n and got.zeros == zeros
    assert abs(got.statistic - v) < 1e-9 and abs(got.z - z) < 1e-9


def test_signed_rank_exact_textbook(spark):
    # classic paired example: V = 40, two-sided exact p = 0.03906
    x = [1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]
    y = [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29]
    rows = [(i, "x", a) for i, a in enumerate(x)] + [(i, "y", b) for i, b in enumerate(y)]
    df = spark.createDataFrame(rows, "lab_id long, k string, v double")
    t = S.signed_rank(S.paired_differences(df, "lab_id", "k", "v", [("x", "y")]))
    t = S.add_rank_pvalue(t, n1="n", n2=None).collect()[0]
    assert t.statistic == 40 and t.exact
    assert abs(t.p - 0.0390625) < 1e-9


def test_rank_sum_exact_textbook(spark):
    # W = 35; one-sided exact p 0.1272, two-sided 0.2544
    x = [0.80, 0.83, 1.89, 1.04, 1.45, 1.38, 1.91, 1.64, 0.73, 1.46]
    y = [1.15, 0.88, 0.90, 0.74, 1.21]
    rows = [("s", "x", v) for v in x] + [("s", "y", v) for v in y]
    df = spark.createDataFrame(rows, "st string, g string, v double")
    t = S.add_rank_pvalue(S.rank_sum(df, ["st"], "g", "v", ("x", "y"))).collect()[0]
    assert t.statistic == 35 and t.exact
    assert abs(t.p - 0.2544) < 1e-4


def test_symmetry_properties(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 80), rng.normal(0.5, 1, 60)
    rows = [("s", "a", float(v)) for v in a] + [("s", "b", float(v)) for v in b]
    df = spark.createDataFrame(rows, "st string, g string, v double")
    w1 = S.rank_sum(df, ["st"], "g", "v", ("a", "b")).collect()[0].statistic
    w2 = S.rank_sum(df, ["st"], "g", "v", ("b", "a")).collect()[0].statistic
    assert w1 + w2 == len(a) * len(b)


def test_spearman_matches_pandas_and_is_rank_invariant(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["u", "v"], 400), "x": rng.integers(0, 5, 400).astype(float),
                        "y": rng.lognormal(0, 1, 400)})
    df = spark.createDataFrame(pdf)
    got = {r.g: r.rho for r in S.spearman(df, ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        assert abs(got[g] - part["x"].rank().corr(part["y"].rank())) < 1e-12
    logged = {r.g: r.rho for r in S.spearman(df.withColumn("y", F.log("y")), ["g"], "x", "y").collect()}
    assert all(abs(got[g] - logged[g]) < 1e-12 for g in got)
    pooled = S.spearman(df, [], "x", "y").collect()[0]
    assert abs(pooled.rho - pdf["x"].rank().corr(pdf["y"].rank())) < 1e-12 and pooled.n == 400


def test_pearson_fit_line(spark):
    df = spark.createDataFrame([("k", float(i), 2.0 * i + 1.0) for i in range(10)] + [("k", None, 1.0)],
                               "k string, x double, y double")
    r = S.pearson(df, ["k"], "x", "y").collect()[0]
    f = S.fit_line(df, ["k"], "x", "y").collect()[0]
    assert r.n == 10 and abs(r.r - 1.0) < 1e-12
    assert f.n == 10 and abs(f.slope - 2.0) < 1e-12 and abs(f.intercept - 1.0) < 1e-12


def test_bonferroni_and_significance(spark):
    df = spark.createDataFrame([(0.01,), (0.2,), (0.0001,), (0.5,)], "p double")
    out = S.add_significance(S.bonferroni(df), "p_adj").orderBy("p").collect()
    assert [r.p_adj for r in out] == [0.0004, 0.04, 0.8, 1.0]
    assert [r.p_adj_signif for r in out] == ["***", "*", "ns", "ns"]


def test_stat_label(spark):
    df = spark.createDataFrame([(0.3, 0.076), (0.251, 0.0004), (0.12, 0.2961)], "r double, p double")
    got = [r.label for r in S.stat_label(df, "r", "p", "rho").collect()]
    assert got == ["rho = 0.3, p = 0.076", "rho = 0.25, p < 0.001", "rho = 0.12, p = 0.296"]


def test_category_pairs(spark):
    df = spark.createDataFrame([("SNT",), ("M",), ("NC",), ("M",), ("other",)], "a string")
    got = [(r.group1, r.group2) for r in S.category_pairs(df, "a", ["NC", "M", "SNT", "SCT"]).collect()]
    assert got == [("M", "NC"), ("M", "SNT"), ("NC", "SNT")]


def _evaluate(spark, add, rows, schema, *columns):
    """The column p that ``add`` puts beside the given rows."""
    df = add(spark.createDataFrame(rows, schema).coalesce(1), *columns, "p")
    assert df.columns[-1] == "p" and not any(c.startswith("__") for c in df.columns)
    return [r["p"] for r in df.collect()]


def test_normal_and_chi_square_tails(spark):
    z = [0.0, 1e-9, 0.3, 1.959963985, 2.9, 3.0, 4.2425, 4.243, 6.0, 12.0, 30.0, -1.959963985]
    got = _evaluate(spark, P.add_normal_p, [(v,) for v in z], "z double", "z")
    for v, p in zip(z, got):
        want = math.erfc(abs(v) / math.sqrt(2))
        assert abs(p - want) <= 1e-9 * max(want, 1e-300) + 1e-15, (v, p, want)
    got = _evaluate(spark, P.add_chi2_df1_p, [(3.841458821,), (0.0,), (None,)], "x double", "x")
    assert abs(got[0] - 0.05) < 1e-9 and got[1:] == [1.0, None]
    assert _evaluate(spark, P.add_normal_p, [(None,)], "z double", "z") == [None]


def _student_by_integration(t, df):
    """Simpson's rule in the angle: P(|T| > t) = 2 c int cos^(df-1)."""
    a = math.atan(t / math.sqrt(df))
    x = np.linspace(a, math.pi / 2, 400_001)
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    y = np.exp(log_c + (df - 1) * np.log(np.maximum(np.cos(x), 1e-300)))
    h = x[1] - x[0]
    return 2 * h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_student_tail(spark):
    rows = [(t, df) for df in (1, 2, 3, 4, 7, 8, 30, 31, 500, 1999, 2000, 2001, 5000)
            for t in (0.0, 0.5, 1.9, 2.306004135, 6.0)]
    got = _evaluate(spark, P.add_student_p, rows, "t double, df long", "t", "df")
    for (t, df), p in zip(rows, got):
        assert abs(p - _student_by_integration(t, df)) < 1e-9, (t, df, p)
    # against the normal limit, which t misses by less than 1e-9 from here on
    rows = [(t, df) for df in (10 ** 10, 10 ** 12) for t in (0.1, 1.9, 5.0)]
    got = _evaluate(spark, P.add_student_p, rows, "t double, df long", "t", "df")
    for (t, df), p in zip(rows, got):
        assert abs(p - math.erfc(t / math.sqrt(2))) < 1e-9, (t, df, p)


def test_correlation_p(spark):
    got = _evaluate(spark, P.add_correlation_p,
                    [(0.62, 16), (1.0, 5), (-1.0, 5), (0.5, 2), (None, 9), (0.0, 9)],
                    "r double, n long", "r", "n")
    # Figure 4B label: rho .62 with n 16 gives p ~ .011
    assert abs(got[0] - 0.0104) < 1e-3 and got[1:] == [0.0, 0.0, None, None, 1.0]


def _two_sided(counts, k):
    """Twice the smaller tail of a list of equally likely statistics."""
    low, high = sum(c <= k for c in counts), sum(c >= k for c in counts)
    return min(1.0, 2 * min(low, high) / len(counts))


@pytest.mark.parametrize("few", [True, False])
def test_exact_wilcoxon_by_enumeration(spark, few):
    from itertools import combinations, product
    rows, want = [], []
    for m, n in ((1, 1), (2, 5), (6, 4), (1, 9), (5, 5)):
        sums = [sum(c) - m * (m - 1) // 2 for c in combinations(range(m + n), m)]
        rows += [(True, float(w), m, n, None) for w in range(m * n + 1)]
        want += [_two_sided(sums, w) for w in range(m * n + 1)]
    schema = "exact boolean, w double, n1 long, n2 long, z double"
    test = lambda df, n1, n2: P.add_rank_test_p(df, "exact", "w", n1, n2, "z", "p", few)
    got = test(spark.createDataFrame(rows, schema), "n1", "n2").collect()
    assert {(r.n1, r.n2, r.w): round(r.p, 12) for r in got} == {
        (r[2], r[3], r[1]): round(w, 12) for r, w in zip(rows, want)}
    rows, want = [], []
    for n in (1, 4, 7, 10):
        sums = [sum(k for k, s in zip(range(1, n + 1), signs) if s)
                for signs in product((0, 1), repeat=n)]
        rows += [(True, float(v), n, None, None) for v in range(n * (n + 1) // 2 + 1)]
        want += [_two_sided(sums, v) for v in range(n * (n + 1) // 2 + 1)]
    got = test(spark.createDataFrame(rows, schema), "n1", None).collect()
    assert {(r.n1, r.w): round(r.p, 12) for r in got} == {
        (r[2], r[1]): round(w, 12) for r, w in zip(rows, want)}
    # the largest sizes: symmetric, a whole distribution; normal and undefined rows beside them
    rows = [(True, 1200.0, 49, 49, 9.0), (True, 1201.0, 49, 49, 9.0), (True, 0.0, 49, 49, 9.0),
            (False, 5.0, 49, 49, 1.959963985), (True, 0.0, 0, 5, None), (False, 1.0, 3, 3, None)]
    got = {(r.exact, r.w, r.n1): r.p for r in test(
        spark.createDataFrame(rows, schema), "n1", "n2").collect()}
    assert got[True, 1200.0, 49] == pytest.approx(got[True, 1201.0, 49], abs=1e-12)
    assert got[True, 0.0, 49] == pytest.approx(2 / math.comb(98, 49), rel=1e-9)
    assert got[False, 5.0, 49] == pytest.approx(0.05, abs=1e-9)
    assert got[True, 0.0, 0] is None and got[False, 1.0, 3] is None


def test_exact_p_needs_no_python(spark):
    """Rank tests and rank correlations are planned without Python workers."""
    df = spark.createDataFrame([("s", "a", 1.0, 2.0), ("s", "b", 2.0, 1.0)],
                               "st string, g string, v double, w double")
    for out in (S.add_rank_pvalue(S.rank_sum(df, ["st"], "g", "v", ("a", "b"))),
                S.add_spearman_pvalue(S.spearman(df, ["st"], "v", "w"))):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert out.count() == 1


def test_spearman_p_by_enumeration(spark):
    """Every possible sum of squared differences of 2 to 9 ranks, and of 10 to
    12, where the series stands in for the orders."""
    from itertools import permutations
    rows, want = [], []
    for n in range(2, 9):
        sums = [sum((i - j) ** 2 for i, j in enumerate(o)) for o in permutations(range(n))]
        for k in sorted(set(sums)):
            rows.append((1 - 6 * k / (n ** 3 - n), n, False))
            want.append(_two_sided(sums, k))
    args = "r double, n long, tied boolean", "r", "n", "tied"
    assert _evaluate(spark, P.add_spearman_p, rows, *args) == pytest.approx(want, abs=1e-12)
    # the series itself is within these of the counted orders, twice its one-sided error
    for n, near in ((9, 1e-12), (10, 1.2e-3), (11, 8e-4), (12, 4e-4)):
        ways = P.spearman_ways(n)
        assert sum(ways) == math.factorial(n)
        rows = [(1 - 12 * k / (n ** 3 - n), n, False) for k in range(len(ways))]
        want = [min(1.0, 2 * min(sum(ways[:k + 1]), sum(ways[k:])) / sum(ways))
                for k in range(len(ways))]
        assert _evaluate(spark, P.add_spearman_p, rows, *args) == pytest.approx(want, abs=near)
    # ties, many points and undefined coefficients
    rows = [(0.62, 16, True), (0.05, 1290, False), (None, 5, False), (None, 5, True),
            (1.0, 5, False), (-1.0, 5, False), (0.3, 1, False)]
    got = _evaluate(spark, P.add_spearman_p, rows, *args)
    t = _evaluate(spark, P.add_correlation_p, [r[:2] for r in rows], "r double, n long", "r", "n")
    assert got[:4] == t[:4] and got[4:] == [2 / 120, 2 / 120, None]
    close = _evaluate(spark, P.add_spearman_p, [(0.05, 1289, False)], *args)
    assert close[0] == pytest.approx(t[1], abs=2e-3)


def test_spearman_of_few_levels_is_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 5 == 0 else f"g{i % 3}", float(rng.integers(0, 5)),
             None if i % 11 == 0 else float(rng.integers(0, 40))) for i in range(400)]
    rows += [("one", 2.0, 1.0), ("flat", 1.0, 3.0), ("flat", 1.0, 4.0),
             ("own", 0.0, 1.0), ("own", 3.0, 5.0), ("own", 4.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in S.spearman(df, ["g"], "x", "y", levels=range(5)).collect()}
    want = {r.g: r for r in S.spearman(df, ["g"], "x", "y").collect()}
    assert set(got) == set(want)
    for g, r in want.items():
        assert (got[g].n, got[g].tied) == (r.n, r.tied)
        assert got[g].rho == (None if r.rho is None else pytest.approx(r.rho, abs=1e-12))
    assert got["one"].rho is None and got["flat"].rho is None and not got["own"].tied
    with pytest.raises(Exception, match="not among the levels"):
        S.spearman(df, ["g"], "x", "y", levels=range(3)).collect()


def test_nan_is_missing_after_ingest(spark):
    from cohortspark.functions import columns as C
    from cohortspark.operators import cohort as K
    from cohortspark.sources.io import nan_to_null
    nan = float("nan")
    rows = [(1, "g", "NC", 50.0), (1, "g", "M", nan), (1, "g", "SCT", 1.0),
            (2, "g", "NC", 50.0), (2, "g", "M", 60.0), (2, "g", "SCT", 1.0)]
    df = nan_to_null(spark.createDataFrame(rows, "lab_id long, g string, antigen string, v double"))
    got = df.select(C.flag_above("v", 40), C.label_above("v", 40)).collect()
    assert [tuple(r) for r in got][1] == (None, None)
    per = K.subject_panel(df, "lab_id", "g", "antigen", "v", ["NC", "M", "SCT"], 40.0).collect()
    assert [(r.lab_id, r.detected) for r in per] == [(2, 2)]
    pts = nan_to_null(spark.createDataFrame(
        [("k", 1.0, 2.0), ("k", 2.0, 4.0), ("k", nan, 1.0), ("k", 3.0, 7.0)],
        "k string, x double, y double"))
    r = S.pearson(pts, ["k"], "x", "y").first()
    assert r.n == 3 and abs(r.r - np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1]) < 1e-12
    assert S.spearman(pts, ["k"], "x", "y").first()["rho"] == 1.0
    t = S.rank_sum(pts.withColumn("g", F.when(F.col("y") > 3, "a").otherwise("b")), ["k"], "g",
                   "x", ("a", "b")).first()
    assert (t.n1, t.n2) == (2, 1)
    text = spark.createDataFrame([("NaN",), ("1.5",), ("n/a",)], "t string")
    assert [r[0] for r in text.select(C.to_number("t")).collect()] == [None, 1.5, None]


def test_category_order_both_ways_with_ties(spark):
    from cohortspark.operators.summary import category_order
    df = spark.createDataFrame([("B", 1), ("A", 1), ("C", 2), ("A", 9)], "c string, at long")
    ahead = {r.c: r.level for r in category_order(df, "c", "at").collect()}
    back = {r.c: r.level for r in category_order(df, "c", "at", reverse=True).collect()}
    assert ahead == {"A": 1, "B": 2, "C": 3} and back == {"C": 1, "B": 2, "A": 3}


def test_degenerate_inputs_give_null_not_errors(spark):
    # all values tied, a one-element sample, all-zero differences, empty row
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 1.0), ("s", "b", 1.0),
                                ("t", "a", 2.0), ("t", "b", 3.0)], "st string, g string, v double")
    t = {r.st: r for r in S.add_rank_pvalue(
        S.rank_sum(df, ["st"], "g", "v", ("a", "b"))).collect()}
    assert t["s"].z is None and t["s"].statistic == 1.0 and t["s"].p is None  # R: NA
    assert t["t"].exact and t["t"].n1 == 1 and t["t"].n2 == 1
    pairs = spark.createDataFrame([(1, "x", "y", 0.0), (2, "x", "y", 0.0)],
                                  "lab_id long, group1 string, group2 string, d double")
    sr = S.signed_rank(pairs).collect()[0]
    assert sr.n == 0 and sr.zeros == 2 and sr.z is None
    cells = spark.createDataFrame([(0, 0, 3, 4)], "a long, b long, c long, d long")
    assert S.chi_square_yates(cells, "a", "b", "c", "d").collect()[0].chi2 is None
    d2 = spark.createDataFrame([("k", 1.0, 1.0), ("k", 1.0, 2.0), ("j", 1.0, 2.0)],
                               "k string, x double, y double")
    assert {r.k: r.n for r in S.spearman(d2, ["k"], "x", "y").collect()} == {"k": 2, "j": 1}


def test_signed_rank_swapped_sides_sum(spark):
    """V(x - y) + V(y - x) = n(n+1)/2 (no zero differences)."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 120)
    y = x + rng.normal(0.2, 1, 120)
    rows = [(i, "x", float(a)) for i, a in enumerate(x)] + [(i, "y", float(b)) for i, b in enumerate(y)]
    df = spark.createDataFrame(rows, "lab_id long, k string, v double")
    p = S.paired_differences(df, "lab_id", "k", "v", [("x", "y"), ("y", "x")])
    got = {(r.group1, r.group2): r for r in S.signed_rank(p).collect()}
    n = got[("x", "y")].n
    assert got[("x", "y")].statistic + got[("y", "x")].statistic == n * (n + 1) / 2
