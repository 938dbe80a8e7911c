"""Distributed ranks against brute force (pandas), including a hot stratum
holding a third of all rows, NULL strata and heavy ties."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators.ranks import mid_ranks, ranked_histogram, row_positions
from cohortspark.operators.summary import median_exact, median_log2


def _data(seed=7, n=3000):
    rng = np.random.default_rng(seed)
    strata = rng.choice(["hot", "a", "b", None], size=n, p=[0.4, 0.3, 0.2, 0.1])
    values = np.round(rng.exponential(5.0, size=n), 1)   # many ties
    values[rng.random(n) < 0.15] = 0.0                    # a hot value
    return pd.DataFrame({"s": strata, "v": values, "id": np.arange(n)})


def test_mid_ranks_match_pandas(spark):
    pdf = _data()
    df = spark.createDataFrame(pdf)
    got = mid_ranks(df, ["s"], "v", slices=7).toPandas().sort_values("id")
    exp = pdf.copy()
    exp["r"] = exp.groupby(exp["s"].fillna("<null>"))["v"].rank(method="average")
    np.testing.assert_allclose(got["mid_rank"].to_numpy(), exp.sort_values("id")["r"].to_numpy())


def test_histogram_counts_and_ties(spark):
    pdf = _data(11, 500)
    df = spark.createDataFrame(pdf)
    h = ranked_histogram(df, ["s"], "v", counts={"c_big": F.col("v") > 5}, slices=3).toPandas()
    assert h["c"].sum() == len(pdf)
    assert h["c_big"].sum() == (pdf["v"] > 5).sum()
    # cum_before + c of the last value in a stratum is the stratum size
    last = h.sort_values("v").groupby(h["s"].fillna("<null>")).tail(1)
    sizes = pdf.groupby(pdf["s"].fillna("<null>")).size()
    for _, r in last.iterrows():
        assert r["cum_before"] + r["c"] == sizes[r["s"] if r["s"] is not None else "<null>"]


def test_row_positions_composite_order(spark):
    pdf = _data(3, 800)
    pdf["n"] = (pdf["v"] // 3).astype(int)
    df = spark.createDataFrame(pdf[["s", "n", "id"]])
    got = row_positions(df, ["s"], ["n", "id"], slices=5).toPandas().sort_values("id")
    exp = pdf.sort_values(["n", "id"]).copy()
    exp["pos"] = exp.groupby(exp["s"].fillna("<null>")).cumcount() + 1
    assert got["position"].tolist() == exp.sort_values("id")["pos"].tolist()


def test_exact_median_even_and_odd(spark):
    pdf = _data(5, 1001)
    pdf = pdf[pdf["s"].notna()]
    df = spark.createDataFrame(pdf)
    got = {r.s: r.median for r in median_exact(df, ["s"], "v").collect()}
    for k, g in pdf.groupby("s"):
        assert abs(got[k] - float(np.median(g["v"]))) < 1e-12


def test_median_log2_is_geometric_mean_of_middle(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 4.0), ("y", 2.0), ("y", 8.0), ("y", 3.0)],
                               "s string, v double")
    got = {r.s: r.median for r in median_log2(df, ["s"], "v").collect()}
    assert abs(got["x"] - 2.0) < 1e-12 and abs(got["y"] - 3.0) < 1e-12


def test_hot_stratum_is_split_over_many_slices(spark):
    """One stratum holding every row is cut into ordered slices (tasks)."""
    from cohortspark.operators.ranks import with_cumulative
    hist = spark.range(0, 5000).select(F.lit("only").alias("s"), F.col("id").cast("double").alias("v"),
                                       F.lit(1).cast("bigint").alias("c"))
    out = with_cumulative(hist, ["s"], "v", slices=8, keep_slice=True)
    per_slice = out.groupBy("slice").agg(F.count("*").alias("n"), F.min("v").alias("lo")).collect()
    assert len(per_slice) >= 6
    assert max(r.n for r in per_slice) < 5000 / 2
    assert out.filter(F.col("cum_before") != F.col("v")).count() == 0


from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 6)), min_size=1, max_size=60),
       st.integers(1, 5))
def test_cumulative_counts_property(spark, rows, parts):
    """Cumulative counts equal the brute-force count of smaller values in the
    same stratum, for any data and any number of range slices."""
    from cohortspark.operators.ranks import ranked_histogram
    df = spark.createDataFrame([(s, float(v)) for s, v in rows], "s string, v double")
    got = {(r.s, r.v): (r.c, r.cum_before) for r in ranked_histogram(df, ["s"], "v", slices=parts).collect()}
    for (s, v), (c, before) in got.items():
        assert c == sum(1 for a, b in rows if a == s and b == v)
        assert before == sum(1 for a, b in rows if a == s and b < v)


def test_default_slicing(spark):
    """Queries leave the slice count to the session."""
    from cohortspark.operators.ranks import ranked_histogram
    pdf = _data(21, 2000)
    df = spark.createDataFrame(pdf)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        h = ranked_histogram(df, ["s"], "v").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    key = pdf["s"].fillna("<null>")
    for _, r in h.iterrows():
        s = r["s"] if r["s"] is not None else "<null>"
        assert r["cum_before"] == int(((key == s) & (pdf["v"] < r["v"])).sum())


def test_plan_has_two_exchanges_of_the_histogram_and_no_job_at_build(spark):
    """The fold and the windows shuffle; nothing is range-partitioned, written
    or run while the plan is built."""
    df = spark.createDataFrame(_data(1, 200))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranks-build", "plan only")
    h = ranked_histogram(df, ["s"], "v")
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert len(tracker.getJobIdsForGroup("ranks-build")) == 0
    spark.sparkContext._jsc.clearJobGroup()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    rows = [line for line in dealt if "sum" not in line and "__of" not in line]
    assert {re.search(r"partitioning\((\w+)", line)[1] for line in rows} <= {"s", "__cell"}


def test_cut_points_do_not_change_counts(spark):
    pdf = _data(8, 1500)
    df = spark.createDataFrame(pdf)
    want = None
    for slices in (1, 2, 5, 60, 700):
        got = sorted(map(tuple, ranked_histogram(df, ["s"], "v", slices=slices).collect()), key=repr)
        want = want or got
        assert got == want


def test_positions_and_sizes_by_name_and_place(spark):
    df = spark.createDataFrame([(i % 7, i // 3, i) for i in range(90)], "a int, b int, c int")
    got = row_positions(df, [], ["b", "a", "c"], total="n", slices=4, slice_by="b").collect()
    ordered = sorted(got, key=lambda r: (r.b, r.a, r.c))
    assert [r.position for r in ordered] == list(range(1, 91)) and {r.n for r in got} == {90}


@pytest.mark.parametrize("slots", ["1", "3", "64"])
@pytest.mark.parametrize("accuracy", [7, 10, 100_000])
def test_medians_are_exact_whatever_the_bracket(spark, monkeypatch, slots, accuracy):
    """Hot, small, tied, single and missing groups; rough and exact brackets."""
    from cohortspark.operators import summary
    monkeypatch.setattr(summary, "MEDIAN_ACCURACY", accuracy)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slots)
    try:
        rng = np.random.default_rng(accuracy)
        groups = {"hot": rng.normal(0, 9, 5001), "even": rng.normal(0, 1, 400),
                  "ties": rng.integers(0, 3, 999), "one": [4.0], "two": [1.0, 2.0],
                  None: rng.exponential(2, 750), "same": [7.0] * 50}
        data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None)]
        df = spark.createDataFrame(data, "s string, v double").repartition(5)
        got = {r.s: r.median for r in median_exact(df, ["s"], "v").collect()}
        assert got == {k: pytest.approx(float(np.median(v)), abs=1e-12) for k, v in groups.items()}
        whole = median_exact(df, [], "v").collect()
        assert [r.median for r in whole] == [pytest.approx(float(np.median(
            np.concatenate([np.asarray(v, float) for v in groups.values()]))), abs=1e-12)]
        assert median_exact(df.limit(0), ["s"], "v").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_large_group_shuffles_its_bracket_only(spark):
    """Of 200,000 different values a handful is shuffled besides the counts."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"),
                                     (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    out = median_exact(df, ["g"], "v")
    execution = out._jdf.queryExecution()
    assert len(out.collect()) == 2
    sizes = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ShuffleExchangeExec":
            sizes.append(int(node.metrics().apply("shuffleRecordsWritten").value()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(execution.executedPlan())
    assert sizes and max(sizes) < 1000
