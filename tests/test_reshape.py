"""Reshape and complete-case operators on hand rows."""

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cohort as K
from cohortspark.operators import reshape as H

LONG = [
    (1, "G1", "NC", 50.0), (1, "G1", "M", 10.0), (1, "G1", "SCT", 41.0),   # complete, 2 above
    (2, "G1", "NC", 0.0), (2, "G1", "M", None), (2, "G1", "SCT", 99.0),    # NULL analyte
    (3, "G2", "NC", 40.0), (3, "G2", "M", 40.0), (3, "G2", "SCT", 40.0),   # at cutoff: 0
    (4, "G2", "NC", 1.0), (4, "G2", "M", 2.0),                             # missing one
    (5, None, "NC", 99.0), (5, None, "M", 99.0), (5, None, "SCT", 99.0),   # NULL group
    (6, "G2", "NC", 90.0), (6, "G2", "M", 90.0), (6, "G2", "SCT", 90.0), (6, "G2", "SNT", 1.0),
]
SCHEMA = "lab_id long, grp string, antigen string, value double"


@pytest.fixture
def long_df(spark):
    return spark.createDataFrame(LONG, SCHEMA)


def test_spread_absent_is_null(spark, long_df):
    w = H.spread(long_df, ["lab_id"], "antigen", "value", ["NC", "M", "SCT", "SNT"])
    got = {r.lab_id: (r.NC, r.M, r.SCT, r.SNT) for r in w.collect()}
    assert got[4] == (1.0, 2.0, None, None)
    assert got[2] == (0.0, None, 99.0, None)


def test_spread_duplicate_raises(spark):
    df = spark.createDataFrame([(1, "NC", 1.0), (1, "NC", 2.0)], "lab_id long, antigen string, value double")
    with pytest.raises(Exception, match="duplicate"):
        H.spread(df, ["lab_id"], "antigen", "value", ["NC"]).collect()


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, "NC"), (1, "NC"), (2, "NC")], "lab_id long, antigen string")
    assert [(r.lab_id, r.n) for r in H.duplicate_keys(df, ["lab_id", "antigen"]).collect()] == [(1, 2)]


def test_gather_keeps_null_cells(spark, long_df):
    w = H.spread(long_df, ["lab_id"], "antigen", "value", ["NC", "M"])
    g = H.gather(w, ["lab_id"], ["NC", "M"], "antigen", "value")
    assert g.count() == 2 * w.count()
    assert g.filter(F.col("value").isNull()).count() == 1


def test_unpivot_pivot_identity_on_complete_cases(spark, long_df):
    cc = H.complete_cases(long_df.filter(F.col("grp").isNotNull()), ["lab_id", "grp"],
                          "antigen", "value", ["NC", "M", "SCT"])
    src = long_df.filter(F.col("lab_id").isin(1, 3, 6) & F.col("antigen").isin("NC", "M", "SCT"))
    key = lambda df: sorted(tuple(r) for r in df.select("lab_id", "grp", "antigen", "value").collect())
    assert key(cc) == key(src)


def test_subject_panel_counts_strictly_above(spark, long_df):
    p = K.subject_panel(long_df, "lab_id", "grp", "antigen", "value", ["NC", "M", "SCT"], 40.0)
    got = sorted((r.lab_id, r.grp, r.detected) for r in p.collect())
    assert got == [(1, "G1", 2), (3, "G2", 0), (6, "G2", 3)]


def test_detected_zero_filled_matches_panel(spark, long_df):
    a = K.detected_zero_filled(long_df, "lab_id", "grp", "antigen", "value",
                               ["NC", "M", "SCT"], 40.0)
    got = sorted((r.lab_id, r.n) for r in a.collect())
    assert got == [(1, 2), (3, 0), (6, 3)]


def test_detected_any_and_sizes(spark, long_df):
    d = K.detected_any(long_df, "lab_id", "grp", "antigen", "value", ["NC", "M", "SCT", "SNT"], 40.0)
    got = sorted((r.lab_id, r.detected) for r in d.collect())
    assert got == [(1, 2), (2, 1), (3, 0), (4, 0), (6, 3)]
    s = K.cohort_sizes(long_df, "lab_id", "grp", "antigen", "value", ["NC", "M", "SCT"])
    assert sorted((r.grp, r.n_ind) for r in s.collect()) == [("G1", 1), ("G2", 2)]


def test_percent_of_group_sums_to_100(spark, long_df):
    d = K.detected_any(long_df, "lab_id", "grp", "antigen", "value", ["NC", "M", "SCT"], 40.0)
    p = K.percent_of_group(K.distribution(d, "grp", "detected"), "grp")
    for r in p.groupBy("grp").agg(F.sum("prop").alias("s")).collect():
        assert abs(r.s - 100.0) < 1e-9
