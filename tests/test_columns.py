"""Column helpers: NULL handling first."""

from pyspark.sql import functions as F

from cohortspark.functions import columns as C
from cohortspark.functions.labels import ANALYTE_SHORT_NAMES, COHORT_RULES


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_threshold_flag_and_label_keep_null(spark):
    df = spark.createDataFrame([(1, 50.0), (2, 40.0), (3, None), (4, 0.0)], "id int, v double")
    out = df.select("id", C.flag_above("v", 40).alias("f"),
                    C.label_above("v", 40).alias("l")).orderBy("id")
    assert rows(out, "f", "l") == [(1, "Above"), (0, "Below"), (None, None), (0, "Below")]


def test_floor_zeros_and_zero_flag(spark):
    df = spark.createDataFrame([(0.0,), (0.01,), (None,), (5.0,)], "v double")
    out = df.select(C.floor_zeros("v", 0.01).alias("f"), C.flag_zero("v").alias("z")).collect()
    assert [(r.f, r.z) for r in out] == [(0.01, True), (0.01, False), (None, None), (5.0, False)]


def test_recode_without_default_gives_null(spark):
    df = spark.createDataFrame([("Capsid sub x5",), ("grün sbu x5",), ("other",), (None,)],
                               "a string")
    got = [r[0] for r in df.select(C.recode("a", ANALYTE_SHORT_NAMES)).collect()]
    assert got == ["NC", "Pepmix (green)", None, None]


def test_combined_status_kleene(spark):
    df = spark.createDataFrame(
        [("Positive", None), (None, "Positive"), ("Negative", "Negative"),
         ("Negative", None), (None, None), ("Negative", "Positive")], "a string, b string")
    got = [r[0] for r in df.select(C.combine_status("a", "b")).collect()]
    assert got == ["Positive", "Positive", "Negative", None, None, "Positive"]


def test_assign_cohort(spark):
    df = spark.createDataFrame([("PCR+", "Positive"), ("PCR+", None), ("Controls", None),
                                ("Exposed", "Negative"), (None, "Positive")], "g string, s string")
    got = [r[0] for r in df.select(C.assign_cohort("g", "s", COHORT_RULES)).collect()]
    assert got == ["PCR+ Seropositive", None, "Controls", "Exposed Seronegative", None]


def test_bin_count_two_falls_in_upper_bin(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (4,), (5,)], "n int")
    bins = [([0, 1], "Less than 2"), ([2, 3, 4], "More than 2")]
    got = [r[0] for r in df.select(C.bin_count("n", bins)).collect()]
    assert got == ["Less than 2", "Less than 2", "More than 2", "More than 2", None]


def test_to_number_bad_text_is_null(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,), ("-3",)], "t string")
    got = [r[0] for r in df.select(C.to_number("t")).collect()]
    assert got == [1.5, None, None, -3.0]


def test_size_label_matches_r_paste(spark):
    df = spark.createDataFrame([("PCR+\nSeropositive", 154), (None, 3), ("M", None)],
                               "g string, n long")
    got = [r[0] for r in df.select(C.size_label("g", "n", " ")).collect()]
    assert got == ["PCR+\nSeropositive \n(n= 154 )", "NA \n(n= 3 )", "M \n(n= NA )"]
    got0 = [r[0] for r in df.select(C.size_label("g", "n", "")).collect()]
    assert got0[0] == "PCR+\nSeropositive\n(n=154)"


def test_safe_log2_and_days(spark):
    df = spark.createDataFrame([(8.0,), (0.0,), (-1.0,), (None,)], "v double")
    got = [r[0] for r in df.select(C.safe_log2("v")).collect()]
    assert got == [3.0, None, None, None]
    d = spark.sql("SELECT DATE'2020-05-10' AS a, DATE'2020-01-01' AS b")
    assert d.select(C.days_between("a", "b")).first()[0] == 130


def test_significance_scale(spark):
    df = spark.createDataFrame([(0.00001,), (0.0001,), (0.0005,), (0.01,), (0.049,),
                                (0.05,), (0.2,), (None,)], "p double")
    got = [r[0] for r in df.select(C.significance("p")).collect()]
    assert got == ["****", "****", "***", "**", "*", "*", "ns", None]
