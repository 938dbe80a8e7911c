import pytest
from pyspark.sql import functions as F

from cohortspark.operators.joins import attach, hot_join, rename_checked, semi_join


def test_attach_matches_null_keys(spark):
    detail = spark.createDataFrame([("A", 1), (None, 2)], "g string, x int")
    sizes = spark.createDataFrame([("A", 10), (None, 20)], "g string, n int")
    got = sorted(((r.g or "-"), r.x, r.n) for r in attach(detail, sizes, ["g"]).collect())
    assert got == [("-", 2, 20), ("A", 1, 10)]


def test_semi_join(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "lab_id long")
    b = spark.createDataFrame([(2,), (2,), (9,)], "lab_id long")
    assert [r.lab_id for r in semi_join(a, b, ["lab_id"]).collect()] == [2]


def test_rename_checked_raises_on_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert rename_checked(df, {"a": "b"}).columns == ["b"]
    with pytest.raises(ValueError):
        rename_checked(df, {"zz": "b"})


def test_semi_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(1,), (None,), (3,)], "lab_id long")
    b = spark.createDataFrame([(None,), (3,)], "lab_id long")
    assert {r.lab_id for r in semi_join(a, b, ["lab_id"]).collect()} == {None, 3}
    assert semi_join(a, b, ["lab_id"]).columns == ["lab_id"]


@pytest.mark.parametrize("slots", [2, 8, 100])
@pytest.mark.parametrize("null_safe", [True, False])
def test_hot_join_is_a_left_join(spark, slots, null_safe):
    rows = [(None if k % 3 == 0 else k % 7, k) for k in range(300)] + [(50, 1), (51, None)]
    left = spark.createDataFrame(rows, "g int, x int")
    right = left.groupBy("g").agg(F.count("*").alias("n"), F.sum("x").alias("s")).filter(
        "g is null or g <> 50")
    right = right.withColumn("s", F.when(F.col("g") != 3, F.col("s")))  # a NULL in the payload
    got = hot_join(left, right, ["g"], "n", slots=slots, null_safe=null_safe)
    assert got.columns == ["g", "x", "s"]
    sums = {r.g: r.s for r in right.collect() if null_safe or r.g is not None}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
        repr((g, x, sums.get(g))) for g, x in rows)


def test_hot_join_without_keys_on_the_right(spark):
    left = spark.createDataFrame([(1, 2)], "g int, x int")
    right = spark.createDataFrame([], "g int, n long, s int")
    assert [tuple(r) for r in hot_join(left, right, ["g"], "n").collect()] == [(1, 2, None)]
    with pytest.raises(ValueError):
        hot_join(left, right.withColumnRenamed("s", "x"), ["g"], "n")


def test_hot_join_balances_a_third_of_all_rows(spark):
    """The largest task stays near the median where a value holds a third."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(30_000).select(
            F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("g"), "id")
        right = left.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("s"))
        joined = hot_join(left, right, ["g"], "n", spread=["id"])
        sizes = sorted(r["count"] for r in joined.groupBy(
            F.spark_partition_id()).count().collect())
        assert sum(sizes) == 30_000 and len(sizes) == 32
        assert sizes[-1] < 1.3 * sizes[16]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_mid_ranks_balance_a_hot_value_and_missing_values(spark):
    """A third of the rows hold one value, a third none: both are spread."""
    from cohortspark.operators.ranks import mid_ranks
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(24_000).select(
            (F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 3 == 0, 0.0)
            .when(F.col("id") % 3 == 1, F.col("id").cast("double")).alias("v"))
        ranked = mid_ranks(df, ["g"], "v")
        sizes = sorted(r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 24_000 and sizes[-1] < 1.5 * sizes[len(sizes) // 2]
        row = ranked.filter("v = 0").first()
        assert row.mid_rank == (4_000 + 1) / 2
        assert ranked.filter("v is null and mid_rank is null").count() == 8_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
