"""All tables from one stored fold; categories and rows in the order of files."""

import pytest
from pyspark.sql import functions as F

from cohortspark.__main__ import main
from cohortspark.operators.ranks import with_slice
from cohortspark.operators.summary import category_order
from cohortspark.plans import batch
from cohortspark.plans.context import Inputs, StudyInputs
from cohortspark.plans.registry import BUILDERS
from cohortspark.sources import io

from .conftest import SF_SMALL


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    given = Inputs(spark, SF_SMALL)
    return given, batch.store_subjects(spark, given, str(tmp_path_factory.mktemp("fold") / "t"))


@pytest.mark.parametrize("key", batch.TABLES)
def test_tables_of_the_fold_are_the_studys(stored, key):
    given, fold = stored
    table = BUILDERS[key](fold)
    assert rows(table) == rows(BUILDERS[key](given))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan


def test_fold_reads_the_assay_once_and_raises_on_repeats(spark, stored):
    given, _ = stored
    plan = batch.fold_subjects(given)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assay = given.assay_long()
    twice = StudyInputs(assay.unionAll(assay), given.subject(), given.parameters)
    with pytest.raises(Exception, match="duplicate rows"):
        batch.fold_subjects(twice).collect()


def test_write_tables_and_command(spark, tmp_path):
    study = StudyInputs(Inputs(spark, SF_SMALL).assay_long(), Inputs(spark, SF_SMALL).subject(),
                        Inputs(spark, SF_SMALL).parameters)
    keys = ["fig3a_distribution", "fig4b_spearman"]
    written = batch.write_tables(spark, study, str(tmp_path / "t"), keys)
    assert list(written) == keys
    for key, path in written.items():
        assert rows(spark.read.parquet(path)) == rows(BUILDERS[key](study))
    with pytest.raises(ValueError, match="fig2b_tests"):
        batch.write_tables(spark, study, str(tmp_path / "u"), ["fig2b_tests"])
    with pytest.raises(SystemExit):
        main(["batch", "--data", SF_SMALL])


def test_order_of_first_appearance_over_files(spark, tmp_path):
    """Neither the key's order nor the name's: the place in the files."""
    path = str(tmp_path / "t")
    for part, names in (("a", ["z", "m"]), ("b", ["m", "a", "z", "q"]), ("c", ["b", "a", None])):
        spark.createDataFrame([(n,) for n in names], "c string").coalesce(1).write.parquet(
            f"{path}/part={part}")
    df = io.read_positioned(spark, path, "c string")
    place = dict(position=["file_path", "row_index"], slice_by="row_index")
    got = {r.c: (r.first_position, r.level) for r in category_order(df, "c", **place).collect()}
    assert got == {"z": (0, 1), "m": (1, 2), "a": (1, 3), "q": (3, 4), "b": (0, 5), None: (2, 6)}
    back = {r.c: r.level for r in category_order(df, "c", reverse=True, **place).collect()}
    assert back == {c: 7 - level for c, (_, level) in got.items()}


@pytest.mark.parametrize("slices", [1, 2, 3, 8, 9, 200])
def test_slices_by_binary_search(spark, slices):
    cuts = sorted((7 * k % 50) / 2 for k in range(slices - 1))
    df = spark.range(-3, 60).select((F.col("id") / 2).alias("a b"), F.array(
        *map(F.lit, cuts)).cast("array<double>").alias("cuts"))
    df = df.unionByName(df.limit(1).withColumn("a b", F.lit(None).cast("double")))
    for r in with_slice(df, "a b", "cuts", slices, "s").collect():
        assert r.s == (0 if r["a b"] is None else sum(c <= r["a b"] for c in cuts)), (r, cuts)


def test_slices_are_generated_code(spark):
    df = spark.range(100).withColumn("cuts", F.sequence(F.lit(1), F.lit(99)).cast("array<long>"))
    plan = with_slice(df, "id", "cuts", 100, "s")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("CASE WHEN") <= 2 * (100).bit_length()
