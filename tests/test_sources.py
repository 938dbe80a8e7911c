"""Malformed input, and studies stored in the catalog."""

import re

import pytest
from pyspark.sql import functions as F

from cohortspark.plans import reports
from cohortspark.plans.context import Inputs, Parameters, StudyInputs
from cohortspark.sources import io

from .conftest import SF_SMALL

GOOD = "1,NC,5.5,2020-01-01\n5,NC,,2020-01-03\n8,M,NaN,\n"
BAD = {"2,M,7x,2020-01-02": "malformed",           # not a number
       "3,SCT": "malformed",                       # a short row
       "4,NC,1.5,notadate": "malformed",
       "6,NC,1,2020-01-03,extra": "malformed",
       ",NC,2.5,2020-01-01": "no lab_id",
       '"7,NC,2': "malformed"}                     # an open quote


@pytest.fixture
def assay_csv(tmp_path):
    def write(*rows):
        path = tmp_path / "assay.csv"
        path.write_text("lab_id,antigen,value,visit_date\n" + GOOD + "".join(r + "\n" for r in rows))
        return str(path)
    return write


def test_good_rows_are_read(spark, assay_csv):
    got = io.read_assay(spark, assay_csv(), fmt="csv").collect()
    assert [(r.lab_id, r.antigen, r.value) for r in got] == [
        (1, "NC", 5.5), (5, "NC", None), (8, "M", None)]


@pytest.mark.parametrize("row", sorted(BAD))
def test_a_malformed_row_fails_loudly(spark, assay_csv, row):
    """Whatever columns a query reads; the error names file and record."""
    df = io.read_assay(spark, assay_csv(row), fmt="csv")
    for query in (df, df.select("lab_id"), df.groupBy("antigen").agg(F.max("value"))):
        with pytest.raises(Exception, match="rejected row") as e:
            query.collect()
        assert "assay.csv" in str(e.value) and BAD[row] in str(e.value)


def test_malformed_rows_go_to_quarantine(spark, assay_csv, tmp_path):
    path, aside = assay_csv(*BAD), str(tmp_path / "aside")
    df = io.read_assay(spark, path, fmt="csv", quarantine=aside)
    assert sorted(r.lab_id for r in df.collect()) == [1, 5, 8] and df.columns == [
        f.name for f in io.ASSAY_LONG_SCHEMA]
    kept = spark.read.parquet(aside).collect()
    assert {r.reason for r in kept} == {"malformed", "no lab_id"} and len(kept) == len(BAD)
    assert all(r.file.endswith("assay.csv") for r in kept)
    records = {r.record: r.reason for r in kept}
    assert {k: records[k] for k in BAD if BAD[k] == "malformed"} == {
        k: v for k, v in BAD.items() if v == "malformed"}
    io.read_assay(spark, path, fmt="csv", quarantine=aside)  # appended, nothing overwritten
    assert spark.read.parquet(aside).count() == 2 * len(BAD)


def test_no_subject_vanishes_unreported(spark, assay_csv, tmp_path):
    """Subjects read and subjects set aside are all subjects of the file."""
    path = assay_csv(*BAD)
    good, bad = io.read_checked(spark, path, io.ASSAY_LONG_SCHEMA, "lab_id")
    n_rows = len(open(path).read().strip().split("\n")) - 1
    assert good.count() + bad.count() == n_rows
    inp = StudyInputs.read(spark, path, _subjects(tmp_path), "csv", quarantine=str(tmp_path / "q"))
    assert {r.lab_id for r in inp.assay().collect()} == {1, 5, 8}
    assert spark.read.parquet(str(tmp_path / "q" / "assay")).count() == len(BAD)
    assert spark.read.parquet(str(tmp_path / "q" / "subjects")).count() == 0


def _subjects(tmp_path):
    path = tmp_path / "subjects.csv"
    path.write_text(",".join(f.name for f in io.SUBJECT_SCHEMA) + "\n1,PCR+,1.0,n/a,,,,,\n")
    return str(path)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    given = Inputs(spark, SF_SMALL)
    study = StudyInputs(given.assay_long(), given.subject(), given.parameters)
    names = study.write_catalog("cs_study", 4, str(tmp_path_factory.mktemp("catalog")))
    return given, StudyInputs.read_catalog(spark, *names, parameters=Parameters(
        cutoff=given.parameters.cutoff))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_catalog_gives_the_same_tables(catalog):
    given, stored = catalog
    for table in (reports.fig3a_distribution, reports.fig4b_spearman, reports.fig3b_strip,
                  reports.status_in_cohort, reports.signed_rank_pairs):
        assert rows(table(stored)) == rows(table(given))


def test_bucketed_tables_meet_without_an_exchange(spark, catalog):
    """Join of assay and subjects, per-subject aggregation and join of the
    titres: no exchange before the ranks of fig4b_spearman."""
    _, stored = catalog
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no side is small at scale
    try:
        points = reports.detected_with_titre(stored, "group5", reports.SEROPOSITIVE3, "roche")
        plan = points._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 1
        whole = reports.fig4b_spearman(stored)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(lab_id" not in whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filters_on_values_reach_the_scan(catalog):
    _, stored = catalog
    plan = stored.assay_long().filter("value > 0.5 and antigen = 'NC'")._jdf.queryExecution() \
        .executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
    assert "GreaterThan(value,0.5)" in pushed and "EqualTo(antigen,NC)" in pushed
