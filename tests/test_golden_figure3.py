"""FIXTURES §3.1/3.2: rebuild subjects from the published Figure 3 counts and
check that the detection tables give the counts back."""

from pyspark.sql import functions as F

from cohortspark.functions.labels import PANEL3, PANEL4, STUDY_CUTOFF
from cohortspark.operators import cohort as K

FIG3A = {  # group: n, counts of 0..3 detected
    "PCR+ Seropositive": (154, [9, 8, 35, 102]),
    "PCR+ Seronegative": (21, [5, 5, 5, 6]),
    "Exposed Seropositive": (54, [1, 5, 8, 40]),
    "Exposed Seronegative": (87, [62, 13, 6, 6]),
    "Controls": (80, [58, 18, 3, 1]),
}
FIG3B = {
    "PCR+ Seropositive": (83, [4, 3, 3, 19, 54]),
    "PCR+ Seronegative": (16, [3, 1, 1, 5, 6]),
    "Exposed Seropositive": (35, [0, 4, 2, 5, 24]),
    "Exposed Seronegative": (56, [39, 8, 5, 1, 3]),
    "Controls": (42, [32, 8, 1, 1, 0]),
}


def _subjects(table, panel):
    rows, lab = [], 0
    for group, (n, counts) in table.items():
        assert sum(counts) == n
        for j, c in enumerate(counts):
            for _ in range(c):
                lab += 1
                for i, a in enumerate(panel):
                    # first j analytes above the cutoff; one exactly at it
                    v = 100.0 if i < j else (STUDY_CUTOFF if i == j else 0.0)
                    rows.append((lab, group, a, v))
        # incomplete subjects (one analyte NULL, one missing) must not count
        lab += 1
        rows += [(lab, group, a, None if i == 0 else 500.0) for i, a in enumerate(panel)]
        lab += 1
        rows += [(lab, group, a, 500.0) for a in panel[1:]]
    # a subject without group
    lab += 1
    rows += [(lab, None, a, 500.0) for a in panel]
    return rows


def _check(spark, table, panel):
    df = spark.createDataFrame(_subjects(table, panel),
                               "lab_id long, group5 string, antigen string, value double")
    per = K.subject_panel(df, "lab_id", "group5", "antigen", "value", panel, STUDY_CUTOFF)
    dist = K.percent_of_group(K.distribution(per, "group5", "detected"), "group5")
    got = {(r.group5, r.detected): (r.n, r.prop) for r in dist.collect()}
    for group, (n, counts) in table.items():
        for j, c in enumerate(counts):
            if c:
                assert got[(group, j)][0] == c
                assert abs(got[(group, j)][1] - 100.0 * c / n) < 1e-9
            else:
                assert (group, j) not in got
    sizes = {r.group5: r.n_ind for r in
             K.cohort_sizes(df, "lab_id", "group5", "antigen", "value", panel).collect()}
    assert sizes == {g: n for g, (n, _) in table.items()}


def test_figure_3a_counts(spark):
    _check(spark, FIG3A, PANEL3)


def test_figure_3b_counts(spark):
    _check(spark, FIG3B, PANEL4)
    assert sum(n for n, _ in FIG3B.values()) == 232
    assert sum(n for n, _ in FIG3A.values()) == 396


def _study(spark, table, panel):
    from cohortspark.plans.context import StudyInputs
    rows = _subjects(table, panel)
    assay = spark.createDataFrame([(lab, a, v, None) for lab, _, a, v in rows],
                                  "lab_id long, antigen string, value double, visit_date date")
    subjects = spark.createDataFrame(sorted({(lab, g or "") for lab, g, _, _ in rows}),
                                     "lab_id long, g string")
    null = lambda t: F.lit(None).cast(t)
    subjects = subjects.select(
        "lab_id", null("string").alias("group3"), null("double").alias("roche"),
        null("string").alias("igg_raw"), null("string").alias("sero_roche"),
        null("string").alias("sero_igg"), null("date").alias("test_date"),
        F.when(F.col("g") != "", F.col("g")).alias("group5"), null("string").alias("group5b"))
    return StudyInputs(assay, subjects)


def test_reports_on_assay_files(spark, tmp_path):
    """The published tables from files, through the reports at the study's cutoff."""
    import pytest
    from cohortspark.plans import reports
    from cohortspark.plans.context import StudyInputs
    from cohortspark.sources.io import write_result
    for table, panel, report in ((FIG3A, PANEL3, reports.fig3a_distribution),
                                 (FIG3B, PANEL4, reports.fig3b_distribution)):
        made = _study(spark, table, panel)
        for fmt in ("parquet", "csv"):
            folder = str(tmp_path / f"{fmt}{len(panel)}")
            write_result(made.assays, folder + "/assay", fmt)
            write_result(made.subjects, folder + "/subjects", fmt)
            inp = StudyInputs.read(spark, folder + "/assay", folder + "/subjects", fmt)
            assert inp.parameters.cutoff == STUDY_CUTOFF
            got = {(r.group5, r.detected): (r.n, r.prop) for r in report(inp).collect()}
            assert got == {(g, j): (c, pytest.approx(100 * c / n, abs=1e-6))
                           for g, (n, counts) in table.items() for j, c in enumerate(counts) if c}
