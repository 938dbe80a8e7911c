"""Inputs shared by the named result tables: two tables and the parameters.

``Inputs(spark, sf_dir)`` maps the test tables onto the study's data model;
``StudyInputs`` takes an assay table and a subject table, as DataFrames or as
paths read with the declared schemas.  Cutoff, floors and analyte panels are
fields of either, and every result table takes them from there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.labels import (PANEL3, PANEL3_LOCALIZED, PANEL4, PLOT_FLOOR, STUDY_CUTOFF,
                                TEST_FLOOR)
from ..operators import cohort as K
from ..sources import fixture, io


@dataclass
class Parameters:
    """What a study sets: the detection cutoff (strictly above it counts),
    the values that stand for zero, and the analyte panels."""

    cutoff: float = STUDY_CUTOFF
    plot_floor: float = PLOT_FLOOR
    test_floor: float = TEST_FLOOR
    panel3: Sequence[str] = field(default_factory=lambda: list(PANEL3))
    panel4: Sequence[str] = field(default_factory=lambda: list(PANEL4))
    panel3_localized: Sequence[str] = field(default_factory=lambda: list(PANEL3_LOCALIZED))


class Tables:
    """What both kinds of input share; they provide assay_long and subject."""

    def assay(self, mapping=None) -> DataFrame:
        return self.assay_long(mapping).join(self.subject(), "lab_id", "left")

    def panel(self, group: str, required: Sequence[str], cutoff: float,
              detected: str = "detected", mapping=None) -> DataFrame:
        """(lab_id, group, detected) of the subjects with every required analyte."""
        return K.subject_panel(self.assay(mapping), "lab_id", group, "antigen", "value", required,
                               cutoff, detected)

    def detected_any(self, group: str, analytes: Sequence[str], cutoff: float) -> DataFrame:
        """(lab_id, group, detected) of the subjects with any of the analytes."""
        return K.detected_any(self.assay(), "lab_id", group, "antigen", "value", analytes, cutoff)

    def titres(self) -> DataFrame:
        """(lab_id, roche, igg) with the text titre cast to a number."""
        return self.subject().select("lab_id", "roche", C.to_number("igg_raw").alias("igg"))


@dataclass
class Inputs(Tables):
    """The test tables of one folder.

    The subject table is planned once for an input; a query makes its own
    input, so it sees the files as they are when it is built."""

    spark: SparkSession
    sf_dir: str
    parameters: Parameters = field(
        default_factory=lambda: Parameters(cutoff=fixture.FIXTURE_CUTOFF))
    _planned: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def table(self, name: str) -> DataFrame:
        return fixture.read_table(self.spark, self.sf_dir, name)

    def assay_raw(self) -> DataFrame:
        return fixture.assay_raw(self.spark, self.sf_dir)

    def assay_long(self, mapping=None) -> DataFrame:
        return fixture.assay_long(self.spark, self.sf_dir, mapping)

    def subject(self) -> DataFrame:
        if "subject" not in self._planned:
            self._planned["subject"] = fixture.subject(self.spark, self.sf_dir)
        return self._planned["subject"]


@dataclass
class StudyInputs(Tables):
    """Real assay data: ``assay`` (lab_id, antigen, value, visit_date) and
    ``subjects`` (see ``sources.io``).  NaN is missing.  A ``mapping`` given to
    a result table recodes the antigen labels; labels outside it become NULL.
    """

    assays: DataFrame
    subjects: DataFrame
    parameters: Parameters = field(default_factory=Parameters)
    clean: bool = False  # stored without NaN: filters on values reach the scan

    @classmethod
    def read(cls, spark: SparkSession, assay_path: str, subject_path: str, fmt: str = "parquet",
             parameters: Parameters | None = None, quarantine: str | None = None,
             **options) -> "StudyInputs":
        """Two files or folders.  CSV rows that do not fit the schemas, or have
        no subject, fail the job that meets them, or go to ``quarantine``/assay
        and ``quarantine``/subjects."""
        aside = lambda name: quarantine and f"{quarantine.rstrip('/')}/{name}"
        return cls(io.read_assay(spark, assay_path, fmt, quarantine=aside("assay"), **options),
                   io.read_subjects(spark, subject_path, fmt, quarantine=aside("subjects"), **options),
                   parameters or Parameters())

    @classmethod
    def read_catalog(cls, spark: SparkSession, assay_table: str, subject_table: str,
                     parameters: Parameters | None = None) -> "StudyInputs":
        """Two catalog tables, such as ``write_catalog`` makes: bucketed by
        subject, so joins and aggregations by subject need no exchange."""
        return cls(spark.table(assay_table), spark.table(subject_table), parameters or Parameters(),
                   clean=True)

    def write_catalog(self, prefix: str, buckets: int, path: str | None = None) -> tuple[str, str]:
        """Store both tables bucketed by subject, NaN as NULL, and return their
        names, ``prefix``_assay and ``prefix``_subjects."""
        names = f"{prefix}_assay", f"{prefix}_subjects"
        for name, df in zip(names, (self.assay_long(), self.subject())):
            io.write_bucketed(df, name, ["lab_id"], buckets, path and f"{path.rstrip('/')}/{name}")
        return names

    def assay_raw(self) -> DataFrame:
        return self.assays.withColumnRenamed("antigen", "antigen_raw")

    def assay_long(self, mapping=None) -> DataFrame:
        a = self.assays if self.clean else io.nan_to_null(self.assays)
        return a.withColumn("antigen", C.recode("antigen", mapping)) if mapping else a

    def subject(self) -> DataFrame:
        return self.subjects if self.clean else io.nan_to_null(self.subjects)


def r6(c) -> "F.Column":
    """Round a double result to 6 places (float summation order differs
    between engines; the oracle rounds the same way)."""
    return F.round(c if not isinstance(c, str) else F.col(c), 6)
