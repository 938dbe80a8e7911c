"""All tables of Figures 3 and 4 from one fold of the assay.

The study recomputes the complete-case cohort for every figure.  Here the
assay is read and folded by subject once; one row per subject, with its value
of every analyte, is stored in the shared folder, and every named table is
made from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.labels import ANALYTE_SHORT_NAMES
from ..operators.reshape import spread
from ..session import ensure_checkpoint_dir
from ..sources.io import write_result
from .context import Parameters, Tables

ANALYTES = list(ANALYTE_SHORT_NAMES.values())


def fold_subjects(inp: Tables, analytes: Sequence[str] | None = None) -> DataFrame:
    """One row per subject: its attributes and a column of each analyte's
    value (``v0``, ``v1``, ...).  Subjects without any value of them are kept;
    a repeated (subject, analyte) raises."""
    analytes = list(analytes or ANALYTES)
    long = inp.assay_long().filter(F.col("antigen").isin(analytes))
    wide = spread(long, ["lab_id"], "antigen", "value", analytes)
    wide = wide.withColumnsRenamed({a: f"v{i}" for i, a in enumerate(analytes)})
    return inp.subject().join(wide, "lab_id", "left")


@dataclass
class SubjectTable(Tables):
    """A stored fold as the input of the named tables.

    The long assay is its unpivoted values; dates of visits are not in it, so
    the kinetics tables need the study itself.
    """

    rows: DataFrame
    parameters: Parameters
    analytes: Sequence[str] = field(default_factory=lambda: list(ANALYTES))

    def _value(self, analyte: str, mapping: Mapping[str, str] | None) -> F.Column:
        """The column of an analyte, named as ``mapping`` names raw labels."""
        if mapping:
            analyte = {name: ANALYTE_SHORT_NAMES.get(raw, raw) for raw, name in mapping.items()}[
                analyte]
        return F.col(f"v{list(self.analytes).index(analyte)}")

    def subject(self) -> DataFrame:
        return self.rows.drop(*(f"v{i}" for i in range(len(self.analytes))))

    def assay(self, mapping=None) -> DataFrame:
        names = {a: a for a in self.analytes}
        if mapping:
            names = {ANALYTE_SHORT_NAMES.get(raw, raw): name for raw, name in mapping.items()}
        cells = F.array(*(F.struct(F.lit(names.get(a)).alias("antigen"),
                                   F.col(f"v{i}").alias("value"))
                          for i, a in enumerate(self.analytes)))
        subject = self.subject().columns
        return (self.rows.select(*subject, F.explode(cells).alias("__c"))
                .select(*subject, "__c.antigen", "__c.value").filter(F.col("value").isNotNull()))

    def panel(self, group, required, cutoff, detected="detected", mapping=None):
        values = [self._value(a, mapping) for a in required]
        keep, hits = F.col(group).isNotNull(), F.lit(0)
        for v in values:
            keep, hits = keep & v.isNotNull(), hits + (v > cutoff).cast("int")
        return self.rows.filter(keep).select("lab_id", group, hits.cast("bigint").alias(detected))

    def detected_any(self, group, analytes, cutoff):
        values = [self._value(a, None) for a in analytes]
        some, hits = F.lit(False), F.lit(0)
        for v in values:
            some = some | v.isNotNull()
            hits = hits + F.coalesce((v > cutoff).cast("int"), F.lit(0))
        return self.rows.filter(F.col(group).isNotNull() & some).select(
            "lab_id", group, hits.cast("bigint").alias("detected"))


def store_subjects(spark: SparkSession, inp: Tables, path: str | None = None) -> SubjectTable:
    """Fold the study by subject, write the fold to ``path`` (by default a new
    folder of the shared one) and return it as an input."""
    path = path or f"{ensure_checkpoint_dir(spark)}/subjects-{uuid.uuid4().hex}"
    folded = fold_subjects(inp)
    folded.write.parquet(path)
    return SubjectTable(spark.read.schema(folded.schema).parquet(path), inp.parameters)


# The named tables that a stored fold gives, in the order of the figures.
TABLES = [
    "fig3a_distribution", "fig3_chi_square", "contingency_2x2", "fig3b_strip", "fig3b_distribution",
    "status_in_cohort", "regrouped_fig3a_distribution", "regrouped_fig3_chi_square",
    "regrouped_contingency_2x2", "regrouped_fig3b_strip", "regrouped_fig3b_distribution",
    "fig3a_localized", "fig4a_correlation", "fig4a_titre2", "fig4b_spearman", "regrouped_fig4b",
    "regrouped_fig4c"]


def write_tables(spark: SparkSession, inp: Tables, out: str, keys: Sequence[str] = TABLES,
                 fmt: str = "parquet") -> dict[str, str]:
    """Write the named tables to folders of ``out`` from one read of the
    assay; returns each table's folder."""
    from .registry import BUILDERS
    if unknown := set(keys) - set(TABLES):
        raise ValueError(f"not tables of a stored fold: {sorted(unknown)}")
    stored = store_subjects(spark, inp)
    written = {}
    for key in keys:
        written[key] = f"{out.rstrip('/')}/{key}"
        write_result(BUILDERS[key](stored), written[key], fmt)
    return written


def distributions(spark: SparkSession, inp: Tables) -> DataFrame:
    """The four distributions of detected analytes, one under the other, from
    one stored fold: (name, cohort, detected, n, prop)."""
    from .registry import BUILDERS
    stored = store_subjects(spark, inp)
    out = None
    for name in ("fig3a_distribution", "fig3b_distribution", "regrouped_fig3a_distribution",
                 "regrouped_fig3b_distribution"):
        part = BUILDERS[name](stored)
        part = part.select(F.lit(name).alias("name"), F.col(part.columns[0]).alias("cohort"),
                           "detected", "n", "prop")
        out = part if out is None else out.unionByName(part)
    return out
