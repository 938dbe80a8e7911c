"""Row-wise preparation of assay rows, for batch and streaming frames.

The study has no streaming part.  Its row-level steps (recode, zero floor,
threshold flag and label, zero flag) are plain column expressions, so they
apply unchanged to a ``readStream`` source; this module only packages them
and the file-stream source.  Everything that groups (cohorts, ranks, tests)
stays batch, as in the study.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.io import ASSAY_LONG_SCHEMA, nan_to_null


def prepare_assay_rows(df: DataFrame, cutoff: float, floor: float,
                       mapping: Mapping[str, str] | None = None,
                       label_col: str = "antigen") -> DataFrame:
    """Add floored value, detection flag/label and zero flag to each row."""
    out = df
    if mapping is not None:
        out = out.withColumn(label_col, C.recode(label_col, mapping))
    return (out.withColumn("zero", C.flag_zero("value"))
            .withColumn("value_floored", C.floor_zeros("value", floor))
            .withColumn("flag", C.flag_above("value", cutoff))
            .withColumn("label", C.label_above("value", cutoff)))


def assay_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of assay rows with the declared long-table schema."""
    r = spark.readStream.schema(ASSAY_LONG_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return nan_to_null(r.load(path))


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A streaming checkpoint folder under the session's checkpoint dir."""
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/streams/{name}"


def detected_above_counts(df: DataFrame) -> DataFrame:
    """Running count of rows above the cutoff per analyte (complete mode)."""
    return df.groupBy("antigen").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum("flag").cast("bigint").alias("n_above"))
