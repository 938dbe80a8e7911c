"""Scans with declared schemas, and result sinks (A1, A3).

The study loads two in-memory tables from one binary image; here the same
two tables are plain columnar files read with a declared schema (no
inference pass over the data), and results are written as CSV (what the
study's commented-out ``write.csv`` calls produce) or parquet.

A text row that does not fit the schema is never read as NULL in silence: it
fails the job with its file and text, or goes to a quarantine table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, FloatType, LongType, StringType,
                               StructField, StructType)

from ..functions.columns import name

ASSAY_LONG_SCHEMA = StructType([
    StructField("lab_id", LongType(), False),
    StructField("antigen", StringType(), True),
    StructField("value", DoubleType(), True),
    StructField("visit_date", DateType(), True),
])

SUBJECT_SCHEMA = StructType([
    StructField("lab_id", LongType(), False),
    StructField("group3", StringType(), True),
    StructField("roche", DoubleType(), True),
    StructField("igg_raw", StringType(), True),
    StructField("sero_roche", StringType(), True),
    StructField("sero_igg", StringType(), True),
    StructField("test_date", DateType(), True),
    StructField("group5", StringType(), True),
    StructField("group5b", StringType(), True),
])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in a floating-point column is a missing value: NULL from here on."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.expr(f"CASE WHEN NOT isnan({name(c)}) THEN {name(c)} END")
                           for c in floats}) if floats else df


_RECORD = "_corrupt_record"


def _text_rows(spark: SparkSession, path: str, schema: StructType, key: str | None,
               **options) -> DataFrame:
    """CSV rows with file, record and reason beside them; reason is NULL for a
    row that fits the schema and, if a ``key`` is named, has one.

    Every row is parsed whole, whatever columns are used later, so a row is
    malformed in every query or in none: a number or date that cannot be read,
    too few or too many fields, an open quote.  An empty field is a NULL.
    """
    if _RECORD in schema.names:
        raise ValueError(f"{_RECORD} is the name of the unparsed record")
    options = {"header": "true", **options, "mode": "PERMISSIVE", "columnPruning": "false",
               "columnNameOfCorruptRecord": _RECORD}
    rows = (spark.read.schema(StructType([*schema.fields, StructField(_RECORD, StringType())]))
            .options(**options).csv(path))
    reason = F.when(F.col(_RECORD).isNotNull(), F.lit("malformed"))
    if key:
        reason = reason.when(F.col(key).isNull(), F.lit(f"no {key}"))
    fields = F.to_csv(F.struct(*schema.names))
    return rows.select(*schema.names, F.col("_metadata.file_path").alias("__file"),
                       F.coalesce(_RECORD, fields).alias("__record"), reason.alias("__reason"))


def read_checked(spark: SparkSession, path: str, schema: StructType, key: str | None = None,
                 **options) -> tuple[DataFrame, DataFrame]:
    """The CSV rows that fit the schema, and the rejected ones as (file,
    record, reason).  Both are lazy; together they hold every row."""
    rows = _text_rows(spark, path, schema, key, **options)
    good = rows.filter(F.col("__reason").isNull()).select(*schema.names)
    bad = rows.filter(F.col("__reason").isNotNull()).select(
        F.col("__file").alias("file"), F.col("__record").alias("record"),
        F.col("__reason").alias("reason"))
    return nan_to_null(good), bad


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               fmt: str = "parquet", key: str | None = None, quarantine: str | None = None,
               **options) -> DataFrame:
    """Read a table with a declared schema; CSV gets a header by default.
    NaN is read as missing.

    With a schema, a CSV row that does not fit it, or lacks its ``key``, fails
    the job that meets it; the error names the file and the record.  With a
    ``quarantine`` folder such rows are appended there as Parquet (file,
    record, reason) in a job of its own, and left out.
    """
    if fmt == "csv" and schema is not None:
        if quarantine:
            good, bad = read_checked(spark, path, schema, key, **options)
            bad.write.mode("append").parquet(quarantine)
            return good
        rows = _text_rows(spark, path, schema, key, **options)
        fits = F.when(F.col("__reason").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(
            " ", F.lit("rejected row"), F.concat(F.lit("("), "__reason", F.lit(")")), F.lit("in"),
            "__file", F.concat(F.lit(": "), "__record"))).cast("boolean"))
        return nan_to_null(rows.filter(fits).select(*schema.names))
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        options.setdefault("header", "true")
    return nan_to_null(reader.options(**options).load(path))


def read_positioned(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table with each row's place: ``file_path`` and ``row_index``,
    the row's number in its file.  Files follow each other by their paths, as
    they do in a listing, so (file_path, row_index) is the order of the data."""
    rows = spark.read.schema(schema).parquet(path)
    return nan_to_null(rows.select("*", "_metadata.file_path", "_metadata.row_index"))


def read_assay(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return read_table(spark, path, ASSAY_LONG_SCHEMA, fmt, key="lab_id", **options)


def read_subjects(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return read_table(spark, path, SUBJECT_SCHEMA, fmt, key="lab_id", **options)


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 **options) -> None:
    """Write a result table; CSV with a header line.  The result tables are
    small, but nothing here funnels them through the driver or one task."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        options.setdefault("header", "true")
    writer.options(**options).save(path)


def write_bucketed(df: DataFrame, table: str, by: list[str], buckets: int,
                   path: str | None = None, mode: str = "overwrite") -> None:
    """Write ``df`` as a catalog table bucketed (and sorted) by ``by``.

    The long assay table is read by every per-subject aggregation; stored
    bucketed by the subject key, those aggregations (and joins with a subject
    table bucketed the same way) read co-located buckets instead of
    shuffling.  ``path`` should point at shared storage on a cluster.
    """
    w = df.write.mode(mode).format("parquet").bucketBy(buckets, *by).sortBy(*by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
