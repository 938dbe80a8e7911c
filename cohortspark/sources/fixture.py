"""Assay tables derived from the driver's star-schema tables.

The study data itself is not public.  The test tables are mapped onto the
study's data model (see FIXTURES.md §2):

* ``assay_raw``   one row per (subject, raw analyte label) from ``lineitem``
* ``assay_long``  the same with analyte labels recoded (unknown label -> NULL)
* ``subject``     one row per subject from ``orders`` left-joined to ``customer``
* ``assay``       ``assay_long`` left-joined to ``subject`` (the long table the
                  analyses start from)

Everything is lazy DataFrame code; Catalyst prunes the scans to the columns
each query needs and pushes filters into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.labels import (ANALYTE_SHORT_NAMES, COHORT_RULES, NEGATIVE,
                                POSITIVE)
from .io import nan_to_null

# --- fixed values: the fixture mapping (FIXTURES.md §2) --------------------
LINE_TO_RAW_LABEL = {
    1: "Capsid sub x5",
    2: "Membrane sub x5",
    3: "SCT sub x5",
    4: "SNT sub x5",
    5: "grün sbu x5",
    6: "yellow sub x5",
    7: "unlisted sub x5",
}
STATUS_TO_GROUP3 = {"F": "PCR+", "O": "Exposed", "P": "Controls"}
FIXTURE_CUTOFF = 2000.0          # stands in for the study cutoff of 40
VALUE_TAX_LIMIT = 0.08           # line values with tax >= this are missing
ROCHE_POSITIVE_FROM = 250000.0   # o_totalprice >= this -> Positive
IGG_POSITIVE_FROM = 4500.0       # c_acctbal >= this -> Positive
IGG_MISSING_PRIORITY = "3-MEDIUM"
ROCHE_MISSING_PRIORITY = "5-LOW"


# The test tables' columns, as far as they are used.
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, "
                "l_discount double, l_tax double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_acctbal double",
    "events": "user_id long, event_type string, value double",
    "labels": "quality int, toxic int",
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as it is now, by its declared schema: no file is opened
    while a plan is built, and the listing is made anew for every query."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table with NaN as missing, as everywhere (``io.nan_to_null``)."""
    return nan_to_null(scan(spark, sf_dir, name))


def _map_int(c, mapping):
    if isinstance(c, str):
        return C.recode(c, mapping)
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def assay_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assay_raw_of(read_table(spark, sf_dir, "lineitem"))


def assay_raw_of(li: DataFrame) -> DataFrame:
    """(lab_id, antigen_raw, value, visit_date); one row per subject x label.

    ``lineitem`` repeats (order, line) keys, so the mapping aggregates; the
    partial aggregate runs before the shuffle, so a hot key is folded on the
    map side.
    """
    # group on the integer line number (cheap to hash) and label afterwards;
    # filters on the label still reach below the aggregation, since they
    # only use a grouping column
    agg = (li.groupBy(F.col("l_orderkey").alias("lab_id"), "l_linenumber")
           .agg(F.expr(f"max(CASE WHEN l_tax < {C.literal(VALUE_TAX_LIMIT)} "
                       "THEN l_extendedprice * l_discount END) AS value"),
                F.expr("CAST(min(l_shipdate) AS DATE) AS visit_date")))
    return agg.select("lab_id",
                      _map_int("l_linenumber", LINE_TO_RAW_LABEL).alias("antigen_raw"),
                      "value", "visit_date")


def assay_long(spark: SparkSession, sf_dir: str, mapping=None) -> DataFrame:
    """(lab_id, antigen, value, visit_date) with analyte labels recoded."""
    raw = assay_raw(spark, sf_dir)
    return raw.select("lab_id",
                      C.recode("antigen_raw", mapping or ANALYTE_SHORT_NAMES).alias("antigen"),
                      "value", "visit_date")


def subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject with groups, titres and serostatus."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    low, positive, negative = (C.literal(v) for v in (ROCHE_POSITIVE_FROM, POSITIVE, NEGATIVE))
    missing = f"o_orderpriority = {C.literal(IGG_MISSING_PRIORITY)}"
    base = j.select(
        F.col("o_orderkey").alias("lab_id"),
        C.recode("o_orderstatus", STATUS_TO_GROUP3).alias("group3"),
        F.col("o_totalprice").alias("roche"),
        F.expr(f"CASE WHEN {missing} THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS igg_raw"),
        F.expr(f"CASE WHEN o_orderpriority = {C.literal(ROCHE_MISSING_PRIORITY)} THEN NULL "
               f"WHEN o_totalprice >= {low} THEN {positive} "
               f"WHEN o_totalprice < {low} THEN {negative} END AS sero_roche"),
        F.expr(f"CASE WHEN {missing} THEN NULL "
               f"WHEN c_acctbal >= {C.literal(IGG_POSITIVE_FROM)} THEN {positive} "
               f"WHEN c_acctbal < {C.literal(IGG_POSITIVE_FROM)} THEN {negative} END AS sero_igg"),
        F.expr("CAST(o_orderdate AS DATE) AS test_date"),
    )
    return (base
            .withColumn("group5", C.assign_cohort("group3", "sero_roche", COHORT_RULES))
            .withColumn("group5b", C.assign_cohort(
                "group3", C.combine_status("sero_roche", "sero_igg"), COHORT_RULES)))


def assay(spark: SparkSession, sf_dir: str, mapping=None) -> DataFrame:
    """The long analysis table: assay rows with their subject's attributes."""
    return assay_long(spark, sf_dir, mapping).join(subject(spark, sf_dir), "lab_id", "left")
