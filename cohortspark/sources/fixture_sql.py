"""The fixture mapping written once as SQL common table expressions.

Every oracle query starts with :data:`FIXTURE_CTES` and reads the CTEs
``assay_raw``, ``assay_long``, ``subject`` and ``assay``.  The text is plain
ANSI SQL as DuckDB runs it; it mirrors :mod:`cohortspark.sources.fixture`.
Labels and limits come from the constants that the Spark side uses.
"""

from ..functions.labels import ANALYTE_SHORT_NAMES, COHORT_RULES, NEGATIVE, POSITIVE
from ..plans.sqltext import case_map, q
from .fixture import (IGG_MISSING_PRIORITY, IGG_POSITIVE_FROM, LINE_TO_RAW_LABEL,
                      ROCHE_MISSING_PRIORITY, ROCHE_POSITIVE_FROM, STATUS_TO_GROUP3,
                      VALUE_TAX_LIMIT)


def _cohort(status: str) -> str:
    whens = "\n              ".join(
        f"WHEN group3 = {q(g)}" + (f" AND {status} = {q(s)}" if s else "") + f" THEN {q(name)}"
        for g, s, name in COHORT_RULES)
    return f"CASE {whens} END"


def _status(value: str, positive_from: float, missing: str) -> str:
    return (f"CASE WHEN o_orderpriority = {q(missing)} THEN NULL\n"
            f"              WHEN {value} >= {positive_from!r} THEN {q(POSITIVE)}\n"
            f"              WHEN {value} < {positive_from!r} THEN {q(NEGATIVE)} END")


FIXTURE_CTES = f"""
WITH RECURSIVE assay_raw AS (
  SELECT l_orderkey AS lab_id,
         {case_map('l_linenumber', LINE_TO_RAW_LABEL)} AS antigen_raw,
         max(CASE WHEN l_tax < {VALUE_TAX_LIMIT!r} THEN l_extendedprice * l_discount END) AS value,
         CAST(min(l_shipdate) AS DATE) AS visit_date
  FROM lineitem
  GROUP BY 1, 2
),
assay_long AS (
  SELECT lab_id, {case_map('antigen_raw', ANALYTE_SHORT_NAMES)} AS antigen, value, visit_date
  FROM assay_raw
),
subject_base AS (
  SELECT o_orderkey AS lab_id,
         {case_map('o_orderstatus', STATUS_TO_GROUP3)} AS group3,
         o_totalprice AS roche,
         CASE WHEN o_orderpriority = {q(IGG_MISSING_PRIORITY)} THEN 'n/a'
              ELSE CAST(c_acctbal AS VARCHAR) END AS igg_raw,
         {_status('o_totalprice', ROCHE_POSITIVE_FROM, ROCHE_MISSING_PRIORITY)} AS sero_roche,
         {_status('c_acctbal', IGG_POSITIVE_FROM, IGG_MISSING_PRIORITY)} AS sero_igg,
         CAST(o_orderdate AS DATE) AS test_date
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
),
subject_status AS (
  SELECT *,
         CASE WHEN sero_roche = {q(POSITIVE)} OR sero_igg = {q(POSITIVE)} THEN {q(POSITIVE)}
              WHEN sero_roche = {q(NEGATIVE)} AND sero_igg = {q(NEGATIVE)} THEN {q(NEGATIVE)}
         END AS sero_combined
  FROM subject_base
),
subject AS (
  SELECT lab_id, group3, roche, igg_raw, sero_roche, sero_igg, test_date,
         {_cohort('sero_roche')} AS group5,
         {_cohort('sero_combined')} AS group5b
  FROM subject_status
),
assay AS (
  SELECT a.lab_id, a.antigen, a.value, a.visit_date,
         s.group3, s.roche, s.igg_raw, s.sero_roche, s.sero_igg, s.test_date,
         s.group5, s.group5b
  FROM assay_long a LEFT JOIN subject s ON a.lab_id = s.lab_id
)"""


def with_fixture(sql_tail: str) -> str:
    """Prefix a query with the fixture CTEs.

    ``sql_tail`` is either a final SELECT or more CTEs starting with a comma.
    """
    tail = sql_tail.strip()
    if tail.startswith(","):
        return FIXTURE_CTES + tail
    return FIXTURE_CTES + "\n" + tail
