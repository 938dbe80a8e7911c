"""Per-subject summaries: complete-case cohorts and detection counts.

The reference re-derives the same complete-case cohort many times through
spread -> filter -> gather.  Here one aggregation by (subject, group) yields
every required analyte, the completeness test and the detected count at
once.  When the input is already hash-partitioned by the subject key (e.g.
it came out of a join on that key) the aggregation adds no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .reshape import spread_columns


def subject_panel(df: DataFrame, id_col: str, group: str | None, key: str,
                  value: str, required: Sequence[str], cutoff: float,
                  detected: str = "detected") -> DataFrame:
    """One row per complete subject: (id, group, detected).

    Keeps subjects with a non-NULL value for every ``required`` analyte and
    counts how many of them lie strictly above ``cutoff``.  A duplicate
    (subject, analyte) raises, as tidyr's spread does.
    """
    required = list(required)
    cols = [f"__a{i}" for i in range(len(required))]
    ids = [id_col] + ([group] if group else [])
    src = df.filter(F.col(key).isin(required))
    if group:
        src = src.filter(F.col(group).isNotNull())
    wide = src.groupBy(*ids).agg(*spread_columns(key, value, required, cols))
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    hits = " + ".join(f"CAST({c} > {C.literal(float(cutoff))} AS INT)" for c in cols)
    return wide.filter(complete).select(*ids, F.expr(f"CAST({hits} AS BIGINT)").alias(detected))


def detected_any(df: DataFrame, id_col: str, group: str, key: str, value: str,
                 analytes: Sequence[str], cutoff: float,
                 detected: str = "detected") -> DataFrame:
    """Detected count per subject over whatever analytes it has (no
    complete-case step): the contingency input of the reference."""
    flag = C.flag_above(value, cutoff)
    return (df.filter(F.col(group).isNotNull() & F.col(key).isin(list(analytes))
                      & F.col(value).isNotNull())
            .groupBy(id_col, group).agg(F.sum(flag).cast("bigint").alias(detected)))


def cohort_sizes(df: DataFrame, id_col: str, group: str, key: str, value: str,
                 required: Sequence[str], name: str = "n_ind") -> DataFrame:
    """Complete-case subjects per group (E10)."""
    panel = subject_panel(df, id_col, group, key, value, required, cutoff=0.0)
    return panel.groupBy(group).agg(F.count(F.lit(1)).alias(name))


def distribution(per_subject: DataFrame, group: str, count_col: str,
                 name: str = "n") -> DataFrame:
    """Subjects per (group, count): the aggregate of an aggregate (E4)."""
    return per_subject.groupBy(group, count_col).agg(F.count(F.lit(1)).alias(name))


def percent_of_group(df: DataFrame, group: str, n: str = "n",
                     name: str = "prop", total: str | None = None) -> DataFrame:
    """``n / sum(n) * 100`` inside each group (G1); ``total`` also keeps the
    group sum as a column.

    The input is a distribution table (groups x distinct counts), so the
    window per group is small; the per-subject rows never reach it.
    """
    from pyspark.sql import Window
    s = F.sum(n).over(Window.partitionBy(group))
    if total:
        df = df.withColumn(total, s)
        s = F.col(total)
    return df.withColumn(name, F.col(n) / s * F.lit(100.0))


def label_counts(df: DataFrame, ids: Sequence[str], label: str,
                 name: str = "n") -> DataFrame:
    """Rows per (ids..., label) (E5)."""
    return df.groupBy(*ids, label).agg(F.count(F.lit(1)).alias(name))


def binned_sums(dist: DataFrame, group: str, count_col: str, bins,
                n: str = "n", name: str = "n2", bin_col: str = "detected_bin") -> DataFrame:
    """Re-aggregate a distribution into labelled bins (B7 + E6)."""
    return (dist.withColumn(bin_col, C.bin_count(count_col, bins))
            .groupBy(group, bin_col).agg(F.sum(n).cast("bigint").alias(name)))


def detected_zero_filled(df: DataFrame, id_col: str, group: str, key: str, value: str,
                         required: Sequence[str], cutoff: float, name: str = "n",
                         above: str = "Above") -> DataFrame:
    """Per complete subject, the number of analytes labelled Above, 0 when
    none is (H5: label -> count -> spread -> gather -> fill 0 -> keep Above).

    The complete-case step and the count share the (id, group) partitioning,
    so the second aggregation adds no exchange.  Unlike the reference, a data
    set where nobody is Above gives zeros rather than an empty table.
    """
    from .reshape import complete_cases
    cc = complete_cases(df.filter(F.col(group).isNotNull()), [id_col, group], key, value,
                        required)
    lab = C.label_above(value, cutoff)
    return (cc.filter(lab.isNotNull())
            .groupBy(id_col, group)
            .agg(F.count(F.when(lab == above, F.lit(1))).cast("bigint").alias(name)))


def subject_summary(df: DataFrame, id_col: str, group: str | None, key: str, value: str,
                    panels: dict[str, Sequence[str]], cutoff: float,
                    names: dict[str, str] | None = None) -> DataFrame:
    """One row per subject with every analyte of every panel, and per panel
    ``complete_<p>`` and ``detected_<p>`` (NULL when incomplete).

    A single aggregation serves all figures that read complete-case panels;
    written once (e.g. with :func:`cohortspark.session.cut_lineage`), it can
    feed several of them without re-reading the assay table.
    """
    analytes = sorted({a for p in panels.values() for a in p})
    names = names or {a: a for a in analytes}
    src = df.filter(F.col(key).isin(analytes))
    ids = [id_col] + ([group] if group else [])
    if group:
        src = src.filter(F.col(group).isNotNull())
    wide = src.groupBy(*ids).agg(*spread_columns(key, value, analytes,
                                                 [names[a] for a in analytes]))
    cols = [F.col(c) for c in wide.columns]
    for p, members in panels.items():
        complete = None
        hits = None
        for a in members:
            nn = F.col(names[a]).isNotNull()
            complete = nn if complete is None else complete & nn
            h = C.flag_above(names[a], cutoff)
            hits = h if hits is None else hits + h
        cols.append(complete.alias(f"complete_{p}"))
        cols.append(F.when(complete, hits.cast("bigint")).alias(f"detected_{p}"))
    return wide.select(*cols)
