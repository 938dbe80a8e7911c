"""Counts, medians, category order and per-facet sizes.

Exact medians are found by selection: an approximate percentile brackets the
middle of a large group, and only the bracket is put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ranks import row_positions

MEDIAN_ACCURACY = 100_000  # of the percentiles that bracket a median


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group; a NULL key is a group of its own (E1)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_group_total(counts: DataFrame, keys: Sequence[str], n: str, name: str) -> DataFrame:
    """Counts with their group's total beside them: the total is the sum of a
    group's few counts, so the rows behind them are read once."""
    return counts.withColumn(name, F.sum(n).over(Window.partitionBy(*keys)))


def zero_counts(df: DataFrame, keys: Sequence[str], raw_value: str,
                zero: str = "zero", name: str = "n") -> DataFrame:
    """Rows per (keys, zero flag), the flag taken from the raw value (E2)."""
    return (df.withColumn(zero, C.flag_zero(raw_value))
            .groupBy(*keys, zero).agg(F.count(F.lit(1)).alias(name)))


def n_per_panel(df: DataFrame, keys: Sequence[str], value: str,
                name: str = "n") -> DataFrame:
    """Non-missing values per facet and x position (E9)."""
    return df.groupBy(*keys).agg(F.count(value).alias(name))


def _middle_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., n, lo, hi): the two middle order statistics of ``value``.

    A group above an even share of the shuffle partitions (there are at most as
    many of them) is bracketed by two approximate percentiles around the
    middle: where its rows are, values below the bracket become one NULL value
    that stands first, those above go, and only the bracket, a few
    hundred-thousandths of the group, is folded, shuffled and put in order.
    The count below and the group's size place the bracket, so the result is
    exact.  Smaller groups are put in order whole, each in its own task.
    """
    keys = list(keys)
    src = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    margin = 3 / MEDIAN_ACCURACY  # the percentiles are off by 1 / MEDIAN_ACCURACY at most
    groups = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(
        "__v", [0.5 - margin, 0.5 + margin], MEDIAN_ACCURACY).alias("__b"))
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = groups.agg(F.sum("__n")).scalar()
    large = groups.filter(F.col("__n") * F.lit(slots) > total).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__n").alias("__of"),
        F.get("__b", F.lit(0)).alias("__low"), F.get("__b", F.lit(1)).alias("__high"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    met = src.join(F.broadcast(large), same, "left")
    inside = F.col("__of").isNull() | (F.col("__v") <= F.col("__high"))
    below = F.col("__of").isNotNull() & (F.col("__v") < F.col("__low"))
    hist = (met.filter(inside).withColumn("__v", F.when(~below, F.col("__v")))
            .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"), F.max("__of").alias("__of")))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumns({
        "__last": F.sum("__c").over(upto),
        "__n": F.coalesce(F.max("__of").over(group), F.sum("__c").over(group))})
    at = lambda k: F.min(F.when(F.col("__last") >= k, F.col("__v")))
    return (ranked.filter(F.col("__v").isNotNull()).groupBy(*keys)
            .agg(F.max("__n").alias("n"),
                 at(F.floor((F.col("__n") + 1) / 2)).alias("lo"),
                 at(F.floor(F.col("__n") / 2) + 1).alias("hi")))


def median_exact(df: DataFrame, keys: Sequence[str], value: str,
                 name: str = "median") -> DataFrame:
    """Exact median per group (mean of the two middle values when even; E7)."""
    m = _middle_values(df, keys, value)
    return m.select(*keys, ((F.col("lo") + F.col("hi")) / 2.0).alias(name))


def median_log2(df: DataFrame, keys: Sequence[str], value: str,
                name: str = "median") -> DataFrame:
    """Median as drawn on a log2 axis: the statistic is taken on log2(value)
    and mapped back, i.e. the geometric mean of the two middle values (E8).
    Values must be positive (floor zeros first)."""
    m = _middle_values(df.filter(F.col(value) > 0), keys, value)
    return m.select(*keys, F.pow(F.lit(2.0), (F.log2("lo") + F.log2("hi")) / 2.0).alias(name))


def category_order(df: DataFrame, category: str, position: str | Sequence[str],
                   reverse: bool = False, name: str = "level",
                   slice_by: str | None = None) -> DataFrame:
    """Levels in order of first appearance (``fct_inorder``), optionally
    reversed (``fct_rev``): (category, first_position, level).

    ``position`` is a numeric column, or several that together order the rows,
    such as the file and the row's number in it; categories that first appear
    at the same place follow by name.  ``first_position`` is the column
    ``slice_by`` at that place, which is numeric (by default the first one).
    """
    cols = [position] if isinstance(position, str) else list(position)
    main = slice_by or cols[0]
    firsts = df.groupBy(category).agg(F.min(F.struct(*cols)).alias("__first"))
    firsts = firsts.select(category, F.col("__first")[main].alias("first_position"),
                           *[F.col("__first")[c].alias(f"__p{i}") for i, c in enumerate(cols)])
    ranked = row_positions(firsts, [], [*(f"__p{i}" for i in range(len(cols))), category],
                           out=name, total="__size", slice_by=f"__p{cols.index(main)}")
    if reverse:
        ranked = ranked.withColumn(name, F.col("__size") + 1 - F.col(name))
    return ranked.select(category, "first_position", F.col(name).cast("bigint").alias(name))


def rank_strip(df: DataFrame, group: str, n: str, id_col: str, name: str = "position",
               size: str | None = None) -> DataFrame:
    """Position of each subject inside its group ordered by ``n`` then id
    (``reorder(id, n)`` per facet; G2), computed without a per-group task;
    ``size`` names a column for the group's number of subjects."""
    return row_positions(df, [group], [n, id_col], out=name, total=size)
