"""Distributed ranks: value histograms with exact cumulative counts.

A ``rank()`` window partitioned by stratum sends a whole stratum (an
analyte, a cohort, or everything) to one task.  Here ranks come from the
value histogram instead:

1. ``groupBy(strata, value).count()`` - partial aggregation folds repeated
   values (e.g. thousands of floored zeros) before the shuffle;
2. cut points over the histogram's values, taken once as a scalar subquery,
   put every value into a slice.  A slice holds about the same number of
   distinct values over all strata, so the part of any one stratum in a slice
   is never larger;
3. a window per (stratum, slice) gives the running count inside the slice;
4. slice totals (strata x slices rows) turn into offsets with a window over
   them, joined back.

The slice depends on the value alone, so nothing is written, sampled or run
while the plan is built.  Cut points steer the balance only; counts are exact
whatever they are.  ``cum_before`` is the number of rows of the same stratum
with a smaller value, and the mid-rank (average rank of ties) is
``cum_before + (c+1)/2``.  Tie sizes ``c`` come with the histogram, so tie
corrections are plain sums; ``stratum_n`` is the size of the whole stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import hot_join


def with_slice(df: DataFrame, value: str, cuts: str, slices: int, out: str) -> DataFrame:
    """Add how many of the ``slices`` - 1 ascending values in the array column
    ``cuts`` are at most ``value`` (none for NULL).

    A binary search, one step a column: each step uses the one before it twice,
    so the optimizer keeps them apart and all of them are generated code.
    """
    name = lambda c: "`" + c.replace("`", "``") + "`"
    df = df.withColumn(out, F.lit(0))
    for bit in range((slices - 1).bit_length() - 1, -1, -1):
        df = df.withColumn(out, F.expr(
            f"{name(out)} + CASE WHEN get({name(cuts)}, {name(out)} + {(1 << bit) - 1}) <= "
            f"{name(value)} THEN {1 << bit} ELSE 0 END"))
    return df


def with_cumulative(hist: DataFrame, strata: Sequence[str], order: str | Sequence[str],
                    weight: str = "c", out: str = "cum_before", total: str | None = None,
                    slices: int | None = None, slice_by: str | None = None,
                    keep_slice: bool = False) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over rows of the same strata that come
    earlier by ``order``.  ``(strata, order)`` must be unique in ``hist``.

    ``order`` is one column or several.  ``slice_by`` is the one of them that
    is cut into slices (the last by default): it is numeric, and the columns
    before it have few values, each of which is cut into slices of its own.
    ``total`` names a column for the stratum's whole weight, ``slices`` their
    number (the session's shuffle partitions by default), ``keep_slice`` keeps
    the slice's number (for inspection).
    """
    strata = list(strata)
    order = [order] if isinstance(order, str) else list(order)
    cut = order.index(slice_by) if slice_by else len(order) - 1
    lead, inner = order[:cut], order[cut:]
    slices = slices or int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row in all, of a size that the number of slices sets
    cuts = hist.agg(F.percentile_approx(
        inner[0], [i / slices for i in range(1, slices)] or [0.5],
        max(10_000, 10 * slices)).alias("cuts")).scalar()
    cell = [*lead, "__slice"]
    sliced = with_slice(hist.withColumn("__cuts", cuts), inner[0], "__cuts", slices,
                        "__slice").drop("__cuts")
    # NULL strata are values like any other: one struct, never NULL itself
    sliced = sliced.withColumn("__cell", F.struct(*strata, *cell))
    before = Window.partitionBy("__cell").orderBy(*inner).rowsBetween(
        Window.unboundedPreceding, -1)
    local = sliced.withColumn("__local", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    totals = sliced.groupBy("__cell").agg(F.sum(weight).alias("__t"))
    totals = totals.select("__cell", "__t", *[F.col(f"__cell.{c}").alias(c)
                                              for c in [*strata, *cell]])
    stratum = Window.partitionBy(*strata)
    earlier = stratum.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__cell").alias("__of"),
        F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__t").over(stratum).alias("__n"))
    joined = local.join(offsets, F.col("__cell") == F.col("__of"))
    joined = joined.withColumn(out, (F.col("__offset") + F.col("__local")).cast("bigint"))
    if total:
        joined = joined.withColumn(total, F.col("__n").cast("bigint"))
    if keep_slice:
        joined = joined.withColumnRenamed("__slice", "slice")
    return joined.drop("__slice", "__cell", "__of", "__local", "__offset", "__n")


def ranked_histogram(df: DataFrame, strata: Sequence[str], value: str,
                     counts: Mapping[str, Column] | None = None,
                     slices: int | None = None, weight: str | None = None) -> DataFrame:
    """(strata..., value, c, <counts>..., cum_before, stratum_n, mid_rank).

    NULL values are left out (as R's rank tests drop NA).  ``counts`` adds
    conditional counts per distinct value, e.g. how many of the tied rows
    belong to the first sample; ``weight`` names a column that says how many
    rows a row stands for.
    """
    strata = list(strata)
    one = F.col(weight) if weight else F.lit(1)
    aggs = [F.sum(one).cast("bigint").alias("c")]
    for name, cond in (counts or {}).items():
        aggs.append(F.sum(F.when(cond, one).otherwise(0)).cast("bigint").alias(name))
    hist = df.filter(F.col(value).isNotNull()).groupBy(*strata, value).agg(*aggs)
    ranked = with_cumulative(hist, strata, value, "c", total="stratum_n", slices=slices)
    return ranked.withColumn(
        "mid_rank", F.col("cum_before").cast("double") + (F.col("c").cast("double") + 1.0) / 2.0)


def mid_ranks(df: DataFrame, strata: Sequence[str], value: str,
              out: str = "mid_rank", slices: int | None = None) -> DataFrame:
    """Every row of ``df`` with the average rank of its value in its stratum.

    Rows with a NULL value get a NULL rank.  The join back is on
    (strata, value) through ``hot_join``: a value repeated by a third of all
    rows, or a third of all values missing, is spread over all tasks.
    """
    strata = list(strata)
    ranked = ranked_histogram(df, strata, value, slices=slices) \
        .select(*strata, value, "c", F.col("mid_rank").alias(out))
    return hot_join(df, ranked, [*strata, value], "c", null_safe=strata)


def row_positions(df: DataFrame, strata: Sequence[str], order: Sequence[str],
                  out: str = "position", total: str | None = None,
                  slices: int | None = None, slice_by: str | None = None) -> DataFrame:
    """1-based position of each row inside its stratum, ordered by ``order``
    (ties broken by the later columns; the full key must be unique).

    Every (strata, order) key is unique, so each row is its own histogram bin
    with weight 1.  See ``with_cumulative`` for what ``order`` may hold.
    """
    keyed = df.withColumn("__w", F.lit(1).cast("bigint"))
    ranked = with_cumulative(keyed, strata, order, "__w", out="__before", total=total,
                             slices=slices, slice_by=slice_by)
    return ranked.withColumn(out, F.col("__before") + F.lit(1)).drop("__w", "__before")
