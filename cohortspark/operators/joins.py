"""Join operators: null-safe attach, semi join, hot-value join, checked rename."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (dplyr's join rule).

    ``<=>`` keys are still hash/sort-merge join keys; no broadcast hint is
    given, so the planner (and AQE at runtime, from measured sizes) picks a
    broadcast only for a side that is actually small.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    tmp = {k: f"__r_{i}_{k}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(c).alias(tmp[c]) if c in tmp else F.col(c)
                       for c in right.columns])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[tmp[k]])
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out
    if how in ("right", "right_outer"):
        for k in keys:
            out = out.withColumn(k, F.col(tmp[k]))
    elif how in ("full", "outer", "full_outer"):
        for k in keys:
            out = out.withColumn(k, F.coalesce(left[k], F.col(tmp[k])))
    return out.drop(*tmp.values())


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str,
             spread: Sequence[str] | None = None, slots: int | None = None,
             null_safe: bool | Sequence[str] = True) -> DataFrame:
    """``left`` left-joined with ``right``, whatever share of ``left`` a key holds.

    ``right`` has one row per key and says in ``count`` how many rows of
    ``left`` hold the key (the column is not returned).  A key with more rows
    than an even share of ``slots`` partitions (the session's shuffle
    partitions by default) is hot.  There are at most ``slots`` hot keys, so
    they are broadcast and answered where the rows of ``left`` are; their rows
    go on to the shuffle under a hash of the columns ``spread`` (all columns by
    default) instead of the key, and match nothing there.  Rows of other keys
    meet ``right`` in the shuffle.  Only rows that are equal in all columns of
    ``spread`` stay together.

    With ``null_safe`` NULL keys match NULL keys; without it they match none,
    and their rows are spread too; it may name the keys that it holds for.
    """
    keys = list(keys)
    safe = set(keys if null_safe is True else null_safe or ())
    slots = slots or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    payload = [c for c in right.columns if c not in keys and c != count]
    if clash := set(payload) & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    total = right.agg(F.sum(count)).scalar()
    right = right.withColumn("__is_hot", F.col(count) * F.lit(slots) > total)

    def side(tag: str, hot: bool) -> DataFrame:
        return right.filter(F.col("__is_hot") == F.lit(hot)).select(
            *[F.col(k).alias(f"__{tag}_{i}") for i, k in enumerate(keys)],
            *[F.col(c).alias(f"__{tag}_{c}") for c in payload],
            F.lit(True).alias(f"__{tag}"))

    def meets(tag: str):
        out = F.lit(True)
        for i, k in enumerate(keys):
            here, there = F.col(k), F.col(f"__{tag}_{i}")
            out = out & (here.eqNullSafe(there) if k in safe else here == there)
        return out

    known = left.join(F.broadcast(side("hot", True)), meets("hot"), "left")
    apart = F.col("__hot")
    for k in keys:
        if k not in safe:
            apart = apart | F.col(k).isNull()
    lane = F.when(apart, F.xxhash64(*(spread or left.columns))).otherwise(F.xxhash64(*keys))
    rest = side("rest", False).withColumn("__to", F.xxhash64(*[f"__rest_{i}" for i in range(len(keys))]))
    met = known.withColumn("__lane", lane).join(
        rest, meets("rest") & (F.col("__lane") == F.col("__to")), "left")
    return met.select(*left.columns, *[
        F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(f"__rest_{c}")).alias(c)
        for c in payload])


def attach(detail: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left_join(detail, sizes)`` on the named keys, NULL matching NULL."""
    return join_null_safe(detail, sizes, keys, "left")


def semi_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys occur in ``other`` (``x %in% other$x``: a
    missing key occurs where the other side has a missing one)."""
    return join_null_safe(df, other.select(*keys), keys, "left_semi")


def rename_checked(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename ``{old: new}``; unlike ``withColumnsRenamed`` an unknown source
    column raises instead of being ignored."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"cannot rename missing columns: {missing}")
    return df.withColumnsRenamed(dict(mapping))
