"""Long <-> wide reshaping and the complete-case cohort.

``spread`` is conditional aggregation over a declared key list: one hash
aggregation (one exchange, by the id columns) instead of ``pivot``'s two, and
a duplicate (id, key) raises at run time through ``raise_error`` instead of
being hidden by ``first``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def spread_columns(key: str, value: str, keys: Sequence[str],
                   names: Sequence[str] | None = None,
                   check_unique: bool = True) -> list[Column]:
    """Aggregate expressions turning (key, value) rows into one column per key."""
    out = []
    for k, name in zip(keys, names or keys):
        own = f"{C.name(key)} = {C.literal(k)}"
        cell = f"max(CASE WHEN {own} THEN {C.name(value)} END)"
        if check_unique:
            error = C.literal(f"duplicate rows for key '{k}' within one id")
            cell = (f"CASE WHEN count(CASE WHEN {own} THEN 1 END) > 1 THEN raise_error({error}) "
                    f"ELSE {cell} END")
        out.append(F.expr(cell).alias(name))
    return out


def spread(df: DataFrame, ids: Sequence[str], key: str, value: str,
           keys: Sequence[str], check_unique: bool = True) -> DataFrame:
    """Long -> wide (tidyr ``spread``): absent pair -> NULL, duplicate -> error."""
    return df.groupBy(*ids).agg(*spread_columns(key, value, keys,
                                                check_unique=check_unique))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n) for every key combination that occurs more than once."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def gather(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
           key: str = "key", value: str = "value") -> DataFrame:
    """Wide -> long (tidyr ``gather``); NULL cells stay as rows."""
    return df.unpivot(list(ids), list(cols), key, value)


def complete_cases(df: DataFrame, ids: Sequence[str], key: str, value: str,
                   required: Sequence[str]) -> DataFrame:
    """Rows of subjects that have a non-NULL value for every required key.

    Same result as spread -> flag -> filter -> drop -> gather, computed as one
    aggregation by the id columns followed by a narrow unpivot.
    """
    required = list(required)
    cols = [f"__k{i}" for i in range(len(required))]
    wide = (df.filter(F.col(key).isin(required))
            .groupBy(*ids).agg(*spread_columns(key, value, required, cols)))
    keep = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    cells = ", ".join(f"named_struct({C.literal(key)}, {C.literal(k)}, {C.literal(value)}, {c})"
                      for k, c in zip(required, cols))
    long = wide.filter(keep).select(*ids, F.expr(f"explode(array({cells}))").alias("__kv"))
    return long.select(*ids, F.col(f"__kv.{key}").alias(key),
                       F.col(f"__kv.{value}").alias(value))
