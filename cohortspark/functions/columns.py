"""Column-level building blocks (Column -> Column).

All of these are built-in Spark SQL expressions, so they stay inside
whole-stage codegen.  The one rule that runs through them: a missing input
stays missing.  ``CASE WHEN NULL ... ELSE x`` would take the ELSE branch, so
no helper here ends in a bare ``otherwise`` on a nullable test.

A column may be given by name or as a ``Column``.  Of a name the expression is
written as SQL text, which costs one call to the JVM instead of one for every
operator in it: half of the time to build a small plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name(c: str) -> str:
    """A column's name in SQL text; a path into a struct stays a path."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in c.split("."))


def literal(v) -> str:
    """A value in SQL text."""
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else repr(v)


def _cases(pairs) -> Column:
    """CASE WHEN of (condition, value) as SQL text, without a default."""
    whens = " ".join(f"WHEN {cond} THEN {literal(value)}" for cond, value in pairs)
    return F.expr(f"CASE {whens} END")


def recode(c, mapping: Mapping[str, str]) -> Column:
    """Lookup recode with no default: values outside ``mapping`` become NULL."""
    if isinstance(c, str) and mapping:
        return _cases((f"{name(c)} = {literal(src)}", dst) for src, dst in mapping.items())
    c = _col(c)
    out = None
    for src, dst in mapping.items():
        out = (F.when(c == src, F.lit(dst)) if out is None
               else out.when(c == src, F.lit(dst)))
    return out if out is not None else F.lit(None).cast("string")


def floor_zeros(c, floor: float) -> Column:
    """Replace an exact zero by ``floor``; NULL stays NULL."""
    if isinstance(c, str):
        return F.expr(f"CASE WHEN {name(c)} = 0 THEN {literal(float(floor))} ELSE {name(c)} END")
    return F.when(c == 0, F.lit(float(floor))).otherwise(c)


def flag_above(c, cutoff: float) -> Column:
    """1 if strictly above the cutoff, 0 if not, NULL if the value is NULL."""
    return (_col(c) > F.lit(float(cutoff))).cast("int")


def label_above(c, cutoff: float, above: str = "Above",
                below: str = "Below") -> Column:
    """Above/Below label; NULL stays NULL."""
    if isinstance(c, str):
        cut = literal(float(cutoff))
        return _cases([(f"{name(c)} > {cut}", above), (f"{name(c)} <= {cut}", below)])
    return (F.when(c > F.lit(float(cutoff)), F.lit(above))
            .when(c <= F.lit(float(cutoff)), F.lit(below)))


def flag_zero(c) -> Column:
    """Zero flag taken from the raw value (before any floor is applied)."""
    return _col(c) == F.lit(0.0)


def combine_status(a, b, positive: str = "Positive",
                   negative: str = "Negative") -> Column:
    """Positive if either is positive, Negative only if both are negative."""
    if isinstance(a, str) and isinstance(b, str):
        yes, no, a, b = literal(positive), literal(negative), name(a), name(b)
        return _cases([(f"{a} = {yes} OR {b} = {yes}", positive),
                       (f"{a} = {no} AND {b} = {no}", negative)])
    a, b = _col(a), _col(b)
    return (F.when((a == positive) | (b == positive), F.lit(positive))
            .when((a == negative) & (b == negative), F.lit(negative)))


def assign_cohort(group, status, rules: Sequence[tuple]) -> Column:
    """Cohort from (group, status) rules; a rule with status None takes any."""
    if isinstance(group, str) and isinstance(status, str):
        return _cases((f"{name(group)} = {literal(g)}" + (
            "" if s is None else f" AND {name(status)} = {literal(s)}"), cohort)
            for g, s, cohort in rules)
    group, status = _col(group), _col(status)
    out = None
    for g, s, cohort in rules:
        cond = group == g if s is None else (group == g) & (status == s)
        out = (F.when(cond, F.lit(cohort)) if out is None
               else out.when(cond, F.lit(cohort)))
    return out


def bin_count(c, bins: Sequence[tuple[Iterable[int], str]]) -> Column:
    """Map integer counts to bin labels; counts outside every bin -> NULL."""
    c = _col(c)
    out = None
    for members, label in bins:
        cond = c.isin(list(members))
        out = (F.when(cond, F.lit(label)) if out is None
               else out.when(cond, F.lit(label)))
    return out


def to_number(c) -> Column:
    """Text to double; text that is not a number, 'NaN' included, becomes NULL."""
    if isinstance(c, str):
        number = f"try_cast({name(c)} AS DOUBLE)"
        return F.expr(f"CASE WHEN NOT isnan({number}) THEN {number} END")
    number = _col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def na_text(c) -> Column:
    """Text form as R prints it: NULL becomes 'NA'."""
    return F.coalesce(_col(c).cast("string"), F.lit("NA"))


def size_label(label, n, sep: str = " ", prefix: str = "\n(n=",
               suffix: str = ")") -> Column:
    """``paste(label, prefix, n, suffix)`` (sep ' ') or ``paste0`` (sep '')."""
    if isinstance(label, str) and isinstance(n, str):
        return F.expr(f"concat_ws({literal(sep)}, coalesce(CAST({name(label)} AS STRING), 'NA'), "
                      f"{literal(prefix)}, coalesce(CAST({name(n)} AS STRING), 'NA'), {literal(suffix)})")
    return F.concat_ws(sep, na_text(label), F.lit(prefix), na_text(n),
                       F.lit(suffix))


def safe_log2(c) -> Column:
    """log2 of a positive value; 0, negatives and NULL give NULL."""
    if isinstance(c, str):
        return F.expr(f"CASE WHEN {name(c)} > 0 THEN log2({name(c)}) END")
    return F.when(c > 0, F.log2(c))


def days_between(end, start) -> Column:
    """Whole days from ``start`` to ``end``."""
    return F.datediff(_col(end), _col(start))


def significance(p, scale=None) -> Column:
    """Star symbols for a p-value column; NULL p gives NULL."""
    from .labels import SIGNIFICANCE_SCALE
    if isinstance(p, str):
        return _cases((f"{name(p)} <= {literal(float(bound))}", sym)
                      for bound, sym in (scale or SIGNIFICANCE_SCALE))
    out = None
    for bound, sym in (scale or SIGNIFICANCE_SCALE):
        cond = p <= F.lit(bound)
        out = F.when(cond, F.lit(sym)) if out is None else out.when(cond, F.lit(sym))
    return out


def relabel(c, mapping: Mapping[str, str]) -> Column:
    """Same as :func:`recode`; named for presentation labels."""
    return recode(c, mapping)
