"""p-values.

All of them are Spark SQL expressions: series, continued fractions and counts
folded over sequences and arrays, so no row goes through Python.  They are
written as SQL text, which costs one call to the JVM instead of one for every
operator in them.  A fold uses its argument many times, so the ``add_...``
functions put arguments into columns of their own first: the plan then holds
each of them once.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES_TERMS = 80      # of erf up to ERFC_SWITCH: the rest is below 1e-17
FRACTION_TERMS = 60    # of erfc beyond it
ERFC_SWITCH = 3.0
T_EXPANSION_FROM = 2000  # degrees of freedom from which t is expanded about the normal


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _add(df: DataFrame, **texts: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in texts.items()})


def erfc(x: str) -> str:
    """Complementary error function of a column x >= 0; NULL for NULL.

    Below the switch 1 - erf with the series of positive terms
    exp(-x^2) sum 2^k x^(2k+1) / (1 3 5 ... (2k+1)); beyond it the continued
    fraction, from its last term back.
    """
    term = f"s.term * 2D * {x} * {x} / (2 * k + 1)"
    return f"""greatest(0D, CASE
        WHEN {x} <= {ERFC_SWITCH!r}D THEN 1D - {2 / math.sqrt(math.pi)!r}D * exp(-{x} * {x}) * aggregate(
            sequence(1, {SERIES_TERMS}), named_struct('term', {x}, 'sum', {x}),
            (s, k) -> named_struct('term', {term}, 'sum', s.sum + {term})).sum
        WHEN {x} > {ERFC_SWITCH!r}D THEN exp(-{x} * {x}) / ({math.sqrt(math.pi)!r}D * aggregate(
            sequence({FRACTION_TERMS}, 1, -1), {x}, (s, k) -> {x} + k / 2D / s)) END)"""


def add_normal_p(df: DataFrame, z: str, name: str) -> DataFrame:
    """Two-sided normal p of a z value; NULL for NULL."""
    df = _add(df, __x=f"abs({_q(z)}) / {math.sqrt(2.0)!r}D")
    return _add(df, **{name: f"CASE WHEN __x IS NOT NULL THEN least(1D, {erfc('__x')}) END"}).drop("__x")


def add_chi2_df1_p(df: DataFrame, x: str, name: str) -> DataFrame:
    """P(X >= x) for chi-square with one degree of freedom; NULL for NULL."""
    df = _add(df, __x=f"CASE WHEN {_q(x)} IS NOT NULL THEN sqrt(greatest({_q(x)}, 0D) / 2) END")
    return _add(df, **{name: f"CASE WHEN __x IS NOT NULL THEN {erfc('__x')} END"}).drop("__x")


def add_student_p(df: DataFrame, t: str, degrees: str, name: str) -> DataFrame:
    """Two-sided p of Student's t with a whole number of degrees of freedom.

    Below T_EXPANSION_FROM the finite sums in the angle atan(t / sqrt(df));
    from there on the expansion about the normal in 1/df up to its third
    power, whose rest is below 1e-12.  Each term of a sum is the one before
    times cos^2 and a ratio that depends on the parity of df.
    """
    df = _add(df, __t=f"abs(CAST({_q(t)} AS DOUBLE))",
              __v=f"CASE WHEN {_q(degrees)} > 0 THEN CAST({_q(degrees)} AS DOUBLE) END")
    df = _add(df, __odd="pmod(__v, 2D) = 1", __cos2="__v / (__v + __t * __t)",
              __sin="__t / sqrt(__v + __t * __t)", __angle="atan(__t / sqrt(__v))", __t2="__t * __t",
              __far=f"__t / {math.sqrt(2.0)!r}D")
    step = ("s.term * __cos2 * CASE WHEN __odd THEN 2D * k / (2 * k + 1) "
            "ELSE (2D * k - 1) / (2 * k) END")
    df = _add(
        df, __first="CASE WHEN NOT __odd THEN 1D WHEN __v > 1 THEN sqrt(__cos2) ELSE 0D END",
        __terms=f"""CASE WHEN __v < {T_EXPANSION_FROM} THEN
            CAST(floor((__v - CASE WHEN __odd THEN 3D ELSE 2D END) / 2) AS INT) END""")
    df = _add(df, __total=f"""aggregate(
        CASE WHEN __terms >= 1 THEN sequence(1, __terms)
             WHEN __terms < 1 THEN CAST(array() AS ARRAY<INT>) END,
        named_struct('term', __first, 'sum', __first),
        (s, k) -> named_struct('term', {step}, 'sum', s.sum + {step})).sum""")

    def poly(*c: int) -> str:  # in t^2, highest power first
        out = f"{c[0]}D"
        for a in c[1:]:
            out = f"({out} * __t2 + {a}D)"
        return out

    inside = f"""CASE WHEN __odd THEN (__angle + __sin * __total) * {2 / math.pi!r}D
        ELSE __sin * __total END"""
    beyond = f"""{erfc('__far')} + 2 * __t * exp(-__t2 / 2) / {math.sqrt(2 * math.pi)!r}D * (
        {poly(1, 1)} / (4 * __v) + {poly(3, -7, -5, -3)} / (96 * __v * __v)
        + {poly(1, -11, 14, 6, -3, -15)} / (384 * __v * __v * __v))"""
    df = _add(df, **{name: f"""CASE WHEN __t IS NOT NULL AND __v > 0 THEN greatest(0D, least(1D,
        CASE WHEN __v < {T_EXPANSION_FROM} THEN 1 - {inside} ELSE {beyond} END)) END"""})
    return df.drop("__t", "__v", "__odd", "__cos2", "__sin", "__angle", "__t2", "__far", "__first",
                   "__terms", "__total")


def add_correlation_p(df: DataFrame, r: str, n: str, name: str) -> DataFrame:
    """p of a correlation coefficient from t = r sqrt((n-2)/(1-r^2)); NULL
    below three points, 0 for a perfect correlation."""
    r, n = _q(r), _q(n)
    df = _add(df, __df=f"CAST({n} AS DOUBLE) - 2",
              __tt=f"{r} * sqrt(try_divide(CAST({n} AS DOUBLE) - 2, 1 - {r} * {r}))")
    df = add_student_p(df, "__tt", "__df", "__tp")
    return _add(df, **{name: f"""CASE WHEN {r} IS NULL OR {n} IS NULL OR {n} < 3 THEN NULL
        WHEN abs({r}) >= 1 THEN 0D ELSE __tp END"""}).drop("__df", "__tt", "__tp")


# ------------------------------------------------ exact Wilcoxon tails ------

# sum of two arrays of counts, the shorter one padded with zeros
_ADDED = "zip_with({}, {}, (x, y) -> coalesce(x, 0D) + coalesce(y, 0D))"


def signrank_ways(n: str) -> str:
    """How many of the 2^n sign patterns give the signed-rank statistic 0, 1,
    ... of n >= 1 pairs without ties and zeros: one rank more a step."""
    moved = "concat(array_repeat(0D, k), w)"
    return f"""aggregate(sequence(1, CAST({n} AS INT)), array(1D),
        (w, k) -> {_ADDED.format('w', moved)})"""


def ranksum_ways(m: str, n: str) -> str:
    """How many orders of samples of m >= 1 and n >= 1 values without ties give
    the rank-sum statistic 0, 1, ...

    f(i, j) = f(i, j - 1) + f(i - 1, j) moved by j: the largest value is of the
    second sample, or of the first and then above j others.  The fold goes from
    j - 1 to j with all f(0..m, j) at once; counts only ever add up.
    """
    own = f"sequence(1, CAST({m} AS INT))"
    moved = "concat(array_repeat(0D, j), element_at(made, -1))"
    return f"""element_at(aggregate(sequence(1, CAST({n} AS INT)),
        concat(array(array(1D)), transform({own}, i -> array(1D))),
        (old, j) -> aggregate({own}, array(array(1D)),
            (made, i) -> concat(made, array({_ADDED.format('get(old, i)', moved)})))), -1)"""


def two_sided(ways: str, statistic: str) -> str:
    """Twice the smaller tail of an integer statistic counted from 0, at most 1."""
    k = f"CAST({statistic} AS INT)"
    total = "aggregate({}, 0D, (s, x) -> s + x)"
    tail = f"""CASE WHEN 2 * {statistic} > size({ways}) - 1 THEN slice({ways}, {k} + 1, size({ways}))
        ELSE slice({ways}, 1, {k} + 1) END"""
    return f"least(1D, 2 * {total.format(tail)} / {total.format(ways)})"


def add_rank_test_p(tests: DataFrame, exact: str, statistic: str, n1: str, n2: str | None,
                    z: str, name: str, few: bool = False) -> DataFrame:
    """Two-sided p of rank tests: exact where ``exact`` says so, else normal.

    Without ``n2`` they are signed-rank tests.  The distribution is counted
    once for each pair of sizes that occurs (below 50 each, so at most 2,401
    of them) and joined to the tests; ``few`` says that there are but a
    handful of tests, which are then counted each by itself, without a join.
    An exact test with an empty sample has a NULL p.
    """
    sizes = [n1] + ([n2] if n2 else [])
    able = " AND ".join([_q(exact), *(f"{_q(c)} > 0" for c in sizes)])
    ways = (ranksum_ways if n2 else signrank_ways)(*map(_q, sizes))
    if few:
        tests = _add(tests, __ways=f"CASE WHEN {able} THEN {ways} END")
    else:
        table = _add(tests.filter(able).select(*sizes).distinct(), __ways=ways)
        table = table.withColumnsRenamed({c: f"__size_{i}" for i, c in enumerate(sizes)})
        met = " AND ".join([able, *(f"{_q(c)} = __size_{i}" for i, c in enumerate(sizes))])
        tests = tests.join(table, F.expr(met), "left").drop(
            *(f"__size_{i}" for i in range(len(sizes))))
    out = add_normal_p(tests, z, "__normal")
    return _add(out, **{name: f"""CASE WHEN NOT {_q(exact)} THEN __normal
        WHEN __ways IS NOT NULL THEN {two_sided('__ways', _q(statistic))} END"""}).drop(
        "__ways", "__normal")


# ----------------------------------------------------- exact Spearman p -----

SPEARMAN_COUNTED = 9       # points up to which all orders are counted
SPEARMAN_EXACT_BELOW = 1290  # points from which t is taken even without ties

# The Edgeworth series of the rank correlation published with
# algorithm AS 89 (Best and Roberts, 1975).
AS89 = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131,
        4.6e-4)


@cache
def spearman_ways(n: int) -> tuple[int, ...]:
    """How many orders of n ranks have the sum of squared rank differences 0,
    2, 4, ...: one rank more a step, by the set of places taken."""
    states = {(0, 0): 1}
    for i in range(n):
        grown: dict[tuple[int, int], int] = {}
        for (taken, s), ways in states.items():
            for j in range(n):
                if not taken >> j & 1:
                    key = taken | 1 << j, s + (i - j) ** 2
                    grown[key] = grown.get(key, 0) + ways
        states = grown
    counts = [0] * ((n ** 3 - n) // 6 + 1)
    for (_, s), ways in states.items():
        counts[s // 2] += ways
    return tuple(counts)


def _spearman_tables() -> str:
    """Array by points from 2 on of P(S <= 0), P(S <= 2), ... with all orders counted."""
    rows = []
    for n in range(2, SPEARMAN_COUNTED + 1):
        total, shares = 0, []
        for count in spearman_ways(n):
            total += count
            shares.append(f"{total / math.factorial(n)!r}D")
        rows.append(f"array({', '.join(shares)})")
    return f"array({', '.join(rows)})"


def add_spearman_p(df: DataFrame, rho: str, n: str, tied: str, name: str) -> DataFrame:
    """Two-sided p of Spearman's rho.

    Without ties and below SPEARMAN_EXACT_BELOW points it comes from the
    distribution of the sum S of squared rank differences: all orders counted
    up to SPEARMAN_COUNTED points, the Edgeworth series beyond.  The smaller
    tail is doubled; S is even, so the series is taken half way between two
    sums.  Otherwise p comes from t, as for ``add_correlation_p``.
    """
    df = _add(df, __n=f"CAST({_q(n)} AS DOUBLE)")
    # S is spread evenly about its mean (n^3 - n) / 6: the tail below it
    df = _add(df, __mean="(__n * __n * __n - __n) / 6", __inv="try_divide(1D, __n)")
    df = _add(df, __s=f"round(__mean * (1 - abs({_q(rho)})))")
    df = _add(df, __z="(try_divide(6 * (__s + 1) * __inv, __n * __n - 1) - 1) * sqrt(__n - 1)")
    df = _add(df, __y="__z * __z", __half=f"abs(__z) / {math.sqrt(2.0)!r}D")
    c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11, c12 = (f"{c!r}D" for c in AS89)
    series = f"""__z * __inv * ({c1} + __inv * ({c2} + {c3} * __inv)
        + __y * (-{c4} + __inv * ({c5} + {c6} * __inv) - __y * __inv * (
            {c7} + {c8} * __inv - __y * (
                {c9} - {c10} * __inv + __y * __inv * ({c11} - {c12} * __y)))))"""
    df = _add(df, __tail=f"""CASE WHEN __n <= {SPEARMAN_COUNTED}
        THEN get(get({_spearman_tables()}, CAST(__n AS INT) - 2), CAST(__s / 2 AS INT))
        ELSE CASE WHEN __z <= 0 THEN {erfc('__half')} / 2 ELSE 1 - {erfc('__half')} / 2 END
             - exp(-__y / 2) * {series} END""")
    df = add_correlation_p(df, rho, n, "__t_p")
    return _add(df, **{name: f"""CASE WHEN {_q(rho)} IS NULL THEN NULL
        WHEN NOT {_q(tied)} AND __n >= 2 AND __n < {SPEARMAN_EXACT_BELOW}
        THEN least(1D, greatest(0D, 2 * __tail)) ELSE __t_p END"""}).drop(
        "__n", "__mean", "__inv", "__s", "__z", "__y", "__half", "__tail", "__t_p")
