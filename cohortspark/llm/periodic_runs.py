"""Periodic runs of words through maximal pairs.

A run is a stretch of words with a smallest period q that is several periods
long and that no neighbouring word extends.  Its first word s and the word
s + q start a maximal pair: the same words follow both for as long as the run
goes on, other words stand before them.  So the runs are the maximal pairs
whose distance is short enough for the length that they share, and nothing has
to be extended.

Pairs come from the LCP-interval tree over the suffixes of a text, walked from
the leaves up.  Every interval carries its places in order, with the class of
each place by the word to its left; when two intervals meet, pairs are formed
between places of different classes only, and two intervals of one and the
same class form none.  Of a place's partners the nearest on either side
suffice: a place between s and s + q would, by the theorem of Fine and Wilf,
give the run a shorter period.
"""

from __future__ import annotations

from bisect import bisect_left
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.text import NON_SPACE, space_words, text_chunks, texts_of, word_codes, word_spans

_MIXED = -2  # the places of an interval have different words to their left


def least_shared(min_words: int, exponent: int) -> int:
    """The fewest words that the two places of any run's pair share."""
    return min(max(min_words - q, (exponent - 1) * q) for q in range(1, max(2, min_words + 1)))


def _repeated(codes: np.ndarray, text: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Places whose next ``size`` words stand elsewhere in the same text too."""
    rank = codes + text * (int(codes.max(initial=0)) + 1)
    at, have = np.arange(len(codes)), 1
    while True:
        _, number, n = np.unique(rank[at], return_inverse=True, return_counts=True)
        again = n[number] > 1
        at = at[again]
        if have == size or not len(at):
            return at
        alive = np.zeros(len(codes) + 1, bool)
        alive[at] = True
        rank = np.zeros(len(codes), np.int64)
        rank[at] = number[again]
        step = min(have, size - have)
        have += step
        at = at[(at + have <= ends[at]) & alive[np.minimum(at + step, len(codes))]]
        pairs = rank[at] * (int(rank.max(initial=0)) + 1) + rank[np.minimum(at + step, len(codes) - 1)]
        rank[at] = pairs


def _suffix_order(codes: np.ndarray, text: np.ndarray, ends: np.ndarray):
    """Suffixes of all texts in order, and how many words each shares with the
    one before it (of its own text), by prefix doubling of groups."""
    n = len(codes)
    order = np.lexsort((codes, text))
    head = np.ones(n, bool)
    head[1:] = (codes[order][1:] != codes[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels = [rank]
    size = 1
    while True:
        group = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        inside = at + size < ends[at]
        behind = np.where(inside, rank[np.where(inside, at + size, 0)], -1)
        own = group[slots]
        new = np.lexsort((behind, own))
        at, own, behind = at[new], own[new], behind[new]
        order[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        levels.append(rank)
        size *= 2
    left, right = order[:-1], order[1:]
    shared = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        inside = (a < ends[left]) & (b < ends[right])
        same = inside & (levels[level][np.where(inside, a, 0)] == levels[level][np.where(inside, b, 0)])
        shared[same] += 1 << level
    return order, shared


def _maximal_pairs(places, shared, before, min_words: int, exponent: int):
    """Maximal pairs (first place, distance, shared words) of one subtree that
    are runs.  ``shared[i]`` is what place i shares with place i + 1; the last
    entry is below all others."""
    found = []
    stack = []

    def meet(a, b, length):
        """Places of two intervals -> of both; pairs between them are found."""
        (many, one), (few, other) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
        if one != other or one == _MIXED:
            reach = length // (exponent - 1)
            for i in few:
                k = bisect_left(many, i)
                for j in many[max(0, k - 1):k + 1]:
                    gap = abs(i - j)
                    if gap <= reach and gap + length >= min_words and before[i] != before[j]:
                        found.append((min(i, j), gap, length))
        if len(few) == 1:
            many.insert(bisect_left(many, few[0]), few[0])
        else:
            many += few
            many.sort()
        return many, one if one == other else _MIXED

    for place, length in zip(places, shared):
        node = [place], before[place]
        while stack and stack[-1][0] > length:
            depth, left = stack.pop()
            node = meet(left, node, depth)
        if stack and stack[-1][0] == length:
            stack[-1] = length, meet(stack[-1][1], node, length)
        else:
            stack.append((length, node))
    return found


def runs_of(codes: np.ndarray, firsts: np.ndarray, min_words: int, exponent: int):
    """By text with runs: its sorted list of (start, length, period).

    ``codes`` are the words of several texts as numbers, ``firsts`` each
    text's first word.
    """
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    least = least_shared(min_words, exponent)
    places = _repeated(codes, text, firsts[1:][text], least)
    live = np.unique(text[places])  # no run in any other text
    if not len(live):
        return {}
    sizes = np.diff(firsts)[live]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(firsts[live] - bounds[:-1], sizes) + np.arange(bounds[-1])
    codes = codes[source]
    text = np.repeat(np.arange(len(live)), sizes)
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[bounds[:-1]] = -1
    order, shared = _suffix_order(codes, text, bounds[1:][text])
    deep = np.concatenate([[False], shared >= least, [False]])
    begin = np.flatnonzero(~deep[:-1] & deep[1:])
    end = np.flatnonzero(deep[:-1] & ~deep[1:])
    before = before.tolist()
    stretches: dict[int, dict] = {}
    for a, b in zip(begin.tolist(), end.tolist()):
        subtree = order[a:b + 1].tolist()
        depths = shared[a:b].tolist() + [0]
        for i, gap, length in _maximal_pairs(subtree, depths, before, min_words, exponent):
            own = stretches.setdefault(int(text[i]), {})
            # a multiple of the smallest period gives the same stretch
            key = i, gap + length
            own[key] = min(gap, own.get(key, gap))
    return {int(live[t]): sorted((i - int(bounds[t]), n, q) for (i, n), q in own.items())
            for t, own in stretches.items()}


def _find(min_words: int, exponent: int):
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column("text")):
                starts, ends, firsts = word_spans(NON_SPACE[data], offsets)
                found = runs_of(word_codes(data, starts, ends)[0], firsts, min_words, exponent)
                raw = data.tobytes()
                kept, runs = [], []
                for t, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    words = space_words(raw[a:b])
                    own = found.get(t, [])
                    if own:
                        stays = np.ones(len(words), bool)
                        for s, n, q in own:
                            stays[s + q:s + n] = False
                        words = [words[p] for p in np.flatnonzero(stays).tolist()]
                    kept.append(b" ".join(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(firsts), pa.int64()),
                     pa.array(runs, pa.list_(run_type)),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, min_words: int = 6, exponent: int = 4) -> DataFrame:
    """All periodic runs of words of every text, and the text without them.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read.  Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a
    stretch of consecutive words with smallest period q, at least
    ``min_words`` words and ``exponent`` (3 or more) periods long, that no
    neighbouring word extends with the same period.

    Returns doc_id, n_words, runs (array of start, length, period, by start)
    and collapsed: the words joined by a space, of each run only the first
    period (a word that any run holds behind its first period goes).

    Defined results: a null or empty text has no words and no runs; rows
    without an id or with a repeated one are read like any other and each
    returned; an empty table gives no rows.  Texts of any length are read whole
    by one task; its memory is a few dozen bytes a word times the number of
    doublings up to the longest repeat.
    """
    if exponent < 3 or min_words < 1:
        raise ValueError("runs of at least three periods and one word")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(_find(min_words, exponent),
                        "doc_id long, n_words long, "
                        "runs array<struct<start: long, length: long, period: long>>, "
                        "collapsed string"))


def _planted(batches):
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
        for k, i in enumerate(ids):
            h = 1 if i is None else crc32(str(i).encode())
            words = space_words(texts[k] or b"") if h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[k] = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "text"])


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tail made periodic in about a tenth of the texts.

    With h the CRC-32 of the decimal doc_id and g = h // 10: if h % 10 is 0,
    every word from number a = g % n on becomes word a + (i - a) % p, for
    p = 1 + (n - a) // (3 + g % 8), and words are joined by one space.  Other
    texts, null and blank texts and rows without an id stay as they are.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(_planted, "doc_id long, text string"))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length / period (compared as
    fractions; ties to the smaller start, then period) and two SHA-256 sums."""
    # reduce over runs by start keeps the first of equal fractions
    best = F.expr("""aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
        (best, r) -> case when best is null or r.length * best.period > best.length * r.period
                          then r else best end)""")
    lines = F.expr(r"array_join(transform(runs, r -> "
                   r"concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
