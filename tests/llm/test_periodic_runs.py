import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cohortspark.llm import periodic_runs
from cohortspark.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.conftest import MORSE, rows


def brute(words, min_words=6, exponent=4):
    """Runs by trying every period at every place, without a pair in sight."""
    n, best = len(words), {}
    for q in range(n // exponent, 0, -1):
        s = 0
        while s < n - q:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(min_words, exponent * q) and e > s:
                best[s, e + q - s] = q  # smaller periods come later
            s = e + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def collapsed(words, runs):
    gone = {p for s, n, q in runs for p in range(s + q, s + n)}
    return " ".join(w for p, w in enumerate(words) if p not in gone)


def planted(doc_id, text):
    words = (text or "").split()  # the test texts have no other white space
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def texts(rnd):
    """Texts full of runs: blocks repeated, runs inside runs, random letters."""
    for _ in range(60):
        alphabet = "ab" if rnd.random() < 0.5 else "abcd"
        words = []
        while len(words) < rnd.randrange(1, 120):
            block = [rnd.choice(alphabet) for _ in range(rnd.randrange(1, 8))]
            words += block * rnd.randrange(1, 9) + block[:rnd.randrange(len(block) + 1)]
        yield words
    yield ["a"] * 300
    yield (["a"] * 7 + ["b"]) * 9
    yield ["x", "y"] * 40 + ["x", "x"] + ["y"] * 5
    yield [f"w{i}" for i in range(50)] * 5


@pytest.mark.parametrize("min_words, exponent", [(6, 4), (1, 3), (12, 3), (5, 6), (2, 5)])
def test_runs_of_random_words(min_words, exponent):
    rnd = random.Random(min_words)
    all_words = list(texts(rnd))
    codes = {w: k for k, w in enumerate(sorted({w for t in all_words for w in t}))}
    firsts = np.concatenate([[0], np.cumsum([len(t) for t in all_words])])
    flat = np.array([codes[w] for t in all_words for w in t], np.int64)
    got = periodic_runs.runs_of(flat, firsts, min_words, exponent)
    want = {k: brute(t, min_words, exponent) for k, t in enumerate(all_words)}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 20


def test_every_text_of_two_words():
    """All texts of up to 13 words over two letters, each by itself."""
    all_words = [format(i, f"0{n}b") for n in range(1, 14) for i in range(1 << n)]
    firsts = np.concatenate([[0], np.cumsum([len(t) for t in all_words])])
    flat = np.frombuffer("".join(all_words).encode(), np.uint8).astype(np.int64) - 48
    got = periodic_runs.runs_of(flat, firsts, 6, 4)
    assert got == {k: r for k, t in enumerate(all_words) if (r := brute(t))}


def test_words_of_equal_polynomial_hashes(spark, checkpoints):
    one, two = MORSE
    words = [one, two, one, one, two, two, one, two]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    r = periodic_runs.find_runs(df, 3, 3).first()
    assert [tuple(x) for x in r.runs] == brute(words, 3, 3) and r.collapsed == " ".join(words)


def test_query_against_brute_force(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF_SMALL).collect()}
    n_runs = 0
    for d in docs.collect():
        words = planted(d.doc_id, d.text)
        runs = brute(words)
        n_runs += len(runs)
        r = got.pop(d.doc_id)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert not got and n_runs > 10


def test_best_run_is_compared_as_a_fraction(spark, checkpoints):
    # 13/3 before 17/4, ties (6/1) to the smaller start
    words = ["a", "b", "c"] * 4 + ["a"] + list("wxyz") * 4 + ["w"]
    ties = ["a"] * 6 + ["b"] * 6
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(ties))],
                               "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.run_digest(periodic_runs.find_runs(df)).collect()}
    assert (got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (0, 13, 3, 4333)
    assert (got[2].n_runs, got[2].start, got[2].exponent_milli) == (2, 0, 6000)


def test_planting(spark, checkpoints):
    docs = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(-40, 200)]
    docs += [(None, "a b"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = periodic_runs.plant_periods(df).collect()
    assert [(r.doc_id, (r.text or "").split()) for r in got] == [(i, planted(i, t)) for i, t in docs]


def test_edges(edge_docs, no_docs):
    got = rows(periodic_runs.find_runs(edge_docs))
    docs = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=repr)
    assert len(got) == len(docs)
    for i, n, runs, left in got:
        words = next((t or "").split() for d, t in docs if d == i and len((t or "").split()) == n)
        assert [tuple(r) for r in runs] == ([] if n > 1000 else brute(words))
        if not runs:
            assert left == " ".join(words)
    assert rows(periodic_runs.find_runs(no_docs)) == []
    empty = periodic_runs.run_digest(periodic_runs.find_runs(edge_docs.filter("doc_id = 2"))).first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(empty) == (2, 0, None, None, None, None, nothing, nothing)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(edge_docs, exponent=2)


def test_a_long_run_of_one_word(spark, checkpoints):
    df = spark.createDataFrame([(1, "a " * 60_000)], "doc_id long, text string")
    r = periodic_runs.find_runs(df).first()
    assert [tuple(x) for x in r.runs] == [(0, 60_000, 1)] and r.collapsed == "a"
