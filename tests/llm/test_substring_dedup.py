import random
import re

import pytest

from cohortspark.llm import substring_dedup
from tests.conftest import SF_SMALL
from tests.llm.conftest import MORSE, rows


def brute(docs, window):
    """docs: (doc_id, text) -> (doc_id, n_words, n_removed, kept); null ids come last."""
    place = lambda i: (i is None, i or 0)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (place(i), s)), (place(i), s))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (place(i), s):
                gone.update(range(s, s + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=repr)


def run(df, window):
    return rows(substring_dedup.remove_repeats(df, window).drop("removed"))


def test_small_table(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(5)
    got = run(docs, 20)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 20)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("flush", [1, 50, 10 ** 6])
def test_random_texts(spark, checkpoints, monkeypatch, flush):
    """Few different words, so windows repeat within and across documents."""
    monkeypatch.setattr(substring_dedup, "FLUSH_WINDOWS", flush)
    rnd = random.Random(flush)
    docs = [(rnd.choice([None, -3, 2, 5, 9, 14, 20, 31]) if k % 3 else k,
             " ".join(rnd.choice("abc") for _ in range(rnd.randrange(40)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert run(df, 5) == brute(docs, 5)


def test_many_small_buckets(spark, checkpoints, monkeypatch):
    """Hundreds of buckets and groups of documents in each partition."""
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 40)
    rnd = random.Random(1)
    docs = [(rnd.choice([None, k, k, k]), " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(60))))
            for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert run(df, 4) == brute(docs, 4)


def test_intervals_are_maximal(spark, checkpoints):
    words = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(words)), (2, "x " + " ".join(words[3:28]) + " y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, 20).collect()}
    assert got[1].removed == [] and [tuple(s) for s in got[2].removed] == [(1, 26)]
    assert got[2].kept == "x y"


def test_edges(edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = run(edge_docs, 20)
    assert got == brute(docs, 20)
    assert [r[2] for r in got if r[0] == 6] == [60_000]  # a whole copy goes
    assert run(no_docs, 20) == []


def test_words_of_equal_polynomial_hashes(spark, checkpoints):
    one, two = MORSE
    docs = [(1, " ".join([one] * 20)), (2, " ".join([one] * 19 + [two])), (2, one), (2, two)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = run(df, 20)
    assert got == brute(docs, 20) and all(r[2] == 0 for r in got)
