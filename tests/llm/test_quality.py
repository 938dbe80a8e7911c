import re
from collections import Counter

import pytest

from cohortspark.llm import quality
from tests.conftest import SF_ORACLE
from tests.llm.conftest import MORSE, rows


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[s:s + 5]) for s in range(len(w) - 4))
    cover = {p for s in range(len(w) - 4) if seen[tuple(w[s:s + 5])] > 1 for p in range(s, s + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(cover),
            len(w) < 10 or 100 * len(cover) > 20 * len(w))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.fixture(scope="module")
def judged(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    return docs, {r.doc_id: r for r in quality.quality_rules(docs).collect()}


def test_base_counts(judged):
    docs, got = judged
    for r in docs.collect():
        assert tuple(got[r.doc_id][c] for c in BASE) == brute(r.text), r.doc_id
        assert not (got[r.doc_id].kept and got[r.doc_id].base_failed)


def test_clean_documents_stay_and_junk_goes(spark, judged):
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()
    _, got = judged
    clean = [got[r.doc_id] for r in labels if r.quality == 1 and got[r.doc_id].n_words >= 10]
    clean = [r for r in clean if not r.base_failed]
    junk = [got[r.doc_id] for r in labels if r.quality == 0]
    assert all(r.kept for r in clean)
    assert sum(not r.kept for r in junk) > 0.8 * len(junk)


def test_the_half_of_the_labels_that_no_limit_was_chosen_on(spark, checkpoints):
    """Limits come from documents of even number of the larger table; of the
    odd ones no clean document goes, and from 150 words on all junk does."""
    folder = SF_ORACLE.replace("0.01", "0.1")
    got = quality.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = got.join(labels, "doc_id").filter("doc_id % 2 = 1 and not base_failed").collect()
    clean, junk = ([r for r in held if r.quality == q] for q in (1, 0))
    assert len(clean) > 1500 and all(r.kept for r in clean)
    assert sum(not r.kept for r in junk) > 0.9 * len(junk)
    assert not any(r.kept for r in junk if r.n_words >= 150)


def test_small_languages_are_judged_too(spark, checkpoints):
    """No number of documents switches the verdict on: junk among 3 documents
    of a language of its own goes, its other documents stay."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    good = (docs.join(labels.filter("quality = 1"), "doc_id").filter("lang = 'en'")
            .filter("size(split(text, ' ')) > 200").orderBy("doc_id").limit(3))
    junk = spark.createDataFrame([(10 ** 6, "$#%& " * 100 + " ".join(f"x{i}#{i * i}%" for i in range(200)))],
                                 "doc_id long, text string")
    few = good.select("doc_id", "text").unionByName(junk).selectExpr("doc_id", "text", "'xx' as lang")
    for others in (docs, docs.limit(0)):
        got = {r.doc_id: r.kept for r in quality.quality_rules(
            others.filter("lang <> 'xx'").unionByName(few).repartition(3)).filter(
            f"doc_id in ({', '.join(str(r.doc_id) for r in few.collect())})").collect()}
        assert sum(got.values()) == 3 and got[10 ** 6] is False


def test_distances_are_jensen_shannon(spark, checkpoints):
    import numpy as np
    p, q = [5, 0, 3, 2], [1, 1, 1, 1]
    df = spark.createDataFrame([(p, q), (p, p), ([1, 0, 0, 0], [0, 1, 0, 0]), (p, None),
                                (p, [0, 0, 0, 0])], "p array<long>, q array<long>")
    df = df.withColumns({"sp": quality._sum(df["p"]), "sq": quality._sum(df["q"])})
    got = [r[0] for r in df.select(
        quality._distance(df["p"], df["q"], df["sp"], df["sq"])).collect()]

    def js(a, b):
        a, b = np.array(a) / sum(a), np.array(b) / sum(b)
        m = (a + b) / 2
        return np.sqrt(sum((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum() for x in (a, b)) / 2)

    assert got[0] == pytest.approx(js(p, q)) and got[1] == pytest.approx(0, abs=1e-7)
    assert got[2] == pytest.approx(1) and got[3:] == [None, None]


def test_edges(edge_docs, no_docs):
    got = quality.quality_rules(edge_docs)
    assert sorted(tuple(r[c] for c in BASE) for r in got.collect()) == sorted(
        brute(r.text) for r in edge_docs.collect())
    assert all(r.class_distance is None for r in got.collect())  # no language has enough
    assert rows(quality.quality_rules(no_docs)) == []


def test_words_of_equal_polynomial_hashes(spark, checkpoints):
    one, two = MORSE
    text = " ".join(f"w{i}" for i in range(6)) + f" {one} a b c d {two} a b c d"
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    r = quality.quality_rules(df).first()
    assert tuple(r[c] for c in BASE) == brute(text) and not r.base_failed
