import hashlib
import re

from cohortspark.llm import decontaminate
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs far away"),
         (2, "cat sat"), (3, None), (4, "..."), (5, ""), (None, "on the mat"),
         (10, "The quick brown fox jumps over the lazy dog and walks"),
         (10, "The quick brown fox jumps over the lazy dog and walks"),
         (11, "x x x x x x x x x x x x")]


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[tuple(w[s:s + k])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names),
                    hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(docs, benchmark):
    return rows(decontaminate.contamination_digest(
        decontaminate.find_contamination(docs, benchmark)))


def test_small_tables(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    extra = spark.createDataFrame([(9001, "the of that is"), (9002, "and")],
                                  "item_id long, text string")
    items = items.unionByName(extra)
    got = run(docs, items)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()],
                        [tuple(r) for r in items.collect()])
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_edges(spark, edge_docs, no_docs):
    planted = [(50, "see: the QUICK brown fox jumps over the lazy dog and walks. the quick brown "
                    "fox jumps over the lazy dog and runs"), (51, "x " * 30),
               (52, "the quick brown fox jumps over the lazy dog")]
    docs = edge_docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"),
                                 allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for name in ("words", "k", "hashes", "row"):
        items = items.withColumn(name, items["item_id"])
    assert run(docs, items) == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert run(no_docs, items) == []
    clean = run(docs, items.limit(0))
    assert len(clean) == docs.count() and not any(r[5] for r in clean)
