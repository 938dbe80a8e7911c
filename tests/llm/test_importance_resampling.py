import hashlib
import math
import random
import re
import zlib
from collections import Counter

from cohortspark.llm import importance_resampling as ir
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_n):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=25, min_words=20, max_n=2, buckets=10_000, seed=7):
    slot = lambda f: zlib.crc32(f.encode()) % buckets
    corpus = Counter(slot(f) for _, t in docs for f in features(t, max_n)[1])
    wanted = Counter(slot(f) for t in target for f in features(t, max_n)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets)
                                       / ((corpus[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, found = features(text, max_n)
        weight = sum(gain[slot(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= min_words),
                  key=lambda r: (-r[4], r[0] is None, r[0] or 0, *r[1:4]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


def test_small_table(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(5)
    target = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    got = rows(ir.resample(docs, target))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got == want and sum(r[5] is not None for r in got) > 20


def test_random_texts(spark, checkpoints, monkeypatch):
    """Separators of every kind between words; ids that are null or repeat."""
    rnd = random.Random(5)
    words = ["a", "B", "Straße", "日本", "x9", "0", "É"]
    seps = [" ", "\n", ".", "\x00", "\t-", "  ", " "]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(seps)
                           for _ in range(rnd.randrange(30)))
    docs = [(rnd.choice([None, 4, k, k, k]), text()) for k in range(80)] + [(4, "a a")] * 3
    target = [(text(),) for _ in range(9)] + [(None,)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    aim = spark.createDataFrame(target, "text string")
    for kw in ({"percent": 50, "min_words": 2, "max_n": 3, "buckets": 7, "seed": 1},
               {"percent": 100, "min_words": 0, "max_n": 1, "buckets": 50, "seed": 2}):
        assert rows(ir.resample(df, aim, **kw)) == brute(docs, [t for t, in target], **kw)


def test_ranks_are_balanced(spark, checkpoints):
    """Every rank from 1 on, whatever share of rows one text or id holds."""
    docs = [(7, "a b c")] * 300 + [(None, "a b c")] * 300 + [(i, f"w{i} x y") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    aim = spark.createDataFrame([("a b x",)], "text string")
    got = ir.resample(df, aim, percent=40, min_words=3).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 361)) and len(got) == 900
    assert all(a.score >= b.score for a, b in zip(ranked, ranked[1:]))


def test_edges(edge_docs, no_docs, spark):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    target = spark.createDataFrame([("The cat",), ("w1 tail1",), (None,)], "text string")
    want = brute(docs, ["The cat", "w1 tail1"], min_words=1, percent=60)
    assert rows(ir.resample(edge_docs, target, min_words=1, percent=60)) == want
    assert rows(ir.resample(no_docs, target)) == []
    none = target.limit(0)
    assert rows(ir.resample(edge_docs, none, min_words=1)) == brute(docs, [], min_words=1)
