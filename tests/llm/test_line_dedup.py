import random
import re
from collections import defaultdict

import pytest

from cohortspark.llm import line_dedup
from tests.conftest import SF_SMALL
from tests.llm.conftest import MORSE, rows

SPACE = "[\\x20\\x09-\\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return re.sub(f"^{SPACE}|{SPACE}$", "", line).translate(LOWER)


def brute(docs, min_docs, min_chars=1, keep_first=False):
    """docs: (doc_id, text); rows of one id, or of none, are one document."""
    where, first = defaultdict(set), {}
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            k = key_of(line)
            where[k].add(i)
            place = (i is None, i or 0, p, t)
            first[k] = min(first.get(k, place), place, key=lambda x: x[:3])
    out = []
    for i, t in docs:
        lines, kept = (t or "").split("\n"), []
        for p, line in enumerate(lines):
            k = key_of(line)
            own = keep_first and first[k] == (i is None, i or 0, p, t)
            if len(k) < min_chars or len(where[k]) < min_docs or own:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(df, *args, **kw):
    return rows(line_dedup.drop_repeated_lines(df, *args, **kw).drop("dropped"))


@pytest.mark.parametrize("bits", [3, 10, 20])
def test_random_lines_with_full_and_empty_filters(spark, checkpoints, bits):
    """A filter of 8 bits suspects everything; the result is the same."""
    rnd = random.Random(bits)
    pool = ["a", " A\t", "b b", "", "  ", "Ünï", "ünï", "c\r", "\x0bC", "日本", "x" * 2000]
    docs = [(rnd.choice([None, 1, 2, 3]) if k % 5 == 0 else 10 + k,
             rnd.choice([None, "", "\n"]) if k % 9 == 0 else
             "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 7)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for min_docs, min_chars in ((2, 1), (10, 1), (14, 2), (10, 0)):
        assert run(df, min_docs, min_chars, bits=bits) == brute(docs, min_docs, min_chars)


def test_first_occurrence_may_stay(spark, checkpoints):
    docs = [(3, "x\nsame\nx"), (1, "own\nSame "), (2, "same\nsame"), (None, "same"),
            (7, "x\ny")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for min_docs in (2, 3, 4):
        assert run(df, min_docs, keep_first=True, bits=12) == brute(docs, min_docs, keep_first=True)
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(df, 3, keep_first=True).collect()}
    assert got[1].kept == "own\nSame " and got[2].dropped == [0, 1] and got[3].kept == "x\nx"


def test_lines_of_equal_polynomial_hashes(spark, checkpoints):
    """Thue-Morse lines share the filters' hash, not their digest."""
    one, two = MORSE
    docs = [(i, one if i % 2 else two) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert all(r[2] == 0 for r in run(df, 4))
    assert all(r[2] == 1 for r in run(df, 3))


def test_small_table(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(5)
    got = run(docs, 10)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 10)
    assert sum(r[2] for r in got) > 0


def test_edges(edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert run(edge_docs, 2) == brute(docs, 2)
    assert [r[2] for r in run(edge_docs, 2) if r[0] in (1, 5, 6)] == [0, 0, 1, 1]
    assert run(no_docs, 2) == []
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(edge_docs, 1)


def test_query_digest(spark, checkpoints):
    import hashlib
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    got = rows(line_dedup.line_digest(line_dedup.drop_repeated_lines(df, 2)))
    assert got == [(1, 2, 0, hashlib.sha256(b"a\nb").hexdigest()),
                   (2, 1, 0, hashlib.sha256(b"").hexdigest())]
