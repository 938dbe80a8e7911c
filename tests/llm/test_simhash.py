import random
import re

import numpy as np
import pytest
import xxhash

from cohortspark.llm import simhash
from cohortspark.llm.components import connected_components
from tests.conftest import SF_ORACLE
from tests.llm.conftest import rows


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+",
                       re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    runs = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, distance):
    """Connected groups of more than one value, by comparing all pairs."""
    values = np.array(sorted(set(values)), np.uint64)
    root = list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance):
            a, b = top(i), top(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, v in enumerate(values.tolist()):
        groups.setdefault(top(i), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def clusters(seed):
    rnd, made = random.Random(seed), set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(rnd.choice([2, 30, 90])):
            x = centre
            for _ in range(rnd.choice([1, 2, 3, 5])):
                x ^= 1 << rnd.randrange(rnd.choice([64, 20]))
            made.add(x)
    return made


@pytest.mark.parametrize("distance, limit", [(3, 1), (3, 64), (2, 4), (0, 64)])
def test_links_join_what_all_pairs_join(spark, checkpoints, distance, limit):
    """limit 1 sends every posting through the wider sets and the balls."""
    made = clusters(5)
    signed = [x - (1 << 64 if x >> 63 else 0) for x in made]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {}
    for node, root in connected_components(
            simhash.near_links(prints, distance, limit)).collect():
        found.setdefault(root, set()).add(node % (1 << 64))
    assert {frozenset(g) for g in found.values()} == {
        g for g in groups_of(made, distance) if len(g) > 1}


def test_groups_against_brute_force(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text")
    # near copies that differ in a character of a long text, and chains of them
    long_ = " ".join(f"word{i}" for i in range(400))
    planted = [(100_000 + i, long_ + f" end{i}") for i in range(6)]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    least = {}
    for group in groups_of(prints.values(), 3):
        members = [i for i, p in prints.items() if p in group]
        least.update((i, min(members)) for i in members)
    got = simhash.simhash_groups(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{prints[i]:016x}", least[i]) for i in texts}
    assert len({least[i] for i, _ in planted}) < len(planted)


def test_edges(edge_docs, no_docs):
    got = simhash.simhash_groups(edge_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert len(by_id[1]) == 2 and len(set(by_id[1])) == 1
    zero = "0" * 16
    assert by_id[2] == by_id[3] == by_id[4] == [(zero, 2)]  # no words: linked like any other
    assert (zero, 2) in by_id[None]
    assert sum(c is None for _, c in by_id[None]) == 2  # a group without any id
    assert by_id[5] == by_id[6] and by_id[6][0][1] == 5
    assert rows(simhash.simhash_groups(no_docs)) == []


def test_components_of_a_chain_and_a_star(spark, checkpoints):
    chain = [(i, i + 1) for i in range(50)]
    star = [(100, 100 + i) for i in range(1, 60)]
    odd = [(7, 7), (None, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(chain + star + odd, "a long, b long")
    found = {}
    for node, root in connected_components(df).collect():
        assert node not in found
        found[node] = root
    assert found == ({i: 0 for i in range(51)} | {100 + i: 100 for i in range(60)}
                     | {200: 200, 201: 200})
