"""SimHash near-duplicates through a byte-position inverted index.

A 64-bit fingerprint is eight bytes, and two fingerprints that differ in at
most d bits share at least 8 - d bytes at their places.  Postings of one byte
would each hold 1/256 of all fingerprints, and tallying pairs over them would
be quadratic, so the index is keyed by the fewest sets of byte positions that
every pair with enough shared bytes must meet in (three of four positions in
either half, for d = 3).  Pairs of a posting are tallied for shared positional
bytes, those that reach the guaranteed count are verified by bit distance.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.components import connected_components
from cohortspark.llm.text import space_words, texts_of
from cohortspark.operators.joins import hot_join
from cohortspark.session import cut_lineage

XXH_SEED = 42
POSTING_LIMIT = 64  # longer postings are dealt anew by more bytes, never dropped


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included."""
    if not words:
        return 0
    h = partial(xxhash.xxh64_intdigest, seed=XXH_SEED)
    n = max(1, len(words) - shingle + 1)
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(h, map(b" ".join, runs)), np.dtype(">u8"), n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int, carry: list[str]):
    def run(batches):
        for batch in batches:
            prints = np.fromiter(
                (fingerprint(space_words(t.lower()) if t else [], shingle)
                 for t in texts_of(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64)),
                 *(batch.column(c) for c in carry)], names=["doc_id", "fp", *carry])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3, key: str | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a long; see simhash_groups."""
    carry = ["_key"] if key else []
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"),
                        *([F.col(key).alias("_key")] if key else []))
            .mapInArrow(_fingerprints(shingle, carry),
                        "doc_id long, fp long" + ", _key string" * len(carry)))


# Any five of the eight byte positions hold three of one half.
TRIPLES = [s for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for s in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))


def _key(fp, positions, number: int):
    """Long made of a position set's number and the fingerprint's bytes there."""
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p)
                                            .bitwiseAND(F.lit(255).cast("long")))
    return key


def _links(shared: int, distance: int):
    """Postings -> the links of a spanning forest of each posting's pairs."""
    def run(batches):
        for batch in batches:
            left, right = [], []
            for members in batch.column("fps").to_pylist():
                a = np.array(members, np.int64).view(np.uint64)
                i, j = np.triu_indices(len(a), 1)
                differ = a[i] ^ a[j]
                tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                enough = tally >= shared
                i, j, differ = i[enough], j[enough], differ[enough]
                near = np.bitwise_count(differ) <= distance
                root = list(range(len(a)))

                def top(x):
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for x, y in zip(i[near].tolist(), j[near].tolist()):
                    p, q = top(x), top(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        left.append(members[x])
                        right.append(members[y])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()),
                                              pa.array(right, pa.int64())], names=["a", "b"])
    return run


def _split(postings: DataFrame, limit: int):
    """Postings of 2 to ``limit`` fingerprints, as lists, and the rows of longer ones."""
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sized = cut_lineage(postings.join(sizes, "key"))
    short = (sized.filter(F.col("n") <= limit).groupBy("key")
             .agg(F.collect_list("fp").alias("fps")).select("fps"))
    return short, sized.filter(F.col("n") > limit).select("key", "fp")


def _ball_links(hot: DataFrame, distance: int) -> DataFrame:
    """Links within long postings whose members share the bytes of a set.

    Two members are within ``distance`` bits just if some value is within h
    bits of one and distance - h of the other.  Each member names the values
    within h bits, the least member naming a value heads it, and the members
    within distance - h of a headed value link to its head: rows grow with the
    members, not with their pairs, and every link has a path.
    """
    near = distance // 2
    masks = []
    for number, s in enumerate(FIVES):
        bits = [1 << b for p in range(8) if p not in s for b in range(8 * p, 8 * p + 8)]
        for r in range(distance - near + 1):
            masks += [(number, r, sum(c) - (1 << 64 if sum(c) >> 63 else 0))
                      for c in combinations(bits, r)]
    # a table with a fixed size: it depends on the distance alone
    table = hot.sparkSession.createDataFrame(masks, "number int, r int, mask long")
    named = (hot.withColumn("number", F.shiftrightunsigned("key", 40).cast("int"))
             .join(F.broadcast(table), "number")
             .select("fp", "r", F.col("fp").bitwiseXOR(F.col("mask")).alias("value")))
    heads = named.filter(F.col("r") <= near).groupBy("value").agg(F.min("fp").alias("head"))
    return (named.join(heads, "value").filter("fp <> head")
            .select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct())


def near_links(prints: DataFrame, distance: int = 3, limit: int = POSTING_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join the
    same fingerprints as all pairs within ``distance`` (at most 3) bits do."""
    if not 0 <= distance <= 3:
        raise ValueError("the index is built for 0 to 3 differing bits")
    shared = 8 - distance
    links = partial(_links, shared, distance)
    postings = prints.select("fp", F.explode(F.array(
        *(_key(F.col("fp"), s, i) for i, s in enumerate(TRIPLES)))).alias("key"))
    short, hot = _split(postings, limit)
    edges = short.mapInArrow(links(), "a long, b long")
    # longer postings: all sets of five shared positions, those of a hot triple
    hot = hot.withColumn("number", F.shiftrightunsigned("key", 24).cast("int"))
    inside = F.coalesce(*(F.when(F.col("number") == i, F.array(*(
        _key(F.col("fp"), s, j) for j, s in enumerate(FIVES) if set(t) <= set(s))))
        for i, t in enumerate(TRIPLES)))
    wider = hot.select("fp", F.explode(inside).alias("key")).distinct()
    short, hot = _split(wider, limit)
    edges = edges.unionAll(short.mapInArrow(links(), "a long, b long"))
    return edges.unionAll(_ball_links(hot, distance)).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 3,
                   limit: int = POSTING_LIMIT, key: str | None = None) -> DataFrame:
    """Group documents whose fingerprints are linked by small bit distances.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read.  A text is lower-cased in A-Z and split into words
    ``[^\\x20\\x09-\\x0D]+``; its shingles of ``shingle`` words, repeats
    included, are joined by a space and hashed by XXH64 (seed 42).  Fewer words
    make one shingle; a null, empty or blank text has fingerprint zero and is
    linked like any other.

    Returns one row per input row: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable over links of at most
    ``distance`` differing bits.  A null doc_id is never the smallest; if a
    group has no other, its component_id is null.  Repeated rows are each
    returned.  An empty table gives no rows.  If a string column ``key`` of
    ``docs`` is named, it is returned too, with group: the same number for the
    rows of a group and for no others, also where ids repeat or are missing.

    Equal fingerprints are one node, so exact copies cost one posting entry,
    and rows learn of their group through ``hot_join``.  Postings above
    ``limit`` are not compared member by member: see ``_ball_links``.
    """
    prints = cut_lineage(fingerprints(docs, shingle, key))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
    roots = connected_components(near_links(nodes.select("fp"), distance, limit))
    roots = roots.withColumnRenamed("node", "fp")
    named = roots.join(nodes, "fp")
    groups = named.groupBy("root").agg(F.min("least").alias("group_least"), F.count("*").alias("n"))
    linked = hot_join(named.select("fp", "root"), groups, ["root"], "n", spread=["fp"])
    # a group without links is its own fingerprint; one whose ids are all missing has no least
    labels = nodes.join(linked, "fp", "left").select(
        "fp", "n_rows", F.coalesce("root", "fp").alias("group"), F.when(
            F.col("root").isNull(), F.col("least")).otherwise(F.col("group_least"))
        .alias("component_id"))
    out = hot_join(prints, labels, ["fp"], "n_rows", spread=["doc_id", *(["_key"] if key else [])])
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *(["group", F.col("_key").alias(key)] if key else []))
