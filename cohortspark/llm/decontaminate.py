"""Benchmark decontamination: prefix-filtered set join, then exact containment.

A benchmark item is cut into windows of ``window`` words, a window into
shingles of five words.  A document holds a window only if it holds all of the
window's shingles, so the prefix a window needs in the join is one shingle: the
rarest in the documents.  Document occurrences of that shingle give candidate
places, bounded by the shingle's position and the window's length, and the
words standing there are compared with the window's words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortspark.llm.text import (ALNUM, alnum_words, span_hashes, text_chunks, texts_of,
                                  window_hashes, word_spans)
from cohortspark.session import cut_lineage

SHINGLE = 5
FILTER_BITS_MAX = 28  # the shingle filter has at most 2^28 bits, 32 MiB
FILTER_BLOCK = 12     # it is put together from blocks of 2^12 bits


def _windows(window: int, shingle: int):
    """Benchmark rows -> windows: item, words, shingle length, shingle hashes."""
    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(),
                                  texts_of(batch.column("text"))):
                words = alnum_words(text) if text else []
                if not words:
                    continue
                size, k = min(window, len(words)), min(shingle, len(words))
                line = b" ".join(words)
                data = np.frombuffer(line, np.uint8)
                starts, ends, firsts = word_spans(data != 32, np.array([0, len(data)]))
                _, hashes = window_hashes(span_hashes(data, starts, ends), firsts, k)
                hashes = hashes.view(np.int64)
                for i in range(len(words) - size + 1):
                    out.append((item, line[starts[i]:ends[i + size - 1]], size, k,
                                hashes[i:i + size - k + 1].tolist()))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()).cast(pa.string()),
                 pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()),
                 pa.array(cols[4], pa.list_(pa.int64()))],
                names=["item_id", "words", "size", "k", "hashes"])
    return run


def _occurrences(window: int, sizes: list[int], bits: int, shared, carry: list[str]):
    """Documents -> word counts and the places of shingles that pass the filter.

    A place carries the words around it, as far as a window through it could
    reach (``lead`` of them stand before it).
    """
    place = pa.struct([("k", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()),
                       ("lead", pa.int32()), ("around", pa.string())])

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        shift = np.uint64(64 - bits)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j, data, offsets in text_chunks(batch.column("text")):
                data = ALNUM[data]
                starts, ends, firsts = word_spans(data != 32, offsets)
                words = span_hashes(data, starts, ends)
                places = [[] for _ in range(j - i)]
                for k in sizes:
                    at, h = window_hashes(words, firsts, k)
                    slot = h >> shift
                    hit = np.flatnonzero(
                        table[(slot >> np.uint64(3)).astype(np.int64)]
                        >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    at, h = at[hit], h[hit].view(np.int64)
                    doc = np.searchsorted(firsts, at, "right") - 1
                    low = np.maximum(at - (window - k), firsts[doc])
                    high = np.minimum(at + window, firsts[doc + 1])
                    for a, v, d, p, q in zip(at.tolist(), h.tolist(), doc.tolist(),
                                             low.tolist(), high.tolist()):
                        around = b" ".join(data[starts[p]:ends[q - 1]].tobytes().split())
                        places[d].append({"k": k, "h": v, "pos": a - int(firsts[d]),
                                          "lead": a - p, "around": around.decode()})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[i:j], pa.int64()),
                     pa.array(np.diff(firsts), pa.int64()),
                     pa.array(places, pa.list_(place)),
                     *(batch.column(c).slice(i, j - i) for c in carry)],
                    names=["doc_id", "n_words", "places", *carry])
    return run


def _shingle_filter(windows: DataFrame) -> tuple[int, bytes]:
    """A bitmap of the shingles' hashes, at most 2^FILTER_BITS_MAX bits.

    Shingles not in the benchmark pass it at a rate of shingles / bits; they
    only cost later work.  It is put together from blocks made in Spark.
    """
    hashes = windows.select(F.explode("hashes").alias("h")).distinct()
    n = hashes.count()
    bits = min(FILTER_BITS_MAX, max(FILTER_BLOCK + 3, (max(n, 1) * 256).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    blocks = (hashes.select(F.shiftright(slot, FILTER_BLOCK).alias("block"),
                            slot.bitwiseAND(F.lit((1 << FILTER_BLOCK) - 1).cast("long"))
                            .cast("int").alias("slot"))
              .groupBy("block").agg(F.sort_array(F.collect_set("slot")).alias("slots")))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for block, slots in blocks.toLocalIterator():
        at = (block << FILTER_BLOCK) + np.array(slots, np.int64)
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits, table.tobytes()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                       shingle: int = SHINGLE, key: str | None = None) -> DataFrame:
    """Mark document words that stand inside benchmark windows.

    ``docs`` needs ``doc_id`` (integer) and ``text``, ``benchmark`` needs
    ``item_id`` (integer) and ``text``; other columns are not read.  Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is
    ``window`` consecutive words of an item, or all words of a shorter item.

    Returns one row per document row: doc_id, n_words, n_hit (words inside any
    occurrence of a window) and items (ids of the items with occurring
    windows, as strings, sorted), and the string column ``key`` of ``docs`` if
    one is named.  Null or empty texts have no words and no
    hits; items without words have no windows; a null doc_id is kept, a null
    item_id takes no place in items though its windows hit; repeated rows are
    each returned, repeated items count once; empty tables on either side give
    no rows or no hits.
    """
    spark = docs.sparkSession
    carry = ["_key"] if key else []
    windows = cut_lineage(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                         F.col("text").cast("string").alias("text"))
        .mapInArrow(_windows(window, shingle),
                    "item_id long, words string, size int, k int, hashes array<long>"))
    sizes = [r[0] for r in windows.select("k").distinct().orderBy("k").collect()]  # 1..shingle
    bits, table = _shingle_filter(windows)
    shared = spark.sparkContext.broadcast(table)
    found = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"),
                    *([F.col(key).alias("_key")] if key else []))
        .mapInArrow(_occurrences(window, sizes, bits, shared, carry),
                    "doc_id long, n_words long, places array<struct<k: int, h: long, pos: int, "
                    "lead: int, around: string>>" + ", _key string" * len(carry))
        .withColumn("row", F.monotonically_increasing_id()))
    places = (found.select("row", F.explode("places").alias("p"))
              .select("row", "p.k", "p.h", "p.pos", "p.lead", "p.around"))
    # order by rarity: how often each shingle stands in the documents
    own = windows.dropDuplicates(["words"])
    shingles = own.select("words", "size", "k", F.posexplode("hashes").alias("offset", "h"))
    seen = places.groupBy("k", "h").agg(F.count("*").alias("n"))
    prefix = (shingles.join(seen, ["k", "h"], "left")
              .groupBy("words", "size", "k")
              .agg(F.min(F.struct("n", "offset", "h")).alias("rarest"),
                   F.count("*").alias("all"), F.count("n").alias("present"))
              .filter("all = present")  # a shingle nowhere: the window is nowhere
              .select("words", "size", "k", "rarest.offset", "rarest.h"))
    start = F.col("lead") - F.col("offset")
    matches = (places.join(prefix, ["k", "h"])
               .withColumn("near", F.split("around", " "))
               .filter((start >= 0) & (start + F.col("size") <= F.size("near")))
               .filter(F.array_join(F.slice("near", start + 1, F.col("size")), " ")
                       == F.col("words"))
               .select("row", (F.col("pos") - F.col("offset")).alias("first"),
                       (F.col("pos") - F.col("offset") + F.col("size")).alias("end"), "words"))
    matches = cut_lineage(matches)
    spans = matches.groupBy("row", "first").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("first")
                               .rowsBetween(Window.unboundedPreceding, -1))
    hits = (spans.withColumn("before", before)
            .withColumn("new", F.greatest(
                F.lit(0), F.col("end") - F.greatest("first", F.coalesce("before", F.lit(0)))))
            .groupBy("row").agg(F.sum("new").alias("n_hit")))
    items = (matches.select("row", "words").distinct()
             .join(windows.select("words", "item_id").distinct(), "words")
             .groupBy("row")
             .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    return (found.select("row", "doc_id", "n_words", *carry)
            .join(hits, "row", "left").join(items, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    *(F.col(c).alias(key) for c in carry)))


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
