"""Importance resampling towards a target distribution of hashed n-grams.

A batch's texts are joined with separator sentinels into one buffer, one
regular expression pass finds all its words, and ``searchsorted`` over the
texts' starts says which text a word is in, which masks the n-grams that would
run over the end of a text.  Bucket counts of corpus and target give each
bucket a gain, documents their mean gain, and Gumbel noise drawn from the
doc_id turns the best scores into a sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.text import ALNUM_TABLE, text_chunks
from cohortspark.operators.ranks import with_cumulative
from cohortspark.session import cut_lineage

_WORD = re.compile(rb"[^ \n]+")  # after the translation of separators to spaces


def _features(data: np.ndarray, offsets: np.ndarray, max_n: int, buckets: int):
    """Buckets of all n-grams of a run of texts, each n-gram's text, and each
    text's number of words."""
    raw = data.tobytes().translate(ALNUM_TABLE)
    bounds = offsets.tolist()
    buffer = b"\n".join(raw[a:b] for a, b in zip(bounds, bounds[1:]))
    spans = [m.span() for m in _WORD.finditer(buffer)]
    n_texts = len(bounds) - 1
    starts = np.fromiter((a for a, _ in spans), np.int64, len(spans))
    text = np.searchsorted(offsets[:-1] + np.arange(n_texts), starts, "right") - 1
    words = [buffer[a:b] for a, b in spans]
    n_words = np.bincount(text, minlength=n_texts)
    sums = list(map(crc32, words))
    found, owner = [], []
    for n in range(1, max_n + 1):
        if n > 1:  # the checksum of a run goes on from that of the run without its last word
            sums = list(map(crc32, words[n - 1:], [crc32(b" ", c) for c in sums[:len(words) - n + 1]]))
        values = np.fromiter(sums, np.int64, len(sums)) % buckets
        whole = text[n - 1:] == text[:len(sums)]
        found.append(values[whole])
        owner.append(text[:len(sums)][whole])
    return np.concatenate(found), np.concatenate(owner), n_words


def _counts(max_n: int, buckets: int):
    """A task's texts -> (bucket, how many features are in it)."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                total += np.bincount(_features(data, offsets, max_n, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())],
                                         names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, max_n: int, buckets: int) -> list[int]:
    """Features by bucket over all texts: a list of ``buckets`` numbers.

    Tasks send their sums, one row a bucket; the driver gets ``buckets`` rows.
    """
    rows = (texts.select(F.col("text").cast("string").alias("text"))
            .mapInArrow(_counts(max_n, buckets), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """Per bucket floor(1000 ln) of how much likelier the target is to fall in
    it than the corpus, each count smoothed by one."""
    n = len(corpus)
    of_corpus, of_target = float(sum(corpus) + n), float(sum(target) + n)
    return [math.floor(1000 * math.log(float(t + 1) * of_corpus / (float(s + 1) * of_target)))
            for s, t in zip(corpus, target)]


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, drawn from the doc_id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(max_n: int, buckets: int, seed: int, shared):
    def run(batches):
        gains = np.array(shared.value, np.float64)
        for batch in batches:
            ids = batch.column("doc_id")
            draws = np.fromiter((noise(seed, i) for i in ids.to_pylist()), np.int64, len(ids))
            for i, j, data, offsets in text_chunks(batch.column("text")):
                found, owner, n_words = _features(data, offsets, max_n, buckets)
                n = np.bincount(owner, minlength=j - i)
                total = np.bincount(owner, weights=gains[found], minlength=j - i).astype(np.int64)
                weight = total // np.maximum(n, 1)  # floors go down
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(weight, pa.int64()), pa.array(weight + draws[i:j], pa.int64())],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20,
             max_n: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Draw ``percent`` of the documents, as if from the target's distribution.

    ``docs`` needs ``doc_id`` (integer) and ``text``, ``target`` needs
    ``text``; other columns are not read.  Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; features are
    all runs of 1 to ``max_n`` words joined by a space, in the bucket of their
    CRC-32 modulo ``buckets``.  Of the N documents with at least ``min_words``
    words the floor(percent * N / 100) highest scores are drawn.

    Returns one row per document: doc_id, n_words, n_features, weight (floored
    mean gain, 0 without features), score (weight and noise) and rank (1, 2, 3
    ... by falling score, ties to the smaller doc_id; null if not drawn).

    Defined results: a null or empty text has no words; a null doc_id draws
    noise of its own, shared by all of them, and stands after all ids in ties;
    repeated rows are each returned, with ranks of their own; with an empty
    target, or one without words, gains measure the corpus against an even
    spread; an empty table gives no rows.

    Ranks come from running counts over slices of scores (``with_cumulative``),
    never from one task's sort; equal rows are folded to one first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(rows, max_n, buckets), bucket_counts(target, max_n, buckets))
    shared = spark.sparkContext.broadcast(gains)  # one number a bucket
    scored = cut_lineage(rows.mapInArrow(
        _scores(max_n, buckets, seed, shared),
        "doc_id long, n_words long, n_features long, weight long, score long"))
    place = ["down", "no_id", "doc_id", "n_words", "n_features", "weight", "score"]
    folded = (scored.filter(F.col("n_words") >= min_words)
              .withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("int")})
              .groupBy(*place).agg(F.count("*").alias("copies")))
    ranked = with_cumulative(folded, [], place, "copies", out="before", total="of", slice_by="down")
    ranked = ranked.withColumn("rank", F.explode(F.sequence(
        F.col("before") + 1, F.col("before") + F.col("copies"))))
    drawn = F.expr(f"rank <= of * {int(percent)} div 100")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(drawn, F.col("rank")).alias("rank")).unionAll(
        scored.filter(F.col("n_words") < min_words)
        .select(*columns, F.lit(None).cast("long").alias("rank")))
