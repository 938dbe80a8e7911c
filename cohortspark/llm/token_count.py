"""Token counts by a map-side two-tier lookup.

A piece of the model never holds a space behind another character, nor a line
feed, so a text's tokens are those of its pre-tokens: words with the space
before them.  A first pass counts the pre-tokens of all texts; different ones
and their counts are shuffled.  The lengths of the frequent ones are broadcast
as a compact hash table; the others are encoded once per worker and cached.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cohortspark.llm.text import (find, gather, hash_table, text_chunks, texts_of, word_codes,
                                  word_spans, worker_store)

TABLE_ENTRIES = 1 << 16   # frequent pre-tokens in the broadcast table
SUMMARY_ENTRIES = 1 << 13 # counted pre-tokens that a task hands on at once
LEVELS = 64               # levels of a doubling that counts of pre-tokens are told apart by
CACHE_ENTRIES = 300_000   # pre-tokens a worker remembers, then it starts anew

IN_WORD = np.ones(256, bool)
IN_WORD[[10, 32]] = False


def plain(text: bytes) -> bool:
    """Whether every word has one space, one line feed or the text's start
    before it: others go to the library whole."""
    return not (b"  " in text or b" \n" in text or b"\n " in text or text[:1] == b" "
                or text[-1:] == b" " or b"\xe2\x96\x81" in text)


def _pre_tokens(data, offsets):
    """Spans of the pre-tokens; a spaced one begins after a space or at its
    text's start, where the library puts a space."""
    starts, ends, firsts = word_spans(IN_WORD[data], offsets)
    spaced = np.zeros(len(starts), bool)
    inner = starts > 0
    spaced[inner] = data[starts[inner] - 1] == 32
    spaced[np.isin(starts, offsets)] = True
    return starts, ends, firsts, spaced


def _model(path: str):
    import sentencepiece
    store = worker_store("sentencepiece")
    if path not in store:
        store[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return store[path]


def _lengths(model, words: list[bytes], spaced: list[bool]) -> list[int]:
    """Tokens of pre-tokens; one without a space is encoded after a line feed,
    which costs two tokens of its own."""
    ids = model.encode([w if s else b"\n" + w for w, s in zip(words, spaced)], num_threads=1)
    return [len(x) - (0 if s else 2) for x, s in zip(ids, spaced)]


def _distinct(data, starts, ends, spaced):
    """A number for each pre-token, equal just for equal ones, and the first
    pre-token of each number."""
    _, lead, back = np.unique(2 * word_codes(data, starts, ends)[0] + spaced, return_index=True,
                              return_inverse=True)
    return back, lead


def _occurrences(batches):
    """Tasks: the different pre-tokens of each run of texts and how often each
    occurs there; none is left out."""
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column("text")):
            starts, ends, _, spaced = _pre_tokens(data, offsets)
            back, lead = _distinct(data, starts, ends, spaced)
            sizes = ends[lead] - starts[lead]
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            words = pa.BinaryArray.from_buffers(
                pa.binary(), len(lead),
                [None, pa.py_buffer(bounds), pa.py_buffer(gather(data, starts[lead], sizes))])
            found = pa.RecordBatch.from_arrays(
                [words, pa.array(spaced[lead]),
                 pa.array(np.bincount(back, minlength=len(lead)), pa.int64())],
                names=["word", "spaced", "n"])
            for at in range(0, len(lead), SUMMARY_ENTRIES):
                yield found.slice(at, SUMMARY_ENTRIES)


def frequent_pre_tokens(texts: DataFrame) -> list[bytes]:
    """The frequent pre-tokens of all texts, at most TABLE_ENTRIES, a spaced
    one with its space.

    Every occurrence in every text is counted.  Counts are taken by levels of
    1/LEVELS of a doubling, from the highest down as long as whole levels fit
    the table: a pre-token is in the list just if it occurs at least as often
    as the least of them.  Counts meet in one shuffle, which both the levels
    and the list read; the window goes over at most 64 * LEVELS rows.

    The list decides which lengths are looked up in the broadcast table and
    which in the workers' caches; counts of tokens never depend on it.
    """
    counts = (texts.mapInArrow(_occurrences, "word binary, spaced boolean, n long")
              .groupBy("word", "spaced").agg(F.sum("n").alias("n")))
    levels = (counts.groupBy(F.floor(F.log2("n") * LEVELS).alias("level"))
              .agg(F.count("*").alias("words"), F.min("n").alias("least")))
    fitting = (levels.withColumn("held", F.sum("words").over(Window.orderBy(F.desc("level"))))
               .filter(F.col("held") <= TABLE_ENTRIES).agg(F.min("least").alias("least")))
    found = counts.join(F.broadcast(fitting), counts["n"] >= fitting["least"])
    return [(b" " if r["spaced"] else b"") + bytes(r["word"])
            for r in found.select("word", "spaced").collect()]


def length_table(model_path: str, words: list[bytes]):
    keys, lengths = [], []
    bare = [w[1:] if w[:1] == b" " else w for w in words]
    spaced = [w[:1] == b" " for w in words]
    found = _lengths(_model(model_path), bare, spaced) if words else []
    for w, s, n in zip(bare, spaced, found):
        if 0 < n < 256:
            keys.append(xxhash.xxh3_64_intdigest(w, seed=s))
            lengths.append(n)
    return hash_table(np.array(keys, np.uint64), np.array(lengths, np.uint8))


def _count(model_path: str, shared):
    def run(batches):
        table, model = shared.value, _model(model_path)
        store = worker_store("pre_token_lengths")
        cache = store.setdefault(model_path, {})
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column("text")):
                texts = [t or b"" for t in texts_of(batch.column("text").slice(i, j - i))]
                starts, ends, firsts, spaced = _pre_tokens(data, offsets)
                # each different pre-token once; the rest of its occurrences follow
                back, lead = _distinct(data, starts, ends, spaced)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(starts[lead].tolist(), ends[lead].tolist())]
                flags = spaced[lead].tolist()
                lengths = find(table, np.fromiter(map(xxhash.xxh3_64_intdigest, words, flags),
                                                  np.uint64, len(words))).astype(np.int64)
                miss = np.flatnonzero(lengths == 0)
                words, flags = [words[k] for k in miss], [flags[k] for k in miss]
                found = [cache.get((w, s)) for w, s in zip(words, flags)]
                new = [k for k, x in enumerate(found) if x is None]
                if len(cache) + len(new) > CACHE_ENTRIES:
                    cache.clear()
                for k, x in zip(new, _lengths(model, [words[k] for k in new],
                                              [flags[k] for k in new])):
                    found[k] = cache[words[k], flags[k]] = x
                lengths[miss] = found
                sums = np.concatenate([[0], np.cumsum(lengths[back])])
                feeds = np.concatenate([[0], np.cumsum(data == 10)])
                tokens = np.diff(sums[firsts]) + np.diff(feeds[offsets])
                # a line feed at the start follows the space that the library puts there
                tokens += np.array([t[:1] == b"\n" for t in texts], np.int64)
                odd = [k for k, t in enumerate(texts) if not plain(t)]
                for k, ids in zip(odd, model.encode([texts[k] for k in odd], num_threads=1)):
                    tokens[k] = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i),
                     pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read.  ``model_path`` is a byte-fallback BPE model of the sentencepiece
    library; the counts are those of its ``encode``.  Texts with runs of
    spaces, spaces at line ends or the library's own space mark go to the
    library whole.

    A null or empty text has no bytes and no tokens; a null doc_id and
    repeated rows are each returned; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    table = length_table(model_path, frequent_pre_tokens(rows.select("text")))
    shared = spark.sparkContext.broadcast(table)  # TABLE_ENTRIES entries at most
    return (rows.mapInArrow(_count(model_path, shared),
                            "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
