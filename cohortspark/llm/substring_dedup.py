"""Substring dedup: every word window hashed, counted in Spark, repeats cut out.

Rabin-Karp hashes of every window of ``window`` words are dealt by hash to
buckets; each bucket finds the windows that occur again and marks all but the
first; marks come back to their document, where overlapping windows merge into
maximal intervals and the words in them go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.text import (NON_SPACE, SECOND_BASE, bytes_hashes, mix, space_words,
                                  text_chunks, window_hashes, word_hashes, word_spans)

FLUSH_WINDOWS = 1_500_000  # windows a task gathers before it deals them out
BUCKET_BYTES = 64 << 20    # text behind a bucket of windows, and of marks

_NULL_ID = np.iinfo(np.int64).max  # a null id stands after all others


def _planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, low bytes first."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _pack_places(columns, places: np.ndarray, compress) -> bytes:
    """Places of documents, compressed.  ``columns`` say by place which
    document it is in; a document's places stand together and ascend."""
    new = np.ones(len(places), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    gaps = np.diff(places, prepend=0)
    gaps[new] = places[new]
    cuts = np.flatnonzero(new)
    counts = np.diff(np.append(cuts, len(places)))
    return compress(b"".join([
        np.uint32(len(cuts)).tobytes(),
        *(_planes(np.diff(c[cuts], prepend=c.dtype.type(0))) for c in columns),
        _planes(counts.astype(np.uint32)), _planes(gaps.astype(np.uint32))]))


def _unpack_places(blob: bytes, kinds, decompress):
    """The columns, of the given types, and the places."""
    raw = np.frombuffer(decompress(blob), np.uint8)
    n, at = int(raw[:4].view(np.uint32)[0]), 4

    def taken(count, kind):
        nonlocal at
        size = count * np.dtype(kind).itemsize
        at += size
        return np.ascontiguousarray(raw[at - size:at].reshape(-1, count).T).view(kind).ravel()

    columns = [np.cumsum(taken(n, kind), dtype=kind) for kind in kinds]
    counts = taken(n, np.uint32).astype(np.int64)
    sums = np.cumsum(taken(int(counts.sum()), np.uint32), dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    base = np.where(firsts > 0, sums[firsts - 1], 0)
    return (*(np.repeat(c, counts) for c in columns), sums - np.repeat(base, counts))


def _row_keys(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """What marks and texts of a row meet by: doc_id and the text's hash, so
    rows without an id, or of one id, are told apart by their texts."""
    return mix(mix(ids.astype(np.uint64)) + texts)


def _later(ids, places, hashes, more, order) -> np.ndarray:
    """Which entries have an equal hash (of 64 and ``more`` of 16 bits) at a
    lower (id, place); ``order`` sorts by hash, then id, then place."""
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(more[order]) != 0)
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.zeros(len(order), bool)
    again[order] = (ids[order] != ids[lead]) | (places[order] != places[lead])
    return again


def _deal(buckets: int, window: int):
    """Tasks: windows of a run of documents -> one row per bucket.

    Only the first occurrence of a window in the run is sent with its hash;
    the later ones are already known to go and travel as marks.
    """
    schema = pa.schema([("bucket", pa.int32()), ("at", pa.binary()), ("hashes", pa.binary()),
                        ("more", pa.binary()), ("gone", pa.binary())])

    def flush(ids, texts, sizes, hashes, more):
        pack = zstandard.ZstdCompressor(level=1).compress
        doc_ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        hashes, more = np.concatenate(hashes), np.concatenate(more)
        ids, texts = np.repeat(doc_ids, sizes), np.repeat(np.concatenate(texts), sizes)
        places = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if (doc_ids[1:] <= doc_ids[:-1]).any():
            order = np.lexsort((places, texts, ids))
            ids, texts, places, hashes, more = (
                x[order] for x in (ids, texts, places, hashes, more))
            order = np.lexsort((places, ids, more, hashes))
        else:
            order = np.lexsort((more, hashes))
        again = _later(ids, places, hashes, more, order)
        bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[b]:cuts[b + 1]]
            first, gone = at[~again[at]], at[again[at]]
            yield (int(b), _pack_places((ids[first], texts[first]), places[first], pack),
                   hashes[first].tobytes(), more[first].tobytes(),
                   _pack_places((ids[gone], texts[gone]), places[gone], pack)
                   if len(gone) else None)

    def rows(*run):
        got = []
        for row in flush(*run):
            got.append(row)
            if len(got) == 256:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)
                got = []
        if got:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)

    def run(batches):
        held, n = ([], [], [], [], []), 0
        for batch in batches:
            all_ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_chunks(batch.column("text")):
                starts, ends, firsts = word_spans(NON_SPACE[data], offsets)
                words, others = word_hashes(data, starts, ends)
                at, h = window_hashes(words, firsts, window)
                _, more = window_hashes(others, firsts, window, SECOND_BASE)
                texts = bytes_hashes(data, offsets[:-1], offsets[1:])[0].astype(np.uint32)
                for to, x in zip(held, (all_ids[i:j], texts, np.diff(np.searchsorted(at, firsts)),
                                        h, more.astype(np.uint16))):
                    to.append(x)
                n += len(h)
                if n >= FLUSH_WINDOWS:
                    yield from rows(*held)
                    held, n = ([], [], [], [], []), 0
        if n:
            yield from rows(*held)

    return run


def _runs(batches, column: str):
    """Rows of batches sorted by ``column``, as (value, rows) of each value."""
    last, held = None, []
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and values[a] != last:
                yield last, held
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def _count(dests: int):
    """Buckets, one after the other: the windows that occur before, as marks of
    documents, in one row for each group of documents that they go to."""
    kinds = (np.int64, np.uint32)

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=1).compress
        for _, rows in _runs(batches, "bucket"):
            firsts, gone, hashes, more = [], [], [], []
            for batch in rows:
                for at, h, m, marks in zip(*(batch.column(c).to_pylist()
                                             for c in ("at", "hashes", "more", "gone"))):
                    ids, texts, places = _unpack_places(at, kinds, open_)
                    firsts.append((ids, texts, places.astype(np.int32)))
                    hashes.append(np.frombuffer(h, np.uint64))
                    more.append(np.frombuffer(m, np.uint16))
                    if marks is not None:
                        ids, texts, places = _unpack_places(marks, kinds, open_)
                        gone.append((_row_keys(ids, texts), places.astype(np.int32)))
            ids, texts, places = (np.concatenate(x) for x in zip(*firsts))
            hashes, more = np.concatenate(hashes), np.concatenate(more)
            again = _later(ids, places, hashes, more, np.lexsort((places, ids, more, hashes)))
            keys = np.concatenate([_row_keys(ids[again], texts[again]), *(x[0] for x in gone)])
            places = np.concatenate([places[again], *(x[1] for x in gone)])
            dest = (keys % np.uint64(dests)).astype(np.int32)
            order = np.lexsort((places, keys, dest))
            keys, places, dest = keys[order], places[order], dest[order]
            to, first = np.unique(dest, return_index=True)
            cuts = np.append(first, len(dest))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()),
                 pa.array([_pack_places((keys[a:b],), places[a:b], pack)
                           for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["dest", "marks"])

    return run


def _shrink(dests: int):
    """Texts compressed one by one, to be dealt to their marks."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_chunks(batch.column("text")):
                texts = bytes_hashes(data, offsets[:-1], offsets[1:])[0].astype(np.uint32)
                keys = _row_keys(known[i:j], texts)
                raw = data.tobytes()
                bodies = [pack(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys % np.uint64(dests)).astype(np.int32)),
                     pa.array(keys.view(np.int64)), ids.slice(i, j - i),
                     pa.array(bodies, pa.binary())], names=["dest", "key", "doc_id", "body"])

    return run


def _cut(window: int):
    """Groups of documents, one after the other, each with its marks and then its
    texts -> the texts without marked windows."""
    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        group, marks, keys, places = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for dest, key, doc_id, body, mark in zip(*(batch.column(c).to_pylist() for c in (
                    "dest", "key", "doc_id", "body", "marks"))):
                if dest != group:
                    group, marks = dest, []
                    keys, places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if body is None:
                    marks.append(_unpack_places(mark, (np.uint64,), open_))
                    continue
                if marks:  # all marks stand before the first text
                    keys, places = (np.concatenate(x) for x in zip(*marks))
                    order = np.argsort(keys, kind="stable")
                    keys, places, marks = keys[order], places[order], []
                words = space_words(open_(body))
                n = len(words)
                key = np.int64(key).view(np.uint64)
                own = places[np.searchsorted(keys, key):np.searchsorted(keys, key, "right")]
                spans = []
                if len(own):
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, own, 1)
                    np.add.at(step, own + window, -1)
                    inside = np.cumsum(step[:n]) > 0
                    spans = np.flatnonzero(np.diff(np.concatenate(
                        [[False], inside, [False]]))).reshape(-1, 2).tolist()
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                out.append((doc_id, n, n - len(kept), b" ".join(kept),
                            [{"first": a, "end": b} for a, b in spans]))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.binary()).cast(pa.string()),
                     pa.array(cols[4], pa.list_(pa.struct([("first", pa.int32()),
                                                           ("end", pa.int32())])))],
                    names=["doc_id", "n_words", "n_removed", "kept", "removed"])
    return run


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Cut out every word of a window whose words also start earlier.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read, whatever their names.  A window is ``window`` consecutive words
    ``[^\\x20\\x09-\\x0D]+`` of one document; earlier means a smaller doc_id or
    an earlier word of the same one.  Windows are judged on the input.

    Defined results: a null or empty text has no words and stays as an empty
    one; a null doc_id stands after all ids; rows that share a doc_id, or have
    none, are one document, whose windows at an equal place are no earlier
    ones, so a repeated row loses nothing to its own copies; each row is
    returned; an empty table gives no rows.  Texts of
    any length are read whole.

    Returns doc_id, n_words, n_removed, kept (the words left, joined by one
    space) and removed (maximal intervals of word numbers).

    Only the first occurrence of a window in a task's run of documents is
    dealt out, as 80-bit hash and place, so a window that a third of all rows
    share costs a bucket one entry per run.  There are as many buckets as
    BUCKET_BYTES of text each need; a partition sorts its buckets, which
    spills, and a task holds one of them at a time, so its memory does not grow
    with the input.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts * max(1, -(-size // (parts * BUCKET_BYTES)))

    def to_parts(df, number):
        return df.repartitionById(parts, F.expr(f"{number} % {parts}"))

    dealt = rows.mapInArrow(_deal(buckets, window),
                            "bucket int, at binary, hashes binary, more binary, gone binary")
    marks = (to_parts(dealt, "bucket").sortWithinPartitions("bucket")
             .mapInArrow(_count(buckets), "dest int, marks binary")
             .select("dest", F.lit(None).cast("long").alias("key"),
                     F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("body"), "marks"))
    texts = (rows.mapInArrow(_shrink(buckets), "dest int, key long, doc_id long, body binary")
             .withColumn("marks", F.lit(None).cast("binary")))
    return (to_parts(marks.unionByName(texts), "dest")
            .sortWithinPartitions("dest", F.col("body").isNotNull())
            .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string, "
                                      "removed array<struct<first: int, end: int>>"))


def kept_digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return cut.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
