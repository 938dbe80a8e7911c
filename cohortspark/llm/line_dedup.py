"""Line dedup: two Bloom filters find suspects, only those are counted exactly.

Every task puts the hashes of its lines into two Bloom filters, one of hashes
seen once and one of hashes seen twice.  Filters of tasks merge bit by bit: a
bit that two tasks saw once was seen twice, so every line of two documents is
in the merged second filter.  Only lines that are in it travel, as a digest of
the line and its document, and are counted exactly.

Rabin-Karp hashes serve the filters alone, where a collision costs work and no
result; lines are the same if their 128-bit BLAKE2b digests are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.text import NON_SPACE, mix, span_hashes, text_chunks
from cohortspark.operators.joins import hot_join
from cohortspark.session import cut_lineage

FILTER_BITS = 27     # the filter that is broadcast holds 2^27 bits: 16 MiB
_SLICE_BITS = 16     # filters travel in slices of 2^16 bits
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all lines of texts laid end to end, the bounds of
    their keys, and each text's first line number.

    A key is the line without white space at its ends; of a blank line it is
    empty.  Every text has at least one line.
    """
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, feeds, "right") - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), row])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends[last] = offsets[1:][rows[last]]
    full = np.flatnonzero(NON_SPACE[data])
    a, b = np.searchsorted(full, starts), np.searchsorted(full, ends)
    some = a < b
    low, high = starts.copy(), starts.copy()
    low[some], high[some] = full[a[some]], full[b[some] - 1] + 1
    return starts, ends, low, high, np.searchsorted(rows, np.arange(len(offsets)))


def _keyed(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """line_spans and, for each line, its key's hash, its text's number and
    whether the key is long enough to be counted."""
    starts, ends, low, high, firsts = line_spans(data, offsets)
    lower = _LOWER[data]
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    counted = leads[high] - leads[low] >= min_chars
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    return lower, starts, ends, low, high, firsts, span_hashes(lower, low, high), text, counted


def _slots(h: np.ndarray, bits: int):
    """The two bits of a hash."""
    shift = np.uint64(64 - bits)
    return ((h >> shift).astype(np.int64), (mix(h * _SECOND + np.uint64(1)) >> shift).astype(np.int64))


def _has(table: np.ndarray, slots) -> np.ndarray:
    out = np.ones(len(slots[0]), bool)
    for s in slots:
        out &= (table[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _set(table: np.ndarray, slots, which) -> None:
    for s in slots:
        np.bitwise_or.at(table, s[which] >> 3, np.left_shift(1, s[which] & 7).astype(np.uint8))


def _filters(bits: int, min_chars: int):
    """A task's texts -> its two filters, slice by slice, blank slices left out."""
    def run(batches):
        once, twice = (np.zeros(1 << (bits - 3), np.uint8) for _ in range(2))
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                *_, hashes, text, counted = _keyed(data, offsets, min_chars)
                order = np.lexsort((text[counted], hashes[counted]))
                h, text = hashes[counted][order], text[counted][order]
                new = np.ones(len(h), bool)        # a line counts once a document
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                h, n = np.unique(h[new], return_counts=True)
                slots = _slots(h, bits)
                _set(twice, slots, (n > 1) | _has(once, slots))
                _set(once, slots, slice(None))
        pack = zstandard.ZstdCompressor(level=1).compress
        once, twice = (x.reshape(-1, min(len(x), 1 << (_SLICE_BITS - 3))) for x in (once, twice))
        used = np.flatnonzero(once.any(axis=1))
        for i in range(0, len(used), 256):
            part = used[i:i + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([pack(once[s]) for s in part], pa.binary()),
                 pa.array([pack(twice[s]) for s in part], pa.binary())],
                names=["slice", "once", "twice"])
    return run


def _merged(batches):
    """Slices of all tasks -> one row per slice: the bits that were seen twice."""
    open_ = zstandard.ZstdDecompressor().decompress
    held: dict[int, list] = {}
    for batch in batches:
        for number, once, twice in zip(*(batch.column(c).to_pylist()
                                         for c in ("slice", "once", "twice"))):
            once, twice = (np.frombuffer(open_(x), np.uint8) for x in (once, twice))
            if number in held:
                all_once, all_twice = held[number]
                held[number] = [all_once | once, all_twice | twice | (all_once & once)]
            else:
                held[number] = [once, twice]
    pack = zstandard.ZstdCompressor(level=1).compress
    yield pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.int32()),
         pa.array([pack(x[1].tobytes()) for x in held.values()], pa.binary())],
        names=["slice", "twice"])


def seen_twice(texts: DataFrame, bits: int = FILTER_BITS, min_chars: int = 1) -> bytes:
    """The filter of lines seen in two texts, 2^``bits`` bits.

    Tasks send their filters' slices compressed; a slice's reducer holds two
    arrays of its size.  The driver puts the slices of the second filter
    together, which is 2^``bits`` / 8 bytes however many lines there are.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, 1 << (bits - _SLICE_BITS)) if bits > _SLICE_BITS else 1
    rows = (texts.mapInArrow(_filters(bits, min_chars), "slice int, once binary, twice binary")
            .repartition(min(parts, slices), "slice").mapInArrow(_merged, "slice int, twice binary"))
    size = min(1 << (bits - 3), 1 << (_SLICE_BITS - 3))
    table = bytearray(1 << (bits - 3))
    for number, blob in rows.toLocalIterator():
        table[number * size:(number + 1) * size] = zstandard.ZstdDecompressor().decompress(blob)
    return bytes(table)


def _suspects(bits: int, min_chars: int, shared):
    """Texts -> (doc_id, text digest, [line digest, first line number])."""
    line = pa.struct([("key", pa.binary()), ("line", pa.int32())])

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column("text")):
                lower, _, _, low, high, firsts, hashes, text, counted = _keyed(
                    data, offsets, min_chars)
                hit = np.flatnonzero(counted & _has(table, _slots(hashes, bits)))
                raw, lowered = data.tobytes(), lower.tobytes()
                found: dict[int, dict] = {}
                for t, a, b, n in zip(text[hit].tolist(), low[hit].tolist(), high[hit].tolist(),
                                      (hit - firsts[text[hit]]).tolist()):
                    found.setdefault(t, {}).setdefault(_digest(lowered[a:b]), n)
                rows = list(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).take(pa.array(rows, pa.int64())),
                     pa.array([_digest(raw[offsets[t]:offsets[t + 1]]) for t in rows], pa.binary()),
                     pa.array([[{"key": k, "line": n} for k, n in found[t].items()] for t in rows],
                              pa.list_(line))], names=["doc_id", "body", "lines"])
    return run


def _named(batches):
    """Texts with their digests."""
    for batch in batches:
        texts = batch.column("text").fill_null("")
        digests = [_digest(t) for t in texts.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), texts],
            names=["doc_id", "body", "text"])


def _cut(batches):
    """Texts with the keys of lines that go -> the lines left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                        ("kept", pa.string()), ("dropped", pa.list_(pa.int32()))])
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column("text")):
            gone = batch.column("gone").slice(i, j - i).to_pylist()
            starts, ends, low, high, firsts = line_spans(data, offsets)
            raw, lowered = data.tobytes(), _LOWER[data].tobytes()
            kept, dropped = [], []
            for t, keys in enumerate(gone):
                first, end = int(firsts[t]), int(firsts[t + 1])
                out = []
                if keys:
                    stays = {k["key"]: k["stays"] for k in keys}
                    out = [n for n in range(end - first)
                           if (k := _digest(lowered[low[first + n]:high[first + n]])) in stays
                           and stays[k] != n]
                dropped.append(out)
                if not out:
                    kept.append(raw[offsets[t]:offsets[t + 1]])
                    continue
                left = set(out)
                kept.append(b"\n".join(raw[starts[n]:ends[n]] for n in range(first, end)
                                       if n - first not in left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(firsts), pa.int64()),
                 pa.array([len(x) for x in dropped], pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(dropped, pa.list_(pa.int32()))], schema=schema)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                        keep_first: bool = False, bits: int = FILTER_BITS) -> DataFrame:
    """Drop the lines whose key stands in at least ``min_docs`` documents.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read, whatever their names.  Texts are split at line feeds.  A line's key
    is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased;
    keys of fewer than ``min_chars`` code points are never dropped.  A repeated
    key loses all its lines, or with ``keep_first`` all but its first one (the
    smallest doc_id, then the first line).

    Defined results: a null or empty text is one empty line; rows that share a
    doc_id, or have none, are one document, so a repeated row makes no line
    more frequent; each row is returned; null ids come after all others; an
    empty table gives no rows.  Texts of any length are read whole.

    Returns doc_id, n_lines (before), n_dropped, kept (the lines left, joined
    by line feeds) and dropped (the numbers of lines that went, from 0).

    ``bits`` sets the size of the filters.  They fill at about 2^bits / 8
    different lines; from there on more lines that do not repeat are counted,
    40 bytes each, with the same result.  Digests are counted by (line,
    document), so a line of a third of all documents is spread over all tasks,
    and its documents learn of it through ``hot_join``.
    """
    if min_docs < 2:
        raise ValueError("a repeated line stands in two documents at least")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(seen_twice(rows, bits, min_chars))
    suspects = cut_lineage(
        rows.mapInArrow(_suspects(bits, min_chars, shared),
                        "doc_id long, body binary, lines array<struct<key: binary, line: int>>")
        .select("doc_id", "body", F.explode("lines").alias("l"))
        .select("doc_id", "body", "l.key", "l.line"))
    counted = (suspects.groupBy("key")
               .agg((F.count_distinct("doc_id")
                     + F.max(F.col("doc_id").isNull().cast("long"))).alias("n_docs"),
                    F.count("*").alias("n_rows"))
               .filter(F.col("n_docs") >= min_docs).select("key", "n_rows"))
    if keep_first:
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line", "body")
        leads = suspects.groupBy("key").agg(F.min(place).alias("lead"))
        counted = counted.join(leads, "key")
    else:
        counted = counted.withColumn("lead", F.lit(True))
    met = hot_join(suspects, counted, ["key"], "n_rows", spread=["doc_id", "body"]) \
        .filter(F.col("lead").isNotNull())
    own = F.lit(False)
    if keep_first:
        own = (F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.body") == F.col("body"))
               & (F.col("lead.line") == F.col("line")))
    gone = (met.select("doc_id", "body", F.struct(
                "key", F.when(own, F.col("line")).otherwise(-1).alias("stays")).alias("k"))
            .groupBy(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body"))
            .agg(F.collect_set("k").alias("gone")))
    named = rows.mapInArrow(_named, "doc_id long, body binary, text string")
    return (named.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id"))
                       & (F.col("body") == F.col("gone_body")), "left")
            .select("doc_id", "text", "gone")
            .mapInArrow(_cut, "doc_id long, n_lines long, n_dropped long, kept string, "
                              "dropped array<int>"))


def line_digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept lines."""
    return cut.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
