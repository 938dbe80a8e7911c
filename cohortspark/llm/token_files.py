"""Token-id files: documents compressed one by one with a shared dictionary.

A file set is a folder with two Parquet tables.  ``dictionary`` holds one row:
the zstandard dictionary, its SHA-256 and the width of an id in bytes.
``shards`` holds the documents in ascending order of id: a row is a shard, a
run of documents from ``first_id`` to ``last_id`` whose frames lie end to end in ``payload``; ``offsets`` is the
index of the frames, ``dictionary`` the hash of the dictionary they need.  One
document is read by decompressing its own frame.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortspark.llm.text import (NON_SPACE, gather, text_chunks, word_codes, word_spans,
                                  worker_store)

SAMPLE_DOCS = 1000          # documents the dictionary is trained on (expected)
SAMPLE_BYTES = 32 << 10     # of each, at most
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 1 << 20       # payload of a shard; a larger document is a shard of its own
CACHE_WORDS = 250_000       # words of a generation whose ids a worker remembers
LEVEL = 3

SHARDS = ("part int, shard int, first_id long, last_id long, tokens_before long, tokens long, "
          "dictionary string, "
          "doc_ids array<long>, lengths array<int>, offsets array<long>, payload binary")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers
    store = worker_store("tokenizers")
    if path not in store:
        store[path] = tokenizers.Tokenizer.from_file(path)
    return store[path]


def _specials(path: str) -> list[bytes]:
    """The strings the tokenizer cuts out of the raw text, A-Z in lower case."""
    store = worker_store("specials")
    if path not in store:
        store[path] = [t.content.encode().lower()
                       for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return store[path]


# Punctuation that may end a word and is then a pre-token of its own.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?%*$#&)]}\"'-")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def _parts(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]):
    """The texts with fewer different words, and the spans of these.

    The tokenizer lower-cases, so A-Z may come in lower case, but for a letter
    before a byte beyond ASCII, with which it might be composed first.  A
    letter and the punctuation that ends its word are never in one token.
    Special tokens are matched before that, in their own case: a word that
    holds one's string in any case stays as it is, and whole.
    """
    capital = (data >= 65) & (data < 91)
    capital[:-1] &= data[1:] < 128
    own, text, data = data, data.tobytes().lower(), data + np.uint8(32) * capital
    starts, ends, _ = word_spans(NON_SPACE[data], offsets)
    whole = np.zeros(len(starts), bool)
    for s in specials:
        at = text.find(s)
        while at >= 0:
            whole[np.searchsorted(starts, at, "right") - 1] = True
            at = text.find(s, at + len(s))
    for a, b in zip(starts[whole].tolist(), ends[whole].tolist()):
        data[a:b] = own[a:b]
    core = np.maximum.accumulate(np.where(_TAIL[data], 0, np.arange(1, len(data) + 1)))[ends - 1]
    tail = core[(core > starts) & (core < ends) & _LETTER[data[core - 1]] & ~whole]
    return data, np.sort(np.concatenate([starts, tail])), np.sort(np.concatenate([tail, ends]))


def _encode(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and each text's first id.

    The tokenizer drops white space before it looks at anything else, so a
    text's ids are those of its words.  A worker remembers words it has met of
    late: of two generations, the older goes when the younger is full.
    """
    tokenizer = _tokenizer(path)
    young, old = worker_store("word_ids").setdefault(path, ({}, {}))
    data, starts, ends = _parts(data, offsets, _specials(path))
    firsts = np.searchsorted(starts, offsets)
    back, lead = word_codes(data, starts, ends)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[lead].tolist(), ends[lead].tolist())]
    if len(young) + len(words) > CACHE_WORDS:
        young, old = worker_store("word_ids")[path] = ({}, young)
    found = [young.get(w) or old.get(w) for w in words]
    new = [k for k, x in enumerate(found) if x is None]
    for k, e in zip(new, tokenizer.encode_batch_fast([words[k].decode() for k in new],
                                                     add_special_tokens=False)):
        found[k] = np.array(e.ids, np.uint32).tobytes()
    young.update(zip(words, found))
    flat = np.frombuffer(b"".join(found), np.uint32)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    n = sizes[back]
    before = np.concatenate([[0], np.cumsum(n)])
    return gather(flat, (np.cumsum(sizes) - sizes)[back], n), before[firsts]


def _texts_ids(path: str, end_id: int, column):
    """Every text's ids with the end id, in order."""
    for _, _, data, offsets in text_chunks(column):
        ids, cuts = _encode(path, data, offsets)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield np.append(ids[a:b], np.uint32(end_id))


def _samples(path: str, end_id: int, width: int):
    def run(batches):
        for batch in batches:
            rows = [ids.astype(f"<u{width}").tobytes()[:SAMPLE_BYTES]
                    for ids in _texts_ids(path, end_id, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["sample"])
    return run


def train_dictionary(rows: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """A dictionary from the serialized ids of about SAMPLE_DOCS documents.

    The sample steers the size of the files alone, never what is read back.
    Without enough samples to train on, the samples themselves are it.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    got = (rows.select("text").sample(share, 42)
           .mapInArrow(_samples(path, end_id, width), "sample binary").collect())
    samples = [bytes(r["sample"]) for r in got]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data)


def _write(path: str, end_id: int, width: int, dictionary: bytes):
    name = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)).compress
        part = TaskContext.get().partitionId()
        shard, before = 0, 0
        doc_ids, lengths, frames, held = [], [], [], 0

        def row():
            least = next((i for i in doc_ids if i is not None), None)  # null ids come first
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()),
                "first_id": pa.array([least], pa.int64()),
                "last_id": pa.array([doc_ids[-1]], pa.int64()),
                "tokens_before": pa.array([before], pa.int64()),
                "tokens": pa.array([sum(lengths)], pa.int64()),
                "dictionary": pa.array([name], pa.string()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "offsets": pa.array([np.cumsum([0, *map(len, frames)]).tolist()],
                                    pa.list_(pa.int64())),
                "payload": pa.array([b"".join(frames)], pa.binary())})

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(ids_of, _texts_ids(path, end_id, batch.column("text"))):
                frame = pack(ids.astype(f"<u{width}").tobytes())
                doc_ids.append(doc_id)
                lengths.append(len(ids))
                frames.append(frame)
                held += len(frame)
                if held >= SHARD_BYTES:
                    yield row()
                    shard, before = shard + 1, before + sum(lengths)
                    doc_ids, lengths, frames, held = [], [], [], 0
        if doc_ids:
            yield row()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Encode whole texts and write a token file set into ``folder``.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read.  ``path`` is a tokenizer file of the tokenizers library that drops
    white space; ``end_id`` closes every document.  Documents are dealt into
    ranges of doc_id and written by Spark's Parquet writer, so a lost executor
    or a repeated attempt leaves no half-written or doubled shard.

    A null text is an empty one (the end id alone); null doc_ids come first;
    rows that repeat a doc_id follow each other in the order of their texts'
    hashes; an empty table makes an empty set that can be read.
    """
    spark = docs.sparkSession
    width = 2 if max(_tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(rows, path, end_id, width)
    spark.createDataFrame(
        [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary), width)],
        "hash string, dictionary binary, width int").write.parquet(f"{folder}/dictionary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(_write(path, end_id, width, dictionary), SHARDS)
     .write.option("compression", "none").parquet(f"{folder}/shards"))


def _opened(spark: SparkSession, folder: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["hash"]:
        raise ValueError(f"the dictionary in {folder} does not have the hash it names")
    return row["hash"], data, row["width"]


def _read(name: str, dictionary: bytes, width: int):
    def run(batches):
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("a shard needs another dictionary")
                payload, offsets = memoryview(row["payload"]), row["offsets"]
                starts, ids_of, before = [], [], row["tokens_before"]
                for a, b, n in zip(offsets, offsets[1:], row["lengths"]):
                    ids = np.frombuffer(open_(payload[a:b]), f"<u{width}")
                    if len(ids) != n:
                        raise ValueError("a document's length is not the index's")
                    ids_of.append(ids.astype("<u4").tobytes())
                    starts.append(before)
                    before += n
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(starts), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start_in_part": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(row["lengths"], pa.int64()),
                    "crc32": pa.array([zlib.crc32(x) for x in ids_of], pa.int64()),
                    "ids": pa.array(ids_of, pa.binary())})
    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a file set: doc_id, start (ids of all documents before it),
    n_tokens, crc32 and ids (little-endian unsigned 32-bit integers)."""
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    docs = shards.mapInArrow(_read(*_opened(spark, folder)),
                             "part int, doc_id long, start_in_part long, n_tokens long, "
                             "crc32 long, ids binary")
    # one row per range of documents: as many as the writing tasks
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return docs.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "crc32",
        "ids")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id; only their frames are opened.

    The shards' first and last ids are columns of their own with Parquet
    statistics, so files and row groups without the id are not read."""
    name, dictionary, width = _opened(spark, folder)
    open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
    rows = (spark.read.schema(SHARDS).parquet(f"{folder}/shards")
            .filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
            .filter(F.array_contains("doc_ids", F.lit(doc_id)))
            .select("part", "shard", "dictionary", "payload",
                    F.posexplode("doc_ids").alias("at", "doc_id"), "offsets")
            .filter(F.col("doc_id") == doc_id)
            .select("part", "shard", "at", "dictionary",
                    F.expr("substring(payload, int(offsets[at]) + 1, "
                           "int(offsets[at + 1] - offsets[at]))").alias("frame"))
            .orderBy("part", "shard", "at").collect())
    if any(r["dictionary"] != name for r in rows):
        raise ValueError("a shard needs another dictionary")
    return [np.frombuffer(open_(bytes(r["frame"])), f"<u{width}").tolist() for r in rows]
