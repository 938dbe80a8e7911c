"""Byte-level text helpers used inside Spark's Python tasks.

Texts are handled as UTF-8 bytes.  Every separator of the word patterns used
here is an ASCII byte, so splitting bytes and splitting code points give the
same words.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 2 << 20  # text handled at once by the array code, one text at least

_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xD1342543DE82EF95 | 1
SECOND_BASE = 0xA0761D6478BD642F | 1  # for a hash of the same spans that differs

# words [^\x20\x09-\x0D]+ : bytes that belong to a word
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: what each
# byte becomes (0x20 for a separator)
ALNUM = np.full(256, 32, dtype=np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    ALNUM[_b] = _b
for _b in range(65, 91):
    ALNUM[_b] = _b + 32
ALNUM_TABLE = ALNUM.tobytes()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (bytes.split() splits at those six bytes)."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(ALNUM_TABLE).split()


def texts_of(column) -> list[bytes | None]:
    """A string column's texts as UTF-8 bytes, None for null."""
    return column.cast(pa.binary()).to_pylist()


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker process, across tasks."""
    home = sys.modules.setdefault("_cohortspark_llm_worker",
                                  types.ModuleType("_cohortspark_llm_worker"))
    return home.__dict__.setdefault(name, {})


def text_chunks(column, max_bytes: int = CHUNK_BYTES):
    """Split a string column into runs of rows of about ``max_bytes`` of text.

    Yields (first row, end row, bytes as uint8, offsets of the rows in them);
    a null is an empty text.  A text above the limit is a run of its own.
    """
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_spans(in_word: np.ndarray, offsets: np.ndarray):
    """Byte starts and ends of the words, and each text's first word number.

    ``in_word`` says which bytes belong to words; a word never runs over the
    end of a text.
    """
    edges = offsets[(offsets > 0) & (offsets < len(in_word))]
    before = np.zeros(len(in_word), bool)
    before[1:] = in_word[:-1]
    before[edges] = False
    starts = np.flatnonzero(in_word & ~before)
    after = np.zeros(len(in_word), bool)
    after[:-1] = in_word[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(in_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Numbers that are equal just if the spans' bytes are, counted from 0 by
    first appearance, and the first span of each number."""
    sizes = ends - starts
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    spans = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes),
        [None, pa.py_buffer(bounds), pa.py_buffer(gather(data, starts, sizes))])
    codes = spans.dictionary_encode().indices.to_numpy().astype(np.int64)
    top = np.maximum.accumulate(codes)
    new = np.ones(len(codes), bool)
    new[1:] = top[1:] > top[:-1]
    return codes, np.flatnonzero(new)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The two halves of the spans' 128-bit XXH3, made once for each different
    span.  Unlike ``span_hashes`` no family of texts is known to collide in
    them, so they may stand for words of any length."""
    codes, lead = word_codes(data, starts, ends)
    halves = bytes_hashes(data, starts[lead], ends[lead])
    return halves[0][codes], halves[1][codes]


def bytes_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The two halves of each span's 128-bit XXH3."""
    raw = data.tobytes()
    digests = b"".join(xxhash.xxh3_128_digest(raw[a:b])
                       for a, b in zip(starts.tolist(), ends.tolist()))
    halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (kept by the worker)."""
    store = worker_store("powers")
    if base not in store or len(store[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            run = np.full(size, b, np.uint64)
            run[0] = 1
            made.append(np.cumprod(run))
        store[base] = tuple(made)
    return store[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                base: int = _WORD_BASE) -> np.ndarray:
    """64-bit polynomial hashes of byte spans: differences of prefix sums.

    Long spans made for it collide (Thue-Morse words from 1,024 bytes on), so
    these serve filters and short spans, never as the identity of a word.
    """
    return sums_hashes(prefix_sums(data, base), starts, ends, base)


def prefix_sums(data: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """Prefix sums of a buffer's polynomial, for sums_hashes."""
    up, _ = _powers(base, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return sums


def sums_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                base: int = _WORD_BASE) -> np.ndarray:
    _, down = _powers(base, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_table(keys: np.ndarray, values: np.ndarray):
    """Open-addressing table from 64-bit hashes to positive numbers:
    (bits, longest step from a key's own slot, keys, values)."""
    bits = max(4, (4 * len(keys)).bit_length())
    slot_keys, slot_values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
    reach, taken = 0, np.zeros(1 << bits, bool)
    for k, v, slot in zip(keys, values, (keys >> np.uint64(64 - bits)).tolist()):
        step = 0
        while taken[slot]:
            slot, step = (slot + 1) % (1 << bits), step + 1
        taken[slot], slot_keys[slot], slot_values[slot] = True, k, v
        reach = max(reach, step)
    return bits, reach, slot_keys, slot_values


def find(table, keys: np.ndarray) -> np.ndarray:
    """Values of the keys, 0 for a key that is not in the table."""
    bits, reach, slot_keys, slot_values = table
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    out = np.where(slot_keys[slot] == keys, slot_values[slot], 0)
    for _ in range(reach):
        open_ = np.flatnonzero(out == 0)
        slot[open_] = (slot[open_] + 1) % (1 << bits)
        hit = open_[slot_keys[slot[open_]] == keys[open_]]
        out[hit] = slot_values[slot[hit]]
    return out


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``sizes`` values from ``starts`` on, end to end."""
    before = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]


def window_hashes(words: np.ndarray, firsts: np.ndarray, k: int, base: int = _WINDOW_BASE):
    """Rabin-Karp hashes of every window of ``k`` consecutive words of one text.

    Returns the windows' first word numbers and their hashes.
    """
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    at = np.arange(n - k + 1)
    last = np.repeat(firsts[1:], np.diff(firsts))[:n - k + 1]  # end of the word's text
    at = at[at + k <= last]
    return at, mix((sums[at + k] - sums[at]) * down[at])
