"""Quality rules by distribution divergence from the document's language.

Every document's character classes and common words are counted; the mean
histograms of a language over the whole input, drawn towards those of all
languages by a few documents' weight, are its reference.  A document whose
Jensen-Shannon distance from its language is larger than chance makes it at
its length is rejected, besides those that fail the base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from cohortspark.llm.text import (NON_SPACE, mix, span_hashes, text_chunks, texts_of,
                                  window_hashes, word_hashes, word_spans, worker_store)
from cohortspark.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
REPEAT_WORDS = 5         # words of a window that must not stand twice
# A distance is too large above a + b / sqrt(words): chance alone moves short
# documents away from their language.  Chosen on the even half of the labels.
CLASS_LIMIT = (0.12, 1.4)   # character classes
WORD_LIMIT = (0.07, 2.4)     # common words
MIN_CLASS_WORDS = 20     # guard: words for the class verdict
MIN_WORDS = 30           # guard: words for the common-word verdict
REF_CHARS = 200          # word characters and words of the documents that
REF_WORDS = 150          # make the reference
PRIOR_DOCS = 20          # weight, in documents, of all languages in a reference
SHARE = 1_000_000        # histograms are shares of this, as integers: sums are exact

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "was", "on",
           "by", "this", "it", "be", "are", "from", "an", "a", "at", "or", "not", "have"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "des", "ein",
           "eine", "im", "nicht", "auf", "für", "dem", "sich", "als", "auch", "es", "an", "ich"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "est", "que",
           "qui", "dans", "pour", "par", "sur", "pas", "au", "avec", "il", "ce", "ne", "se"],
    "es": ["el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "es",
           "por", "con", "para", "se", "no", "su", "al", "lo", "como", "más", "o", "le"],
}

# Character classes: lower, upper, digit, beyond ASCII, white space,
# punctuation, symbol, control; 8 marks the bytes that continue a character.
CLASSES = 8
CLASS_OF = np.full(256, 7, np.uint8)
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58] = 0, 1, 2
CLASS_OF[192:], CLASS_OF[128:192] = 3, 8
CLASS_OF[[9, 10, 11, 12, 13, 32]] = 4
CLASS_OF[list(b".,;:!?'\"()-")] = 5
CLASS_OF[list(b"#*$%&|<>@/\\=+_[]{}~^`")] = 6

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SLOT_BITS = 20


def _word_table():
    """Word hash -> its number among all common words; several lists may hold it."""
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data != 32, np.array([0, len(data)]))
    hashes = span_hashes(data, starts, ends)
    slots = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
    assert len(set(slots.tolist())) == len(words)
    table = np.full(1 << _SLOT_BITS, -1, np.int16)
    table[slots] = np.arange(len(words))
    return words, hashes, table


def _count_chunk(data, offsets):
    """Per text: words, word characters, repeated words, class and word counts."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    cells = np.repeat(np.arange(n) * 9, lens) + CLASS_OF[data]
    classes = np.bincount(cells, minlength=9 * n).reshape(n, 9)[:, :CLASSES]
    starts, ends, firsts = word_spans(NON_SPACE[data], offsets)
    hashes, _ = word_hashes(data, starts, ends)
    at, windows = window_hashes(hashes, firsts, REPEAT_WORDS)
    repeat = np.zeros(len(starts) + REPEAT_WORDS, np.int32)
    if len(at):
        doc = np.searchsorted(firsts, at, "right").astype(np.uint64)
        key = mix(windows ^ mix(doc))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeat, at[twice], 1)
        np.add.at(repeat, at[twice] + REPEAT_WORDS, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(repeat[:len(starts)]) > 0)])
    words, common, table = _word_table_of_worker()
    low = span_hashes(LOWER[data], starts, ends)
    number = table[(low >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
    real = np.flatnonzero(number >= 0)
    real = real[common[number[real]] == low[real]]
    doc = np.searchsorted(firsts, real, "right") - 1
    counts = np.bincount(doc * len(words) + number[real],
                         minlength=n * len(words)).reshape(n, len(words))
    chars = classes.sum(axis=1) - classes[:, 4]
    return np.diff(firsts), chars, np.diff(inside[firsts]), classes, counts


def _word_table_of_worker():
    store = worker_store("quality")
    if "table" not in store:
        store["table"] = _word_table()
    return store["table"]


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return np.where(total > 0, counts * SHARE // np.maximum(total, 1), 0)


def _measure(carry: list[str]):
    """Documents -> base counts and both histograms as integer shares."""
    def run(batches):
        return _measured(batches, carry)
    return run


def _measured(batches, carry):
    words = _word_table_of_worker()[0]
    columns = {lang: [words.index(w) for w in ws] for lang, ws in COMMON_WORDS.items()}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        ids = batch.column("doc_id")
        for i, j, data, offsets in text_chunks(batch.column("text")):
            texts = texts_of(batch.column("text").slice(i, j - i))
            n_words, chars, repeat, classes, counts = _count_chunk(data, offsets)
            common = []
            for r, lang in enumerate(langs[i:j]):
                if lang in columns:
                    own = counts[r, columns[lang]]
                    row = np.append(own, n_words[r] - own.sum())[None, :]
                    common.append(_shares(row)[0].tolist())
                else:
                    common.append([])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(langs[i:j], pa.string()),
                 pa.array(n_words, pa.int64()), pa.array(chars, pa.int64()),
                 pa.array([len(t) - len(t.translate(None, SYMBOLS)) if t else 0
                           for t in texts], pa.int64()),
                 pa.array([_duplicate_lines(t) if t else 0 for t in texts], pa.int64()),
                 pa.array(repeat, pa.int64()),
                 pa.array(_shares(classes).tolist(), pa.list_(pa.int64())),
                 pa.array(common, pa.list_(pa.int64())),
                 *(batch.column(c).slice(i, j - i) for c in carry)],
                names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "classes", "common", *carry])


def _distance(p, q, of_p, of_q):
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms, given their
    sums; NULL if one is missing or empty."""
    def part(a, b, of_a, of_b):  # a's half of the divergence
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(
            x > 0, x / of_a * F.log2(2 * (x / of_a) / (x / of_a + y / of_b))).otherwise(0.0)),
            F.lit(0.0), lambda s, x: s + x)

    divergence = (part(p, q, of_p, of_q) + part(q, p, of_q, of_p)) / 2
    return F.when((of_p > 0) & (of_q > 0) & divergence.isNotNull(),
                  F.sqrt(F.greatest(F.lit(0.0), divergence)))


def _sum(histogram):
    return F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x)


def quality_rules(docs: DataFrame, class_limit: tuple[float, float] = CLASS_LIMIT,
                  word_limit: tuple[float, float] = WORD_LIMIT,
                  key: str | None = None) -> DataFrame:
    """Count the base rules and judge each document against its language.

    ``docs`` needs ``doc_id`` (integer), ``text`` and ``lang``; other columns
    are not read.  Words are ``[^\\x20\\x09-\\x0D]+``.  A language's reference
    is the sum of the histograms of its documents that pass the base rules and
    have REF_CHARS characters and REF_WORDS words, and PRIOR_DOCS times the
    mean over all languages (of common words by their place in the lists): a
    language with few documents is judged by little more than that mean, and
    nothing is switched off.  ``kept`` is false if a base rule fails, or if the
    character classes (from MIN_CLASS_WORDS words on) or the common words (from
    MIN_WORDS words on) are further from the reference than a + b / sqrt(words),
    for the given limits (a, b).

    Defined results: a null or empty text has no words and fails the base
    rule; a null language is a language of its own, without common words, as
    is any language without a list; without any document for a reference there
    is no verdict besides the base rules; repeated rows count and are returned
    each; an empty table gives no rows.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance, kept, and the
    string column ``key`` of ``docs`` if one is named.
    """
    carry = ["_key"] if key else []
    rows = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang"),
                    *([F.col(key).alias("_key")] if key else []))
        .mapInArrow(_measure(carry), "doc_id long, lang string, n_words long, word_chars long, "
                    "n_symbols long, n_dup_lines long, n_repeat_words long, "
                    "classes array<long>, common array<long>" + ", _key string" * len(carry))
        .withColumn("base_failed", (F.col("n_words") < 10)
                    | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    behind = ~F.col("base_failed") & (F.col("word_chars") >= REF_CHARS) & (
        F.col("n_words") >= REF_WORDS)
    width = 1 + max(len(ws) for ws in COMMON_WORDS.values())

    def sums(name, n):
        return F.array(*(F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0).cast(LongType()))
                         for i in range(n)))

    # a row per language, those without a document behind their reference too
    own = (rows.select(F.col("lang").alias("ref_lang"), F.size("common").alias("listed"),
                       F.when(behind, F.col("classes")).alias("classes"),
                       F.when(behind, F.col("common")).alias("common"))
           .groupBy("ref_lang").agg(F.count("classes").alias("n"),
                                    sums("classes", CLASSES).alias("classes"),
                                    sums("common", width).alias("common"),
                                    F.max("listed").alias("listed")))
    # and one of all of them together
    mean = own.agg(F.struct(F.sum("n").alias("n"), sums("classes", CLASSES).alias("classes"),
                            sums("common", width).alias("common"))).scalar()

    def reference(name):
        return F.zip_with(name, f"mean.{name}", lambda x, m: x.cast("double")
                          + PRIOR_DOCS * F.try_divide(m.cast("double"), F.col("mean.n").cast("double")))

    references = (own.withColumn("mean", mean)
                  .select("ref_lang", reference("classes").alias("ref_classes"),
                          F.slice(reference("common"), 1, F.greatest("listed", F.lit(1)))
                          .alias("ref_common"))
                  .withColumns({f"_{c}": _sum(F.col(c)) for c in ("ref_classes", "ref_common")}))
    judged = (rows.join(references, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
              .withColumns({f"_{c}": _sum(F.col(c)) for c in ("classes", "common")}))
    by_class = _distance(*(F.col(c) for c in (
        "classes", "ref_classes", "_classes", "_ref_classes")))
    by_word = F.when(F.size("common") > 0, _distance(*(F.col(c) for c in (
        "common", "ref_common", "_common", "_ref_common"))))
    limit = lambda ab: ab[0] + ab[1] / F.sqrt("n_words")
    strange = (((F.col("n_words") >= MIN_CLASS_WORDS) & (by_class > limit(class_limit)))
               | ((F.col("n_words") >= MIN_WORDS) & (by_word > limit(word_limit))))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", by_class.alias("class_distance"), by_word.alias("word_distance"),
        (~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))).alias("kept"),
        *(F.col(c).alias(key) for c in carry))
