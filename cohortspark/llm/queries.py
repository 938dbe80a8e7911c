"""The registered query of each operator, with production parameters.

Every query applies its operator to its whole table and derives the digest
columns from the operator's output.  ``public_tokenizers`` only names the
place of the vocabulary files.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm import (decontaminate, html_extract, importance_resampling, license_scan,
                             line_dedup, periodic_runs, piece_sampling, quality, secret_scan,
                             simhash, substring_dedup, token_count, token_files)
from cohortspark.session import ensure_checkpoint_dir

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
END_ID = 2
TOKEN_LIMIT = 4096
SEED = 42


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(decontaminate.find_contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder,
                                  public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", "crc32").withColumnRenamed("crc32", "ids_crc32")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.scan_licenses(
        _table(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path(PIECE_MODEL), TOKEN_LIMIT)


def op9_piece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_pieces(_table(spark, sf_dir, "documents"),
                                        public_tokenizers.path(PIECE_MODEL), SEED)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digest(substring_dedup.remove_repeats(
        _table(spark, sf_dir, "documents"), window=20))


def op11_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(line_dedup.drop_repeated_lines(
        _table(spark, sf_dir, "documents"), min_docs=10, min_chars=1))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.plant_periods(_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digest(periodic_runs.find_runs(planted, min_words=6, exponent=4))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25,
        min_words=20, max_n=2, buckets=10_000, seed=7).drop("n_words")


QUERIES = {f.__name__: f for f in (
    op1_simhash_groups, op2_main_text, op3_contamination, op4_quality_rules, op5_token_files,
    op6_licenses, op7_secrets, op8_token_counts, op9_piece_samples, op10_repeats,
    op11_repeated_lines, op12_periodic_runs, op13_resample)}

# Lower-cased words [0-9a-z and beyond ASCII] of the named text column.
_ALNUM = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
          r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
_SPACED = (r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), "
           r"lambda x: x <> '')")

# Characters of each class of the quality rules, in order, as patterns.
_CLASS_PATTERNS = [
    "[a-z]", "[A-Z]", "[0-9]", r"[^\x00-\x7F]", r"[\x20\x09-\x0D]", r"""[.,;:!?'"()\-]""",
    r"[#*$%&|<>@/\\=+_\[\]{}~^`]", r"[\x00-\x08\x0E-\x1F\x7F]"]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count_of(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, {_text(pattern)}, '', 'g')))"


_COMMON = ", ".join(f"({_text(lang)}, {i}, {_text(w)})"
                    for lang, words in quality.COMMON_WORDS.items()
                    for i, w in enumerate(words, 1))


def _half(a: str, of_a: str, b: str, of_b: str) -> str:
    p, q = f"({a} / {of_a})", f"({b} / {of_b})"
    return f"CASE WHEN {a} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"


def _distances(histogram: str) -> str:
    """SELECT of doc key and distance for one of the two histograms."""
    return f"""
  SELECT k, CASE WHEN max(of_p) > 0 AND max(of_q) > 0 THEN
           sqrt(greatest(0, sum({_half('p', 'of_p', 'q', 'of_q')}
                                + {_half('q', 'of_q', 'p', 'of_p')}) / 2)) END AS d
  FROM (SELECT k, CAST(h.x AS DOUBLE) AS p, CAST(r.x AS DOUBLE) AS q,
               CAST(sum(h.x) OVER (PARTITION BY k) AS DOUBLE) AS of_p,
               CAST(sum(r.x) OVER (PARTITION BY k) AS DOUBLE) AS of_q
        FROM {histogram} h JOIN ref_{histogram} r
          ON h.lang IS NOT DISTINCT FROM r.lang AND h.i = r.i)
  GROUP BY k"""


def _reference(histogram: str) -> str:
    """SELECT of a language's reference: its documents' sums and the weighted mean of all."""
    return f"""
  WITH own AS (SELECT lang, i, sum(x) AS x FROM {histogram} WHERE k IN (SELECT k FROM behind)
               GROUP BY lang, i),
  mean AS (SELECT i, CAST(sum(x) AS DOUBLE) / (SELECT count(*) FROM behind) AS m FROM own GROUP BY i)
  SELECT cells.lang, cells.i, CAST(coalesce(x, 0) AS DOUBLE) + {quality.PRIOR_DOCS} * m AS x
  FROM (SELECT DISTINCT lang, i FROM {histogram}) cells JOIN mean ON cells.i = mean.i
  LEFT JOIN own ON cells.lang IS NOT DISTINCT FROM own.lang AND cells.i = own.i"""


def _limit(ab: tuple[float, float]) -> str:
    return f"CAST({ab[0]!r} AS DOUBLE) + CAST({ab[1]!r} AS DOUBLE) / sqrt(CAST(n_words AS DOUBLE))"


_QUALITY = f"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t, {_SPACED} AS w
  FROM documents),
repeats AS (
  SELECT k, count(DISTINCT p) AS n FROM (
    SELECT k, unnest(range(s, s + 5)) AS p FROM (
      SELECT k, s, count(*) OVER (PARTITION BY k, words) AS c FROM (
        SELECT k, s, array_to_string(w[s:s + 4], ' ') AS words
        FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS s FROM docs WHERE len(w) >= 5)))
    WHERE c > 1) GROUP BY k),
base AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM (
    SELECT docs.k, doc_id, lang, t, w, len(w) AS n_words,
           length(array_to_string(w, '')) AS word_chars,
           {_count_of('[#*$%&|<>]')} AS n_symbols,
           len(list_filter(string_split(t, chr(10)),
                           lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)),
                           lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
           coalesce(n, 0) AS n_repeat_words
    FROM docs LEFT JOIN repeats ON docs.k = repeats.k)),
class_counts AS (
  SELECT k, lang, [{', '.join(map(_count_of, _CLASS_PATTERNS))}] AS c FROM base),
classes AS (
  SELECT k, lang, unnest(range(1, len(c) + 1)) AS i,
         unnest(list_transform(c, lambda x: CASE WHEN list_sum(c) > 0
                THEN x * {quality.SHARE} // CAST(list_sum(c) AS BIGINT) ELSE 0 END)) AS x
  FROM class_counts),
listed(lang, i, v) AS (VALUES {_COMMON}),
met AS (
  SELECT k, i, count(*) AS c FROM (
    SELECT k, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz') AS v FROM base)
  JOIN listed USING (lang, v) GROUP BY k, i),
common_counts AS (
  SELECT k, lang, i, coalesce(c, 0) AS c, n_words
  FROM base JOIN listed USING (lang) LEFT JOIN met USING (k, i)),
common AS (
  SELECT k, lang, i, CASE WHEN n_words > 0 THEN c * {quality.SHARE} // n_words ELSE 0 END AS x
  FROM common_counts
  UNION ALL
  SELECT k, lang, max(i) + 1, CASE WHEN max(n_words) > 0
         THEN CAST(max(n_words) - sum(c) AS BIGINT) * {quality.SHARE} // max(n_words) ELSE 0 END
  FROM common_counts GROUP BY k, lang),
behind AS (
  SELECT k, lang FROM base
  WHERE NOT base_failed AND word_chars >= {quality.REF_CHARS} AND n_words >= {quality.REF_WORDS}),
ref_classes AS ({_reference('classes')}),
ref_common AS ({_reference('common')}),
by_class AS ({_distances('classes')}),
by_word AS ({_distances('common')})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       round(by_class.d, 6) AS class_distance, round(by_word.d, 6) AS word_distance,
       NOT base_failed
       AND NOT coalesce(n_words >= {quality.MIN_CLASS_WORDS}
                        AND by_class.d > {_limit(quality.CLASS_LIMIT)}, false)
       AND NOT coalesce(n_words >= {quality.MIN_WORDS}
                        AND by_word.d > {_limit(quality.WORD_LIMIT)}, false) AS kept
FROM base LEFT JOIN by_class USING (k) LEFT JOIN by_word USING (k)"""

ORACLES = {
    "op4_quality_rules": _QUALITY,
    "op3_contamination": f"""
WITH items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
        FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM docs, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, places.n, s FROM places JOIN win USING (n, words)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op11_repeated_lines": r"""
WITH line AS (
  SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op13_resample": f"""
WITH bits AS (
  SELECT i, c FROM (SELECT i, list_reduce(list_concat([i], range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
of_docs AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
         lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs),
of_items AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)),
         lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM items),
named AS (
  SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
           list_transform(range(0, octet_length(encode(f))),
             lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT f FROM of_docs UNION SELECT f FROM of_items), crc),
doc_buckets AS (SELECT b, count(*) AS s FROM of_docs JOIN named USING (f) GROUP BY b),
item_buckets AS (SELECT b, count(*) AS t FROM of_items JOIN named USING (f) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln(
           CAST(coalesce(t, 0) + 1 AS DOUBLE)
           * CAST((SELECT count(*) FROM of_docs) + 10000 AS DOUBLE)
           / (CAST(s + 1 AS DOUBLE)
              * CAST((SELECT count(*) FROM of_items) + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM doc_buckets LEFT JOIN item_buckets USING (b)),
summed AS (
  SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g
  FROM of_docs JOIN named USING (f) JOIN gains USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
         CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) + 0.5)
                                   / 4294967296.0::DOUBLE))) AS BIGINT) AS noise
  FROM docs LEFT JOIN summed USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS of
  FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + noise AS score,
       CASE WHEN r <= 25 * of // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op10_repeats": f"""
WITH docs AS (SELECT doc_id, {_SPACED} AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS k FROM win)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS line
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(line, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""",
}
