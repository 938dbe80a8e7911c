"""Corpus pipeline: five operators of ``cohortspark.llm`` one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

A verdict belongs to a row's doc_id and texts, not to its doc_id alone: rows
that share an id, or have none, are judged each by its own text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm import decontaminate, piece_sampling, quality, secret_scan, simhash
from cohortspark.llm.queries import PIECE_MODEL, SEED
from cohortspark.session import ensure_checkpoint_dir


def _keyed(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """``docs`` with a digest of ``columns``, and the digest's free name."""
    name = "_row_key"
    while name in docs.columns:
        name += "_"
    parts = [F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit(""))
             for c in columns]
    return docs.withColumn(name, F.md5(F.concat_ws(" ", *parts))), name


def _chosen(docs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id and key are among the verdicts', each once."""
    ids = verdicts.select(F.col("doc_id").alias("_chosen_id"), F.col(key).alias("_chosen_key"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_chosen_id"])
                     & (docs[key] == ids["_chosen_key"]), "left_semi").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed, key = _keyed(docs, ["text", "lang"])
    return _chosen(keyed, quality.quality_rules(keyed, key=key).filter("kept"), key)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id,
    a missing one last; rows of one id and text are one document."""
    keyed, key = _keyed(docs, ["text"])
    groups = simhash.simhash_groups(keyed, shingle=3, distance=3, key=key)
    first = groups.groupBy("group").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", key)).alias("first"))
    chosen = first.select("first.doc_id", F.col(f"first.{key}").alias(key))
    return _chosen(keyed.dropDuplicates(["doc_id", key]), chosen, key)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, key = _keyed(docs, ["text"])
    found = decontaminate.find_contamination(keyed, benchmark, window=10, key=key)
    return _chosen(keyed, found.filter("n_hit = 0"), key)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the secret's kind in brackets."""
    masked = secret_scan.mask_secrets(docs)
    if "n_chars" in masked.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(
            docs.schema["n_chars"].dataType))
    return masked


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled, lossless piece segmentation of every document."""
    return piece_sampling.sample_pieces(docs, public_tokenizers.path(PIECE_MODEL), SEED)


STAGES = [("quality rules", quality_stage), ("SimHash near-dedup", near_dedup_stage),
          ("benchmark decontamination", decontamination_stage), ("secret scans", secret_stage),
          ("SentencePiece encoding", piece_stage)]

# Fingerprints and sampled pieces are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
