"""Corpus cleaning from `documents` to token ids, in stages that each keep, drop or change documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes what a stage returns as Parquet in the
shared folder and hands the table to the next. All but the last return the columns that came in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reelspark.llm import bpe, decontam, langid, near, pii
from reelspark.llm.common import boxed, unboxed, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that have a language, drops texts without one (null, or without letters)."""
    model = langid.fit(docs)
    if not model["langs"]:  # nothing to learn from
        return docs.where(F.col("text").rlike("\\p{L}"))
    return unboxed(langid.label(boxed(docs), model).where("lang_pred <> 'und'"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id."""
    return near.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak an item of `benchmark`, by its template or by its words as they stand."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), exact=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kind in brackets; n_chars follows the text."""
    out = pii.redact(docs, pii.fit())
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids as little-endian 32-bit integers, and whether they decode to their words."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text"), path)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmark_leaks), ("PII", personal_data), ("BPE encoding and decoding", token_ids)]
ORACLE_SQL: str | None = None  # models and bags are beyond SQL; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
