"""The registered queries of this package, each over its whole table, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reelspark.llm import bpe, decontam, diverge, idfile, langid, near, pii, quality, repair, sharding, suffix, warc, weak
from reelspark.llm.common import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return bpe.decode(coded, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = written(warc.write_records(warc.plan_records(table(spark, sf_dir, "pages"))), "warc")
    return warc.read_records(archive).drop("intact")


@query
def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (langid.remainder("doc_id", 4) == 2).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").where(langid.remainder("doc_id", 4) != 2)
    model = quality.fit(quality.sample(docs.where("not held_out"), labels))
    docs = quality.featurise(docs).drop("text")
    return quality.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.remainder("doc_id", 3) != 1))
    return langid.label(docs.select("doc_id", (langid.remainder("doc_id", 3) == 1).alias("held_out"), "text"), model).drop("text")


@query
def op6_personal_data_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit())
    kinds = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *kinds, F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(weak.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    return weak.judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n_windows")).otherwise(0))
    return found.groupBy("doc_id", "item_id").agg(n(decontam.TEMPLATE).alias("n_windows"), n(decontam.WORDS).alias("n_copies"))


ORACLES["op2_template_decontamination"] = decontam.oracle()


@query
def op3_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


@query
def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeat"), "n_shared", (F.col("n_shared") > 0).alias("shares_passage"))




@query
def op11_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return idfile.documents(written(idfile.files(docs, public_tokenizers.path("byte_bpe_50k.json")), "ids"))


@query
def op12_segment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diverge.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLES["op12_segment_trees"] = diverge.oracle()


@query
def op13_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


ORACLES["op3_bag_min_hash"] = near.oracle()
ORACLES["op7_warc_round_trip"] = warc.oracle()
