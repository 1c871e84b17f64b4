"""The registered queries of the training-data operators, one for each, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import chat_format, embed_neardup, gru_lm, license_scan, line_dedup, merkle, mixing, ngram_join, packing, quality, secrets_crf, token_files, whitening
from alertloom.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_neardup.near_dups(read(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(read(spark, sf_dir, "documents")).select(*cols, "lang", "source", "distance")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.chat_format(rows.unionByName(extra)))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "set_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.summary(secrets_crf.scan(read(spark, sf_dir, "documents")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(read(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.read_back(spark, token_files.write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_embedding_near_dedup, op3_license_scan, op4_quality_rules, op5_chat_format, op6_source_mixing, op7_ngram_jaccard_join, op8_best_fit_packing, op9_secret_scan, op10_lm_scoring, op11_token_files, op12_merkle_manifest, op13_embedding_whitening)}
