"""Registered queries of the operators of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clauselake.llm import align, bpe, chat, fingerprint, language, linededup, packing, pieces, quality, ranked, secrets, simhash, suffix
from clauselake.sources.tables import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    light = cut.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(light).withColumnRenamed("id", "doc_id")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.with_next(read(spark, sf_dir, "documents")).withColumn(
        "edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    known = pairs.drop("next_text").withColumns({"n_chars": F.char_length("text").cast("bigint"),
                               "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    return fingerprint.compare_versions(known, carry=("n_chars", "edited_sha256")).withColumnRenamed("id", "doc_id")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :says), (-7L, 1L, 'assistant', :says) AS t(conv_id, turn, role, text)",
                     args={"says": says})
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    made = chat.format_conversations(rows)
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(chat.loss_texts(F.col("segments")), "")
    return (made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", loss)
            .select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                    F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
                    F.char_length("loss").cast("bigint").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("bigint").alias("formatted_chars"), "valid"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = pieces.decode(pieces.encode(docs, model, carry=("source",)), model)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        decoded.alias("decoded_sha256"), (decoded == F.col("source")).alias("restored"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = secrets.shown(secrets.in_order(*secrets.BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        secrets.shown(secrets.in_order(*secrets.BASE_KINDS, "weak")).alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(read(spark, sf_dir, "documents"), *files).withColumnRenamed("digest", "groups_sha256")


def op12_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), file), file)
    told = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(told.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_best_fit_packing, op3_document_fingerprints, op4_chat_formatting, op5_sentencepiece, op6_line_dedup,
                                       op7_suffix_dedup, op8_secret_scans, op9_language_id, op10_simhash_near_dedup,
                                       op11_cross_tokenizer_alignment, op12_bpe_encoding, op13_ranked_search)}
QUERIES["pipeline"] = corpus_pipeline.run
