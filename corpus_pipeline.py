"""A training-text pipeline over `documents`: language, lines, near-duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import language, linededup, packing, secrets, simhash
from clauselake.llm.shared import written
from clauselake.sources.tables import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; `lang` stays as given and is filled in where it is null."""
    rows = docs.select(*COLUMNS)
    found = language.predict(rows, language.fit(rows), carry=COLUMNS[1:]).where("not rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds."""
    return linededup.dedup_lines(docs.select(*COLUMNS), carry=("lang", "source")).select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("bigint").alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link (three words, two bits): the one with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets masked."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    light = cut.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(light).withColumnRenamed("id", "doc_id")


STAGES = [("language", known_language), ("lines", fresh_lines), ("near_duplicates", one_of_each), ("secrets", without_secrets),
          ("packing", packed)]

# the language model, the bit counts of fingerprints and the tokens have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
