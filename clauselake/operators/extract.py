"""Named answers (parties, dates, law ...) from patterns and, optionally, a model's answer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.batches import first_answers
from clauselake.functions.lookup import lookup
from clauselake.functions.text import let, unfold
from clauselake.rules.vocab import (ALL_EXTRACTION_TYPES, EXTRACTION_PATTERNS, EXTRACTION_QUESTIONS, EXTRACTION_TYPES,
                                    EXTRACTION_WORDS)

PATTERN_CONFIDENCE = 0.9
TRUSTED, MIN_MODEL_CONFIDENCE, MIN_MODEL_TEXT = 0.8, 0.5, 20


def answers(text: Column, types=EXTRACTION_TYPES) -> Column:
    """Array of (ext_type, value, confidence, method), one per asked type, in order.

    The value is what the first pattern of the type that matches finds, at its first match.
    """
    known = [list(zip(EXTRACTION_WORDS.get(n, ()), EXTRACTION_PATTERNS.get(n, ()))) for n in types]
    named = F.arrays_zip(F.array(*[F.lit(n) for n in types]).alias("ext_type"), first_answers(text, known).alias("value"))
    return F.transform(named, lambda r: F.struct(
        r["ext_type"].alias("ext_type"), F.coalesce(r["value"], F.lit("")).alias("value"),
        F.when(r["value"].isNotNull(), F.lit(PATTERN_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(r["value"].isNotNull(), F.lit("pattern")).otherwise(F.lit("none")).alias("method")))


def extract(docs: DataFrame, text: str = "body", types=EXTRACTION_TYPES, id_col: str = "doc_id") -> DataFrame:
    """Long table of pattern answers, one row per document and asked type."""
    rows = docs.select(id_col, F.length(text).alias("text_chars"), answers(F.col(text), types).alias("answers"))
    return (unfold(rows, [id_col, "text_chars"], F.col("answers"), "type_order", "a")
            .select(id_col, "type_order", "a.*", "text_chars"))


def merge_answers(extracted: DataFrame, model: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Let model answers(doc_id, ext_type, value, confidence) fill or beat weak pattern answers."""
    good = (model.where((F.col("value") != "") & (F.col("confidence") >= MIN_MODEL_CONFIDENCE))
            .select(id_col, "ext_type", F.col("value").alias("m_value"), F.col("confidence").alias("m_confidence")))
    weak = (F.col("method") == "none") | (F.col("confidence") < TRUSTED)
    better = weak & (F.col("text_chars") >= MIN_MODEL_TEXT) & F.col("m_confidence").isNotNull() & (
        (F.col("method") == "none") | (F.col("m_confidence") > F.col("confidence")))
    return (extracted.join(good, [id_col, "ext_type"], "left")
            .select(id_col, "type_order", "ext_type",
                    F.when(better, F.col("m_value")).otherwise(F.col("value")).alias("value"),
                    F.when(better, F.col("m_confidence")).otherwise(F.col("confidence")).alias("confidence"),
                    F.when(better, F.lit("ml")).otherwise(F.col("method")).alias("method")))


def merged_answers(found: Column, model: Column, chars: Column) -> Column:
    """`merge_answers` inside the document's row: answers of the document and array of a model's (ext_type, value, confidence).

    Of several usable model answers of one type the surest counts, of equals the first by its text.
    """
    order = F.array_sort(F.transform(
        F.filter(model, lambda m: (m["value"] != "") & (m["confidence"] >= MIN_MODEL_CONFIDENCE)),
        lambda m: F.struct(m["ext_type"].alias("ext_type"), (-m["confidence"]).alias("minus"), m["value"].alias("value"))))

    def row(a, usable):
        def choose(best):
            weak = (a["method"] == "none") | (a["confidence"] < TRUSTED)
            better = best.isNotNull() & weak & (chars >= MIN_MODEL_TEXT) & ((a["method"] == "none") | (-best["minus"] > a["confidence"]))
            return F.struct(a["ext_type"].alias("ext_type"), F.when(better, best["value"]).otherwise(a["value"]).alias("value"),
                            F.when(better, -best["minus"]).otherwise(a["confidence"]).alias("confidence"),
                            F.when(better, F.lit("ml")).otherwise(a["method"]).alias("method"))

        return let(F.get(F.filter(usable, lambda m: m["ext_type"] == a["ext_type"]), 0), choose)

    return F.when(model.isNull(), found).otherwise(let(order, lambda usable: F.transform(found, lambda a: row(a, usable))))


def questions(docs: DataFrame, text: str = "body", types=ALL_EXTRACTION_TYPES, id_col: str = "doc_id") -> DataFrame:
    """(document, type, question, text) rows to hand to an answer model."""
    return (docs.select(id_col, F.col(text).alias("text"),
                        F.explode(F.array(*[F.lit(t) for t in types])).alias("ext_type"))
            .withColumn("question", lookup(F.col("ext_type"), EXTRACTION_QUESTIONS)))
