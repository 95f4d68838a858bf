"""Extractive summaries and key points.

A sentence is worth the number of legal terms it holds, so a summary depends on
its own text only: no corpus statistics, no word-keyed shuffle, and the same
result in a batch and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauselake.functions.batches import summaries_of
from clauselake.functions.text import is_ascii, strip, unfold, word_count
from clauselake.operators.segment import batch_sections, foreign_paragraphs, section_array, section_id
from clauselake.rules.model import java_pattern, whole_words
from clauselake.rules.term import LEGAL_TERMS
from clauselake.rules.vocab import KEY_POINT_SECTION_TYPES, SUMMARY_SECTION_TYPES

# Length limits, section counts and the fallback sentence.
MAX_WORDS, MIN_WORDS = 150, 30
MIN_SUMMARY_CHARS = 50
MAX_SECTIONS, KEY_SECTIONS = 10, 5
NO_SUMMARY = "Contract analysis could not generate a summary."
TERM_WORDS = whole_words(w for t in LEGAL_TERMS for w in t.words)


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def summarize(text: Column) -> Column:
    """`summary_of`, worked out for whole batches of texts."""
    by_batch = summaries_of(text, TERM_WORDS, MAX_WORDS, MIN_WORDS, MIN_SUMMARY_CHARS)
    return F.coalesce(by_batch, F.when(~is_ascii(text), summary_of(text)))


def summary_of(text: Column) -> Column:
    """Best sentences first until 150 words, at least until 30, put back into reading order."""
    scored = F.transform(sentences(text), lambda s, i: F.struct(
        (-F.regexp_count(s, F.lit(java_pattern(TERM_WORDS)))).alias("worth"), i.alias("pos"),
        word_count(s).alias("words"), s.alias("sentence")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<pos:int,sentence:string>>").alias("kept"))

    def take(acc, s):
        used = acc["used"] + s["words"]
        fits = (used <= MAX_WORDS) | (acc["used"] < MIN_WORDS)
        more = F.concat(acc["kept"], F.array(F.struct(s["pos"].alias("pos"), s["sentence"].alias("sentence"))))
        return F.struct(used.alias("used"), F.when(fits, more).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate(F.array_sort(scored), start, take, lambda acc: acc["kept"])
    joined = F.array_join(F.transform(F.array_sort(kept), lambda k: k["sentence"]), " ")
    return F.when(F.length(strip(text)) < MIN_SUMMARY_CHARS, F.lit("")).otherwise(joined)


def is_important(section_type: Column, words: Column) -> Column:
    return section_type.isin(*SUMMARY_SECTION_TYPES) | (words > 100)


def important_sections(docs: DataFrame, hierarchical: bool = True, text: str = "text", id_col: str = "doc_id",
                       most: int | None = MAX_SECTIONS) -> DataFrame:
    """At most `most` important sections per document (None: all): all in reading order, or the longest by length.

    They are chosen inside the document's row; only their texts become rows.
    """
    # both in one projection, so that one worker a task does them
    rows = docs.select(id_col, foreign_paragraphs(F.col(text)).alias("foreign"), batch_sections(F.col(text), hierarchical).alias("by_batch"))
    secs = F.coalesce("by_batch", section_array(F.col("foreign"), hierarchical))
    rows = rows.select(id_col, F.filter(secs, lambda s: is_important(s["type"], s["words"])).alias("secs"))
    chosen = F.col("secs")
    if most is not None:
        by_length = F.array_sort(F.transform("secs", lambda s: F.struct((-s["words"]).alias("k"), s["idx"].alias("idx"), s.alias("s"))))
        chosen = F.when(F.size("secs") > most, F.transform(F.slice(by_length, 1, most), lambda x: x["s"])).otherwise(chosen)
    return (unfold(rows, [id_col], chosen, "n", "s")
            .select(id_col, F.col("s.idx").alias("para_idx"), section_id(F.col("s.idx")).alias("section_id"), "s.title", "s.text",
                    F.col("s.type").alias("section_type"), F.col("s.words").alias("word_count"), (F.col("n") + 1).alias("position")))


def section_summaries(important: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return (important.select(id_col, "section_id", "title", "position", summarize(F.col("text")).alias("summary"))
            .where(strip(F.col("summary")) != ""))


def with_prefix(summary: Column, contract_type: Column) -> Column:
    """Name the agreement type unless it is general or the summary already mentions it."""
    known = (contract_type == "general") | F.contains(F.lower(summary), contract_type)
    lowered = F.concat(F.lower(F.left(summary, F.lit(1))), F.substr(summary, F.lit(2)))
    return F.when(known, summary).otherwise(F.concat(F.lit("This "), contract_type, F.lit(" agreement "), lowered))


def length_class(text: Column) -> Column:
    return F.when(F.length(text) < 5000, "short").when(F.length(text) < 20000, "medium").otherwise("long")


def key_point_label(ext_type: Column) -> Column:
    return F.initcap(F.replace(ext_type, F.lit("_"), F.lit(" ")))


def section_context(text: Column) -> Column:
    return F.when(F.length(text) > 100, F.concat(F.left(text, F.lit(100)), F.lit("..."))).otherwise(text)


def key_points(extracted: DataFrame, sections: DataFrame, id_col: str = "doc_id", most: int | None = KEY_SECTIONS) -> DataFrame:
    """Non-empty answers in type order, then the first `most` sections of the key types (None: all), numbered."""
    facts = extracted.where(F.col("value") != "").select(
        id_col, F.lit(0).alias("part"), F.col("type_order").alias("ord"), F.col("ext_type").alias("category"),
        F.concat(key_point_label(F.col("ext_type")), F.lit(": "), F.col("value")).alias("description"),
        F.lit("high").alias("importance"), F.lit("").alias("context"), F.col("value").alias("extracted_value"))
    first = W.partitionBy(id_col).orderBy("para_idx")
    parts = (sections.where(F.col("section_type").isin(*KEY_POINT_SECTION_TYPES))
             .select(id_col, "para_idx", "section_type", "title", section_context(F.col("text")).alias("context"))
             .withColumn("n", F.row_number().over(first)).where(F.lit(True) if most is None else F.col("n") <= most)
             .select(id_col, F.lit(1).alias("part"), F.col("para_idx").alias("ord"), F.lit("section").alias("category"),
                     F.concat(F.lit("Important "), F.col("section_type"), F.lit(" clause: "), F.col("title"))
                     .alias("description"),
                     F.lit("medium").alias("importance"), "context", F.col("title").alias("extracted_value")))
    order = W.partitionBy(id_col).orderBy("part", "ord")
    return (facts.unionByName(parts)
            .withColumn("point_id", F.format_string("point-%03d", F.row_number().over(order) - 1))
            .drop("part", "ord"))
