"""Personal data over a document table: detect, redact, report, entities, encryption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions import privacy as p
from clauselake.functions.text import unfold


def with_pii(docs: DataFrame, text: str = "clean", redact: bool = True) -> DataFrame:
    """Add pii groups, has_pii, pii_types and body (redacted text, or the text itself)."""
    out = docs.withColumns({"pii": p.pii_values(F.col(text)), "_redacted": p.redacted(F.col(text), redact)})
    # the column itself is read from the batch's result, so that one pass cleans and redacts
    out = out.withColumn(text, F.col("_redacted.text"))
    by_batch, groups = F.col("_redacted.types").isNotNull(), p.pii_values(F.col(text), gated=False)
    types = F.when(by_batch, F.col("_redacted.types")).otherwise(p.pii_type_names(groups))
    body = F.when(by_batch, F.col("_redacted.body")).otherwise(p.redact(F.col(text), groups)) if redact else F.col(text)
    return out.withColumns({"has_pii": F.size(types) > 0, "pii_types": types, "body": body}).drop("_redacted")


def without_pii(docs: DataFrame, text: str = "clean") -> DataFrame:
    return docs.withColumns({"has_pii": F.lit(False), "pii_types": F.array().cast("array<string>"),
                             "body": F.col(text)})


def pii_table(docs: DataFrame, text: str = "clean", id_col: str = "doc_id") -> DataFrame:
    """doc_id, pii_type, value, redaction: one row per distinct value and type in a document."""
    groups = unfold(docs, [id_col], p.pii_values(F.col(text)), "at", "g").select(id_col, "g.*")
    return (unfold(groups, [id_col, "pii_type"], F.col("values"), "at", "value").drop("at")
            .withColumn("redaction", p.redaction_tag(F.col("pii_type"), F.col("value"))))


def pii_report(docs: DataFrame, text: str = "clean") -> DataFrame:
    """Documents and values per type.

    Values are distinct within a document already, so plain sums replace a
    distinct count and every task sends nine small rows.
    """
    groups = unfold(docs, [], p.pii_values(F.col(text)), "at", "g").select("g.*")
    return groups.groupBy("pii_type").agg(F.count("*").alias("documents"), F.sum(F.size("values")).alias("values"))


def entity_table(sections: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, section_id, entity_type, value."""
    sections = sections.select(id_col, "section_id", p.legal_entities(F.col(text)).alias("entities"))
    groups = unfold(sections, [id_col, "section_id"], F.col("entities"), "at", "entity_type", "found")
    return unfold(groups, [id_col, "section_id", "entity_type"], F.col("found"), "at", "value").drop("at")
