"""Document-level metadata: one row per document, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions import metadata as m
from clauselake.functions.batches import words_of

METADATA_COLUMNS = ("file_name", "file_type", "file_size_kb", "page_count", "language", "word_count",
                    "contract_type", "contract_type_confidence", "dates", "parties")


def with_metadata(docs: DataFrame, clean: str = "clean", raw: str = "text", name: str = "file_name",
                  most: int | None = m.MAX_FOUND) -> DataFrame:
    """Add the metadata columns; pages are counted on the raw text, all else on the cleaned text.

    `most` bounds the lists of dates and parties (None: all).
    """
    text = F.col(clean)
    return (docs
            # worked out for whole batches of texts, and only if they are asked for
            .withColumns({"low": F.lower(text), "scores": m.type_scores(text), "word_count": words_of(text),
                          "dates": m.all_dates(text, most), "parties": m.all_parties(text, most)})
            .withColumn("top", m.top_type(F.col("low"), F.col("scores")))
            .withColumns({
                "file_type": m.file_type(F.col(name)),
                "file_size_kb": m.size_kb(text),
                "page_count": m.page_count(F.col(raw)),
                "language": F.lit("en"),
                "contract_type": m.contract_type(F.col("top")),
                "contract_type_confidence": m.type_confidence(F.col("top")),
            }).drop("low", "scores", "top"))


def contract_types(docs: DataFrame, clean: str = "clean", id_col: str = "doc_id") -> DataFrame:
    """Agreement type and confidence only."""
    return (docs.select(id_col, F.lower(clean).alias("low"), m.type_scores(F.col(clean)).alias("scores"))
            .select(id_col, m.top_type(F.col("low"), F.col("scores")).alias("top"))
            .select(id_col, m.contract_type(F.col("top")).alias("contract_type"),
                    m.type_confidence(F.col("top")).alias("contract_type_confidence")))
