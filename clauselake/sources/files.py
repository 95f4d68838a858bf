"""Document intake: directories of files, text tables, status of unusable input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions.text import unique_id
from clauselake.sources.listing import contents, list_files

# Fixed value: suffixes without plain text; every other suffix is read as text.
BINARY_SUFFIXES = ("pdf", "docx", "doc", "xlsx", "xls")
NO_INPUT = "The document is empty or missing"


def decode(content: Column) -> Column:
    """UTF-8 text; bytes that are no UTF-8 are dropped."""
    valid = F.make_valid_utf8(content.cast("string"))
    return F.replace(valid, F.lit("�"), F.lit(""))


def read_files(spark: SparkSession, path: str, max_mb: float | None = 25, recursive: bool = False,
               pattern: str | None = None) -> DataFrame:
    """doc_id, file_name, text, status, errors: one row per file, empty files included.

    Tasks list the files with their sizes and read them; no name of a file
    reaches the driver.  The bytes of an oversized file are never loaded; such
    a file, a format without plain text and an empty file become status rows,
    the first and the last straight from the listing.  `max_mb` None sets no limit.
    """
    listed = list_files(spark, path, recursive, pattern)
    large = F.col("length") > _limit(max_mb)
    told = F.when(large, _too_large(max_mb)).otherwise(NO_INPUT)
    bad = listed.where(large | (F.col("length") == 0)).select(*_known(), F.lit(None).cast("string").alias("text"),
                                                             F.lit("error").alias("status"), F.array(told).alias("errors"))
    return _readable(contents(listed.where((F.col("length") > 0) & ~large)), max_mb).unionByName(bad)


def _limit(max_mb: float | None) -> int:
    return (1 << 62) if max_mb is None else int(max_mb * 1024 * 1024)


def _too_large(max_mb: float | None) -> str:
    return f"File exceeds maximum size of {max_mb}MB"


def _known() -> list[Column]:
    """Id and name of a file, from its path."""
    return [unique_id(F.col("path"), length=32).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name")]


def _readable(files: DataFrame, max_mb: float | None) -> DataFrame:
    """Text, or unsupported, of the files within the limit."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    unsupported = suffix.isin(*BINARY_SUFFIXES)
    none = F.array().cast("array<string>")
    return files.where(F.col("length") <= _limit(max_mb)).select(
        *_known(), F.when(~unsupported, decode(F.col("content"))).alias("text"),
        F.when(unsupported, "unsupported").otherwise("success").alias("status"),
        F.when(unsupported, F.array(F.concat(F.lit("No plain text in a file of type "), suffix))).otherwise(none)
        .alias("errors"))


def classify_files(files: DataFrame, max_mb: float | None = 25) -> DataFrame:
    """The files of a scan or stream (path, length, content) as documents and status rows; empty ones are not scanned."""
    large = files.where(F.col("length") > _limit(max_mb)).select(
        *_known(), F.lit(None).cast("string").alias("text"), F.lit("error").alias("status"),
        F.array(F.lit(_too_large(max_mb))).alias("errors"))
    return _readable(files, max_mb).unionByName(large)


def read_dir(spark: SparkSession, path: str, max_mb: int | None = 25) -> DataFrame:
    """Every .txt, .pdf and .docx file below a directory."""
    return read_files(spark, path, max_mb, recursive=True, pattern="*.{txt,pdf,docx}")


def from_text_table(rows: DataFrame, id_col: str, text_col: str, name: str = "document.txt") -> DataFrame:
    return rows.select(F.col(id_col).alias("doc_id"), F.lit(name).alias("file_name"), F.col(text_col).alias("text"))


def with_status(docs: DataFrame) -> DataFrame:
    """Add status and errors; a missing or empty text is an error row, never a failed job."""
    empty = F.col("text").isNull() | (F.col("text") == "")
    if "status" in docs.columns:
        bad = (F.col("status") == "success") & F.col("text").isNull()
        return docs.withColumns({"status": F.when(bad, F.lit("error")).otherwise(F.col("status")),
                                 "errors": F.when(bad, F.array(F.lit(NO_INPUT))).otherwise(F.col("errors"))})
    return docs.withColumns({
        "status": F.when(empty, F.lit("error")).otherwise(F.lit("success")),
        "errors": F.when(empty, F.array(F.lit(NO_INPUT))).otherwise(F.array().cast("array<string>"))})


def split_by_status(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable documents, quarantined documents)."""
    return docs.where("status = 'success'"), docs.where("status <> 'success'")
