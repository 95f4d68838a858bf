"""Line dedup across documents, with DataFrame functions only.

Lines are exploded to hashes, the distinct documents of each hash are counted,
lines over the threshold are dropped and the rest is put together by position.
Only hashes and positions are shuffled by line; each text moves once, to meet
the positions that it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import let
from clauselake.llm.shared import BLANKS, ascii_lower

MIN_CHARS = 10
MIN_DOCS = 2
LAST_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _lines(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """One row per text; `owner` orders null ids last, `mark` tells apart rows that share an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("owner"), F.xxhash64(text).alias("mark"),
                       F.col(id_col).alias("id"), text.alias("body"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """owner, mark, pos and a 128-bit hash of every line whose key is long enough."""
    keyed = F.transform(F.split("body", "\n", -1), line_key)
    hashed = F.transform(keyed, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(
        i.alias("pos"), F.xxhash64(k).alias("a"), F.xxhash64(F.lit("line"), k).alias("b"))))
    return (rows.select("owner", "mark", F.explode(F.filter(hashed, lambda x: x.isNotNull())).alias("x"))
            .select("owner", "mark", "x.pos", "x.a", "x.b"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_lines, n_dropped and the kept text of every row of `docs`, with its columns named in `carry`.

    A line whose key has `min_chars` code points or more and is found in
    `min_docs` documents or more stays only in the document with the smallest
    id.  A null text is one empty line.  Null ids count as one document that
    comes after all others.  Rows that repeat an id count as one document and
    each gives a row.  Other columns are not read.
    """
    rows = _lines(docs, id_col, text_col, carry)
    keys = _keys(rows, min_chars)
    if min_docs <= 2:  # two documents hold it exactly when the smallest and the largest id differ
        common = (keys.groupBy("a", "b").agg(F.min("owner").alias("keeper"), F.max("owner").alias("other"))
                  .where(F.col("keeper") < F.col("other")).drop("other"))
    else:
        common = (keys.select("a", "b", "owner").distinct().groupBy("a", "b")
                  .agg(F.min("owner").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n"))
    lost = (keys.join(common, ["a", "b"]).where(F.col("owner") > F.col("keeper"))
            .groupBy("owner", "mark").agg(F.collect_set("pos").alias("lost")))
    lines = F.split("body", "\n", -1)

    def kept(of: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(of) - 1), F.col("lost"))
        return F.array_join(F.transform(stay, lambda i: F.get(of, i)), "\n")

    return (rows.join(lost, ["owner", "mark"], "left")
            .select(F.col("id").alias(id_col), F.size(lines).cast("bigint").alias("n_lines"),
                    F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
                    F.when(F.col("lost").isNull(), F.col("body"))
                    .otherwise(let(lines, kept)).alias("kept"),  # a text is split once, not for each line
                    *[F.col("carried")[c].alias(c) for c in carry]))
