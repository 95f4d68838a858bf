"""Quality rules with adaptive thresholds.

Ratios of each text are gathered in mergeable quantile sketches per language
and source: logarithmic buckets with counts, so a sketch merges by adding
counts, gives every quantile within RELATIVE_ERROR and is the same in every
run.  Fences around the quartiles replace fixed cutoffs and are joined back to
the texts' measures.  Each group's sketch is blended with its language's, and
that with the sketch of all rows, at every size: PRIOR pseudo-rows, the
percentiles of the wider sketch, are added to the group's own counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.shared import joined, slices, utf8, written

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
RELATIVE_ERROR = 0.005
LEAST = 1e-6
PRIOR = 100
FENCE = 3.0
# rounding floor of a spread: a sketch may hold one value only
LEAST_SPREAD = 0.01
# ratio: what it divides, and how many of the counted things come at once (a repeat marks two runs of words);
# a mean is not a count and has none
RATIOS = {
    "word_length": ("word_chars", "n_words", None),
    "symbol_ratio": ("n_symbols", "n_words", 1),
    "upper_ratio": ("n_upper", "word_chars", 1),
    "dup_line_ratio": ("n_dup_lines", "n_text_lines", 1),
    "repeat_ratio": ("n_repeat_words", "n_words", 2 * WINDOW),
}
TWO_SIDED = ("word_length",)
# a mean over n words may lie this much over the square root of n outside its fences
MEAN_NOISE = 5.0
# deviations by which a count may exceed what its fence expects, by chance alone
COUNT_NOISE = 2.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_text_lines")


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], np.int64)


STARTS_CHAR = _table(lambda b: b & 0xC0 != 0x80 and not (b == 32 or 9 <= b <= 13))
IS_SYMBOL = _table(lambda b: b in SYMBOLS)
IS_UPPER = _table(lambda b: 65 <= b <= 90)


def _per_text(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(table[data])))
    return sums[starts[1:]] - sums[starts[:-1]]


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a `window`-word run which the text holds twice or more.

    Runs are numbered exactly, by numbering pairs of shorter, overlapping runs.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for ws in words for w in ws], np.int64)
    text = np.repeat(np.arange(len(words)), lengths)
    out = np.zeros(len(words), np.int64)
    if len(ids) < window:
        return out
    runs, span = ids, 1
    while span < window:
        step = min(span, window - span)
        runs = np.unique(runs[:-step] * (len(ids) + 1) + runs[step:], return_inverse=True)[1]
        span += step
    inside = text[:len(runs)] == text[window - 1:]
    at = np.flatnonzero(inside)
    _, group, n = np.unique(runs[at] * len(words) + text[at], return_inverse=True, return_counts=True)
    marks = np.zeros(len(ids) + 1, np.int64)
    again = at[n[group] > 1]
    marks[again] += 1
    np.subtract.at(marks, again + window, 1)
    np.add.at(out, text, (np.cumsum(marks)[:-1] > 0).astype(np.int64))
    return out


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id, the group keys as strings and the counts in MEASURES of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = utf8(part.column("text"))
            data, starts = joined(texts)
            words = [t.split() for t in texts]
            lines = np.array([duplicate_lines(t) for t in texts], np.int64).reshape(-1, 2)
            counts = [np.array([len(w) for w in words], np.int64), _per_text(data, starts, STARTS_CHAR),
                      _per_text(data, starts, IS_SYMBOL), lines[:, 1], repeated_words(words), _per_text(data, starts, IS_UPPER), lines[:, 0]]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in fixed] + [pa.array(c) for c in counts], [*fixed, *MEASURES])

    fixed = ["id", *[f"key{i}" for i in range(len(keys))]]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"),
                       *[F.col(k).cast("string").alias(f"key{i}") for i, k in enumerate(keys)], F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(["id bigint", *[f"{k} string" for k in fixed[1:]], *[f"{m} bigint" for m in MEASURES]]))


def ratio(name: str) -> Column:
    part, whole, _ = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


_GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, bucket, n: the counts of the logarithmic buckets of every ratio.  Adding counts merges sketches."""
    values = F.array(*[F.struct(F.lit(r).alias("name"), ratio(r).alias("value")) for r in RATIOS])
    bucket = F.when(F.col("x.value") < LEAST, F.lit(-(1 << 30))).otherwise(F.ceil(F.log("x.value") / math.log(_GAMMA))).cast("int")
    return (rows.select(*keys, F.explode(values).alias("x")).select(*keys, "x.name", bucket.alias("bucket"))
            .groupBy(*keys, "name", "bucket").agg(F.count("*").alias("n")))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches merged over all keys that are not named."""
    return sketches.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))


QUANTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, total and QUANTILES of every sketch (lower quantiles, within RELATIVE_ERROR)."""
    group = Window.partitionBy(*keys, "name")
    value = F.when(F.col("bucket") == -(1 << 30), 0.0).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (_GAMMA + 1))
    sums = sketches.select(*keys, "name", "bucket", F.sum("n").over(group).alias("total"), F.sum("n").over(
        group.orderBy("bucket")).alias("upto"), value.alias("value"))
    return sums.groupBy(*keys, "name").agg(
        F.max("total").alias("total"), *[F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value"))).alias(a)
                                         for a, q in QUANTILES.items()])


def pseudo_rows(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Every sketch shrunk to PRIOR rows, one at each of its evenly spaced quantiles; at most PRIOR buckets are left."""
    group = Window.partitionBy(*keys, "name")
    sums = sketches.select(*keys, "name", "bucket", "n", F.sum("n").over(group).alias("total"),
                           F.sum("n").over(group.orderBy("bucket")).alias("upto"))

    def below(n: str) -> Column:
        return F.expr(f"({2 * PRIOR} * ({n}) + total) div (2 * total)")

    return sums.select(*keys, "name", "bucket", (below("upto") - below("upto - n")).alias("n")).where("n > 0")


def blended(own: DataFrame) -> DataFrame:
    """The sketches of key0 and key1 with PRIOR pseudo-rows of their key0's sketch, which itself has as many of all rows'."""
    names = F.col("name"), F.col("bucket"), F.col("n")
    wide = merged(own, ["key0"])
    every = wide.select("key0", "name").distinct().join(pseudo_rows(merged(own, []), []), "name")
    wide = merged(wide.unionByName(every), ["key0"])
    prior = pseudo_rows(wide, ["key0"]).select(F.col("key0").alias("k"), *names)
    groups = own.select("key0", "key1").distinct()
    return merged(own.unionByName(groups.join(prior, F.col("key0").eqNullSafe(F.col("k"))).drop("k")), ["key0", "key1"])


def thresholds(rows: DataFrame) -> DataFrame:
    """key0, key1 and for every ratio its lowest and highest accepted value.

    The fence lies FENCE spreads beyond the upper quartile (and the lower one);
    the spread is the distance of the quartiles.  Where they coincide, as for a
    ratio that most texts have at zero, it lies as many distances of the median
    and the ninth decile beyond that decile.
    """
    own = written(sketch(rows, ["key0", "key1"]), "sketches")
    found = quartiles(written(blended(own), "blended"), ["key0", "key1"])
    wide = F.col("q3") > F.col("q1")
    reach = FENCE * F.greatest(F.when(wide, F.col("q3") - F.col("q1")).otherwise(F.col("q9") - F.col("q2")), F.lit(LEAST_SPREAD))
    fences = found.select("key0", "key1", "name", (F.when(wide, F.col("q3")).otherwise(F.col("q9")) + reach).alias("high"),
                          (F.col("q1") - reach).alias("low"))
    return fences.groupBy("key0", "key1").agg(*[
        F.max(F.when(F.col("name") == r, F.col("high"))).alias(f"{r}_high") for r in RATIOS], *[
        F.max(F.when(F.col("name") == r, F.col("low"))).alias(f"{r}_low") for r in TWO_SIDED])


def exceeds(name: str) -> Column:
    """Whether a text lies above its fence by more than chance: a mean by its length, a count by its expected deviation."""
    part, whole, at_once = RATIOS[name]
    high = F.col(f"{name}_high")
    if at_once is None:
        return ratio(name) > high + MEAN_NOISE / F.sqrt("n_words")
    usual = high * F.col(whole)
    return F.col(part) > usual + COUNT_NOISE * F.sqrt(at_once * usual) + COUNT_NOISE ** 2 * at_once


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, MEASURES, base_failed, the first failed rule (or null) and kept, for every row.

    Texts that fail the base rules (too few words, too many words in repeated
    runs) take no part in the thresholds.  Null keys are a group of their own.
    The threshold table has a row for each group; the optimizer broadcasts it
    only while its measured size is small.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = written(measures(docs, id_col, text_col, keys).withColumn("base_failed", failed), "measures")
    limits = written(thresholds(rows.where("not base_failed")), "thresholds").select(
        F.col("key0").alias("t0"), F.col("key1").alias("t1"), *[f"{r}_high" for r in RATIOS], *[f"{r}_low" for r in TWO_SIDED])
    out = rows.join(limits, F.col("key0").eqNullSafe(F.col("t0")) & F.col("key1").eqNullSafe(F.col("t1")), "left")
    rule = F.when(F.col("base_failed"), F.lit("base"))
    for r in RATIOS:
        rule = rule.when(exceeds(r), F.lit(r))
        if r in TWO_SIDED:
            rule = rule.when(ratio(r) < F.col(f"{r}_low") - MEAN_NOISE / F.sqrt("n_words"), F.lit(f"{r}_low"))
    return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed", rule.alias("rule"), rule.isNull().alias("kept"))
