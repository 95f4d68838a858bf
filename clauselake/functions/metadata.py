"""Document metadata as Column expressions over raw and cleaned text."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions.batches import first_found, group_counts
from clauselake.functions.text import holds
from clauselake.rules.model import whole_word
from clauselake.rules.vocab import CONTRACT_TYPES, DATE_PATTERN, DATE_WORDS, PARTY_PATTERN, PARTY_WORDS

MAX_FOUND = 5


def file_type(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit("txt"))


def size_kb(text: Column) -> Column:
    return F.bround(F.octet_length(text) / F.lit(1024.0), 2)


def page_count(raw: Column) -> Column:
    return F.length(raw) - F.length(F.replace(raw, F.lit("\f"), F.lit(""))) + 1


def all_dates(text: Column, most: int | None = MAX_FOUND) -> Column:
    """The first `most` distinct dates (None: all), by appearance."""
    return first_found(text, DATE_WORDS, DATE_PATTERN, 0, most)


def all_parties(text: Column, most: int | None = MAX_FOUND) -> Column:
    """The first `most` distinct parties (None: all), by appearance."""
    return first_found(text, PARTY_WORDS, PARTY_PATTERN, 4, most)


def type_scores(text: Column) -> Column:
    """How often the key words of each agreement type occur, as a column that `top_type` takes; null for texts beyond ASCII."""
    return group_counts(text, list(CONTRACT_TYPES.values()))


def top_type(low: Column, scores: Column) -> Column:
    """(score, rank, type, scale) of the best agreement type; ties go to the type declared first.

    `low` is the lower-case text as a column, looked at where there are no `scores`.
    Counting with a regex is only paid for key words that occur at all.
    """

    def hits(word):
        return F.when(holds(low, word), F.regexp_count(low, F.lit(whole_word(word)))).otherwise(F.lit(0))

    def score(rank, words):
        return F.when(scores.isNotNull(), F.get(scores, F.lit(rank))).otherwise(reduce(add, [hits(w) for w in words]))

    entries = [F.struct(score(rank, words).alias("score"), F.lit(-rank).alias("rank"),
                        F.lit(name).alias("type"), F.lit(2.0 * len(words)).alias("scale"))
               for rank, (name, words) in enumerate(CONTRACT_TYPES.items())]
    return F.array_max(F.array(*entries))


def contract_type(top: Column) -> Column:
    return F.when(top["score"] == 0, F.lit("general")).otherwise(top["type"])


def type_confidence(top: Column) -> Column:
    share = F.least(F.greatest(top["score"] / top["scale"], F.lit(0.5)), F.lit(0.95))
    return F.when(top["score"] == 0, F.lit(0.5)).otherwise(share)
