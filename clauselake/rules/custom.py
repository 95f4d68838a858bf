"""Rules of your own: read from a table or a JSON file, used like the built-in packs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.rules.model import RiskRule, java_pattern

# Rules of one projection; a bigger table is cut into packs.
MAX_RULES = 5000
SCHEMA = ("key string, name string, category string, severity string, patterns array<string>, "
          "exceptions array<string>, context array<string>, impact string, explanation string, suggestion string")


def rules_from_dataframe(rows: DataFrame) -> tuple[RiskRule, ...]:
    """Compile a rule table.  A pack becomes part of the plan, so its size is checked before it is fetched;
    `packs_from_dataframe` takes tables of any size."""
    fetched = rows.limit(MAX_RULES + 1).collect()
    if len(fetched) > MAX_RULES:
        raise ValueError(f"a rule pack may hold at most {MAX_RULES} rules")
    packed = []
    for r in fetched:
        packed.append(RiskRule(r["key"], r["name"], r["category"], r["severity"], tuple(r["patterns"]),
                               tuple(r["exceptions"] or ()), tuple(r["context"] or ()), r["impact"] or "",
                               r["explanation"] or "", r["suggestion"] or ""))
    patterns = {p for r in packed for p in (*r.patterns, *r.exceptions)}
    if patterns:  # the engine that runs the patterns has to accept them
        rows.sparkSession.range(1).select(*[F.lit("").rlike(java_pattern(p, True)) for p in sorted(patterns)]).collect()
    return tuple(packed)


def packs_from_dataframe(rows: DataFrame, most: int = MAX_RULES) -> Iterator[tuple[RiskRule, ...]]:
    """The rules of a table of any size as packs of at most `most`, one after the other.

    Apply each pack in a projection of its own and put the findings together.
    """
    parts = -(-rows.count() // max(1, most // 2))
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, parts)))
    for part in range(parts):
        yield rules_from_dataframe(rows.where(bucket == part))


def rules_from_json(spark: SparkSession, path: str) -> tuple[RiskRule, ...]:
    return rules_from_dataframe(spark.read.schema(SCHEMA).option("multiLine", True).json(path))
