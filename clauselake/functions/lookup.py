"""Constant tables as literal maps: small rule prose and label maps need no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    found = F.element_at(literal_map(table), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def pick(number: Column, values: list[Column]) -> Column:
    """The value whose position is `number`; only that one is evaluated."""
    chain = F
    for i, value in enumerate(values):
        chain = chain.when(number == i, value)
    return chain.otherwise(F.lit(None))
