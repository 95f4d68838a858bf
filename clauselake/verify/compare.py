"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def compare(spark_rows, spark_columns, duck_rows, duck_columns) -> str | None:
    """None when equal, else what differs first."""
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} <> {sorted(duck_columns)}"
    order = [duck_columns.index(c) for c in spark_columns]
    left = Counter(tuple(_key(v) for v in r) for r in spark_rows)
    right = Counter(tuple(_key(r[i]) for i in order) for r in duck_rows)
    if left == right:
        return None
    only_left, only_right = left - right, right - left
    return (f"{sum(left.values())} vs {sum(right.values())} rows; {sum(only_left.values())} only in Spark, e.g. "
            f"{sorted(map(repr, only_left))[:1]}; {sum(only_right.values())} only in DuckDB, e.g. "
            f"{sorted(map(repr, only_right))[:1]}")


def types_match(spark_schema, description) -> list[str]:
    """Columns whose types differ between the engines."""
    known = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    theirs = {d[0]: str(d[1]).upper() for d in description}
    return [f"{f.name}: {f.dataType.simpleString()} / {theirs[f.name]}" for f in spark_schema
            if known.get(f.dataType.simpleString()) != {"STRING": "VARCHAR", "NUMBER": "?"}.get(theirs[f.name], theirs[f.name])]
