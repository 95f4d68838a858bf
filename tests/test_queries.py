"""Registered queries against their DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from clauselake.verify.compare import compare, duck, types_match
from conftest import SF

SQL = entry.oracle_sql()
SLOW = {"results_json", "results_json_models", "stream_redelivery", "stream_analyze", "train_eval_classifier", "result_store", "type_distribution", "risk_mean_by_type",
        "evaluation_details", "eval_stats", "contract_basics", "training_counts", "digest", "overall_summaries", "risk_top5",
        "terms_in_order", "section_offsets", "reference_lists"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_registered():
    assert set(SQL) <= set(entry.queries()) and len(entry.queries()) >= 60


@pytest.mark.parametrize("name", [n for n in SQL if n not in SLOW])
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    result = con.execute(SQL[name])
    described = result.description
    assert compare([tuple(r) for r in df.collect()], df.columns, result.fetchall(), [d[0] for d in described]) is None
    assert types_match(df.schema, described) == []
