"""Redaction of whole batches says what the expressions over single texts say."""

import random

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from clauselake.functions import batches
from clauselake.functions import privacy as pv
from clauselake.operators.privacy import with_pii
from clauselake.plans import pipeline
from clauselake.sources import tables
from clauselake.sources.files import read_files
from clauselake.sources.store import Store
from clauselake.streaming import drops
from conftest import SF

PARTS = ["a.b@c.example.com", "+1 555 010 4477", "(555) 010-4477", "123-45-6789", "4111 1111 1111 1111", "12 North Main Street", "1 a St 2 b Ave",
         "Dr. Mary Ann Jones", "Mr. A B", "04/17/1961", "1961-04-17", "AB1234567", "account with number 12345600", "ACH no. # 99 12345", "12", "x",
         "\n", "é", "中", "", "\x01", "x\x02y", "[REDACTED-ssn-01234567]", "_", "-", "."]


def odd_texts():
    dice = random.Random(11)
    return ["", "\n", *PARTS, *["".join(dice.choice(PARTS) + dice.choice(["", " ", " ", "\n"]) for _ in range(dice.randrange(12))) for _ in range(600)]]


def test_batches_redact_what_expressions_redact(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts()] + [(None,)], "clean string")
    groups = pv.pii_values(F.col("clean"), gated=False)
    want = df.select("clean", F.size(groups) > 0, pv.pii_type_names(groups), pv.redact(F.col("clean"), groups))
    got = with_pii(df).select("clean", "has_pii", "pii_types", "body")
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in got.sparkSession.createDataFrame(want.collect(), got.schema).collect())
    by_batch = df.select(pv.redacted(F.col("clean")).alias("r")).where("r.body is not null").count()
    assert 200 < by_batch < 600


def test_a_batch_is_worked_on_in_slices():
    sizes = []

    @batches.in_slices
    def upper(texts):
        sizes.append(len(texts))
        return pa.array([t and t.upper() for t in texts.to_pylist()], pa.string())

    rows = ["a" * (batches.SLICE_BYTES // 2 - 1), None, "b", "c" * (3 * batches.SLICE_BYTES), "", "d"] * 3
    assert upper(pa.array(rows)).to_pylist() == [t and t.upper() for t in rows]
    assert len(sizes) > 3 and upper(pa.array([], pa.string())).to_pylist() == []


def test_the_body_is_worked_out_once(spark, agreement):
    plan = pipeline.analysis_rows(agreement).select("doc_id", "sections_count")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("redact(") == 1


def test_rows_are_worked_out_once_for_a_store(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(50).withColumnRenamed("id", "doc_id").mapInArrow(count, "doc_id bigint")
    store = Store(spark, str(tmp_path / "store"), rows_per_bucket=10)
    assert store.save(rows, count=50) == 50
    assert seen.value == 50 and store.read().count() == 50 and store.lookup(7).count() == 1


def test_no_file_of_a_folder_reaches_the_driver(spark, tmp_path):
    for name, content in (("a.txt", b"one\xff"), ("deep/er/b.txt", b"two"), ("deep/c.pdf", b"%PDF"), ("deep/d.txt", b""), ("big.txt", b"x" * 3000)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = read_files(spark, str(tmp_path), 0.002, recursive=True)
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "binaryFile" not in plan and "MapInArrow" in plan
    assert sorted((r.file_name, r.text, r.status) for r in rows.collect()) == [
        ("a.txt", "one", "success"), ("b.txt", "two", "success"), ("big.txt", None, "error"), ("c.pdf", None, "unsupported"), ("d.txt", None, "error")]


def test_batches_of_texts_are_bounded(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(limit)
    try:
        spark.conf.unset(limit)
        tables.read(spark, SF, "orders")
        assert spark.conf.get(limit) == "4194304b"
        spark.conf.set(limit, "32m")
        tables.read(spark, SF, "orders")
        assert spark.conf.get(limit) == "32m"
    finally:
        spark.conf.set(limit, given)


def test_a_batch_of_a_stream_is_kept_on_disks(spark, tmp_path, monkeypatch):
    levels, plain = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda df, level=StorageLevel.MEMORY_AND_DISK_DESER: levels.append(level) or plain(df, level))
    docs = spark.createDataFrame([(1, "a.txt", "One text"), (1, "a.txt", "One text"), (2, "b.txt", None)], "doc_id bigint, file_name string, text string")
    drops._analyze_batch(str(tmp_path / "store"), pipeline.AnalysisConfig())(docs, 0)
    assert levels == [StorageLevel.DISK_ONLY] and Store(spark, str(tmp_path / "store")).read().count() == 2
