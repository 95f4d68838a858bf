"""The store grows in runs; lookups and redeliveries open what an id can be in, however long the history is."""

import os

import pytest
from pyspark.sql import functions as F

from clauselake.sources.store import RUNS_PER_TIER, Store, bits_for
from clauselake.streaming import drops


def rows(spark, ids, word="v"):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("bigint") for i in ids])).alias("doc_id")).select(
        "doc_id", F.concat(F.lit(word), F.col("doc_id").cast("string")).alias("v"))


def size_of(paths):
    return sum(os.path.getsize(os.path.join(d, f)) for p in paths for d, _, names in os.walk(p.removeprefix("file:")) for f in names
               if f.endswith(".parquet"))


def test_rows_come_back_and_are_found(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), rows_per_bucket=10)
    assert store.manifest().version == 0 and store.lookup(1).count() == 0
    store.save(rows(spark, range(100)))
    store.save(rows(spark, range(90, 120), "w"))
    assert sorted(tuple(r) for r in store.read().collect()) == sorted(
        [(i, f"v{i}") for i in range(100)] + [(i, f"w{i}") for i in range(90, 120)])
    assert sorted(r.v for r in store.lookup(95).collect()) == ["v95", "w95"]
    assert [r.v for r in store.lookup(7).collect()] == ["v7"] and store.lookup(1000).collect() == []
    assert len(store.lookup(95).inputFiles()) == 2 and len(store.lookup(7).inputFiles()) == 1
    store.save(rows(spark, [5], "new"), "overwrite")
    assert [tuple(r) for r in store.read().collect()] == [(5, "new5")] == [tuple(r) for r in spark.read.parquet(store.path).select(
        "doc_id", "v").collect()]
    with pytest.raises(ValueError):
        store.save(rows(spark, [5]), "ignore")


def test_buckets_follow_the_number_of_rows(spark, tmp_path):
    assert [bits_for(n, 10) for n in (0, 1, 10, 11, 20, 21, 41, 1 << 60)] == [0, 0, 0, 1, 1, 2, 3, 24]
    for n, folders in ((8, 1), (80, 8), (640, 64)):
        store = Store(spark, str(tmp_path / str(n)), rows_per_bucket=10)
        store.save(spark.range(n).select(F.col("id").alias("doc_id")))
        made = os.listdir(tmp_path / str(n) / "store_run=1")
        assert folders * 0.7 <= len([x for x in made if x.startswith("store_bucket=")]) <= folders


def test_ids_of_any_kind_and_null(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "key", rows_per_bucket=1)
    data = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("é", 4)], "key string, id int")
    store.save(data)
    assert [r.id for r in store.lookup("é").collect()] == [4]
    again = spark.createDataFrame([("a", 1), ("c", 2), (None, 3)], "key string, id int")
    assert [r["key"] for r in store.unseen(again).collect()] == ["c"]


def test_an_empty_save_keeps_the_schema(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(rows(spark, [1]).where("false"))
    assert store.read().columns == ["doc_id", "v"] and store.read().count() == 0 and store.lookup(1).columns == ["doc_id", "v"]
    store.save(rows(spark, [1]))
    assert store.read().count() == 1


def test_a_run_without_a_manifest_does_not_count(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.save(rows(spark, range(5)))
    monkeypatch.setattr(Store, "_commit", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.save(rows(spark, range(5, 9)))
    monkeypatch.undo()
    assert store.read().count() == 5 and store.unseen(rows(spark, range(9))).count() == 4
    store.save(rows(spark, range(5, 9)))
    assert store.read().count() == 9 == spark.read.parquet(store.path).count()


def test_two_writers_do_not_share_a_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(rows(spark, [1]))
    old = store.manifest()
    store.save(rows(spark, [2]))
    with pytest.raises(RuntimeError):
        store._commit(type(old)(old.version + 1, old.schema, old.index))


def test_what_a_batch_reads_does_not_grow_with_history(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), rows_per_bucket=500)
    ask = spark.createDataFrame([(3,), (10 ** 9,)], "doc_id bigint")
    read, files = [], []
    for k, n in enumerate((1_000, 8_000, 64_000)):
        store.save(spark.range(n * 10, n * 11).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("v")))
        paths = store.index_paths(ask, "doc_id")
        read.append(size_of(paths))
        files.append(len(paths))
    index = size_of([f"{store.path}/_ids"])
    assert files == [2, 4, 6]
    # a bucket of each index run for each id: about as much for 64,000 ids as for 1,000
    assert read[2] - read[1] < 3 * read[0] and read[2] < index / 20
    assert [r.doc_id for r in store.unseen(ask.union(spark.createDataFrame([(640_005,)], "doc_id bigint"))).collect()] == [3, 10 ** 9]


def test_index_runs_are_merged(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), rows_per_bucket=4)
    for i in range(2 * RUNS_PER_TIER + 1):
        store.save(rows(spark, [2 * i, 2 * i + 1]))
    now = store.manifest()
    assert sorted((r.tier, r.rows) for r in now.index) == [(0, 2), (1, 2 * RUNS_PER_TIER), (1, 2 * RUNS_PER_TIER)]
    assert store.unseen(rows(spark, range(2 * 2 * RUNS_PER_TIER + 4))).count() == 2
    assert all([r.v for r in store.lookup(i).collect()] == [f"v{i}"] for i in (0, 17, 33))
    # old versions and the index runs that only they name are gone
    assert len(os.listdir(tmp_path / "s" / "_ids")) < 2 * RUNS_PER_TIER + 3


def test_a_batch_given_again_is_not_stored_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, "document.txt", f"text {i}") for i in range(6)], "doc_id bigint, file_name string, text string")
    run = drops._analyze_batch(str(tmp_path / "s"), drops.AnalysisConfig())
    run(docs.where("doc_id < 4").union(docs.where("doc_id < 2")), 0)
    run(docs.where("doc_id < 4"), 0)
    run(docs, 1)
    store = Store(spark, str(tmp_path / "s"))
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(6)) and store.manifest().version == 2
