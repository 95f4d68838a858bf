from collections import defaultdict

import corpus_pipeline
import llm_cases
from conftest import SF

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_every_stage_stands_the_cases(spark, tmp_path):
    for name, start in (("full", llm_cases.table(spark)), ("empty", llm_cases.empty(spark))):
        docs = start
        for step, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            path = str(tmp_path / f"{name}-{step}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if step != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == COLUMNS
        assert (docs.count() > 0) == (name == "full")


def test_each_stage_alone_stands_the_cases(spark):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, llm_cases.table(spark), SF).write.format("noop").mode("overwrite").save()


def test_the_run_is_its_stages(spark):
    """Every decision can be found again in the rows of the stage before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.select(*COLUMNS).schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(kept["language"]) >= 0.99 * len(source)
    assert set(kept["lines"]) == set(kept["language"])
    assert all(len(r.text) <= len(source[i].text) and r.n_chars == len(r.text) for i, r in kept["lines"].items())
    texts = defaultdict(list)
    for i, r in kept["lines"].items():
        texts[r.text].append(i)
    for ids in texts.values():  # equal texts are one group, and its smallest id is never left for a larger one
        assert len([i for i in ids if i in kept["near_duplicates"]]) <= 1
    assert set(kept["secrets"]) == set(kept["near_duplicates"])
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(kept["secrets"])
    rooms = defaultdict(int)
    for r in packed:
        rooms[r.sequence_id] += r.length
    assert max(rooms.values()) <= 2048 and len(rooms) - sum(rooms.values()) / 2048 < 5
