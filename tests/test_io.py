import os

from pyspark.sql import functions as F

from clauselake.functions.text import strip
from clauselake.operators import learn, training
from clauselake.plans import pipeline
from clauselake.rules import training as rules
from clauselake.sources import clause_csv, files, sinks
from clauselake.streaming import drops


def test_files_are_classified(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff ok")
    (tmp_path / "noext").write_bytes(b"plain")
    (tmp_path / "no bytes+.txt").write_bytes(b"")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "sub" / "c.txt").write_bytes(b"x" * (1024 * 1024 + 1))
    (tmp_path / "sub" / "d.docx").write_bytes(b"PK")
    got = {r.file_name: r for r in files.read_files(spark, str(tmp_path), max_mb=1, recursive=True).collect()}
    assert got["a.txt"].text == "café  ok" and got["noext"].text == "plain"
    assert got["no bytes+.txt"].status == "error" and got["no bytes+.txt"].errors == [files.NO_INPUT]
    assert got["b.pdf"].status == "unsupported" and got["c.txt"].status == "error" and "1MB" in got["c.txt"].errors[0]
    listed = {r.file_name for r in files.read_dir(spark, str(tmp_path)).collect()}
    assert listed == {"a.txt", "b.pdf", "c.txt", "d.docx", "no bytes+.txt"}
    good, bad = files.split_by_status(files.with_status(files.read_dir(spark, str(tmp_path), 1)))
    assert good.count() == 1 and bad.count() == 4
    r = {x.metadata.file_name: x for x in pipeline.response(files.read_dir(spark, str(tmp_path), 1)).collect()}
    assert r["b.pdf"].status == "unsupported" and r["a.txt"].status == "success"


def test_text_table(spark):
    df = spark.createDataFrame([(5, "hello")], "k int, t string")
    assert files.from_text_table(df, "k", "t").first().asDict() == {"doc_id": 5, "file_name": "document.txt", "text": "hello"}


def test_result_store_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    sinks.save_results(df, str(tmp_path / "store"))
    found = sinks.get_result(spark, str(tmp_path / "store"), 2)
    assert [r.v for r in found.collect()] == ["b"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,2)" in plan and [f.rsplit("/", 2)[1] for f in found.inputFiles()] == ["store_bucket=0"]
    assert sinks.get_result(spark, str(tmp_path / "store"), 9).count() == 0
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    kids = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "doc_id int, n int, w string")
    got = {r.doc_id: r.json for r in sinks.results_json(df, {"kids": (kids, ["n"])}).collect()}
    assert got[1] == '{"doc_id":1,"v":"a","kids":[{"n":1,"w":"x"},{"n":2,"w":"y"}]}' and got[2] == '{"doc_id":2,"v":"b"}'


CSV = '''Document Name , Auto-Renewal-Answer,Non-Compete-Answer,Governing Law-Answer,Renewal Term-Answer
"A long document name that has more than fifty letters in it",It renews each year,Yes,Ohio law governs the whole deal,"twelve
months, each"
short name,,no,,six months in a row at most
"Another document name that also has more than fifty letters",  tiny ,maybe,OH,
'''


def test_training_sets_from_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(CSV)
    wide = clause_csv.read_clause_csv(spark, str(path)).withColumn("id", F.monotonically_increasing_id())
    risk = sorted((r.text, r.label) for r in training.risk_training(wide, "id").collect())
    # two provisions are present; only their own two successors in the list count as sources of negatives
    assert risk == sorted([("It renews each year", "auto_renewal"), ("Yes", "non_compete"), ("no", "non_compete"),
                           ("It renews each year", "no_risk")])
    section = sorted((r.text, r.label) for r in training.section_training(wide, "id").collect())
    assert section == [("Ohio law governs the whole deal", "jurisdiction"), ("six months in a row at most", "renewal")]
    qa = sorted((r.question, r.answer) for r in training.qa_training(wide).collect())
    assert qa == [("What are the renewal terms of this agreement?", "twelve\nmonths, each"),
                  ("Which law governs this agreement?", "Ohio law governs the whole deal")]
    assert training.qa_manifest(training.qa_training_b(wide)).first().asDict() == {"sample_count": 1, "extraction_types": "this"}
    sinks.write_training(training.section_training(wide, "id"), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["text", "label"] and back.count() == 2
    assert training.label_counts(training.risk_training_b(wide, "id")).count() == 0
    assert training.section_training_b(wide.select("id"), "id").count() == 0


def test_negatives_are_at_most_ten_of_each_source(spark):
    rows = [(i, f"renewal answer {i:03d}", f"exit answer {i:03d} long") for i in range(300)]
    wide = spark.createDataFrame(rows, "id int, `Auto-Renewal-Answer` string, `Termination For Convenience-Answer` string")
    got = training.risk_training(wide, "id").groupBy("label").count().collect()
    # auto-renewal draws from termination; termination draws from auto-renewal
    assert {r.label: r["count"] for r in got} == {"auto_renewal": 300, "termination_without_notice": 300, "no_risk": 20}
    again = [training.risk_training(wide.repartition(n), "id").where("label = 'no_risk'").orderBy("text").collect() for n in (1, 6)]
    assert again[0] == again[1]
    assert set(rules.SHORT_ANSWERS) == {"yes", "no"} and strip(F.lit(" a ")) is not None


def test_split_is_exact_and_skew_proof(spark):
    rows = [(i, 1 if i % 10 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, y int")
    got = learn.split_rows(df, "id", "y").groupBy("y").agg(F.count_if("is_validation").alias("v"), F.count("*").alias("n")).collect()
    assert {r.y: (r.v, r.n) for r in got} == {0: (20, 100), 1: (180, 900)}
    a, b = (sorted(r.id for r in learn.split_rows(df.repartition(n), "id", "y").where("is_validation").collect()) for n in (1, 5))
    assert a == b


def test_train_score_save_load(spark, tmp_path):
    rows = [(i, f"pay the fee and invoice {i}" if i % 2 else f"keep the secret data {i}", i % 2) for i in range(80)]
    df = learn.split_rows(spark.createDataFrame(rows, "id int, text string, label_idx int"), "id", "label_idx")
    model = learn.train(df, 5)
    learn.save_model(model, str(tmp_path / "m"), ["secret", "fee"], "demo", 64)
    loaded, meta = learn.load_model(str(tmp_path / "m"))
    assert meta.first().labels == ["secret", "fee"]
    scored = learn.score(loaded, df.where("is_validation"), ["secret"], ["id", "label_idx"])
    q = learn.quality(scored).first()
    assert q.n == 16 and q.accuracy == q.f1 == 1.0
    assert {r.label for r in scored.collect()} == {"secret", "unknown_1"}


def test_external_model_hook(spark):
    def load():
        import numpy as np

        def predict(texts):
            return {"label": np.array(["long" if len(t) > 5 else "short" for t in texts]),
                    "confidence": np.array([0.5 for _ in texts])}
        return predict

    score = learn.external_model(load)
    df = spark.createDataFrame([("tiny",), ("much longer",)], "t string")
    assert [r.x.label for r in df.select(score(F.col("t")).alias("x")).collect()] == ["short", "long"]
    whole = spark.createDataFrame([(1, "x" * 9000), (2, "tiny"), (3, "")], "id int, t string")
    got = {r.id: r.label for r in learn.score_windows(whole, score, ["id"], "t", width=100, overlap=20).collect()}
    assert got == {1: "long", 2: "short", 3: "short"}


def test_windows_of_a_text(spark):
    def plain(t, width, overlap):
        step, out, at = width - overlap, [], 0
        while at < max(len(t) - overlap, 1):
            out.append(t[at:at + width])
            at += step
        return out

    texts = ["", "a", "abcdefghij" * 7 + "é😀\n", "x" * 20, "y" * 21]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for width, overlap in ((10, 3), (10, 0), (10, 9), (7, 5), (1000, 10)):
        got = df.select("t", learn.text_windows(F.col("t"), width, overlap).alias("w")).collect()
        assert all(r.w == plain(r.t, width, overlap) for r in got), (width, overlap)
    long = spark.createDataFrame([("word " * 2_000_000,)], "t string")
    assert long.select(F.size(learn.text_windows(F.col("t"), 4000, 200))).first()[0] == 2632


def test_negatives_by_number(spark):
    rows = [(i, f"renewal answer {i:03d}", f"exit answer {i:03d} long") for i in range(60)]
    wide = spark.createDataFrame(rows, "id int, `Auto-Renewal-Answer` string, `Termination For Convenience-Answer` string")
    counts = {n: training.risk_training(wide, "id", n).where("label = 'no_risk'").count() for n in (0, 3, 10, None)}
    assert counts == {0: 0, 3: 6, 10: 20, None: 120}
    plan = training.risk_training(wide, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "answer" not in [w.split("#")[0] for line in plan.split("\n") if "Window" in line for w in line.replace("[", " ").replace(",", " ").split()]


def test_keys_by_hash_are_the_first_by_hash(spark):
    import hashlib
    rows = [(i % 3, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, k int")
    got = training.first_by_hash(df, "g", "k", 25, bits=8).collect()
    for g in range(3):
        want = sorted((hashlib.md5(f"{k}:42".encode()).hexdigest(), k) for x, k in rows if x == g)[:25]
        assert sorted(r.k for r in got if r.g == g) == sorted(k for _, k in want)


def test_json_lines_that_are_none(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": "x", "more": 2}\nno record\n\n{"b": null}\n{"a": "text"}\n[1, 2]\n')
    got = [tuple(r) for r in sinks.read_json(spark, str(tmp_path), "a bigint, b string").collect()]
    assert got[:3] == [(1, "x", None), (None, None, "no record"), (None, None, None)]
    assert [r[2] for r in got[3:4]] == ['{"a": "text"}']


def test_stream_analyses_each_file_once(spark, tmp_path):
    drop, store, check = (str(tmp_path / n) for n in ("drop", "store", "check"))
    os.makedirs(drop)
    for name, body in (("a.txt", "The party shall pay."), ("b.txt", "No party may end it."), ("c.pdf", "%PDF")):
        with open(f"{drop}/{name}", "w") as f:
            f.write(body)
    drops.stream_files(spark, drop, store, check).awaitTermination()
    assert {r.file_name: r.status for r in spark.read.parquet(store).collect()} == {
        "a.txt": "success", "b.txt": "success", "c.pdf": "unsupported"}
    # the same file delivered again under a new checkpoint, next to a new one
    with open(f"{drop}/d.txt", "w") as f:
        f.write("A new document.")
    drops.stream_files(spark, drop, store, str(tmp_path / "check2")).awaitTermination()
    assert sorted(r.file_name for r in spark.read.parquet(store).collect()) == ["a.txt", "b.txt", "c.pdf", "d.txt"]


def test_stream_of_rows_collapses_copies(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(i, "the same text for all" if i % 3 else f"text {i}") for i in range(90)],
                          "id bigint, text string").repartition(3).write.parquet(src)
    drops.stream_table(spark, src, "id bigint, text string", str(tmp_path / "st"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "st")).count() == 31
    keyed = str(tmp_path / "keyed")
    for check in "ab":  # a second run finds every row in its bucket of the store
        drops.stream_table(spark, src, "id bigint, text string", keyed, str(tmp_path / check), key="id", files_per_batch=2).awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(keyed).collect()) == list(range(90))
