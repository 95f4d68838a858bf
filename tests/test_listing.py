"""Tasks list what is in folders; no path of a file is part of a plan."""

import os

import pytest

from clauselake.plans.catalog import file_drop
from clauselake.sources import files, listing
from conftest import SF


def names(frame):
    return sorted((r.path.rsplit("/", 1)[1], r.length) for r in frame.collect())


@pytest.fixture
def tree(tmp_path):
    for name, size in (("a.txt", 3), ("empty.txt", 0), ("_hidden.txt", 1), (".dot", 1), ("x/b.pdf", 5), ("x/y/c d+é.txt", 7), ("x/y/z/e.TXT", 1),
                       ("_no/f.txt", 1), ("k=1/g.docx", 2)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    return str(tmp_path)


def test_levels_hidden_names_and_patterns(spark, tree):
    assert names(listing.list_files(spark, tree)) == [("a.txt", 3), ("empty.txt", 0)]
    all_files = [("a.txt", 3), ("b.pdf", 5), ("c d+é.txt", 7), ("e.TXT", 1), ("empty.txt", 0), ("g.docx", 2)]
    assert names(listing.list_files(spark, tree, True)) == sorted(all_files)
    assert names(listing.list_files(spark, tree, True, "*.{txt,pdf}")) == [("a.txt", 3), ("b.pdf", 5), ("c d+é.txt", 7), ("empty.txt", 0)]
    assert names(listing.list_files(spark, f"{tree}/a.txt")) == [("a.txt", 3)]
    assert names(listing.list_files(spark, f"{tree}/x/*")) == [("b.pdf", 5), ("c d+é.txt", 7)]
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, f"{tree}/none")
    assert listing.patterns("a{b,c}d{e,f}") == ["abde", "abdf", "acde", "acdf"]


def test_paths_are_those_of_the_scan(spark, tree):
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tree).select("path")
    assert {r.path for r in scan.collect()} == {r.path for r in listing.list_files(spark, tree, True).where("length > 0").collect()}


def test_the_plan_does_not_grow_with_the_files(spark, tmp_path):
    sizes = []
    for n in (5, 200):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"{i}.txt").write_bytes(b"" if i % 2 else b"text")
        rows = files.read_files(spark, str(folder))
        assert rows.count() == n and rows.where("status = 'error'").count() == n // 2
        sizes.append(len(rows._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < sizes[0] + 100


def test_files_share_folders_and_hold_their_texts(spark):
    root = file_drop(spark, SF)
    folders = [p for p, inner, _ in os.walk(root) if not inner]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    assert len(docs) > 100 > len(folders)
    for d in docs[:50]:
        scan = d.doc_id % 10 == 0
        path = f"{root}/{'scans' if scan else 'texts'}/shelf={d.doc_id % 10}/box={d.doc_id // 10_000}/{d.doc_id}.{'pdf' if scan else 'txt'}"
        with open(path, encoding="utf-8", newline="") as f:
            assert f.read() == (str(d.doc_id) if scan else d.text) + "\n"
