import random
import re

from pyspark.sql import functions as F

from clauselake.functions.text import clean_text
from clauselake.operators import segment as sg
from clauselake.rules.vocab import HEADER_PATTERNS, SECTION_TYPES


def fold_parents(levels):
    """Stack of the last header per level, as a plain loop."""
    stack, out, current = {}, [], None
    for i, level in enumerate(levels):
        if level is None:
            out.append(current)
            continue
        smaller = [k for k in stack if k < level]
        out.append(stack[max(smaller)] if smaller and level > 0 else None)
        stack = {k: v for k, v in stack.items() if k < level} | {level: i}
        current = i
    return out


def test_inline_agreement(agreement):
    docs = agreement.select("doc_id", clean_text(F.col("text")).alias("text"))
    rows = sg.segment(docs).orderBy("para_idx").collect()
    got = [(r.is_header, r.section_number, r.level, r.parent_id) for r in rows]
    assert got == [
        (True, None, 0, None), (True, None, 1, "sec-000"), (False, None, 0, "sec-001"), (True, "I", 1, "sec-000"),
        (False, None, 0, "sec-003"), (True, "II", 1, "sec-000"), (True, "2.1", 2, "sec-005"), (True, "2.2.1", 3, "sec-006"),
        (False, None, 0, "sec-007"), (True, "2.3", 2, "sec-005"), (True, "III", 1, "sec-000"), (False, None, 0, "sec-010"),
        (True, "IV", 1, "sec-000")]
    assert rows[0].children_ids == ["sec-001", "sec-003", "sec-005", "sec-010", "sec-012"]
    assert rows[5].children_ids == ["sec-006", "sec-009"] and rows[2].children_ids == rows[12].children_ids == []
    assert rows[2].title == "Section 3" and rows[1].title == "Words used here" and rows[5].title == "MONEY MATTERS"


def test_offsets_slice_back(agreement):
    docs = agreement.select("doc_id", clean_text(F.col("text")).alias("text"))
    rows = sg.segment(docs).orderBy("para_idx").collect()
    joined = "\n\n".join(r.text for r in rows)
    texts = [r.text for r in rows]
    for i, r in enumerate(rows):
        assert joined[r.start_char:r.end_char] == r.text
        assert r.ref_start_char == (len("\n\n".join(texts[:i])) + 2 * i if i else 0)
        assert r.ref_end_char == len("\n\n".join(texts[:i + 1])) + 2 * i


def test_short_and_numeric_paragraphs_do_not_count(spark):
    text = "1. PURPOSE\n\n1234567890.1\n\nA paragraph that stays here.\n \t\nAnother one that stays."
    rows = sg.paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r.para_idx, r.text[:9]) for r in rows] == [(0, "A paragra"), (1, "Another o")]


def test_header_shapes_match_python(spark):
    samples = ["12.3.4 Deep clause here", "IV. Ending the deal", "X Some title here", "B. Notices to all", "RECITALS AND MORE: text",
               "WITNESSETH:\nwrapped text", "1.\nwrapped number line", "2 lines\nare no header", "Section 12 - Payment of it",
               "article iv: general", "Exhibit B - ", "SCHEDULE A: Amounts", "plain words only", "1.1.1."]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = {r.i: (r.k, r.n, r.h) for r in df.select(
        "i", sg.header_kind(F.col("t")).alias("k"), sg.header_group(F.col("t"), sg.header_kind(F.col("t")), 1).alias("n"),
        sg.header_group(F.col("t"), sg.header_kind(F.col("t")), 2).alias("h")).collect()}
    for i, s in enumerate(samples):
        want = (None, None, None)
        for name, pattern, ignore_case in HEADER_PATTERNS:
            m = re.match(pattern, s, re.I if ignore_case else 0)
            if m:
                want = (name, m.group(1), m.group(2) or "")
                break
        assert got[i] == want, s


def test_parents_and_children_equal_the_fold(spark, monkeypatch):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(40):
        levels = [rng.choice([None, None, 0, 1, 1, 2, 2, 3, 4, 6, 14, 15]) for _ in range(rng.randrange(40))]
        want[doc] = fold_parents(levels)
        rows.append((doc, [(level is not None, level or 0, i) for i, level in enumerate(levels)]))
    df = spark.createDataFrame(rows, "doc_id int, lines array<struct<is_header:boolean,level:int,idx:int>>")
    for block in (4, 512):
        monkeypatch.setattr(sg, "BLOCK", block)
        found = df.select("doc_id", sg.parents(F.col("lines")).alias("p")).withColumn("k", sg.children(F.col("p"))).collect()
        for r in found:
            assert r.p == want[r.doc_id]
            assert r.k == [[j for j, p in enumerate(r.p) if p == i] for i in range(len(r.p))]


def test_deep_headings_keep_their_parents(spark):
    numbers = [".".join(["1"] * n) for n in range(1, 16)]
    text = "\n\n".join(f"{n} Heading number {len(n)}" for n in numbers)
    rows = sg.segment(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("para_idx").collect()
    assert [r.level for r in rows] == list(range(1, 16))
    assert [r.parent_id for r in rows] == [None] + [f"sec-{i:03d}" for i in range(14)]


def test_section_type_first_match_wins(spark):
    texts = ["They agree and represent.", "A warranty until then.", "When it is late.", "Nothing of that kind", "ONLY CAPITALS HERE",
             "It may cease.", "The billing", "He will settle", "in the meaning", "described in it"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    got = [r.x for r in df.select(sg.section_type(F.col("t"), F.col("low"), F.lit(3)).alias("x")).collect()]

    def plain(t):
        for name, words in SECTION_TYPES.items():
            if any(w in t.lower() for w in words):
                return name
        return "header" if t.isupper() else "clause"
    assert got == [plain(t) for t in texts]


def test_flat_mode_has_no_tree(agreement):
    docs = agreement.select("doc_id", clean_text(F.col("text")).alias("text"))
    rows = sg.segment(docs, hierarchical=False).orderBy("para_idx").collect()
    assert {r.parent_id for r in rows} == {None} and {r.level for r in rows} == {0}
    assert all(r.children_ids == [] for r in rows) and rows[0].is_header


def test_the_tree_needs_no_exchange(spark, tmp_path, agreement):
    path = str(tmp_path / "docs")
    agreement.select("doc_id", clean_text(F.col("text")).alias("text")).write.parquet(path)
    plan = sg.segment(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_the_tree_of_batches_equals_the_tree_in_the_row(spark):
    from clauselake.plans.corpus import contracts
    from clauselake.functions.text import prefix_sums
    from conftest import SF

    rng = random.Random(5)
    lines = ["1. First heading", "1.2 Second heading", "1.2.3. Third one here", "IV. Roman numbers", "A. Letter heading", "IX The ninth part",
             "TITLED THING: and more", "Section 4 - about it", "ARTICLE IV: words", "exhibit b - the list", "ſection 3. long s here", "SCHEDULE 1: ",
             "ONLY CAPITALS HERE", "ends in a colon:", "a plain paragraph of words", "ÉÉÉ ÀÀÀ ÜÜÜ ÖÖÖ", "1.1\nbroken heading line", "1.1 line\nand more",
             "1.1 heading of a kind\x85", "CAPITALS\x0bAND\x0bMORE OF THEM", "٣. arabic digit line", "X" * 30 + "."]
    texts = [None, "", "short"] + ["\n\n".join(rng.choices(lines, k=rng.randrange(1, 30))) for _ in range(60)]
    texts += [r.t for r in contracts(spark, SF).select(clean_text(F.col("text")).alias("t")).limit(100).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = df.select("doc_id", sg.paragraph_array(F.col("text")).alias("ps"))
    rows = rows.select("doc_id", "ps", sg.parents(sg.outline(F.col("ps"), True)).alias("parent"), prefix_sums(F.transform("ps", F.length)).alias("before"))
    want = {(r.doc_id, i): (r.ps[i], r.before[i] + 2 * i, None if r.parent[i] is None else f"sec-{r.parent[i]:03d}",
                            [f"sec-{j:03d}" for j, p in enumerate(r.parent) if p == i])
            for r in rows.collect() if r.ps for i in range(len(r.ps))}
    got = {(r.doc_id, r.para_idx): (r.text, r.start_char, r.parent_id, r.children_ids) for r in sg.segment(df).collect()}
    assert got == want
