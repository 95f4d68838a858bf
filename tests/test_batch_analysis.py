"""Sections, rules and summaries of whole batches say what the expressions over single texts say."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clauselake.functions.text import is_ascii
from clauselake.operators import detect, summary, xref
from clauselake.operators import segment as sg
from clauselake.plans import pipeline
from clauselake.rules.clause import CLAUSE_RULES
from clauselake.rules.model import RiskRule
from clauselake.rules.prefilter import portable
from clauselake.rules.risk import RISK_RULES
from clauselake.rules.vocab import SECTION_TYPES

HEADS = ["1. PURPOSE OF IT", "2.1 Renewal", "IV. Ending the deal", "B. Liability of", "TERMS AND MORE: of the", "ARTICLE II - The end", "SCHEDULE A: ",
         "Exhibit B - ", "LOUD WORDS HERE", "A short one here:", "Section 4. Pay", "1.2.3 x\ny", "x" * 11, "12.", "::::::::::::", "VII: colon here", "TOO MANY LOUD WORDS " * 4]
WORDS = sorted({w for r in (*RISK_RULES, *CLAUSE_RULES) for p in r.patterns for w in re.findall(r"[A-Za-z]{3,}", p)}
               | {w for ws in SECTION_TYPES.values() for w in ws} | {"Mean", "shall mean", "\"It\" means", "refers to", "a", "X", "é", "5%", "thirty days'"})


def texts(n=500):
    dice = random.Random(23)
    phrases = [re.sub(r"\\s[+*]", " ", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", p)).replace("?", "") for r in (*RISK_RULES, *CLAUSE_RULES) for p in (
        *r.patterns, *r.exceptions)]

    def paragraph():
        if dice.random() < 0.3:
            return dice.choice(HEADS)
        return "".join(dice.choice(WORDS + phrases + phrases) + dice.choice([" ", " ", " ", "  ", "\n", ". ", "! ", ".\t"]) for _ in range(dice.randrange(1, 30)))

    return ["", "\n\n", "short", "é only", *["\n\n".join(paragraph() for _ in range(dice.randrange(9))) for _ in range(n)]]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("hierarchical", [True, False])
def test_sections_agree(rows, hierarchical):
    t = F.col("text")
    both = rows.withColumns({"ps": sg.paragraph_array(t), "none": F.lit(None).cast("array<string>")}).select(
        "text", sg.section_array(F.col("ps"), hierarchical).alias("want"), sg.section_column(t, hierarchical, F.col("none")).alias("got"),
        sg.count_paragraphs(t).alias("n"), F.size("ps").alias("n1"), is_ascii(t).alias("plain")).collect()
    assert all(r.got == (r.want if r.plain else None) and r.n == r.n1 for r in both)
    assert {s.type for r in both for s in r.want} == {*SECTION_TYPES, "header", "clause"}


@pytest.mark.parametrize("rules", [RISK_RULES, CLAUSE_RULES])
def test_rules_agree(rows, rules):
    given = rows.select(F.explode(sg.paragraph_array(F.col("text"))).alias("text")).withColumn("low", F.lower("text"))
    held, flags = detect.flagged(given, rules, ["text", "low"], "held")
    both = held.select("text", "held", detect.raised(flags).alias("got"), detect.fired_rules(rules, F.col("text"), F.col("low")).alias("want")).collect()
    assert all(r.got == r.want and (r.held is None) == (not r.text.isascii()) for r in both)
    assert {n for r in both for n in r.want} == set(range(len(rules)))


@pytest.mark.parametrize("long_headers", [True, False])
def test_fired_lines_agree(rows, long_headers):
    cfg = pipeline.AnalysisConfig(include_long_headers=long_headers)
    t = F.col("text")
    both = rows.withColumn("ps", sg.paragraph_array(t)).select("text", pipeline._fired(F.col("ps"), cfg).alias("want"), detect.fired_column(
        RISK_RULES, t, True, long_headers).alias("got")).collect()
    for r in both:
        assert (r.got is None) == (not r.text.isascii())
        assert r.got is None or [tuple(x) for x in r.got] == [(i, n) for i, fired in enumerate(r.want) for n in fired]


def test_summaries_agree(rows):
    both = rows.select("text", summary.summarize(F.col("text")).alias("got"), summary.summary_of(F.col("text")).alias("want")).collect()
    assert all(r.got == r.want for r in both) and sum(r.want != "" for r in both) > 300


def test_rules_that_engines_may_read_differently_are_left_to_the_jvm(rows):
    for pattern in (r"a(?=b)", r"(?i)a", r"a++", r"a$", r"[a&&b]", r"[a[b]]", r"\Qa\E", r"\Sa", r"(a)\1", r"\p{L}", r"é", r"a{200}", r"[]a]", r"a{,3}"):
        assert not portable(pattern), pattern
    assert all(portable(p) for r in (*RISK_RULES, *CLAUSE_RULES) for p in (*r.patterns, *getattr(r, "exceptions", ())))
    own = (RiskRule("own", "Own", "c", "low", (r"renew(?=al)",)),)
    assert detect.batch_rules(own) is None and detect.batch_rules(own * 64) is None
    docs = rows.select("doc_id", F.lit("x.txt").alias("file_name"), "text")
    counted = pipeline.analysis_rows(docs, rules=own).select("doc_id", "text", F.size("risks").alias("n")).collect()
    assert sum(r.n for r in counted) > 50


@pytest.mark.parametrize("hierarchical", [True, False])
def test_trees_agree(rows, hierarchical):
    t, none = F.col("text"), F.col("none")
    both = rows.withColumns({"ps": sg.paragraph_array(t), "none": F.lit(None).cast("array<string>")}).select(
        "text", sg.section_tree(sg.section_array(F.col("ps"), hierarchical), hierarchical).alias("want"), sg.tree_column(t, hierarchical, none).alias("got")).collect()
    assert all(r.got == (r.want if r.text.isascii() else None) for r in both)
    assert not hierarchical or any(s.children_ids for r in both for s in r.want)


def test_references_agree(spark):
    dice = random.Random(3)
    parts = ["1. Alpha beta gamma", "2.1 Beta gamma delta", "2.1 Again this one", "IV. Ending the deal", "see Section 2.1 and", "pursuant to Clause 1 or",
             "Section 2.1 above holds", "subject to Section 9.9 so", "as defined in Article 1, see Section 1", "words without any"]
    given = ["\n\n".join(" ".join(dice.sample(parts, dice.randrange(1, 3))) for _ in range(dice.randrange(8))) + dice.choice(["", "", "", "é"]) for _ in range(300)]
    t, none = F.col("text"), F.col("none")
    both = spark.createDataFrame([(x,) for x in given], "text string").withColumns(
        {"ps": sg.paragraph_array(t), "none": F.lit(None).cast("array<string>")}).select(
        "text", xref.reference_array(F.col("ps")).alias("want"), xref.reference_column(t, none).alias("got")).collect()
    assert all(r.got == (r.want if r.text.isascii() else None) for r in both) and sum(len(r.want) for r in both) > 100


def test_terms_agree(spark):
    dice = random.Random(7)
    words = [w for t in detect.LEGAL_TERMS for w in t.words]
    parts = [*words, "Agreements", "x", "_", "-", "1", "ip ", "  ", ".", "\n", "termination of", "Effective  Date"]
    given = ["", "Term", "term", "term é"] + ["".join(dice.choice(parts) + dice.choice([" ", " ", "", ". "]) for _ in range(dice.randrange(30)))
                                              + dice.choice(["", "", "é"]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(given)), "i int, text string")
    t = F.col("text")
    both = df.select("text", detect.words_placed_in(t, [w.lower() for w in words], detect.TERM_CONTEXT).alias("got"), detect.term_matches(t).alias("want")).collect()
    assert all(r.got == (r.want if r.text.isascii() else None) for r in both)
    found = detect.detect_terms(df, ["i"]).groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in found} == {i: len(r.want) for i, r in enumerate(both) if r.want}
    # a word of several alike tokens counts from left to right without overlaps
    own = (detect.LEGAL_TERMS[0].__class__("own", "c", "low", ("so so",)),)
    assert [(r.position, r.matched_text) for r in detect.detect_terms(spark.createDataFrame([(1, "So so so so. so")], "i int, text string"), ["i"], own)
            .orderBy("position").collect()] == [(0, "So so"), (6, "so so")]
