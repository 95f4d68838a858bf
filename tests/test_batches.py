"""Functions over Arrow batches say what the expressions over single texts say."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from clauselake.functions import batches
from clauselake.functions import metadata as md
from clauselake.functions import privacy as pv
from clauselake.functions.text import clean_text, strip, word_count
from clauselake.operators import detect, xref
from clauselake.operators import segment as sg
from clauselake.operators.privacy import with_pii
from clauselake.plans.catalog import section_types
from clauselake.rules.clause import CLAUSE_RULES
from clauselake.rules.model import java_pattern
from clauselake.rules.privacy import PII_PATTERNS
from clauselake.rules.risk import RISK_RULES
from clauselake.rules.vocab import CONTRACT_TYPES, DATE_PATTERN, PARTY_PATTERN, SECTION_TYPES
from conftest import SF

ODD = ["", " ", "\n", "a", " a  b\tc\x0b\x0cd\r\n", "Keep", "bİlling", "BILLING", "İK agree", "fee paid", "中文 shall",
       "Of no kind", "CAPITALS ONLY", "It must", "x\u0085y"]


def odd_texts():
    dice = random.Random(5)
    words = [w for ws in SECTION_TYPES.values() for w in ws] + ["", "x", "\n", "\t", "\x0c", "é", "END", "when", "no"]
    return ODD + [" ".join(dice.choice(words) for _ in range(dice.randrange(6))) for _ in range(300)]


def test_batches_agree_with_expressions(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    t = F.col("t")
    rows = df.select(
        "t", batches.words_of(t).alias("w"), word_count(t).alias("w1"),
        sg.section_type(t, F.col("low"), word_count(t)).alias("type"),
        sg.typed(t, batches.first_of(t, [sg.indicator_words(w) for w in SECTION_TYPES.values()]), word_count(t)).alias("type1")).collect()
    for r in rows:
        assert r.w == r.w1 == len([x for x in re.split(r"[ \t\n\r\x0b\x0c]+", r.t) if x]), r
        assert r.type == r.type1, r


def test_slices_and_nulls():
    whole = pa.array(["x", None, "two words", "", " a\nb c "])
    assert batches.counted_words(whole.slice(1)).to_pylist() == [None, 2, 0, 3]
    assert batches.first_holding(whole.slice(1), ["words", "b"]).to_pylist() == [None, 0, None, 1]
    assert batches.cleaned(whole.slice(1)).to_pylist() == ["", "two words", "", "a\nb c"]
    assert batches.cleaned(pa.array([], pa.string())).to_pylist() == []


def test_cleaning_steps(spark):
    given = ["a\x07b—ć", "жш фąx 中́", "aBcD  e\n\n\n\nf", "a\n 12 \nb\n3\n4\nc", "a\n page 1 OF 2\nb", None]
    want = ["a b--c", "zhsh fax 中", "a Bc D e\n\nf", "a\nb\n4\nc", "a\nb", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    assert [r.c for r in df.orderBy("i").select(clean_text(F.col("t")).alias("c")).collect()] == want


def test_types_take_one_search_a_type_not_one_a_word(spark):
    plan = section_types(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Contains(" not in plan


PII_TEXTS = ["é.%@c.org", "é(555) 010-4477", "7\x0bOld\x0bStreet", "x" * 50, "Dr. Ann\nLee of 1 Kſ St, ACCOUNT no number 12345é", "AB1234567é",
             "ssn 123-45-6789, a@b.co 4111 1111 1111 1111 and 04/17/1961 or 1961-04-17"]


def test_personal_data_behind_the_batch_test_is_what_the_patterns_find(spark):
    df = spark.createDataFrame([(t,) for t in PII_TEXTS], "t string")
    t = F.col("t")
    each = [pv._all_values(t, *p).alias(p[0]) for p in PII_PATTERNS]
    for r in df.select("t", pv.pii_values(t).alias("g"), *each).collect():
        assert {g.pii_type: g["values"] for g in r.g} == {n: r[n] for n, _, _ in PII_PATTERNS if r[n]}, r


def test_redaction_searches_only_for_types_that_were_found(spark):
    df = spark.createDataFrame([(t,) for t in PII_TEXTS], "clean string")
    plan = with_pii(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "RLIKE" not in plan


def test_word_boundaries_are_tested_only_where_a_match_can_begin(spark):
    for name, pattern, ignore_case in PII_PATTERNS:
        java = pv._jvm_pattern(name, pattern, ignore_case)
        assert name == "email" or re.match(r"\(\?d?i?\)\(\?=", java), name
        for text in PII_TEXTS:
            if text.isascii() and name != "name":
                assert re.findall(java.replace("(?di)", "(?i)").replace("(?d)", ""), text) == re.findall(("(?i)" if ignore_case else "") + pattern, text)


def test_paragraphs_agree_with_expressions(spark):
    dice = random.Random(7)
    parts = ["\n", "\n\n", " \n \x0b\n", "\t", "12.5 ", "123456789.0", "words of a line", "é中文 und 中文 so", "\x0c", " ", "\r\n\r\n", "x"]
    texts = ["", "\n\n", "123456789.01 \n\nplain words here", None] + ["".join(dice.choice(parts) for _ in range(dice.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.filter(F.transform(F.split("t", r"\n\s*\n"), strip), lambda p: (F.length(p) > sg.MIN_PARAGRAPH) & ~p.rlike(r"^[\d.]+$"))
    for r in df.select("t", sg.paragraph_array(F.col("t")).alias("got"), plain.alias("want")).collect():
        assert r.got == r.want, r


def test_found_names_agree_with_expressions(spark):
    dice = random.Random(11)
    parts = ["dated ", "Dated as of ", "AS OF\n", "effective", " May 3, 2020", " 01/02/2021 ", "3rd day of June, 2022", "by and between ", "Between\t",
             "among", " Alpha", " and ", " Beta, ", ".", "é", " İ", "between", ", ", "  B  "]
    texts = [None, ""] + ["".join(dice.choice(parts) for _ in range(dice.randrange(14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    dates = F.slice(F.array_distinct(F.regexp_extract_all("t", F.lit(java_pattern(DATE_PATTERN)), F.lit(1))), 1, 5)
    halves = [F.regexp_extract_all("t", F.lit(java_pattern(PARTY_PATTERN)), F.lit(n)) for n in (1, 2)]
    names = F.flatten(F.zip_with(*halves, lambda a, b: F.array(strip(a), strip(b))))
    parties = F.slice(F.array_distinct(F.filter(names, lambda n: F.length(n) > 3)), 1, 5)
    rows = df.select("t", md.all_dates(F.col("t")).alias("d"), dates.alias("d1"), md.all_parties(F.col("t")).alias("p"), parties.alias("p1")).collect()
    assert all(r.d == r.d1 and r.p == r.p1 for r in rows), [r for r in rows if (r.d, r.p) != (r.d1, r.p1)][:3]
    assert sum(bool(r.d) for r in rows) > 50 and sum(bool(r.p) for r in rows) > 50


def test_types_agree_with_expressions(spark):
    dice = random.Random(13)
    words = [w for ws in CONTRACT_TYPES.values() for w in ws] + ["Lease_", "non", "-", "of", "é", "rent1", "TRADE", "secret", "trade  secret"]
    texts = [None, ""] + ["".join(dice.choice(words) + dice.choice([" ", "-", "", "\n"]) for _ in range(dice.randrange(9))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower("t").alias("low"), md.type_scores(F.col("t")).alias("s"))
    for r in df.select("t", "s", md.top_type(F.col("low"), F.col("s")).alias("a"), md.top_type(F.col("low"), F.lit(None).cast("array<int>")).alias("b")).collect():
        assert r.a == r.b and (r.s is None) == (r.t is None or not r.t.isascii()), r


def test_gates_miss_no_rule(spark):
    dice = random.Random(17)
    for rules in (RISK_RULES, CLAUSE_RULES):
        words = [w for r in rules for ws in detect.rule_words(r) for w in ws] + ["shall be", "the", "“Fee” means", "at any time", "not", "İ"]
        texts = ["", *[" ".join(w.upper() if dice.random() < 0.2 else w for w in dice.choices(words, k=dice.randrange(14))) for _ in range(500)]]
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower("t").alias("low"), detect.gate(rules, F.col("t")).alias("held"))
        t, low = F.col("t"), F.col("low")
        rows = df.select(detect.raised(detect.gated_flags(rules, t, low, F.col("held"))).alias("got"), detect.fired_rules(rules, t, low).alias("want")).collect()
        assert all(r.got == r.want for r in rows) and any(r.want for r in rows)
    # a rule without words that its patterns need is not gated
    assert batches.held_groups(pa.array(["a", "b"]), [[], [["b"]]]).to_pylist() == [1, 3]


def test_headers_agree_with_expressions(spark):
    texts = odd_texts() + ["1. Fees", "IV. End", "A Deal", "TERMS: x", "Section 2: Pay", "ſection 2: Pay", "EXHIBIT B - ", "1.2.3 a\n", "2.1 a\nb", "TITLE.\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("held", sg.held_headers(F.col("t")))
    rows = df.select("t", sg.header_kind(F.col("t"), F.col("held")).alias("a"), sg.header_kind(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) > 5


def test_spelling_keeps_texts_apart():
    assert batches.spelled(pa.array(["é", "é", "", "aé", "\x07“", "中"])).to_pylist() == ["e", "e", "", "ae", ' "', "中"]


def test_references_agree_with_expressions(spark):
    dice = random.Random(19)
    parts = ["pursuant to ", "Subject to\n", "as described in ", "see ", "refer to ", "Section ", "article\t", "clause ", "2.1", "3", " hereof", " above", "12.", " é ", " "]
    texts = ["", *["".join(dice.choice(parts) for _ in range(dice.randrange(12))) for _ in range(1500)], None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", xref.numbers_of(F.col("t")).alias("a"), xref.referenced_numbers(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows), [r for r in rows if r.a != r.b][:3]
    assert sum(bool(r.a) for r in rows) > 50 and any(len(r.a or ()) > 1 for r in rows)
