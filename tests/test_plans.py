"""What the optimizer must not do to a plan, and batch functions against plain searches."""

import re

from pyspark.sql import functions as F

from clauselake.functions import privacy as pv
from clauselake.functions.text import clean_text, unfold
from clauselake.operators import extract
from clauselake.plans import catalog
from clauselake.plans.corpus import contracts
from clauselake.rules.privacy import ENTITY_PATTERNS
from clauselake.rules.vocab import EXTRACTION_PATTERNS, EXTRACTION_TYPES
from conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_is_worked_out_below_the_exchange_that_spreads_it(spark):
    for name in ("section_types", "label_encoding", "prediction_quality", "risk_by_category", "risk_top5", "risk_type_matrix",
                 "legal_entities", "section_offsets", "extract_merge", "pii_report"):
        above, *below = plan_of(catalog.QUERIES[name](spark, SF)).split("RepartitionByExpression")
        assert below and "EvalPython" in above, name
        assert not any("EvalPython" in part for part in below[:1]), name


def test_rule_gate_and_shared_cleaning_run_once(spark):
    assert plan_of(catalog.risk_by_category(spark, SF)).count("ArrowEvalPython") == 3
    assert len(re.findall(r"\bclean\(", plan_of(catalog.risk_type_matrix(spark, SF)))) == 1


def test_unfold_keeps_elements_and_drops_empty_rows(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None)], "i int, xs array<string>")
    assert [tuple(r) for r in unfold(df, ["i"], F.col("xs"), "at", "x").collect()] == [(1, 0, "a"), (1, 1, None), (1, 2, "b")]


ODD = [None, "", "THIS AGREEMENT of today by A\nand B, C", "agreement between  and  x", "Agreement\tmade and entered into \x0b and \x0c,",
       "the effective date is Maﬆ 3, 2020. Effective date is May 3, 2020", "shall end upon 1/2/20; expiring date of June 1 1999",
       "EXPIRIES date. termination date iſ May 1, 2000 termination date shall be May 2, 2001 end",
       "ſhall end on May 1, 2000", "governed by the laws of  State of  New York é", "governing law x\ny is that of Ohio. governing law: is Utah",
       "contract  contract by and between é ü and ö. agreement between (a) and (b), c"]


def test_answers_equal_a_plain_search(spark):
    texts = ODD + [r.t for r in contracts(spark, SF).select(clean_text(F.col("text")).alias("t")).limit(200).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    got = {(r.doc_id, r.ext_type): (r.value, r.method) for r in extract.extract(df).collect()}
    blanks = " \t\n\r\x0b\x0c"
    for i, text in enumerate(texts):
        for kind in EXTRACTION_TYPES:
            found = (re.search(p, text or "", re.I | re.A) for p in EXTRACTION_PATTERNS.get(kind, ()))
            match = next((m for m in found if m), None)
            value = " and ".join(g for g in match.groups() if g.strip(blanks)).strip(blanks) if match else ""
            assert got[i, kind] == (value, "pattern" if match else "none"), (kind, text)


def test_entities_equal_a_search_without_the_batch_test(spark):
    texts = ODD + ["Contract No. -é", "éContract # 7", "LICENSE Number a-é and Agreement\x0b#b", "TaxK EIN:: 12-3456789", "EIN\n123456789é",
                   "5 U.S. 7 (1999)x 5 U.S. 7 (1999)é 5 U.S.\x0b7 (1999)_", "ſ Company Number : 121234567"]
    texts += [r.t for r in contracts(spark, SF).select(clean_text(F.col("text")).alias("t")).limit(100).collect()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from clauselake.rules.model import java_pattern
    plain = F.array(*[F.array_distinct(F.regexp_extract_all("t", F.lit(java_pattern(p, ci)), F.lit(0))) for _, p, ci in ENTITY_PATTERNS])
    for r in df.select("t", pv.legal_entities(F.col("t")).alias("e"), plain.alias("plain")).collect():
        want = {name: found for (name, *_), found in zip(ENTITY_PATTERNS, r.plain) if found}
        assert r.e == want, r.t
