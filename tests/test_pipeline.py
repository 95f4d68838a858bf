import json
import random

import pytest
from pyspark.sql import functions as F

from clauselake.config import AnalysisConfig
from clauselake.functions.text import clean_text
from clauselake.operators import evaluate, extract, segment as sg, summary, xref
from clauselake.operators.metadata import with_metadata
from clauselake.plans import pipeline
from clauselake.plans.corpus import contracts
from clauselake.rules.model import RiskRule
from conftest import AGREEMENT, SF


def secs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, text string")
    return sg.sections(df)


def test_cross_references(spark):
    text = ("1. First heading of it\n\nRules apply pursuant to Section 2, see Section 2 and Section 1 hereof,\nand see Clause 7.\n\n"
            "2. Second heading\n\n2. Second again\n\nSubject to Section 2 it is done as described in Article 1\nand so on.")
    rows = secs(spark, [(1, text)])
    got = xref.reference_lists(xref.cross_references(rows)).orderBy("section_id").collect()
    assert [(r.section_id, r.target_section_ids) for r in got] == [
        ("sec-001", ["sec-003", "sec-000", "sec-003"]), ("sec-004", ["sec-003", "sec-000"])]


def test_pattern_answers_and_model_answers(spark):
    text = ("This contract between North Works and South Works, has an effective date of May 4, 2021. It shall terminate on "
            "June 1, 2024. It is governed fully by all the laws of the State of Ohio. End.")
    docs = spark.createDataFrame([(1, text), (2, "too short text")], "doc_id int, body string")
    found = extract.extract(docs)
    got = {(r.doc_id, r.ext_type): (r.value, r.confidence, r.method) for r in found.collect()}
    assert got[1, "parties"] == ("North Works and South Works", 0.9, "pattern")
    assert got[1, "effective_date"] == ("May 4, 2021", 0.9, "pattern")
    assert got[1, "termination_date"] == ("June 1, 2024", 0.9, "pattern")
    assert got[1, "governing_law"] == ("Ohio", 0.9, "pattern") and got[1, "venue"] == ("", 0.0, "none")
    model = spark.createDataFrame([(1, "venue", "Columbus", 0.5), (1, "parties", "Other", 0.99), (1, "notice_period", "", 0.9),
                                   (2, "venue", "Paris", 0.9)], "doc_id int, ext_type string, value string, confidence double")
    merged = {(r.doc_id, r.ext_type): (r.value, r.method) for r in extract.merge_answers(found, model).collect()}
    assert merged[1, "venue"] == ("Columbus", "ml") and merged[1, "parties"][1] == "pattern"
    assert merged[1, "notice_period"] == ("", "none") and merged[2, "venue"] == ("", "none")
    assert extract.questions(docs).count() == 16


def plain_summary(text):
    import re

    from clauselake.rules.term import LEGAL_TERMS
    words = [w for t in LEGAL_TERMS for w in t.words]
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.I)
    if len(text.strip()) < 50:
        return ""
    parts = [s.strip() for s in re.split("\x01", re.sub(r"([.!?])\s+", "\\1\x01", text)) if s.strip()]
    order = sorted(range(len(parts)), key=lambda i: (-len(pattern.findall(parts[i])), i))
    used, kept = 0, []
    for i in order:
        n = len(parts[i].split())
        if used + n <= 150 or used < 30:
            kept.append(i)
        used += n
    return " ".join(parts[i] for i in sorted(kept))


def test_summary_equals_a_plain_loop(spark):
    rng = random.Random(11)
    vocabulary = "the party shall pay a fee under this agreement and keep term notice of it warm green house".split()
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "!", "?\n"]) for _ in range(rng.randrange(3, 400)))
             for _ in range(40)] + ["short one.", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", summary.summarize(F.col("t")).alias("s")).collect()}
    assert got == {i: plain_summary(t) for i, t in enumerate(texts)}


def test_prefix_names_the_type(spark):
    df = spark.createDataFrame([("All is well.", "loan"), ("A Loan it is.", "loan"), ("Any.", "general")], "s string, t string")
    got = [r.x for r in df.select(summary.with_prefix(F.col("s"), F.col("t")).alias("x")).collect()]
    assert got == ["This loan agreement all is well.", "A Loan it is.", "Any."]


def test_important_sections_keep_order_or_take_the_longest(spark):
    many = "\n\n".join(f"They shall pay sum number {i} " + "again " * (i % 7) for i in range(14))
    few = "\n\n".join(["They shall pay it now.", "Blue sky and sea.", "word " * 101, "It may cease soon."])
    docs = spark.createDataFrame([(1, many), (2, few)], "doc_id int, text string")
    got = summary.important_sections(docs).orderBy("doc_id", "position").collect()
    first = sorted(range(14), key=lambda i: (-(6 + i % 7), i))[:10]
    assert [r.para_idx for r in got if r.doc_id == 1] == first
    assert [r.para_idx for r in got if r.doc_id == 2] == [0, 2, 3]
    assert summary.important_sections(docs, most=None).where("doc_id = 1").count() == 14


def test_row_arrays_equal_the_tables(spark):
    docs = contracts(spark, SF).where("doc_id < 120")
    tables = pipeline.analyze(docs)
    wide = {r.doc_id: r for r in pipeline.analysis_rows(docs).select(
        "doc_id", "sections_count", F.size("risks").alias("risks"), "key_points", "answers").collect()}
    count = {r.doc_id: r["count"] for r in tables["sections"].groupBy("doc_id").count().collect()}
    risks = {r.doc_id: r["count"] for r in tables["risks"].groupBy("doc_id").count().collect()}
    points = {}
    for r in tables["key_points"].orderBy("doc_id", "point_id").collect():
        points.setdefault(r.doc_id, []).append((r.point_id, r.description, r.context))
    for d, r in wide.items():
        assert r.sections_count == count.get(d, 0) and r.risks == risks.get(d, 0)
        assert [(k.point_id, k.description, k.context) for k in r.key_points] == points.get(d, [])


@pytest.mark.parametrize("cfg", [AnalysisConfig(), AnalysisConfig(hierarchical=False, detect_pii=False, cross_references=False)])
def test_switches_choose_branches(spark, agreement, cfg):
    tables = pipeline.analyze(agreement, cfg)
    assert ("cross_references" in tables) == cfg.cross_references
    r = pipeline.response(agreement, cfg).first()
    assert r.metadata.contract_type == "general" and r.metadata.type_confidence == 0.5
    assert r.has_pii == cfg.detect_pii and r.sections_count == 13 and r.status == "success"
    assert tables["sections"].where("parent_id is not null").count() == (12 if cfg.hierarchical else 0)


def test_inline_agreement_end_to_end(spark, agreement):
    r = pipeline.response(agreement).first()
    assert r.pii_types == ["phone"] and r.risks_count == 2 and r.risks_by_category == {"payment_risk": 2}
    assert [k.point_id for k in r.summary.key_points] == ["point-000", "point-001"]
    assert len(r.summary.overall) > 50 and r.summary.basics.estimated_length == "short"
    m = pipeline.analyze(agreement)["metadata"].first()
    assert m.dates == ["October 31, 2024"] and m.parties == []
    d = pipeline.digest(agreement).first()
    assert [k.name for k in d.key_risks] == ["Hidden Fee", "Unilateral Price Change"]


def test_bad_documents_become_rows(spark):
    df = spark.createDataFrame([(1, "a.txt", None), (2, "b.txt", ""), (3, "c.xyz", "invalid")],
                               "doc_id int, file_name string, text string")
    got = {r.doc_id: r for r in pipeline.response(df).collect()}
    assert [got[i].status for i in (1, 2, 3)] == ["error", "error", "success"]
    assert len(got[1].errors) == 1 and got[1].summary.overall == "Analysis failed" and got[1].metadata.file_type == "unknown"
    assert got[1].summary.key_points == [] and got[3].sections_count == 0
    stats = evaluate.corpus_stats(pipeline.metrics(df)).first()
    assert (stats.total_contracts, stats.successful_contracts) == (3, 1) and abs(stats.error_rate - 2 / 3) < 1e-12


def test_detailed_response_nests_everything(spark, agreement, tmp_path):
    one = pipeline.detailed_response(agreement, staging=str(tmp_path / "prepared"))
    r = json.loads(one.select(F.to_json(F.struct(*one.columns)).alias("j")).first().j)
    assert len(r["sections"]) == 13 and r["sections"][5]["children_ids"] == ["sec-006", "sec-009"]
    assert [x["risk_name"] for x in r["risks"]] == ["Hidden Fee", "Unilateral Price Change"]
    assert [a["ext_type"] for a in r["extracted_data"]] == list(extract.EXTRACTION_TYPES)


def test_detailed_response_is_put_together_in_the_row(spark, agreement):
    plan = pipeline.detailed_response(agreement)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_detailed_response_says_what_the_tables_say(spark, agreement):
    """Sections, risks with a model's, answers and references of the row equal the normalized tables."""
    more = agreement.withColumns({"doc_id": F.lit(2).cast("bigint"), "text": F.concat(F.col("text"), F.lit(
        "\n\n4. LAST THINGS\n\n4.1 As Section 2.1 and Section 3.2 and Section 2.1 say, and Section 9.9 does not, this is so for all."))})
    docs = agreement.union(more).union(spark.createDataFrame([(3, "x.txt", None), (4, "y.txt", "too short")], agreement.schema))
    bodies = pipeline.prepare(docs)
    rows = pipeline.section_rows(bodies)
    guesses = rows.where("doc_id <> 4").select("doc_id", "section_id", F.when(F.col("para_idx") % 3 == 0, "hidden_fee").when(
        F.col("para_idx") % 3 == 1, "unilateral_price_change").otherwise("novel").alias("label"), (F.lit(1) - F.col("para_idx") / 20).alias("confidence"))
    guesses = guesses.union(guesses.selectExpr("doc_id", "'sec-999'", "label", "1.0D")).union(guesses.selectExpr("doc_id", "'odd'", "label", "1.0D"))
    told = docs.select("doc_id", F.explode(F.array(F.lit("venue"), F.lit("parties"))).alias("ext_type"), F.lit("a model's").alias("value"),
                       F.lit(0.95).alias("confidence"))
    got = {r.doc_id: r for r in pipeline.detailed_response(docs, predictions=guesses, model_answers=told).collect()}
    tables = pipeline.analyze(docs, predictions=guesses, model_answers=told)
    for doc, r in got.items():
        want = tables["sections"].where(F.col("doc_id") == doc).orderBy("para_idx").collect()
        fields = ("section_id", "title", "text", "section_type", "is_header", "level", "parent_id", "children_ids")
        assert [[s[f] for f in fields] for s in r.sections] == [[w[f] for f in fields] for w in want]
        risks = tables["risks"].where(F.col("doc_id") == doc).orderBy("risk_id").collect()
        fields = ("risk_id", "risk_name", "risk_level", "risk_category", "section_id", "confidence", "method")
        assert [[x[f] for f in fields] for x in r.risks] == [[w[f] for f in fields] for w in risks]
        assert r.risks_count == len(risks) == sum(r.risks_by_category.values())
        refs = tables["cross_references"].where(F.col("doc_id") == doc).orderBy("section_id").collect()
        assert [(x.section_id, x.target_section_ids) for x in r.cross_references] == [(w.section_id, w.target_section_ids) for w in refs]
        answers = tables["extracted"].where(F.col("doc_id") == doc).orderBy("type_order").collect()
        if r.status == "success":
            assert [(x.ext_type, x.value, x.method) for x in r.extracted_data] == [(w.ext_type, w.value, w.method) for w in answers]
    assert any(x.method == "ml" for x in got[2].risks)
    assert got[3].risks == [] and got[3].sections == [] and got[3].status == "error"


def test_references_inside_the_row_equal_the_table(spark):
    rng = random.Random(6)
    docs = [(i, "\n\n".join(f"{rng.randint(1, 4)}.{rng.randint(1, 3)} Some clause as set forth in Section {rng.randint(1, 4)}.{rng.randint(1, 3)} and "
                            f"pursuant to Section {rng.randint(1, 9)}.1 of this." for _ in range(rng.randint(0, 40)))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    paras = sg.paragraph_array(F.col("text"))
    got = {(r.doc_id, x.section_id): x.target_section_ids for r in df.select("doc_id", xref.reference_array(paras).alias("x")).collect() for x in r.x}
    table = xref.reference_lists(xref.cross_references(sg.sections(df))).collect()
    assert got == {(r.doc_id, r.section_id): r.target_section_ids for r in table} and len(got) > 50


def test_detailed_response_with_rules_of_ones_own(spark, agreement):
    rule = RiskRule("visits", "Visits", "operational", "low", ("doubled up on",), (), ())
    r = pipeline.detailed_response(agreement, rules=[rule]).first()
    assert [(x.risk_name, x.risk_category) for x in r.risks] == [("Visits", "operational")] and r.risks_by_category == {"operational": 1}


def test_lists_are_whole_if_asked(spark):
    dates = " ".join(f"effective January {i}, 2020 and" for i in range(1, 9))
    body = "\n\n".join(f"{i}. Payment of fee number {i} is due at once." for i in range(1, 9))
    df = spark.createDataFrame([(1, "a.txt", f"{dates}\n\n{body}")], "doc_id int, file_name string, clean string").withColumn("text", F.col("clean"))
    assert [len(with_metadata(df, most=n).first().dates) for n in (5, 7, None)] == [5, 7, 8]
    points = [pipeline.key_point_rows(df, most=n).where("category = 'section'").count() for n in (5, None)]
    rows = sg.sections(df.select("doc_id", "text"))
    assert points == [5, 8] == [summary.key_points(extract.extract(df, "text"), rows, most=n).where("category = 'section'").count() for n in (5, None)]


def test_histogram_counts_every_value(spark):
    values = [0.0, 0.049, 0.05, 0.5, 0.99, 1.0, 1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.bin: r.n for r in evaluate.histogram(df, "v").collect()}
    assert sum(got.values()) == 7 and got[20] == 3 and got[1] == 2
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r.bin, r.n) for r in evaluate.histogram(same, "v").collect()] == [(11, 2)]


def test_text_survives_control_characters_and_scale_of_one_document(spark):
    text = AGREEMENT + "\n\n".join(f"{i}.1 Clause body number {i} shall\nstand." for i in range(3000))
    df = spark.createDataFrame([(1, "big.txt", text)], "doc_id int, file_name string, text string")
    rows = sg.segment(df.select("doc_id", clean_text(F.col("text")).alias("text")))
    assert rows.count() > 3000
    assert pipeline.metrics(df).first().sections_count > 3000


def test_sections_and_risks_are_worked_out_once(spark, agreement, tmp_path):
    guesses = spark.createDataFrame([(1, "sec-001", "novel_risk", 0.9)], "doc_id bigint, section_id string, label string, confidence double")
    plain = pipeline.analyze(agreement, predictions=guesses)
    shared = pipeline.analyze(agreement, predictions=guesses, staging=str(tmp_path / "run"))
    for name in ("risks", "clauses"):
        assert sorted(map(str, shared[name].collect())) == sorted(map(str, plain[name].select(*shared[name].columns).collect()))
    plan = shared["responses"].select("doc_id", "risks_count")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "RLIKE" not in plan and "-risks" in str(shared["risks"].inputFiles())
