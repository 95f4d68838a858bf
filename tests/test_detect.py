import re

from pyspark.sql import functions as F

from clauselake.functions.text import clean_text
from clauselake.operators import detect, segment as sg
from clauselake.plans.corpus import contracts
from clauselake.rules.clause import CLAUSE_RULES
from clauselake.rules.custom import rules_from_dataframe, rules_from_json
from clauselake.rules.prefilter import needles
from clauselake.rules.risk import RISK_RULES
from clauselake.rules.term import LEGAL_TERMS
from conftest import SF


def sections_of(docs):
    return sg.sections(docs.select("doc_id", clean_text(F.col("text")).alias("text")))


def corpus_texts(spark):
    rows = sections_of(contracts(spark, SF)).select("text").distinct().collect()
    return [r.text for r in rows]


def test_packs_have_the_expected_size():
    assert (len(RISK_RULES), sum(len(r.patterns) for r in RISK_RULES), sum(len(r.exceptions) for r in RISK_RULES)) == (9, 45, 27)
    assert (len(CLAUSE_RULES), sum(len(r.patterns) for r in CLAUSE_RULES)) == (12, 47)
    assert (len(LEGAL_TERMS), sum(len(t.words) for t in LEGAL_TERMS)) == (13, 50)


def test_inline_agreement_risks(agreement):
    found = detect.number_risks(detect.detect_risks(sections_of(agreement))).orderBy("risk_id").collect()
    assert [(r.para_idx, r.finding_id, r.risk_category, r.risk_level, r.risk_id) for r in found] == [
        (8, "hidden_fee_3", "payment_risk", "high", "risk-000"),
        (8, "unilateral_price_change_1", "payment_risk", "high", "risk-001")]


def python_findings(text, rules):
    low, out = text.lower(), []
    for rule in rules:
        if any(re.search(e, text, re.I) for e in rule.exceptions) or (rule.context and not any(c in low for c in rule.context)):
            continue
        for i, p in enumerate(rule.patterns):
            m = re.search(p, text, re.I)
            if m:
                a, b = max(0, m.start() - 100), min(len(text), m.end() + 100)
                out.append((rule.key, i, m.group(0), ("..." if a else "") + text[a:b] + ("..." if b < len(text) else "")))
                break
    return out


def test_findings_equal_a_plain_search_on_all_wordings(spark):
    texts = corpus_texts(spark) + [
        "x" * 300 + " the fee may increase " + "y" * 300, 'Word means this. "Quoted" shall mean that.', "a means nothing here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for rules in (RISK_RULES, CLAUSE_RULES):
        got = {}
        for r in detect.find(df, rules, ["doc_id"]).orderBy("doc_id", "rule_no").collect():
            got.setdefault(r.doc_id, []).append((r.rule_key, r.pattern_idx, r.matched_text, r.context))
        for i, t in enumerate(texts):
            assert got.get(i, []) == python_findings(t, rules), t


def test_needles_occur_in_every_match(spark):
    texts = corpus_texts(spark)[:400]
    for rules in (RISK_RULES, CLAUSE_RULES):
        for rule in rules:
            for p in rule.patterns:
                words = needles([p])
                for t in texts:
                    if words and re.search(p, t, re.I):
                        assert any(w in t.lower() for w in words), (p, t)
    assert needles([r"a?b?"]) == () and needles([r"(?:fee|charge)s?\s+may"]) in (("may",), ("charge", "fee"))


def test_terms_equal_finditer(spark):
    texts = corpus_texts(spark)[:300] + ["may may May IP " * 200, "termination", "Term"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {(r.doc_id, r.term, r.word_order, r.position, r.matched_text, r.context)
           for r in detect.detect_terms(df, ["doc_id"]).collect()}
    want = set()
    for i, t in enumerate(texts):
        for term in LEGAL_TERMS:
            for n, w in enumerate(term.words):
                for m in re.finditer(rf"\b{re.escape(w)}\b", t, re.I):
                    a, b = max(0, m.start() - 50), min(len(t), m.end() + 50)
                    want.add((i, term.key, n, m.start(), m.group(0),
                              ("..." if a else "") + t[a:b] + ("..." if b < len(t) else "")))
    assert got == want


def test_model_findings_join_without_repeating_rules(spark, agreement):
    rows = sections_of(agreement)
    predictions = spark.createDataFrame(
        [(1, "sec-008", "hidden_fee", 0.9), (1, "sec-008", "data_usage", 0.7), (1, "sec-011", "odd", 0.6),
         (1, "sec-004", "non_compete", 0.59), (1, "sec-006", "non_compete", 0.99)],
        "doc_id bigint, section_id string, label string, confidence double")
    both = detect.union_model_risks(detect.detect_risks(rows), rows, predictions).orderBy("risk_id").collect()
    assert [(r.risk_id, r.rule_key, r.method, r.risk_category, r.risk_level) for r in both] == [
        ("risk-000", "hidden_fee", "rule_based", "payment_risk", "high"),
        ("risk-001", "unilateral_price_change", "rule_based", "payment_risk", "high"),
        ("risk-002", "data_usage", "ml", "privacy_risk", "medium"),
        ("risk-003", "odd", "ml", "other_risk", "medium")]


def test_own_rules_from_table_and_json(spark, tmp_path):
    row = ("audit", "Audit", "audit_risk", "low", [r"\baudit\b"], [r"no audit"], ["books"], "", "", "")
    schema = ("key string, name string, category string, severity string, patterns array<string>, exceptions array<string>, "
              "context array<string>, impact string, explanation string, suggestion string")
    table = spark.createDataFrame([row], schema)
    rules = rules_from_dataframe(table)
    df = spark.createDataFrame([(1, "They audit the books"), (2, "no audit of books"), (3, "an audit")], "doc_id int, text string")
    assert [(r.doc_id, r.rule_key) for r in detect.find(df, rules, ["doc_id"]).collect()] == [(1, "audit")]
    table.write.json(str(tmp_path / "rules"))
    assert rules_from_json(spark, str(tmp_path / "rules")) == rules


def test_results_do_not_depend_on_partitioning(spark):
    docs = contracts(spark, SF).where("doc_id < 60")
    runs = [sorted((r.doc_id, r.risk_id, r.finding_id) for r in
                   detect.number_risks(detect.detect_risks(sections_of(docs.repartition(n)))).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and runs[0]


def test_definition_runs_equal_the_pattern(spark):
    import random
    rng = random.Random(17)
    rule = next(r for r in CLAUSE_RULES if r.key == "definitions")
    tokens = ["word", "Term", "a", "I", "means", "meansx", "shall", "mean", "shall mean", "refers", "refers to", "to", "9", "9ab",
              '"Quoted text"', "'x y'", '"', "'", "(x)", ",", ".", "it's", "\n", "b2b"]
    texts = ["".join(rng.choice(tokens) + rng.choice([" ", " ", " ", "", "\n"]) for _ in range(rng.randrange(2, 14)))
             for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.hit, r.m) for r in df.select("i", F.col("t").rlike("(?di)" + rule.probes[1].pattern).alias("hit"),
                                                detect.run_match(F.col("t"), rule.probes[1]).alias("m")).collect()}
    for i, t in enumerate(texts):
        m = re.search(rule.patterns[1], t, re.I)
        assert got[i] == (bool(m), m.group(0) if m else ""), t


def test_very_long_word_runs_and_numbers_are_safe(spark):
    text = "9 " + "word " * 60000 + "means this one. See Section 1" + ".1" * 60000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {r.rule_key: len(r.matched_text) for r in detect.find(df, CLAUSE_RULES, ["doc_id"]).collect()}
    assert got["definitions"] == len("word ") * 60000 + len("means")
    heads = sg.sections(spark.createDataFrame([(1, "1" + ".1" * 60000 + " Title")], "doc_id int, text string")).collect()
    assert heads[0].is_header and heads[0].level == 60001


def test_rules_run_as_compiled_code(spark):
    """No pattern is evaluated inside a generator, and no stage keeps a method that the JVM would only interpret."""
    import re

    from clauselake.plans import catalog
    for query in (catalog.clauses, catalog.risks, catalog.clause_risk_link, catalog.terms):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        generators = re.findall(r"Generate explode\((.*)", plan)
        assert generators and not any("RLIKE" in g or "Contains" in g for g in generators)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
