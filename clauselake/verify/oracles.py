"""DuckDB SQL per registered query, with the same column names and types."""

from __future__ import annotations

from clauselake.plans.catalog import (ANSWERS_SQL, DOCUMENT_NAME_SQL, INGEST_MB, LETTERS, OVERLAP, OWN_RULES, PREDICTIONS_SQL,
                                       WIDE_COLUMNS, WINDOW)
from clauselake.plans.corpus import DUCK_BASE, q
from clauselake.rules import training as tr
from clauselake.rules.model import RiskRule
from clauselake.rules.risk import RISK_RULES
from clauselake.rules.term import LEGAL_TERMS
from clauselake.rules.vocab import (ALL_EXTRACTION_TYPES, DEFAULT_RISK_CLASS, EXTRACTION_QUESTIONS, RISK_CLASSES,
                                    SECTION_LABELS)
from clauselake.sources.files import NO_INPUT
from clauselake.verify.duck import clean, finds, sql, strip, words


def values(table: str, rows, *names: str) -> str:
    body = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) {table}({', '.join(names)})"


def _custom_rules() -> str:
    rules = [RiskRule(k, n, c, s, tuple(p), tuple(e), tuple(x)) for k, n, c, s, p, e, x in OWN_RULES]
    found = finds(rules, "(SELECT * FROM bsecs WHERE word_count >= 10 AND NOT is_header)", "rule_key", "finding",
                  lambda r: {"risk_category": q(r.category)})
    return sql("SELECT doc_id, coalesce(n, 0)::BIGINT AS risks_count, coalesce(c, '') AS categories FROM body LEFT JOIN (SELECT doc_id, "
               "sum(n) AS n, string_agg(risk_category || '=' || n, '|' ORDER BY risk_category) AS c FROM (SELECT doc_id, risk_category, "
               f"count(*) AS n FROM ({found}) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)", "body", "bsecs")


def _analyze_with_predictions(graded: str) -> str:
    return sql("SELECT doc_id, coalesce(n, 0)::BIGINT AS risks_count, coalesce(n, 0)::BIGINT AS measured_risks, coalesce(c, 0)::BIGINT AS "
               "unique_risk_categories, coalesce(n, 0)::BIGINT AS risk_rows FROM body LEFT JOIN (SELECT doc_id, count(*) AS n, "
               "count(DISTINCT risk_category) AS c FROM (SELECT doc_id, risk_category FROM brisks UNION ALL SELECT g.doc_id, g.risk_category "
               f"FROM {graded.replace('FROM secs', 'FROM bsecs')} g JOIN bsecs s USING (doc_id, section_id) WHERE s.word_count >= 10 AND NOT "
               "s.is_header AND NOT EXISTS (SELECT 1 FROM brisks r WHERE r.doc_id = g.doc_id AND r.section_id = g.section_id AND "
               "r.rule_key = g.label)) GROUP BY doc_id) USING (doc_id)", "body", "brisks", "bsecs")


def _results(risks: str, answers: str) -> str:
    """The nested parts of every document, one line each."""
    return sql(
        "SELECT m.doc_id, 'success' AS status, o.summary AS overall, coalesce(r.n, 0)::BIGINT AS risks_count, x.sections_count, "
        "coalesce(s.l, '') AS sections, coalesce(r.l, '') AS risks, a.l AS extracted_data, coalesce(c.l, '') AS cross_references "
        "FROM meta m JOIN overall o USING (doc_id) JOIN metrics x USING (doc_id) "
        "LEFT JOIN (SELECT doc_id, string_agg(concat_ws(':', section_id, section_type, level, is_header, coalesce(parent_id, ''), "
        "coalesce(kids, ''), length(text)), '|' ORDER BY para_idx) AS l FROM btree LEFT JOIN (SELECT doc_id AS d, parent_id AS p, "
        "string_agg(section_id, ',' ORDER BY para_idx) AS kids FROM btree GROUP BY ALL) ON d = doc_id AND p = section_id GROUP BY doc_id) s "
        f"USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(concat_ws(':', risk_id, section_id, risk_name, risk_level, "
        f"risk_category, method, round(confidence * 100)::INT), '|' ORDER BY risk_id) AS l FROM ({risks}) GROUP BY doc_id) r USING (doc_id) "
        f"JOIN (SELECT doc_id, string_agg(concat_ws(':', ext_type, value, method), '|' ORDER BY type_order) AS l FROM ({answers}) "
        "GROUP BY doc_id) a USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(section_id || ':' || l, '|' ORDER BY section_id) AS l FROM "
        "(SELECT doc_id, section_id, string_agg(target_section_id, ',' ORDER BY ref_pos) AS l FROM brefs GROUP BY ALL) GROUP BY doc_id) c "
        "USING (doc_id)", "meta", "overall", "metrics", "btree", "brisks", "bextracted", "brefs", "clean")


def _risks_with_models(graded: str) -> str:
    return ("SELECT doc_id, printf('risk-%03d', row_number() OVER (PARTITION BY doc_id ORDER BY source, para_idx, rule_no, rule_key) - 1) "
            "AS risk_id, section_id, risk_name, risk_level, risk_category, method, confidence FROM (SELECT 0 AS source, doc_id, para_idx, "
            "rule_no, section_id, rule_key, risk_name, risk_level, risk_category, 1.0::DOUBLE AS confidence, 'rule_based' AS method FROM brisks "
            "UNION ALL SELECT 1, g.doc_id, s.para_idx, 0, g.section_id, g.label, g.label, g.risk_level, g.risk_category, g.confidence, 'ml' "
            f"FROM {graded.replace('FROM secs', 'FROM bsecs')} g JOIN bsecs s USING (doc_id, section_id) WHERE s.word_count >= 10 AND NOT "
            "s.is_header AND NOT EXISTS (SELECT 1 FROM brisks r WHERE r.doc_id = g.doc_id AND r.section_id = g.section_id AND "
            "r.rule_key = g.label))")


def _saved_classifier() -> str:
    """Sums per label of the training rows give the model; the held-out rows are scored by it."""
    names = [f"n_{c}" for c in LETTERS] + ["n_blank"]
    counts = ", ".join(f"length(text) - length(replace(lower(text), '{c}', '')) AS n_{c}" for c in LETTERS)
    sums = ", ".join(f"sum({n}) AS s_{n}" for n in names)
    total = " + ".join(f"s_{n}" for n in names)
    score = " + ".join(f"v.{n} * (ln(m.s_{n} + 1) - ln({total.replace('s_', 'm.s_')} + {len(names)}))" for n in names)
    return (f"WITH r AS (SELECT doc_id, quality AS y, {counts}, length(text) - length(replace(text, ' ', '')) AS n_blank "
            "FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY "
            "md5(doc_id || ':42'), doc_id) <= ceil(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE) AS held FROM r), "
            f"m AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS kinds, {sums} FROM t WHERE NOT held GROUP BY y), "
            f"s AS (SELECT v.doc_id, m.y, m.total, ln(m.n + 1) - ln(m.total + m.kinds) + {score} AS score FROM t v, m WHERE v.held), "
            "b AS (SELECT doc_id, arg_max(y, score) AS y, max(score) AS best, max(total) AS total FROM s GROUP BY doc_id) "
            "SELECT b.doc_id, CASE b.y WHEN 0 THEN 'low' ELSE 'high' END AS label, round(1 / sum(exp(s.score - b.best)), 6) AS confidence, "
            "b.total::BIGINT AS training_rows FROM b JOIN s USING (doc_id) GROUP BY ALL")


HOOKED_SCORES = (
    "WITH w AS (SELECT doc_id, text[i * {s} + 1:i * {s} + {w}] AS t FROM (SELECT doc_id, text, "
    "unnest(range((greatest(length(text) - {o}, 1) - 1) // {s} + 1)) AS i FROM documents WHERE text IS NOT NULL)), "
    "c AS (SELECT doc_id, 0.5::DOUBLE * (length(t) - length(replace(t, 'e', ''))) - 0.25::DOUBLE * (length(t) - length(replace(t, ' ', ''))) - 8 "
    "AS x FROM w), d AS (SELECT doc_id, CASE WHEN x > 0 THEN 'dense' ELSE 'loose' END AS label, abs(x) / (1 + abs(x)) AS confidence FROM c) "
    "SELECT doc_id, label, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, label) AS n FROM d) "
    "WHERE n = 1").format(s=WINDOW - OVERLAP, w=WINDOW, o=OVERLAP)


ANSWERS_WITH_MODELS = (
    "SELECT e.doc_id, e.type_order, e.ext_type, CASE WHEN better THEN v ELSE value END AS value, CASE WHEN better THEN 'ml' ELSE method END "
    "AS method FROM (SELECT e.*, m.value AS v, coalesce(e.method = 'none' AND e.chars >= 20 AND m.value <> '' AND m.confidence >= 0.5, false) "
    f"AS better FROM bextracted e LEFT JOIN ({ANSWERS_SQL}) m USING (doc_id, ext_type)) e")


def _answers(provisions) -> str:
    """Long (doc_id, name, provision, answer) over the provisions the wide table has."""
    return " UNION ALL ".join(
        f"SELECT doc_id, {DOCUMENT_NAME_SQL} AS name, {q(p)} AS provision, {WIDE_COLUMNS[p]} AS answer FROM ({DUCK_BASE})"
        for p in provisions if p in WIDE_COLUMNS)


def _labelled(labels: dict[str, str]) -> str:
    return (f"SELECT {strip('answer')} AS text, label FROM ({_answers(labels)}) JOIN "
            f"{values('t', labels.items(), 'provision', 'label')} USING (provision) WHERE length({strip('answer')}) > 20")


def _qa(questions: dict[str, str]) -> str:
    return (f"SELECT {strip('name')} AS context, question, {strip('answer')} AS answer FROM ({_answers(questions)}) JOIN "
            f"{values('t', questions.items(), 'provision', 'question')} USING (provision) "
            f"WHERE length({strip('name')}) > 50 AND length({strip('answer')}) > 3")


def _risk_training() -> str:
    usable = f"(length({strip('answer')}) >= 10 OR lower({strip('answer')}) IN ('yes', 'no'))"
    have = [p for p in tr.RISK_LABELS if p in WIDE_COLUMNS]
    pairs = [(p, n) for p in have for n in [o for o in tr.RISK_LABELS if o != p][:2] if n in WIDE_COLUMNS]
    return f"""
    WITH a AS MATERIALIZED ({_answers(tr.RISK_LABELS)}),
    s AS (SELECT provision, answer, row_number() OVER (PARTITION BY provision ORDER BY md5(doc_id || ':42'), doc_id) AS n
          FROM a WHERE answer IS NOT NULL)
    SELECT {strip('answer')} AS text, label FROM a JOIN {values('t', tr.RISK_LABELS.items(), 'provision', 'label')} USING (provision)
    WHERE answer IS NOT NULL AND {usable}
    UNION ALL
    SELECT {strip('answer')}, 'no_risk' FROM {values('p', pairs, 'pos', 'neg')} JOIN s ON s.provision = p.neg
    WHERE n <= 10 AND {usable}"""


def _quality() -> str:
    labels = "[" + ", ".join(q(x) for x in SECTION_LABELS) + "]"
    return sql(f"""
    SELECT round((sum(hit) / sum(support))::DOUBLE, 9) AS accuracy, round(sum(p * support) / sum(support), 9) AS precision,
           round(sum(r * support) / sum(support), 9) AS recall,
           round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 9) AS f1,
           sum(support)::BIGINT AS n
    FROM (SELECT t, support, hit, coalesce(hit / g.guessed, 0)::DOUBLE AS p, (hit / support)::DOUBLE AS r
          FROM (SELECT t, count(*) AS support, count(*) FILTER (t = g) AS hit FROM pairs GROUP BY t) x
          LEFT JOIN (SELECT g AS gg, count(*) AS guessed FROM pairs GROUP BY g) g ON gg = t)""", "secs").replace(
        " SELECT round((sum(hit)", f", pairs AS (SELECT section_type AS t, ({labels})[(doc_id + para_idx) % 8 + 1] AS g FROM secs)"
        " SELECT round((sum(hit)", 1)


def _stats(select: str) -> str:
    return sql(select, "metrics")


def build() -> dict[str, str]:
    question_types = {p: tr.QUESTIONS_B[a] for p, a in tr.ANSWER_TYPES_B.items()}
    graded = (f"(SELECT doc_id, section_id, label, confidence, coalesce(category, {q(DEFAULT_RISK_CLASS[0])}) AS risk_category, "
              f"coalesce(severity, {q(DEFAULT_RISK_CLASS[1])}) AS risk_level FROM ({PREDICTIONS_SQL}) LEFT JOIN "
              f"{values('c', [(k, c, s) for k, (c, s) in RISK_CLASSES.items()], 'label', 'category', 'severity')} USING (label) "
              "WHERE confidence >= 0.6)")
    risk_cols = ("doc_id, risk_id, section_id, rule_key, pattern_idx, finding_id, risk_name, risk_level, risk_category, "
                 "matched_text, context")
    sec_cols = ("doc_id, para_idx, section_id, title, text, section_type, is_header, section_number, level, parent_id, "
                "start_char, end_char")
    running = "sum(length(text)) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING)"
    offsets = (f"CAST({running} - length(text) + 2 * para_idx AS BIGINT) AS start_char, CAST({running} + 2 * para_idx AS BIGINT) AS end_char")
    ref_offsets = (f"CAST(CASE WHEN para_idx > 0 THEN {running} - length(text) + 4 * para_idx - 2 ELSE 0 END AS BIGINT) "
                   f"AS ref_start_char, CAST({running} + 4 * para_idx AS BIGINT) AS ref_end_char")
    trim_right = "rtrim(text[1:{n}], (' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    out = {
        "clean_documents": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
        "strip_html": "SELECT page_id, coalesce(regexp_replace(html, '<[^>]+>', '', 'g'), '') AS text FROM pages",
        "truncate_text": "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE " + trim_right.format(n=100)
                         + " || '...' END AS short, CASE WHEN length(text) <= 40 THEN text ELSE " + trim_right.format(n=40)
                         + " END AS bare FROM documents",
        "hash_text": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
        "unique_ids": "SELECT doc_id, 'doc-' || sha256(text)[1:12] AS uid FROM documents",
        "paragraphs": sql("SELECT doc_id, para_idx, text FROM paras", "paras"),
        "sections_flat": sql(f"SELECT {sec_cols} FROM (SELECT *, CAST(NULL AS VARCHAR) AS parent_id, {offsets} FROM flat)", "flat"),
        "sections_hier": sql(
            f"SELECT {sec_cols}, ref_start_char, ref_end_char, coalesce(kids, '') AS children_ids "
            f"FROM (SELECT *, {offsets}, {ref_offsets} FROM tree) LEFT JOIN (SELECT doc_id AS d, parent_id AS p, "
            "string_agg(section_id, '|' ORDER BY para_idx) AS kids FROM tree GROUP BY ALL) ON d = doc_id AND p = section_id", "tree"),
        "section_tree": sql("SELECT level, is_header, count(*) AS n, count(parent_id) AS with_parent FROM tree GROUP BY ALL", "tree"),
        "section_types": sql("SELECT section_type, count(*) AS n, sum(word_count)::BIGINT AS words FROM secs GROUP BY ALL", "secs"),
        "section_offsets": sql(f"SELECT doc_id, para_idx, {offsets}, {ref_offsets} FROM secs", "secs"),
        "doc_metadata": sql("SELECT * FROM meta", "meta"),
        "document_sizes": "SELECT doc_id, round_even(strlen(clean) / 1024::DOUBLE, 2) AS file_size_kb, CAST(length(text) - "
                          f"length(replace(text, chr(12), '')) + 1 AS BIGINT) AS page_count, CAST({words('clean')} AS BIGINT) AS "
                          f"word_count, lang AS language FROM (SELECT *, {clean('text')} AS clean FROM documents)",
        "contract_type_counts": sql("SELECT contract_type, count(*) AS n, min(contract_type_confidence) AS lowest, "
                                    "max(contract_type_confidence) AS highest FROM meta GROUP BY ALL", "meta"),
        "dates_parties": sql("SELECT doc_id, dates, parties FROM meta", "meta"),
        "pii_detect": sql("SELECT doc_id, pii_type, value, '[REDACTED-' || pii_type || '-' || md5(value)[1:8] || ']' AS redaction "
                          "FROM pii", "pii"),
        "pii_documents": sql("SELECT doc_id, pii_type, value, '[REDACTED-' || pii_type || '-' || md5(value)[1:8] || ']' AS "
                             "redaction FROM docpii", "docpii"),
        "pii_redact": sql("SELECT doc_id, pii_types IS NOT NULL AS has_pii, body FROM body", "body"),
        "pii_redact_documents": sql("SELECT doc_id, pii_types IS NOT NULL AS has_pii, body FROM body", "body").replace(
            "SELECT doc_id, file_name, text, ", "SELECT doc_id, 'd' AS file_name, text, ", 1).replace(
            _contracts_cte(), "contracts AS MATERIALIZED (SELECT doc_id, text FROM documents)", 1),
        "pii_report": sql("SELECT pii_type, count(DISTINCT doc_id) AS documents, count(*) AS values FROM docpii GROUP BY ALL", "docpii"),
        "legal_entities": sql("SELECT doc_id, section_id, entity_type, value FROM entities", "entities"),
        "encrypt_roundtrip": "SELECT doc_id, text AS plain, true AS changed, '[DECRYPTION ERROR]' AS broken FROM documents",
        "risks": sql(f"SELECT {risk_cols} FROM risks", "risks"),
        "risk_advice": sql("SELECT rule_key, risk_name, count(*) AS n, risk_description, impact, suggested_changes FROM risks JOIN "
                           + values("a", [(r.key, r.explanation, r.impact, r.suggestion) for r in RISK_RULES], "rule_key",
                                    "risk_description", "impact", "suggested_changes")
                           + " USING (rule_key) GROUP BY ALL", "risks"),
        "risk_by_category": sql("SELECT doc_id, risk_category, count(*) AS n FROM risks GROUP BY ALL", "risks"),
        "risk_top5": sql("SELECT doc_id, rank::BIGINT AS rank, risk_name, risk_level, risk_category FROM (SELECT *, row_number() OVER "
                         "(PARTITION BY doc_id ORDER BY para_idx, rule_no) AS rank FROM risks) WHERE rank <= 5", "risks"),
        "risk_type_matrix": sql("SELECT contract_type, risk_category, count(*) AS n FROM risks JOIN meta USING (doc_id) GROUP BY ALL",
                                "risks", "meta"),
        "risk_union_predictions": sql(
            "SELECT doc_id, printf('risk-%03d', row_number() OVER (PARTITION BY doc_id ORDER BY source, para_idx, rule_no, rule_key) "
            "- 1) AS risk_id, section_id, rule_key, risk_name, risk_level, risk_category, matched_text, context, confidence, method "
            "FROM (SELECT 0 AS source, doc_id, para_idx, rule_no, section_id, rule_key, risk_name, risk_level, risk_category, "
            "matched_text, context, 1.0::DOUBLE AS confidence, 'rule_based' AS method FROM risks UNION ALL "
            "SELECT 1, g.doc_id, s.para_idx, 0, g.section_id, g.label, g.label, g.risk_level, g.risk_category, '', s.text[1:300] "
            f"|| '...', g.confidence, 'ml' FROM {graded} g JOIN secs s USING (doc_id, section_id) "
            "WHERE s.word_count >= 10 AND NOT s.is_header AND NOT EXISTS (SELECT 1 FROM risks r WHERE r.doc_id = g.doc_id AND "
            "r.section_id = g.section_id AND r.rule_key = g.label))", "risks", "secs"),
        "clauses": sql("SELECT doc_id, section_id, clause_key, clause_id, pattern_idx, clause_name, matched_text, context, importance, "
                       "is_boilerplate, risk_factors FROM clauses", "clauses"),
        "clause_risk_link": sql(
            "SELECT doc_id, section_id, clause_key, rule_key, finding_id FROM (SELECT doc_id, section_id, clause_key, "
            "unnest(string_split(risk_factors, ',')) AS rule_key FROM clauses WHERE risk_factors <> '') LEFT JOIN "
            "(SELECT doc_id, section_id, rule_key, finding_id FROM risks) USING (doc_id, section_id, rule_key)", "clauses", "risks"),
        "terms": sql("SELECT doc_id, section_id, category, term, matched_text, position::BIGINT AS position, context, importance "
                     "FROM terms", "terms"),
        "terms_in_order": sql("SELECT doc_id, section_id, category, string_agg(position || ':' || matched_text, '|' ORDER BY position, "
                              "term_order, word_order) AS hits FROM (SELECT * REPLACE (position::BIGINT AS position) FROM terms) "
                              "GROUP BY ALL", "terms"),
        "glossary": sql("SELECT category, term, count(*) AS n, plain_english, definition FROM terms JOIN " + values(
            "g", [(t.key, t.plain, t.definition) for t in LEGAL_TERMS], "term", "plain_english", "definition")
            + " USING (term) GROUP BY ALL", "terms"),
        "cross_references": sql("SELECT doc_id, section_id, ref_pos::BIGINT AS ref_pos, section_number, target_section_id FROM refs",
                                "refs"),
        "reference_lists": sql("SELECT doc_id, section_id, string_agg(target_section_id, '|' ORDER BY ref_pos) AS target_section_ids "
                               "FROM refs GROUP BY ALL", "refs"),
        "extract_info": sql("SELECT doc_id, ext_type, value, confidence, method FROM extracted", "extracted"),
        "extract_merge": sql(
            "SELECT e.doc_id, e.ext_type, CASE WHEN better THEN m.value ELSE e.value END AS value, CASE WHEN better THEN m.confidence "
            "ELSE e.confidence END AS confidence, CASE WHEN better THEN 'ml' ELSE e.method END AS method FROM (SELECT e.*, "
            "coalesce(e.method = 'none' AND e.chars >= 20 AND m.value <> '' AND m.confidence >= 0.5, false) AS better "
            f"FROM extracted e LEFT JOIN ({ANSWERS_SQL}) m USING (doc_id, ext_type)) e LEFT JOIN ({ANSWERS_SQL}) m "
            "USING (doc_id, ext_type)", "extracted", "clean"),
        "extract_questions": sql("SELECT doc_id, ext_type, question, length(clean) AS chars FROM clean, " + values(
            "t", [(t, EXTRACTION_QUESTIONS[t]) for t in ALL_EXTRACTION_TYPES], "ext_type", "question"), "clean"),
        "important_sections": sql("SELECT doc_id, section_id, section_type, word_count::BIGINT AS word_count, position FROM important",
                                  "important"),
        "section_summaries": sql("SELECT doc_id, section_id, title, position, summary FROM sums", "sums"),
        "overall_summaries": sql("SELECT doc_id, summary FROM overall", "overall"),
        "key_points": sql("SELECT doc_id, point_id, category, description, importance, context, extracted_value FROM points", "points"),
        "contract_basics": sql("SELECT doc_id, contract_type AS type, n AS sections_count, CASE WHEN length(body) < 5000 THEN 'short' "
                               "WHEN length(body) < 20000 THEN 'medium' ELSE 'long' END AS estimated_length FROM meta JOIN body "
                               "USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM bsecs GROUP BY 1) USING (doc_id)",
                               "meta", "body", "bsecs"),
        "response": sql(
            "SELECT m.doc_id, 'success' AS status, m.file_name, m.file_type, m.file_size_kb, m.page_count, m.word_count, "
            "m.contract_type, m.contract_type_confidence AS type_confidence, o.summary AS overall, coalesce(k.points, '') AS key_points, "
            "CASE WHEN length(b.body) < 5000 THEN 'short' WHEN length(b.body) < 20000 THEN 'medium' ELSE 'long' END AS "
            "estimated_length, x.risks_count, coalesce(r.cats, '') AS risks_by_category, x.sections_count, x.has_pii, "
            "coalesce(array_to_string(list_transform(string_split(b.pii_types, ','), lambda t: split_part(t, ':', 2)), ','), '') AS "
            "pii_types FROM meta m JOIN body b USING (doc_id) JOIN overall o USING (doc_id) JOIN metrics x USING (doc_id) LEFT JOIN "
            "(SELECT doc_id, string_agg(description, '|' ORDER BY point_id) AS points FROM bpoints WHERE point_id <= 'point-002' "
            "GROUP BY 1) k USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(c, '|' ORDER BY c) AS cats FROM (SELECT doc_id, "
            "risk_category || '=' || count(*) AS c FROM brisks GROUP BY doc_id, risk_category) GROUP BY 1) r USING (doc_id)",
            "meta", "body", "overall", "metrics", "bpoints", "brisks"),
        "digest": sql(
            "SELECT x.doc_id, x.contract_type, x.risks_count, x.sections_count, coalesce(k, '') AS key_risks FROM metrics x LEFT JOIN "
            "(SELECT doc_id, string_agg(risk_name || '/' || risk_level || '/' || risk_category, '|' ORDER BY risk_id) AS k FROM brisks "
            "WHERE risk_id <= 'risk-004' GROUP BY 1) USING (doc_id)", "metrics", "brisks"),
        "results_json": _results("SELECT *, 'rule_based' AS method, 1.0 AS confidence FROM brisks", "bextracted"),
        "results_json_models": _results(_risks_with_models(graded), ANSWERS_WITH_MODELS),
        "training_risk": _risk_training(),
        "training_section": _labelled(tr.SECTION_LABELS),
        "training_qa": _qa(tr.QUESTIONS),
        "training_risk_b": _labelled(tr.RISK_LABELS_B),
        "training_section_b": _labelled(tr.SECTION_LABELS_B),
        "training_qa_b": _qa(question_types),
        "training_counts": f"SELECT label, count(*) AS examples FROM ({_risk_training()}) GROUP BY ALL",
        "qa_manifest": "SELECT count(*) AS sample_count, string_agg(DISTINCT w, ',' ORDER BY w) AS extraction_types FROM "
                       f"(SELECT split_part(question, ' ', 4) AS w FROM ({_qa(question_types)}))",
        "label_encoding": sql(
            "SELECT label, idx AS label_idx, count(*) AS n, CASE WHEN idx < 4 THEN label0 ELSE 'unknown_' || idx END AS name FROM "
            "(SELECT section_type AS label, coalesce(i, 0)::BIGINT AS idx, coalesce(l.name, 'covenant') AS label0 FROM secs LEFT JOIN "
            + values("l", [(n, i) for i, n in enumerate(SECTION_LABELS)], "name", "i") + " ON l.name = section_type) GROUP BY ALL",
            "secs"),
        "train_split": "SELECT doc_id, quality::BIGINT AS quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), "
                       "doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE) AS is_validation FROM labels",
        "prediction_quality": _quality(),
        "graded_predictions": sql(f"SELECT label, risk_category, risk_level, count(*) AS n FROM {graded} GROUP BY ALL", "secs"),
        "metric_rows": _stats("SELECT * FROM metrics"),
        "eval_stats": _stats("SELECT count(*) AS total_contracts, count(*) AS successful_contracts, 0.0::DOUBLE AS error_rate, "
                             "round(avg(risks_count), 9) AS avg_risks, round(avg(sections_count), 9) AS avg_sections FROM metrics"),
        "type_distribution": _stats("SELECT contract_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9)::DOUBLE AS share "
                                    "FROM metrics GROUP BY contract_type"),
        "risk_mean_by_type": _stats("SELECT contract_type, round(avg(risks_count), 9) AS avg_risks, count(*) AS n FROM metrics "
                                    "GROUP BY ALL"),
        "measure_histogram": "SELECT bin + 1 AS bin, count(*) AS n, round(min(lo + bin * w), 6) AS bin_start FROM (SELECT lo, w, "
                             "least(floor((value - lo) / w), 19)::BIGINT AS bin FROM events, (SELECT min(value) AS lo, "
                             "(max(value) - min(value)) / 20 AS w FROM events)) GROUP BY bin",
        "evaluation_details": _stats("SELECT filename, contract_type, risks_count, sections_count FROM metrics"),
        "error_documents": "SELECT CASE WHEN text <> '' THEN 'success' ELSE 'error' END AS status, count(*) AS n, "
                           "sum(CASE WHEN text <> '' THEN 0 ELSE 1 END)::BIGINT AS errors FROM documents "
                           "FULL JOIN (SELECT c_custkey AS doc_id FROM customer) USING (doc_id) GROUP BY 1",
        "custom_rules": _custom_rules(),
        "analyze_with_predictions": _analyze_with_predictions(graded),
        "stream_analyze": sql("SELECT m.doc_id, m.status, t.word_count, m.has_pii, m.sections_count, m.risks_count FROM metrics m "
                              "JOIN meta t USING (doc_id)", "metrics",
                              contracts="SELECT doc_id, 'document.txt' AS file_name, text FROM documents"),
        "ingest_files": "SELECT status, errors, count(*) AS n, sum(chars)::BIGINT AS chars FROM (SELECT 'error' AS status, "
                        f"{q(NO_INPUT)} AS errors, 0 AS chars UNION ALL SELECT CASE WHEN doc_id % 10 = 0 THEN 'unsupported' WHEN large "
                        "THEN 'error' ELSE 'success' END, CASE WHEN doc_id % 10 = 0 THEN 'No plain text in a file of type pdf' WHEN large "
                        f"THEN 'File exceeds maximum size of {INGEST_MB}MB' ELSE '' END, CASE WHEN doc_id % 10 = 0 OR large THEN 0 ELSE "
                        f"length(text) + 1 END FROM (SELECT *, strlen(text) + 1 > {int(INGEST_MB * 1024 * 1024)} AS large FROM documents "
                        "WHERE text IS NOT NULL)) GROUP BY ALL",
        "scored_labels":
            "SELECT doc_id, label_idx, TRUE AS known_label, TRUE AS likelier_class FROM (SELECT doc_id, quality::INT AS label_idx, "
            "row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) "
            "* 0.2::DOUBLE) AS held FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) WHERE held",
        "saved_classifier": _saved_classifier(),
        "hooked_scores": HOOKED_SCORES,
        "metrics_json": sql(
            "SELECT *, NULL::VARCHAR AS corrupt_record FROM metrics UNION ALL BY NAME "
            "SELECT 'no record of ' || doc_id AS corrupt_record FROM documents WHERE doc_id % 50 = 0", "metrics",
            contracts="SELECT doc_id, 'document.txt' AS file_name, text FROM documents"),
        "stream_redelivery": sql(
            "SELECT m.doc_id, CASE WHEN m.doc_id % 3 = 2 THEN 2 ELSE 1 END::BIGINT AS delivery, m.status, t.word_count, m.sections_count, "
            "m.risks_count FROM metrics m JOIN meta t USING (doc_id)", "metrics",
            contracts="SELECT doc_id, 'document.txt' AS file_name, text FROM documents"),
        "format_ts": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'not a time ' || event_id ELSE strftime(ts, "
                     "'%d/%m/%Y %H:%M') END AS shown FROM events",
        "merge_maps": "SELECT event_id, 'props=' || props || ';type=' || event_type || ';user=hidden' AS merged FROM events",
    }
    return {**out, "result_store": out["digest"], "result_lookup": f"SELECT * FROM ({out['digest']}) WHERE doc_id = 7", "clause_csv_training": out["training_section"]}


def _contracts_cte() -> str:
    from clauselake.plans.corpus import duck_contracts
    return f"contracts AS MATERIALIZED ({duck_contracts()})"
