"""Registered queries: every operator over the given tables, whole tables and whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake.functions import metadata as meta_fn
from clauselake.functions import privacy as pv
from clauselake.functions import text as tx
from clauselake.operators import detect, evaluate, extract, learn, privacy, segment, summary, training, xref
from clauselake.operators.metadata import METADATA_COLUMNS, contract_types, with_metadata
from clauselake.plans import pipeline
from clauselake.plans.corpus import base, clause_sql, contracts
from clauselake.rules.custom import rules_from_dataframe
from clauselake.rules.vocab import RISK_CLASSES, SECTION_LABELS
from clauselake.sources import sinks
from clauselake.sources.clause_csv import read_clause_csv
from clauselake.sources.files import from_text_table, read_dir
from clauselake.sources.store import Store
from clauselake.sources.tables import read, spread_scan
from clauselake.session import shared_root
from clauselake.streaming import drops


# --- inputs ---------------------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread_scan(read(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")


def cleaned(docs: DataFrame, shared: bool = False) -> DataFrame:
    return docs.withColumn("clean", tx.clean_text(F.col("text"), shared))


def cleaned_contracts(spark: SparkSession, sf: str, shared: bool = False) -> DataFrame:
    return cleaned(contracts(spark, sf), shared)


def contract_sections(spark: SparkSession, sf: str, hierarchical: bool = True) -> DataFrame:
    docs = cleaned_contracts(spark, sf).select("doc_id", F.col("clean").alias("text"))
    return segment.sections(docs, hierarchical)


def full_segments(spark: SparkSession, sf: str, hierarchical: bool = True) -> DataFrame:
    docs = cleaned_contracts(spark, sf).select("doc_id", F.col("clean").alias("text"))
    return segment.segment(docs, hierarchical)


def flat(rows: DataFrame) -> DataFrame:
    """Scalars only: integers as bigint, arrays as text, so that results compare across engines."""
    cols = []
    for f in rows.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return rows.select(*cols)


def predictions(sections: DataFrame) -> DataFrame:
    """A stand-in prediction table computed from the section keys."""
    labels = F.array(*[F.lit(x) for x in [*RISK_CLASSES, "novel_risk"]])
    return sections.select(
        "doc_id", "section_id",
        F.element_at(labels, ((F.col("doc_id") + 7 * F.col("para_idx")) % 18 + 1).cast("int")).alias("label"),
        (((31 * F.col("doc_id") + 17 * F.col("para_idx")) % 100) / F.lit(100.0)).alias("confidence"))


PREDICTIONS_SQL = (
    "SELECT doc_id, section_id, ([" + ", ".join(f"'{x}'" for x in [*RISK_CLASSES, "novel_risk"])
    + "])[(doc_id + 7 * para_idx) % 18 + 1] AS label, ((31 * doc_id + 17 * para_idx) % 100)::DOUBLE / 100 AS confidence FROM secs")


def model_answers(docs: DataFrame) -> DataFrame:
    """A stand-in answer table: every document, every asked type, confidence from the key."""
    rows = docs.select("doc_id", F.posexplode(F.array(*[F.lit(t) for t in extract.EXTRACTION_TYPES])).alias("n", "ext_type"))
    value = F.when((F.col("doc_id") + F.col("n")) % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit("answer "), F.col("doc_id").cast("string")))
    return rows.select("doc_id", "ext_type", value.alias("value"),
                       (((13 * F.col("doc_id") + 29 * F.col("n")) % 100) / F.lit(100.0)).alias("confidence"))


ANSWERS_SQL = (
    "SELECT doc_id, ext_type, CASE WHEN (doc_id + n) % 4 = 0 THEN '' ELSE 'answer ' || doc_id END AS value, "
    "((13 * doc_id + 29 * n) % 100)::DOUBLE / 100 AS confidence FROM clean, (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(extract.EXTRACTION_TYPES)) + ") t(n, ext_type)")


# Provision column -> the clause wording of the generated agreements that answers it.
PROVISIONS = {
    "Auto-Renewal": "renewal", "Termination For Convenience": "exit", "Liquidated Damages": "liability",
    "Most Favored Nation": "fees", "Anti-Assignment": "law", "Uncapped Liability": "liability",
    "Governing Law": "law", "Renewal Term": "renewal", "Payment Terms": "fees", "Confidentiality": "secrecy",
    "Indemnification": "liability", "License Grant": "scope", "Minimum Commitment": "fees", "Parties": "preamble",
    "Effective Date": "preamble", "Notice Period To Terminate Renewal": "change",
}
SHORT_ANSWER_SQL = {"Non-Compete": "CASE kn % 3 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'none' END", "Agreement Date": "ds"}
WIDE_COLUMNS = {**{p: clause_sql(c) for p, c in PROVISIONS.items()}, **SHORT_ANSWER_SQL}
DOCUMENT_NAME_SQL = clause_sql("preamble")


def wide_answers(spark: SparkSession, sf: str) -> DataFrame:
    columns = [f"{sql} AS `{p}-Answer`" for p, sql in WIDE_COLUMNS.items()]
    return base(spark, sf).selectExpr("doc_id", f"{DOCUMENT_NAME_SQL} AS `Document Name`", *columns)


INGEST_MB = 0.02
# Fixed value: documents whose ids share a folder, so that folders stay small however many documents there are.
IDS_PER_BOX = 10_000


def file_drop(spark: SparkSession, sf: str) -> str:
    """A folder with a file for every document, nested and partly of a type without text, and an empty one."""
    root = scratch(spark, "drop")
    docs = spread_scan(read(spark, sf, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    shelf, line = F.pmod("doc_id", F.lit(10)), F.lit("\n")
    scan = shelf == 0
    box = F.concat(F.lit("/shelf="), shelf, F.lit("/box="), F.floor(F.col("doc_id") / IDS_PER_BOX), F.lit("/"), "doc_id")
    sinks.write_files(docs.select(
        F.concat(F.when(scan, "scans").otherwise("texts"), box, F.when(scan, ".pdf").otherwise(".txt")).alias("name"),
        F.concat(F.when(scan, F.col("doc_id").cast("string")).otherwise(F.col("text")), line).alias("text")), root)
    docs.select("text").where("false").write.text(f"{root}/empty")
    return root


def ingest_files(spark, sf):
    """The files of a folder by status and message; texts are as long as they were, oversized ones are not read."""
    rows = read_dir(spark, file_drop(spark, sf), INGEST_MB)
    return rows.groupBy("status", F.array_join("errors", "|").alias("errors")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))


def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have labels, with their quality label."""
    docs = spread_scan(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label_idx"))
    return docs.join(labels, "doc_id")


# --- queries --------------------------------------------------------------------------------------


def clean_documents(spark, sf):
    return documents(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


def strip_html(spark, sf):
    pages = spread_scan(read(spark, sf, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", tx.strip_tags(F.col("html")).alias("text"))


def truncate_text(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("doc_id", tx.truncate(t, 100).alias("short"),
                                       tx.truncate(t, 40, add_ellipsis=False).alias("bare"))


def hash_text(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("doc_id", tx.hash_text(t, "md5").alias("md5"), tx.hash_text(t, "sha1").alias("sha1"),
                                       tx.hash_text(t).alias("sha256"))


def unique_ids(spark, sf):
    return documents(spark, sf).select("doc_id", tx.unique_id(F.col("text"), "doc", 12).alias("uid"))


def paragraphs(spark, sf):
    return flat(segment.paragraphs(cleaned_contracts(spark, sf).drop("text").withColumnRenamed("clean", "text")))


def sections_flat(spark, sf):
    return flat(full_segments(spark, sf, False).select(
        "doc_id", "para_idx", "section_id", "title", "text", "section_type", "is_header", "section_number", "level",
        "parent_id", "start_char", "end_char"))


def sections_hier(spark, sf):
    return flat(full_segments(spark, sf).select(
        "doc_id", "para_idx", "section_id", "title", "text", "section_type", "is_header", "section_number", "level",
        "parent_id", "start_char", "end_char", "ref_start_char", "ref_end_char", "children_ids"))


def section_tree(spark, sf):
    rows = full_segments(spark, sf)
    return (rows.groupBy("level", "is_header")
            .agg(F.count("*").alias("n"), F.count("parent_id").alias("with_parent")).transform(flat))


def section_types(spark, sf):
    return contract_sections(spark, sf).groupBy("section_type").agg(F.count("*").alias("n"),
                                                                    F.sum("word_count").alias("words"))


def section_offsets(spark, sf):
    rows = full_segments(spark, sf)
    return flat(rows.select("doc_id", "para_idx", "start_char", "end_char", "ref_start_char", "ref_end_char"))


def doc_metadata(spark, sf):
    return flat(with_metadata(cleaned_contracts(spark, sf, shared=True)).select("doc_id", *METADATA_COLUMNS))


def document_sizes(spark, sf):
    c = F.col("clean")
    return flat(cleaned(documents(spark, sf)).select(
        "doc_id", meta_fn.size_kb(c).alias("file_size_kb"), meta_fn.page_count(F.col("text")).alias("page_count"),
        tx.word_count(c).alias("word_count"), F.col("lang").alias("language")))


def contract_type_counts(spark, sf):
    return (contract_types(cleaned_contracts(spark, sf)).groupBy("contract_type")
            .agg(F.count("*").alias("n"), F.min("contract_type_confidence").alias("lowest"),
                 F.max("contract_type_confidence").alias("highest")))


def dates_parties(spark, sf):
    c = F.col("clean")
    return flat(cleaned_contracts(spark, sf).select("doc_id", meta_fn.all_dates(c).alias("dates"),
                                                    meta_fn.all_parties(c).alias("parties")))


def pii_detect(spark, sf):
    return privacy.pii_table(cleaned_contracts(spark, sf))


def pii_documents(spark, sf):
    return privacy.pii_table(cleaned(documents(spark, sf)))


def pii_redact(spark, sf):
    return privacy.with_pii(cleaned_contracts(spark, sf)).select("doc_id", "has_pii", "body")


def pii_redact_documents(spark, sf):
    return privacy.with_pii(cleaned(documents(spark, sf))).select("doc_id", "has_pii", "body")


def pii_report(spark, sf):
    return privacy.pii_report(cleaned(documents(spark, sf)))


def legal_entities(spark, sf):
    return privacy.entity_table(contract_sections(spark, sf))


def encrypt_roundtrip(spark, sf):
    key = F.lit("0123456789abcdef").cast("binary")
    docs = documents(spark, sf).select("doc_id", "text", pv.encrypt(F.col("text"), key).alias("cipher"))
    return docs.select("doc_id", pv.decrypt(F.col("cipher"), key).alias("plain"),
                       (F.col("cipher") != F.col("text")).alias("changed"),
                       pv.decrypt(F.lit("AAAA"), key).alias("broken"))


RISK_COLUMNS = ("doc_id", "risk_id", "section_id", "rule_key", "pattern_idx", "finding_id", "risk_name", "risk_level",
                "risk_category", "matched_text", "context")


def risk_rows(spark, sf):
    return detect.detect_risks(contract_sections(spark, sf))


def risks(spark, sf):
    return flat(detect.number_risks(risk_rows(spark, sf)).select(*RISK_COLUMNS))


def risk_advice(spark, sf):
    """Findings per rule with the advice shown next to them."""
    return detect.with_risk_advice(risk_rows(spark, sf).groupBy("rule_key", "risk_name").agg(F.count("*").alias("n")))


def risk_by_category(spark, sf):
    return detect.count_by_category(risk_rows(spark, sf))


def risk_top5(spark, sf):
    return flat(detect.top_risks(risk_rows(spark, sf)).select("doc_id", "rank", "risk_name", "risk_level", "risk_category"))


def risk_type_matrix(spark, sf):
    """Flagship: how often each risk category occurs in each type of agreement.

    Types and findings are worked out inside the document row, so the only
    exchange carries one partial count per type and category and task.
    """
    docs = cleaned_contracts(spark, sf, shared=True).withColumnRenamed("text", "raw").withColumnRenamed("clean", "text")
    docs = (docs.select("doc_id", "text", F.lower("text").alias("low"), meta_fn.type_scores(F.col("text")).alias("scores"))
            .select("doc_id", "text", meta_fn.top_type(F.col("low"), F.col("scores")).alias("top"))
            .select("doc_id", "text", meta_fn.contract_type(F.col("top")).alias("contract_type")))
    rows = segment.sections(docs, keep=("contract_type",))
    found = detect.find(detect.eligible_for_risk(rows), detect.RISK_RULES, ["doc_id", "contract_type"])
    category = F.element_at(F.array(*[F.lit(r.category) for r in detect.RISK_RULES]), F.col("rule_no") + 1)
    return found.groupBy("contract_type", category.alias("risk_category")).agg(F.count("*").alias("n"))


def risk_union_predictions(spark, sf):
    rows = contract_sections(spark, sf)
    both = detect.union_model_risks(detect.detect_risks(rows), rows, predictions(rows))
    return both.select("doc_id", "risk_id", "section_id", "rule_key", "risk_name", "risk_level", "risk_category",
                       "matched_text", "context", "confidence", "method")


OWN_RULES = (
    ("price_named", "Named price", "financial", "medium", ["price of .{1,40} dollars", "invoice"], [], []),
    ("meeting_duty", "Duty to meet", "operational", "low", ["will meet"], ["never meet"], ["meetings", "record"]),
)


def own_rules(spark):
    """Two rules of one's own, as a table."""
    rows = spark.createDataFrame(OWN_RULES, "key string, name string, category string, severity string, patterns array<string>, "
                                            "exceptions array<string>, context array<string>")
    return rules_from_dataframe(rows.selectExpr("*", "'' AS impact", "'' AS explanation", "'' AS suggestion"))


def custom_rules(spark, sf):
    """Responses by rules of one's own."""
    r = pipeline.response(contracts(spark, sf), rules=own_rules(spark))
    return flat(r.select("doc_id", "risks_count", F.array_join(F.array_sort(F.transform(
        F.map_entries("risks_by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), "|").alias("categories")))


def analyze_with_predictions(spark, sf):
    """Counts of the responses and metrics of one analysis with model findings, next to its risk rows."""
    docs = contracts(spark, sf)
    staging = scratch(spark, "analysis")
    bodies = pipeline.stage(pipeline.prepare(docs), staging)
    guesses = predictions(pipeline.section_rows(bodies))
    tables = pipeline.analyze(docs, predictions=guesses, prepared=bodies, staging=staging)
    found = tables["risks"].groupBy("doc_id").agg(F.count("*").alias("risk_rows"))
    responses = tables["responses"].select("doc_id", "risks_count")
    measured = tables["metrics"].select("doc_id", F.col("risks_count").alias("measured_risks"), "unique_risk_categories")
    return (responses.join(measured, "doc_id").join(found, "doc_id", "left")
            .select("doc_id", F.col("risks_count").cast("bigint").alias("risks_count"), "measured_risks", "unique_risk_categories",
                    F.coalesce("risk_rows", F.lit(0)).cast("bigint").alias("risk_rows")))


def clause_rows(spark, sf):
    return detect.detect_clauses(contract_sections(spark, sf))


def clauses(spark, sf):
    return flat(clause_rows(spark, sf).select("doc_id", "section_id", "clause_key", "clause_id", "pattern_idx", "clause_name",
                                              "matched_text", "context", "importance", "is_boilerplate",
                                              F.array_join("risk_factors", ",").alias("risk_factors")))


def clause_risk_link(spark, sf):
    return detect.clause_risks(contract_sections(spark, sf))


def term_rows(spark, sf):
    return detect.detect_terms(contract_sections(spark, sf), ["doc_id", "section_id"])


def terms(spark, sf):
    return flat(term_rows(spark, sf).select("doc_id", "section_id", "category", "term", "matched_text", "position", "context",
                                            "importance"))


def terms_in_order(spark, sf):
    rows = detect.terms_by_category(term_rows(spark, sf), ["doc_id", "section_id"])
    return rows.select("doc_id", "section_id", "category", F.array_join(F.transform("hits", lambda h: F.concat(
        h["position"].cast("string"), F.lit(":"), h["matched_text"])), "|").alias("hits"))


def glossary(spark, sf):
    rows = detect.with_glossary(term_rows(spark, sf).groupBy("category", "term").agg(F.count("*").alias("n")))
    return rows.select("category", "term", "n", "plain_english", "definition")


def cross_references(spark, sf):
    return flat(xref.cross_references(contract_sections(spark, sf)))


def reference_lists(spark, sf):
    return flat(xref.reference_lists(xref.cross_references(contract_sections(spark, sf))))


def extract_info(spark, sf):
    return extract.extract(cleaned_contracts(spark, sf), "clean").select("doc_id", "ext_type", "value", "confidence", "method")


def extract_merge(spark, sf):
    docs = cleaned_contracts(spark, sf)
    merged = extract.merge_answers(extract.extract(docs, "clean"), model_answers(docs))
    return merged.select("doc_id", "ext_type", "value", "confidence", "method")


def extract_questions(spark, sf):
    rows = extract.questions(cleaned_contracts(spark, sf), "clean")
    return rows.select("doc_id", "ext_type", "question", F.length("text").cast("bigint").alias("chars"))


def important_sections(spark, sf):
    rows = summary.important_sections(cleaned_contracts(spark, sf), text="clean")
    return flat(rows.select("doc_id", "section_id", "section_type", "word_count", "position"))


def section_summaries(spark, sf):
    return flat(summary.section_summaries(summary.important_sections(cleaned_contracts(spark, sf), text="clean")))


def overall_summaries(spark, sf):
    return pipeline.analysis_rows(contracts(spark, sf)).select("doc_id", "summary")


def key_points(spark, sf):
    return pipeline.key_point_rows(cleaned_contracts(spark, sf), "clean")


def contract_basics(spark, sf):
    a = pipeline.analysis_rows(contracts(spark, sf))
    return a.select("doc_id", F.col("contract_type").alias("type"), F.col("sections_count").cast("bigint").alias("sections_count"),
                    summary.length_class(F.col("body")).alias("estimated_length"))


def response(spark, sf):
    r = pipeline.response(contracts(spark, sf))
    pairs = F.array_sort(F.transform(F.map_entries("risks_by_category"),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return flat(r.select(
        "doc_id", "status", "metadata.file_name", "metadata.file_type", "metadata.file_size_kb", "metadata.page_count",
        "metadata.word_count", "metadata.contract_type", "metadata.type_confidence",
        F.col("summary.overall").alias("overall"),
        F.array_join(F.transform("summary.key_points", lambda k: k["description"]), "|").alias("key_points"),
        F.col("summary.basics.estimated_length").alias("estimated_length"), "risks_count",
        F.array_join(pairs, "|").alias("risks_by_category"), "sections_count", "has_pii",
        F.array_join("pii_types", ",").alias("pii_types")))


def digest(spark, sf):
    d = pipeline.digest(contracts(spark, sf))
    return flat(d.select("doc_id", "contract_type", "risks_count", "sections_count", F.array_join(F.transform(
        "key_risks", lambda r: F.concat_ws("/", r["name"], r["level"], r["category"])), "|").alias("key_risks")))


RESULT_SCHEMA = (
    "doc_id bigint, status string, summary struct<overall: string>, risks_count bigint, sections_count bigint, "
    "sections array<struct<section_id: string, section_type: string, level: int, is_header: boolean, parent_id: string, "
    "children_ids: array<string>, text: string>>, risks array<struct<risk_id: string, section_id: string, risk_name: string, "
    "risk_level: string, risk_category: string, confidence: double, method: string>>, extracted_data array<struct<ext_type: string, "
    "value: string, method: string>>, cross_references array<struct<section_id: string, target_section_ids: array<string>>>")


def flat_results(rows: DataFrame) -> DataFrame:
    """JSON documents written, read back and told in one line for each nested part."""
    def listed(column, *fields):
        def told(x):
            return F.concat_ws(":", *[F.coalesce(f(x).cast("string"), F.lit("")) for f in fields])

        return F.array_join(F.transform(column, told), "|").alias(column)

    def field(name):
        return lambda x: x[name]

    def joined(name):
        return lambda x: F.array_join(x[name], ",")

    folder = scratch(rows.sparkSession, "results")
    sinks.write_results(rows, folder)
    return sinks.read_json(rows.sparkSession, folder, RESULT_SCHEMA).where("corrupt_record is null").select(
        "doc_id", "status", F.col("summary.overall").alias("overall"), "risks_count", "sections_count",
        listed("sections", *map(field, ("section_id", "section_type", "level", "is_header", "parent_id")), joined("children_ids"),
               lambda x: F.char_length(x["text"])),
        listed("risks", *map(field, ("risk_id", "section_id", "risk_name", "risk_level", "risk_category", "method")),
               lambda x: F.round(x["confidence"] * 100).cast("int")),
        listed("extracted_data", *map(field, ("ext_type", "value", "method"))),
        listed("cross_references", field("section_id"), joined("target_section_ids")))


def results_json(spark, sf):
    """Every agreement's full result as one JSON document, read back."""
    return flat_results(sinks.results_json(pipeline.detailed_response(contracts(spark, sf))))


def results_json_models(spark, sf):
    """The same with a model's findings and answers in it."""
    docs = contracts(spark, sf)
    bodies = pipeline.stage(pipeline.prepare(docs), scratch(spark, "bodies"))
    guesses = predictions(pipeline.section_rows(bodies))
    return flat_results(sinks.results_json(pipeline.detailed_response(docs, predictions=guesses, model_answers=model_answers(docs))))


def metrics_json(spark, sf):
    """Metrics of the documents written as JSON lines and read back by a stated schema, next to lines that are none."""
    folder = scratch(spark, "metrics")
    rows = pipeline.metrics(from_text_table(documents(spark, sf), "doc_id", "text"))
    sinks.write_json(rows, folder)
    other = read(spark, sf, "documents").where("doc_id % 50 = 0").select(F.concat(F.lit("no record of "), F.col("doc_id").cast("string")))
    other.write.mode("append").text(folder)
    return sinks.read_json(spark, folder, ", ".join(f"{n} {t}" for n, t in rows.dtypes))


def training_risk(spark, sf):
    return training.risk_training(wide_answers(spark, sf), "doc_id")


def training_section(spark, sf):
    return training.section_training(wide_answers(spark, sf), "doc_id")


def training_qa(spark, sf):
    return training.qa_training(wide_answers(spark, sf))


def training_risk_b(spark, sf):
    return training.risk_training_b(wide_answers(spark, sf), "doc_id")


def training_section_b(spark, sf):
    return training.section_training_b(wide_answers(spark, sf), "doc_id")


def training_qa_b(spark, sf):
    return training.qa_training_b(wide_answers(spark, sf))


def training_counts(spark, sf):
    return training.label_counts(training_risk(spark, sf))


def qa_manifest(spark, sf):
    return training.qa_manifest(training_qa_b(spark, sf))


def clause_csv_training(spark, sf):
    """The wide table written as CSV, read back as a clause-answer source and turned into a training set."""
    folder = scratch(spark, "clauses")
    sinks.write_training(wide_answers(spark, sf), folder)
    return training.section_training(read_clause_csv(spark, folder), "doc_id")


def label_encoding(spark, sf):
    rows = contract_sections(spark, sf).select(F.col("section_type").alias("label"))
    coded = learn.encode_labels(rows, list(SECTION_LABELS)).groupBy("label", "label_idx").agg(F.count("*").alias("n"))
    return flat(coded.withColumn("name", learn.label_name(F.col("label_idx"), list(SECTION_LABELS[:4]))))


def train_split(spark, sf):
    labels = read(spark, sf, "labels").select("doc_id", "quality")
    return learn.split_rows(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("bigint").alias("quality"),
                                                                "is_validation")


def train_eval_classifier(spark, sf):
    rows = learn.split_rows(text_rows(spark, sf), "doc_id", "label_idx")
    model = learn.train(rows, max_iter=5)
    scored = learn.score(model, rows.where("is_validation"), ["low", "high"], ["doc_id", "label_idx"])
    return learn.quality(scored)


def scored_labels(spark, sf):
    """The text classifier trained and applied to the held-out rows: which rows they are, and that every one has a known
    label and the confidence of the likelier of two classes."""
    rows = learn.split_rows(text_rows(spark, sf).where("text is not null"), "doc_id", "label_idx")
    labels = ["low", "high"]
    scored = learn.score(learn.train(rows, max_iter=5), rows.where("is_validation"), labels, ["doc_id", "label_idx"])
    return scored.select("doc_id", "label_idx", F.col("label").isin(labels).alias("known_label"),
                         F.col("confidence").between(0.5, 1.0).alias("likelier_class"))


LETTERS = "aeiou"


def letter_counts(spark, sf):
    """Documents with a quality label and how often they hold each vowel and a blank."""
    text = F.lower("text")
    counts = {f"n_{c}": F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS}
    blanks = F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label_idx"))
    return documents(spark, sf).where("text is not null").join(labels, "doc_id").select(
        "doc_id", "label_idx", *[c.alias(n) for n, c in counts.items()], blanks.alias("n_blank"))


def saved_classifier(spark, sf):
    """A model of counts trained, saved, loaded and applied to the rows that were held out."""
    folder = scratch(spark, "model")
    rows = learn.split_rows(letter_counts(spark, sf), "doc_id", "label_idx")
    names = [f"n_{c}" for c in LETTERS] + ["n_blank"]
    model = learn.train(rows, pipeline=learn.count_classifier(names))
    learn.save_model(model, folder, ["low", "high"], "quality", rows.where("not is_validation").count())
    loaded, told = learn.load_model(folder)
    scored = learn.score(loaded, rows.where("is_validation"), ["low", "high"], ["doc_id"])
    return scored.crossJoin(F.broadcast(told.select("training_rows"))).select(  # the one row that describes the model
        "doc_id", "label", F.round("confidence", 6).alias("confidence"), "training_rows")


WINDOW, OVERLAP = 1000, 100


def linear_model():
    """A stand-in for a model of one's own: a line over two counts, in numpy."""
    import numpy as np

    def predict(texts):
        x = np.array([[t.count("e"), t.count(" ")] for t in texts], np.float64)
        score = x @ np.array([0.5, -0.25]) - 8
        return {"label": np.where(score > 0, "dense", "loose"), "confidence": np.abs(score) / (1 + np.abs(score))}
    return predict


def hooked_scores(spark, sf):
    """Whole documents scored by a model that reads a thousand characters at a time."""
    model = learn.external_model(linear_model, batch_size=64)
    rows = documents(spark, sf).where("text is not null")
    return learn.score_windows(rows, model, ["doc_id"], width=WINDOW, overlap=OVERLAP)


def prediction_quality(spark, sf):
    """Grading of the stand-in predictions against the section types, as a confusion table."""
    rows = contract_sections(spark, sf)
    pairs = rows.select(F.col("section_type").alias("label_idx"), F.element_at(
        F.array(*[F.lit(x) for x in SECTION_LABELS]), ((F.col("doc_id") + F.col("para_idx")) % 8 + 1).cast("int"))
        .alias("prediction"))
    q = learn.quality(pairs)
    return q.select(F.round("accuracy", 9).alias("accuracy"), F.round("precision", 9).alias("precision"),
                    F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"), "n")


def graded_predictions(spark, sf):
    rows = detect.model_risks(predictions(contract_sections(spark, sf)))
    return rows.groupBy("label", "risk_category", "risk_level").agg(F.count("*").alias("n"))


def metric_rows(spark, sf):
    return pipeline.metrics(contracts(spark, sf))


def eval_stats(spark, sf):
    s = evaluate.corpus_stats(metric_rows(spark, sf))
    return s.select("total_contracts", "successful_contracts", "error_rate",
                    F.round("avg_risks_per_contract", 9).alias("avg_risks"),
                    F.round("avg_sections_per_contract", 9).alias("avg_sections"))


def type_distribution(spark, sf):
    return evaluate.type_distribution(metric_rows(spark, sf)).withColumn("share", F.round("share", 9))


def risk_mean_by_type(spark, sf):
    return evaluate.mean_risks_by_type(metric_rows(spark, sf)).withColumn("avg_risks", F.round("avg_risks", 9))


def measure_histogram(spark, sf):
    return flat(evaluate.histogram(read(spark, sf, "events").select("value"), "value")
                .withColumn("bin_start", F.round("bin_start", 6)))


def evaluation_details(spark, sf):
    return evaluate.report_tables(metric_rows(spark, sf))["details"]


def error_documents(spark, sf):
    """Documents asked for by key, by status: keys without a document and documents without text are errors, not lost."""
    asked = read(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    docs = documents(spark, sf).select("doc_id", "text").join(asked, "doc_id", "full")
    rows = pipeline.metrics(from_text_table(docs, "doc_id", "text"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("errors").alias("errors"))


def format_ts(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(F.col("event_type") == "error", F.concat(F.lit("not a time "), F.col("event_id").cast("string"))).otherwise(iso)
    return read(spark, sf, "events").select("event_id", tx.format_timestamp(given, "dd/MM/yyyy HH:mm").alias("shown"))


def merge_maps(spark, sf):
    left = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    right = F.create_map(F.lit("user"), F.lit("hidden"), F.lit("props"), F.col("props"))
    merged = tx.merge_maps(left, right)
    return read(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.transform(
        F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("merged"))


def stream_analyze(spark, sf):
    """The documents table read as a stream of rows, analysed in micro-batches into a result store."""
    root = scratch(spark, "stream")
    schema = "doc_id bigint, text string"
    # a pattern, because the table may be one file or a folder of files
    drops.stream_table(spark, f"{sf}/documents.parque[t]", schema, f"{root}/store", f"{root}/checkpoint", key="doc_id").awaitTermination()
    return flat(spark.read.parquet(f"{root}/store").select("doc_id", "status", "word_count", "has_pii", "sections_count",
                                                           "risks_count"))


def stream_redelivery(spark, sf):
    """Every document delivered twice, over three batches: which save stored it, and what it says; nothing is stored twice."""
    root = scratch(spark, "redelivery")
    part = F.pmod("doc_id", F.lit(3))
    for n, parts in enumerate(((0, 1), (1, 2), (2, 0))):
        read(spark, sf, "documents").select("doc_id", "text").where(part.isin(*parts)).write.parquet(f"{root}/drop/{n}")
        drops.stream_table(spark, f"{root}/drop/*", "doc_id bigint, text string", f"{root}/store", f"{root}/checkpoint",
                           key="doc_id", files_per_batch=1 << 30).awaitTermination()
    rows = spark.read.parquet(f"{root}/store")
    return flat(rows.select("doc_id", F.col("store_run").alias("delivery"), "status", "word_count", "sections_count", "risks_count"))


def result_store(spark, sf):
    """Digests written to a store and read back."""
    root = scratch(spark, "store")
    sinks.save_results(digest(spark, sf), f"{root}/digests", "overwrite")
    return Store(spark, f"{root}/digests").read()


def result_lookup(spark, sf):
    """One digest looked up by its id in a store on disk."""
    root = scratch(spark, "lookup")
    sinks.save_results(digest(spark, sf), f"{root}/digests", "overwrite")
    return sinks.get_result(spark, f"{root}/digests", 7)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the session's shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


QUERIES = {f.__name__: f for f in (
    clean_documents, strip_html, truncate_text, hash_text, unique_ids, paragraphs, sections_flat, sections_hier,
    section_tree, section_types, section_offsets, doc_metadata, document_sizes, contract_type_counts, dates_parties,
    pii_detect, pii_documents, pii_redact, pii_redact_documents, pii_report, legal_entities, encrypt_roundtrip,
    risks, risk_advice, risk_by_category, risk_top5, risk_type_matrix, risk_union_predictions, clauses, clause_risk_link, terms,
    terms_in_order, glossary, cross_references, reference_lists, extract_info, extract_merge, extract_questions,
    important_sections, section_summaries, overall_summaries, key_points, contract_basics, response, digest,
    results_json, results_json_models, metrics_json, ingest_files, training_risk, training_section, training_qa, training_risk_b, training_section_b, training_qa_b,
    training_counts, qa_manifest, clause_csv_training, label_encoding, train_split, train_eval_classifier, scored_labels, saved_classifier, hooked_scores, prediction_quality,
    graded_predictions, metric_rows, eval_stats, type_distribution, risk_mean_by_type, measure_histogram,
    evaluation_details, error_documents, format_ts, merge_maps, stream_analyze, stream_redelivery, result_store, result_lookup,
    custom_rules, analyze_with_predictions)}
