"""The whole analysis.

Two shapes are offered.  `analysis_rows` keeps one row per document and works
out sections, findings, answers, summary and key points as arrays inside that
row: responses, digests and corpus metrics then need no join and no shuffle at
all.  `analyze` gives the normalized tables (sections, risks, references …).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.config import AnalysisConfig
from clauselake.functions.privacy import legal_entities
from clauselake.functions.text import clean_text, let, unfold, word_count
from clauselake.operators import detect, extract, segment, summary, xref
from clauselake.operators.metadata import with_metadata
from clauselake.operators.privacy import with_pii, without_pii
from clauselake.rules.risk import RISK_RULES
from clauselake.rules.vocab import KEY_POINT_SECTION_TYPES
from clauselake.sources.files import with_status

# Fixed value: the summary of a document that could not be analysed.
FAILED_SUMMARY = "Analysis failed"


def prepare(docs: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """documents(doc_id, file_name, text) + status, errors, clean, has_pii, pii_types, body."""
    # with redaction the batch that redacts cleans, too
    docs = with_status(docs).withColumn("clean", clean_text(F.col("text"), shared=not cfg.detect_pii))
    return with_pii(docs) if cfg.detect_pii else without_pii(docs)


def stage(rows: DataFrame, path: str | None) -> DataFrame:
    """Write rows to a new shared folder and go on from there, so that several branches do not repeat the work
    and a lost executor costs no recomputation; without a path the plan just goes on.  A folder that exists is refused.

    Of the text as given only its page breaks are written, of the found values only their types."""
    if path is None:
        return rows
    lean = rows.withColumn("text", F.regexp_replace("text", r"[^\f]+", "")).drop("pii")
    lean.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


# --- one row per document -------------------------------------------------------------------------


def _fired(paras: Column, cfg: AnalysisConfig, rules=RISK_RULES) -> Column:
    """Per paragraph the rules that fire on it; headers and short paragraphs are not checked."""
    def rules_of(p):
        def check(s):
            is_header, _, _ = segment.header_parts(p, s["kind"], s["words"], F.lit(""), cfg.hierarchical)
            eligible = s["words"] >= detect.MIN_RISK_WORDS
            if not cfg.include_long_headers:
                eligible = eligible & ~is_header
            return F.when(eligible, detect.fired_rules(rules, p, s["low"])).otherwise(F.array().cast("array<int>"))

        return let(F.struct(segment.header_kind(p).alias("kind"), word_count(p).alias("words"), F.lower(p).alias("low")), check)

    return F.transform(paras, rules_of)


def _overall_summary(body: Column) -> Column:
    """Summary of the whole text, however long."""
    return F.coalesce(F.nullif(summary.summarize(body), F.lit("")), F.lit(summary.NO_SUMMARY))


def _key_points(found: Column, secs: Column, most: int | None = summary.KEY_SECTIONS) -> Column:
    facts = F.transform(F.filter(found, lambda a: a["value"] != ""), lambda a: F.struct(
        a["ext_type"].alias("category"),
        F.concat(summary.key_point_label(a["ext_type"]), F.lit(": "), a["value"]).alias("description"),
        F.lit("high").alias("importance"), F.lit("").alias("context"), a["value"].alias("extracted_value")))
    first = F.filter(secs, lambda s: s["type"].isin(*KEY_POINT_SECTION_TYPES))
    first = first if most is None else F.slice(first, 1, most)
    parts = F.transform(first, lambda s: F.struct(
        F.lit("section").alias("category"),
        F.concat(F.lit("Important "), s["type"], F.lit(" clause: "), s["title"]).alias("description"),
        F.lit("medium").alias("importance"), summary.section_context(s["text"]).alias("context"),
        s["title"].alias("extracted_value")))
    return F.transform(F.concat(facts, parts), lambda k, i: F.struct(
        F.format_string("point-%03d", i).alias("point_id"), k["category"].alias("category"),
        k["description"].alias("description"), k["importance"].alias("importance"), k["context"].alias("context"),
        k["extracted_value"].alias("extracted_value")))


def analysis_rows(docs: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), prepared: DataFrame | None = None,
                  rules=RISK_RULES) -> DataFrame:
    """One wide row per document; parts that are not selected are pruned before they are computed.

    `risks` number the given rules."""
    rows, body = prepare(docs, cfg) if prepared is None else prepared, F.col("body")
    by_batch = detect.fired_column(rules, body, cfg.hierarchical, cfg.include_long_headers)
    one_by_one = F.flatten(F.transform(_fired(F.col("paras" if by_batch is None else "foreign"), cfg, rules), lambda fired, i: F.transform(
        fired, lambda r: F.struct(i.alias("idx"), r.alias("rule_no")))))
    # what batches work out stands in one projection, below all that reads it, so that one worker a task does it;
    # paragraphs as columns are what is left to the JVM; what nothing reads is not worked out
    rows = with_metadata(rows.withColumns({
        "paras": segment.paragraph_array(body), "foreign": segment.foreign_paragraphs(body), "sections_count": segment.count_paragraphs(body),
        "batch_secs": segment.batch_sections(body, cfg.hierarchical), "batch_risks": F.lit(None) if by_batch is None else by_batch,
        "answers": extract.answers(body), "plain_summary": _overall_summary(body)}))
    ok = F.col("status") == "success"
    points = _key_points(F.col("answers"), F.col("secs"))
    return (rows
            .withColumns({"secs": F.coalesce("batch_secs", segment.section_array(F.col("foreign"), cfg.hierarchical)),
                          "risks": one_by_one if by_batch is None else F.coalesce("batch_risks", one_by_one)})
            .withColumn("summary", F.when(ok, summary.with_prefix(F.col("plain_summary"), F.col("contract_type")))
                        .otherwise(F.lit(FAILED_SUMMARY)))
            .withColumn("key_points", F.when(ok, points).otherwise(F.slice(points, 1, 0)))
            .drop("paras", "foreign", "batch_secs", "batch_risks", "plain_summary"))


def category_counts(risks: Column, rules=RISK_RULES) -> Column:
    """Map category -> number of findings, categories in rule order, only those that occur."""
    counts = F.array(*[F.struct(
        F.lit(c).alias("key"),
        F.size(F.filter(risks, lambda r: r["rule_no"].isin(*[i for i, x in enumerate(rules) if x.category == c])))
        .alias("value")) for c in dict.fromkeys(r.category for r in rules)])
    return F.map_from_entries(F.filter(counts, lambda e: e["value"] > 0))


def basics(contract_type: Column, sections: Column, body: Column) -> Column:
    return F.struct(contract_type.alias("type"), sections.alias("sections_count"),
                    summary.length_class(body).alias("estimated_length"))


def response(docs: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), rules=RISK_RULES) -> DataFrame:
    """The answer to one analysis request, one row per document."""
    return response_of(analysis_rows(docs, cfg, rules=rules), rules=rules)


def response_of(a: DataFrame, *more, rules=RISK_RULES) -> DataFrame:
    """The response columns of analysed documents, followed by `more`."""
    top, count = F.slice("key_points", 1, 3), F.col("sections_count")
    ok = F.col("status") == "success"
    return a.select(
        "doc_id", "status",
        F.struct("file_name", F.when(ok, F.col("file_type")).otherwise("unknown").alias("file_type"),
                 F.when(ok, F.col("file_size_kb")).otherwise(0.0).alias("file_size_kb"),
                 F.when(ok, F.col("page_count")).otherwise(0).alias("page_count"), "word_count", "contract_type",
                 F.col("contract_type_confidence").alias("type_confidence")).alias("metadata"),
        F.struct(F.col("summary").alias("overall"), top.alias("key_points"),
                 basics(F.col("contract_type"), count, F.col("body")).alias("basics")).alias("summary"),
        F.size("risks").alias("risks_count"), category_counts(F.col("risks"), rules).alias("risks_by_category"),
        count.alias("sections_count"), "has_pii", "pii_types", "errors", F.array().cast("array<string>").alias("warnings"), *more)


def digest(docs: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), rules=RISK_RULES, most: int | None = 5) -> DataFrame:
    """Short row: type, counts, summary and the first `most` risks (None: all)."""
    a = analysis_rows(docs, cfg, rules=rules)

    def shown(r):
        no = r["rule_no"]

        def of(attribute):
            return F.element_at(F.array(*[F.lit(getattr(x, attribute)) for x in rules]), no + 1)

        return F.struct(of("name").alias("name"), of("severity").alias("level"), of("category").alias("category"),
                        of("explanation").alias("description"))

    return a.select("doc_id", "contract_type", F.size("risks").alias("risks_count"),
                    "sections_count", "summary",
                    F.transform(F.col("risks") if most is None else F.slice("risks", 1, most), shown).alias("key_risks"))


def metrics(docs: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), prepared: DataFrame | None = None,
            rules=RISK_RULES) -> DataFrame:
    """Evaluation metrics, one row per document, failed documents included."""
    a = analysis_rows(docs, cfg, prepared, rules)
    categories = F.array_distinct(F.transform("risks", lambda r: F.element_at(
        F.array(*[F.lit(x.category) for x in rules]), r["rule_no"] + 1)))
    ok = F.col("status") == "success"
    return a.select(
        "doc_id", F.col("file_name").alias("filename"), "contract_type",
        F.col("contract_type_confidence").alias("confidence"), "status",
        F.col("sections_count").cast("bigint").alias("sections_count"), F.size("risks").cast("bigint").alias("risks_count"),
        F.size(categories).cast("bigint").alias("unique_risk_categories"),
        # every document has one: a failed or unsummarizable document gets a fixed sentence
        F.lit(True).alias("has_summary"),
        F.when(ok, F.size("answers")).otherwise(0).cast("bigint").alias("extracted_data_count"), "has_pii",
        F.size("errors").cast("bigint").alias("errors"), F.lit(0).cast("bigint").alias("warnings"))


# --- normalized tables ----------------------------------------------------------------------------


def section_rows(prepared: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    return segment.sections(prepared.select("doc_id", F.col("body").alias("text")), cfg.hierarchical)


def written(rows: DataFrame, path: str | None) -> DataFrame:
    """The rows read back from a new folder that they are written to; as they are without one."""
    if path is None:
        return rows
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def risk_findings(prepared: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), predictions: DataFrame | None = None,
                  rules=RISK_RULES, rows: DataFrame | None = None) -> DataFrame:
    """Numbered risks of prepared documents, or of their section `rows`."""
    rows = section_rows(prepared, cfg) if rows is None else rows
    found = detect.detect_risks(rows, rules, include_long_headers=cfg.include_long_headers)
    if predictions is not None and cfg.model_risks:
        return detect.union_model_risks(found, rows, predictions, cfg.risk_threshold,
                                        include_long_headers=cfg.include_long_headers)
    return detect.number_risks(found)


def analyze(docs: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), predictions: DataFrame | None = None,
            model_answers: DataFrame | None = None, staging: str | None = None, rules=RISK_RULES,
            prepared: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables.  Give a `staging` path when several of them are read, or documents `prepared` before.

    The switches choose plan branches here, on the driver; an unread table costs nothing.
    Predictions, model answers and rules of your own count in every table: responses and
    metrics then take their findings and key points from the tables of the same call.
    With predictions three tables hold the risks, so with a `staging` path the sections and the risks are
    written beside the documents, once.
    """
    if prepared is None:
        prepared = stage(prepare(docs, cfg), staging)
    good = prepared.where("status = 'success'")
    shared = staging if predictions is not None and cfg.model_risks else None
    rows = written(section_rows(good, cfg), shared and f"{shared}-sections")
    findings = written(risk_findings(good, cfg, predictions, rules, rows), shared and f"{shared}-risks")
    seen = good if cfg.entities_on_redacted else good.drop("body").withColumnRenamed("clean", "body")
    found = extract.extract(good)
    if model_answers is not None:
        found = extract.merge_answers(found, model_answers)
    out = {
        "documents": prepared.select("doc_id", "file_name", "status", "errors", "has_pii", "pii_types"),
        "metadata": with_metadata(good).drop("text", "clean", "body", "pii", "status", "errors"),
        "sections": segment.segment(good.select("doc_id", F.col("body").alias("text")), cfg.hierarchical),
        "entities": segment.sections(seen.select("doc_id", F.col("body").alias("text")), cfg.hierarchical)
        .select("doc_id", "section_id", legal_entities(F.col("text")).alias("entities")).where(F.size("entities") > 0),
        "risks": detect.with_risk_advice(findings, rules),
        "clauses": detect.detect_clauses(rows),
        "terms": detect.detect_terms(rows, ["doc_id", "section_id"]),
        "extracted": found.select("doc_id", "type_order", "ext_type", "value", "confidence", "method"),
        "key_points": summary.key_points(found, rows),
        "section_summaries": summary.section_summaries(summary.important_sections(
            good.select("doc_id", F.col("body").alias("text")), cfg.hierarchical)),
        "responses": response_of(analysis_rows(docs, cfg, prepared, rules), rules=rules),
        "metrics": metrics(docs, cfg, prepared, rules),
    }
    if predictions is not None and cfg.model_risks:
        out["responses"], out["metrics"] = _recounted(out["responses"], out["metrics"], out["risks"])
    if model_answers is not None:
        out["responses"] = _with_key_points(out["responses"], out["key_points"])
    if cfg.cross_references:
        out["cross_references"] = xref.reference_lists(xref.cross_references(rows))
    return out


def _recounted(responses: DataFrame, measured: DataFrame, risks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses and metrics with the counts of the risk table; only counts are joined."""
    per = risks.groupBy("doc_id", "risk_category").agg(F.count("*").alias("n"), F.min("risk_id").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", F.col("risk_category").alias("key"), F.col("n").cast("int").alias("value"))))
    counts = per.groupBy("doc_id").agg(F.sum("n").alias("_n"), F.count("*").alias("_kinds"), F.map_from_entries(F.transform(
        listed, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))).alias("_map"))
    none = F.create_map().cast("map<string,int>")
    both = responses.join(counts, "doc_id", "left").withColumns({
        "risks_count": F.coalesce("_n", F.lit(0)).cast("int"), "risks_by_category": F.coalesce("_map", none)})
    rows = measured.join(counts, "doc_id", "left").withColumns({
        "risks_count": F.coalesce("_n", F.lit(0)), "unique_risk_categories": F.coalesce("_kinds", F.lit(0))})
    return both.select(*responses.columns), rows.select(*measured.columns)


def _with_key_points(responses: DataFrame, points: DataFrame) -> DataFrame:
    """Responses whose summary shows the first three of the given key points."""
    fields = ("point_id", "category", "description", "importance", "context", "extracted_value")
    first = points.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(*fields))), 1, 3).alias("_points"))
    out = responses.join(first, "doc_id", "left")
    shown = F.coalesce("_points", F.slice(F.col("summary.key_points"), 1, 0))
    return out.withColumn("summary", F.col("summary").withField("key_points", shown)).select(*responses.columns)


def key_point_rows(docs: DataFrame, text: str = "clean", cfg: AnalysisConfig = AnalysisConfig(),
                   most: int | None = summary.KEY_SECTIONS) -> DataFrame:
    """Key points, one per row, worked out inside the document's row; `most` sections of the key types (None: all)."""
    rows = docs.select("doc_id", F.col(text).alias("t"))
    rows = rows.select("doc_id", extract.answers(F.col("t")).alias("answers"), segment.foreign_paragraphs(F.col("t")).alias("foreign"),
                       segment.batch_sections(F.col("t"), cfg.hierarchical).alias("batch_secs"))
    rows = rows.withColumn("secs", F.coalesce("batch_secs", segment.section_array(F.col("foreign"), cfg.hierarchical)))
    points = _key_points(F.col("answers"), F.col("secs"), most)
    return unfold(rows, ["doc_id"], points, "at", "point").select("doc_id", "point.*")


def with_model_columns(docs: DataFrame, predictions: DataFrame | None, model_answers: DataFrame | None) -> DataFrame:
    """Documents with what models say of them: arrays `model_risks` and `model_answers`, where tables are given.

    The tables are grouped by document first; the raw text moves once to meet
    them, and not at all without them.
    """
    for table, name, fields in ((predictions, "model_risks", ("section_id", "label", "confidence")),
                                (model_answers, "model_answers", ("ext_type", "value", "confidence"))):
        if table is not None:
            docs = docs.join(table.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias(name)), "doc_id", "left")
    return docs


def detailed_response(docs: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), staging: str | None = None, rules=RISK_RULES,
                      predictions: DataFrame | None = None, model_answers: DataFrame | None = None) -> DataFrame:
    """The response plus nested sections, risks, answers and references of each document.

    Everything is put together inside the document's row; no exchange is
    planned, but for the one that brings predictions (doc_id, section_id, label,
    confidence) or model answers (doc_id, ext_type, value, confidence) to the
    documents where such tables are given.  They and rules of your own count in
    the response, too.  With a `staging` path (a shared folder) the cleaned
    documents are written there first.
    """
    prepared = stage(prepare(with_model_columns(docs, predictions, model_answers), cfg), staging)
    a = analysis_rows(docs, cfg, prepared, rules)
    ok = F.col("status") == "success"
    if model_answers is not None:
        a = a.withColumn("answers", extract.merged_answers(F.col("answers"), F.col("model_answers"), F.length("body")))
        points = _key_points(F.col("answers"), F.col("secs"))
        a = a.withColumn("key_points", F.when(ok, points).otherwise(F.slice(points, 1, 0)))
    # a column of its own: it is read as a whole and, where a model has found risks, for each of them
    a = a.withColumn("foreign", segment.foreign_paragraphs(F.col("body")))
    a = a.withColumn("tree", segment.tree_column(F.col("body"), cfg.hierarchical, F.col("foreign")))
    given = F.col("model_risks") if predictions is not None and cfg.model_risks else None
    a = a.withColumn("listed", detect.risk_array(F.col("risks"), F.col("tree"), F.transform("secs", lambda s: s["words"]), given, rules,
                                                 cfg.risk_threshold, cfg.include_long_headers))
    nested_parts = [F.col("tree").alias("sections"), F.col("listed").alias("risks"), F.col("answers").alias("extracted_data")]
    if cfg.cross_references:
        nested_parts.append(xref.reference_column(F.col("body"), F.col("foreign")).alias("cross_references"))
    out = response_of(a, *nested_parts, rules=rules)
    if given is None:
        return out
    kinds = F.array_distinct(F.transform("risks", lambda r: r["risk_category"]))
    counts = let(F.col("risks"), lambda listed: F.map_from_entries(F.transform(kinds, lambda k: F.struct(
        k, F.size(F.filter(listed, lambda r: r["risk_category"] == k))))))
    return out.withColumns({"risks_count": F.size("risks"), "risks_by_category": counts})
