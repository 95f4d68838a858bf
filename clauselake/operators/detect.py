"""Rule packs -> Column expressions -> findings.

Detection is two projections and one generator over the section rows, without
a join or a shuffle.  The first projection only decides which rules fire: a
cheap substring gate, then one alternation of the rule's patterns, then one of
its exceptions.  Pattern index, matched text and context are worked out only
for the few (section, rule) pairs that fired.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauselake.functions.batches import fired_lines_of, fired_of, holding_groups, words_placed_in
from clauselake.functions.lookup import lookup, pick
from clauselake.functions.text import holds, is_ascii, let, prefix_sums, runs, unfold
from clauselake.operators.segment import MIN_PARAGRAPH, header_shapes
from clauselake.operators.segment import section_id as segment_id
from clauselake.rules.clause import CLAUSE_RULES
from clauselake.rules.model import Probe, any_of, java_pattern
from clauselake.rules.prefilter import needles, portable
from clauselake.rules.risk import RISK_RULES
from clauselake.rules.term import LEGAL_TERMS
from clauselake.rules.vocab import DEFAULT_RISK_CLASS, RISK_CLASSES

MIN_RISK_WORDS = 10
RISK_CONTEXT, TERM_CONTEXT = 100, 50
# Rules that have a bit of their own in a number.
MOST_GATED = 63
# Characters per piece of a text from which contexts are cut.
BLOCK = 512


def contains_any(text: Column, words) -> Column:
    return reduce(or_, [holds(text, w) for w in words])


def rule_fires(rule, text: Column, low: Column) -> Column:
    """Cheapest test first: context word, words the patterns need, patterns, exceptions."""
    plain = [p for i, p in enumerate(rule.patterns) if i not in rule.probes]
    tests = []
    if plain:
        words, test = needles(plain), text.rlike(java_pattern(any_of(plain)))
        tests.append(contains_any(low, words) & test if words else test)
    tests += [contains_any(low, p.words) & text.rlike(java_pattern(p.pattern)) for p in rule.probes.values()]
    fires = reduce(or_, tests)
    if rule.context:
        fires = contains_any(low, rule.context) & fires
    if rule.exceptions:
        fires = fires & ~text.rlike(java_pattern(any_of(rule.exceptions)))
    return fires


def rule_flags(rules, text: Column, low: Column) -> Column:
    """Array with the position of each rule that fires on `text` (`low` is its lower-case column), null for the others.

    As a column of its own it runs as compiled code; inside a generator or a
    higher-order function Spark would walk the expressions row by row.
    """
    return F.array(*[F.when(rule_fires(r, text, low), F.lit(i)) for i, r in enumerate(rules)])


def rule_words(rule) -> list[list[str]]:
    """Lists of lower-case words: a text on which the rule fires holds a word of each."""
    plain = [p for i, p in enumerate(rule.patterns) if i not in rule.probes]
    words = needles(plain) if plain else ()
    lists = [[*words, *(w for p in rule.probes.values() for w in p.words)]] if words or not plain else []
    return lists + ([list(rule.context)] if rule.context else [])


def batch_rules(rules) -> list | None:
    """The rules as `fired_of` takes them; None if there are too many or the engine there might read a pattern otherwise."""
    given = [p for r in rules for p in (*r.patterns, *r.exceptions, *(q.pattern for q in r.probes.values()))]
    if not 0 < len(rules) <= MOST_GATED or not all(map(portable, given)):
        return None

    def groups(rule):
        plain = [p for i, p in enumerate(rule.patterns) if i not in rule.probes]
        return [(list(needles(plain)), plain)] * bool(plain) + [(list(p.words), [p.pattern]) for p in rule.probes.values()]

    return [(list(r.context), groups(r), list(r.exceptions)) for r in rules]


def fired_column(rules, text: Column, hierarchical: bool, include_long_headers: bool) -> Column | None:
    """Array of (idx, rule_no) of whole texts: the rules that fire on their paragraphs, null beyond ASCII; None if batches
    cannot test the rules."""
    tests = batch_rules(rules)
    return tests and fired_lines_of(text, MIN_PARAGRAPH, tests, MIN_RISK_WORDS, include_long_headers, hierarchical, header_shapes())


def flagged(rows: DataFrame, rules, keep: list[str], name: str) -> tuple[DataFrame, Column]:
    """Rows with a column `name` for the rules, and the flags of `rule_flags` told from it and from columns `text` and `low`.

    Batches decide which rules fire; a text beyond ASCII, or rules that they cannot test, are left to the JVM.
    """
    text, low, held, tests = F.col("text"), F.col("low"), F.col(name), batch_rules(rules)
    if tests:
        return rows.select(*keep, fired_of(text, tests).alias(name)), F.when(held.isNull(), rule_flags(rules, text, low)).otherwise(
            F.array(*[F.when(held.bitwiseAND(F.lit(1 << i)) != 0, F.lit(i)) for i in range(len(rules))]))
    if len(rules) <= MOST_GATED:
        return rows.select(*keep, gate(rules, text).alias(name)), gated_flags(rules, text, low, held)
    return rows.select(*keep, F.lit(None).cast("bigint").alias(name)), rule_flags(rules, text, low)


def gate(rules, text: Column) -> Column:
    """The rules that may fire, as a column that `gated_flags` takes."""
    return holding_groups(text, [rule_words(r) for r in rules])


def gated_flags(rules, text: Column, low: Column, held: Column) -> Column:
    """`rule_flags`, looked at only where a batch test has found words of the rule."""
    return F.array(*[F.when((held.bitwiseAND(F.lit(1 << i)) != 0) & rule_fires(r, text, low), F.lit(i)) for i, r in enumerate(rules)])


def raised(flags: Column) -> Column:
    return F.filter(flags, lambda x: x.isNotNull())


def fired_rules(rules, text: Column, low: Column) -> Column:
    """Array of the positions of the rules that fire on `text`."""
    return raised(rule_flags(rules, text, low))


def first_pattern(rule, text: Column) -> Column:
    tests = [rule.probes[i].pattern if i in rule.probes else p for i, p in enumerate(rule.patterns)]
    return F.coalesce(*[F.when(text.rlike(java_pattern(p)), F.lit(i)) for i, p in enumerate(tests)])


def run_match(text: Column, probe: Probe) -> Column:
    """First match of `quoted verb` or `word word … verb`, without a loop over words in the pattern.

    One-letter words end a run of words, so they are blanked out first (keeping
    all positions); a run is then one character class, entered only where it begins.
    """
    apart = F.regexp_replace(text, r"(?<![A-Za-z])[A-Za-z](?![A-Za-z])", "\u0001")
    run = F.regexp_extract(apart, java_pattern(rf"(?:^|[^a-z\s])\s*([a-z][a-z\s]*\s{probe.verb})"), 1)
    quoted = F.regexp_extract(text, java_pattern(probe.quoted), 0)
    first = (quoted != "") & ((run == "") | (F.instr(text, quoted) < F.instr(text, run)))
    return F.when(first, quoted).otherwise(run)


def match_text(rule, i: int, text: Column) -> Column:
    if i in rule.probes:
        return run_match(text, rule.probes[i])
    return F.regexp_extract(text, java_pattern(rule.patterns[i]), 0)


def match_position(rule, i: int, text: Column, matched: Column) -> Column:
    """1-based start of the match."""
    if i in rule.probes:
        return F.instr(text, matched)
    return F.regexp_instr(text, F.lit(java_pattern(rule.patterns[i])))


def snippet(text: Column, start: Column, length: Column, around: int) -> Column:
    """`around` characters on both sides of a match (start is 0-based), dots where text was cut."""
    lo = F.greatest(start - around, F.lit(0))
    hi = F.least(start + length + around, F.length(text))
    return F.concat(F.when(lo > 0, F.lit("...")).otherwise(F.lit("")), F.substring(text, lo + 1, hi - lo),
                    F.when(hi < F.length(text), F.lit("...")).otherwise(F.lit("")))


def block_snippet(blocks: Column, chars: Column, start: Column, length: Column, around: int) -> Column:
    """`snippet` from the blocks of a text, so that its cost does not depend on where in the text the match is."""
    lo = F.greatest(start - around, F.lit(0))
    hi = F.least(start + length + around, chars)
    first, last = F.floor(lo / BLOCK).cast("int"), F.floor((hi - 1) / BLOCK).cast("int")
    part = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.concat(F.when(lo > 0, F.lit("...")).otherwise(F.lit("")), F.substring(part, lo - first * BLOCK + 1, hi - lo),
                    F.when(hi < chars, F.lit("...")).otherwise(F.lit("")))


def find(rows: DataFrame, rules, keys: list[str], around: int = RISK_CONTEXT) -> DataFrame:
    """One row per (input row, rule that fires), with the first pattern's first match."""
    text = F.col("text")
    hit, flags = flagged(rows, rules, [*keys, "text"], "held")
    hit = hit.where("held is null or held <> 0").withColumn("low", F.lower("text")).select(*keys, "text", flags.alias("flags"))
    hit = unfold(hit, [*keys, "text"], raised(F.col("flags")), "rule_no")
    hit = hit.withColumn("pattern_idx", pick(F.col("rule_no"), [first_pattern(r, text) for r in rules]))
    numbered = [(r, i) for r in rules for i in range(len(r.patterns))]
    starts = [sum(len(r.patterns) for r in rules[:i]) for i in range(len(rules))]
    hit = hit.withColumn("pattern_no", pick(F.col("rule_no"), [F.lit(s) for s in starts]) + F.col("pattern_idx"))
    hit = hit.withColumn("matched_text", pick(F.col("pattern_no"), [match_text(r, i, text) for r, i in numbered]))
    hit = hit.withColumn("start", pick(F.col("pattern_no"), [match_position(r, i, text, F.col("matched_text"))
                                                             for r, i in numbered]) - 1)
    hit = hit.withColumn("context", snippet(text, F.col("start"), F.length("matched_text"), around))
    return hit.select(*keys, "rule_no", pick(F.col("rule_no"), [F.lit(r.key) for r in rules]).alias("rule_key"),
                      "pattern_idx", "matched_text", "context")


def eligible_for_risk(sections: DataFrame, include_long_headers: bool = False) -> DataFrame:
    keep = F.col("word_count") >= MIN_RISK_WORDS
    return sections.where(keep if include_long_headers else keep & ~F.col("is_header"))


def detect_risks(sections: DataFrame, rules=RISK_RULES, id_col: str = "doc_id",
                 include_long_headers: bool = False) -> DataFrame:
    """Risk findings with names and grades, not yet numbered."""
    found = find(eligible_for_risk(sections, include_long_headers), rules, [id_col, "para_idx", "section_id"])
    no = F.col("rule_no")
    return found.withColumns({
        "finding_id": F.concat("rule_key", F.lit("_"), F.col("pattern_idx").cast("string")),
        "risk_name": pick(no, [F.lit(r.name) for r in rules]),
        "risk_category": pick(no, [F.lit(r.category) for r in rules]),
        "risk_level": pick(no, [F.lit(r.severity) for r in rules]),
        "confidence": F.lit(1.0),
        "method": F.lit("rule_based"),
    })


def number_risks(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number findings per document in (section, rule) order: the only shuffle of risk detection,
    and it moves findings, not sections."""
    order = W.partitionBy(id_col).orderBy("para_idx", "rule_no")
    return found.withColumn("risk_id", F.format_string("risk-%03d", F.row_number().over(order) - 1))


def with_risk_advice(risks: DataFrame, rules=RISK_RULES) -> DataFrame:
    """Attach the explanatory text of each rule."""
    key = F.col("rule_key")
    return risks.withColumns({
        "risk_description": lookup(key, {r.key: r.explanation for r in rules}),
        "impact": lookup(key, {r.key: r.impact for r in rules}),
        "suggested_changes": lookup(key, {r.key: r.suggestion for r in rules}),
    })


def model_risks(predictions: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Predictions(…, label, confidence) at or above the threshold, graded by label."""
    label = F.col("label")
    return predictions.where(F.col("confidence") >= threshold).withColumns({
        "risk_category": lookup(label, {k: c for k, (c, _) in RISK_CLASSES.items()}, DEFAULT_RISK_CLASS[0]),
        "risk_level": lookup(label, {k: s for k, (_, s) in RISK_CLASSES.items()}, DEFAULT_RISK_CLASS[1]),
    })


def union_model_risks(rule_risks: DataFrame, sections: DataFrame, predictions: DataFrame, threshold: float = 0.6,
                      id_col: str = "doc_id", include_long_headers: bool = False) -> DataFrame:
    """Rule findings first, then model findings for risks no rule has found in that section."""
    keys = [id_col, "section_id"]
    # 300 characters of context per section travel to the join, never whole sections
    heads = eligible_for_risk(sections, include_long_headers).select(
        *keys, "para_idx", F.concat(F.left("text", F.lit(300)), F.lit("...")).alias("context"))
    graded = model_risks(predictions, threshold).withColumnRenamed("label", "rule_key")
    known = rule_risks.select(*keys, "rule_key")
    fresh = (graded.join(heads, keys).join(known, [*keys, "rule_key"], "left_anti")
             .withColumns({"risk_name": F.col("rule_key"), "method": F.lit("ml"), "source": F.lit(1),
                           "matched_text": F.lit("")}))
    cols = [id_col, "para_idx", "section_id", "rule_key", "risk_name", "risk_category", "risk_level", "matched_text",
            "context", "confidence", "method", "source", "rule_no"]
    both = (rule_risks.withColumn("source", F.lit(0)).select(*cols)
            .unionByName(fresh.withColumn("rule_no", F.lit(0)).select(*cols)))
    order = W.partitionBy(id_col).orderBy("source", "para_idx", "rule_no", "rule_key")
    return (both.withColumn("risk_id", F.format_string("risk-%03d", F.row_number().over(order) - 1))
            .drop("source", "rule_no"))


def risk_array(found: Column, tree: Column, words: Column, model: Column | None = None, rules=RISK_RULES, threshold: float = 0.6,
               include_long_headers: bool = False) -> Column:
    """The numbered risks of one document inside its row: rule findings (idx, rule_no), then a model's.

    `model` holds (section_id, label, confidence) of the document, `tree` its
    sections, `words` their numbers of words.  As in `union_model_risks`, a
    model finding counts on the sections that rules may look at, if it is sure
    enough and no rule has found the same there.
    """

    def of(no, attribute):
        return F.element_at(F.array(*[F.lit(getattr(x, attribute)) for x in rules]), no + 1)

    def by_rule(r):
        no = r["rule_no"]
        return F.struct(of(no, "name").alias("risk_name"), of(no, "severity").alias("risk_level"), of(no, "category").alias("risk_category"),
                        segment_id(r["idx"]).alias("section_id"), of(no, "explanation").alias("description"),
                        F.lit(1.0).alias("confidence"), of(no, "suggestion").alias("suggested_changes"), F.lit("rule_based").alias("method"))

    def by_model(e):
        key = e["key"]
        return F.struct(key.alias("risk_name"), lookup(key, {k: s for k, (_, s) in RISK_CLASSES.items()}, DEFAULT_RISK_CLASS[1]).alias("risk_level"),
                        lookup(key, {k: c for k, (c, _) in RISK_CLASSES.items()}, DEFAULT_RISK_CLASS[0]).alias("risk_category"),
                        segment_id(e["idx"]).alias("section_id"), lookup(key, {r.key: r.explanation for r in rules}).alias("description"),
                        (-e["minus"]).alias("confidence"), lookup(key, {r.key: r.suggestion for r in rules}).alias("suggested_changes"),
                        F.lit("ml").alias("method"))

    def fresh(sections):
        def usable(m, i):
            s = F.get(sections, i)
            open_to = (F.get(words, i) >= MIN_RISK_WORDS) & (s["section_id"] == m["section_id"])
            return open_to if include_long_headers else open_to & ~s["is_header"]

        told = F.transform(model, lambda m: F.struct(F.substring(m["section_id"], 5, 9).try_cast("int").alias("idx"), m.alias("m")))
        good = F.filter(told, lambda x: (x["m"]["confidence"] >= threshold) & F.coalesce(usable(x["m"], x["idx"]), F.lit(False)))
        mine = F.transform(found, lambda r: F.struct(r["idx"].alias("idx"), of(r["rule_no"], "key").alias("key"), F.lit(0).alias("given"),
                                                     F.lit(-1.0).alias("minus")))
        given = F.transform(good, lambda x: F.struct(x["idx"].alias("idx"), x["m"]["label"].alias("key"), F.lit(1).alias("given"),
                                                     (-x["m"]["confidence"]).alias("minus")))
        both = runs(F.array_sort(F.concat(mine, given)), lambda a, b: (a["idx"] == b["idx"]) & (a["key"] == b["key"]))
        return F.transform(F.flatten(F.filter(both, lambda run: F.get(run, 0)["given"] == 1)), by_model)

    listed = F.transform(found, by_rule)
    if model is not None:
        listed = F.when(model.isNull(), listed).otherwise(F.concat(listed, let(tree, fresh)))
    return F.transform(listed, lambda r, i: F.struct(F.format_string("risk-%03d", i).alias("risk_id"), *[r[c].alias(c) for c in (
        "risk_name", "risk_level", "risk_category", "section_id", "description", "confidence", "suggested_changes", "method")]))


def count_by_category(risks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return risks.groupBy(id_col, "risk_category").agg(F.count("*").alias("n"))


def top_risks(risks: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The first k findings per document; the limit is applied before the shuffle too."""
    order = W.partitionBy(id_col).orderBy("para_idx", "rule_no")
    return risks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def detect_clauses(sections: DataFrame, rules=CLAUSE_RULES, id_col: str = "doc_id") -> DataFrame:
    found = find(sections, rules, [id_col, "para_idx", "section_id"])
    no = F.col("rule_no")
    return found.select(
        id_col, "para_idx", "section_id", F.col("rule_key").alias("clause_key"),
        F.concat("rule_key", F.lit("_"), F.col("pattern_idx").cast("string")).alias("clause_id"), "pattern_idx",
        "matched_text", "context",
        pick(no, [F.lit(r.name) for r in rules]).alias("clause_name"),
        pick(no, [F.lit(r.purpose) for r in rules]).alias("purpose"),
        pick(no, [F.lit(r.importance) for r in rules]).alias("importance"),
        pick(no, [F.lit(r.boilerplate) for r in rules]).alias("is_boilerplate"),
        pick(no, [F.array(*[F.lit(f) for f in r.risk_factors]).cast("array<string>") for r in rules])
        .alias("risk_factors"))


def clause_risks(sections: DataFrame, clauses=CLAUSE_RULES, risks=RISK_RULES, id_col: str = "doc_id",
                 include_long_headers: bool = False) -> DataFrame:
    """Link every clause to the findings of the same section that it is known to carry.

    Both kinds of rules are looked up in one pass, inside the section's row; nothing is shuffled.
    """
    text = F.col("text")
    eligible = F.col("word_count") >= MIN_RISK_WORDS
    if not include_long_headers:
        eligible = eligible & ~F.col("is_header")
    rows = sections.select(id_col, "section_id", "text", eligible.alias("eligible"))
    rows, clause_flags = flagged(rows, clauses, rows.columns, "clauses_held")
    rows, risk_flags = flagged(rows, risks, rows.columns, "risks_held")
    rows = rows.where("clauses_held is null or clauses_held <> 0").withColumn("low", F.lower("text"))
    rows = rows.select(id_col, "section_id", "text", clause_flags.alias("clause_flags"), F.when(F.col("eligible"), risk_flags).alias("risk_nos"))
    rows = unfold(rows, [id_col, "section_id", "text", "risk_nos"], raised(F.col("clause_flags")), "no")
    factors = pick(F.col("no"), [F.array(*[F.lit(f) for f in r.risk_factors]).cast("array<string>") for r in clauses])
    rows = rows.withColumn("clause_key", pick(F.col("no"), [F.lit(r.key) for r in clauses]))
    rows = unfold(rows, [id_col, "section_id", "text", "risk_nos", "clause_key"], factors, "rule_key")
    at = lookup(F.col("rule_key"), {r.key: str(i) for i, r in enumerate(risks)}).cast("int")
    rows = rows.withColumn("rule_no", F.when(F.array_contains("risk_nos", at), at))
    found = F.when(F.col("rule_no").isNotNull(), pick(F.col("rule_no"), [first_pattern(r, text) for r in risks]))
    return rows.select(id_col, "section_id", "rule_key", "clause_key",
                       F.concat("rule_key", F.lit("_"), found.cast("string")).alias("finding_id"))


def _term_words(terms) -> list[tuple]:
    """(number of the term, term, number of the word in it, word, its pattern) of every word."""
    return [(t_no, t, w_no, w, p) for t_no, t in enumerate(terms) for w_no, (w, p) in enumerate(zip(t.words, t.word_patterns()))]


def detect_terms(rows: DataFrame, keys: list[str], terms=LEGAL_TERMS) -> DataFrame:
    """Every whole-word match of every term and variation, with its position.

    Batches find them; texts beyond ASCII, and all texts where a word is beyond ASCII or begins or ends with a sign, are
    left to `term_matches`.
    """
    flat, no = _term_words(terms), F.col("word_id")
    batched = all(w.isascii() and re.match(r"\w", w) and re.search(r"\w\Z", w) for *_, w, _ in flat)
    rows = rows.select(*keys, "text")
    foreign = F.when(~is_ascii(F.col("text")), F.col("text")) if batched else F.col("text")
    rows = rows.withColumn("foreign", foreign)
    hits = term_matches(F.col("foreign"), terms)
    if batched:
        hits = F.coalesce(words_placed_in(F.col("text"), [w.lower() for *_, w, _ in flat], TERM_CONTEXT), F.when(F.col("foreign").isNotNull(), hits))
    # a column of its own: inside a generator the expressions would be walked row by row
    hit = unfold(rows.select(*keys, hits.alias("hits")), keys, F.col("hits"), "m").select(*keys, "m.*")
    return hit.select(
        *keys,
        pick(no, [F.lit(t.category) for _, t, *_ in flat]).alias("category"),
        pick(no, [F.lit(t.key) for _, t, *_ in flat]).alias("term"),
        pick(no, [F.lit(n) for n, *_ in flat]).alias("term_order"),
        pick(no, [F.lit(n) for _, _, n, *_ in flat]).alias("word_order"),
        "matched_text", "position", "context",
        pick(no, [F.lit(t.importance) for _, t, *_ in flat]).alias("importance"))


def term_matches(text: Column, terms=LEGAL_TERMS) -> Column:
    """Array of (word_id, matched_text, position, context) of the matches in one text, word after word.

    A word's matches and the text between them come from one pair of array expressions; match positions are prefix sums
    over their lengths, contexts are cut from blocks of the text.
    """
    flat = _term_words(terms)

    def of(word_id, blocks):
        found = pick(word_id, [F.regexp_extract_all(text, F.lit(java_pattern(p)), F.lit(0)) for *_, p in flat])
        gaps = F.transform(pick(word_id, [F.split(text, java_pattern(p)) for *_, p in flat]), F.length)
        return let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda m: placed(m, word_id, blocks))

    def placed(m, word_id, blocks):
        before = prefix_sums(F.zip_with(F.slice(m["gaps"], 1, F.size(m["found"])), F.transform(m["found"], F.length), lambda g, n: g + n))
        matches = F.filter(F.arrays_zip(m["found"].alias("found"), m["gaps"].alias("gaps"), before.alias("before")), lambda x: x["found"].isNotNull())
        return F.transform(matches, lambda x: told(x["found"], x["gaps"] + x["before"], word_id, blocks))

    def told(match, at, word_id, blocks):
        return F.struct(word_id.alias("word_id"), match.alias("matched_text"), at.alias("position"),
                        block_snippet(blocks, F.length(text), at, F.length(match), TERM_CONTEXT).alias("context"))

    held = let(F.lower(text), lambda low: raised(F.array(*[F.when(holds(low, w.lower()), F.lit(i)) for i, (*_, w, _) in enumerate(flat)])))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(cut, lambda blocks: F.flatten(F.transform(held, lambda word_id: of(word_id, blocks))))


def with_glossary(found: DataFrame, terms=LEGAL_TERMS) -> DataFrame:
    key = F.col("term")
    return found.withColumns({"plain_english": lookup(key, {t.key: t.plain for t in terms}),
                              "definition": lookup(key, {t.key: t.definition for t in terms})})


def terms_by_category(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per text and category with its hits in text order."""
    hit = F.struct("position", "term_order", "word_order", "term", "matched_text")
    return found.groupBy(*keys, "category").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
