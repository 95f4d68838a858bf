"""The same results in DuckDB SQL, written independently of the Spark operators.

Only rule data and the agreement wording are shared.  Where the Spark plan uses
a trick (window stacks, prefix sums, arrays inside a row) the SQL states the
definition instead: self joins, running sums, grouped lists.
"""

from __future__ import annotations

import re

from clauselake.functions.text import MARKS, ascii_tables
from clauselake.plans.corpus import duck_contracts, q
from clauselake.rules.clause import CLAUSE_RULES
from clauselake.rules.privacy import ENTITY_PATTERNS, PII_PATTERNS
from clauselake.rules.risk import RISK_RULES
from clauselake.rules.term import LEGAL_TERMS
from clauselake.rules.vocab import (CONTRACT_TYPES, DATE_PATTERN, EXTRACTION_PATTERNS, EXTRACTION_TYPES, HEADER_PATTERNS,
                                    KEY_POINT_SECTION_TYPES, PARTY_PATTERN, REFERENCE_PATTERNS, SECTION_TYPES,
                                    SUMMARY_SECTION_TYPES)

BLANK = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
TERM_WORDS = r"(?i)\b(?:" + "|".join(re.escape(w) for t in LEGAL_TERMS for w in t.words) + r")\b"


def ci(pattern: str) -> str:
    return q("(?i)" + pattern)


def strip(x: str) -> str:
    return f"trim({x}, {BLANK})"


def words(x: str) -> str:
    return f"(CASE WHEN {strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(x)}, '\\s+')) END)"


def upper(x: str) -> str:
    return f"(upper({x}) = {x} AND regexp_matches({x}, '[A-Z]'))"


def section_id(x: str) -> str:
    return f"printf('sec-%03d', {x})"


def clean(x: str) -> str:
    source, target, many = ascii_tables()
    out = f"translate({x}, {q(source)}, {q(target)})"
    for char, plain in many:
        out = f"replace({out}, {q(char)}, {q(plain)})"
    for pattern, new in ((f"[{MARKS}]", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "), (" +", " "),
                         (r"\n{3,}", "\n\n"), ("([a-z])([A-Z])", r"\1 \2"), (r"\n\s*\d+\s*\n", "\n"),
                         (r"(?i)\n\s*Page\s+\d+\s+of\s+\d+\s*\n", "\n")):
        out = f"regexp_replace({out}, {q(pattern)}, {q(new)}, 'g')"
    return f"coalesce({strip(out)}, '')"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def summarize(table: str, key: str, text: str = "text", out: str = "summary") -> str:
    """One summary per key: sentences by term count, a running word budget, reading order."""
    return f"""
    SELECT {key}, CASE WHEN length({strip('any_value(full_text)')}) < 50 THEN ''
                  ELSE coalesce(string_agg(sentence, ' ' ORDER BY pos) FILTER (used <= 150 OR used - n < 30), '') END AS {out}
    FROM (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY worth DESC, pos ROWS UNBOUNDED PRECEDING) AS used
          FROM (SELECT {key}, full_text, pos, sentence, {words('sentence')} AS n,
                       len(regexp_extract_all(sentence, {q(TERM_WORDS)})) AS worth
                FROM (SELECT {key}, full_text, unnest(range(len(parts))) AS pos, unnest(parts) AS sentence
                      FROM (SELECT {key}, {text} AS full_text, list_filter(list_transform(string_split(
                               regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
                               lambda s: {strip('s')}), lambda s: s <> '') AS parts FROM {table}))))
    GROUP BY {key}"""


def _clean() -> str:
    return f"SELECT doc_id, file_name, text, {clean('text')} AS clean FROM contracts"


def _pii(source: str = "clean") -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ti, {q(n)} AS pii_type, unnest(list_distinct(regexp_extract_all(clean, "
        f"{ci(p) if flag else q(p)}))) AS value FROM {source}" for i, (n, p, flag) in enumerate(PII_PATTERNS))


def _body() -> str:
    """Type by type, matches become markers without digits; the markers are spelled out at the end."""
    text = "SELECT doc_id, file_name, text AS raw, clean, clean AS t FROM clean"
    for i, (_, pattern, ignore_case) in enumerate(PII_PATTERNS):
        p = ci(pattern) if ignore_case else q(pattern)
        mark = f"chr(57344) || '{'ABCDEFGHI'[i]}' || translate(substr(md5(v), 1, 8), '0123456789', 'ghijklmnop') || chr(57345)"
        text = (f"SELECT doc_id, file_name, raw, clean, array_to_string(flatten(list_transform(list_zip(regexp_split_to_array(t, {p}), "
                f"list_transform(regexp_extract_all(t, {p}), lambda v: {mark})), lambda z: [z[1], coalesce(z[2], '')])), '') AS t "
                f"FROM ({text})")
    marked = f"chr(57344) || '[A-I][a-p]{{8}}' || chr(57345)"
    names = " ".join(f"WHEN '{'ABCDEFGHI'[i]}' THEN {q(n)}" for i, (n, _, _) in enumerate(PII_PATTERNS))
    tag = f"'[REDACTED-' || CASE v[2] {names} END || '-' || translate(v[3:10], 'ghijklmnop', '0123456789') || ']'"
    return f"""
    SELECT c.doc_id, c.file_name, c.raw, c.clean, p.pii_types,
           CASE WHEN p.doc_id IS NULL THEN c.clean ELSE array_to_string(flatten(list_transform(list_zip(
             regexp_split_to_array(t, {marked}), list_transform(regexp_extract_all(t, {marked}), lambda v: {tag})),
             lambda z: [z[1], coalesce(z[2], '')])), '') END AS body
    FROM ({text}) c LEFT JOIN (
      SELECT doc_id, string_agg(DISTINCT ti || ':' || pii_type, ',' ORDER BY ti || ':' || pii_type) AS pii_types
      FROM pii GROUP BY doc_id) p USING (doc_id)"""


def paras(source: str, text: str) -> str:
    return f"""
    SELECT doc_id, CAST(unnest(range(len(ps))) AS BIGINT) AS para_idx, unnest(ps) AS text FROM (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array({text}, '\\n\\s*\\n'), lambda p: {strip('p')}),
               lambda p: length(p) > 10 AND NOT regexp_matches(p, '^[\\d.]+$')) AS ps FROM {source})"""


def sections(source: str, hierarchical: bool = True) -> str:
    kind = " ".join(f"WHEN regexp_matches(text, {ci(p) if i else q(p)}) THEN {q(n)}" for n, p, i in HEADER_PATTERNS)

    def group(no):
        arms = " ".join(f"WHEN {q(n)} THEN regexp_extract(text, {ci(p) if i else q(p)}, {no})" for n, p, i in HEADER_PATTERNS)
        return f"(CASE kind {arms} END)"

    kinds = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), {q(w)})" for w in ws) + f" THEN {q(n)}"
        for n, ws in SECTION_TYPES.items())
    if hierarchical:
        caps = f"(kind IS NULL AND words <= 10 AND {upper('text')} AND length(text) > 3)"
        colon = f"(kind IS NULL AND NOT {caps} AND words <= 5 AND ends_with(text, ':'))"
        guess = f"CASE WHEN {caps} THEN text WHEN {colon} THEN rtrim(text, ':') END"
        level = ("CASE WHEN kind = 'numbered' THEN length(num) - length(replace(num, '.', '')) + 1 "
                 f"WHEN kind IN ('article', 'roman') THEN 1 WHEN kind = 'alphabetical' THEN 2 WHEN {colon} THEN 1 ELSE 0 END")
        header = f"(kind IS NOT NULL OR {caps} OR {colon})"
    else:
        caps = f"(kind IS NULL AND words <= 5 AND {upper('text')})"
        guess, level, header = f"CASE WHEN {caps} THEN text END", "0", f"(kind IS NOT NULL OR {caps})"
    return f"""
    SELECT doc_id, para_idx, {section_id('para_idx')} AS section_id, text, words AS word_count,
           coalesce(nullif(coalesce({group(2)}, {guess}), ''), 'Section ' || (para_idx + 1)) AS title,
           CASE {kinds} WHEN words < 10 AND {upper('text')} THEN 'header' ELSE 'clause' END AS section_type,
           {header} AS is_header, num AS section_number, CAST({level} AS BIGINT) AS level
    FROM (SELECT *, {group(1)} AS num FROM (
            SELECT *, CASE {kind} END AS kind, {words('text')} AS words FROM {source}))"""


def tree(source: str) -> str:
    return f"""
    SELECT s.*, p.parent_idx, CASE WHEN p.parent_idx IS NOT NULL THEN {section_id('p.parent_idx')} END AS parent_id
    FROM {source} s LEFT JOIN (
      SELECT s.doc_id, s.para_idx, max(h.para_idx) AS parent_idx FROM {source} s JOIN {source} h
        ON h.doc_id = s.doc_id AND h.para_idx < s.para_idx AND h.is_header AND (NOT s.is_header OR h.level < s.level)
      GROUP BY s.doc_id, s.para_idx) p USING (doc_id, para_idx)"""


def finds(rules, source: str, key: str, prefix: str, extra) -> str:
    arms = []
    for no, r in enumerate(rules):
        idx = " ".join(f"WHEN regexp_matches(text, {ci(p)}) THEN {i}" for i, p in enumerate(r.patterns))
        context = " OR ".join(f"contains(lower(text), {q(w)})" for w in r.context) or "true"
        stop = " OR ".join(f"regexp_matches(text, {ci(p)})" for p in r.exceptions) or "false"
        cols = ", ".join(f"{v} AS {n}" for n, v in extra(r).items())
        match = " ".join(f"WHEN {i} THEN regexp_extract(text, {ci(p)})" for i, p in enumerate(r.patterns))
        arms.append(f"""SELECT doc_id, para_idx, section_id, {no} AS rule_no, {q(r.key)} AS {key}, CAST(pattern_idx AS BIGINT)
          AS pattern_idx, text, CASE pattern_idx {match} END AS matched_text, {cols}
          FROM (SELECT *, CASE {idx} END AS pattern_idx FROM {source} WHERE ({context}) AND NOT ({stop}))
          WHERE pattern_idx IS NOT NULL""")
    return f"""
    SELECT *, {key} || '_' || pattern_idx AS {prefix}_id, {snippet('pos0', 'length(matched_text)', 100)} AS context
    FROM (SELECT *, strpos(text, matched_text) - 1 AS pos0 FROM ({' UNION ALL '.join(arms)}))"""


def snippet(at: str, n: str, around: int) -> str:
    lo, hi = f"greatest({at} - {around}, 0)", f"least({at} + {n} + {around}, length(text))"
    return (f"(CASE WHEN {lo} > 0 THEN '...' ELSE '' END || substr(text, {lo} + 1, {hi} - {lo}) || "
            f"CASE WHEN {hi} < length(text) THEN '...' ELSE '' END)")


def _risks(source: str) -> str:
    found = finds(RISK_RULES, f"(SELECT * FROM {source} WHERE word_count >= 10 AND NOT is_header)", "rule_key", "finding",
                  lambda r: {"risk_name": q(r.name), "risk_category": q(r.category), "risk_level": q(r.severity)})
    return (f"SELECT *, printf('risk-%03d', row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, rule_no) - 1) AS risk_id "
            f"FROM ({found})")


def _clauses() -> str:
    return finds(CLAUSE_RULES, "secs", "clause_key", "clause",
                 lambda r: {"clause_name": q(r.name), "importance": q(r.importance),
                            "is_boilerplate": str(r.boilerplate).lower(), "risk_factors": q(",".join(r.risk_factors))})


def _terms() -> str:
    arms = []
    for t_no, t in enumerate(LEGAL_TERMS):
        for w_no, w in enumerate(t.words):
            p = rf"\b{re.escape(w)}\b"
            arms.append(
                f"SELECT doc_id, section_id, text, {q(t.category)} AS category, {q(t.key)} AS term, {t_no} AS term_order, "
                f"{w_no} AS word_order, {q(t.importance)} AS importance, regexp_extract_all(text, {ci(p)}) AS found, "
                f"regexp_split_to_array(text, {ci(p)}) AS gaps FROM secs WHERE contains(lower(text), {q(w.lower())})")
    return f"""
    SELECT *, {snippet('position', 'length(matched_text)', 50)} AS context FROM (
      SELECT *, CAST(sum(length(gap)) OVER w + sum(length(matched_text)) OVER w - length(matched_text) AS BIGINT) AS position
      FROM (SELECT doc_id, section_id, text, category, term, term_order, word_order, importance,
                   unnest(range(len(found))) AS n, unnest(found) AS matched_text, unnest(gaps[1:len(found)]) AS gap
            FROM ({' UNION ALL '.join(arms)}) WHERE len(found) > 0)
      WINDOW w AS (PARTITION BY doc_id, section_id, term_order, word_order ORDER BY n ROWS UNBOUNDED PRECEDING))"""


def _metadata() -> str:
    scores = ", ".join(
        "(" + " + ".join(f"len(regexp_extract_all(lower(clean), {q(chr(92) + 'b' + w + chr(92) + 'b')}))" for w in ws)
        + f") AS s{i}" for i, ws in enumerate(CONTRACT_TYPES.values()))
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(CONTRACT_TYPES))) + ")"
    name = " ".join(f"WHEN s{i} = top THEN {q(n)}" for i, n in enumerate(CONTRACT_TYPES))
    scale = " ".join(f"WHEN s{i} = top THEN {2 * len(ws)}" for i, ws in enumerate(CONTRACT_TYPES.values()))
    both = (f"list_filter(flatten(list_transform(range(1, len(a) + 1), lambda i: [{strip('a[i]')}, {strip('b[i]')}])), "
            "lambda v: length(v) > 3)")
    return f"""
    SELECT doc_id, file_name, CASE WHEN contains(file_name, '.') THEN string_split(file_name, '.')[-1] ELSE 'txt' END AS file_type,
           round_even(strlen(clean) / 1024::DOUBLE, 2) AS file_size_kb,
           CAST(length(raw) - length(replace(raw, chr(12), '')) + 1 AS BIGINT) AS page_count, 'en' AS language,
           CAST({words('clean')} AS BIGINT) AS word_count,
           CASE WHEN top = 0 THEN 'general' {name} END AS contract_type,
           CASE WHEN top = 0 THEN 0.5::DOUBLE ELSE least(greatest(top::DOUBLE / CASE {scale} END, 0.5::DOUBLE), 0.95::DOUBLE) END
             AS contract_type_confidence,
           array_to_string({distinct_in_order('d')}[1:5], '|') AS dates, array_to_string({distinct_in_order('names')}[1:5], '|') AS parties
    FROM (SELECT *, {both} AS names, {top} AS top
          FROM (SELECT doc_id, file_name, text AS raw, clean, {scores}, regexp_extract_all(clean, {ci(DATE_PATTERN)}, 1) AS d,
                       regexp_extract_all(clean, {ci(PARTY_PATTERN)}, 1) AS a, regexp_extract_all(clean, {ci(PARTY_PATTERN)}, 2) AS b
                FROM clean))"""


def _extracted(source: str, text: str) -> str:
    arms = []
    for i, name in enumerate(EXTRACTION_TYPES):
        values = []
        for p in EXTRACTION_PATTERNS.get(name, ()):
            groups = (1, 2) if name == "parties" else (1,)
            whole = ", ".join(f"CASE WHEN {strip(f'regexp_extract({text}, {ci(p)}, {g})')} <> '' "
                              f"THEN regexp_extract({text}, {ci(p)}, {g}) END" for g in groups)
            values.append(f"WHEN regexp_matches({text}, {ci(p)}) THEN {strip(f'''concat_ws(' and ', {whole})''')}")
        value = f"CASE {' '.join(values)} END" if values else "NULL"
        arms.append(f"SELECT doc_id, {i} AS type_order, {q(name)} AS ext_type, {value} AS v, length({text}) AS chars FROM {source}")
    return (f"SELECT doc_id, type_order, ext_type, coalesce(v, '') AS value, CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END "
            f"AS confidence, CASE WHEN v IS NULL THEN 'none' ELSE 'pattern' END AS method, chars FROM ({' UNION ALL '.join(arms)})")


def _references(source: str) -> str:
    lists = " || ".join(f"regexp_extract_all(text, {ci(p)}, 1)" for p in REFERENCE_PATTERNS)
    return f"""
    SELECT r.doc_id, r.section_id, r.ref_pos, r.number AS section_number, {section_id('t.idx')} AS target_section_id
    FROM (SELECT doc_id, para_idx, section_id, unnest(range(len(l))) AS ref_pos, unnest(l) AS number
          FROM (SELECT *, {lists} AS l FROM {source})) r
    JOIN (SELECT doc_id, section_number, max(para_idx) AS idx FROM {source} WHERE section_number <> '' GROUP BY ALL) t
      ON t.doc_id = r.doc_id AND t.section_number = r.number AND t.idx <> r.para_idx"""


def _important(source: str) -> str:
    kinds = ", ".join(q(t) for t in SUMMARY_SECTION_TYPES)
    return f"""
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN total > 10 THEN by_length ELSE para_idx END) AS position
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total,
                 row_number() OVER (PARTITION BY doc_id ORDER BY word_count DESC, para_idx) AS by_length
          FROM {source} WHERE section_type IN ({kinds}) OR word_count > 100) WHERE by_length <= 10"""


def _section_summaries(source: str) -> str:
    return (f"SELECT i.doc_id, i.section_id, i.title, i.position, s.summary FROM {source} i JOIN ("
            + summarize(f"(SELECT doc_id || '/' || section_id AS sk, text FROM {source})", "sk")
            + ") s ON s.sk = i.doc_id || '/' || i.section_id WHERE s.summary <> ''")


def _overall() -> str:
    source = "(SELECT doc_id, body AS text FROM body)"
    return f"""
    SELECT m.doc_id, CASE WHEN m.contract_type = 'general' OR contains(lower(s), m.contract_type) THEN s
                     ELSE 'This ' || m.contract_type || ' agreement ' || lower(s[1]) || s[2:] END AS summary
    FROM meta m JOIN (SELECT doc_id, coalesce(nullif(summary, ''), 'Contract analysis could not generate a summary.') AS s
                      FROM (SELECT doc_id, coalesce(summary, '') AS summary FROM body LEFT JOIN ({summarize(source, 'doc_id')}) x
                            USING (doc_id))) USING (doc_id)"""


def _key_points(secs: str, extracted: str) -> str:
    kinds = ", ".join(q(t) for t in KEY_POINT_SECTION_TYPES)
    label = ("array_to_string(list_transform(string_split(ext_type, '_'), lambda w: upper(w[1]) || w[2:]), ' ')")
    return f"""
    SELECT doc_id, printf('point-%03d', row_number() OVER (PARTITION BY doc_id ORDER BY part, ord) - 1) AS point_id, category,
           description, importance, context, extracted_value FROM (
      SELECT doc_id, 0 AS part, type_order AS ord, ext_type AS category, {label} || ': ' || value AS description,
             'high' AS importance, '' AS context, value AS extracted_value FROM {extracted} WHERE value <> ''
      UNION ALL
      SELECT doc_id, 1, para_idx, 'section', 'Important ' || section_type || ' clause: ' || title, 'medium',
             CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END, title
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n FROM {secs} WHERE section_type IN ({kinds}))
      WHERE n <= 5)"""


def _metrics() -> str:
    return """
    SELECT m.doc_id, m.file_name AS filename, m.contract_type, m.contract_type_confidence AS confidence, 'success' AS status,
           coalesce(s.n, 0)::BIGINT AS sections_count, coalesce(r.n, 0)::BIGINT AS risks_count,
           coalesce(r.c, 0)::BIGINT AS unique_risk_categories, true AS has_summary, 6::BIGINT AS extracted_data_count,
           b.pii_types IS NOT NULL AS has_pii, 0::BIGINT AS errors, 0::BIGINT AS warnings
    FROM meta m JOIN body b USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM bsecs GROUP BY 1) s USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT risk_category) AS c FROM brisks GROUP BY 1) r USING (doc_id)"""


def _entities() -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, section_id, {q(n)} AS entity_type, unnest(list_distinct(regexp_extract_all(text, "
        f"{ci(p) if flag else q(p)}))) AS value FROM secs" for n, p, flag in ENTITY_PATTERNS)


# name -> (builder, names it reads); the b-prefixed family reads the redacted text
CTES = {
    "contracts": (duck_contracts, ()),
    "clean": (_clean, ("contracts",)),
    "docclean": (lambda: f"SELECT doc_id, text, {clean('text')} AS clean FROM documents", ()),
    "pii": (_pii, ("clean",)),
    "docpii": (lambda: _pii("docclean"), ("docclean",)),
    "body": (_body, ("clean", "pii")),
    "paras": (lambda: paras("clean", "clean"), ("clean",)),
    "bparas": (lambda: paras("body", "body"), ("body",)),
    "secs": (lambda: sections("paras"), ("paras",)),
    "bsecs": (lambda: sections("bparas"), ("bparas",)),
    "flat": (lambda: sections("paras", False), ("paras",)),
    "tree": (lambda: tree("secs"), ("secs",)),
    "risks": (lambda: _risks("secs"), ("secs",)),
    "brisks": (lambda: _risks("bsecs"), ("bsecs",)),
    "clauses": (_clauses, ("secs",)),
    "terms": (_terms, ("secs",)),
    "refs": (lambda: _references("secs"), ("secs",)),
    "brefs": (lambda: _references("bsecs"), ("bsecs",)),
    "btree": (lambda: tree("bsecs"), ("bsecs",)),
    "meta": (_metadata, ("clean",)),
    "extracted": (lambda: _extracted("clean", "clean"), ("clean",)),
    "bextracted": (lambda: _extracted("body", "body"), ("body",)),
    "important": (lambda: _important("secs"), ("secs",)),
    "bimportant": (lambda: _important("bsecs"), ("bsecs",)),
    "sums": (lambda: _section_summaries("important"), ("important",)),
    "bsums": (lambda: _section_summaries("bimportant"), ("bimportant",)),
    "overall": (_overall, ("body", "meta")),
    "points": (lambda: _key_points("secs", "extracted"), ("secs", "extracted")),
    "bpoints": (lambda: _key_points("bsecs", "bextracted"), ("bsecs", "bextracted")),
    "metrics": (_metrics, ("meta", "body", "bsecs", "brisks")),
    "entities": (_entities, ("secs",)),
}


def sql(select: str, *names: str, contracts: str | None = None) -> str:
    """`WITH` the named tables and everything they read, then the select; `contracts` reads other documents."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTES[name][1]:
                visit(other)
            order.append(name)

    for n in names:
        visit(n)
    with_list = ", ".join(f"{n} AS MATERIALIZED ({contracts if contracts and n == 'contracts' else CTES[n][0]()})" for n in order)
    return f"WITH {with_list} {select}" if order else select
