"""DuckDB SQL with the same rows as the registered queries, where SQL can express them."""

from clauselake.llm import chat, secrets

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > c.keeper, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_formatting(template: chat.Template = chat.DEFAULT) -> str:
    """Turn by turn: the length of markers and escaped texts, and which role stands before each."""
    escaped = r"replace(text, '\', '\\')"
    for c in template.controls:
        escaped = f"replace({escaped}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    other = template.turns[chat.OTHER]
    named = [(r, t) for r, t in template.turns.items() if r != chat.OTHER]
    marks = " ".join(f"WHEN {_quoted(r)} THEN {len(t.before) + len(t.after)}" for r, t in named)
    loss = ", ".join(_quoted(r) for r, t in named if t.loss)
    pairs = ", ".join(_quoted(f"{a}>{b}") for a, bs in template.follow.items() for b in bs)
    says = "'</s>[INST] ok [/INST]'"
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', {says}), (-7, 1, 'assistant', {says})),
    e AS (SELECT *, length({escaped}) + CASE role {marks} ELSE {len(other.before) + len(other.after) + 2} + 2 * strlen(role) END AS n,
                 lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) || '>' || role AS pair FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
      sum(n)::BIGINT AS formatted_chars, bool_and(pair IN ({pairs})) AS valid
    FROM e GROUP BY conv_id"""


def secret_scans(scope: int = secrets.SCOPE) -> str:
    """Every kind's matches with their places, and weak ones joined to what completes them by distance."""
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "client": secrets.CLIENT, "bare": secrets.BARE,
                "endpoint": secrets.ENDPOINT}
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, {_quoted(p)}) AS m, regexp_split_to_array(t, {_quoted(p)}) AS g "
        f"FROM d WHERE regexp_matches(t, {_quoted(p)})" for i, (k, p) in enumerate(patterns.items()))
    role = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in secrets.ROLE.items() if r) + " END"
    needs = " ".join(f"WHEN '{k}' THEN " + " AND ".join(f"bool_or(b.role = '{n}')" for n in need) for k, need in secrets.NEEDS.items())
    base = ", ".join(f"'{k}'" for k in secrets.BASE_KINDS)
    span = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE_KINDS)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
    u AS (SELECT doc_id, rank, kind, unnest(m) AS x, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS n FROM f),
    p AS (SELECT *, sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, rank ORDER BY n) AS stop FROM u),
    s AS (SELECT doc_id, rank, kind, (stop - length(x))::BIGINT AS start, stop::BIGINT AS stop, {role} AS role FROM p WHERE CASE kind
            WHEN 'assign' THEN length(regexp_extract(x, {_quoted(secrets.ASSIGN)}, 1)) >= 6
            WHEN 'bare' THEN length(x) = 40 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')
            ELSE true END),
    w AS (SELECT a.doc_id, a.rank, a.kind, a.start, a.stop FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.start - a.stop <= {scope}
            AND a.start - b.stop <= {scope} AND NOT (a.kind = b.kind AND a.start = b.start)
          WHERE a.kind NOT IN ({base}) AND b.role IN ('id', 'key') GROUP BY ALL HAVING CASE a.kind {needs} END),
    r AS (SELECT doc_id, rank, kind, start, stop FROM s WHERE kind IN ({base}) UNION ALL SELECT * FROM w)
    SELECT d.doc_id, {counts.replace('count(*)', 'count(r.kind)')},
      sha256(coalesce(string_agg({span}, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
      coalesce(string_agg({span}, ',' ORDER BY start, rank, stop), '') AS spans
    FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id"""


RANKED_SEARCH = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
f AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM n, s),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s WHERE term IN (SELECT term FROM q)
      GROUP BY term, docs),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20
"""


SQL = {"op13_ranked_search": RANKED_SEARCH, "op4_chat_formatting": chat_formatting(), "op6_line_dedup": LINE_DEDUP, "op8_secret_scans": secret_scans()}
