"""Secret scans with multipart credential linking, with DataFrame functions only.

Certain kinds (assignments, access keys, long hex) are reported as they are.
Weak parts - client ids, bare 40-character keys, endpoints - are reported only
when parts that complete them lie in the same scope: the parts are cut into
cells as long as the scope and joined on equal cells, then by distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import let, prefix_folds, prefix_sums
from clauselake.llm.shared import written

ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CLIENT = r"(?i)(?:client|account|access|app)[_-]?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{6,}"
BARE = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+[A-Za-z0-9]"

BASE_KINDS = ("assign", "access", "hex")
# what each weak kind needs in its scope
NEEDS = {"client": ("key",), "bare": ("id",), "endpoint": ("id", "key")}
ROLE = {"assign": "key", "access": "id", "hex": None, "client": "id", "bare": "key", "endpoint": "place"}
SCOPE = 200
BLOCK = 1024

SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _spans(text: Column, guard: Column, pattern: str, kind: str, valid=None) -> Column:
    """Spans (code points, end exclusive) of the leftmost matches that are valid, read off the gaps between matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(found: Column) -> Column:
        # each array is bound once: inside the lambdas it would be worked out again for every match
        def step(gaps: Column) -> Column:
            return F.transform(found, lambda m, i: (F.get(gaps, i) + F.char_length(m)).cast("int"))

        def spans(gaps: Column, steps: Column, before: Column) -> Column:
            return F.transform(found, lambda m, i: F.struct(
                (F.get(before, i) + F.get(gaps, i)).alias("start"), (F.get(before, i) + F.get(steps, i)).alias("end"),
                F.lit(list(ROLE).index(kind)).alias("rank"), F.lit(kind).alias("kind"), m.alias("found")))

        return let(F.transform(F.split(text, pattern, -1), F.char_length), lambda gaps: let(step(gaps), lambda steps: let(
            prefix_sums(steps), lambda before: spans(gaps, steps, before))))

    placed = let(matches, lambda found: F.when(F.size(found) > 0, place(found)))
    if valid is not None:
        placed = F.filter(placed, lambda s: valid(s["found"]))
    bare = F.transform(placed, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "rank", "kind")]))
    return F.coalesce(F.when(guard, bare), F.array().cast(SPAN)).alias(kind)


def parts(text: Column) -> list[Column]:
    """One array of spans for each kind; cheap tests guard the costlier patterns."""
    word = text.rlike(r"(?i)passw|secret|token|api_?key")
    return [
        _spans(text, word, ASSIGN, "assign", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 6),
        _spans(text, text.contains("AKIA"), ACCESS, "access"),
        _spans(text, text.rlike(HEX), HEX, "hex"),
        _spans(text, text.rlike(r"(?i)_?-?id[\"']?\x20*[:=]"), CLIENT, "client"),
        _spans(text, text.rlike(BARE), BARE, "bare", lambda m: (F.char_length(m) == 40) & m.rlike("[0-9]") & m.rlike("[A-Z]")
               & m.rlike("[a-z]")),
        _spans(text, text.contains("http"), ENDPOINT, "endpoint"),
    ]


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """owner, mark and the weak spans that are complete."""
    weak = F.concat("client", "bare", "endpoint")
    strong = F.concat("assign", "access")
    several = (F.size(weak) > 0) & (F.size(weak) + F.size(strong) > 1)
    rows = found.where(several).select("owner", "mark", F.explode(F.concat(strong, weak)).alias("s"))
    roles = F.create_map(*[F.lit(x) for k, v in ROLE.items() if v for x in (k, v)])
    each = rows.distinct().select("owner", "mark", "s", F.element_at(roles, F.col("s.kind")).alias("role"))
    cells = F.sequence(F.floor(F.col("s.start") / scope) - 1, F.floor(F.col("s.end") / scope) + 1)
    asking = each.where(F.col("s.kind").isin(*NEEDS)).withColumn("cell", F.explode(cells))
    # a part stands in every cell it covers: a weak part may lie in the middle of a long one
    held = F.sequence(F.floor(F.col("s.start") / scope), F.floor(F.col("s.end") / scope))
    giving = (each.where("role != 'place'").withColumn("cell", F.explode(held))
        .select("owner", "mark", "cell", F.col("role").alias("gives"), F.col("s.start").alias("from"), F.col("s.end").alias("to"),
                F.col("s.kind").alias("by")))
    near = ((F.col("from") - F.col("s.end") <= scope) & (F.col("s.start") - F.col("to") <= scope)
            & ~((F.col("by") == F.col("s.kind")) & (F.col("from") == F.col("s.start"))))
    met = (asking.join(giving, ["owner", "mark", "cell"]).where(near)
           .groupBy("owner", "mark", "s").agg(F.collect_set("gives").alias("got")))
    complete = reduce(lambda a, b: a | b, [(F.col("s.kind") == k) & reduce(lambda a, b: a & b, [
        F.array_contains("got", need) for need in needs]) for k, needs in NEEDS.items()])
    return met.where(complete).groupBy("owner", "mark").agg(F.collect_list("s").alias("weak"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, mark, and sorted spans of every row: `assign`, `access`, `hex` and the completed weak ones, `weak`.

    A weak span is complete if all it needs lies within `scope` code points.
    Null and empty texts have no spans.  Rows that repeat an id are told apart
    by `mark`, a hash of the text.  Null ids are kept.  Other columns are not
    read.  Texts are scanned once; only spans are written and joined.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found = written(rows.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("owner"), F.xxhash64(text).alias("mark"), *parts(text)),
                    "secret-parts")
    return (found.join(_linked(found, scope), ["owner", "mark"], "left")
            .select(F.col("id").alias(id_col), "mark", *BASE_KINDS, F.coalesce("weak", F.array().cast(SPAN)).alias("weak")))


def in_order(*spans: str) -> Column:
    """All spans by start, then kind as listed."""
    return F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _islands(spans: Column) -> Column:
    """Start and end of what sorted spans cover; spans that touch are one."""

    def apart(reach: Column) -> Column:
        """Where a span starts that begins beyond all before it, and how far those reach."""
        marked = F.transform(spans, lambda s, i: F.when(s["start"] > F.get(reach, i), F.struct(
            s["start"].alias("start"), F.get(reach, i).alias("before"))))
        return F.filter(marked, lambda m: m.isNotNull())

    def closed(marks: Column) -> Column:
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.transform(marks, lambda m, i: F.struct(
            m["start"].alias("start"), F.coalesce(F.get(marks, i + 1)["before"], last).alias("end")))

    ends = F.transform(spans, lambda s: s["end"])
    return let(prefix_folds(ends, lambda a, x: F.greatest(a, x), -1), lambda reach: let(apart(reach), closed))


def _masked(text: Column, islands: Column, mask: str) -> Column:
    """`text` with each island replaced: cut once into blocks, so that a piece costs what it is long."""

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        part = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(part, start - first * BLOCK + 1, end - start)).otherwise("")

    def joined(blocks: Column, found: Column) -> Column:
        before = F.transform(found, lambda s, i: piece(blocks, F.when(i == 0, 0).otherwise(F.get(found, i - 1)["end"]), s["start"]))
        rest = piece(blocks, F.get(found, F.size(found) - 1)["end"], F.char_length(text))
        return F.concat(F.array_join(before, mask), F.lit(mask), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(blocks, lambda cut: let(islands, lambda found: joined(cut, found)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """The rows of `docs` with every reported span replaced; spans that overlap or touch become one mask.

    Null and empty texts stay, rows that repeat stay, columns of any name stay as they are.
    """
    spans = (scan(docs, id_col, text_col, scope).select(F.col(id_col).alias("owner"), "mark", in_order(*BASE_KINDS, "weak").alias("spans"))
             .where(F.size("spans") > 0).dropDuplicates(["owner", "mark"]))
    text = F.col("row")[text_col]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(spans, F.col("row")[id_col].cast("bigint").eqNullSafe(F.col("owner"))
                       & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("mark")), "left")
    clean = F.when(F.col("spans").isNull(), text).otherwise(_masked(text, _islands(F.col("spans")), mask))
    return joined.select(*[(clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
