"""Documents -> paragraphs -> sections.

Everything that a section needs from its own text is computed on the exploded
row.  The columns that look at neighbouring sections (parent, offsets, children)
are arrays of the document's row before that.  Neither needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.batches import first_of, holding, outline_of, paragraph_count, paragraphs_of, sections_of, trees_of, words_of
from clauselake.functions.text import holds, is_ascii, is_upper, let, unfold, word_count
from clauselake.rules.model import java_pattern
from clauselake.rules.vocab import HEADER_PATTERNS, SECTION_TYPES

MIN_PARAGRAPH = 10
# The characters that a paragraph of each header shape can begin with.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEADER_STARTS = {"numbered": "0123456789", "roman": "IVX", "alphabetical": _CAPITALS, "titled": _CAPITALS,
                 "article": "aAsS", "schedule": "sSaAeE"}
# Lines folded before their results are put aside.
BLOCK = 512


def paragraph_array(text: Column) -> Column:
    return paragraphs_of(text, MIN_PARAGRAPH)


def foreign_paragraphs(text: Column) -> Column:
    """The paragraphs of texts beyond ASCII, null for the others, which batches describe."""
    return paragraph_array(F.when(~is_ascii(text), text))


def count_paragraphs(text: Column) -> Column:
    return paragraph_count(text, MIN_PARAGRAPH)


def header_shapes() -> list[tuple[str, str, str, bool]]:
    return [(name, HEADER_STARTS[name], pattern, ignore_case) for name, pattern, ignore_case in HEADER_PATTERNS]


def paragraphs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per kept paragraph; positions count kept paragraphs only."""
    rows = docs.select(id_col, *keep, paragraph_array(F.col(text)).alias("ps"))
    return unfold(rows, [id_col, *keep], F.col("ps"), "para_idx", "text")


def section_id(idx: Column) -> Column:
    return F.format_string("sec-%03d", idx)


def indicator_words(words: list[str]) -> list[str]:
    """Words that are not implied by a shorter word of the same list."""
    return [w for w in words if not any(o != w and o in w for o in words)]


def type_words() -> dict[str, list[str]]:
    return {name: indicator_words(words) for name, words in SECTION_TYPES.items()}


def section_type(text: Column, low: Column, words_in_text: Column) -> Column:
    """`low` (the lower-case text) and the word count are columns: an expression repeated in
    every branch would be evaluated once per indicator word."""
    chain = F
    for name, words in SECTION_TYPES.items():
        hit = F.lit(False)
        for n, w in enumerate(indicator_words(words)):
            hit = holds(low, w) if n == 0 else hit | holds(low, w)
        chain = chain.when(hit, F.lit(name))
    return chain.when((words_in_text < 10) & is_upper(text), F.lit("header")).otherwise(F.lit("clause"))


def typed(text: Column, type_no: Column, words_in_text: Column) -> Column:
    """`section_type` where the first type whose words occur is known by its number."""
    names = F.array(*[F.lit(name) for name in SECTION_TYPES])
    return (F.when(type_no.isNotNull(), F.element_at(names, type_no + 1))
            .when((words_in_text < 10) & is_upper(text), F.lit("header")).otherwise(F.lit("clause")))


def held_headers(text: Column) -> Column:
    """The header patterns that may fit, as a column that `header_kind` takes."""
    return holding(text, [(pattern.removesuffix("$") + r"\n?$", ignore_case) for _, pattern, ignore_case in HEADER_PATTERNS])


def header_kind(text: Column, held: Column | None = None) -> Column:
    """Name of the first header pattern that fits the whole paragraph, else null.

    The matcher would try an anchored pattern at every place of the text, so the first character is looked at before,
    and the patterns that may fit, where they are known.
    """
    chain, first = F, F.left(text, F.lit(1))
    for n, (name, pattern, ignore_case) in enumerate(HEADER_PATTERNS):
        fits = first.isin(*HEADER_STARTS[name]) & text.rlike(java_pattern(pattern, ignore_case))
        if held is not None:
            fits = (held.bitwiseAND(F.lit(1 << n)) != 0) & fits
        chain = chain.when(fits, F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


def header_group(text: Column, kind: Column, group: int) -> Column:
    chain = F
    for name, pattern, ignore_case in HEADER_PATTERNS:
        chain = chain.when(kind == name, F.regexp_extract(text, java_pattern(pattern, ignore_case), group))
    return chain.otherwise(F.lit(None).cast("string"))


def header_parts(t: Column, kind: Column, words: Column, number: Column, hierarchical: bool) -> tuple[Column, Column, Column]:
    """(is_header, level, title guessed from a paragraph that fits no pattern)."""
    # words are looked at last: they cost most where they are counted on the spot
    if not hierarchical:
        caps = kind.isNull() & is_upper(t) & (words <= 5)
        return kind.isNotNull() | caps, F.lit(0), F.when(caps, t)
    caps = kind.isNull() & is_upper(t) & (F.length(t) > 3) & (words <= 10)
    colon = kind.isNull() & F.endswith(t, F.lit(":")) & (words <= 5) & ~caps
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    level = (F.when(kind == "numbered", dots + 1).when(kind.isin("article", "roman"), 1)
             .when(kind == "alphabetical", 2).when(colon, 1).otherwise(0))
    return kind.isNotNull() | caps | colon, level.cast("int"), F.when(caps, t).when(colon, F.rtrim(t, F.lit(":")))


def attributes(rows: DataFrame, hierarchical: bool, keep: list[str]) -> DataFrame:
    """What a paragraph (para_idx, text) tells about itself: type, heading, number, title, length."""
    t = F.col("text")
    # worked out for whole batches of paragraphs, and only if they are asked for
    rows = rows.withColumns({"word_count": words_of(t), "type_no": first_of(t, [indicator_words(w) for w in SECTION_TYPES.values()]),
                             "held": held_headers(t)})
    rows = rows.withColumn("kind", header_kind(t, F.col("held")))
    kind, words = F.col("kind"), F.col("word_count")
    rows = rows.withColumn("section_number", header_group(t, kind, 1))
    is_header, level, guess = header_parts(t, kind, words, F.col("section_number"), hierarchical)
    rows = rows.withColumns({"is_header": is_header, "guess": F.coalesce(header_group(t, kind, 2), guess)})
    return rows.select(
        *keep, "para_idx", section_id(F.col("para_idx")).alias("section_id"),
        F.coalesce(F.nullif("guess", F.lit("")), F.concat(F.lit("Section "), (F.col("para_idx") + 1).cast("string")))
        .alias("title"),
        "text", typed(t, F.col("type_no"), words).alias("section_type"), "is_header", "section_number",
        level.alias("level"), "word_count")


def sections(docs: DataFrame, hierarchical: bool = True, text: str = "text", id_col: str = "doc_id",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Section rows without neighbour columns: narrow, shuffle-free."""
    return attributes(paragraphs(docs, text, id_col, keep), hierarchical, [id_col, *keep])


def outline(paras: Column, hierarchical: bool) -> Column:
    """Per paragraph whether it is a heading, its level and its number."""

    def of(p, i):
        def parts(kind):
            number = F.when(kind == "numbered", header_group(p, kind, 1))
            is_header, level, _ = header_parts(p, kind, word_count(p), number, hierarchical)
            return F.struct(is_header.alias("is_header"), level.alias("level"), i.alias("idx"))

        return let(header_kind(p), parts)

    return F.transform(paras, of)


def parents(outline: Column) -> Column:
    """Index of the parent of each line of an outline, or null.

    A fold with a stack of open headings, of any depth: a heading closes those
    of its level and below and belongs to the one left on top; content belongs
    to the last heading.  Results are gathered per block, so that a very long
    document does not cost the square of its lines.
    """
    empty = F.array().cast("array<struct<level:int,idx:int>>")

    def top(stack):
        return F.get(stack, F.size(stack) - 1)["idx"]

    def step(acc, x):
        above = F.when(x["is_header"], F.filter(acc["stack"], lambda h: h["level"] < x["level"])).otherwise(acc["stack"])
        more = F.concat(above, F.array(F.struct(x["level"].alias("level"), x["idx"].alias("idx"))))
        return F.struct(F.when(x["is_header"], more).otherwise(acc["stack"]).alias("stack"),
                        F.concat(acc["out"], F.array(top(above))).alias("out"))

    def block(lines, acc, start):
        begin = F.struct(acc["stack"].alias("stack"), F.array().cast("array<int>").alias("out"))
        done = F.aggregate(F.slice(lines, start, BLOCK), begin, step)
        return let(done, lambda d: F.struct(d["stack"].alias("stack"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def folded(lines):
        start = F.struct(empty.alias("stack"), F.array().cast("array<array<int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(lines), F.lit(BLOCK)), start, lambda acc, s: block(lines, acc, s),
                           lambda acc: F.flatten(acc["out"]))

    # bound once: inside the fold the outline would be worked out again for each block
    return let(outline, lambda lines: F.when(F.size(lines) == 0, F.array().cast("array<int>")).otherwise(folded(lines)))


def children(parent: Column) -> Column:
    """Indexes of the children of each line, given every line's parent.

    Lines and child entries are sorted into one array, where each line stands
    before its children; the places of the lines bound the children's slices.
    """
    none = F.array().cast("array<array<int>>")

    def cut(entries):
        marks = F.filter(F.transform(entries, lambda e, i: F.when(e["idx"] < 0, i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(marks, 2, F.size(marks)), F.array(F.size(entries)))
        return F.transform(F.arrays_zip(marks.alias("a"), ends.alias("b")), lambda z: F.transform(
            F.slice(entries, z["a"] + 2, z["b"] - z["a"] - 1), lambda e: e["idx"]))

    lines = F.transform(parent, lambda p, i: F.struct(i.alias("parent"), F.lit(-1).alias("idx")))
    kids = F.filter(F.transform(parent, lambda p, i: F.struct(p.alias("parent"), i.alias("idx"))), lambda k: k["parent"].isNotNull())
    return F.when(F.size(parent) == 0, none).otherwise(let(F.array_sort(F.concat(lines, kids)), cut))


def segment(docs: DataFrame, hierarchical: bool = True, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The full section table: attributes, parent, offsets and children.

    The tree is worked out for the documents of an Arrow batch, before sections
    become rows, so no exchange is planned.  Offsets count in the text that joins the
    paragraphs with blank lines; `ref_*` keep the numbers of the original
    hierarchical mode, which counts every separator twice.
    """
    rows = docs.select(id_col, outline_of(F.col(text), MIN_PARAGRAPH, header_shapes() if hierarchical else None).alias("lines"))
    each = unfold(rows, [id_col], F.col("lines"), "para_idx", "z").select(id_col, "para_idx", "z.*")
    place = [id_col, "chars", "parent", "kids"]
    size, idx, chars = F.length("text"), F.col("para_idx"), F.col("chars")
    out = attributes(each, hierarchical, place).withColumns({
        "start_char": chars + 2 * idx,
        "end_char": chars + size + 2 * idx,
        "ref_start_char": F.when(idx > 0, chars + 4 * idx - 2).otherwise(0),
        "ref_end_char": chars + size + 4 * idx,
        "parent_id": F.when(F.col("parent").isNotNull(), section_id(F.col("parent"))),
        "children_ids": F.transform("kids", section_id)}).drop("chars", "parent", "kids")
    return out if hierarchical else out.drop("ref_start_char", "ref_end_char")


def section_array(paras: Column, hierarchical: bool) -> Column:
    """Per paragraph its text, length, title and type, as an array of the document's row."""

    def basics(p, i):
        return F.struct(i.alias("idx"), p.alias("text"), F.lower(p).alias("low"), word_count(p).alias("words"),
                        header_kind(p).alias("kind"))

    def finish(s):
        p, kind = s["text"], s["kind"]
        _, _, guess = header_parts(p, kind, s["words"], F.lit(""), hierarchical)
        title = F.nullif(F.coalesce(header_group(p, kind, 2), guess), F.lit(""))
        return F.struct(
            s["idx"].alias("idx"), p.alias("text"), s["words"].alias("words"),
            F.coalesce(title, F.concat(F.lit("Section "), (s["idx"] + 1).cast("string"))).alias("title"),
            section_type(p, s["low"], s["words"]).alias("type"))

    return F.transform(F.transform(paras, basics), finish)


def section_column(text: Column, hierarchical: bool, foreign: Column) -> Column:
    """`section_array` of whole texts; `foreign` is a column of their `foreign_paragraphs`."""
    return F.coalesce(batch_sections(text, hierarchical), section_array(foreign, hierarchical))


def batch_sections(text: Column, hierarchical: bool) -> Column:
    """`section_array` of whole texts, null beyond ASCII."""
    return sections_of(text, MIN_PARAGRAPH, hierarchical, header_shapes(), type_words())


def tree_column(text: Column, hierarchical: bool, foreign: Column) -> Column:
    """`section_tree` of whole texts; `foreign` is a column of their `foreign_paragraphs`."""
    one_by_one = section_tree(section_array(foreign, hierarchical), hierarchical)
    return F.coalesce(trees_of(text, MIN_PARAGRAPH, hierarchical, header_shapes(), type_words()), F.when(foreign.isNotNull(), one_by_one))


def section_tree(secs: Column, hierarchical: bool = True) -> Column:
    """The section table of one document as an array, from its `section_array`: what `segment` says of each section,
    offsets left out, without leaving the document's row."""

    def whole(paras, lines):
        def zipped(parent, kids):
            return F.transform(secs, lambda s, i: F.struct(
                i.alias("para_idx"), section_id(i).alias("section_id"), s["title"].alias("title"), s["text"].alias("text"),
                s["type"].alias("section_type"), F.get(lines, i)["is_header"].alias("is_header"), F.get(lines, i)["level"].alias("level"),
                (F.when(F.get(parent, i).isNotNull(), section_id(F.get(parent, i)))).alias("parent_id"),
                F.transform(F.get(kids, i), section_id).alias("children_ids")))

        if not hierarchical:
            none = F.transform(paras, lambda p: F.lit(None).cast("int"))
            return zipped(none, F.transform(paras, lambda p: F.array().cast("array<int>")))
        return let(parents(lines), lambda parent: let(children(parent), lambda kids: zipped(parent, kids)))

    texts = F.transform(secs, lambda s: s["text"])
    return let(texts, lambda paras: let(outline(paras, hierarchical), lambda lines: whole(paras, lines)))
