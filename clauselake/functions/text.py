"""Text cleaning and small scalar helpers as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.batches import BLANKS, clean_text  # noqa: F401  (cleaning is one of the text functions)

# Two blanks together, or one that is neither a space nor a line break.
_UNEVEN_BLANKS = r"[ \n\t\r\x0b\x0c](?:[ \n]|(?<=[\t\r\x0b\x0c]))"

# Characters whose ASCII spelling is not their base letter.
SPECIAL_ASCII = {
    "\u00a0": " ", "¡": "!", "¢": "C/", "£": "PS", "¥": "Y=", "¦": "|", "§": "SS", "¨": '"', "©": "(c)",
    "ª": "a", "«": "<<", "¬": "!", "\u00ad": "", "®": "(r)", "¯": "-", "°": "deg", "±": "+-", "²": "2",
    "³": "3", "´": "'", "µ": "u", "¶": "P", "·": "*", "¸": ",", "¹": "1", "º": "o", "»": ">>",
    "¿": "?", "×": "x", "÷": "/",
    "Æ": "AE", "æ": "ae", "Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Þ": "Th", "þ": "th", "ß": "ss",
    "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--", "‘": "'", "’": "'", "‚": ",", "‛": "'",
    "“": '"', "”": '"', "„": ",,", "†": "+", "‡": "++", "•": "*", "…": "...", "′": "'", "″": '"',
    "‹": "<", "›": ">", "€": "EUR", "™": "(tm)", "\u2003": " ", "\u2009": " ", "\u202f": " ",
}


# Spelling of Greek and Cyrillic small letters; capital letters are derived.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t y ph ch ps o".split()))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёєіїґ",
                    "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia io ie i i g".split()))
MARKS = "\u0300-\u036f"


def ascii_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """(from, to) strings for one-to-one characters and pairs for the rest.

    Accented and joined letters are derived from their Unicode decomposition.
    """
    letters = {k: v for table in (GREEK, CYRILLIC) for c, v in table.items() for k, v in ((c, v), (c.upper(), v.capitalize()))}
    spelled = {}
    for code in (*range(0x00C0, 0x0250), *range(0x0370, 0x0530)):
        if unicodedata.category(chr(code)).startswith("L"):
            parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
            plain = letters.get(chr(code)) or "".join(letters.get(c, c) for c in parts)
            if plain.isascii():
                spelled[chr(code)] = plain
    singles, many = {}, []
    for char, plain in (spelled | SPECIAL_ASCII).items():
        if len(plain) == 1:
            singles[char] = plain
        else:
            many.append((char, plain))
    return "".join(singles), "".join(singles.values()), many


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def word_count(text: Column) -> Column:
    """Number of blank-separated words; 0 for empty text.

    Where blanks stand alone they are counted by length; only other texts are split.
    """
    blanks = F.octet_length(text) - F.octet_length(F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit(" "), F.lit("")))
    ends = sum((f(text, F.lit(b)).cast("int") for f in (F.startswith, F.endswith) for b in (" ", "\n")), F.lit(0))
    inner = strip(text)
    apart = F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"\s+")))
    return F.when(text == "", F.lit(0)).when(text.rlike(_UNEVEN_BLANKS), apart).otherwise(blanks + 1 - ends)


def is_upper(text: Column) -> Column:
    return text.rlike("[A-Z]") & ~text.rlike("[a-z]")


# Letters of English text, the frequent ones first; what is not here is rare.
_FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def holds(text: Column, word: str) -> Column:
    """Whether lower-case `text` contains `word`.

    A search compares wherever the first letter stands, so the part of the
    word from its rarest letter on is looked for first; only where that is
    found is the whole word.
    """
    starts = range(max(1, len(word) - 2))
    rank = [_FREQUENT.find(c) if c in _FREQUENT else len(_FREQUENT) for c in word]
    tail = word[max(starts, key=lambda i: (rank[i], -i)):]
    whole = F.contains(text, F.lit(word))
    return whole if tail == word else F.contains(text, F.lit(tail)) & whole


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unfold(rows: DataFrame, keep: list, value: Column, *names: str) -> DataFrame:
    """A row for every element of a computed array or map, with its position first, or the element alone where one name
    is given and no element is null; an empty or missing array has none.

    From an inner generator the optimizer infers a filter on the size.  That filter moves down as far as it can, below
    `spread` into the few tasks of a scan, and works the whole array out there a first time.
    """
    generator = F.explode_outer if len(names) == 1 else F.posexplode_outer
    return rows.select(*keep, generator(value).alias(*names)).where(F.col(names[0]).isNotNull())


def is_ascii(text: Column) -> Column:
    """Pure ASCII has as many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def to_ascii(text: Column) -> Column:
    """ASCII spelling of Latin, Greek and Cyrillic letters and of common signs; what has no spelling stays as it is."""
    source, target, many = ascii_tables()

    def replaced(t, pairs):
        return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), pairs, t)

    latin = [p for p in many if not "\u0370" <= p[0] < "\u0530"]
    other = [p for p in many if "\u0370" <= p[0] < "\u0530"]

    def spell_out(t):
        longer = let(replaced(t, latin), lambda x: F.when(x.rlike("[\u0370-\u052f]"), replaced(x, other)).otherwise(x))
        return F.when(is_ascii(t), t).otherwise(F.regexp_replace(longer, f"[{MARKS}]", ""))

    return F.when(is_ascii(text), text).otherwise(let(F.translate(text, source, target), spell_out))


def between(pieces: Column, put: Column) -> Column:
    """The pieces of a split text, joined with what is put between them."""
    zipped = F.arrays_zip(pieces.alias("piece"), put.alias("put"))
    # the last piece has nothing after it; its null is skipped by the join
    return F.array_join(F.flatten(F.transform(zipped, lambda z: F.array(z["piece"], z["put"]))), "")


def strip_tags(html: Column) -> Column:
    return F.coalesce(F.regexp_replace(html, r"<[^>]+>", ""), F.lit(""))


def truncate(text: Column, max_length: int = 100, add_ellipsis: bool = True) -> Column:
    cut = rstrip(F.left(text, F.lit(max_length)))
    if add_ellipsis:
        cut = F.concat(cut, F.lit("..."))
    return F.when(F.length(text) <= max_length, text).otherwise(cut)


def hash_text(text: Column, algorithm: str = "sha256") -> Column:
    name = algorithm.lower()
    if name == "md5":
        return F.md5(text.cast("binary"))
    if name == "sha1":
        return F.sha1(text.cast("binary"))
    return F.sha2(text.cast("binary"), 256)


def unique_id(content: Column, prefix: str = "", length: int = 8) -> Column:
    """Content-derived identifier: the same content always gets the same id."""
    part = F.left(F.sha2(content.cast("binary"), 256), F.lit(length))
    return F.concat(F.lit(prefix + "-"), part) if prefix else part


def format_timestamp(value: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Reformat an ISO string; text that is no timestamp is returned unchanged, null means now."""
    shown = F.coalesce(F.date_format(F.try_to_timestamp(value), fmt), value)
    return F.coalesce(shown, F.date_format(F.current_timestamp(), fmt))


def merge_maps(left: Column, right: Column, levels: int = 1) -> Column:
    """Merge two maps key by key, the right side winning; nested maps merge `levels` deep."""

    def pick(_, a, b):
        if levels > 1:
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge_maps(a, b, levels - 1))
        return F.coalesce(b, a)

    return F.map_zip_with(left, right, pick)


def prefix_folds(values: Column, fold, zero: int, block: int = 512) -> Column:
    """`fold` of all earlier elements, per element, of an integer array; `zero` where there are none.

    Whole blocks are folded first, so a very long array does not cost the square of its length.
    """

    def total(arr):
        return F.aggregate(arr, F.lit(zero), fold)

    def running(arr, start):
        seed = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            arr, seed,
            lambda acc, x: F.struct(fold(acc["sum"], x).alias("sum"),
                                    F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
            lambda acc: acc["out"])

    def cut(arr):
        return F.transform(F.sequence(F.lit(1), F.size(arr), F.lit(block)), lambda s: F.slice(arr, s, block))

    def blocks(parts):
        offsets = running(F.transform(parts, total), F.lit(zero))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), offsets.alias("start")),
                                     lambda z: running(z["part"], z["start"])))

    return let(values, lambda arr: F.when(F.size(arr) == 0, F.array().cast("array<int>"))
               .when(F.size(arr) <= block, running(arr, F.lit(zero)))
               .otherwise(let(cut(arr), blocks)))


def prefix_sums(values: Column, block: int = 512) -> Column:
    """Sum of all earlier elements, per element, of an integer array."""
    return prefix_folds(values, lambda a, x: a + x, 0, block)


def runs(rows: Column, same) -> Column:
    """The slices of a sorted array whose neighbours are the same by `same(a, b)`, in linear time."""

    def cut(arr):
        marks = F.filter(F.transform(arr, lambda x, i: F.when((i == 0) | ~same(F.get(arr, i - 1), x), i)), lambda i: i.isNotNull())
        return let(marks, lambda at: F.transform(at, lambda a, k: F.slice(arr, a + 1, F.coalesce(F.get(at, k + 1), F.size(arr)) - a)))

    return let(rows, cut)
