"""Personal data and legal entities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions.batches import holding, redacted_of
from clauselake.functions.text import between, let
from clauselake.rules.model import java_pattern
from clauselake.rules.privacy import ENTITY_PATTERNS, PII_PATTERNS

PII_TYPES = tuple(name for name, _, _ in PII_PATTERNS)
_MARK_OPEN, _MARK_CLOSE = "\ue000", "\ue001"
_DIGITS, _DIGIT_LETTERS = "0123456789", "ghijklmnop"
_TYPE_LETTERS = "ABCDEFGHI"

# The same language as the `name` pattern, with a possessive word loop: the JVM matcher then
# iterates instead of recursing, so a long run of capitalised words cannot exhaust a task's stack.
_JVM_FORM = {"name": r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+\b(?:\s+[A-Z][a-z]+\b)++"}
# What a match of a type begins with.  The matcher looks at it before it tests a word boundary, which costs far more.
_START = {"phone": r"[+(\d]", "ssn": r"\d", "credit_card": r"\d", "address": r"\d", "name": "[MDP]", "dob": r"\d",
          "passport": "[A-Z]", "financial_id": "[aArR]"}
# Types looked for in whole batches of texts before a text is searched.  A phone number or an address may begin with a
# sign after a letter beyond ASCII, where a batch sees no word boundary: of an address only the @ is looked for, and
# numbers, which nearly every text holds, are not.
_GATED = [(name, "@" if name == "email" else p, ci) for name, p, ci in PII_PATTERNS if name != "phone"]


def _jvm_pattern(name: str, pattern: str, ignore_case: bool) -> str:
    start = f"(?={_START[name]})" if name in _START else ""
    return java_pattern(start + _JVM_FORM.get(name, pattern), ignore_case)


def _all_values(text: Column, name: str, pattern: str, ignore_case: bool) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_jvm_pattern(name, pattern, ignore_case)), F.lit(0)))


def pii_values(text: Column, gated: bool = True) -> Column:
    """Array of (pii_type, values) for the types that occur, in redaction order; `gated` by a batch test."""
    held = holding(text, [(p, ci) for _, p, ci in _GATED]) if gated else None
    bits = {name: n for n, (name, _, _) in enumerate(_GATED)}

    def values(name, pattern, ignore_case):
        found = _all_values(text, name, pattern, ignore_case)
        if held is None or name not in bits:
            return found
        return F.when(held.bitwiseAND(F.lit(1 << bits[name])) != 0, found).otherwise(F.array().cast("array<string>"))

    groups = F.array(*[F.struct(F.lit(name).alias("pii_type"), values(name, p, ci).alias("values")) for name, p, ci in PII_PATTERNS])
    return F.filter(groups, lambda g: F.size(g["values"]) > 0)


def pii_type_names(groups: Column) -> Column:
    return F.transform(groups, lambda g: g["pii_type"])


def redaction_tag(pii_type: Column, value: Column) -> Column:
    return F.concat(F.lit("[REDACTED-"), pii_type, F.lit("-"), F.left(F.md5(value.cast("binary")), F.lit(8)), F.lit("]"))


def redact(text: Column, groups: Column) -> Column:
    """Replace every match of every type by its tag, type by type in declared order.

    A type's matches are looked up in what earlier types have left, in one
    linear pass.  They become markers without digits first, so that no later
    type can match inside an earlier replacement; a last pass spells them out.
    A value that also stands where its pattern does not match (inside a longer
    word) stays there.  Only the types of `groups`, the values of this text,
    are looked for: matches begin and end at word boundaries, so a marker makes
    no new one, and what earlier types have left holds no type that the text does not.
    """
    marked, types = text, pii_type_names(groups)
    for (name, pattern, ignore_case), code in zip(PII_PATTERNS, _TYPE_LETTERS):
        there = F.array_contains(types, F.lit(name))
        marked = let(marked, _marker_pass(_jvm_pattern(name, pattern, ignore_case), code, there))
    return F.when(F.size(groups) == 0, text).otherwise(let(marked, _spell_out))


def redacted(text: Column, replace: bool = True) -> Column:
    """(text, types, body): the types of personal data that a text holds and the redacted text, worked out for whole
    batches; both null where the text is the JVM's to search."""
    letters = str.maketrans(_DIGITS, _DIGIT_LETTERS)
    return redacted_of(text, list(PII_PATTERNS), _TYPE_LETTERS, _MARK_OPEN, _MARK_CLOSE, letters, replace)


def _marker_pass(pattern: str, code: str, there: Column):
    def mark(value: Column) -> Column:
        digest = F.translate(F.left(F.md5(value.cast("binary")), F.lit(8)), _DIGITS, _DIGIT_LETTERS)
        return F.concat(F.lit(_MARK_OPEN + code), digest, F.lit(_MARK_CLOSE))

    def run(t: Column) -> Column:
        return F.when(there, between(F.split(t, pattern), F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), mark))).otherwise(t)

    return run


def _spell_out(marked: Column) -> Column:
    pattern = f"{_MARK_OPEN}[A-I][a-p]{{8}}{_MARK_CLOSE}"
    pieces = F.split(marked, pattern)
    markers = F.regexp_extract_all(marked, F.lit(pattern), F.lit(0))

    def tag(marker):
        code = F.substring(marker, 2, 1)
        name = F
        for pii_type, letter in zip(PII_TYPES, _TYPE_LETTERS):
            name = name.when(code == letter, F.lit(pii_type))
        digits = F.translate(F.substring(marker, 3, 8), _DIGIT_LETTERS, _DIGITS)
        return F.concat(F.lit("[REDACTED-"), name, F.lit("-"), digits, F.lit("]"))

    return between(pieces, F.transform(markers, tag))


def legal_entities(text: Column) -> Column:
    """Map entity type -> distinct values, only for the types that occur.

    A text is searched for the types that a batch test holds; that test leaves out the last word boundary, which the
    JVM also sees before letters beyond ASCII.
    """
    held = holding(text, [(p.removesuffix(r"\b"), ci) for _, p, ci in ENTITY_PATTERNS])

    def values(n, pattern, ignore_case):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(java_pattern(pattern, ignore_case)), F.lit(0)))
        return F.when(held.bitwiseAND(F.lit(1 << n)) != 0, found).otherwise(F.array().cast("array<string>"))

    groups = F.array(*[F.struct(F.lit(name).alias("key"), values(n, p, ci).alias("value"))
                       for n, (name, p, ci) in enumerate(ENTITY_PATTERNS)])
    return F.map_from_entries(F.filter(groups, lambda g: F.size(g["value"]) > 0))


def encrypt(text: Column, key: Column | None) -> Column:
    """AES-GCM cipher text in base64; without a key the text stays as it is."""
    return text if key is None else F.base64(F.aes_encrypt(text, key, F.lit("GCM")))


def decrypt(cipher: Column, key: Column | None) -> Column:
    """Plain text; a value that does not decrypt becomes a marker instead of failing the job."""
    if key is None:
        return cipher
    plain = F.try_aes_decrypt(F.unbase64(cipher), key, F.lit("GCM")).cast("string")
    return F.when(cipher.isNotNull(), F.coalesce(plain, F.lit("[DECRYPTION ERROR]")))
