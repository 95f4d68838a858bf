"""Column functions that read the texts of an Arrow batch at once.

Spark partitions the rows and bounds a batch by rows and bytes.  A pattern of
many words costs one pass here, where a search in the JVM costs one per word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, wraps
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
# Characters that cleaning spells in ASCII or blanks out, whatever stands around them.
FOREIGN = r"[^\x20-\x7e\t\n\r]"
# Bytes of text worked on at once, so that what a worker holds beside its batch is bounded.
SLICE_BYTES = 1 << 21


def in_slices(work: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """A function of texts, applied to slices of a batch that hold about `SLICE_BYTES` each, or one text."""
    @wraps(work)
    def run(texts: pa.Array) -> pa.Array:
        _, ends = bytes_of(texts)
        if ends[-1] <= SLICE_BYTES:
            return work(texts)
        cuts, at = [0], 0
        while at < len(texts):
            at = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
            cuts.append(at)
        return pa.concat_arrays([work(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    return run


def changed(texts: pa.Array, where: str, change) -> pa.Array:
    """The texts, those that hold the pattern `where` changed."""
    hit = pc.match_substring_regex(texts, where)
    if hit.true_count == 0:
        return texts
    done = change(texts.filter(hit))
    return done if hit.true_count == len(texts) else pc.replace_with_mask(texts, hit, done)


def replaced(pattern: str, by: str):
    return lambda texts: pc.replace_substring_regex(texts, pattern, by)


@cache
def _spelling() -> dict:
    from clauselake.functions.text import MARKS, ascii_tables

    source, target, many = ascii_tables()
    first, last = MARKS.split("-")
    marks = {chr(c): "" for c in range(ord(first), ord(last) + 1)}
    controls = {chr(c): " " for c in (*range(0x20), 0x7F) if chr(c) not in "\t\n\r"}
    return str.maketrans({**marks, **controls, **dict(zip(source, target)), **dict(many)})


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts without nulls, and where in them the texts begin and the last one ends."""
    whole = texts.cast(pa.large_string())
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def respelled(texts: pa.Array, begins: np.ndarray, stops: np.ndarray, spell: Callable[[bytes], bytes]) -> pa.Array:
    """The texts with the runs of bytes from `begins` to `stops`, in order, spelled anew; each different run is spelled once."""
    chars, ends = bytes_of(texts)
    data, known, pieces, done = chars.tobytes(), {}, [], 0
    grown = np.zeros(len(begins) + 1, np.int64)
    for n, (begin, stop) in enumerate(zip(begins.tolist(), stops.tolist())):
        run = data[begin:stop]
        if run not in known:
            known[run] = spell(run)
        pieces += (data[done:begin], known[run])
        grown[n + 1] = len(known[run]) - len(run)
        done = stop
    pieces.append(data[done:])
    moved = ends + np.cumsum(grown)[np.searchsorted(begins, ends, "left")]
    out = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(b"".join(pieces)))
    return out.cast(pa.string())


def spelled(texts: pa.Array) -> pa.Array:
    """ASCII spelling where there is one, a blank for control characters.

    The runs of such characters are found in all texts at once.
    """
    chars, ends = bytes_of(texts)
    odd = (chars > 0x7E) | ((chars < 0x20) & (chars != 9) & (chars != 10) & (chars != 13))
    at = np.flatnonzero(odd)
    if not len(at):
        return texts
    apart = np.diff(at) > 1
    bounds = ends[1:-1]
    apart |= np.diff(np.searchsorted(bounds, at, "right")) > 0
    begins, stops = at[np.concatenate([[True], apart])], at[np.concatenate([apart, [True]])] + 1
    table = _spelling()
    return respelled(texts, begins, stops, lambda run: run.decode("utf-8", "replace").translate(table).encode())


def cleaned(texts: pa.Array) -> pa.Array:
    """See `clean_text`."""
    def page_numbers(t):
        return replaced(r"\n\s*(?i:Page)\s+\d+\s+(?i:of)\s+\d+\s*\n", "\n")(replaced(r"\n\s*\d+\s*\n", "\n")(t))

    out = changed(texts.fill_null(""), FOREIGN, spelled)
    out = changed(out, " {2}", replaced(r" {2,}", " "))
    out = changed(out, r"\n{3}", replaced(r"\n{3,}", "\n\n"))
    out = changed(out, "[a-z][A-Z]", replaced("([a-z])([A-Z])", r"\1 \2"))
    out = changed(out, r"\n\s*(?:\d+\s*\n|(?i:Page)\s+\d)", page_numbers)
    return pc.ascii_trim(out, BLANKS)


def lower(texts: pa.Array) -> pa.Array:
    low = pc.ascii_lower(texts)
    other = pc.invert(pc.string_is_ascii(texts))
    if other.true_count == 0:
        return low
    return pc.replace_with_mask(low, other, pa.array(
        [t.decode("utf-8", "replace").lower() for t in texts.filter(other).cast(pa.binary()).to_pylist()], pa.string()))


def first_holding(texts: pa.Array, patterns: list[str]) -> pa.Array:
    """Position of the first pattern that the lower-case text holds, null for none."""
    found = np.full(len(texts), -1, np.int32)
    left, at = lower(texts.fill_null("")), np.arange(len(texts))
    for n, pattern in enumerate(patterns):
        hit = pc.match_substring_regex(left, pattern).to_numpy(zero_copy_only=False)
        found[at[hit]] = n
        left, at = left.filter(pa.array(~hit)), at[~hit]
    return pa.array(found, mask=found < 0)


def split_paragraphs(texts: pa.Array, longer_than: int) -> pa.Array:
    """Stretches between blank lines, trimmed; those of few characters or of a number alone are left out."""
    even = changed(texts.fill_null(""), r"\n[\s\x0b]+\n", replaced(r"\n[\s\x0b]*\n", "\n\n"))
    parts = pc.split_pattern(even, "\n\n")
    row = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = pc.ascii_trim(parts.flatten(), BLANKS)
    number = pc.match_substring_regex(flat, r"^[\d.]+[\x{85}\x{2028}\x{2029}]?$")
    keep = pc.and_not(pc.greater(pc.utf8_length(flat), longer_than), number)
    counts = np.bincount(row[keep.to_numpy(zero_copy_only=False)], minlength=len(parts))
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat.filter(keep), mask=texts.is_null() if texts.null_count else None)


def shapes_by_start(shapes: list[tuple[str, str, str, bool]]) -> dict[str, list[tuple[str, re.Pattern]]]:
    """Name and pattern of the shapes by the character that a paragraph begins with.

    A shape is (name, characters that it begins with, pattern, ignore case).
    """
    by_start: dict[str, list[tuple[str, re.Pattern]]] = {}
    for name, starts, pattern, ignore_case in shapes:
        compiled = re.compile(pattern, re.ASCII | re.IGNORECASE if ignore_case else re.ASCII)
        for c in starts:
            by_start.setdefault(c, []).append((name, compiled))
    return by_start


def headings(flat: pa.Array, shapes: list[tuple[str, str, str, bool]]) -> list[int]:
    """The level of every paragraph that is a heading, -1 for the others; see `header_parts` of the segmentation."""
    by_start = shapes_by_start(shapes)
    words = counted_words(flat)
    upper = pc.and_not(pc.match_substring_regex(flat, "[A-Z]"), pc.match_substring_regex(flat, "[a-z]"))
    caps = pc.and_(upper, pc.and_(pc.greater(pc.utf8_length(flat), 3), pc.less_equal(words, 10)))
    colon = pc.and_(pc.ends_with(flat, ":"), pc.less_equal(words, 5))
    levels = pc.if_else(caps, 0, pc.if_else(colon, 1, -1)).to_pylist()
    fixed = {"roman": 1, "article": 1, "alphabetical": 2, "titled": 0, "schedule": 0}
    for n, text in enumerate(decoded(flat)):
        for name, pattern in by_start.get(text[:1], ()):
            match = pattern.match(text)
            if match:
                levels[n] = match[1].count(".") + 1 if name == "numbered" else fixed[name]
                break
    return levels


def family(levels: list[int], ends: np.ndarray) -> tuple[list[int | None], list[list[int]]]:
    """Parent and children of every paragraph, by their positions in the text that it is of; see `outlined`."""
    parent: list[int | None] = [None] * len(levels)
    kids: list[list[int]] = [[] for _ in range(len(levels))]
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        open_now: list[int] = []
        for n in range(begin, end):
            if levels[n] >= 0:
                while open_now and levels[open_now[-1]] >= levels[n]:
                    open_now.pop()
            if open_now:
                parent[n] = open_now[-1] - begin
                kids[open_now[-1]].append(n - begin)
            if levels[n] >= 0:
                open_now.append(n)
    return parent, kids


def outlined(texts: pa.Array, longer_than: int, shapes: list[tuple[str, str, str, bool]] | None) -> pa.Array:
    """The paragraphs of every text as (text, characters of those before, index of the parent, indexes of the children).

    A heading closes those of its level and below and belongs to the one left open; other paragraphs belong to the last
    heading.  Without `shapes` no paragraph is a heading.
    """
    paras = split_paragraphs(texts, longer_than)
    flat, ends = paras.flatten(), paras.offsets.to_numpy()
    ends = ends - ends[0]
    sums = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False), dtype=np.int64)])
    chars = sums[:-1] - np.repeat(sums[ends[:-1]], np.diff(ends))
    parent, kids = family(headings(flat, shapes), ends) if shapes else ([None] * len(flat), [[] for _ in range(len(flat))])
    lines = pa.StructArray.from_arrays(
        [flat, pa.array(chars.astype(np.int32)), pa.array(parent, pa.int32()), pa.array(kids, pa.list_(pa.int32()))], ["text", "chars", "parent", "kids"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines, mask=texts.is_null() if texts.null_count else None)


def bare_heads(flat: pa.Array, words: pa.Array, hierarchical: bool) -> tuple[pa.Array, pa.Array]:
    """Which paragraphs are headings without a shape: by capitals alone, by a colon; see `header_parts`."""
    upper = pc.and_not(pc.match_substring_regex(flat, "[A-Z]"), pc.match_substring_regex(flat, "[a-z]"))
    if not hierarchical:
        return pc.and_(upper, pc.less_equal(words, 5)), pa.array(np.zeros(len(flat), bool))
    caps = pc.and_(upper, pc.and_(pc.greater(pc.utf8_length(flat), 3), pc.less_equal(words, 10)))
    return caps, pc.and_not(pc.and_(pc.ends_with(flat, ":"), pc.less_equal(words, 5)), caps)


def are_headings(flat: pa.Array, words: pa.Array, hierarchical: bool, by_start: dict) -> np.ndarray:
    """Which paragraphs are headings."""
    caps, colon = bare_heads(flat, words, hierarchical)
    bare = pc.or_(caps, colon).to_pylist()
    return np.array([b or any(p.match(t) for _, p in by_start.get(t[:1], ())) for b, t in zip(bare, decoded(flat))], bool)


def section_lines(flat: pa.Array, idx: np.ndarray, hierarchical: bool, by_start: dict, types: list[tuple[str, str]]) -> pa.StructArray:
    """What `section_array` says of paragraphs (without nulls) at the positions `idx` of their documents."""
    words = counted_words(flat)
    caps, colon = bare_heads(flat, words, hierarchical)
    titles: list[str] = []
    for text, n, by_caps, by_colon in zip(decoded(flat), idx.tolist(), caps.to_pylist(), colon.to_pylist()):
        match = next((m for _, p in by_start.get(text[:1], ()) if (m := p.match(text))), None)
        title = match[2] if match else text if by_caps else text.rstrip(":") if by_colon else None
        titles.append(title or f"Section {n + 1}")
    names = pa.array([name for name, _ in types])
    other = pc.if_else(pc.and_(pc.less(words, 10), pc.and_not(pc.match_substring_regex(flat, "[A-Z]"), pc.match_substring_regex(flat, "[a-z]"))),
                       "header", "clause")
    kind = pc.coalesce(names.take(first_holding(flat, [p for _, p in types])), other)
    return pa.StructArray.from_arrays([pa.array(idx.astype(np.int32)), flat, words, pa.array(titles, pa.string()), kind],
                                      ["idx", "text", "words", "title", "type"])


def ascii_paragraphs(texts: pa.Array, longer_than: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray | None]:
    """Paragraphs of the texts of ASCII alone: all in one array, where each text's begin and end, their positions in
    their texts, and which texts have none to tell (null or beyond ASCII)."""
    left_out = pc.invert(pc.fill_null(pc.string_is_ascii(texts), False))
    paras = split_paragraphs(pc.if_else(left_out, pa.scalar("", texts.type), texts), longer_than)
    ends = paras.offsets.to_numpy()
    ends = (ends - ends[0]).astype(np.int32)
    idx = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
    return paras.flatten(), ends, idx, left_out


def sectioned(texts: pa.Array, longer_than: int, hierarchical: bool, by_start: dict, types: list[tuple[str, str]]) -> pa.Array:
    """The `section_array` of every text; null for texts beyond ASCII, which are the JVM's to describe."""
    flat, ends, idx, left_out = ascii_paragraphs(texts, longer_than)
    return pa.ListArray.from_arrays(pa.array(ends), section_lines(flat, idx, hierarchical, by_start, types), mask=left_out)


def section_names(idx: list[int | None]) -> list[str | None]:
    return [None if i is None else f"sec-{i:03d}" for i in idx]


def treed(texts: pa.Array, longer_than: int, hierarchical: bool, shapes: list[tuple[str, str, str, bool]],
          types: list[tuple[str, str]]) -> pa.Array:
    """The `section_tree` of every text; null for texts beyond ASCII."""
    flat, ends, idx, left_out = ascii_paragraphs(texts, longer_than)
    by_start = shapes_by_start(shapes)
    n, text, words, title, kind = section_lines(flat, idx, hierarchical, by_start, types).flatten()
    if hierarchical:
        levels = headings(flat, shapes)
        parent, kids = family(levels, ends)
        level = np.array(levels, np.int32)
        is_header = level >= 0
    else:
        parent, kids, level = [None] * len(flat), [[]] * len(flat), np.zeros(len(flat), np.int32)
        is_header = are_headings(flat, words, False, by_start)
    fields = {"para_idx": n, "section_id": pa.array(section_names(idx.tolist()), pa.string()), "title": title, "text": text, "section_type": kind,
              "is_header": pa.array(is_header, pa.bool_()), "level": pa.array(np.maximum(level, 0)), "parent_id": pa.array(section_names(parent), pa.string()),
              "children_ids": pa.array(list(map(section_names, kids)), pa.list_(pa.string()))}
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=left_out)


def referring(texts: pa.Array, longer_than: int, by_start: dict, needed: str, compiled: list[tuple[tuple[str, ...], re.Pattern]]) -> pa.Array:
    """The `reference_array` of every text; null for texts beyond ASCII."""
    flat, ends, _, left_out = ascii_paragraphs(texts, longer_than)
    naming = pc.match_substring_regex(flat, needed).to_pylist()
    paras = decoded(flat)
    out = []
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if not any(naming[begin:end]):
            out.append([])
            continue
        owner = {}
        for n, text in enumerate(paras[begin:end]):
            match = next((m for _, p in by_start.get(text[:1], ()) if (m := p.match(text))), None)
            if match and match[1]:
                owner[match[1]] = n
        found = [(n, [owner[m[1]] for words, pattern in compiled for m in matches(text, words, pattern) if owner.get(m[1], n) != n])
                 for n, text in enumerate(paras[begin:end]) if naming[begin + n]]
        out.append([{"section_id": f"sec-{n:03d}", "target_section_ids": section_names(targets)} for n, targets in found if targets])
    lines = pa.array(out, pa.list_(pa.struct([("section_id", pa.string()), ("target_section_ids", pa.list_(pa.string()))])))
    return pc.if_else(left_out, pa.scalar(None, lines.type), lines)


# A rule as batches test it: words of its context, groups of (words that its patterns need, patterns), exceptions.
RuleTest = tuple[str, list[tuple[str, list[str]]], list[str]]


def fired_bits(texts: pa.Array, rules: list[RuleTest]) -> np.ndarray:
    """Numbers whose bits tell which rules fire on texts of ASCII without nulls; at most 63 rules."""
    low = pc.ascii_lower(texts)

    def holding_at(at: np.ndarray, pattern: str) -> np.ndarray:
        return at[pc.match_substring_regex(low.take(pa.array(at)), pattern).to_numpy(zero_copy_only=False)]

    bits, every = np.zeros(len(texts), np.int64), np.arange(len(texts))
    needed = [words for _, groups, _ in rules for words, _ in groups]
    if all(needed):
        # most texts hold no word of any rule
        every = holding_at(every, "|".join(dict.fromkeys(needed)))
    for n, (context, groups, exceptions) in enumerate(rules):
        at = holding_at(every, context) if context else every
        fired = np.zeros(len(texts), bool)
        for words, patterns in groups:
            left = holding_at(at, words) if words else at
            for pattern in patterns:
                hit = holding_at(left, pattern)
                fired[hit] = True
                left = left[~fired[left]]
        at = np.flatnonzero(fired)
        for pattern in exceptions:
            fired[holding_at(at, pattern)] = False
            at = np.flatnonzero(fired)
        bits[at] |= 1 << n
    return bits


def fired_lines(texts: pa.Array, longer_than: int, rules: list[RuleTest], min_words: int, long_headers: bool, hierarchical: bool,
                by_start: dict) -> pa.Array:
    """(idx, rule_no) of every rule that fires on a paragraph that rules may look at; null for texts beyond ASCII."""
    flat, ends, idx, left_out = ascii_paragraphs(texts, longer_than)
    words = counted_words(flat)
    at = np.flatnonzero(words.to_numpy() >= min_words)
    bits = fired_bits(flat.take(pa.array(at)), rules)
    at, bits = at[bits != 0], bits[bits != 0]
    if not long_headers:
        here = pa.array(at)
        open_to = ~are_headings(flat.take(here), words.take(here), hierarchical, by_start)
        at, bits = at[open_to], bits[open_to]
    which, rule = np.nonzero((bits[:, None] >> np.arange(len(rules))) & 1)
    found = at[which]
    lines = pa.StructArray.from_arrays([pa.array(idx[found].astype(np.int32)), pa.array(rule.astype(np.int32))], ["idx", "rule_no"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(found, ends).astype(np.int32)), lines, mask=left_out)


def _gathered(data: bytes, begins: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The stretches of bytes as texts."""
    return pa.array([data[a:b] for a, b in zip(begins.tolist(), stops.tolist())], pa.binary()).cast(pa.string())


_WORD_BYTES = np.array([b < 128 and (chr(b).isalnum() or b == 0x5F) for b in range(256)])


def word_hits(texts: pa.Array, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words of lower case stand as whole words, in any case, in texts of ASCII without nulls: position in `words`,
    first byte and byte after the last, both in the bytes of all texts; words in order, places of each from left to right.

    All tokens (runs of letters, digits and underscores) are compared by their first eight bytes; a word is looked at only
    where its first token stands.
    """
    chars, ends = bytes_of(pc.ascii_lower(texts))
    # texts are apart from each other; words may be compared beyond the last byte
    room = max([8, *map(len, words)]) + 1
    data = np.concatenate([chars, np.zeros(room, np.uint8)])
    inside = _WORD_BYTES[data]
    first = np.zeros(len(data), bool)
    first[ends] = True
    begins = np.flatnonzero(inside & (first | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside[:-1] & (first[1:] | ~inside[1:])) + 1
    begins = begins[:len(stops)]
    size = stops - begins
    key = np.zeros(len(begins), np.uint64)
    for n in range(8):
        key |= np.where(size > n, data[begins + n], 0).astype(np.uint64) << np.uint64(8 * n)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    found = []
    for no, word in enumerate(words):
        token = re.match(r"\w+", word, re.ASCII)[0].encode()
        want = np.uint64(int.from_bytes(token[:8], "little"))
        at = begins[order[np.searchsorted(ranked, want, "left"):np.searchsorted(ranked, want, "right")]]
        for n, c in enumerate(word.encode()):
            at = at[data[at + n] == c]
        end = at + len(word)
        # within its text, and no word goes on after it
        own = ends[np.searchsorted(ends, at, "right")]
        whole = (end <= own) & ((end == own) | ~inside[end])
        at, end = at[whole], end[whole]
        if len(at) > 1 and (at[1:] < end[:-1]).any():
            kept, last = [], -1
            for n, (a, e) in enumerate(zip(at.tolist(), end.tolist())):
                if a >= last:
                    kept.append(n)
                    last = e
            at, end = at[kept], end[kept]
        found.append((np.full(len(at), no), at, end))
    return tuple(np.concatenate(x) for x in zip(*found))


def placed_words(texts: pa.Array, words: list[str], around: int) -> pa.Array:
    """(word_id, matched_text, position, context) of the whole words of every text, as `detect_terms` says; null beyond ASCII.

    Contexts reach `around` characters to both sides, dots where the text was cut.
    """
    left_out = pc.invert(pc.fill_null(pc.string_is_ascii(texts), False))
    whole = pc.if_else(left_out, pa.scalar("", texts.type), texts)
    chars, ends = bytes_of(whole)
    no, at, stop = word_hits(whole, words)
    row = np.searchsorted(ends, at, "right") - 1
    order = np.lexsort((at, no, row))
    no, at, stop, row = no[order], at[order], stop[order], row[order]
    data, begin, end = chars.tobytes(), ends[row], ends[row + 1]
    lo, hi = np.maximum(at - around, begin), np.minimum(stop + around, end)
    dots = np.array(["", "..."])
    context = pc.binary_join_element_wise(pa.array(dots[(lo > begin).astype(int)]), _gathered(data, lo, hi), pa.array(dots[(hi < end).astype(int)]), "")
    lines = pa.StructArray.from_arrays([pa.array(no.astype(np.int32)), _gathered(data, at, stop), pa.array((at - begin).astype(np.int32)), context],
                                       ["word_id", "matched_text", "position", "context"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), lines, mask=left_out)


def summarized(texts: pa.Array, terms: str, max_words: int, min_words: int, min_chars: int) -> pa.Array:
    """The summaries of `summary.summarize`; null for texts beyond ASCII, which are the JVM's."""
    left_out = pc.invert(pc.fill_null(pc.string_is_ascii(texts), False))
    whole = pc.if_else(left_out, pa.scalar("", texts.type), texts)
    parts = pc.split_pattern(pc.replace_substring_regex(whole, r"([.!?])[\s\x0b]+", "\\1\x01"), "\x01")
    row = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = pc.ascii_trim(parts.flatten(), BLANKS)
    keep = pc.not_equal(flat, "")
    flat, row = flat.filter(keep), row[keep.to_numpy(zero_copy_only=False)]
    worth, words = pc.count_substring_regex(flat, terms).to_numpy(), counted_words(flat).to_numpy().astype(np.int64)
    # the best sentences of each text first
    order = np.lexsort((-worth, row))
    size, owner = words[order], row[order]
    total = np.concatenate([[0], np.cumsum(size)])
    used = total[1:] - total[np.searchsorted(owner, owner)]
    kept = np.zeros(len(flat), bool)
    kept[order[(used <= max_words) | (used - size < min_words)]] = True
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(parts)))]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(kept))), " ")
    short = pc.less(pc.utf8_length(pc.ascii_trim(whole, BLANKS)), min_chars)
    return pc.if_else(left_out, pa.scalar(None, pa.string()), pc.if_else(short, "", joined))


def held_groups(texts: pa.Array, groups: list[list[list[str]]]) -> pa.Array:
    """A number whose bits tell for which groups the text holds, in any case, a word of each of the group's lists."""
    tests = [["|".join(re.escape(w) for w in words) for words in lists] for lists in groups]
    bits = np.zeros(len(texts), np.int64)
    low, at = lower(texts.fill_null("")), np.arange(len(texts))
    if all(tests):
        # most texts hold no word of any group's first list
        some = pc.match_substring_regex(low, "|".join(dict.fromkeys(lists[0] for lists in tests)))
        low, at = low.filter(some), at[some.to_numpy(zero_copy_only=False)]
    for n, lists in enumerate(tests):
        left, here = low, at
        for test in lists:
            hit = pc.match_substring_regex(left, test)
            left, here = left.filter(hit), here[hit.to_numpy(zero_copy_only=False)]
        bits[here] |= 1 << n
    return pa.array(bits)


def beginnings(low: str, words: tuple[str, ...]) -> list[int]:
    """Where one of the words stands in a lower-case text, in order."""
    found = set()
    for word in words:
        at = low.find(word)
        while at >= 0:
            found.add(at)
            at = low.find(word, at + 1)
    return sorted(found)


def matches(text: str, words: tuple[str, ...], pattern: re.Pattern) -> Iterator[re.Match]:
    """The matches, from left to right, of a case-blind pattern that begins with one of the lower-case words."""
    if not text.isascii():
        yield from pattern.finditer(text)
        return
    end = 0
    for at in beginnings(text.lower(), words):
        match = pattern.match(text, at) if at >= end else None
        if match:
            yield match
            end = match.end()


# Letters in lower case, digits and underscores; what stands between words becomes a blank.
_WORD_CHARS = bytes(ord(chr(c).lower()) if c < 128 and (chr(c).isalnum() or c == 0x5F) else 32 for c in range(256))


def whole_words(low: str, word: str) -> int:
    """How often a word stands in a lower-case ASCII text, no letter, digit or underscore beside it."""
    n, at = 0, low.find(word)
    while at >= 0:
        end = at + len(word)
        before, after = low[at - 1:at] if at else "", low[end:end + 1]
        whole = not (before.isalnum() or before == "_" or after.isalnum() or after == "_")
        n += whole
        at = low.find(word, end if whole else at + 1)
    return n


def decoded(texts: pa.Array) -> list[str | None]:
    return [t if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]


def counted_groups(texts: pa.Array, groups: list[list[str]]) -> pa.Array:
    """How often words of each group stand in a text as whole words; null for texts beyond ASCII, which are the JVM's to count."""
    # the first and the last word of those that are no single word
    phrases = {w: (parts[0].encode(), parts[-1].encode()) for words in groups for w in words if len(parts := re.findall(r"\w+", w)) > 1}
    keys = [[w if w in phrases else w.encode() for w in words] for words in groups]

    def count(text: bytes | None) -> list[int] | None:
        if text is None or not text.isascii():
            return None
        seen = Counter(text.translate(_WORD_CHARS).split())
        low = None
        for phrase, (first, last) in phrases.items():
            if first in seen and last in seen:
                low = low or text.decode().lower()
                seen[phrase] = whole_words(low, phrase)
        return [sum(seen[w] for w in words) for words in keys]

    return pa.array([count(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))


def counted_words(texts: pa.Array) -> pa.Array:
    """Number of blank-separated words; null where the text is."""
    chars, ends = bytes_of(texts.fill_null(""))
    inside = (chars != 32) & ((chars < 9) | (chars > 13))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = inside[first]
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), ends)).astype(np.int32)
    return pa.array(counts, mask=texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None)


def clean_text(text: Column, shared: bool = False) -> Column:
    """ASCII spelling where there is one, no control characters, single spaces, no page-number lines, trimmed.

    A text is rebuilt only by the steps that have something to do in it.  The next batch function takes its result
    inside the same worker; where several read it (`shared`), it is a column of its own, or each would clean again.
    """
    @F.arrow_udf("string")
    @in_slices
    def clean(texts: pa.Array) -> pa.Array:
        return cleaned(texts)

    return (clean.asNondeterministic() if shared else clean)(text)


# What a match is wrapped in until it is replaced; texts that hold these are not worked on in batches.
_WRAP_OPEN, _WRAP_CLOSE = b"\x01", b"\x02"


def redacted(texts: pa.Array, patterns: list[tuple[str, str]], codes: str, mark_open: str, mark_close: str, letters: dict,
             replace: bool) -> pa.Array:
    """(text, names of the patterns that match, text with every match replaced by its tag); names and replaced text are
    null for texts beyond ASCII, which are the JVM's to search.

    On ASCII the engine here finds what the JVM's finds.  Pattern after pattern, matches become the same markers as in
    `privacy.redact`; a last pass spells them out.
    """
    whole = texts.fill_null("")
    usable = pc.and_(pc.and_(texts.is_valid(), pc.string_is_ascii(whole)), pc.invert(pc.match_substring_regex(whole, r"[\x01\x02]")))
    body = whole.filter(usable)
    held, tags = np.zeros((len(body), len(patterns)), bool), {}
    first = body
    for n, ((name, pattern), code) in enumerate(zip(patterns, codes)):
        hit = pc.match_substring_regex(first, pattern)
        held[:, n] = hit.to_numpy(zero_copy_only=False)
        if not replace or not hit.true_count:
            continue

        def mark(run: bytes) -> bytes:
            digest = md5(run[1:-1]).hexdigest()[:8]
            marker = f"{mark_open}{code}{digest.translate(letters)}{mark_close}".encode()
            tags[marker] = f"[REDACTED-{name}-{digest}]".encode()
            return marker

        wrapped = pc.replace_substring_regex(body.filter(hit), pattern, (_WRAP_OPEN + rb"\0" + _WRAP_CLOSE).decode())
        chars, _ = bytes_of(wrapped)
        done = respelled(wrapped, np.flatnonzero(chars == _WRAP_OPEN[0]), np.flatnonzero(chars == _WRAP_CLOSE[0]) + 1, mark)
        body = pc.replace_with_mask(body, hit, done)
    if tags:
        # beyond ASCII there are only markers
        at = np.flatnonzero(bytes_of(body)[0] == mark_open.encode()[0])
        body = respelled(body, at[0::2], at[1::2] + len(mark_close.encode()), tags.__getitem__)
    row, kind = np.nonzero(held)
    names = pa.array([name for name, _ in patterns]).take(pa.array(kind))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(body)))]).astype(np.int32)
    place = pa.array(np.cumsum(usable.to_numpy(zero_copy_only=False)) - 1, mask=~usable.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays(
        [texts, pa.ListArray.from_arrays(pa.array(ends), names).take(place), body.take(place)], ["text", "types", "body"])


def redacted_of(text: Column, patterns: list[tuple[str, str, bool]], codes: str, mark_open: str, mark_close: str, letters: dict,
                replace: bool) -> Column:
    """See `redacted`.  A column of its own: several parts of it are read."""
    tests = [(name, _for_batches(pattern, ignore_case)) for name, pattern, ignore_case in patterns]

    @F.arrow_udf("struct<text:string,types:array<string>,body:string>")
    @in_slices
    def redact(texts: pa.Array) -> pa.Array:
        return redacted(texts, tests, codes, mark_open, mark_close, letters, replace)

    return redact.asNondeterministic()(text)


def first_of(text: Column, groups: list[list[str]]) -> Column:
    """Position of the first group of words one of which the text holds in any case, null for none."""
    patterns = ["|".join(re.escape(w) for w in words) for words in groups]

    @F.arrow_udf("int")
    @in_slices
    def first(texts: pa.Array) -> pa.Array:
        return first_holding(texts, patterns)

    return first(text)


def paragraphs_of(text: Column, longer_than: int) -> Column:
    """Array of the paragraphs of a text."""
    @F.arrow_udf("array<string>")
    @in_slices
    def split(texts: pa.Array) -> pa.Array:
        return split_paragraphs(texts, longer_than)

    return split(text)


def paragraph_count(text: Column, longer_than: int) -> Column:
    """Number of the paragraphs of a text."""
    @F.arrow_udf("int")
    @in_slices
    def count(texts: pa.Array) -> pa.Array:
        return pc.list_value_length(split_paragraphs(texts, longer_than))

    return count(text)


def sections_of(text: Column, longer_than: int, hierarchical: bool, shapes: list[tuple[str, str, str, bool]],
                types: dict[str, list[str]]) -> Column:
    """See `sectioned`; `types` are words by the section type that they tell."""
    patterns = [(name, "|".join(re.escape(w) for w in words)) for name, words in types.items()]

    @F.arrow_udf("array<struct<idx:int,text:string,words:int,title:string,type:string>>")
    @in_slices
    def secs(texts: pa.Array) -> pa.Array:
        return sectioned(texts, longer_than, hierarchical, shapes_by_start(shapes), patterns)

    return secs(text)


def trees_of(text: Column, longer_than: int, hierarchical: bool, shapes: list[tuple[str, str, str, bool]],
             types: dict[str, list[str]]) -> Column:
    """See `treed`; `types` are words by the section type that they tell."""
    patterns = [(name, "|".join(re.escape(w) for w in words)) for name, words in types.items()]

    @F.arrow_udf("array<struct<para_idx:int,section_id:string,title:string,text:string,section_type:string,is_header:boolean,level:int,"
                 "parent_id:string,children_ids:array<string>>>")
    @in_slices
    def trees(texts: pa.Array) -> pa.Array:
        return treed(texts, longer_than, hierarchical, shapes, patterns)

    return trees(text)


def references_of(text: Column, longer_than: int, shapes: list[tuple[str, str, str, bool]], needed: str,
                  patterns: list[tuple[tuple[str, ...], str]]) -> Column:
    """See `referring`; the patterns are those of `all_found`."""
    compiled = [(words, re.compile(pattern, re.ASCII | re.IGNORECASE)) for words, pattern in patterns]
    test = _for_batches(needed, True)

    @F.arrow_udf("array<struct<section_id:string,target_section_ids:array<string>>>")
    @in_slices
    def references(texts: pa.Array) -> pa.Array:
        return referring(texts, longer_than, shapes_by_start(shapes), test, compiled)

    return references(text)


def _rule_tests(rules: list[tuple[list[str], list[tuple[list[str], list[str]]], list[str]]]) -> list[RuleTest]:
    def any_word(words):
        return "|".join(re.escape(w) for w in words)

    def read(patterns):
        return [_for_batches(p, True) for p in patterns]

    return [(any_word(context), [(any_word(words), read(patterns)) for words, patterns in groups], read(exceptions))
            for context, groups, exceptions in rules]


def fired_of(text: Column, rules: list) -> Column:
    """A number whose bits tell which rules (context words, groups of needed words and patterns, exceptions) fire on the
    text; null beyond ASCII.  Not to be worked out anew, as in `holding_groups`."""
    tests = _rule_tests(rules)

    @F.arrow_udf("bigint")
    @in_slices
    def fired(texts: pa.Array) -> pa.Array:
        plain = pc.fill_null(pc.string_is_ascii(texts), False).to_numpy(zero_copy_only=False)
        bits = np.zeros(len(texts), np.int64)
        bits[plain] = fired_bits(texts.filter(pa.array(plain)), tests)
        return pa.array(bits, mask=~plain)

    return fired.asNondeterministic()(text)


def fired_lines_of(text: Column, longer_than: int, rules: list, min_words: int, long_headers: bool, hierarchical: bool,
                   shapes: list[tuple[str, str, str, bool]]) -> Column:
    """See `fired_lines`."""
    tests = _rule_tests(rules)

    @F.arrow_udf("array<struct<idx:int,rule_no:int>>")
    @in_slices
    def fired(texts: pa.Array) -> pa.Array:
        return fired_lines(texts, longer_than, tests, min_words, long_headers, hierarchical, shapes_by_start(shapes))

    return fired(text)


def words_placed_in(text: Column, words: list[str], around: int) -> Column:
    """See `placed_words`."""
    @F.arrow_udf("array<struct<word_id:int,matched_text:string,position:int,context:string>>")
    @in_slices
    def placed(texts: pa.Array) -> pa.Array:
        return placed_words(texts, words, around)

    return placed(text)


def summaries_of(text: Column, terms: str, max_words: int, min_words: int, min_chars: int) -> Column:
    """See `summarized`; `terms` is a case-blind pattern."""
    pattern = _for_batches(terms, True)

    @F.arrow_udf("string")
    @in_slices
    def summaries(texts: pa.Array) -> pa.Array:
        return summarized(texts, pattern, max_words, min_words, min_chars)

    return summaries(text)


def outline_of(text: Column, longer_than: int, shapes: list[tuple[str, str, str, bool]] | None) -> Column:
    """See `outlined`."""
    @F.arrow_udf("array<struct<text:string,chars:int,parent:int,kids:array<int>>>")
    @in_slices
    def outline(texts: pa.Array) -> pa.Array:
        return outlined(texts, longer_than, shapes)

    return outline(text)


def holding_groups(text: Column, groups: list[list[list[str]]]) -> Column:
    """See `held_groups`; at most 63 groups.

    Not to be worked out anew, so the optimizer may not move a filter on it below its column.
    """
    @F.arrow_udf("bigint")
    @in_slices
    def held(texts: pa.Array) -> pa.Array:
        return held_groups(texts, groups)

    return held.asNondeterministic()(text)


def group_counts(text: Column, groups: list[list[str]]) -> Column:
    """See `counted_groups`."""
    @F.arrow_udf("array<int>")
    @in_slices
    def counts(texts: pa.Array) -> pa.Array:
        return counted_groups(texts, groups)

    return counts(text)


def first_found(text: Column, words: tuple[str, ...], pattern: str, min_chars: int, most: int | None) -> Column:
    """The first `most` distinct values (None: all) of the groups of a case-blind pattern that begins with one of the
    lower-case words, by appearance, trimmed and of `min_chars` characters at least."""
    compiled = re.compile(pattern, re.ASCII | re.IGNORECASE)

    def of(given: str | None) -> list[str] | None:
        if given is None:
            return None
        values = (v.strip(BLANKS) for m in matches(given, words, compiled) for v in m.groups())
        return list(dict.fromkeys(v for v in values if len(v) >= min_chars))[:most]

    @F.arrow_udf("array<string>")
    @in_slices
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([of(t) for t in decoded(texts)], pa.list_(pa.string()))

    return found(text)


def all_found(text: Column, needed: str, patterns: list[tuple[tuple[str, ...], str]]) -> Column:
    """What the first group of each case-blind pattern matches: all of the first pattern, then of the second and so on.

    A match of each begins with one of its lower-case words; only texts that hold the case-blind pattern `needed` are looked at.
    """
    compiled = [(words, re.compile(pattern, re.ASCII | re.IGNORECASE)) for words, pattern in patterns]
    test = _for_batches(needed, True)

    @F.arrow_udf("array<string>")
    @in_slices
    def found(texts: pa.Array) -> pa.Array:
        out: list[list[str] | None] = [[] if t else None for t in texts.is_valid().to_pylist()]
        hit = pc.match_substring_regex(texts.fill_null(""), test)
        at = np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist()
        for n, t in zip(at, decoded(texts.filter(hit))):
            out[n] = [m[1] for words, pattern in compiled for m in matches(t, words, pattern)]
        return pa.array(out, pa.list_(pa.string()))

    return found(text)


def first_answers(text: Column, kinds: list[list[tuple[tuple[str, ...], str]]]) -> Column:
    """For every kind the groups of its first case-blind pattern that matches, at its first match, trimmed and joined
    by "and"; null if none does.

    A match of a pattern begins with one of its lower-case words.
    """
    compiled = [[(words, re.compile(pattern, re.ASCII | re.IGNORECASE)) for words, pattern in patterns] for patterns in kinds]

    def of(given: str | None, patterns: list) -> str | None:
        if given is None:
            return None
        for words, pattern in patterns:
            match = next(matches(given, words, pattern), None)
            if match:
                return " and ".join(g for g in match.groups() if g and g.strip(BLANKS)).strip(BLANKS)
        return None

    @F.arrow_udf("array<string>")
    @in_slices
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[of(t, patterns) for patterns in compiled] for t in decoded(texts)], pa.list_(pa.string()))

    return found(text)


def words_of(text: Column) -> Column:
    """`word_count` of whole texts in a column of their own."""
    @F.arrow_udf("int")
    @in_slices
    def words(texts: pa.Array) -> pa.Array:
        return counted_words(texts)

    return words(text)


def _for_batches(pattern: str, ignore_case: bool) -> str:
    """A pattern of the JVM's as Arrow reads it: its blanks hold the vertical tab, too."""
    out, inside = "", False
    for token in re.findall(r"\\.|.", pattern, re.S):
        inside = token == "[" or (inside and token != "]")
        out += {True: r"\s\x0b", False: r"[\s\x0b]"}[inside] if token == r"\s" else token
    return ("(?i)" if ignore_case else "") + out


def holding(text: Column, patterns: list[tuple[str, bool]]) -> Column:
    """A number whose bits tell which of the patterns (pattern, ignore case) may match somewhere in the text.

    The JVM's word boundaries know letters beyond ASCII and its case-blind letters none, so a pattern whose
    boundaries stand at ASCII words may be found here and not there, but never the other way round.
    """
    tests = [_for_batches(*p) for p in patterns]

    @F.arrow_udf("int")
    @in_slices
    def held(texts: pa.Array) -> pa.Array:
        bits = np.zeros(len(texts), np.int32)
        whole = texts.fill_null("")
        for n, test in enumerate(tests):
            bits |= pc.match_substring_regex(whole, test).to_numpy(zero_copy_only=False).astype(np.int32) << n
        return pa.array(bits)

    return held(text)
