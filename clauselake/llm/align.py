"""Alignment of the tokens of two tokenizers by interval coalescing.

All tokens of both sides, as byte intervals, are sorted by their start, and the
running maximum of their ends is taken; a group ends where a start reaches this
maximum.  Within a group every overlap of a token of one side with one of the
other is a link.  How often a pair of ids is linked in the whole corpus is
counted per slice of texts, added up, and joined back to the slices, so that
neither tokens nor links are shuffled one by one.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.bpe import byte_letters
from clauselake.llm.packing import Remembered
from clauselake.llm.shared import slices, written

SLICE_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 20
CACHE_UNITS = 150_000
MARK = "▁"
# Fixed value: the characters that are white space in Unicode.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WHITES = frozenset("\t\n\x0b\x0c\r" + WHITE[3:])
JOINED_UNITS = 2048
SLICED = ("slice bigint, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
          "digests array<string>, codes array<bigint>, times array<bigint>, links binary")


class Side:
    """A tokenizer whose ids of a text are those of its units, one after the other; distinct units are encoded once."""

    unit: re.Pattern

    def __init__(self, cache: int = CACHE_UNITS):
        self.known = Remembered(cache)
        self.sizes: np.ndarray
        self.decimal: np.ndarray
        self.digits: np.ndarray

    def set_tokens(self, tokens: list[bytes]) -> None:
        """Byte length and decimal digits of every id."""
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        told = [str(i).encode() for i in range(len(tokens))]
        self.digits = np.array([len(t) for t in told], np.int64)
        self.decimal = np.array(told, f"S{max(map(len, told))}").view(np.uint8).reshape(len(tokens), -1)

    def units(self, text: str) -> list[str]:
        return self.unit.findall(text)

    def fresh(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit by itself."""
        raise NotImplementedError

    def joins(self, unit: str) -> bool:
        """Whether units like this may stand one behind the other in one text and keep their ids."""
        raise NotImplementedError

    def joined(self, units: list[str]) -> list[int]:
        """Ids of such units in one text."""
        raise NotImplementedError

    def raw(self, unit: str) -> bytes:
        return unit.encode()

    def learn(self, units: list[str]) -> None:
        """Put ids of units into the cache, None for units whose bytes come back changed.

        Units that may be joined are encoded together and cut by their bytes.
        """
        young = self.known.young
        together = [u for u in units if self.joins(u)]
        alone = [u for u in units if not self.joins(u)]
        for at in range(0, len(together), JOINED_UNITS):
            some = together[at:at + JOINED_UNITS]
            ids = np.array(self.joined(some), np.uint32)
            raw = [self.raw(u) for u in some]
            if b"".join([self.tokens[i] for i in ids.tolist()]) != b"".join(raw):
                alone += some
                continue
            cuts = 4 * np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(r) for r in raw]), "right")
            packed, cuts = ids.tobytes(), cuts.tolist()
            young.update(zip(some, [packed[a:b] for a, b in zip([0, *cuts], cuts)]))
        for unit, found in zip(alone, self.fresh(alone)):
            same = b"".join([self.tokens[i] for i in found]) == self.raw(unit)
            young[unit] = array("I", found).tobytes() if same else None

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids (unsigned 32 bits) of each text, and whether their bytes are a blank and the text."""
        self.known.age()
        split = [self.units(t) for t in texts]
        self.learn(self.known.missing(set().union(*split)))
        young = self.known.young
        found = [[young[u] for u in us] for us in split]
        right = [None not in x for x in found]
        return [b"".join(x) if ok else b"" for x, ok in zip(found, right)], right


class ByteSide(Side):
    """Byte-level merges of a tokenizers file; strings of special tokens inside texts are plain text."""

    unit = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.set_tokens([bytes([byte_of[c] for c in n]) if set(n) <= byte_of.keys() else n.encode() for n in names])

    def joins(self, unit: str) -> bool:
        return unit[0] == " " and len(unit) > 1 and unit[1] not in WHITES

    def joined(self, units: list[str]) -> list[int]:
        return self.library.encode("".join(units), add_special_tokens=False).ids

    def fresh(self, units: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(units), 4096)
                for e in self.library.encode_batch(units[at:at + 4096], add_special_tokens=False)]


class PieceSide(Side):
    """Pieces of a sentencepiece model whose pieces hold no line break and no mark after another character."""

    unit = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def __init__(self, path: str):
        import sentencepiece
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("\n" in n or MARK in n.lstrip(MARK) for n in names):
            raise ValueError("the pieces of this model may reach over the borders of words")
        self.lone = self.library.piece_to_id(MARK)
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.set_tokens([bytes.fromhex(m[1]) if self.library.is_byte(i) and (m := byte.fullmatch(n)) else n.replace(MARK, " ").encode()
                         for i, n in enumerate(names)])

    def units(self, text: str) -> list[str]:
        return self.unit.findall(text.replace(" ", MARK))

    def raw(self, unit: str) -> bytes:
        return unit.replace(MARK, " ").encode()

    def joins(self, unit: str) -> bool:
        return unit[0] == MARK and len(unit) > 1 and unit[1] != MARK

    def joined(self, units: list[str]) -> list[int]:
        return self.library.encode("".join(units)[1:].replace(MARK, " "), num_threads=1)

    def fresh(self, units: list[str]) -> list[list[int]]:
        # the library puts a mark before a text: instead of the unit's own, or, behind a line break, as a piece of its own
        whole = [u[1:].replace(MARK, " ") if u[0] == MARK else u if u == "\n" else "\n" + u for u in units]
        skip = [0 if u[0] == MARK else 1 if u == "\n" else 2 for u in units]
        coded = self.library.encode(whole, num_threads=1) if whole else []
        return [[self.lone] if u == MARK else ids[k:] for u, ids, k in zip(units, coded, skip)]


@lru_cache(maxsize=2)
def sides(byte_file: str, piece_file: str) -> tuple[Side, Side]:
    return ByteSide(byte_file), PieceSide(piece_file)


@dataclass
class Aligned:
    """Tokens of both sides that cover the same bytes: group of each token, and the links as positions (a, b)."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    groups: int


def coalesce(size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Groups and links of two sequences of token sizes (bytes, above 0) over the same bytes; no tokens have no groups."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    start_a, start_b = end_a - size_a, end_b - size_b
    start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    many = last - first
    link_a = np.repeat(np.arange(len(size_a)), many)
    before = np.cumsum(many) - many
    link_b = np.arange(len(link_a)) - np.repeat(before - first, many)
    return Aligned(group[:len(size_a)], group[len(size_a):], link_a, link_b, int(breaks.sum()))


def told(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` as bytes with a mark after every token, and where each group ends in it."""
    group = np.concatenate((found.group_a, found.group_b))
    order = np.argsort(group, kind="stable")  # in a group first the tokens of one side, then those of the other
    from_b = (np.arange(len(group)) >= len(ids_a))[order]
    group = group[order]
    digits = np.concatenate((a.digits[ids_a], b.digits[ids_b]))[order]
    width = max(a.decimal.shape[1], b.decimal.shape[1]) + 1
    cells = np.zeros((len(group), width), np.uint8)
    at_a, at_b = np.flatnonzero(~from_b), np.flatnonzero(from_b)
    cells[at_a, :a.decimal.shape[1]] = a.decimal[ids_a]
    cells[at_b, :b.decimal.shape[1]] = b.decimal[ids_b]
    ends = np.ones(len(group), bool)
    ends[:-1] = group[1:] != group[:-1]
    turns = np.zeros(len(group), bool)
    turns[:-1] = ~ends[:-1] & (from_b[1:] != from_b[:-1])
    cells[np.arange(len(group)), digits] = np.where(ends, ord(";"), np.where(turns, ord("|"), ord(",")))
    text = cells[np.arange(width) <= digits[:, None]].tobytes()
    return text, np.cumsum(digits + 1)[ends]


@dataclass
class Document:
    """What is known of a text after some of its segments."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    right: bool = True
    digest: object = None
    codes: list[np.ndarray] = field(default_factory=list)

    def add(self, n_a: int, n_b: int, n_groups: int, text: bytes, codes: np.ndarray) -> None:
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(text)
        self.codes.append(codes)


def segments(text: str, most: int = SEGMENT_BYTES) -> Iterator[str]:
    """A blank and the text, cut before single blanks between other characters, where both sides start a token."""
    text = " " + text
    start = 0
    while len(text) - start > most:
        cut = CUT.search(text, start + most)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


CUT = re.compile(f"(?<=[^{WHITE}{MARK}]) (?=[^{WHITE}{MARK}])")


def align_segments(a: Side, b: Side, texts: list[str], docs: list[Document]) -> None:
    """Align texts (each with its leading blank) and add what is found to their documents."""
    coded_a, right_a = a.encode(texts)
    coded_b, right_b = b.encode(texts)
    good = [i for i, t in enumerate(texts) if right_a[i] and right_b[i] and MARK not in t]
    for i in set(range(len(texts))) - set(good):
        docs[i].right = False
    ids_a = np.frombuffer(b"".join([coded_a[i] for i in good]), np.uint32).astype(np.int64)
    ids_b = np.frombuffer(b"".join([coded_b[i] for i in good]), np.uint32).astype(np.int64)
    if not good or not len(ids_a):
        return
    found = coalesce(a.sizes[ids_a], b.sizes[ids_b])
    text, group_ends = told(a, b, ids_a, ids_b, found)
    codes = ids_a[found.link_a] << 32 | ids_b[found.link_b]
    last_a = np.cumsum([len(coded_a[i]) // 4 for i in good])
    last_b = np.cumsum([len(coded_b[i]) // 4 for i in good])
    last_group = found.group_a[last_a - 1] + 1
    last_link = np.searchsorted(found.link_a, last_a, "left")
    last_char = group_ends[last_group - 1]
    bounds = np.stack((last_a, last_b, last_group, last_link, last_char))
    for i, (a0, b0, g0, l0, c0), (a1, b1, g1, l1, c1) in zip(good, np.concatenate((np.zeros((5, 1), np.int64), bounds), axis=1).T.tolist(),
                                                             bounds.T.tolist()):
        docs[i].add(a1 - a0, b1 - b0, g1 - g0, text[c0:c1 - 1], codes[l0:l1])


def align_texts(a: Side, b: Side, texts: list[str | None]) -> list[Document]:
    """A document for each text; texts whose bytes a side changes, null and empty ones have no tokens."""
    docs = [Document() for _ in texts]
    some, owners, size = [], [], 0
    for doc, text in zip(docs, texts):
        for segment in segments(text) if text else ():
            if some and size + len(segment) > SEGMENT_BYTES:
                align_segments(a, b, some, owners)
                some, owners, size = [], [], 0
            some.append(segment)
            owners.append(doc)
            size += len(segment)
    align_segments(a, b, some, owners)
    return [d if d.right else Document() for d in docs]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2 to the 32 in little room: byte by byte, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def sliced(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per slice of texts: its documents in arrays, its distinct id pairs with how often they are linked, and
    the number of the pair of each link, document after document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        a, b = sides(byte_file, piece_file)
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", SLICE_BYTES):
            done = align_texts(a, b, part.column("text").to_pylist())
            links = np.concatenate([np.zeros(0, np.int64)] + [c for d in done for c in d.codes])
            codes, which, times = np.unique(links, return_inverse=True, return_counts=True)
            digests = [d.digest.hexdigest() if d.digest else "" for d in done]
            rows = [[number], [part.column("id").to_pylist()], *[[[getattr(d, n) for d in done]] for n in ("n_a", "n_b", "n_groups")],
                    [[sum(map(len, d.codes)) for d in done]], [digests], [codes], [times], [packed(which)]]
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), *[longs] * 5, pa.list_(pa.string()), longs, longs, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)],
                                             [f.split()[0] for f in SLICED.split(", ")])
            number += 1

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SLICED)


def pair_counts(slices_of: DataFrame) -> DataFrame:
    """code (id of one side << 32 | id of the other), n (its links in the corpus) and best (highest of its second id)."""
    totals = written(slices_of.select(F.inline(F.arrays_zip("codes", "times"))).groupBy(F.col("codes").alias("code"))
                     .agg(F.sum("times").alias("n")), "pair-counts")
    second = F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = totals.groupBy(second).agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary at most
    return totals.withColumn("b", second).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


OUT = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, digest string"


def _per_document(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one slice with sums over their links; `right` has the corpus counts of the slice's pairs."""
    order = np.argsort(right.column("code").to_numpy())
    n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
    row = {c: left.column(c)[0].values if c not in ("slice", "links") else left.column(c)[0].as_py() for c in left.column_names}
    many = row["n_links"].to_numpy()
    which = unpacked(row["links"], int(many.sum()))
    bound = np.concatenate(([0], np.cumsum(many)))
    sums = []
    for of in (best, n):
        total = np.concatenate(([0], np.cumsum(of[which])))
        sums.append(pa.array(total[bound[1:]] - total[bound[:-1]]))
    columns = [row[c] for c in ("ids", "n_a", "n_b", "n_groups", "n_links")] + sums + [row["digests"]]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")])


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and digest of every row of `docs`, from its whole text.

    A text with a blank in front is encoded by both files.  Byte offsets where
    tokens of both sides end cut them into groups; tokens of a group that
    overlap are linked.  `count_sum` adds up, over a row's links, how many links
    of the corpus hold the same pair of ids, `n_best` counts the links whose
    pair is as frequent as any of its second id.  `digest` is the SHA-256 of the
    groups in decimal ids.  Null and empty texts, and texts that a side does not
    give back byte by byte, have no tokens: zeros and an empty digest.  Rows
    that repeat, and null ids, give a row each and count each; other columns are
    not read; no rows give no rows.
    """
    done = written(sliced(docs, byte_file, piece_file, id_col, text_col), "aligned")
    counts = written(pair_counts(done), "pair-ranks")
    asked = done.select(F.col("slice").alias("part"), F.explode("codes").alias("code"))
    found = asked.join(counts, "code").select("part", "code", "n", "best")
    whole = done.drop("codes", "times")
    out = whole.groupBy("slice").cogroup(found.groupBy("part")).applyInArrow(_per_document, OUT)
    return out.withColumnRenamed("id", id_col)
