"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, and long paragraphs further at words whose hash
says so, so an edit changes few parts.  Each part's digest is added to three
cells (count, xor of digests, xor of checks) of a sketch.  Subtracting the
sketches of two texts leaves the digests that they do not share; peeling cells
that hold one digest recovers them.  If peeling gets stuck, both sketches are
built anew with four times the cells.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.shared import bucket_count, mixed, slices, utf8

CELLS = 12
GROWTH = 4
ROOM = 16
CACHE_WORDS = 50_000
HASHES = 3
CUT = 8
SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
CHECK = np.uint64(0x082EFA98EC4E6C89)


def digests(text: bytes) -> list[int]:
    """64-bit digests of a text's parts, each with how often it came before; equal for equal texts only.

    A part ends at a line end, and after a word whose hash is divisible by CUT.
    Its blanks count, so the parts together are the whole text.
    """
    out, seen = [], {}
    for line in text.split(b"\n"):
        words = line.split(b" ")
        start = 0
        for i, w in enumerate(words, 1):
            if i == len(words) or hash_of(w) % CUT == 0:
                part = b" ".join(words[start:i])
                nth = seen[part] = seen.get(part, -1) + 1
                out.append(xxhash.xxh3_64_intdigest(part, nth))
                start = i
    return out


_WORDS: dict[bytes, int] = {}


def hash_of(word: bytes) -> int:
    found = _WORDS.get(word)
    if found is None:
        if len(_WORDS) > CACHE_WORDS:
            _WORDS.clear()
        found = _WORDS[word] = xxhash.xxh3_64_intdigest(word) & 0xFFFF
    return found


class Sketches:
    """Sketches of many digest sets at once: sketch i has `cells[i]` cells, one after the other."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.starts = np.concatenate(([0], np.cumsum(cells)))
        total = int(self.starts[-1])
        self.count, self.keys, self.checks = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)

    def places(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The three cells of each key: one in each third of its owner's sketch."""
        third = (self.cells[owner] // HASHES).astype(np.uint64)
        rows = [(mixed(keys ^ salt) % third).astype(np.int64) + self.starts[owner] + i * third.astype(np.int64)
                for i, salt in enumerate(SALTS)]
        return np.concatenate(rows)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        at = self.places(keys, owner)
        np.add.at(self.count, at, np.tile(sign, HASHES))
        np.bitwise_xor.at(self.keys, at, np.tile(keys, HASHES))
        np.bitwise_xor.at(self.checks, at, np.tile(mixed(keys ^ CHECK), HASHES))

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Digests recovered per sketch, and which sketches came out empty (all recovered)."""
        owner_of = np.repeat(np.arange(len(self.cells)), self.cells)
        found = np.zeros(len(self.cells), np.int64)
        look = np.arange(len(self.count))
        while True:
            pure = look[(np.abs(self.count[look]) == 1) & (mixed(self.keys[look] ^ CHECK) == self.checks[look])]
            if not len(pure):
                break
            _, first = np.unique(self.keys[pure] ^ mixed(owner_of[pure].astype(np.uint64)), return_index=True)
            one = pure[first]
            keys, owner, sign = self.keys[one].copy(), owner_of[one], -self.count[one]
            np.add.at(found, owner, 1)
            self.add(keys, owner, sign)
            look = np.unique(self.places(keys, owner))
        bad = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        left = np.bincount(owner_of[bad], minlength=len(self.cells)) if bad.any() else np.zeros(len(self.cells), np.int64)
        return found, left == 0


def _flat(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return np.array([d for s in sets for d in s], np.uint64), owner


def sketch_bytes(sets: list[list[int]], cells: int = CELLS) -> list[bytes]:
    """A fingerprint of each set: its size and the cells of its smallest sketch."""
    made = Sketches(np.full(len(sets), cells, np.int64))
    keys, owner = _flat(sets)
    made.add(keys, owner, np.ones(len(keys), np.int64))
    width = cells
    return [np.array([len(s)], "<u4").tobytes() + made.count[i * width:(i + 1) * width].astype("<u2").tobytes()
            + made.keys[i * width:(i + 1) * width].astype("<u8").tobytes()
            + made.checks[i * width:(i + 1) * width].astype("<u4").tobytes() for i, s in enumerate(sets)]


def differences(left: list[list[int]], right: list[list[int]], cells: int = CELLS) -> np.ndarray:
    """How many digests the sets of each pair do not share, by subtracting and peeling sketches; larger ones on failure.

    Sketches grow up to ROOM cells for each digest of a pair, where peeling fails
    by chance only; such a pair is compared digest by digest.
    """
    out = np.zeros(len(left), np.int64)
    todo = np.arange(len(left))
    size = cells
    while len(todo):
        a, a_owner = _flat([left[i] for i in todo])
        b, b_owner = _flat([right[i] for i in todo])
        made = Sketches(np.full(len(todo), size, np.int64))
        made.add(np.concatenate([a, b]), np.concatenate([a_owner, b_owner]),
                 np.concatenate([np.ones(len(a), np.int64), -np.ones(len(b), np.int64)]))
        found, whole = made.peel()
        out[todo[whole]] = found[whole]
        size *= GROWTH
        left_over = todo[~whole]
        full = np.array([size > ROOM * (len(left[i]) + len(right[i])) + ROOM * cells for i in left_over], bool)
        for i in left_over[full]:
            out[i] = len(set(left[i]) ^ set(right[i]))
        todo = left_over[~full]
    return out


def likeness(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    """Shared digests over all digests of each pair, 0 to 1."""
    apart = differences(left, right)
    both = np.array([len(a) + len(b) for a, b in zip(left, right)], np.int64)
    shared = (both - apart) // 2
    return shared / np.maximum(shared + apart, 1)


def _constant(values: list[int]) -> Column:
    """An array literal that costs the planner one expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null: empty) and the digests of every row, as 64-bit little-endian numbers one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            packed = [np.array(digests(t), "<u8").tobytes() for t in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), pa.array(packed, pa.binary())],
                                             ["id", "text", "digests"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).mapInArrow(
        run, "id bigint, text string, digests binary")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and digests of each row, and text and digests of the next row in descending order of ids; after the last
    row comes the first.

    Ids are dealt into ranges at approximate quantiles, one per bucket; the
    first row of a range is copied to the range before it, so each range finds
    its neighbours by itself.  Null texts are empty; null ids come last; equal
    ids are ordered by their texts' hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.coalesce("id", F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    n = bucket_count(docs.sparkSession, 2)
    quantiles = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(quantiles or []), reverse=True)  # at most one per bucket
    above = F.size(F.filter(_constant(cuts), lambda c: c >= owner)) if cuts else F.lit(0)
    placed = rows.select("id", "mark").withColumn("range", above)
    heads = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max(F.struct(owner, "mark")).alias("top")).collect()}
    rows = with_digests(docs, id_col, text_col).withColumns({"mark": F.xxhash64("text"), "range": above})
    if not heads:
        return rows.select("id", "text", "digests", F.col("text").alias("next_text"), F.col("digests").alias("next_digests"))
    used = sorted(heads)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    known = [[heads[r][0] if r in heads else 0 for r in range(len(cuts) + 1)],
             [heads[r][1] if r in heads else 0 for r in range(len(cuts) + 1)], [before.get(r, 0) for r in range(len(cuts) + 1)]]
    top_owner, top_mark, to = (F.get(_constant(v), F.col("range")) for v in known)
    own = F.struct(F.col("range").cast("bigint").alias("range"), F.lit(0).alias("copy"))
    head = (top_owner == owner) & (top_mark == F.col("mark"))
    both = F.array(own, F.struct(to.alias("range"), F.lit(1).alias("copy")))
    dealt = rows.select("id", "text", "digests", "mark", F.explode(F.when(head, both).otherwise(F.array(own))).alias("at"))
    span = Window.partitionBy("at.range").orderBy("at.copy", owner.desc(), F.desc("mark"))
    follows = {"next_text": F.lead("text").over(span), "next_digests": F.lead("digests").over(span)}
    return dealt.withColumns(follows).where("at.copy = 0").select("id", "text", "digests", *follows)


def edited(text: Column, following: Column) -> Column:
    """`text` with its last third of code points replaced by as many from the start of `following`."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def compare_versions(rows: DataFrame, id_col: str = "id", first: str = "digests", second: str = "edited",
                     other: str = "next_digests", cells: int = CELLS, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in `carry`, the fingerprints of two versions, and the likeness of the first to the second and to
    another text.

    The first and the other are given by their digests, the second by its text;
    only that text goes through the tasks' Python.  A null text is empty; two
    empty texts are alike.
    """

    def unpacked(column: pa.Array) -> list[list[int]]:
        return [np.frombuffer(x or b"", "<u8").tolist() for x in column.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "b", 1 << 18):
            a, c = (unpacked(part.column(k)) for k in "ac")
            b = [digests(t) for t in utf8(part.column("b"))]
            shown = [pa.array([base64.b64encode(s).decode() for s in sketch_bytes(sets, cells)]) for sets in (a, b)]
            yield pa.RecordBatch.from_arrays(
                [part.column(k) for k in kept] + [*shown, pa.array(likeness(a, b)), pa.array(likeness(a, c))],
                [*kept, "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    read = rows.select(F.col(id_col).alias("id"), *[F.col(k).alias(f"_{k}") for k in carry], F.col(first).alias("a"),
                       F.col(second).alias("b"), F.col(other).alias("c"))
    kept = read.columns[:-3]
    types = ", ".join(f"`{n}` {t}" for n, t in read.dtypes[:-3])
    found = read.mapInArrow(run, types + ", fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnsRenamed({f"_{k}": k for k in carry})
