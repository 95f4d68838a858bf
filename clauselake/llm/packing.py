"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Only how many pieces have each length decides a packing, so the instance is a
histogram with at most `capacity` entries, however large the corpus is.  Small
sets that provably dominate every alternative for their longest piece are fixed
first, as often as the counts allow; what remains is packed best-fit, longest
first.  The outcome is a bounded list of runs ("the pieces of length n ranked
from a to b go k per sequence, from sequence s on, at offset o"), which every
task looks up for its own pieces.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.shared import bucket_count, slices, written

CAPACITY = 2048
END_ID = 0
CACHE_PARTS = 200_000
SLICE_BYTES = 4 << 20
PIECES = "id bigint, piece int, start bigint, length bigint, ids binary"


# words of these characters only are cut into parts here: they are their own normal form, and none is a blank
PLAIN = re.compile(r"[\x21-\x7e\xa1-\u024f]+")
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Remembered:
    """A mapping of bounded size in two generations, so that what is used often stays."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def age(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """Keys that are not known; known ones are young afterwards."""
        for k in keys & self.old.keys():
            self.young[k] = self.old.pop(k)
        return list(keys - self.young.keys())


class WordIds:
    """Token ids of texts by a word tokenizer, each distinct part of a word encoded once.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words one after the other; it lower-cases words and
    cuts them into letters, digits and other signs, so the ids of a plain word
    are those of these parts.  Other words are encoded whole.  Parts are
    remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Remembered(CACHE_PARTS)

    def parts_of(self, word: bytes) -> tuple[bytes, ...]:
        """The parts of a word, lower-cased; none if the word has to be encoded whole."""
        if word.isalpha():
            return (word.lower(),)
        if word[:-1].isalpha() and word[-1:] in (b".", b","):
            return word[:-1].lower(), word[-1:]
        text = word.decode()
        low = text.lower()
        if PLAIN.fullmatch(text) and len(low) == len(text) and "<|" not in text:
            return tuple(p.encode() for p in PART.findall(low))
        return ()

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        self.parts.age()
        cut = [self.parts_of(w) for w in words]
        known = self.parts.young
        new = self.parts.missing({p for parts in cut for p in parts})
        for at in range(0, len(new), 1 << 13):
            some = new[at:at + (1 << 13)]
            coded = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            ids = np.array(coded.ids, "<u4").tobytes()
            ends = [4 * x for x in np.searchsorted(np.array(coded.word_ids), np.arange(len(some)), "right").tolist()]
            known.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        return [known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts]) if parts else np.array(
            self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w, parts in zip(words, cut)]

    def packed(self, texts: pa.Array, end_id: int = END_ID) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then `end_id`; null counts as empty.

        Arrow splits the texts and numbers the distinct words; the ids of all
        words are put together by their numbers.
        """
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary.cast(pa.binary()).to_pylist())
        length = np.array([len(x) // 4 for x in ids], np.int64)
        start = np.cumsum(length) - length
        word = coded.indices.to_numpy()
        size = length[word]
        before = np.cumsum(size) - size
        table = np.frombuffer(b"".join(ids), "<u4")
        tokens = table[np.repeat(start[word] - before, size) + np.arange(int(size.sum()))]
        bound = np.append(before, len(tokens))[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        end = np.array([end_id], "<u4").tobytes()
        return [tokens[a:b].tobytes() + end for a, b in zip(bound, bound[1:])]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length and ids (binary, little-endian unsigned 32 bits) of the pieces of every text.

    A text is its token ids and END_ID; only longer ones than `capacity` are
    cut, into pieces of `capacity`, the last one may be shorter.  Null texts
    are empty (END_ID alone).  Rows that repeat an id give pieces each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer)
        for part in slices(batches, "text", SLICE_BYTES):
            rows = []
            for doc, packed in zip(part.column("id").to_pylist(), words.packed(part.column("text"))):
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    ids = packed[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(ids) // 4, ids))
            columns = zip(*rows)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Runs: length, first rank, pieces per sequence, first sequence, offset in it; `fixed` sequences came by dominance."""

    capacity: int
    left: np.ndarray
    used: np.ndarray
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0

    def take(self, pattern: list[tuple[int, int]], times: int) -> None:
        """Fill `times` sequences with `pattern`: pairs of length and pieces of that length."""
        offset = 0
        for length, per in pattern:
            self.add(length, per, times, self.sequences, offset)
            offset += per * length
        self.sequences += times

    def add(self, length: int, per: int, times: int, first: int, offset: int) -> None:
        """Put `per` pieces of a length into each of `times` sequences from `first` on, at `offset`."""
        self.runs.append((length, int(self.used[length]), per, first, offset))
        self.used[length] += per * times
        self.left[length] -= per * times

    def often(self, pattern: list[tuple[int, int]]) -> int:
        return min(int(self.left[length]) // per for length, per in pattern)


def _pattern(lengths: list[int]) -> list[tuple[int, int]]:
    return [(n, lengths.count(n)) for n in sorted(set(lengths), reverse=True)]


def dominating(plan: Plan, longest: int) -> list[tuple[int, int]] | None:
    """A set with a piece of length `longest` that dominates all feasible ones, if three pieces or less decide it.

    With room R beside it: nothing fits - the piece alone; one fills R - that
    pair; two never fit - the largest that fits.  If three never fit, a pair
    beats all when it is as large as the best two together, and the best two
    beat all when the larger is the largest that fits and no two pieces longer
    than the smaller fit, so each piece of any other set is matched by one of
    these that is no shorter.
    """
    room = plan.capacity - longest
    left = plan.left.copy()
    left[longest] -= 1
    there = np.flatnonzero(left)
    fit = there[there <= room]
    if not len(fit):
        return _pattern([longest])
    best = int(fit[-1])
    if best == room:
        return _pattern([longest, best])
    small = np.repeat(fit[:3], np.minimum(left[fit[:3]], 3))[:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return _pattern([longest, best])
    if len(small) == 3 and small.sum() <= room:
        return None
    after = left.copy()
    after[best] -= 1
    second = np.flatnonzero(after[:room - best + 1])
    partner = fit[np.maximum(np.searchsorted(fit, room - fit, "right") - 1, 0)]
    sums = np.where((fit + partner <= room) & ((partner != fit) | (left[fit] > 1)), fit + partner, 0)
    if best >= int(sums.max()):
        return _pattern([longest, best])
    if len(second):
        b = int(second[-1])
        longer = there[there > b]
        two = np.repeat(longer[:2], np.minimum(left[longer[:2]], 2))[:2]
        if len(two) < 2 or two.sum() > room:
            return _pattern([longest, best, b])
    return None


def reduce_by_dominance(plan: Plan) -> None:
    """Fix dominating sets, longest pieces first, until no length has one.

    Taking pieces away only removes alternatives, so a set stays dominating for
    as long as its pieces last and is fixed that often at once.
    """
    again = True
    while again:
        again = False
        for length in np.flatnonzero(plan.left)[::-1]:
            while plan.left[length] and (found := dominating(plan, int(length))):
                times = plan.often(found)
                plan.take(found, times)
                plan.fixed += times
                again = True


def best_fit(plan: Plan) -> None:
    """Pack what is left, longest first: every piece goes into the fullest open sequence that has room, else into a new one.

    Open sequences are kept as ranges of equal room.  A sequence that has just
    been given a piece is again the fullest one for its length, so it is filled
    with as many as fit, and a whole range at once.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}  # room: first sequence and number of sequences
    rooms: list[int] = []  # the rooms that have sequences, ascending
    for length in np.flatnonzero(plan.left)[::-1].tolist():
        while left := int(plan.left[length]):
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, first, n = plan.capacity, plan.sequences, -(-left // (plan.capacity // length))
                plan.sequences += n
            else:
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            per = min(room // length, left)
            times = min(n, left // per)
            plan.add(length, per, times, first, plan.capacity - room)
            for rest, start, count in ((room - per * length, first, times), (room, first + times, n - times)):
                if rest and count:
                    if rest not in ranges:
                        bisect.insort(rooms, rest)
                    ranges.setdefault(rest, []).append((start, count))


def solve(histogram: np.ndarray, capacity: int) -> Plan:
    """A plan for `histogram[n]` pieces of length n (1 to capacity)."""
    plan = Plan(capacity, histogram.astype(np.int64), np.zeros(capacity + 1, np.int64))
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan


def pack(rows: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """`rows` (with a `length` of 1 to capacity) plus sequence_id and offset, gapless from 0 in every sequence.

    Ranks within a length are counted per hash bucket of the keys and added up,
    so a length that a third of all pieces have spreads over all tasks.  The
    driver sees one count per length.  No rows give no rows.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*keys, "length"), F.lit(bucket_count(spark))).cast("int")
    placed = written(rows.withColumn("_bucket", bucket), "pieces")
    counts = written(placed.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        histogram[r["length"]] = r["n"]
    plan = solve(histogram, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    lookup = spark.sparkContext.broadcast(runs)  # bounded: a run for each distinct length of each pattern

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lookup.value
        spread = 1 << 40
        starts = known[:, 0] * spread + known[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = known[np.searchsorted(starts, length * spread + rank, "right") - 1]
            place = rank - run[:, 1]
            columns = {n: b.column(n) for n in b.schema.names if n not in ("_rank", "_bucket")}
            yield pa.RecordBatch.from_pydict(columns | {
                "sequence_id": pa.array(run[:, 3] + place // run[:, 2]), "offset": pa.array(run[:, 4] + place % run[:, 2] * length)})

    before = counts.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    ranked = (placed.join(before, ["length", "_bucket"])
              .withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)) - 1
                          + F.coalesce("before", F.lit(0))).drop("before"))
    fields = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes if n not in ("_rank", "_bucket"))
    return ranked.mapInArrow(look, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, its length and its token ids (binary), put together from the pieces by offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
