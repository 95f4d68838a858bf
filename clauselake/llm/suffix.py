"""Removal of long repeated byte strings by run-length suffix indexes.

A string of WIDTH bytes belongs to the place of its smallest GRAM-byte hash.
Neighbouring strings with the same place form a run, so two equal strings lie
in runs with the same key, and each key can be decided by itself:

* keys of one run are unique and go;
* equal runs found twice or more are repeated as a whole;
* what is left - different runs under one key - is put into a suffix index per
  block of keys: suffixes are ranked, their Burrows-Wheeler transform is cut
  into runs of equal bytes, matches are measured only at the sampled ends of
  these runs, and the statistics of all other positions are streamed from them,
  one byte less with every step.  Strings whose match is long enough are marked.

Keys under which very many different runs lie are counted string by string
instead, so no task ever holds more than a bounded block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import joined, mixed, slices, utf8, written

WIDTH = 200
GRAM = 32
MAX_RUN = 1024
SEGMENT = 1 << 20
BLOCK_BYTES = 1 << 20
MAX_GROUP = 2000
LAST_ID = (1 << 63) - 1
SEPARATOR = 0xFF  # never part of UTF-8

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Rolling:
    """Hashes of all substrings of one length of a buffer by prefix sums, modulo 2^64; they choose keys, where a clash does no harm."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data)).bit_length())
        if size not in self._powers:
            one = np.full(size, _BASE, np.uint64)
            back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            one[0] = back[0] = 1
            self._powers.clear()
            self._powers[size] = np.multiply.accumulate(one), np.multiply.accumulate(back)
        up, self.down = self._powers[size]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:len(data)], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width))


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """128-bit hashes of substrings: equal ones decide what is removed, and sums modulo 2^64 are equal for some different texts."""
    body = memoryview(data.tobytes())
    return [hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist())]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours, by running minima from both ends of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def runs_of(data: np.ndarray, starts: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of the strings of several texts in one buffer: text number, first string, strings, key, content hash, and
    whether the key's place occurs in it more than once (then strings may repeat inside the run)."""
    empty = {k: np.zeros(0, np.int64) for k in ("text", "at", "n", "key", "twice")} | {"content": []}
    if len(data) < width:
        return empty
    rolling = Rolling(data)
    hashes = rolling.all(gram)
    place = np.arange(len(hashes), dtype=np.uint64) & np.uint64(SEGMENT * 2 - 1)
    top = hashes & ~np.uint64(SEGMENT * 2 - 1)
    reach = width - gram + 1
    first = _position(window_min(top | place, reach), reach)
    last = _position(window_min(top | (np.uint64(SEGMENT * 2 - 1) - place), reach), reach, backwards=True)
    count = len(first)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:count]
    inside = np.arange(count) + width <= starts[text + 1]
    key = hashes[first]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (key[at[1:]] != key[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    pieces = -(-size // MAX_RUN)  # a run over a periodic stretch may be long
    index = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[begin][index] + nth * MAX_RUN
    n = np.minimum(size[index] - nth * MAX_RUN, MAX_RUN)
    return {"text": text[start], "at": start - starts[text[start]], "n": n, "key": key[start].view(np.int64),
            "content": digests(data, start, start + n - 1 + width),
            "twice": (first[start] != last[start + n - 1]).astype(np.int64)}


def _position(minima: np.ndarray, reach: int, backwards: bool = False) -> np.ndarray:
    """Place of each window's minimum, from the low bits."""
    low = (minima & np.uint64(SEGMENT * 2 - 1)).astype(np.int64)
    if backwards:
        low = SEGMENT * 2 - 1 - low
    window = np.arange(len(minima))
    return window + (low - window) % (SEGMENT * 2)


def segments(text: bytes, width: int = WIDTH) -> Iterator[tuple[int, bytes]]:
    """Parts of a very long text that together hold all its strings once, and where they start."""
    step = SEGMENT - width + 1
    for at in range(0, max(1, len(text) - width + 1), step):
        yield at, text[at:at + SEGMENT]


def _runs(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """key, content, owner, mark, place (first string and number of strings), twice: a row for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SEGMENT // 2):
            cut = [(i, at, x) for i, t in enumerate(utf8(part.column("text"))) for at, x in segments(t, width)]
            found = runs_of(*joined([x for _, _, x in cut]), width, gram)
            of = np.array([i for i, _, _ in cut], np.int64)[found["text"]] if cut else np.zeros(0, np.int64)
            shift = np.array([at for _, at, _ in cut], np.int64)[found["text"]] if cut else np.zeros(0, np.int64)
            owner, mark = (part.column(c).to_numpy(zero_copy_only=False) for c in ("owner", "mark"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["key"]), pa.array(found["content"], pa.binary()), pa.array(owner[of]), pa.array(mark[of]),
                 pa.array((found["at"] + shift) * (MAX_RUN * 2) + found["n"]), pa.array(found["twice"])],
                ["key", "content", "owner", "mark", "place", "twice"])

    return docs.mapInArrow(run, "key bigint, content binary, owner bigint, mark bigint, place bigint, twice bigint")


class RunIndex:
    """Run-length Burrows-Wheeler transform of a few strings, with match lengths sampled where its runs end."""

    def __init__(self, strings: list[bytes], depth: int):
        self.data = np.frombuffer(b"".join(s + b"\xff" for s in strings) + b"\xff" * 8, np.uint8)
        self.n = len(self.data) - 8
        self.levels: dict[int, np.ndarray] = {}
        packed = np.zeros(self.n, np.uint64)
        for i in range(8):
            packed = packed << np.uint64(8) | self.data[i:i + self.n].astype(np.uint64)
        span, rank = 8, self._rank(packed)
        while True:
            self.levels[span] = rank
            if span >= depth:
                break
            after = np.zeros(self.n, np.int64)
            after[:max(0, self.n - span)] = rank[span:] + 1
            rank = self._rank(rank * (self.n + 2) + after)
            span *= 2
        self.order = np.argsort(rank, kind="stable")
        before = self.data[self.order - 1]
        tied = rank[self.order[1:]] == rank[self.order[:-1]]
        self.ends = np.flatnonzero((before[1:] != before[:-1]) | tied)  # last positions of runs, and ties of the ranking

    @staticmethod
    def _rank(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes, by halving steps."""
        length = np.zeros(len(a), np.int64)
        for span in sorted(self.levels, reverse=True):
            inside = np.maximum(a, b) + length < self.n
            x, y = np.minimum(a + length, self.n - 1), np.minimum(b + length, self.n - 1)
            length += span * (inside & (self.levels[span][x] == self.levels[span][y]))
        for _ in range(7):
            inside = np.maximum(a, b) + length < self.n
            x, y = np.minimum(a + length, self.n - 1), np.minimum(b + length, self.n - 1)
            length += inside & (self.data[x] == self.data[y])
        return length

    def statistics(self) -> np.ndarray:
        """A match length with some other suffix for every position, exact up to the depth of the ranking."""
        a, b = self.order[self.ends], self.order[self.ends + 1]
        length = self.common(a, b)
        reach = np.zeros(self.n, np.int64)
        np.maximum.at(reach, a, length + a)
        np.maximum.at(reach, b, length + b)
        return np.maximum.accumulate(reach) - np.arange(self.n)


def repeated(strings: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Starts of the strings of `width` bytes in each string that start anywhere else in these strings."""
    index = RunIndex(strings, width)
    long = index.statistics() >= width
    out, at = [], 0
    for s in strings:
        out.append(np.flatnonzero(long[at:at + max(0, len(s) - width + 1)]))
        at += len(s) + 1
    return out


def _stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring starts as (first, number)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    first = starts[np.concatenate(([0], cut))]
    return list(zip(first.tolist(), np.diff(np.concatenate(([0], cut, [len(starts)]))).tolist()))


def _strings(keyed: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """The bytes of the chosen runs, cut out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for owner, mark, text, runs in zip(*(b.column(c).to_pylist() for c in ("owner", "mark", "text", "runs"))):
                body = text.encode()
                for r in runs:
                    at, n = divmod(r["place"], MAX_RUN * 2)
                    rows.append((r["key"], owner, mark, at, r["n"], r["members"], body[at:at + n - 1 + width]))
            types = (*[pa.int64()] * 6, pa.binary())
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["key", "owner", "mark", "at", "n", "members", "string"])

    listed = reps.groupBy("owner", "mark").agg(F.collect_list(F.struct("key", "place", "n", "members")).alias("runs"))
    return (keyed.join(listed, ["owner", "mark"]).select("owner", "mark", "text", "runs")
            .mapInArrow(run, "key bigint, owner bigint, mark bigint, at bigint, n bigint, members bigint, string binary"))


def _indexed(strings: DataFrame, width: int) -> DataFrame:
    """owner, mark, first, strings: what repeats among different runs of one key; blocks of whole keys at a time."""

    def solve(block: list[tuple]) -> list[tuple]:
        found = repeated([r[-1] for r in block], width)
        return [(owner, mark, at + first, size) for (_, owner, mark, at, n, _, _), starts in zip(block, found) if n == 1
                for first, size in _stretches(starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*solve(block))) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["owner", "mark", "first", "size"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "owner", "mark", "at", "n", "members", "string"))):
                if size > BLOCK_BYTES and row[0] != last:
                    yield out()
                    block, size = [], 0
                block.append(row)
                size, last = size + len(row[-1]) + 1, row[0]
        if block:
            yield out()

    return (strings.repartition("key").sortWithinPartitions("key")
            .mapInArrow(run, "owner bigint, mark bigint, first bigint, size bigint"))


def _counted(strings: DataFrame, width: int) -> DataFrame:
    """The same for keys with very many different runs: every string is counted by a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(hashlib.blake2b(s[i:i + width], digest_size=16).digest(), owner, mark, at + i, n)
                    for owner, mark, at, n, s in zip(*(b.column(c).to_pylist() for c in ("owner", "mark", "at", "n", "string")))
                    for i in range(len(s) - width + 1)]
            for k in range(0, len(rows), 1 << 16):
                part = list(zip(*rows[k:k + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.binary()), *[pa.array(c, pa.int64()) for c in part[1:]]],
                                                 ["h", "owner", "mark", "first", "n"])

    each = strings.mapInArrow(run, "h binary, owner bigint, mark bigint, first bigint, n bigint")
    often = each.groupBy("h").agg(F.sum("n").alias("all")).where("all > 1").select("h")
    return each.where("n = 1").join(often, "h").select("owner", "mark", "first", F.lit(1).cast("bigint").alias("size"))


def repeated_ranges(docs: DataFrame, width: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The keyed texts, and rows (owner, mark, first, size): strings that start at first, first + 1, … are repeated."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce("id", F.lit(LAST_ID)).alias("owner"), F.xxhash64(text).alias("mark"), text.alias("text"), "id")
    runs = _runs(keyed.select("owner", "mark", "text"), width, gram)
    several = (runs.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
               .where("n > 1 or twice > 0").select("key"))
    shared = written(runs.join(several, "key"), "runs")
    same = shared.groupBy("key", "content").agg(F.count("*").alias("n"), F.max("twice").alias("twice"),
                                                F.min(F.struct("owner", "mark", "place")).alias("rep"))
    same = written(same, "run-classes")
    whole = (shared.join(same.where("n > 1").select("key", "content"), ["key", "content"])
             .select("owner", "mark", F.floor(F.col("place") / (MAX_RUN * 2)).alias("first"), (F.col("place") % (MAX_RUN * 2)).alias("size")))
    open_keys = (same.groupBy("key").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("twice").alias("twice"))
                 .where("least = 1 and (members > 1 or twice > 0)").select("key", "members"))
    reps = same.join(open_keys, "key").select("key", "n", "members", "rep.*")
    strings = written(_strings(keyed, reps, width), "run-strings")
    few = _indexed(strings.where(F.col("members") <= MAX_GROUP), width)
    many = _counted(strings.where(F.col("members") > MAX_GROUP), width)
    return keyed, whole.union(few).union(many)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, spans (start, end) removed, and kept (binary, the bytes left) of every row.

    A byte goes if a string of `width` bytes over it also starts anywhere else,
    in the same text or another one.  Null texts are empty; shorter texts stay
    whole.  Rows that repeat are texts of their own, so repeated texts of that
    length go entirely.  Other columns are not read.
    """
    keyed, ranges = repeated_ranges(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), width, gram)
    listed = ranges.distinct().groupBy("owner", "mark").agg(F.collect_list(F.struct("first", "size")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spans, kept, sizes = b.column("id"), [], [], []
            for text, found in zip(utf8(b.column("text")), b.column("ranges").to_pylist()):
                cover = np.zeros(len(text) + 1, np.int64)
                for r in found or ():
                    cover[r["first"]] += 1
                    cover[min(len(text), r["first"] + r["size"] - 1 + width)] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                cut = _stretches(np.flatnonzero(gone))
                spans.append([{"start": s, "end": s + n} for s, n in cut])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if cut else text)
                sizes.append(len(text))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             ["id", "n_bytes", "spans", "kept"])

    out = keyed.join(listed, ["owner", "mark"], "left").select("id", "text", "ranges").mapInArrow(
        run, "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)
