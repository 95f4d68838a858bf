"""Ranked lexical search by norm buckets.

Every document becomes a sparse vector of impacts over the terms that the items
of a block ask for.  Vectors are ordered by their length and cut into buckets.
A score is a product of two vectors, so a bucket whose longest vector times the
length of an item cannot reach the item's present 20th score is passed over
(Cauchy-Schwarz).  Inside a bucket, bounds on the item's heaviest coordinates
leave few vectors, whose scores are then worked out exactly in integers.

The first buckets of all tasks are searched first.  The scores found there are
lower bounds for every item that hold in all tasks of the main search.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.shared import slices, written

MOST = 20
BLOCK_ITEMS = 2_000
BLOCK_BYTES = 4 << 20
BUCKET_ROWS = 1024
BUCKET_CELLS = 1 << 19
FOCUS = 0.9  # share of an item's squared length that its focus coordinates hold
SLACK = 1e-9  # bounds are in doubles, scores in integers: what lies this close to a bound is kept
LAST_ID = (1 << 63) - 1

# letters, digits and all that is not ASCII; A-Z become small, the rest of ASCII a blank
TERMS = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts after each other, numbered, and where each text's begin (one entry more than texts)."""
    filled = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    body = data.to_pybytes()[offsets[0]:offsets[-1]].translate(TERMS) if data else b""
    plain = pa.LargeStringArray.from_buffers(len(filled), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(body))
    split = pc.ascii_split_whitespace(plain)
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    starts = before[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return words.filter(full).dictionary_encode(), starts


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L; in long integers where the product leaves 64 bits."""
    if len(n) and int(n.max()) * 25 * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // total for x in n], np.int64)
    return 75 + 25 * n * documents // max(total, 1)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Items:
    """The items of a block as vectors over the block's terms: distinct terms, how often, and lengths."""

    ids: list[int | None]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray
    least: np.ndarray
    coordinate: list[np.ndarray] = field(default_factory=list)
    lengths: np.ndarray | None = None

    def __post_init__(self):
        self.coordinate = [n * np.sqrt(self.weights[t]) for t, n in zip(self.terms, self.times)]
        self.lengths = np.array([math.sqrt(float((c * c).sum())) for c in self.coordinate])


class Bucket:
    """Vectors by falling length: their cells by row, and by coordinate from the largest share of its vector down."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray):
        self.lengths, self.terms, self.impacts = lengths, terms, impacts
        self.bound = np.concatenate(([0], np.cumsum(sizes)))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        share = np.sqrt(weights[terms]) * impacts / lengths[rows]
        order = np.lexsort((-share, terms))
        self.rows, self.share = rows[order], share[order]
        self.known, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(order))

    def cells(self, term: int) -> slice:
        at = int(np.searchsorted(self.known, term))
        return slice(self.first[at], self.first[at + 1]) if at < len(self.known) and self.known[at] == term else slice(0, 0)

    def candidates(self, terms: np.ndarray, unit: np.ndarray, length: float, least: int) -> np.ndarray:
        """Rows that may score `least` or more with an item of these coordinates (divided by its `length`)."""
        reach = int(np.searchsorted(-self.lengths, -(least / length) * (1 - SLACK), "right"))  # longer ones come first
        if not reach:
            return np.zeros(0, np.int64)
        needed = least / (length * self.lengths[:reach])  # cosine that each row needs
        theta = min(1.0, float(needed[0]))  # the smallest of them, the longest row's
        order = np.argsort(-unit)
        mass = np.cumsum(unit[order] ** 2)
        focus = order[:int(np.searchsorted(mass, FOCUS)) + 1]
        inside = np.ones(reach, bool)
        partial, taken = np.zeros(reach), np.zeros(reach)
        for at in focus:
            cells = self.cells(int(terms[at]))
            q = float(unit[at])
            # the share of a row on this coordinate must lie within the angle that is left beside it
            spare = math.sqrt(max(0.0, (1 - q * q) * (1 - theta * theta)))
            low, high = q * theta - spare - SLACK, (1.0 if q >= theta else q * theta + spare) + SLACK
            rows, share = self.rows[cells], self.share[cells]
            fits = rows < reach
            rows, share = rows[fits], share[fits]
            if low > 0 or high < 1:
                good = np.full(reach, low <= 0)
                good[rows] = (share >= low) & (share <= high)
                inside &= good
            partial[rows] += q * share
            taken[rows] += share * share
        # what the other coordinates may add: by their lengths, or by the largest share that the bucket has on each
        other = order[len(focus):]
        rest = math.sqrt(max(0.0, 1.0 - float((unit[focus] ** 2).sum())))
        most = sum(float(unit[at]) * float(self.share[cells.start]) for at in other for cells in [self.cells(int(terms[at]))]
                   if cells.start < cells.stop)
        bound = partial + np.minimum(rest * np.sqrt(np.maximum(0.0, 1 - taken)), most) + SLACK
        return np.flatnonzero(inside & (bound >= needed * (1 - SLACK)))

    def scores(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Exact scores of rows; `table` holds the item's weight of every term."""
        sizes = self.bound[rows + 1] - self.bound[rows]
        ends = np.cumsum(sizes)
        cells = np.repeat(self.bound[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        total = np.concatenate(([0], np.cumsum(table[self.terms[cells]] * self.impacts[cells])))
        return total[ends] - total[ends - sizes]


@dataclass
class Best:
    """The best rows of one item so far."""

    most: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    null: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def add(self, score: np.ndarray, owner: np.ndarray, null: np.ndarray) -> None:
        score, owner, null = (np.concatenate(x) for x in ((self.score, score), (self.owner, owner), (self.null, null)))
        order = np.lexsort((owner, null, -score))[:self.most]
        self.score, self.owner, self.null = score[order], owner[order], null[order]

    def least(self, known: int) -> int:
        """Rows below this are not among the best."""
        return max(1, known, int(self.score[-1]) if len(self.score) == self.most else 0)


def _search(buckets: DataFrame, shared, most: int) -> DataFrame:
    """item, doc, score: the best rows of every item of each task's buckets, no worse than `least` of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best = [Best(most) for _ in items.ids]
        table = np.zeros(len(items.weights), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                owner, null, lengths, sizes, terms, impacts = (
                    batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("owners", "nulls", "lengths", "sizes", "terms", "impacts"))
                bucket = None
                least = np.array([b.least(int(x)) for b, x in zip(best, items.least)])
                for i in np.flatnonzero(lengths[0] * items.lengths * (1 + SLACK) >= least).tolist():
                    if bucket is None:
                        bucket = Bucket(lengths, sizes, terms, impacts, items.weights)
                    length = float(items.lengths[i])
                    rows = bucket.candidates(items.terms[i], items.coordinate[i] / length, length, int(least[i])) if length else ()
                    if len(rows):
                        table[items.terms[i]] = items.times[i] * items.weights[items.terms[i]]
                        found = bucket.scores(rows, table)
                        table[items.terms[i]] = 0
                        keep = found >= least[i]
                        best[i].add(found[keep], owner[rows[keep]], null[rows[keep]])
        for i, b in enumerate(best):
            if len(b.score):
                doc = pa.array(b.owner, mask=b.null)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i), pa.int32()), doc, pa.array(b.score)],
                                                 ["item", "doc", "score"])

    return buckets.mapInArrow(run, "item int, doc bigint, score bigint")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc, n (terms) and the asked terms with their counts of every text."""
    asked = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one block of items, bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(asked.value, pa.large_string())
        many = max(1, len(known))
        for part in slices(batches, "text"):
            coded, starts = terms_of(part.column("text"))
            number = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            term = number[coded.indices.to_numpy()].astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(starts))
            cells, tf = np.unique(row[term >= 0] * many + term[term >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(cells, np.arange(part.num_rows + 1) * many).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(np.diff(starts).astype(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array((cells % many).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], ["doc", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc bigint, n bigint, terms array<int>, tf array<bigint>")


def _vectors(counted: DataFrame, shared, documents: int, total: int) -> DataFrame:
    """owner, null, length, terms and impacts of the texts that hold a term of some weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for b in batches:
            sizes = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False)
            terms, tf = (b.column(c).flatten().to_numpy() for c in ("terms", "tf"))
            row = np.repeat(np.arange(b.num_rows), sizes)
            found = impact(tf, length_factor(b.column("n").to_numpy(), documents, total)[row])
            length = np.sqrt(np.bincount(row, weights[terms] * found.astype(np.float64) ** 2, b.num_rows))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            doc = b.column("doc")
            columns = [doc.fill_null(LAST_ID), pc.is_null(doc), pa.array(length), pa.ListArray.from_arrays(offsets, pa.array(terms)),
                       pa.ListArray.from_arrays(offsets, pa.array(found))]
            yield pa.RecordBatch.from_arrays(columns, ["owner", "null", "length", "terms", "impacts"])

    kind = "owner bigint, null boolean, length double, terms array<int>, impacts array<bigint>"
    return counted.mapInArrow(run, kind).where("length > 0")


def _buckets(vectors: DataFrame) -> DataFrame:
    """A row for each bucket of vectors, by falling length inside a task; `level` 0 is a task's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, waiting, rows, cells = 0, [], 0, 0

        def bucket() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            sizes = pc.list_value_length(whole.column("terms"))
            columns = [whole.column(c).combine_chunks() for c in ("owner", "null", "length")] + [sizes.combine_chunks()] + [
                whole.column(c).combine_chunks().flatten() for c in ("terms", "impacts")]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), *lists],
                                              ["level", "owners", "nulls", "lengths", "sizes", "terms", "impacts"])

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                used = int(ends[start - 1]) if start else 0
                room = int(np.searchsorted(ends, used + BUCKET_CELLS - cells, "right")) - start
                take = min(BUCKET_ROWS - rows, max(room, 0 if rows else 1), batch.num_rows - start)
                if take > 0:
                    waiting.append(batch.slice(start, take))
                    rows, cells, start = rows + take, cells + int(ends[start + take - 1]) - used, start + take
                if rows == BUCKET_ROWS or start < batch.num_rows:
                    yield bucket()
                    level, waiting, rows, cells = level + 1, [], 0, 0
        if rows:
            yield bucket()

    kind = ("level int, owners array<bigint>, nulls array<boolean>, lengths array<double>, sizes array<int>, terms array<int>, "
            "impacts array<bigint>")
    return vectors.sortWithinPartitions(F.col("length").desc(), "owner").mapInArrow(run, kind)


def _block(texts: DataFrame, rows: list, most: int) -> DataFrame:
    """The ranks of one block of items; `rows` are its ids and texts."""
    spark = texts.sparkSession
    coded, starts = terms_of(pa.array([r["text"] for r in rows], pa.string()))
    vocabulary = coded.dictionary.to_pylist()
    asked = [Counter(coded.indices[a:b].to_pylist()) for a, b in zip(starts.tolist(), starts[1:].tolist())]
    counted = written(_counted(texts, vocabulary), "ranked-terms")
    documents, total = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # a block's terms
    weights = np.array([weight(documents, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    terms = [np.array(sorted(c), np.int64) for c in asked]
    times = [np.array([c[t] for t in sorted(c)], np.int64) for c in asked]
    items = Items([r["id"] for r in rows], terms, times, weights, np.zeros(len(rows), np.int64))
    shared = spark.sparkContext.broadcast(items)
    buckets = written(_buckets(_vectors(counted, shared, documents, total)), "ranked-buckets")
    first = _ranked(_search(buckets.where("level = 0"), shared, most), most).where(F.col("rank") == most)
    for r in first.collect():  # one row for each item of the block
        items.least[r["item"]] = r["score"]
    found = _ranked(_search(buckets, spark.sparkContext.broadcast(items), most), most)
    names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], "item int, id bigint")
    return found.join(F.broadcast(names), "item").select("id", "rank", "doc", "score")  # at most BLOCK_ITEMS names


def search(docs: DataFrame, items: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item, rank (int, from 1), document and score (long) of the `most` best documents of every item.

    Terms, weights and scores are stated with the query in the README; only
    documents with a score above 0 are ranked, equal scores by ascending id,
    null ids last.  Null and empty texts have no terms.  Rows that repeat a
    document's id are documents of their own; items that repeat as a whole count
    once, items that share an id are ranked each.  An item without terms, or no
    rows on either side, gives no rows.  Other columns are not read.

    Items are taken in blocks of `block_items` items and BLOCK_BYTES of text
    (about); a block's terms, at most as many as its text has, go to every task.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    asked = written(items.select(F.col(item_col).cast("bigint").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct(),
                    "items")
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block_items), -(-size // BLOCK_BYTES))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    out = None
    for k in range(blocks):
        rows = asked.where(place == k).collect()  # one block
        if rows or out is None and k == blocks - 1:
            part = _block(texts, sorted(rows, key=lambda r: (r["id"] is None, r["id"], r["text"])), most)
            part = part if blocks == 1 else written(part, "ranked")
            out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
