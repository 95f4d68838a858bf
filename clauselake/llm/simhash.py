"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are cut into five blocks; two that differ in at most two bits
agree in three blocks at least, so joining on every choice of three blocks
finds all close pairs, whose Hamming distance is then checked.  Equal
fingerprints meet once, before any join.  In buckets too full for pairs the
same links come from shared midpoints: fingerprints two bits apart have a value
in common that is one bit or less from either, and all that share such a value
are linked to the smallest of them.  Groups come from min-label rounds over the
links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import slices, utf8, written

SEED = 42
SHINGLE = 3
BLOCKS = (13, 13, 13, 13, 12)
SHARED = 3
DISTANCE = 2
PAIR_BUCKET = 48
LAST_ID = (1 << 63) - 1
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 values of a text's word shingles; zero without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the 64 bits as a signed long) and mark (a hash of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in utf8(part.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found), part.column("mark")], ["id", "fp", "mark"])

    return (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), text_mark(F.col(text_col)).alias("mark"))
            .mapInArrow(run, "id bigint, fp bigint, mark bigint"))


def _masks() -> list[int]:
    """The bits of every choice of SHARED blocks, as signed longs."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    blocks = [((1 << n) - 1) << at for n, at in zip(BLOCKS, starts)]
    full = [sum(blocks[i] for i in chosen) for chosen in combinations(range(len(BLOCKS)), SHARED)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in full]


def _signed_bit(i: int) -> int:
    return -(1 << 63) if i == 63 else 1 << i


def close_links(fps: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (u, v), u < v, that connect whatever a chain of fingerprints two bits or less apart connects.

    `fps` holds distinct values.  Buckets of up to `pair_bucket` values give
    their close pairs; larger ones give one link per value and midpoint.
    """
    masks = F.array(*[F.lit(m) for m in _masks()])
    keys = fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("block"), "mask")
    sizes = keys.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keys.join(sizes, ["choice", "block"]), "blocks")
    few = shared.where(F.col("n") <= pair_bucket)
    a, b = (few.select("choice", "block", F.col("fp").alias(name)) for name in "uv")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    pairs = a.join(b, ["choice", "block"]).where((F.col("u") < F.col("v")) & near).select("u", "v")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed_bit(i)) for i in range(64)])
    free = F.filter(flips, lambda x: x.bitwiseAND(F.col("mask")) == 0)
    around = (shared.where(F.col("n") > pair_bucket)
              .select("fp", "choice", F.explode(F.transform(free, lambda x: F.col("fp").bitwiseXOR(x))).alias("middle")))
    centres = around.groupBy("choice", "middle").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = around.join(centres, ["choice", "middle"]).where("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that the links (u, v) reach, for every node that has a link.

    Alternates large-star and small-star steps until the links are stars.  Each
    step shuffles links only; a node with very many links is pre-aggregated and
    joined, never gathered.
    """
    links = written(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "links")
    state = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = (joined.select(F.col("m").alias("u"), F.col("u").alias("v")).union(joined.select(F.col("m").alias("u"), "v"))
                 .where("u < v").distinct())
        links = written(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return (links.select(F.col("v").alias("node"), F.col("u").alias("label"))
            .union(links.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, mark and component_id (the smallest id reachable by links) of every row.

    Texts without words (null, empty, blank) have fingerprint zero and link
    like any other.  A null id gives a row and never is a component's id unless
    its component has no other.  Repeated rows give a row each.
    """
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    labels = components(close_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    grouped = written(classes.join(labels, "fp", "left")
                      .select("fp", F.coalesce("label", "fp").alias("label"), "first_id"), "grouped")
    firsts = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    wide = grouped.join(firsts, "label").select("fp", "component_id")
    return marked.join(wide, "fp").select(F.col("id").alias(id_col), "fp", "mark", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with the smallest id of each of their `groups` (id, mark, component_id).

    Of rows that share this id the one with the smallest text hash stays, once.
    Null ids come last.
    """
    first = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID))
    group = F.coalesce("component_id", F.lit(LAST_ID))
    stay = groups.where(first == group).groupBy(first.alias("owner")).agg(F.min("mark").alias("mark"))
    row = F.struct(*[docs[c] for c in docs.columns])  # columns of any name stay apart from those of the join
    marked = docs.select(first.alias("owner"), text_mark(F.col(text_col)).alias("mark"), row.alias("row"))
    once = marked.join(stay, ["owner", "mark"]).dropDuplicates(["owner", "mark"])
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row with the smallest id stays (see `one_of_each`)."""
    return one_of_each(docs, near_groups(docs, id_col, text_col), id_col, text_col)
