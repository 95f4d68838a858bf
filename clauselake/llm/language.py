"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each letter of a word from the four before it.
All models sit in shared arrays sorted by the hash of a gram, with a column per
language, so a gram is looked up once for all of them.  The language with the
lowest cross-entropy per letter wins; a text whose best cross-entropy lies far
above what was seen on labelled rows that the model did not count is rejected.

Labelled rows are fitted on a bounded sample (`sample_chars` code points per
language, whole texts); every row is predicted from its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import mixed, slices, written

ORDER = 5
SAMPLE_CHARS = 2_000_000
CALIBRATION_SHARE = 0.2
CACHE_WORDS = 100_000
# a mean over n letters may lie this much over the square root of n above the limit
SHORT_ALLOWANCE = 4.0
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
START, END = 1, 2
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if not one of them holds a letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(w.isalpha() or any(map(str.isalpha, w)) for w in found) else []


def grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `order` code points ending at each letter and at the end of each word; letters and end per word."""
    text = "".join("\x01" * (order - 1) + w + "\x02" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    rows = np.lib.stride_tricks.sliding_window_view(codes, order) if len(codes) >= order else np.zeros((0, order), np.uint32)
    return rows[rows[:, -1] != START], np.array([len(w) + 1 for w in words], np.int64)


def row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for column in range(rows.shape[1]):
        h = (h + rows[:, column].astype(np.uint64) + np.uint64(1)) * STEP
        h ^= h >> np.uint64(29)
    return mixed(h)


def grouped_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows (by hash), the group of each row, and the sorted hashes."""
    hashes, first, group = np.unique(row_hash(rows), return_index=True, return_inverse=True)
    return rows[first], group, hashes


@dataclass
class Model:
    """`grams[k]`/`scores[k]`: sorted hashes and log-probabilities (a column per language) of seen k-grams;
    `contexts[k]`/`backoffs[k]`: the log weight that a seen context of k letters leaves to shorter ones;
    `letters`: what any language has seen, END included: all models are over these and one unknown letter."""

    langs: list[str]
    grams: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    backoffs: dict[int, np.ndarray]
    base: np.ndarray
    letters: np.ndarray
    order: int = ORDER

    def score_rows(self, rows: np.ndarray) -> np.ndarray:
        """Log-probability of the last letter of each row given the others, per language."""
        total = np.zeros((len(rows), len(self.langs)), np.float64)
        todo = np.arange(len(rows))
        for k in range(self.order, 0, -1):
            at, hit = _find(self.grams[k], row_hash(rows[todo, self.order - k:]))
            total[todo[hit]] += self.scores[k][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return total
            at, hit = _find(self.contexts[k - 1], row_hash(rows[todo, self.order - k:-1]))
            total[todo[hit]] += self.backoffs[k - 1][at[hit]]
        total[todo] += self.base
        return total

    def score_words(self, words: list[str]) -> np.ndarray:
        rows, lengths = grams(words, self.order)
        distinct, group, _ = grouped_rows(rows)
        return np.add.reduceat(self.score_rows(distinct)[group], np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def fit_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from the distinct full-length grams (rows) and their counts of each language."""
    langs = sorted(counts)
    tables: dict[tuple[str, int], tuple] = {}
    letters = np.unique(np.concatenate([rows[:, -1] for rows, _ in counts.values()]))
    share = 1.0 / (len(letters) + 1)  # the same for all, or a language with few letters would be favoured on those it never saw
    base = np.full(len(langs), math.log(share))
    for lang in langs:
        rows, c = counts[lang]
        levels = []
        for k in range(order, 0, -1):
            shorter, suffix, _ = grouped_rows(rows[:, 1:])
            _, context, context_hash = grouped_rows(rows[:, :-1])
            levels.append((k, rows, c.astype(np.float64), suffix, context, context_hash))
            rows, c = shorter, np.bincount(suffix)
        lower = np.full(1, share)
        for k, rows, c, suffix, context, context_hash in reversed(levels):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))
            mass, kinds = np.bincount(context, c), np.bincount(context)
            left = discount * kinds / mass
            p = (c - discount) / mass[context] + left[context] * lower[suffix if k > 1 else np.zeros(len(c), np.int64)]
            tables[lang, k] = (row_hash(rows), rows, np.log(p), context_hash, np.log(left))
            lower = _by_suffix(rows, p)
    out = Model(langs, {}, {}, {}, {}, base, letters, order)
    for k in range(1, order + 1):
        rows = np.concatenate([tables[lang, k][1] for lang in langs])
        distinct, _, out.grams[k] = grouped_rows(rows)
        ctx = np.unique(np.concatenate([tables[lang, k][3] for lang in langs]))
        out.contexts[k - 1], out.backoffs[k - 1] = ctx, np.zeros((len(ctx), len(langs)))
        for j, lang in enumerate(langs):
            out.backoffs[k - 1][np.searchsorted(ctx, tables[lang, k][3]), j] = tables[lang, k][4]
        at, hit = _find(out.contexts[k - 1], row_hash(distinct[:, :-1]))
        shorter = np.broadcast_to(base, (len(distinct), len(langs)))
        if k > 1:
            shorter = out.scores[k - 1][_find(out.grams[k - 1], row_hash(distinct[:, 1:]))[0]]
        out.scores[k] = shorter + np.where(hit[:, None], out.backoffs[k - 1][at], 0)
        for j, lang in enumerate(langs):
            out.scores[k][np.searchsorted(out.grams[k], tables[lang, k][0]), j] = tables[lang, k][2]
    for table in (out.scores, out.backoffs):
        for k in table:
            table[k] = table[k].astype(np.float32)
    return out


def _by_suffix(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities in the order in which `grouped_rows` lists these rows as suffixes of longer ones."""
    return p[np.argsort(row_hash(rows), kind="stable")]


@dataclass
class Identifier:
    """A model, sent to the tasks once, and the largest accepted cross-entropy of each language.

    The model's size is bounded by the fitted sample.
    """

    shared: Broadcast
    limits: np.ndarray

    @property
    def model(self) -> Model:
        return self.shared.value

    def read(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Each slice with one (lang, score, cross-entropy, letters, rejected) per text."""
        index: dict[str, int] = {}
        scores = np.zeros((0, len(self.model.langs)))
        for part in slices(batches, column):
            if len(index) > CACHE_WORDS:
                index, scores = {}, scores[:0]
            texts = [words_of(t) for t in part.column(column).to_pylist()]
            known = len(index)
            ids = [[index.setdefault(w, len(index)) for w in words] for words in texts]
            if len(index) > known:
                scores = np.concatenate([scores, self.model.score_words(list(index)[known:])])
            yield part, [self.decide(words, scores[i].sum(axis=0)) if words else (UNKNOWN, 0.0, None, 0, True)
                         for words, i in zip(texts, ids)]

    def decide(self, words: list[str], logs: np.ndarray) -> tuple:
        letters = sum(map(len, words)) + len(words)
        entropy = -logs / letters
        best = int(entropy.argmin())
        # the evidence of one long word at most counts, so that a long text is not sure by its length alone
        score = 1.0 / float(np.exp(-(entropy - entropy[best]) * min(letters, 20)).sum())
        return self.model.langs[best], score, float(entropy[best]), letters, bool(entropy[best] > self.limits[best] + SHORT_ALLOWANCE / math.sqrt(letters))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
        sample_chars: int = SAMPLE_CHARS) -> Identifier | None:
    """Fit on labelled rows that are not held out; None if there are none with letters.

    At most about `sample_chars` code points per language are counted and as
    much again times CALIBRATION_SHARE is kept for the limits; rows are chosen
    by hash, whole.  Of every language with two rows or more, one row at least
    is counted and another kept for the limits: if the sample has none, the
    beginning of the row with the largest or smallest hash.
    """
    rows = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
            .where(~held_out(F.col(id_col)))
            .select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))
    # a written table has a known size, so the optimizer sends it to the texts while it is small, and not the texts to it
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = written(rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars"), F.min(place).alias("first"), F.max(place).alias("last")),
                    "language-sizes")
    rate = F.lit(float(sample_chars)) * (1 + CALIBRATION_SHARE) / F.greatest("chars", F.lit(1))
    sampled = F.col("place") < F.least(rate, F.lit(1.0))
    apart = (F.col("place") < F.least(rate, F.lit(1.0)) * (CALIBRATION_SHARE / (1 + CALIBRATION_SHARE))) | (F.col("place") == F.col("first"))
    chosen = (rows.join(sizes, "lang").withColumn("place", place).where(sampled | F.col("place").isin(F.col("first"), F.col("last")))
              .select("lang", F.when(sampled, F.col("text")).otherwise(F.left("text", F.lit(sample_chars))).alias("text"),
                      (apart & (F.col("place") != F.col("last"))).alias("apart")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            seen: dict[str, Counter] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            columns = list(zip(*flat)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                              pa.array(columns[2], pa.int64())], ["lang", "word", "n"])

    words = (chosen.where("not apart").select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    padded = F.concat(F.lit("\x01" * (order - 1)), F.col("word"), F.lit("\x02"))
    spots = F.sequence(F.lit(1), F.char_length("word") + 1)
    counted = (words.select("lang", "n", F.explode(F.transform(spots, lambda i: F.substring(padded, i, F.lit(order)))).alias("gram"))
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    model_rows = counted.toPandas()  # at most one gram for each sampled code point or word end
    if not len(model_rows):
        return None
    counts = {}
    for lang, part in model_rows.groupby("lang"):
        codes = np.frombuffer("".join(part["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, order)
        counts[lang] = (codes, part["n"].to_numpy())
    model = fit_counts(counts, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    open_end = Identifier(shared, np.full(len(model.langs), np.inf))
    cross = (predict(chosen.where("apart").select(F.lit(0).alias("doc_id"), "text"), open_end)
             .where("letters > 0").groupBy("lang_pred")
             .agg(F.percentile_approx("entropy", [0.5, 0.999], 10000).alias("q")).collect())
    limits = np.full(len(model.langs), np.inf)
    for r in cross:
        usual, high = r["q"]
        limits[model.langs.index(r["lang_pred"])] = high + max(high - usual, 0.5)
    return Identifier(shared, limits)


def predict(docs: DataFrame, fitted: Identifier | None, id_col: str = "doc_id", text_col: str = "text",
            carry: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score (0 to 1), entropy, letters, rejected and the columns in `carry` for every row.

    Null texts and texts without a letter are `und` with score 0 and rejected;
    so are all if nothing could be fitted.  Only the text is read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if fitted is None:
            read = ((part, [(UNKNOWN, 0.0, None, 0, True)] * part.num_rows) for part in slices(batches, "text"))
        else:
            read = fitted.read(batches, "text")
        for part, found in read:
            lang, score, entropy, letters, rejected = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()),
                 pa.array(letters, pa.int64()), pa.array(rejected, pa.bool_())] + [part.column(c) for c in carried],
                ["id", "lang_pred", "score", "entropy", "letters", "rejected", *carried])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
                       *[F.col(c).alias(f"_{c}") for c in carry])
    carried = rows.columns[2:]
    more = "".join(f", `{n}` {t}" for n, t in rows.dtypes[2:])
    found = rows.mapInArrow(run, "id bigint, lang_pred string, score double, entropy double, letters bigint, rejected boolean" + more)
    return found.select(F.col("id").alias(id_col), *found.columns[1:6], *[F.col(f"_{c}").alias(c) for c in carry])
