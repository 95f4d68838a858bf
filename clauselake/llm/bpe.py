"""Byte-pair encoding by speculation and verification, and decoding.

A merge vocabulary has exactly one sequence of tokens for a word in which every
two neighbours are compatible, that is, merging their joined strings afresh
gives these two again, and it is the one that the merges make.  So the longest
match from the left proposes tokens, all adjacent pairs of all new words are
tested at once on arrays, and only words with a pair that fails are merged
exactly, all short ones side by side on arrays and a long one with its pairs
waiting in a heap.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.packing import Remembered
from clauselake.llm.shared import slices

CACHE_PARTS = 200_000
SLICE_BYTES = 2 << 20
NEVER = 1 << 40
# words of up to so many letters are merged side by side, longer ones with a heap: the same result
SIDE_BY_SIDE = 48
BLOCK = 4096

# words of these characters only are their own normal form; all others go through the file's normalizer
PLAIN = re.compile(r"[\x21-\x7e\xa1-\u024f]+")
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """The merges of a vocabulary as arrays over token ids: when a token is made, and of which two."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        n = max(vocab.values()) + 1
        self.made = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for at, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.made[whole], self.left[whole], self.right[whole] = at, *pair
            self.rank[pair] = (at, whole)
        parents = np.flatnonzero(self.made >= 0)
        parts = np.maximum(self.made[self.left[parents]], self.made[self.right[parents]])
        if len(parents) < len(merges) or (parts >= self.made[parents]).any():
            raise ValueError("every token must have one merge, which comes after those of its parts")
        self.whole = np.array([w for _, w in self.rank.values()], np.int64)
        codes = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none."""
        wanted = x << 32 | y
        if not len(self.codes):
            return np.full(len(wanted), NEVER)
        at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        return np.where(self.codes[at] == wanted, self.ranks[at], NEVER)

    def crosses(self, left: np.ndarray, right: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether merging the two strings of each pair afresh merges across their border.

        The merges that make both tokens are undone one after the other, the
        last first.  Before each of them the symbols at the border must not have
        a merge that comes earlier; of equal ones the leftmost goes first.  With
        `whole` false the tokens as a whole may merge.
        """
        found = np.zeros(len(left), bool)
        todo = np.arange(len(left))
        x, y = left.astype(np.int64), right.astype(np.int64)
        limit, after = np.full(len(left), NEVER if whole else -1), np.zeros(len(left), bool)
        while len(todo):
            rank = self.rank_of(x, y)
            hit = (rank < limit) | ((rank == limit) & after & (rank < NEVER))
            found[todo[hit]] = True
            made_x, made_y = self.made[x], self.made[y]
            on = ~hit & ((made_x >= 0) | (made_y >= 0))
            todo, x, y, made_x, made_y = todo[on], x[on], y[on], made_x[on], made_y[on]
            after = made_y >= made_x
            limit = np.where(after, made_y, made_x)
            x, y = np.where(after, x, self.right[x]), np.where(after, self.left[y], y)
        return found

    def merged_all(self, rows: list[list[int]]) -> list[list[int]]:
        """`merged` of every row.  Short rows of like length are merged together, one merge of each row at a time."""
        out: list[list[int]] = [[]] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        while order and len(rows[order[-1]]) > SIDE_BY_SIDE:
            i = order.pop()
            out[i] = self.merged(rows[i])
        for at in range(0, len(order), BLOCK):
            block = order[at:at + BLOCK]
            for i, found in zip(block, self._side_by_side([rows[i] for i in block])):
                out[i] = found
        return out

    def _side_by_side(self, rows: list[list[int]]) -> list[list[int]]:
        width = max(map(len, rows)) + 2  # a border left of the first and right of the last symbol
        length = np.array([len(r) for r in rows])
        column = np.arange(width)
        symbol = np.full((len(rows), width), -1, np.int64)
        symbol[(column > 0) & (column <= length[:, None])] = np.fromiter((i for r in rows for i in r), np.int64, int(length.sum()))

        def ranks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.where((x >= 0) & (y >= 0), self.rank_of(x, y), NEVER)

        rank = ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(len(rows), width - 1)
        todo = np.arange(len(rows))
        final = symbol.copy()
        while len(todo):
            at = rank.argmin(axis=1)  # the leftmost of the earliest
            each = np.arange(len(todo))
            best = rank[each, at]
            on = best < NEVER
            final[todo[~on]] = symbol[~on]
            todo, at, best, each = todo[on], at[on], best[on], np.arange(int(on.sum()))
            shift = column + (column > at[:, None])
            shift[:, -1] = width - 1
            symbol = np.take_along_axis(symbol[on], shift, axis=1)
            rank = np.take_along_axis(rank[on], np.minimum(shift[:, :-1], width - 2), axis=1)
            symbol[each, at] = self.whole[best]
            rank[each, at] = ranks(symbol[each, at], symbol[each, at + 1])
            rank[each, np.maximum(at - 1, 0)] = ranks(symbol[each, np.maximum(at - 1, 0)], symbol[each, np.maximum(at, 1)])
        return [r[r >= 0].tolist() for r in final]

    def merged(self, ids: list[int]) -> list[int]:
        """The symbols after all merges, earliest merge first, leftmost first among equals; n log n."""
        n, parts = len(ids), list(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (known := self.rank.get((parts[a], parts[b]))):
                heapq.heappush(waiting, (known[0], a, b, parts[a], parts[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while waiting:
            rank, a, b, left, right = heapq.heappop(waiting)
            if parts[a] != left or after[a] != b or parts[b] != right:
                continue  # one of the two has been merged since
            parts[a], parts[b] = self.rank[left, right][1], -1
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p >= 0]


class Encoder:
    """A tokenizer file with word ends: its words, proposals, checks and exact merges."""

    def __init__(self, path: str, cache: int = CACHE_PARTS):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, added = told["model"], [(a["content"], a["id"]) for a in told["added_tokens"]]
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer, library.pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.merges = Merges(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.letters = byte_letters()
        # tokens that their own string does not give are never part of a result, so they are not proposed
        parents = np.flatnonzero(self.merges.made >= 0)
        lost = set(parents[self.merges.crosses(self.merges.left[parents], self.merges.right[parents], whole=False)].tolist())
        self.vocab = {t: i for t, i in vocab.items() if i not in lost}
        self.letter_id = vocab
        self.longest = max(map(len, self.vocab))
        self.added = dict(added)
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t, _ in added) + ")") if added else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in added}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        self.parts = Remembered(cache)
        self.checked = self.failed = 0

    def parts_of(self, word: str) -> list[str | int]:
        """What a word without ASCII blanks is cut into: strings in byte letters, and ids of added tokens."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        if self.split_added and "<|" in word:
            out: list[str | int] = []
            for piece in self.split_added.split(word):
                out += [self.added[piece]] if piece in self.added else self.parts_of_plain(piece) if piece else []
            return out
        return self.parts_of_plain(word)

    def parts_of_plain(self, word: str) -> list[str]:
        low = word.lower()
        if PLAIN.fullmatch(word) and len(low) == len(word):
            found = PART.findall(low)
            return found if word.isascii() else ["".join([self.letters[b] for b in p.encode()]) for p in found]
        return [p for p, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(word))]

    def proposed(self, part: str) -> list[int]:
        """Ids by the longest match from the left; the last one carries the end of the word."""
        out, at, n, vocab = [], 0, len(part), self.vocab
        while at < n:
            found = vocab.get(part[at:] + self.suffix) if n - at <= self.longest else None
            if found is not None:
                out.append(found)
                break
            stop = min(at + self.longest, n - 1 if self.suffix else n)
            while stop > at + 1 and part[at:stop] not in vocab:
                stop -= 1
            out.append(vocab[part[at:stop]])
            at = stop
        return out

    def letters_of(self, part: str) -> list[int]:
        return [self.letter_id[c] for c in part[:-1]] + [self.letter_id[part[-1] + self.suffix]]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each part: proposals, one check of all adjacent pairs, exact merges where it fails."""
        guesses = [self.proposed(p) for p in parts]
        lengths = np.array([len(g) for g in guesses], np.int64)
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(parts)), lengths)
        same = owner[1:] == owner[:-1]
        pairs, which = np.unique(flat[:-1][same] << 32 | flat[1:][same], return_inverse=True)
        bad = self.merges.crosses(pairs >> 32, pairs & 0xFFFFFFFF)
        wrong = np.unique(owner[1:][same][bad[which]]).tolist()
        self.checked, self.failed = self.checked + len(parts), self.failed + len(wrong)
        for i, found in zip(wrong, self.merges.merged_all([self.letters_of(parts[i]) for i in wrong])):
            guesses[i] = found
        return [array("I", g).tobytes() for g in guesses]

    def encode_words(self, words: list[str]) -> list[bytes]:
        self.parts.age()
        cut = [self.parts_of(w) for w in words]
        new = self.parts.missing({p for ps in cut for p in ps if isinstance(p, str)})
        known = self.parts.young
        known.update(zip(new, self.encode_parts(new)))
        return [known[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else b"".join(
            [known[p] if isinstance(p, str) else array("I", [p]).tobytes() for p in ps]) for ps in cut]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text, null as empty: Arrow numbers the distinct words, whose ids are put together by number."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        ids = self.encode_words(coded.dictionary.to_pylist())
        length = np.array([len(x) // 4 for x in ids], np.int64)
        start = np.cumsum(length) - length
        word = coded.indices.to_numpy()
        size = length[word]
        before = np.cumsum(size) - size
        table = np.frombuffer(b"".join(ids), "<u4")
        tokens = table[np.repeat(start[word] - before, size) + np.arange(int(size.sum()))].astype(np.int32)
        bound = np.append(before, len(tokens))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(tokens))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token names with a blank between them, as a file without a decoder gives them; null stays null."""
        kind = ids.type.value_type
        names = self.names.take(ids.flatten().cast(pa.int64() if pa.types.is_integer(kind) else kind))
        sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, names), " ")
        return pc.if_else(pc.is_valid(ids), text, pa.scalar(None, pa.string()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, ids (array of int) and the columns in `carry` of every row, from its whole text.

    The ids are those of the tokenizers library without added special tokens
    around the text; strings of special tokens inside a text are these tokens.
    Null and empty texts have no ids.  Rows that repeat give a row each, other
    columns are not read, no rows give no rows.  Nothing is shuffled; a task
    remembers a bounded number of words.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    kept = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for part in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("id"), known.encode(part.column("text")), *[part.column(c) for c in kept]],
                                             ["id", "ids", *kept])

    found = rows.mapInArrow(run, "id bigint, ids array<int>" + "".join(f", `{n}` {t}" for n, t in rows.dtypes[2:]))
    return found.withColumnsRenamed({"id": id_col, **{f"_{c}": c for c in carry}})


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """`rows` with `decoded`, the text of their ids; null ids give null.  A `decoded` column of `rows` is replaced."""
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, known.decode(part.column(ids_col))], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", decoded string")
