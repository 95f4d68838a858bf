"""SentencePiece encoding and decoding by a Viterbi search over a shared trie.

The distinct marked words of a slice of texts are sorted, so that they form a
trie, and walked depth-first.  Every node holds the forward state of its prefix
(score, last piece, where it starts), which all words below it share.

A unigram model takes the best sum of piece scores.  In a merge (BPE) model not
every segmentation is reachable: a piece may follow another only if merging the
two strings afresh gives these two pieces.  Exactly one segmentation meets this
everywhere, the one that the merges make, so the search with this condition
gives the library's ids.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import slices

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
CACHE_WORDS = 200_000
CACHE_PAIRS = 200_000
UNKNOWN_COST = 1e6


class Pieces:
    """Vocabulary of a model file, and the search."""

    def __init__(self, path: str, merges: bool = True):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        plain = [i for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.merges = merges
        self.id = {lib.id_to_piece(i): i for i in plain}
        self.score = {p: lib.get_score(i) for p, i in self.id.items()}
        self.unknown = lib.unk_id()
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(lib.is_byte(i) for i in self.byte)
        self.text = [b""] * len(ids)
        for p, i in self.id.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte if self.has_bytes else ()):
            self.text[i] = bytes([b])
        self.pieces = [lib.id_to_piece(i) for i in ids]
        self.scores = [lib.get_score(i) for i in ids]
        self.backwards: dict = {}  # trie of the reversed pieces; the key "" holds a piece's id
        for p, i in self.id.items():
            node = self.backwards
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a string by merging the best pair, leftmost first among equals; pairs wait in a heap."""
        parts, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                score = self.score.get(parts[left] + parts[right])
                if score is not None:
                    heapq.heappush(waiting, (-score, left, right, len(parts[left]) + len(parts[right])))

        for i in range(n - 1):
            offer(i, i + 1)
        while waiting:
            _, left, right, size = heapq.heappop(waiting)
            if after[left] != right or not parts[left] or len(parts[left]) + len(parts[right]) != size:
                continue  # one of the two has been merged with another since
            parts[left], parts[right] = parts[left] + parts[right], ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' strings afresh gives the two pieces."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.pairs[key] = self.merged(a + b) == [a, b]
        return found

    def step(self, word: str, end: int, states: list[tuple[float, int, int]]) -> tuple[float, int, int]:
        """The state of word[:end] from those of its prefixes: best score, last piece (-1: a character without), its start."""
        node, at, ends = self.backwards, end, []
        while at:
            at -= 1
            node = node.get(word[at])
            if node is None:
                break
            if "" in node:
                ends.append((node[""], at))
        best = None
        for piece, start in reversed(ends):  # longest first
            before = states[start]
            if self.merges:
                if before[1] < 0 or self.follows(before[1], piece):
                    return before[0] + self.scores[piece], piece, start
            elif best is None or before[0] + self.scores[piece] > best[0]:
                best = (before[0] + self.scores[piece], piece, start)
        return best or (states[end - 1][0] - UNKNOWN_COST, -1, end - 1)

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of each word into the cache, walking the trie of the sorted words."""
        states: list[tuple[float, int, int]] = [(0.0, -1, 0)]
        last = ""
        for word in sorted(words):
            if self.merges and MARK * 2 in word:  # runs of marks have equal scores, where only the order of merges decides
                self.words[word] = self.packed([self.id.get(x, (-1, x)) for x in self.merged(word)])
                continue
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                states.append(self.step(word, end, states))
            last = word
            found, at = [], len(word)
            while at:
                _, piece, start = states[at]
                found.append(piece if piece >= 0 else (-1, word[start:at]))
                at = start
            found.reverse()
            self.words[word] = self.packed(found)

    def packed(self, found: list) -> bytes:
        """Ids as bytes; a pair in place of an id is a character without a piece."""
        ids: list[int] = []
        for x in found:
            if isinstance(x, int):
                ids.append(x)
            elif self.has_bytes:
                ids.extend(self.byte[b] for b in x[1].encode())
            else:
                ids.append(self.unknown)
        return array("I", ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null and empty texts have none."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.words
        self.encode_words(list({w for ws in split for w in ws if w not in known}))
        return [b"".join([known[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text that was encoded: pieces put together, without the mark in front."""
        table = self.text
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _model(path: str, merges: bool) -> Pieces:
    return Pieces(path, merges)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", merges: bool = True,
           carry: tuple[str, ...] = ()) -> DataFrame:
    """id, ids (binary, little-endian unsigned 32 bits) and the columns in `carry` of every row, from its whole text.

    `merges` says that the model file holds a merge (BPE) model, otherwise a
    unigram model.  Null and empty texts have no ids.  Rows that repeat stay.
    Other columns are not read.  Nothing is shuffled; a task remembers a
    bounded number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _model(model, merges)
        for part in slices(batches, "text"):
            ids = known.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), *[part.column(c) for c in kept]],
                                             ["id", "ids", *kept])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    kept = rows.columns[2:]
    found = rows.mapInArrow(run, "id bigint, ids binary" + "".join(f", `{n}` {t}" for n, t in rows.dtypes[2:]))
    return found.withColumnsRenamed({"id": id_col, **{f"_{c}": c for c in carry}})


def decode(rows: DataFrame, model: str, ids_col: str = "ids", merges: bool = True) -> DataFrame:
    """`rows` with `decoded`, the text of their ids; null ids give null.  A `decoded` column of `rows` is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _model(model, merges)
        for b in batches:
            texts = [None if x is None else known.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    rows = rows.drop("decoded")
    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", decoded string")
