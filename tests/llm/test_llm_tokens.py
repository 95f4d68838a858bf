import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import llm_cases
from clauselake.llm import packing, pieces

WORDS = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b   c", "\n\n a\n", "日本語のテキスト", "é ́x \x00 \t tab\ttab 😀😀 a</s><0x0A>", "a" * 90, " 000000 ===== ..... ", "Ⅷ ﬁ ＡＢＣ ½",
       "don't DON'T it's!'s 'S x'll'd ''s", "a\xa0b\x85c \xadsoft \x1c\x1d x", "İstanbul ΑΣ ς Σ. ǅ ŉ É", "<|endoftext|> a<|startoftext|>b <|x"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "ab'sTtRe.,!<|>12½éßİŉ\xa0\xad́ \n\x1c"
    return ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(n)]


def test_word_ids_equal_the_tokenizer():
    lib, own = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    texts = ODD + random_texts(400) + [t or "" for _, t in llm_cases.texts()]
    for text, ids in zip(texts, own.packed(pa.array(texts, pa.string()))):
        assert np.frombuffer(ids, "<u4").tolist() == [*lib.encode(text, add_special_tokens=False).ids, 0]


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_the_cases(spark):
    lib = Tokenizer.from_file(WORDS)
    cut = packing.pieces(llm_cases.table(spark), WORDS, capacity=64)
    packed = packing.pack(cut, capacity=64)
    rows = packed.collect()
    check_layout(rows, 64)
    want = Counter()
    for i, t in llm_cases.texts():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == want
    total = {r.sequence_id: (r.length, bytes(r.ids)) for r in packing.sequences(packed).collect()}
    assert all(len(ids) == 4 * n for n, ids in total.values())
    parts = defaultdict(list)
    for r in rows:
        parts[r.sequence_id].append((r.offset, bytes(r.ids)))
    assert {s: b"".join(x for _, x in sorted(p)) for s, p in parts.items()} == {s: ids for s, (_, ids) in total.items()}
    assert packing.pack(packing.pieces(llm_cases.empty(spark), WORDS)).count() == 0


def test_equal_lengths_are_ranked_across_buckets(spark):
    df = spark.range(3000).select("id", F.lit(0).alias("piece"), F.lit(700).cast("bigint").alias("length"), F.lit("w").alias("ids"))
    rows = packing.pack(df, 2048).collect()
    assert len(rows) == 3000 and check_layout(rows, 2048) == 1500


def fewest(lengths, capacity):
    """Fewest sequences, by trying everything."""
    best = len(lengths)

    def put(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= rest[0] and rooms[i] not in rooms[:i]:
                put(rest[1:], rooms[:i] + [rooms[i] - rest[0]] + rooms[i + 1:])
        put(rest[1:], rooms + [capacity - rest[0]])

    put(sorted(lengths, reverse=True), [])
    return best


def test_fixing_dominating_sets_loses_nothing():
    rng = random.Random(4)
    for _ in range(400):
        capacity = rng.choice([10, 15, 24])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        h = np.bincount(lengths, minlength=capacity + 1)
        plan = packing.Plan(capacity, h.astype(np.int64), np.zeros(capacity + 1, np.int64))
        packing.reduce_by_dominance(plan)
        rest = [n for n in range(capacity + 1) for _ in range(int(plan.left[n]))]
        assert plan.fixed + (fewest(rest, capacity) if rest else 0) == fewest(lengths, capacity)
        whole = packing.solve(h, capacity)
        assert whole.sequences >= -(-sum(lengths) // capacity) and not whole.left.any()


def plain_best_fit(lengths, capacity):
    """The rooms left in the sequences of best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_equals_one_piece_at_a_time():
    rng = random.Random(8)
    for _ in range(600):
        capacity = rng.choice([10, 24, 40, 100])
        lengths = [rng.randrange(1, rng.choice([4, capacity]) + 1) for _ in range(rng.randrange(1, 60))]
        plan = packing.Plan(capacity, np.bincount(lengths, minlength=capacity + 1).astype(np.int64), np.zeros(capacity + 1, np.int64))
        packing.best_fit(plan)
        places, ranks = {}, Counter()
        for length, rank, per, first, offset in plan.runs:
            assert rank == ranks[length]
            upto = min([r[1] for r in plan.runs if r[0] == length and r[1] > rank], default=lengths.count(length))
            for i in range(upto - rank):
                places.setdefault(first + i // per, []).append((offset + i % per * length, length))
            ranks[length] = upto
        assert sorted(places) == list(range(plan.sequences))
        for parts in places.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
        assert sorted(capacity - sum(n for _, n in parts) for parts in places.values()) == plain_best_fit(lengths, capacity)


def test_many_short_texts_fill_their_sequences():
    h = np.bincount(np.random.default_rng(3).integers(1, 900, 50000), minlength=2049)
    plan = packing.solve(h, 2048)
    assert plan.sequences - int((h * np.arange(2049)).sum()) / 2048 < 5


def test_pieces_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = pieces.Pieces(MODEL)
    texts = ODD + random_texts(200) + [t for _, t in llm_cases.texts()]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text or "")
        assert own.decode(ids) == (text or "")
    got = pieces.decode(pieces.encode(llm_cases.table(spark), MODEL, carry=("text", "id")), MODEL)
    want = Counter((i, t, t or "") for i, t in llm_cases.texts())
    assert Counter((r.doc_id, r.text, r.decoded) for r in got.collect()) == want
    assert pieces.decode(pieces.encode(llm_cases.empty(spark), MODEL), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(None, "x")], "ids binary, decoded string"), MODEL).first().decoded is None


def test_unigram_search_takes_the_best_sum():
    own = pieces.Pieces(MODEL, merges=False)
    own.score = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -3.5, "aba": -3.2, "c": -4.0}
    own.id = {p: i for i, p in enumerate(own.score)}
    own.scores = list(own.score.values())
    own.backwards = {}
    for p, i in own.id.items():
        node = own.backwards
        for c in reversed(p):
            node = node.setdefault(c, {})
        node[""] = i

    def best(word):
        cuts = (itertools.combinations(range(1, len(word)), k) for k in range(len(word)))
        splits = ([word[a:b] for a, b in itertools.pairwise((0, *c, len(word)))] for c in itertools.chain.from_iterable(cuts))
        return max(sum(own.score[p] for p in s) for s in splits if all(p in own.score for p in s))

    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abc", repeat=n)]
    own.encode_words(words)
    for w in words:
        got = sum(own.scores[i] for i in np.frombuffer(own.words[w], "<u4"))
        assert got == pytest.approx(best(w))
