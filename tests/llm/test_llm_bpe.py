"""Speculated and verified ids against the tokenizers library, and against merging every word exactly."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauselake.llm import bpe, queries
import llm_cases as cases

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(FILE)


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


ODD = ["<|endoftext|>a<|startoftext|> <|ENDOFTEXT|> <|x", "don't we'LL I'M 's", "ΑΣ ΑΣΑ Σ", "İ ŉ Ǆ", "é e" + chr(0x301) + " " + chr(0x301),
       "\x00 \x1c \x85 \xa0a", "日本語 가나", "12 3.4%", "</w> a</w>b", "a" * 300, "aab" * 90, "ab" * 2000, "😀" * 70, " 　 x"]


def test_every_case_and_odd_text_as_the_library(spark, library):
    rows = [(r[0], r[1]) for r in cases.rows()] + list(enumerate(ODD, 100))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' ids", "'y' decoded", "'z' id")
    got = bpe.decode(bpe.encode(table, FILE), FILE).collect()
    seen = sorted(str((r["doc_id"], r["ids"], r["decoded"])) for r in got)
    assert seen == sorted(str((i, want(library, t), library.decode(want(library, t), skip_special_tokens=False))) for i, t in rows)
    assert bpe.decode(bpe.encode(cases.empty(spark), FILE), FILE).collect() == []


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 49407])], "doc_id bigint, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(rows, FILE).orderBy("doc_id").collect()] == [None, "", "a</w> <|endoftext|>"]


def test_random_texts_as_the_library(library):
    rng = random.Random(3)
    letters = "aaaabcdeinsthor  \n\t'.,1<|>ÀéΣσßİ" + chr(0x301) + "가\xa0日😀/w"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(0x20, 0x24F), rng.randint(0x300, 0x3FF), rng.randint(0x1E00, 0x2FFF)])) for _ in range(30))
              for _ in range(600)]
    encoder = bpe.Encoder(FILE, cache=500)
    for at in range(0, len(texts), 400):
        part = texts[at:at + 400]
        assert encoder.encode(pa.array(part)).to_pylist() == [want(library, t) for t in part]
    assert 0 < encoder.failed < encoder.checked


def test_only_words_that_fail_the_check_are_merged(library):
    encoder = bpe.encoder(FILE)
    rng = random.Random(4)
    names = sorted(n.removesuffix("</w>") for n in encoder.vocab if n.isascii())
    parts = ["".join(rng.choice(names) for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    parts = [p for p in parts if p]
    guesses = [encoder.proposed(p) for p in parts]
    exact = encoder.merges.merged_all([encoder.letters_of(p) for p in parts])
    assert exact == [encoder.merges.merged(encoder.letters_of(p)) for p in parts]
    for guess, truth in zip(guesses, exact):
        pairs = np.array(guess)
        assert (not encoder.merges.crosses(pairs[:-1], pairs[1:]).any()) == (guess == truth)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=14), st.integers(0, 10_000))
def test_compatible_neighbours_are_exactly_the_merged_word(word, seed):
    """Small made-up vocabularies, where ties and runs of one letter are frequent."""
    rng = random.Random(seed)
    vocab, merges = {"a": 0, "b": 1}, []
    for _ in range(rng.randint(0, 8)):
        x, y = rng.choice(list(vocab)), rng.choice(list(vocab))
        if x + y not in vocab:
            vocab[x + y] = len(vocab)
            merges.append((x, y))
    known = bpe.Merges(vocab, merges)
    parts = list(word)
    while pairs := [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]:
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    letters = [vocab[c] for c in word]
    truth = [vocab[p] for p in parts]
    assert known.merged(letters) == truth and (not letters or known.merged_all([letters])[0] == truth)
    if len(truth) > 1:
        assert not known.crosses(np.array(truth[:-1]), np.array(truth[1:])).any()
    for i, (x, y) in enumerate(zip(letters, letters[1:])):
        assert known.crosses(np.array([x]), np.array([y]))[0] == (known.merged([x, y]) != [x, y])


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])


def test_one_very_long_word_ends(library):
    text = "abracadabra" * 20_000
    assert bpe.encoder(FILE).encode(pa.array([text])).to_pylist() == [want(library, text)]


def test_query_digests(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_bpe_encoding(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = want(library, d["text"]), got[d["doc_id"]]
        told = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *[hashlib.sha256(t.encode()).hexdigest() for t in told])
