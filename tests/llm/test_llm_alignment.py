"""Groups and links of two tokenizers against a plain count; ids and corpus counts from the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauselake.llm import align, queries
import llm_cases as cases

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, text):
    """ids, groups and links of one text, token by token."""
    a, b = align.sides(A, B)
    if not text:
        return [], [], [], []
    ids_a, ids_b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    bytes_a, bytes_b = [a.tokens[i] for i in ids_a], [b.tokens[i] for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    spans = []
    for tokens in (bytes_a, bytes_b):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        spans.append([(e - len(t), e) for e, t in zip(ends, tokens)])
    groups, low = [], 0
    for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        groups.append(tuple([i for i, (_, e) in zip(ids, of) if low < e <= cut] for ids, of in zip((ids_a, ids_b), spans)))
        low = cut
    links = [(i, j) for i, (s, e) in zip(ids_a, spans[0]) for j, (u, v) in zip(ids_b, spans[1]) if s < v and u < e]
    return ids_a, ids_b, groups, links


def digest(groups):
    told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return hashlib.sha256(told.encode()).hexdigest() if groups else ""


def expected(libraries, texts):
    found = [plain(libraries, t) for t in texts]
    counts = Counter(link for *_, links in found for link in links)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest(groups))
            for a, b, groups, links in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest")


def test_every_case_as_counted_one_by_one(spark, libraries):
    rows = cases.rows()
    got = sorted(map(str, ((r["doc_id"], *[r[c] for c in COLUMNS]) for r in align.align(cases.table(spark), A, B).collect())))
    want = expected(libraries, [r[1] for r in rows])
    assert got == sorted(str((r[0], *w)) for r, w in zip(rows, want))
    assert align.align(cases.empty(spark), A, B).collect() == []


def test_strings_of_special_tokens_and_marks(spark, libraries):
    texts = ["<|endoftext|> a <s> b </s> <unk> <0x0A>", chr(0x2581) + "x", "a" + chr(0x2581), "\n", " ", "  a  b ", "\x00", "x\ny", "\n\n z", "é́"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [tuple(r[c] for c in COLUMNS) for r in align.align(rows, A, B).orderBy("doc_id").collect()]
    assert got == expected(libraries, texts)
    assert got[1] == got[2] == (0, 0, 0, 0, 0, 0, "")


def test_counts_over_several_slices(spark, libraries, monkeypatch):
    rng = random.Random(8)
    texts = [cases.words(rng, rng.randint(1, 40)) + rng.choice(["", "!", " 日本", "\n"]) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7, "doc_id")
    got = [tuple(r[c] for c in COLUMNS) for r in align.align(rows, A, B).orderBy("doc_id").collect()]
    assert got == expected(libraries, texts)


def test_a_long_text_is_cut_where_both_sides_start(libraries):
    rng = random.Random(9)
    text = " ".join(cases.words(rng, 9) + rng.choice(["  ", "\n", " \t ", ".", ""]) for _ in range(40))
    parts = list(align.segments(text, 50))
    assert "".join(parts) == " " + text and len(parts) > 20
    a, b = align.sides(A, B)
    whole, small = align.Document(), align.Document()
    align.align_segments(a, b, [" " + text], [whole])
    align.align_segments(a, b, parts, [small] * len(parts))
    assert (whole.n_a, whole.n_b, whole.n_groups, whole.digest.hexdigest()) == (small.n_a, small.n_b, small.n_groups, small.digest.hexdigest())
    assert np.concatenate(whole.codes).tolist() == np.concatenate(small.codes).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=12), st.lists(st.integers(1, 5), max_size=12))
def test_coalesced_groups_and_links(x, y):
    lack = sum(x) - sum(y)
    x, y = x + [-lack] * (lack < 0), y + [lack] * (lack > 0)
    found = align.coalesce(np.array(x, np.int64), np.array(y, np.int64))
    ends = [set(np.cumsum(v).tolist()) for v in (x, y)]
    assert found.groups == len(ends[0] & ends[1])
    spans = [[(int(e) - n, int(e)) for n, e in zip(v, np.cumsum(v))] for v in (x, y)]
    want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
    assert list(zip(found.link_a.tolist(), found.link_b.tolist())) == want
    for i, j in want:
        assert found.group_a[i] == found.group_b[j]


def test_packed_numbers_come_back():
    for numbers in (np.zeros(0, np.int64), np.arange(70_000)):
        assert align.unpacked(align.packed(numbers), len(numbers)).tolist() == numbers.tolist()


def test_query_reads_every_row(spark):
    rows = queries.op11_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(len(r["groups_sha256"]) == 64 and r["n_links"] >= r["n_groups"] for r in rows if r["n_a"])
