"""Ranked search against scores that are worked out term by term."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clauselake.llm import ranked
import llm_cases as cases

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(SMALL) for t in TERM.findall(text or "")]


def plain(docs, items, most=20):
    """(item, rank, doc, score) of every item, document after document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in counts]
    documents, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), size in zip(counts, n):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * documents // total)))
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, k, doc, -score) for k, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:most], 1)]
    return sorted(out, key=str)


def got(docs, items, **more):
    return sorted((tuple(r) for r in ranked.search(docs, items, **more).collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "item_id bigint, text string, doc string, rank int")


ITEMS = [(0, "the of the and this EXACT line"), (1, "password api key token"), (2, None), (3, "..."), (4, "é 日本語 x"), (None, "one two three"),
         (5, "under over water house"), (5, "sample mark"), (6, "nowhere"), (6, "nowhere"), (-1, "x")]


def test_every_case_as_scored_one_by_one(spark):
    docs = [(r[0], r[1]) for r in cases.rows()]
    want = plain(docs, [x for x in ITEMS if x != (6, "nowhere")], 5)
    assert got(cases.table(spark), items_of(spark, ITEMS), most=5) == want
    assert len({(r[0], r[1]) for r in want if r[0] != 5}) == len([r for r in want if r[0] != 5])


def test_empty_tables(spark):
    assert got(cases.empty(spark), items_of(spark, ITEMS)) == []
    assert got(cases.table(spark), items_of(spark, [])) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_many_documents_in_small_buckets_and_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(ranked, "BUCKET_ROWS", 16)
    monkeypatch.setattr(ranked, "BUCKET_CELLS", 150)
    rng = random.Random(seed)
    stock = [f"t{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, cases.words(rng, int(rng.paretovariate(0.7)) + 1 if i % 50 else 700, stock)) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties over the border of the ranks
    items = [(i, cases.words(rng, rng.randint(1, 30), stock)) for i in range(25)] + [(99, docs[7][1])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3, "doc_id")
    assert got(table, items_of(spark, items), block_items=10) == plain(docs, items)


def test_bounds_keep_all_that_reaches_the_limit_and_drop_most_of_the_rest():
    rng = np.random.default_rng(3)
    weights = rng.integers(100, 9000, 300)
    rows = [np.unique(rng.zipf(1.3, rng.integers(1, 80)) % 300) for _ in range(800)]
    sizes = np.array([len(r) for r in rows])
    cells = np.concatenate(rows)
    impacts = rng.integers(100_000, 900_000, len(cells))
    owner = np.repeat(np.arange(800), sizes)
    length = np.sqrt(np.bincount(owner, weights[cells] * impacts.astype(float) ** 2))
    order = np.argsort(-length)
    bucket = ranked.Bucket(length[order], sizes[order], np.concatenate([rows[i] for i in order]),
                           np.concatenate([impacts[owner == i] for i in order]), weights)
    kept = reached = 0
    for k in range(60):
        item = rows[rng.integers(800)]
        times = rng.integers(1, 3, len(item))
        table = np.zeros(300, np.int64)
        table[item] = times * weights[item]
        exact = bucket.scores(np.arange(800), table)
        least = int(np.sort(exact)[-20])
        unit = times * np.sqrt(weights[item])
        size = float(np.sqrt((unit * unit).sum()))
        found = bucket.candidates(item, unit / size, size, least)
        assert set(np.flatnonzero(exact >= least).tolist()) <= set(found.tolist())
        kept, reached = kept + len(found), reached + 800
    assert kept < 0.5 * reached


def test_terms_of_slices_and_nulls():
    texts = pa.array(["skipped", "A-b É", None, "", " \n", "x1;Y2"], pa.string()).slice(1)
    coded, starts = ranked.terms_of(texts)
    assert coded.to_pylist() == ["a", "b", "É", "x1", "y2"] and starts.tolist() == [0, 3, 3, 3, 3, 5]


def test_length_factor_beyond_64_bits():
    n = np.array([10, 4_000_000_000], np.int64)
    assert ranked.length_factor(n, 10 ** 9, 10 ** 12).tolist() == [75 + 25 * int(x) * 10 ** 9 // 10 ** 12 for x in n]
