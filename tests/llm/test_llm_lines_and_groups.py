import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

import llm_cases
from clauselake.llm import linededup, simhash, suffix

BLANKS = " \t\n\x0b\x0c\r"


def plain_lines(rows):
    """Line dedup by its definition; a null id comes last."""
    def low(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    order = {i: (i is None, i) for i, _ in rows}
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[low(line.strip(BLANKS))].add(order[i])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(k := low(x.strip(BLANKS))) >= 10 and len(held[k]) >= 2 and min(held[k]) != order[i])]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup_equals_its_definition(spark):
    got = linededup.dedup_lines(llm_cases.table(spark), carry=("lang", "owner"))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept", "lang", "owner"]
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(plain_lines(llm_cases.texts()))
    assert linededup.dedup_lines(llm_cases.empty(spark)).count() == 0


def test_line_threshold(spark):
    df = spark.createDataFrame([(i, "this line is in many\nand this one: %d" % (i // 2)) for i in range(4)], "doc_id int, text string")
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(df, min_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def plain_fingerprint(text):
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in text.encode().split()]
    if not w:
        return 0
    grams = [w[i:i + 3] for i in range(len(w) - 2)] or [w]
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(prints):
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(a ^ b).count("1") <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_simhash_equals_its_definition(spark):
    rows = llm_cases.texts()
    got = simhash.near_groups(llm_cases.table(spark)).collect()
    prints = {t: plain_fingerprint(t or "") for _, t in rows}
    label = plain_groups(sorted(set(prints.values())))
    first = {}
    for i, t in rows:
        if i is not None:
            first[label[prints[t]]] = min(first.get(label[prints[t]], i), i)
    want = Counter((i, prints[t], first.get(label[prints[t]])) for i, t in rows)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_groups(llm_cases.empty(spark)).count() == 0


def test_spark_hash_is_the_contracts_hash(spark):
    got = spark.sql("select xxhash64('a b c') as h").first().h
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_close_links_in_small_and_full_buckets(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(25)}
    label = plain_groups(sorted(values))
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for most in (1, 48):
        links = simhash.close_links(df, most).collect()
        assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 2 for r in links)
        found = {r.node: r.label for r in simhash.components(simhash.close_links(df, most)).collect()}
        groups = defaultdict(set)
        for v in signed:
            groups[found.get(v, v)].add(v & (1 << 64) - 1)
        want = defaultdict(set)
        for v in values:
            want[label[v]].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one_leaves_one_row_of_each_group(spark):
    df = llm_cases.table(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = {r.component_id for r in simhash.near_groups(df).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted(groups, key=str)


def plain_removal(texts, width):
    places = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for t in data:
        for i in range(len(t) - width + 1):
            places[t[i:i + width]] += 1
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if places[t[i:i + width]] > 1:
                gone[i:i + width] = True
        out.append((len(t), int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_suffix_dedup_equals_its_definition(spark, monkeypatch):
    rows = llm_cases.texts()
    for width, gram, group in ((200, 32, 2000), (40, 8, 2000), (40, 8, 1)):
        monkeypatch.setattr(suffix, "MAX_GROUP", group)
        want = Counter((i, *x) for (i, _), x in zip(rows, plain_removal([t for _, t in rows], width)))
        found = suffix.remove_repeats(llm_cases.table(spark), width=width, gram=gram).collect()
        got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in found)
        assert got == want
    assert suffix.remove_repeats(llm_cases.empty(spark)).count() == 0


def test_run_index_equals_a_plain_search():
    rng = random.Random(3)
    for _ in range(150):
        width = rng.choice([3, 8, 9, 20])
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings = [base[rng.randrange(30):][:rng.randrange(60)] if rng.random() < .5 else bytes(rng.choice(b"abc") for _ in range(rng.randrange(40)))
                   for _ in range(rng.randrange(1, 8))] + [b"ab" * 30] * (rng.random() < .3)
        count = Counter(s[i:i + width] for s in strings for i in range(len(s) - width + 1))
        want = [[i for i in range(len(s) - width + 1) if count[s[i:i + width]] > 1] for s in strings]
        assert [x.tolist() for x in suffix.repeated(strings, width)] == want


def test_runs_cover_every_string_once():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 10, 39, 40, 41, 500)] + [b"a" * 3000, b"xy" * 900]
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = suffix.runs_of(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))), 40, 8)
    seen = Counter((t, a + i) for t, a, n in zip(found["text"], found["at"], found["n"]) for i in range(n))
    assert seen == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x) - 39))
    keys = defaultdict(set)
    for t, a, n, key in zip(found["text"], found["at"], found["n"], found["key"]):
        for i in range(a, a + n):
            keys[texts[t][i:i + 40]].add(key)
    assert all(len(k) == 1 for k in keys.values())  # equal strings have one key


def test_long_texts_are_cut_with_overlap():
    text = bytes(np.random.default_rng(2).integers(97, 123, 2_500_000).astype(np.uint8))
    parts = list(suffix.segments(text))
    assert all(text[at:at + len(p)] == p for at, p in parts)
    assert sum(len(p) - 199 for _, p in parts) == len(text) - 199
    assert hashlib.sha256(b"".join([parts[0][1]] + [p[199:] for _, p in parts[1:]])).digest() == hashlib.sha256(text).digest()


def test_hot_line_is_not_gathered(spark):
    """The plan joins lines on their hash and gathers positions by document only."""
    plan = linededup.dedup_lines(llm_cases.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_set" in plan and plan.count("CartesianProduct") == 0


def test_texts_whose_sums_are_equal_are_told_apart(spark):
    """A Thue-Morse string and its complement have the same polynomial modulo 2^64."""
    line = [0]
    while len(line) < 2048:
        line += [1 - x for x in line]
    one, other = (bytes(ord("ab"[x ^ flip]) for x in line) for flip in (0, 1))
    both = np.frombuffer(one + other, np.uint8)
    assert len(set(suffix.digests(both, np.array([0, 2048]), np.array([2048, 4096])))) == 2
    mark = "a long opening that holds the smallest of all hashes, whatever it is, in front of both of them: "
    texts = [(1, mark + one.decode()), (2, mark + other.decode()), (3, one.decode()[:700])]
    got = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == {i: x[2] for (i, _), x in zip(texts, plain_removal([t for _, t in texts], 200))}
