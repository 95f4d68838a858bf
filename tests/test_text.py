import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from clauselake.functions import metadata as md
from clauselake.functions import text as tx
from clauselake.rules.model import whole_word, whole_words
from clauselake.rules.term import LEGAL_TERMS


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_cleaning_follows_the_steps(spark):
    raw = "Two  words\n\n\n\nnext\x00line\tkept\rhere. TechCorp\n12\nafter\nPage 3 OF 9\nend\x0b "
    assert one(spark, raw, tx.clean_text) == "Two words\n\nnext line\tkept\rhere. Tech Corp\nafter\nend"
    assert one(spark, None, tx.clean_text) == "" and one(spark, "", tx.clean_text) == ""


def test_ascii_spelling(spark):
    assert one(spark, "Straße “Zürich” – œuvre… 中x", tx.clean_text) == 'Strasse "Zurich" - oeuvre... 中x'
    assert one(spark, "Договор и ΑΒΓ Άλφα, ĳ Щука ё é", tx.clean_text) == "Dogovor i ABG Alpha, ij Shchuka io e"


def test_adjacent_page_numbers_keep_the_second(spark):
    assert one(spark, "a\n1\n2\nb", tx.clean_text) == re.sub(r"\n\s*\d+\s*\n", "\n", "a\n1\n2\nb")


def test_truncate_html_and_hash(spark):
    assert one(spark, "abc  def", lambda c: tx.truncate(c, 5)) == "abc..."
    assert one(spark, "abc", lambda c: tx.truncate(c, 3)) == "abc"
    assert one(spark, "abcd ", lambda c: tx.truncate(c, 4, False)) == "abcd"
    assert one(spark, "<p>a<br/>b</p>", tx.strip_tags) == "ab"
    for name in ("md5", "sha1", "sha256"):
        assert one(spark, "é", lambda c, n=name: tx.hash_text(c, n)) == hashlib.new(name, "é".encode()).hexdigest()
    assert one(spark, "é", lambda c: tx.hash_text(c, "other")) == hashlib.sha256("é".encode()).hexdigest()
    assert one(spark, "é", lambda c: tx.unique_id(c, "doc", 6)) == "doc-" + hashlib.sha256("é".encode()).hexdigest()[:6]


def test_half_even_size_and_counts(spark):
    assert one(spark, "x" * 128, md.size_kb) == 0.12
    assert one(spark, "a\fb\fc", md.page_count) == 3
    assert one(spark, " a\tb \n c ", tx.word_count) == 3 and one(spark, "", tx.word_count) == 0
    assert one(spark, "a.b.TXT", md.file_type) == "TXT" and one(spark, "plain", md.file_type) == "txt"


def test_timestamps_and_maps(spark):
    assert one(spark, "2024-02-03T04:05:06", tx.format_timestamp) == "2024-02-03 04:05:06"
    assert one(spark, "soon", tx.format_timestamp) == "soon"
    assert one(spark, None, tx.format_timestamp)[:4] >= str(datetime.date.today().year - 1)
    df = spark.sql("select map('a', map('x', 1, 'y', 2), 'b', map('q', 0)) l, map('a', map('y', 3), 'c', map('z', 4)) r")
    got = df.select(tx.merge_maps(F.col("l"), F.col("r"), 2).alias("m")).first().m
    assert got == {"a": {"x": 1, "y": 3}, "b": {"q": 0}, "c": {"z": 4}}


def test_prefix_sums_below_and_above_the_block_size(spark):
    rng = random.Random(5)
    for n in (0, 1, 7, 8, 9, 64, 100):
        values = [rng.randrange(9) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        got = df.select(tx.prefix_sums(F.col("v"), block=8).alias("s")).first().s
        assert got == [sum(values[:i]) for i in range(n)]


def test_word_patterns_equal_plain_boundaries(spark):
    text = "Contract contracts sub-contract _contract 9contract contract. IPs IP ip! the term termination TERM_ term"
    for t in LEGAL_TERMS:
        for w in t.words:
            plain = [m.span() for m in re.finditer(rf"\b{re.escape(w)}\b", text, re.I)]
            assert [m.span() for m in re.finditer(whole_word(w), text, re.I)] == plain
            got = one(spark, text, lambda c, w=w: F.regexp_count(c, F.lit("(?i)" + whole_word(w))))
            assert got == len(plain)
    words = [w for t in LEGAL_TERMS for w in t.words]
    plain = r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"
    assert re.findall(whole_words(words), text, re.I) == re.findall(plain, text, re.I)


def test_dates_parties_in_order_of_appearance(spark):
    text = ("dated May 3, 2020 and effective 01/02/2021, as of 3rd day of June, 2022; dated May 3, 2020. "
            "made between Alpha Works and Beta Works, among ab and Gamma Works.")
    assert one(spark, text, md.all_dates) == ["May 3, 2020", "01/02/2021", "3rd day of June, 2022"]
    assert one(spark, text, md.all_parties) == ["Alpha Works", "Beta Works", "Gamma Works"]


def test_cleaning_of_few_and_many_foreign_characters_equals_the_plain_steps(spark):
    rng = random.Random(5)
    parts = ["word ", "a  b", "  ", "\n", "\n\n\n\n", "camelCase", "\n12\n", "\nPage 3 of 9\n", "\x00", "\x0b", "\x7f", "é", "“q”", "œuvre", "Щука",
             "中", "\t", "\r", "e\u0301", "\U0001f600", " plain text of some length"]
    texts = ["".join(rng.choices(parts, [rng.choice((1, 30)) for _ in parts], k=rng.randrange(60))) for _ in range(300)]

    def plainly(t):
        cleaned = F.regexp_replace(tx.to_ascii(t), r"\p{Cntrl}(?<![\t\n\r])", " ")
        for pattern, put in ((r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"(?<=[a-z])[A-Z]", " $0"), (r"\n\s*\d+\s*\n", "\n"),
                             (r"\n\s*(?i:Page)\s+\d+\s+(?i:of)\s+\d+\s*\n", "\n")):
            cleaned = F.regexp_replace(cleaned, pattern, put)
        return tx.strip(cleaned)

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", tx.clean_text(F.col("t")).alias("a"), plainly(F.col("t")).alias("b")).collect()
    assert len(got) == 300 and [r.t for r in got if r.a != r.b] == []


def test_words_are_found_by_their_rare_part(spark):
    words = ["agree", "end", "fee", "required to", "non-disclosure", "obligation", "e", "mm", "zebra"]
    texts = ["we agree", "weekend", "the gree", "required  to", "required to", "obligations", "bligation", "non-disclosure", "zebr", "", "ebra zebra"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", *[tx.holds(F.col("t"), w).alias(f"w{i}") for i, w in enumerate(words)]).collect()
    assert all(r[f"w{i}"] == (w in r.t) for r in got for i, w in enumerate(words))
