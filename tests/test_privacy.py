import hashlib
import re

from pyspark.sql import functions as F

from clauselake.functions import privacy as pv
from clauselake.functions.text import clean_text
from clauselake.operators.privacy import pii_report, with_pii
from clauselake.plans.corpus import contracts
from clauselake.rules.privacy import PII_PATTERNS
from conftest import SF

TEXTS = [
    "Write to a.b@c.example.org or call (555) 010-4477, SSN 123-45-6789.",
    "Dr. Ann Lee Smith lives at 12 Old Mill Road, card 4111-1111-1111-1111, passport AB1234567.",
    "Born 04/17/1961; account with number 99887766 and 99887766 again; 9988 alone.",
    "Mr. John SmithX is no name, Mrs. Mary Jane Watson is. 7 tiny words without street end",
    "nothing personal here", "",
]


def plain_pii(text):
    out = {}
    for name, pattern, ignore_case in PII_PATTERNS:
        found = list(dict.fromkeys(m.group(0) for m in re.finditer(pattern, text, re.I if ignore_case else 0)))
        if found:
            out[name] = found
    return out


def test_detection_equals_a_plain_search(spark):
    texts = TEXTS + [r.t for r in contracts(spark, SF).select(clean_text(F.col("text")).alias("t")).limit(150).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: {g.pii_type: g["values"] for g in r.g} for r in df.select("i", pv.pii_values(F.col("t")).alias("g")).collect()}
    assert got == {i: plain_pii(t) for i, t in enumerate(texts)}


def test_street_run_equals_the_word_group():
    group = (r"\b\d+\s+(?:[A-Za-z]+\s+)+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Court|Ct|Lane|Ln|Way|Place|Pl|"
             r"Terrace|Ter)\b")
    run = dict((n, p) for n, p, _ in PII_PATTERNS)["address"]
    for t in TEXTS + ["5 a Street b Way, c", "5 Street", "5 x\ny  Dr", "12 Ave St Road 9 Lane"]:
        assert [m.group(0) for m in re.finditer(run, t, re.I)] == [m.group(0) for m in re.finditer(group, t, re.I)]


def test_long_runs_do_not_exhaust_the_matcher(spark):
    text = "7 " + "word " * 60000 + "Street. Mr. " + "Abc " * 60000 + "end"
    df = spark.createDataFrame([(text,)], "t string")
    got = {g.pii_type: g["values"] for g in df.select(pv.pii_values(F.col("t")).alias("g")).first().g}
    assert len(got["address"][0]) > 290000 and len(got["name"][0]) > 230000


def test_redaction_leaves_no_value_outside_the_tags(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, clean string")
    for r in with_pii(df).collect():
        rest = re.sub(r"\[REDACTED-[a-z_]+-[0-9a-f]{8}\]", "", r.body)
        for values in plain_pii(r.clean).values():
            assert not any(v in rest for v in values)
        assert r.has_pii == bool(plain_pii(r.clean)) and r.pii_types == list(plain_pii(r.clean))
        if not r.has_pii:
            assert r.body == r.clean


def test_tag_is_the_hash_of_the_value(spark):
    df = spark.createDataFrame([(1, "mail x@y.example.com now")], "doc_id int, clean string")
    tag = hashlib.md5(b"x@y.example.com").hexdigest()[:8]
    assert with_pii(df).first().body == f"mail [REDACTED-email-{tag}] now"


def test_report_and_encryption(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, clean string")
    got = {r.pii_type: (r.documents, r["values"]) for r in pii_report(df).collect()}
    want = {}
    for t in TEXTS:
        for k, v in plain_pii(t).items():
            d, n = want.get(k, (0, 0))
            want[k] = (d + 1, n + len(v))
    assert got == want
    key = F.lit("k" * 16).cast("binary")
    c = df.withColumn("c", pv.encrypt(F.col("clean"), key))
    assert [r.p for r in c.select(pv.decrypt(F.col("c"), key).alias("p")).collect()] == TEXTS
    assert c.select(pv.decrypt(F.lit("no cipher"), key).alias("p")).first().p == "[DECRYPTION ERROR]"
    assert c.select(pv.encrypt(F.col("clean"), None).alias("p")).first().p == TEXTS[0]


def test_entities(spark):
    df = spark.createDataFrame([("EIN 12-3456789 and Contract No. C-77, see 512 U.S. 218 (1994)a, 12 F. 9 (2001)",)], "t string")
    assert df.select(pv.legal_entities(F.col("t")).alias("e")).first().e == {
        "company_id": ["EIN 12-3456789"], "contract_number": ["Contract No. C-77"], "case_citation": ["512 U.S. 218 (1994)"]}
