"""A corpus of agreements derived from the order tables.

The given `documents` hold no contract wording, so the rule operators read one
agreement per order instead: clause wordings chosen and filled by the order's
own values.  Both SQL dialects get the text from the same clause list, which
uses only syntax the two share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.sources.tables import read, spread

PARA = "\n\n"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str) -> str:
    """`word {col} word` -> SQL concatenation."""
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += ([q(head)] if head else []) + [name]
    return " || ".join(out + ([q(rest)] if rest or not out else []))


def choose(number: str, *templates: str | None) -> str:
    arms = " ".join(f"WHEN {i} THEN {fill(t)}" for i, t in enumerate(templates) if t is not None)
    return f"CASE {number} % {len(templates)} {arms} END"


KINDS = ("service", "lease", "employment", "nda", "subscription", "license", "purchase", "loan", "general")

# (name, SQL expression); a null clause is left out of the agreement
CLAUSES = (
    ("title", choose("k", "SERVICES AGREEMENT", "PREMISES LEASE", "EMPLOYMENT CONTRACT", "MUTUAL SECRECY AGREEMENT",
                     "SUBSCRIPTION ORDER", "SOFTWARE LICENSE", "PURCHASE AGREEMENT", "TERM LOAN AGREEMENT",
                     "LETTER OF UNDERSTANDING")),
    ("preamble", choose(
        "k",
        "This Agreement is made and entered into as of {ds} by and between {buyer} and {seller}, who intend\nto be bound by it.",
        "This agreement between {buyer} and {seller}, dated {ds}, sets out the dealings\nof both sides (“the Deal”).",
        "THIS AGREEMENT dated as of {ds} is signed by {seller} and {buyer}, each acting\nthrough its officers.",
        "Entered into on {us}, effective as of {ds}, among {buyer}, {seller} and their\naffiliates in the region of {nation}.",
        "The commencement date is {ds}. The expiration date is {de}. {buyer} joins\n{seller} in this venture.")),
    ("short_head", choose("k", "1. PURPOSE", "1. PURPOSES", None)),
    ("recitals", choose("k", None, "RECITALS:", "Background of the deal:", "WITNESSETH: the sides declare what follows")),
    ("definitions", choose(
        "k",
        "1.1 Definitions. The words used here have one meaning throughout.",
        "1.1 \"Deliverable\" means any report, file or device handed over under\nthis paper, and Work Product shall mean the same thing.",
        "As used in this Agreement, Affiliate refers to a company under common\ncontrol with a side of the deal.")),
    ("scope", choose(
        "k",
        "The provider performs each service for the client under a statement of work,\nand every deliverable meets the service level named in Exhibit A.",
        "The landlord gives the tenant occupancy of the premises; rent for the leased property\nis due on the first day, and the lease covers all rental rooms.",
        "The employer will hire the employee and grants a salary, benefits and other\ncompensation for the whole employment of the employee.",
        "Proprietary facts and any trade secret stay confidential; this non-disclosure duty\nbinds both sides and confidentiality survives the deal.",
        "The subscription is recurring with a monthly or annual billing cycle, and renewal of\nthe subscription term follows the plan of TechCorp.",
        "The licensor hands the licensee a license grant for the permitted use of intellectual property\nagainst a royalty stated in the license.",
        "The buyer will purchase the goods from the seller at the price of {price} dollars; delivery\nand invoice follow the payment terms.",
        "The lender pays out the loan of {price} dollars to the borrower; interest rate, repayment of\nprincipal and default are dealt with below.",
        "Both sides will meet four times a year and keep a written record of what\nthey have talked about in those meetings.")),
    ("term_head", fill("2. TERM AND RENEWAL")),
    ("renewal", choose(
        "k",
        "2.1 The first term lasts one year. This Agreement shall automatically renew for successive terms\nof one year after the close of the period.",
        "2.1 This Agreement shall automatically renew unless a side sends notice of non-renewal at least thirty days\nbefore the end of the term.",
        "2.1 The arrangement will continue in full force and effect until terminated by a side,\nand any perpetual renewal is accepted.",
        "2.1 It may be renewed once for an additional term of one year, by signed\nletter of both sides and not otherwise.",
        "2.1 The plan renews automatically each period; renewal will occur unless written notice is given\nten days ahead of the next period.",
        "2.1 The right shall extend indefinitely, but not to exceed the total of three years\nfrom the first day of the term.",
        None)),
    ("pay_head", choose("k", "3. FEES AND PAYMENT", "3. PAYMENT TERMS: amounts and dates")),
    ("fees", choose(
        "k",
        "3.1 Client shall pay the fees listed in Exhibit B. Additional charges may apply for work outside\nthe plan, as stated in each invoice.",
        "3.1 The price is {price} dollars. The provider may increase fees for all customers at any time\nwith notice by electronic mail.",
        "3.1 A minimum monthly fee of {price} dollars is due. Client must purchase at least ten units\nin every quarter of the year.",
        "3.1 The full amount of all fees is set forth here; other costs are not owed, and prices shall\nremain fixed for the whole period.",
        "3.1 Fees in effect at the time of renewal apply, and rates may change; an increase capped at 5%\nper year is accepted by the client.")),
    ("nested", choose("k", "3.1.1 Late payment. A late sum bears interest at the rate set by law.", None,
                      "3.1.2.1 Currency. All sums are stated in dollars of the United States.", None)),
    ("exit_head", choose("k", "4. TERMINATION", "ARTICLE IV - TERMINATION OF THE DEAL", "IV. Ending the deal")),
    ("exit", choose(
        "k",
        "4.1 The company may terminate at any time without prior notice, and immediate termination follows a breach;\nno further claim arises.",
        "4.1 A side may terminate upon thirty days' notice in writing, and immediately terminate after a fraud\nof the other side.",
        "4.1 Ending before the last day requires a fee for early termination, and the client must pay the remaining\nbalance in full.",
        "4.1 The client may terminate the plan within a month without penalty; no early termination fee is due\nin such a case.",
        "4.1 On termination the tenant is liable for the outstanding rent, and the termination date is {de}\nunless extended by both.",
        "4.1 This deal shall end on {de} without further steps; what is due by then\nstays due afterwards for both sides.")),
    ("change", choose(
        "k",
        "The operator reserves the right to amend these rules and may change them from time to time; changes are\nsent to each client.",
        "Any amendment must be in writing and signed by both parties; nobody may alter at any time what\nwas agreed and changed before.",
        None)),
    ("liability_head", choose("k", "5. LIABILITY", "B. Liability of the sides", None)),
    ("liability", choose(
        "k",
        "5.1 The contractor accepts unlimited liability and is liable for all damage, loss or claim caused\nby its people on site.",
        "5.1 Neither party shall be liable for any damages of an indirect kind, and liability shall not exceed\nthe sums paid.",
        "5.1 The client shall indemnify, defend, and hold harmless the vendor from any and all claims raised\nby third persons.",
        "5.1 The insurer covers ordinary damage to the goods during transport and storage\nat the cost of the vendor.")),
    ("secrecy", choose(
        "k",
        None,
        "6.1 Each side must keep such data confidential and undertakes not to disclose Confidential Information\nto outsiders, as provided in Section 2.1.",
        "6.1 The sides protect proprietary information, and the warranty given in the document is a guarantee\nof ordinary quality.")),
    ("references", choose(
        "k",
        "7.1 Sums are due pursuant to Section 3.1, and exit is governed by Section 4.1 above; see Section 9.9 for\nmatters left open.",
        "7.1 Subject to Section 7.1 and in accordance with Clause 3.1, as well as Section 2.1 hereof, the duties\nremain; refer to Section 2.",
        None,
        "7.1 As described in Article 2 and subject to Section 3, this instrument stands; see Paragraph 1.1 for\nthe words used in it.")),
    ("duplicate", choose("k", None, None, None, "2.1 Supplement. The rule on renewal is repeated here for ease of reading.")),
    ("law", choose(
        "k",
        "8.1 This Agreement shall be governed by and construed in accordance with the laws of the State of {state}, without\nregard to conflict rules.",
        "8.1 The governing law of the deal shall be that of the State of {state}; disputes must be settled by\nbinding arbitration under ICC rules.",
        "8.1 Courts at the seat of the vendor decide, and no side may assign its position; an assignment needs\nthe consent of the other.",
        None)),
    ("contact", choose(
        "k",
        "Notices go to Mr. John Carter Hill, {k} North Main Street, or to legal{k}@vendor-{nation}.example.com,\ntelephone (555) 010-{nation} 77{nation}.",
        "The signer was born on 04/17/1961, holds passport AB1234567, SSN 123-45-67{nation}9 and pays by card\n4111 1111 1111 1111 for the company.",
        None,
        "Wire to account with number {price}00; the company has EIN 12-34567{nation}9 and quotes Contract No. C-{k} on\nevery letter to Dr. Mary Ann Jones.",
        "The panel relies on 512 U.S. 218 (1994) and on Registration Number: 987654321 as filed, with Agreement #{k}\nkept on record.")),
    ("page_mark", choose("k", "The table runs over the page\n12\nand goes on here with its last rows.", None,
                         "The list is continued\nPage 3 of 9\nwith the items of the second column.", None)),
    ("page_break", choose("k", None, "An annex follows after a page break.{ff}It lists the rooms, tools and people\nneeded for the work.", None)),
    ("schedule", choose("k", "SCHEDULE A: Table of amounts", "Exhibit B - ", None)),
    ("long_body", "CASE WHEN k % 40 = 7 THEN repeat(" + q(
        "The sides shall meet in good faith and talk over open points before a claim is raised. ") + ", 160)"
     " WHEN k % 10 = 3 THEN repeat(" + q(
         "Each delivery is checked on arrival and a written report is kept for seven years by the buyer. ") + ", 12) END"),
    ("closing", choose("k", "IN WITNESS WHEREOF: the sides have signed on the day named above.",
                       "Signed for {buyer} and for {seller} by their\nofficers, café “Zürich” – first floor.")),
)

STATES = ("Delaware", "New York", "California", "Texas", "Nevada", "Ohio", "Oregon")


def _columns(date_text: str, us_text: str, end_text: str) -> str:
    states = " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(STATES))
    return (
        "o_orderkey AS doc_id, CAST(o_orderkey AS STRING) AS k, o_orderkey AS kn, "
        f"{date_text} AS ds, {us_text} AS us, {end_text} AS de, "
        "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS price, "
        "'Harbor ' || CAST(c_custkey AS STRING) || ' Holdings' AS buyer, "
        "'Granite ' || CAST(coalesce(s_suppkey, 1) AS STRING) || ' Partners LLC' AS seller, "
        "CAST(n_nationkey AS STRING) AS nation, "
        f"CASE n_nationkey % {len(STATES)} {states} END AS state, chr(12) AS ff")


def clause_sql(name: str) -> str:
    return dict(CLAUSES)[name].replace("CASE k %", "CASE kn %").replace("WHEN k %", "WHEN kn %")


def text_sql() -> str:
    return "concat_ws(" + q(PARA) + ", " + ", ".join(clause_sql(n) for n, _ in CLAUSES) + ")"


FILE_NAME_SQL = ("'agreement-' || k || CASE kn % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.v2.md' WHEN 2 THEN '' "
                 "ELSE '.json' END")

DUCK_BASE = (
    "SELECT " + _columns("strftime(o_orderdate, '%B %-d, %Y')", "strftime(o_orderdate, '%-m/%-d/%Y')",
                         "strftime(CAST(o_orderdate AS DATE) + 730, '%B %-d, %Y')")
    + " FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
    " LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_supplier = (read(spark, sf_dir, "lineitem").groupBy("l_orderkey")
                      .agg(F.min("l_suppkey").alias("s_suppkey")))
    # join strategies are left to the optimizer, which knows the sizes of the tables
    rows = (read(spark, sf_dir, "orders")
            .join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
            .join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
            .join(first_supplier, F.col("l_orderkey") == F.col("o_orderkey"), "left"))
    rows = rows.selectExpr(*_split(_columns("date_format(o_orderdate, 'MMMM d, yyyy')",
                                            "date_format(o_orderdate, 'M/d/yyyy')",
                                            "date_format(date_add(CAST(o_orderdate AS DATE), 730), 'MMMM d, yyyy')")))
    # the narrow rows are spread by document before the long texts are built from them
    return spread(rows, "doc_id")


def _split(columns: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(columns):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif not quoted and depth == 0 and ch == ",":
            out.append(columns[start:i])
            start = i + 1
    return out + [columns[start:]]


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents(doc_id, file_name, text): one agreement per order."""
    return base(spark, sf_dir).selectExpr("doc_id", f"{FILE_NAME_SQL} AS file_name", f"{text_sql()} AS text")


def duck_contracts() -> str:
    return f"SELECT doc_id, {FILE_NAME_SQL} AS file_name, {text_sql()} AS text FROM ({DUCK_BASE})"
