"""Personal-data and legal-entity patterns."""

# Personal-data types in redaction order (name, pattern, ignore case).
PII_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False),
    ("phone", r"\b(?:\+\d{1,3}[ -]?)?(?:\(\d{1,4}\)|\d{1,4})[ -]?\d{1,4}[ -]?\d{1,9}\b", False),
    ("ssn", r"\b\d{3}[-]?\d{2}[-]?\d{4}\b", False),
    ("credit_card", r"\b(?:\d{4}[-.\s]?){3}\d{4}\b", False),
    ("address",
     r"\b\d+\s+[A-Za-z][A-Za-z\s]*\s"
     r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Court|Ct|Lane|Ln|Way|Place|Pl|Terrace|Ter)\b", True),
    ("name", r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", False),
    ("dob",
     r"\b(?:(?:0?[1-9]|1[0-2])[/.-](?:0?[1-9]|[12]\d|3[01])[/.-](?:19|20)\d{2}"
     r"|(?:19|20)\d{2}[/.-](?:0?[1-9]|1[0-2])[/.-](?:0?[1-9]|[12]\d|3[01]))\b", False),
    ("passport", r"\b[A-Z]{1,2}\d{6,9}\b", False),
    ("financial_id", r"\b(?:account|routing|ACH).{1,10}?(?:number|#).{1,10}?\d{4,17}\b", True),
)
# The street words of `address` are one run of letters and blanks, so the pattern names that run as a
# character class: the same strings match as with a repeated word group, without recursion in the matcher.

# Legal entity types (name, pattern, ignore case).
ENTITY_PATTERNS = (
    ("company_id", r"\b(?:EIN|Tax ID|Company Number|Registration Number)[\s:]+\d{2}[-]?\d{7}\b", True),
    ("contract_number", r"\b(?:Contract|Agreement|License)\s+(?:No\.|Number|#)\s*[\w-]+\b", True),
    ("case_citation", r"\b\d+\s+[A-Za-z\.]+\s+\d+\s+\(\d{4}\)\b", False),
)
