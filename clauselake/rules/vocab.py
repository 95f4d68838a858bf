"""Word lists, label maps and extraction patterns shared by the operators."""

# Header shapes, tried in this order (name, pattern, ignore case).
HEADER_PATTERNS = (
    ("numbered", r"^(\d+(?:\.\d+)*)\.?\s+(.+)$", False),
    ("roman", r"^([IVX]+)\.?\s+(.+)$", False),
    ("alphabetical", r"^([A-Z])\.?\s+(.+)$", False),
    ("titled", r"^([A-Z][A-Z\s]+)[\.\:]\s*(.*)$", False),
    ("article", r"^(?:ARTICLE|Section)\s+(\d+|[IVX]+)(?:\.|\:|\s+\-)\s*(.+)$", True),
    ("schedule", r"^(?:SCHEDULE|APPENDIX|EXHIBIT)\s+([A-Z\d]+)(?:\.|\:|\s+\-)\s*(.+)?$", True),
)

# Section type -> indicator substrings; the first type that hits wins.
SECTION_TYPES = {
    "covenant": ["agree", "covenant", "shall", "must", "undertake", "obligation", "duty", "perform", "commit",
                 "required to", "responsible for", "will provide"],
    "representation": ["represent", "warranty", "warrants", "represents", "certify", "acknowledge", "confirm",
                       "declare", "guarantee", "assurance"],
    "condition": ["condition", "subject to", "contingent", "dependent", "provided that", "only if",
                  "unless", "until", "when", "prerequisite"],
    "termination": ["terminate", "termination", "cancel", "end", "expiration", "discontinue", "cease",
                    "rescind", "revoke", "void", "invalidate"],
    "payment": ["payment", "fee", "cost", "price", "dollar", "pay", "compensation", "rate", "invoice",
                "billing", "expense", "reimbursement"],
    "liability": ["liability", "indemnify", "indemnification", "hold harmless", "responsible for",
                  "damages", "remedy", "claim", "reimburse", "defend", "settle"],
    "definition": ["mean", "definition", "define", "interpret", "construe", "refer to", "shall mean",
                   "defined term", "for purposes of"],
    "reference": ["refer to", "pursuant to", "accordance with", "subject to", "described in",
                  "set forth in", "specified in", "provided in"],
}

# Agreement type -> key words counted as whole words; ties go to the first type.
CONTRACT_TYPES = {
    "lease": ["lease", "rent", "tenant", "landlord", "property", "premises", "rental", "leased", "occupancy"],
    "employment": ["employment", "salary", "employee", "employer", "hire", "compensation", "benefits",
                   "termination of employment"],
    "nda": ["confidential", "non-disclosure", "confidentiality", "proprietary", "trade secret",
            "disclosure of information"],
    "service": ["service", "provider", "client", "deliverable", "statement of work", "services provided",
                "service level"],
    "subscription": ["subscription", "recurring", "monthly", "annual", "billing cycle", "renewal",
                     "subscription term"],
    "license": ["license", "licensor", "licensee", "intellectual property", "royalty", "permitted use",
                "license grant"],
    "purchase": ["purchase", "buyer", "seller", "goods", "delivery", "price", "payment terms", "invoice"],
    "loan": ["loan", "lender", "borrower", "principal", "interest rate", "repayment", "default", "term loan"],
}

# Metadata patterns (case-blind).
DATE_PATTERN = (
    r"(?:dated|effective|as of|dated as of)\s+"
    r"(\w+\s+\d{1,2},?\s+\d{4}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2}(?:st|nd|rd|th)?\s+(?:day of\s+)?\w+,?\s+\d{4})"
)
DATE_WORDS = ("dated", "effective", "as of")  # a date's match begins with one of these
PARTY_PATTERN = r"(?:between|by and between|among)\s+([^,]+?)\s+(?:and|,)\s+([^,\.]+)"
PARTY_WORDS = ("between", "by and between", "among")

# Cross-reference patterns (case-blind), tried in this order.
REFERENCE_PATTERNS = (
    r"(?:pursuant to|as provided in|as set forth in|in accordance with|as defined in|subject to|as described in)"
    r"\s+(?:Section|Article|Paragraph|Clause)\s+(\d+(?:\.\d+)*)",
    r"(?:Section|Article|Paragraph|Clause)\s+(\d+(?:\.\d+)*)\s+(?:hereof|above|below)",
    r"(?:see|refer to)\s+(?:Section|Article|Paragraph|Clause)\s+(\d+(?:\.\d+)*)",
)
# The words that a match of each begins with, and what stands in every match.
_SECTION_WORDS = ("section", "article", "paragraph", "clause")
REFERENCE_WORDS = (
    ("pursuant to", "as provided in", "as set forth in", "in accordance with", "as defined in", "subject to", "as described in"),
    _SECTION_WORDS, ("see", "refer to"))
REFERENCE_NEEDS = r"(?:" + "|".join(_SECTION_WORDS) + r")\s+\d"

# The answers the pipeline asks for, in this order, and their patterns (case-blind).
EXTRACTION_TYPES = ("parties", "effective_date", "termination_date", "governing_law", "venue", "notice_period")
ALL_EXTRACTION_TYPES = ("parties", "effective_date", "termination_date", "payment_terms", "renewal_terms",
                        "governing_law", "venue", "notice_period")
EXTRACTION_PATTERNS = {
    "parties": (
        r"(?:agreement|contract)\s+(?:is\s+)?(?:made\s+and\s+entered\s+into|between|by\s+and\s+between)\s+([^,]+?)\s+(?:and)\s+([^,\.]+)",
        r"(?:THIS AGREEMENT|THIS CONTRACT).{1,50}?(?:by|between)\s+([^,]+?)\s+(?:and)\s+([^,\.]+)",
    ),
    "effective_date": (
        r"(?:effective|commencement)\s+date\s+(?:is|shall\s+be|of)\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"(?:effective|shall\s+commence)\s+(?:as\s+of|on)\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    ),
    "termination_date": (
        r"(?:terminat|expir|end)(?:ion|e|es|ing)\s+date\s+(?:is|shall\s+be|of)\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"(?:shall|will)\s+(?:terminat|expir|end|conclude)(?:e|ion)?\s+(?:on|upon)\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    ),
    "governing_law": (
        r"(?:governed|construed|interpreted).{1,20}?(?:by|in\s+accordance\s+with).{1,20}?(?:laws|law)\s+of\s+(?:the\s+)?(?:State\s+of|Commonwealth\s+of|Province\s+of)?\s+([A-Za-z\s]+)",
        r"governing\s+law.{1,20}?(?:shall\s+be|is)\s+(?:that\s+of\s+)?(?:the\s+)?(?:State\s+of|Commonwealth\s+of|Province\s+of)?\s+([A-Za-z\s]+)",
    ),
}
# The words that a match of each pattern begins with.
EXTRACTION_WORDS = {
    "parties": (("agreement", "contract"), ("this agreement", "this contract")),
    "effective_date": (("effective", "commencement"), ("effective", "shall")),
    "termination_date": (("terminat", "expir", "end"), ("shall", "will")),
    "governing_law": (("governed", "construed", "interpreted"), ("governing",)),
}
# The question put to an answer model per type.
EXTRACTION_QUESTIONS = {
    "parties": "Who are the parties to this agreement?",
    "effective_date": "What is the effective date of this agreement?",
    "termination_date": "What is the termination date of this agreement?",
    "payment_terms": "What are the payment terms in this agreement?",
    "renewal_terms": "What are the renewal terms in this agreement?",
    "governing_law": "Which law governs this agreement?",
    "venue": "What is the venue for disputes under this agreement?",
    "notice_period": "What is the notice period for termination under this agreement?",
}

# Section types that matter for summaries and for key points.
SUMMARY_SECTION_TYPES = ("covenant", "representation", "liability", "termination", "payment", "definition")
KEY_POINT_SECTION_TYPES = ("covenant", "representation", "termination", "payment", "liability")

# Model risk classes in index order -> (category, severity).
RISK_CLASSES = {
    "auto_renewal": ("renewal_risk", "medium"),
    "hidden_fee": ("payment_risk", "high"),
    "termination_without_notice": ("termination_risk", "high"),
    "unilateral_modification": ("modification_risk", "medium"),
    "unlimited_liability": ("liability_risk", "high"),
    "waiver_of_rights": ("limitation_risk", "medium"),
    "jurisdiction_restriction": ("jurisdiction_risk", "medium"),
    "data_usage": ("privacy_risk", "medium"),
    "arbitration_clause": ("jurisdiction_risk", "medium"),
    "class_action_waiver": ("limitation_risk", "high"),
    "non_assignment": ("limitation_risk", "low"),
    "minimum_commitment": ("payment_risk", "medium"),
    "liquidated_damages": ("liability_risk", "medium"),
    "non_compete": ("limitation_risk", "medium"),
    "evergreen_renewal": ("renewal_risk", "high"),
    "unilateral_price_change": ("payment_risk", "high"),
    "early_termination_fee": ("termination_risk", "medium"),
}
DEFAULT_RISK_CLASS = ("other_risk", "medium")
SECTION_LABELS = ("covenant", "representation", "condition", "termination", "payment", "liability", "definition",
                  "general")
