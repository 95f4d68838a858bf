"""Clause rule pack: which standard clause a section contains."""

from clauselake.rules.model import ClauseRule, Probe

# Keys, names, importance, risk factors and patterns decide the
# results and must stay exactly as they are.
CLAUSE_RULES = (
    ClauseRule(
        key="definitions", name="Definitions", importance="high", boilerplate=True,
        purpose="Gives the words of the deal one agreed meaning.",
        patterns=(
            r"(?:Definitions|Defined\s+Terms)",
            r"""(?:"[^"]+"|'[^']+'|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:shall\s+mean|means|refers\s+to)""",
            r"(?:For\s+purposes\s+of\s+this\s+Agreement|As\s+used\s+in\s+this\s+Agreement)",
        ),
        # case-blind, the capitalised words are any words, so two letters before the verb decide
        probes={1: Probe(
            words=("mean", "refers"),
            pattern=r"""(?:"[^"]+"|'[^']+'|[a-z]{2})\s+(?:shall\s+mean|means|refers\s+to)""",
            quoted=r"""(?:"[^"]+"|'[^']+')\s+(?:shall\s+mean|means|refers\s+to)""",
            verb=r"(?:shall\s+mean|means|refers\s+to)")},
    ),
    ClauseRule(
        key="term", name="Term", importance="high",
        purpose="Says from when and for how long the deal runs.",
        patterns=(
            r"(?:Term|Duration)\s+of\s+(?:Agreement|this\s+Agreement)",
            r"This\s+Agreement\s+shall\s+(?:commence|begin|be\s+effective)",
            r"(?:initial\s+term|term\s+of)\s+(?:this\s+Agreement)?\s+shall\s+be",
            r"shall\s+remain\s+in\s+(?:full\s+)?force\s+and\s+effect\s+for\s+a\s+period\s+of",
        ),
    ),
    ClauseRule(
        key="renewal", name="Renewal", importance="high",
        purpose="Says how a further period comes about.",
        risk_factors=("auto_renewal", "evergreen_renewal"),
        patterns=(
            r"(?:renewal|extension|renew|extend)\s+(?:term|period|for)",
            r"(?:auto(?:matic)?ally|deemed\s+to)\s+(?:renew|extend|continue)",
            r"(?:successive|additional|renewal)\s+(?:term|period)s?\s+of",
            r"(?:continue|extend)\s+for\s+(?:successive|additional)",
        ),
    ),
    ClauseRule(
        key="termination", name="Termination", importance="high",
        purpose="Says who may end the deal and in which way.",
        risk_factors=("termination_without_notice", "early_termination_fee"),
        patterns=(
            r"(?:Termination|Cancellation)",
            r"(?:right\s+to\s+|may\s+|can\s+)(?:terminate|cancel)\s+this\s+Agreement",
            r"(?:Either|Any)\s+[Pp]arty\s+may\s+terminate",
            r"This\s+Agreement\s+may\s+be\s+terminated",
        ),
    ),
    ClauseRule(
        key="payment_terms", name="Payment Terms", importance="high",
        purpose="Says what is paid, how and by when.",
        risk_factors=("hidden_fee", "unilateral_price_change", "minimum_commitment"),
        patterns=(
            r"(?:Payment|Fees|Compensation|Price)",
            r"(?:shall|will|agrees\s+to)\s+pay",
            r"(?:payment|fee)s?\s+(?:shall|will)\s+be\s+due",
            r"(?:invoice|billing|payment)\s+terms",
        ),
    ),
    ClauseRule(
        key="confidentiality", name="Confidentiality", importance="high",
        purpose="Keeps shared secrets between the sides.",
        patterns=(
            r"(?:Confidentiality|Non[-\s]Disclosure|Confidential\s+Information)",
            r"(?:shall|will|must)\s+(?:maintain\s+|treat\s+|keep\s+|hold).{0,20}?confidential",
            r"(?:agrees\s+|undertakes\s+)?not\s+to\s+disclose",
            r"(?:protect|safeguard).{0,20}?(?:confidential|proprietary)\s+information",
        ),
    ),
    ClauseRule(
        key="intellectual_property", name="Intellectual Property", importance="high",
        purpose="Says who owns and who may use inventions, brands and works.",
        patterns=(
            r"(?:Intellectual\s+Property|IP)\s+Rights",
            r"(?:copyright|trademark|patent|trade\s+secret)",
            r"(?:ownership|title|rights)\s+(?:to|in|of).{0,30}?(?:intellectual\s+property|copyright|trademark)",
            r"(?:license|grant|transfer).{0,30}?(?:intellectual\s+property|copyright|trademark)",
        ),
    ),
    ClauseRule(
        key="limitation_of_liability", name="Limitation of Liability", importance="high",
        purpose="Caps what one side can owe the other for damage.",
        risk_factors=("unlimited_liability",),
        patterns=(
            r"(?:Limitation\s+of\s+Liability|Limits\s+on\s+Liability)",
            r"(?:not|no|never)\s+(?:be\s+liable|have\s+liability)",
            r"(?:liability|damages|obligation).{0,30}?(?:limited|limit|cap|exceed|maximum)",
            r"(?:exclude|exclusion|limitation)\s+of\s+(?:liability|damages)",
        ),
    ),
    ClauseRule(
        key="indemnification", name="Indemnification", importance="high",
        purpose="Shifts the cost of outside claims to one side.",
        patterns=(
            r"(?:Indemnification|Indemnity)",
            r"(?:indemnify|defend|hold\s+harmless)",
            r"(?:shall|will|agrees\s+to)\s+(?:indemnify|defend|hold.{0,10}?harmless)",
            r"(?:indemnification|defense)\s+obligations",
        ),
    ),
    ClauseRule(
        key="governing_law", name="Governing Law", importance="high",
        purpose="Names the legal system that decides questions.",
        patterns=(
            r"(?:Governing\s+Law|Applicable\s+Law|Choice\s+of\s+Law)",
            r"(?:governed|construed|interpreted)\s+(?:by|in\s+accordance\s+with)\s+the\s+laws\s+of",
            r"(?:laws|law)\s+of\s+the\s+(?:State|Commonwealth|Province|Territory)\s+of",
            r"this\s+Agreement\s+shall\s+be\s+governed\s+by",
        ),
    ),
    ClauseRule(
        key="arbitration", name="Arbitration", importance="high",
        purpose="Sends disputes to a private panel instead of a court.",
        risk_factors=("arbitration_clause", "class_action_waiver"),
        patterns=(
            r"(?:Arbitration|Dispute\s+Resolution)",
            r"(?:disputes|claims|controversies).{0,30}?(?:shall|will|must)\s+be\s+(?:resolved|settled)\s+by\s+arbitration",
            r"(?:binding|mandatory)\s+arbitration",
            r"(?:JAMS|AAA|ICC).{0,20}?(?:rules|procedures)",
        ),
    ),
    ClauseRule(
        key="assignment", name="Assignment", importance="medium",
        purpose="Says whether the deal can be handed to somebody else.",
        risk_factors=("non_assignment",),
        patterns=(
            r"(?:Assignment|Transfer|Delegation)",
            r"(?:may|shall)\s+(?:not|neither)\s+(?:assign|transfer|delegate)",
            r"(?:assignment|transfer|delegation).{0,20}?(?:consent|permission|approval)",
            r"(?:rights|obligations|agreement)\s+(?:not|non)\s+(?:assignable|transferable)",
        ),
    ),
)
