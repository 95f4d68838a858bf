"""Legal vocabulary: words to find, their category and a plain-language gloss."""

from clauselake.rules.model import LegalTerm

# Keys, words, categories and importance decide the results and
# must stay exactly as they are (the first word is the term, the rest its variations).
LEGAL_TERMS = (
    LegalTerm("agreement", "contract", "high", ("agreement", "contract", "instrument", "document"),
              plain="the deal", definition="A promise between sides that a court would enforce."),
    LegalTerm("party", "contract", "high", ("party", "parties", "signatory", "signatories"),
              plain="someone who signed", definition="A person or firm that takes on duties by signing."),
    LegalTerm("effective_date", "time", "high", ("effective date", "commencement date", "start date"),
              plain="first day", definition="The day from which rights and duties count."),
    LegalTerm("term", "time", "high", ("term", "duration", "period"),
              plain="how long it runs", definition="The stretch of time for which the deal binds."),
    LegalTerm("termination", "time", "high", ("termination", "terminate", "cancellation", "rescission"),
              plain="ending it", definition="The close of a deal, on schedule or ahead of it."),
    LegalTerm("shall", "obligation", "medium", ("shall", "must", "will", "is obligated to"),
              plain="has to", definition="Marks a duty that leaves no choice."),
    LegalTerm("may", "permission", "medium", ("may", "is permitted to", "is entitled to", "has the right to"),
              plain="is free to", definition="Marks a choice that can be taken or left."),
    LegalTerm("payment", "financial", "high", ("payment", "fee", "compensation", "remuneration", "consideration"),
              plain="money handed over", definition="Value given in return for goods, work or rights."),
    LegalTerm("invoice", "financial", "medium", ("invoice", "bill", "statement"),
              plain="request for money", definition="A seller's note of what was delivered and what is owed."),
    LegalTerm("confidentiality", "protection", "high",
              ("confidentiality", "confidential information", "proprietary information", "non-disclosure"),
              plain="keeping a secret", definition="The duty to keep named facts away from outsiders."),
    LegalTerm("intellectual_property", "protection", "high",
              ("intellectual property", "IP", "intangible assets", "proprietary rights"),
              plain="owned ideas", definition="Rights in inventions, brands, texts and other products of the mind."),
    LegalTerm("indemnification", "protection", "high", ("indemnification", "indemnity", "hold harmless", "defend"),
              plain="cover for a loss", definition="One side's duty to make good what the other loses."),
    LegalTerm("warranty", "protection", "high", ("warranty", "guarantee", "represent", "assurance"),
              plain="promise of quality", definition="A promise that something is, or will be, as described."),
)
