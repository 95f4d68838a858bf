"""Small immutable records that describe rules; they live on the driver only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """Literal pattern for Spark: newline is ``\\n`` only, optionally case-blind."""
    # dotted numbers: no other way to match exists once a part is taken, so the loop may be possessive and
    # then iterates instead of recursing
    pattern = pattern.replace(r"(?:\.\d+)*", r"(?:\.\d++)*+")
    return ("(?di)" if ignore_case else "(?d)") + pattern


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def whole_word(word: str) -> str:
    """`\\bword\\b` with the literal in front.

    The matcher then skips a position on its first character instead of testing
    a word boundary everywhere; the boundary before the word is checked last.
    """
    literal = re.escape(word)
    return rf"{literal}\b(?<!\w{literal})"


def whole_words(words) -> str:
    """Any of the words as a whole word, grouped by first letter so that few branches are tried."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0].lower(), []).append(re.escape(w[1:]))
    return r"\b(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items()) + r")\b"


@dataclass(frozen=True)
class Probe:
    """Stand-ins for a pattern of the form `(quoted text | run of words) + verb`, which would recurse once per word.

    `pattern` tells whether it matches, `quoted` and `verb` are its parts for finding the match.
    """
    words: tuple[str, ...]
    pattern: str
    quoted: str
    verb: str


@dataclass(frozen=True)
class RiskRule:
    key: str
    name: str
    category: str
    severity: str
    patterns: tuple[str, ...]
    exceptions: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    impact: str = ""
    explanation: str = ""
    suggestion: str = ""
    probes: dict[int, Probe] = field(default_factory=dict)


@dataclass(frozen=True)
class ClauseRule:
    key: str
    name: str
    importance: str
    patterns: tuple[str, ...]
    purpose: str = ""
    boilerplate: bool = False
    risk_factors: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    probes: dict[int, Probe] = field(default_factory=dict)


@dataclass(frozen=True)
class LegalTerm:
    key: str
    category: str
    importance: str
    words: tuple[str, ...]
    plain: str = ""
    definition: str = ""

    def word_patterns(self) -> list[str]:
        return [whole_word(w) for w in self.words]
