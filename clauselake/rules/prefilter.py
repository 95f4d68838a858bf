"""Words that a text must contain for a pattern to be able to match.

A substring test is far cheaper than a case-blind regex, so every pattern is
guarded by the words it cannot match without.
"""

from __future__ import annotations

import re

try:  # the parse tree of the standard library's own regex compiler
    from re import _constants as _c
    from re import _parser
except ImportError:  # pragma: no cover - without it rules run unguarded
    _parser = None

MIN_NEEDLE = 3
# Escapes that the engines read alike on ASCII.
_COMMON_ESCAPES = "dDwWsbBnrt"
# Groups with a mark of their own, possessive loops, ends of text, classes in classes, repeats without a lower bound.
_OWN_SYNTAX = re.compile(r"\(\?(?!:)|[+*?}]\+|\$|\[\^?\]|\[[^\]]*(?:&&|\[)|\{,")


def _best(choices: list[frozenset[str]]) -> frozenset[str] | None:
    """The most selective choice: longest shortest word, then fewest words."""
    usable = [c for c in choices if c and min(map(len, c)) >= MIN_NEEDLE]
    return max(usable, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _required(nodes) -> frozenset[str] | None:
    choices, run = [], ""
    for op, arg in [*nodes, (None, None)]:
        if op is _c.LITERAL:
            run += chr(arg)
            continue
        if run:
            choices.append(frozenset([run.lower()]))
            run = ""
        if op is _c.SUBPATTERN:
            choices.append(_required(arg[3]))
        elif op is _c.BRANCH:
            arms = [_required(a) for a in arg[1]]
            if all(arms):
                choices.append(frozenset().union(*arms))
        elif op is _c.MAX_REPEAT or op is _c.MIN_REPEAT:
            if arg[0] >= 1:
                choices.append(_required(arg[2]))
    return _best([c for c in choices if c])


def needles(patterns) -> tuple[str, ...]:
    """One of these lower-case words occurs in every text that any pattern matches; () if unknown."""
    if _parser is None:
        return ()
    found = [_required(_parser.parse(p)) for p in patterns]
    if not all(found):
        return ()
    words = sorted(frozenset().union(*found))
    return tuple(w for w in words if not any(o != w and o in w for o in words))


def portable(pattern: str) -> bool:
    """Whether the engine that searches batches of ASCII texts reads a pattern as the JVM does; False if in doubt."""
    escapes = re.findall(r"\\(.)", pattern, re.S)
    if not pattern.isascii() or any(e.isalnum() and e not in _COMMON_ESCAPES for e in escapes):
        return False
    bare = re.sub(r"\\.", "x", pattern, flags=re.S)
    # the other engine's largest count, counts in counts multiplied
    if _OWN_SYNTAX.search(bare) or any(int(n) > 100 for n in re.findall(r"\d+", " ".join(re.findall(r"\{[\d,]*\}", bare)))):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
