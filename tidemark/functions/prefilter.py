"""Which of many word patterns can match a text at all, found in one pass.

Every pattern begins at a word boundary, so its first letters say where it can begin. One
search for all first letters, written as a tree, names the few patterns worth evaluating.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as parser

#: Letters of a key.
LETTERS = 3


def first_letters(pattern: str) -> set[str]:
    """All beginnings of what a pattern matches, up to ``LETTERS`` letters, shorter where they stop being fixed."""
    found = _grow(list(parser.parse(pattern)), {("", False)})
    keys = {k for k, _ in found}
    if "" in keys:
        raise ValueError(f"no fixed beginning: {pattern!r}")
    return keys


def _grow(items: list, begun: set[tuple[str, bool]]) -> set[tuple[str, bool]]:
    """Beginnings (letters, ended) extended by the parsed items."""
    for op, arg in items:
        if all(ended or len(k) >= LETTERS for k, ended in begun):
            break
        if op is C.AT:
            continue
        if op is C.LITERAL:
            more = {chr(arg)}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            more = {chr(a) for _, a in arg}
        elif op is C.SUBPATTERN:
            begun = _grow(list(arg[3]), begun)
            continue
        elif op is C.BRANCH:
            begun = set().union(*(_grow(list(branch), begun) for branch in arg[1]))
            continue
        elif op is C.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            begun = begun | _grow(list(arg[2]), begun)
            continue
        else:
            more = None
        if more is None:
            return {(k, True) for k, _ in begun}
        begun = {b for k, ended in begun for b in ([(k, ended)] if ended or len(k) >= LETTERS else [(k + c, False) for c in more])}
    return begun


class Prefilter:
    """Keys of a list of patterns: ``regex`` finds those in a text, ``keys[i]`` are those of pattern i."""

    def __init__(self, patterns: Sequence[str]):
        every = sorted(set().union(*map(first_letters, patterns)), key=len)
        kept: list[str] = []
        for k in every:
            # a key that begins with another one is found as the other
            if not any(k.startswith(other) for other in kept):
                kept.append(k)
        self.keys = [sorted({next(k for k in kept if key.startswith(k)) for key in first_letters(p)}) for p in patterns]
        self.regex = r"\b" + _tree(sorted(kept))

    def found(self, text: Column) -> Column:
        """Distinct keys at the word beginnings of a text."""
        return F.array_distinct(F.regexp_extract_all(text, F.lit(self.regex), F.lit(0)))

    def possible(self, found: Column, i: int) -> Column:
        """Whether pattern i can match a text with these keys."""
        keys = self.keys[i]
        return F.array_contains(found, keys[0]) if len(keys) == 1 else F.arrays_overlap(found, F.array(*map(F.lit, keys)))


def _tree(words: Sequence[str]) -> str:
    """One pattern for words none of which begins with another, alternatives parted by first letter."""
    if list(words) == [""]:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(re.escape(c) + _tree(rest) for c, rest in by.items()) + ")"


def parted(terms: Sequence[str]) -> str:
    """Alternatives grouped by first letter, each group in the given order: the same matches with fewer tries."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(t[1:])
    return "(?:" + "|".join(re.escape(c) + "(?:" + "|".join(rest) + ")" for c, rest in by.items()) + ")"
