"""Column helpers for text and regular expressions.

All of them are built-in JVM expressions.  Patterns follow the rules of the
``re`` module of Python on ``str``: ``\\w \\s \\d \\b`` and letter case are
Unicode aware, and ``.`` stops only at a line feed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.rules import Pattern

# Fixed value: the characters removed by ``str.strip()``.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def java_regex(pattern: Pattern | str) -> str:
    """The pattern with flags that give it the meaning it has in Python.

    d: ``.`` excludes only ``\\n``; U: Unicode classes; iu: Unicode case folding.
    """
    if isinstance(pattern, str):
        return f"(?dU){pattern}"
    return f"(?d{'iu' if pattern.ignore_case else ''}U){pattern.scan}"


def find_all(text: Column, pattern: Pattern | str, group: int = 0) -> Column:
    """All non-overlapping matches of one group; ``''`` where it did not take part."""
    return F.regexp_extract_all(text, F.lit(java_regex(pattern)), F.lit(group))


def first_group(text: Column, pattern: Pattern, group: int = 1) -> Column:
    """One group of the first match, null without a match."""
    return F.when(found(text, pattern), F.regexp_extract(text, java_regex(pattern), group))


def found(text: Column, pattern: Pattern | str) -> Column:
    return text.rlike(java_regex(pattern))


def count_matches(text: Column, pattern: Pattern | str) -> Column:
    return F.regexp_count(text, F.lit(java_regex(pattern)))


def folded(text: Column) -> Column:
    """Lower case, with the four letters that match ASCII ones without case."""
    letters = {"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"}
    replaced = text
    for letter, plain in letters.items():
        replaced = F.replace(replaced, F.lit(letter), F.lit(plain))
    is_ascii = F.octet_length(text) == F.char_length(text)
    usual = is_ascii | ~contains_any(text, tuple(letters))
    return F.when(usual, F.lower(text)).otherwise(F.lower(replaced))


def may_match(low: Column, pattern: Pattern) -> Column:
    """False only if the pattern has no match; ``low`` is the folded text."""
    return contains_any(low, pattern.needles) if pattern.needles else F.lit(True)


def find_all_with(low: Column, text: Column, pattern: Pattern, group: int = 0) -> Column:
    """:func:`find_all`, run only on texts that hold a needle of the pattern."""
    none = F.array().cast("array<string>")
    return F.when(may_match(low, pattern), find_all(text, pattern, group)).otherwise(none)


def any_of(patterns: list[Pattern] | tuple[Pattern, ...]) -> str:
    """One Java regex that matches where any of the patterns does."""
    return "|".join(f"(?d{'iu' if p.ignore_case else ''}U:{p.scan})" for p in patterns)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def strip(text: Column) -> Column:
    """``str.strip()``: ``trim`` alone would remove spaces only."""
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ends_with_any(text: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.endswith(s) for s in suffixes])


def code_lines(text: Column, comment: str) -> Column:
    """Number of lines that are neither blank nor start with the comment mark."""
    mark = "".join(f"\\{c}" for c in comment)
    return F.regexp_count(
        text,
        F.lit(rf"(?dmU)^[[\s\x1c-\x1f]&&[^\n]]*+(?!{mark})[^\s\x1c-\x1f]"),
    )


def unix_newlines(text: Column) -> Column:
    """Universal newlines, as in text-mode reading."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
