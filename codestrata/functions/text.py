"""String expressions (Column in, Column out)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce, wraps
from operator import and_, or_

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

# White space as scripts see it; the regex engine's own \s covers ASCII only.
WIDE_SPACE = r"[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE_CHARACTERS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NON_SPACE = r"[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def built_once(build: Callable) -> Callable:
    """Keep large column expressions of a session instead of building them per query."""
    known: dict = {}

    @wraps(build)
    def cached(*arguments):
        context = SparkContext._active_spark_context
        key = (None if context is None else context.applicationId, arguments)
        if key not in known:
            known[key] = build(*arguments)
        return known[key]

    return cached


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``.

    A projected column that is referenced inside a lambda would be inlined and
    recomputed per element; a lambda variable never is. An aggregate over nothing hands
    its start value on as it is; an element of a transformed array would be copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, use)


def when(*cases: Column | str | int | None) -> Column:
    """Conditions, each with its value, and the value otherwise (null if none is given), as nested ``if``.

    For lambdas: these are interpreted, and there ``F.when`` walks its list of cases for every element.
    """
    values = [c if isinstance(c, Column) else F.lit(c) for c in cases]
    result = values.pop() if len(values) % 2 else F.lit(None)
    while values:
        value = values.pop()
        result = F.call_function("if", values.pop(), value, result)
    return result


def _initials(alternatives: Sequence[str], ignore_case: bool) -> str:
    """Look-ahead for the possible first characters; it rejects most positions at once."""
    firsts = {a[0] for a in alternatives}
    if ignore_case:
        firsts |= {c.upper() for c in firsts} | {c.lower() for c in firsts}
    return f"(?=[{''.join(sorted(firsts))}])"


def _word_pattern(alternatives: Sequence[str], ignore_case: bool, before: str, after: str) -> str:
    flag = "(?i)" if ignore_case else ""
    return f"{_initials(alternatives, ignore_case)}{before}{flag}(?:{'|'.join(alternatives)}){after}"


def whole_words(*alternatives: str, ignore_case: bool = False) -> str:
    """Pattern for whole words with ASCII word limits, whatever the JVM's ``\\b`` does."""
    return _word_pattern(alternatives, ignore_case, r"(?<!\w)", r"(?!\w)")


def word_starts(*alternatives: str, ignore_case: bool = False) -> str:
    """Alternatives that end in punctuation and need a word character right after."""
    return _word_pattern(alternatives, ignore_case, r"(?<!\w)", r"(?=\w)")


def distinct_words(text: Column) -> Column:
    """Different runs of ASCII word characters, for ``has_word``."""
    return F.array_distinct(F.split(text, r"\W+"))


def has_word(text: Column, words: Column, *alternatives: str, ignore_case: bool = False) -> Column:
    """Whether ``whole_words`` of the alternatives match; ``words`` are the distinct words of the text.

    With ``ignore_case`` these are in lower case. Only an alternative of several words is
    looked for in the text, and only where all of its words occur.
    """
    cased = (lambda w: w.lower()) if ignore_case else (lambda w: w)
    plain = [a for a in alternatives if re.fullmatch(r"\w+", a)]
    found = F.arrays_overlap(words, F.array(*[F.lit(cased(a)) for a in plain]))
    for several in [a for a in alternatives if a not in plain]:
        parts = [F.array_contains(words, cased(w)) for w in re.findall(r"\w+", several)]
        found = found | (reduce(and_, parts) & matches(text, whole_words(several, ignore_case=ignore_case)))
    return found


def listed_words(text: Column, listed: Sequence[str]) -> Column:
    """Those of the words in the alternatives that occur in any case, in lower case, for ``has_word`` with ``ignore_case``.

    Words are ASCII, so a text of ASCII is put in lower case as a whole; other texts word by word, since
    signs outside ASCII may have a lower case within it.
    """
    wanted = sorted({w.lower() for a in listed for w in re.findall(r"\w+", a.replace("\\", " "))})
    words = when(F.octet_length(text) == F.length(text), F.split(F.lower(text), r"\W+"), F.transform(F.split(text, r"\W+"), F.lower))
    return F.array_intersect(words, F.array(*[F.lit(w) for w in wanted]))


def has_cased_word(text: Column, words: Column, *alternatives: str) -> Column:
    """Whether ``whole_words`` of the alternatives match; only a text with one of the ``listed_words`` is searched."""
    return has_word(text, words, *alternatives, ignore_case=True) & matches(text, whole_words(*alternatives))


def keywords(*alternatives: str) -> str:
    """Whole words of a script that are not a member name."""
    return _word_pattern(alternatives, False, r"(?<![\w$.])", r"(?![\w$])")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def has_any(text: Column, *parts: str) -> Column:
    """Whether one of the parts occurs; a quick test before a pattern that needs one of them."""
    return reduce(or_, [text.contains(part) for part in parts])


def matches_with(text: Column, pattern: str, *parts: str) -> Column:
    """``matches`` for a pattern that needs one of the parts."""
    return has_any(text, *parts) & matches(text, pattern)


def occurrences_with(text: Column, pattern: str, *parts: str) -> Column:
    """``occurrences`` of a pattern that needs one of the parts."""
    return when(has_any(text, *parts), occurrences(text, pattern), text.isNotNull(), 0)


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NON_SPACE)


def without_indent(line: Column) -> Column:
    """Blanks go first: they are dropped one by one without a look into the list."""
    return F.ltrim(F.ltrim(line), F.lit(SPACE_CHARACTERS))


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def line_count(text: Column) -> Column:
    """Blank text has no lines; otherwise a trailing newline adds one."""
    return F.when(is_blank(text), F.lit(0)).otherwise(F.size(lines_of(text)))


def marker_count(text: Column) -> Column:
    return occurrences(text, whole_words(*fixed.MARKERS, ignore_case=True))


def _without_line_comments(text: Column, sign: str) -> Column:
    """Text without what stands from a sign to the end of its line.

    A class of few ASCII signs is one table for the JVM, a class that joins others is several
    tests a character. So the wider one is for texts that hold such line ends.
    """
    wide = text.contains("\u2028") | text.contains("\u2029")
    shorter = when(wide, F.regexp_replace(text, sign + r"[^\n\r\u2028\u2029]*", ""), F.regexp_replace(text, sign + r"[^\n\r]*", ""))
    return when(text.contains(sign), shorter, text)


def strip_hash_comments(text: Column) -> Column:
    return _without_line_comments(text, "#")


def strip_slash_comments(text: Column) -> Column:
    def blocks(no_line: Column) -> Column:
        return when(no_line.contains("/*"), F.regexp_replace(no_line, r"(?s)/\*.*?\*/", ""), no_line)

    return bind(_without_line_comments(text, "//"), blocks)


def body_hash(body: Column, hash_comments: bool) -> Column:
    text = strip_hash_comments(body) if hash_comments else body

    def hashed(code: Column) -> Column:
        # All white space that is wide is outside ASCII.
        wide = (F.octet_length(code) > F.length(code)) & code.rlike(WIDE_SPACE)
        ascii_only = when(wide, F.regexp_replace(code, WIDE_SPACE, " "), code)
        # Single blanks stay as they are: replacing only the other runs is much cheaper.
        collapsed = F.regexp_replace(ascii_only, r"[\t\n\x0b\f\r]\s*| \s+", " ")
        return F.sha1(F.trim(collapsed))

    return bind(strip_slash_comments(text), hashed)


def slug(text: Column) -> Column:
    runs = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(runs, "^_+|_+$", ""), 1, 80)


def brief_file_name(number: Column, title: Column) -> Column:
    digits = number.cast("string")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.concat(padded, F.lit("_"), slug(title), F.lit(".md"))


def pascal_case(text: Column) -> Column:
    parts = F.filter(F.split(text, "[^a-zA-Z0-9]+"), lambda p: p != "")
    cased = F.transform(
        parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
    )
    return F.array_join(cased, "")


def snake_case(text: Column) -> Column:
    split_humps = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2")
    runs = F.regexp_replace(split_humps, "[^a-zA-Z0-9]+", "_")
    return F.lower(F.regexp_replace(runs, "^_+|_+$", ""))


def signed(value: Column) -> Column:
    text = value.cast("string")
    return (
        F.when(value.isNull(), F.lit("n/a"))
        .when(value >= 0, F.concat(F.lit("+"), text))
        .otherwise(text)
    )


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a small fixed dictionary as a chain of conditions."""
    chain = None
    for name, value in values.items():
        chain = (
            F.when(key == name, F.lit(value))
            if chain is None
            else chain.when(key == name, F.lit(value))
        )
    return chain


def lookup_lists(values: dict[str, Sequence[str]], key: Column) -> Column:
    chain = None
    for name, items in values.items():
        item = F.array(*[F.lit(i) for i in items])
        chain = F.when(key == name, item) if chain is None else chain.when(key == name, item)
    return chain
