"""Turning rule tables into column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \b follows Unicode letters while \w is ASCII, so "caf\b" misses inside "cafés".
# Rules mean ASCII words, hence an explicit edge.
ASCII_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _sql(text: str) -> str:
    """A text as SQL literal. Tables of literals are one SQL text: one call instead of hundreds."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`.

    Catalyst may inline a column into the place that reads it. Inside a lambda that would repeat
    the work per element, so a value used there is passed as a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", ASCII_EDGE)


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java_pattern(pattern, ignore_case))


def first_group(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The group of the first match, or null. An empty match also gives null."""
    found = F.regexp_extract(text, java_pattern(pattern, ignore_case), group)
    return F.when(found != "", found)


def all_groups(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern, ignore_case)), F.lit(group))


def required_words(pattern: str) -> list[str] | None:
    """One lower-case literal per alternative without which it cannot match; None if one has none."""
    gap = "\n"
    bare = re.sub(r"\[[^\]]*\][?*+]?", gap, pattern)
    while "(" in bare.replace(r"\(", ""):
        bare = re.sub(r"\([^()]*\)[?*+]?", gap, bare)
    bare = re.sub(r"\\.[?*+]?|\.[?*+]?|.[?*]|[+^$]", gap, bare)
    words = [max(alternative.split(gap), key=len).lower() for alternative in bare.split("|")]
    return words if min(map(len, words)) >= 2 else None


def _guarded(text: Column, lowered: Column, pattern: str) -> Column:
    """The pattern test, tried only where a plain substring search found one of its words."""
    words = required_words(pattern)
    if words is None:
        return matches(text, pattern)
    present = F.lit(False)
    for word in words:
        present = present | lowered.contains(word)
    return present & matches(text, pattern)


def first_label(
    text: Column, rules: Sequence[tuple[str, str]], default: str | None = None
) -> Column:
    """Label of the first rule that matches; CASE stops at the first true branch."""

    def decide(t: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, label in rules:
            chain = chain.when(_guarded(t["text"], t["low"], pattern), F.lit(label))
        return chain.otherwise(F.lit(default).cast("string"))

    return bind(F.struct(text.alias("text"), F.lower(text).alias("low")), decide)


def count_hits(text: Column, patterns: Iterable[str]) -> Column:
    """How many of the patterns occur at least once."""

    def total(t: Column) -> Column:
        n = F.lit(0)
        for pattern in patterns:
            n = n + _guarded(t["text"], t["low"], pattern).cast("int")
        return n

    return bind(F.struct(text.alias("text"), F.lower(text).alias("low")), total)


def terms_found(lowered: Column, terms: Sequence[str]) -> Column:
    """The terms that occur as substrings, in rule order. One array filter, not one column each."""
    table = F.expr(_array(f"named_struct('low', {_sql(t.lower())}, 'term', {_sql(t)})" for t in terms))
    hits = bind(lowered, lambda text: F.filter(table, lambda t: text.contains(t["low"])))
    return F.transform(hits, lambda t: t["term"])


def labels_by_signature(lowered: Column, signatures: Mapping[str, Sequence[str]]) -> Column:
    """The labels with at least one signature present, in rule order."""
    rows = (
        f"named_struct('label', {_sql(label)}, 'sigs', {_array(_sql(s.lower()) for s in sigs)})"
        for label, sigs in signatures.items()
    )
    table = F.expr(_array(rows))
    hits = bind(
        lowered,
        lambda text: F.filter(table, lambda t: F.exists(t["sigs"], lambda s: text.contains(s))),
    )
    return F.transform(hits, lambda t: t["label"])


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed map, or null."""
    pairs = ", ".join(_sql(x) for pair in table.items() for x in pair)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def string_array(values: Iterable[str]) -> Column:
    return F.expr(_array(_sql(v) for v in values))
