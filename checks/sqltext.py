"""Pieces of DuckDB SQL shared by the checks."""

from __future__ import annotations

from entitylake.functions.html import ENTITIES
from entitylake.rules import query_rules as qr


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(v if isinstance(v, str) and v.startswith("::") else (lit(v) if isinstance(v, str) else str(v)) for v in r) + ")" for r in rows)


def trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:@\s]+)"


def host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, {lit(HOST)}, 1)), '')"


def domain(u: str) -> str:
    return rf"coalesce(regexp_replace({host(u)}, '^www\.', ''), {u})"


def path(u: str) -> str:
    p = rf"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"(CASE WHEN {host(u)} IS NULL THEN NULL WHEN {p} = '' THEN '/' ELSE {p} END)"


def decode(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return x


def text_of(x: str) -> str:
    return decode(f"regexp_replace({x}, '<[^<>]*>', '', 'g')")


def attr(tag: str, name: str) -> str:
    p = lit(rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    return decode("(" + " || ".join(f"regexp_extract({tag}, {p}, {i})" for i in (1, 2, 3)) + ")")


def markup(x: str) -> str:
    return rf"regexp_replace({x}, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g')"


def i(pattern: str) -> str:
    """Case-insensitive pattern literal."""
    return lit("(?i)" + pattern)


def re2_hit(x: str, pattern: str) -> str:
    """Condition for a rule; RE2 has no look-ahead, so those rules become two counts."""
    for word in ("game", "software"):
        ahead = rf"\b{word}\b(?! agency)"
        if ahead in pattern:
            rest = [p for p in pattern.split("|") if p != ahead]
            alone = f"len(regexp_extract_all({x}, {i(rf'''\b{word}\b''')})) > len(regexp_extract_all({x}, {i(rf'''\b{word}\b agency''')}))"
            return f"(regexp_matches({x}, {i('|'.join(rest))}) OR {alone})"
    return f"regexp_matches({x}, {i(pattern.replace(r'(?!\w)', ''))})"


def first_label(x: str, rules, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {re2_hit(x, p)} THEN {lit(label)}" for p, label in rules)
    return f"(CASE {whens} ELSE {default} END)"


def hits(x: str, patterns) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {i(p)}) AS INT)" for p in patterns) + ")"


def as_list(x: str) -> str:
    return f"list_filter(string_split(coalesce({x}, ''), '|'), lambda e: e <> '')"


def group(x: str, pattern: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {i(pattern)}, {g}), '')"


def distinct_in_order(array: str, limit: int) -> str:
    """Text of the first distinct elements of a list, joined by '|'."""
    return (
        f"coalesce((SELECT string_agg(e, '|' ORDER BY p) FROM (SELECT e, min(p) AS p FROM (SELECT unnest({array}) AS e, "
        f"generate_subscripts({array}, 1) AS p) GROUP BY e ORDER BY p LIMIT {limit})), '')"
    )


def short_list(array: str, limit: int) -> str:
    return f"array_to_string(list_slice({array}, 1, {limit}), '|')"


INTENT = lambda q: first_label(q, qr.INTENT_RULES, lit(qr.DEFAULT_INTENT))
