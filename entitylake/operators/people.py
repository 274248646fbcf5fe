"""People found in structured data, in page markup and in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.html import inside_of, text_of
from ..functions.patterns import ASCII_EDGE, bind, lookup
from ..functions.text import squash, trim_all
from ..rules import page_rules as rules

PAIRS = "array<struct<name:string,role:string>>"
PERSON = "struct<name:string,role:string,linkedin:string,twitter:string>"


def person(name: Column, role: Column, linkedin: Column | None = None, twitter: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        role.alias("role"),
        (none if linkedin is None else linkedin).alias("linkedin"),
        (none if twitter is None else twitter).alias("twitter"),
    )


def add_people(start: Column, people: Column, limit: int) -> Column:
    """`start`, then each of `people` whose name, case ignored, is not there yet, up to `limit`."""

    def step(kept: Column, p: Column) -> Column:
        known = F.exists(kept, lambda q: F.lower(q["name"]) == F.lower(p["name"]))
        return F.when(known | (F.size(kept) >= limit), kept).otherwise(F.concat(kept, F.array(p)))

    return F.slice(F.aggregate(people, start, step), 1, limit)


def first_by_name(people: Column, limit: int) -> Column:
    return add_people(F.array().cast(f"array<{PERSON}>"), people, limit)


def _zip_groups(text: Column, pattern: str, name_group: int, role_group: int) -> Column:
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(name_group)).alias("name"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(role_group)).alias("role"),
    )


# --- markup -------------------------------------------------------------------------------------

HEADING_THEN_SIBLING = r"(?is)<h[34]\b[^>]*>(.*?)</h[34]>\s*<[a-z0-9]+\b[^>]*>(.*?)</"
BLOCK = r"(?is)<(?:p|li)\b[^>]*>(.*?)</(?:p|li)>"
BOLD = r"(?is)<(?:strong|b)(?:\s[^>]*)?>(.*?)</(?:strong|b)>"
CAPTION = (
    r"""(?is)<(?:figcaption\b|(?:p|div|span)\s[^>]*class=["'][^"']*(?:caption|credit|byline)[^"']*["'])"""
    r"""[^>]*>(.*?)</(?:figcaption|p|div|span)>"""
)
CAPTION_PARTS = r"^([A-Z][a-zA-Z'-]+(?: [A-Z][a-zA-Z'-]+)+)\s*[|,]\s*([^|,\n]{3,60})"
ROLE = "(?i)" + rules.MARKUP_ROLES
_CARD_WORDS = "|".join(rules.CARD_CLASSES)
CARD = rf"""<[a-zA-Z][a-zA-Z0-9]*\b[^>]*?\s(?:class\s*=\s*["'][^"']*(?:{_CARD_WORDS})|itemtype\s*=\s*["'][^"']*Person|typeof\s*=\s*["']Person["'])[^>]*>"""
CARD_NAME = r"""<(?:[hH][1-5]|[sS][tT][rR][oO][nN][gG]|[bB])\b[^>]*>|<[a-zA-Z][^>]*?\sclass\s*=\s*["'](?:[^"']*name|(?![^"']*(?:job|position))[^"']*title)[^>]*>"""
CARD_ROLE = (
    rf"""<[a-zA-Z][^>]*?\sclass\s*=\s*["'](?:[^"']*(?:{"|".join(rules.ROLE_CLASSES)})"""
    r"""|(?=[^"']*title)[^"']*(?:job|pos))[^>]*>"""
)
NOT_A_NAME = ASCII_EDGE + "(" + "|".join(rules.NOT_A_NAME_MARKUP) + ")" + ASCII_EDGE


def _acceptable(p: Column) -> Column:
    return (
        F.length(p["name"]).between(4, 55)
        & F.length(p["role"]).between(3, 80)
        & p["name"].rlike("^[A-Z][a-z]")
        & p["name"].contains(" ")
        & ~p["name"].rlike(NOT_A_NAME)
    )


def _tidy(pairs: Column) -> Column:
    people = F.transform(pairs, lambda p: person(squash(p["name"]), squash(p["role"])))
    return F.filter(people, _acceptable)


def _without(text: Column, part: Column) -> Column:
    """The text with the first occurrence of a part cut out."""
    at = F.position(part, text)
    cut = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part)))
    return F.when(at > 0, cut).otherwise(text)


def _from(text: Column, opening: str) -> Column:
    """The text from the first tag like `opening` on, '' without one."""
    return F.regexp_extract(text, rf"(?s)((?:{opening}).*)\z", 1)


def _in_card(opened: Column) -> Column:
    """(name, role) of the card that the text starts with: the first heading, bold or named element, and the element with a class of
    a role, else the one that follows the name, else the first paragraph or span."""

    def pair(card: Column) -> Column:
        def roles(at: Column) -> Column:
            opening = F.length(F.regexp_extract(at, r"^<[^>]*>", 0))
            behind = F.regexp_replace(F.substring(at, opening + F.length(inside_of(at)) + 1, F.length(at)), r"^</[^>]*>", "")
            ways = [_from(card, CARD_ROLE), F.regexp_extract(behind, r"(?s)^[^<]*(<[a-zA-Z].*)\z", 1), _from(card, r"<(?:[pP]|[sS][pP][aA][nN])\b")]
            found = F.when(ways[0] != "", ways[0]).when(ways[1] != "", ways[1]).otherwise(ways[2])
            return F.struct(trim_all(text_of(inside_of(at))).alias("name"), trim_all(text_of(inside_of(found))).alias("role"))

        return bind(_from(card, CARD_NAME), roles)

    return bind(inside_of(opened), pair)


def people_in_cards(markup: Column) -> Column:
    """Name and role of every team card, in page order; a card within a card counts as well."""

    def cards(parts: Column) -> Column:
        opened = F.transform(F.slice(parts, 2, F.size(parts)), lambda _, i: F.array_join(F.slice(parts, i + 2, F.size(parts)), ""))
        return F.filter(F.transform(opened, _in_card), lambda p: (p["name"] != "") & p["role"].rlike(ROLE))

    found = bind(F.split(F.concat(F.lit(" "), markup), f"(?={CARD})"), cards)
    return F.when(markup.rlike(f"{_CARD_WORDS}|Person"), found).otherwise(F.array().cast(PAIRS))


def people_in_markup(markup: Column, limit: int = 8) -> Column:
    """Team cards; only if none, a heading with a role sibling; only if none, a bold name with a short role line. Captions always."""
    carded = _tidy(people_in_cards(markup))
    headed = F.filter(
        F.transform(
            _zip_groups(markup, HEADING_THEN_SIBLING, 1, 2),
            lambda p: F.struct(text_of(p["name"]).alias("name"), text_of(p["role"]).alias("role")),
        ),
        lambda p: p["role"].rlike(ROLE),
    )
    headed = _tidy(headed)

    lines = F.transform(
        F.filter(F.regexp_extract_all(markup, F.lit(BLOCK), F.lit(1)), lambda b: b.rlike(BOLD)),
        lambda b: F.struct(
            trim_all(text_of(F.regexp_extract(b, BOLD, 1))).alias("name"), trim_all(text_of(b)).alias("all")
        ),
    )
    rests = F.transform(
        lines,
        lambda p: F.struct(p["name"].alias("name"), trim_all(_without(p["all"], p["name"])).alias("rest")),
    )
    bold = F.transform(
        F.filter(rests, lambda p: (F.length(p["rest"]) <= 120) & p["rest"].rlike(ROLE)),
        lambda p: F.struct(p["name"].alias("name"), F.regexp_extract(p["rest"], ROLE, 0).alias("role")),
    )
    bold = _tidy(bold)

    captions = F.transform(
        F.regexp_extract_all(markup, F.lit(CAPTION), F.lit(1)), lambda c: trim_all(text_of(c))
    )
    credited = F.filter(
        F.transform(
            captions,
            lambda c: F.struct(
                F.regexp_extract(c, CAPTION_PARTS, 1).alias("name"),
                trim_all(F.regexp_extract(c, CAPTION_PARTS, 2)).alias("role"),
            ),
        ),
        lambda p: p["role"].rlike(ROLE),
    )
    credited = _tidy(credited)
    other = bind(headed, lambda h: F.when(F.size(h) > 0, h).otherwise(bold))
    found = F.concat(bind(carded, lambda c: F.when(F.size(c) > 0, c).otherwise(other)), credited)
    return first_by_name(found, limit)


# --- running text -------------------------------------------------------------------------------

_TITLES = "|".join(rules.EXECUTIVE_TITLES)
_TITLES_REVERSED = "|".join(t[::-1] for t in rules.EXECUTIVE_TITLES)
_INITIALS = "".join(sorted({t[0] for t in rules.EXECUTIVE_TITLES}))
TITLE_THEN_NAME = rf"(?=[{_INITIALS}])({_TITLES})\s*[:\-–]\s*([A-Z][a-z]++(?: [A-Z][a-z]++)++)"
# "Name, TITLE" and "Name is the TITLE" end in a title after a run of words of any length. Matching
# them forwards backtracks over the run; on reversed text the title comes first and the run is
# taken without backtracking, which gives the same pairs from right to left. Most texts have no
# such title at all, which a forward search for the anchor alone settles cheaply.
NAME_THEN_TITLE = rf"[a-z][,\s]++\(?(?=[{_INITIALS}])(?:{_TITLES})"
NAME_THEN_TITLE_REVERSED = rf"({_TITLES_REVERSED})\(?[,\s]+([a-z]++[A-Z](?: [a-z]++[A-Z])++)"
NAME_IS_TITLE = rf"(?i)[a-z]\s++is\s++(?:the\s++)?(?=[{_INITIALS}])(?:{_TITLES})"
NAME_IS_TITLE_REVERSED = rf"(?i)({_TITLES_REVERSED})(?:\s+eht)?\s+si\s+([a-z]{{2,}}+(?: [a-z]{{2,}}+)++)"
NOT_A_NAME_IN_TEXT = ASCII_EDGE + "(" + "|".join(rules.NOT_A_NAME_TEXT) + ")" + ASCII_EDGE


def _pairs(text: Column, pattern: str, name_group: int, role_group: int) -> Column:
    """(name, role) of every match; the groups are read from the short matches, not the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        found,
        lambda m: F.struct(
            F.regexp_extract(m, pattern, name_group).alias("name"),
            F.regexp_extract(m, pattern, role_group).alias("role"),
        ),
    )


def _before_title(text: Column, anchor: str, pattern: str) -> Column:
    turned = F.transform(
        _pairs(F.reverse(text), pattern, 2, 1),
        lambda p: F.struct(F.reverse(p["name"]).alias("name"), F.reverse(p["role"]).alias("role")),
    )
    return F.when(text.rlike(anchor), F.reverse(turned)).otherwise(F.array().cast(PAIRS))


def people_in_text(text: Column, limit: int = 6) -> Column:
    pairs = bind(
        text,
        lambda t: F.concat(
            _pairs(t, TITLE_THEN_NAME, 2, 1),
            _before_title(t, NAME_THEN_TITLE, NAME_THEN_TITLE_REVERSED),
            _before_title(t, NAME_IS_TITLE, NAME_IS_TITLE_REVERSED),
        ),
    )
    kept = F.filter(pairs, lambda p: (F.length(p["name"]) >= 4) & ~p["name"].rlike(NOT_A_NAME_IN_TEXT))
    people = F.transform(
        kept,
        lambda p: person(p["name"], F.coalesce(lookup(p["role"], rules.SHORT_TITLES), p["role"])),
    )
    return first_by_name(people, limit)
