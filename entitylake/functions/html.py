"""HTML expressions. Pages are captured text; these read the few constructs the jobs need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import bind
from .text import squash, trim_all

COMMENTS = r"(?s)<!--.*?-->"
NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
# The character entities decoded, ampersand last.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
    ("&middot;", "·"), ("&amp;", "&"),
]
# Body containers as (opening tag, element), first present wins.
CONTENT_CLASS = r"""class=(?:["'](?:[^"']*\s)?content(?:\s[^"']*)?["'][^>]*|content(?:\s[^>]*)?)>"""
CONTENT_ID = r"""id=(?:["']content["'][^>]*|content(?:\s[^>]*)?)>"""
BODY_CONTAINERS = [
    (r"<main\b[^>]*>", "main"),
    (r"<article\b[^>]*>", "article"),
    (rf"<div\b[^>]*{CONTENT_CLASS}", "div"),
    (rf"<section\b[^>]*{CONTENT_CLASS}", "section"),
    (rf"<div\b[^>]*{CONTENT_ID}", "div"),
    (rf"<section\b[^>]*{CONTENT_ID}", "section"),
    (r"<body\b[^>]*>", "body"),
]


# What a page without a body tag still does not show.
NO_BODY = r"(?is)<head\b.*?</head>|<title\b.*?</title>|<noscript\b.*?</noscript>"


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENTS, "")


def markup_of(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, NOT_MARKUP, "")


def decode_entities(text: Column) -> Column:
    def decoded(t: Column) -> Column:
        plain = t
        for name, char in ENTITIES:
            plain = F.replace(plain, F.lit(name), F.lit(char))
        return F.when(t.contains("&"), plain).otherwise(t)

    return bind(text, decoded)


def text_of(html: Column) -> Column:
    return decode_entities(F.regexp_replace(html, r"<[^<>]*+>", ""))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag; '' when absent. Either quote, or none."""
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return decode_entities(F.regexp_replace(quoted, """^["']|["']$""", ""))


def tags(markup: Column, name: str) -> Column:
    return F.regexp_extract_all(markup, F.lit(rf"(?i)<{name}\s[^>]*>"), F.lit(0))


def first_tag_value(tag_list: Column, key: str, key_value: str, value: str) -> Column:
    """`value` attribute of the first tag whose `key` attribute equals key_value, else null."""
    pattern = rf"""(?is)\s{key}\s*=\s*(?:["']{key_value}["']|{key_value}[\s/>])"""
    hit = F.get(F.filter(tag_list, lambda t: t.rlike(pattern)), F.lit(0))
    return bind(hit, lambda tag: F.when(tag.isNotNull(), attribute(tag, value)))


def title_of(markup: Column) -> Column:
    return squash(decode_entities(F.regexp_extract(markup, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))


def headings_of(markup: Column) -> Column:
    """Headings of level 1 to 3 in document order as array<struct<level,text>>, empty ones out."""
    pattern = F.lit(r"(?is)<h([123])\b[^>]*>(.*?)</h[123]>")
    pairs = F.arrays_zip(
        F.regexp_extract_all(markup, pattern, F.lit(1)).alias("level"),
        F.regexp_extract_all(markup, pattern, F.lit(2)).alias("inner"),
    )
    typed = F.transform(
        pairs,
        lambda p: F.struct(
            p["level"].cast("int").alias("level"), trim_all(text_of(p["inner"])).alias("text")
        ),
    )
    return F.filter(typed, lambda h: h["text"] != "")


def hrefs_of(markup: Column) -> Column:
    """Link targets in document order without anchors, mail and phone links."""
    found = F.transform(tags(markup, "a"), lambda t: attribute(t, "href"))
    return F.filter(found, lambda h: (h != "") & ~h.rlike(r"^(#|mailto:|tel:)"))


def element_of(page: Column, opening: str, name: str) -> Column:
    """Inside of the first element that `opening` starts, up to its own closing tag: nested ones of the same name are counted.

    Without that tag it runs to the end of the page.
    """
    rest = F.concat(F.lit(" "), F.regexp_extract(page, rf"(?is){opening}(.*)\z", 1))
    return until_closed(F.split(rest, rf"(?i)(?=</?{name}\b)"))


def inside_of(opened: Column) -> Column:
    """Inside of the element whose opening tag the text starts with, up to its own closing tag; '' for elements that hold nothing."""
    name = F.regexp_extract(opened, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1)
    rest = F.concat(F.lit(" "), F.regexp_replace(opened, r"^<[^>]*>", ""))
    held = F.substring(until_closed(F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)")))), F.lit(2), F.length(opened))
    return F.when((opened == "") | opened.rlike(r"(?i)^<(?:br|hr|img|input|wbr)\b"), "").otherwise(held)


def until_closed(parts: Column) -> Column:
    """The parts of a text, cut before every tag of one name, up to the tag that closes what was open at its start."""

    def inside(parts: Column) -> Column:
        def step(seen: Column, part: Column) -> Column:
            turn = F.when(part.startswith("</"), -1).when(part.startswith("<"), 1).otherwise(0)
            depth = F.when(seen["depth"] == 0, 0).otherwise(seen["depth"] + turn)
            return bind(depth, lambda d: F.struct(d.alias("depth"), F.when(d > 0, seen["n"] + 1).otherwise(seen["n"]).alias("n")))

        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
        return F.array_join(F.slice(parts, 1, F.aggregate(parts, start, step, lambda x: x["n"])), "")

    return bind(parts, inside)


def body_text_of(html: Column, max_chars: int | None = None) -> Column:
    """Text of the first body container, the whole element; of all behind the head where a page names no container.

    The whole text unless a limit is given.
    """

    def region(page: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(""))
        for opening, name in BODY_CONTAINERS:
            chain = chain.when(page.rlike(f"(?i){opening}"), element_of(page, opening, name))
        return chain.otherwise(F.regexp_replace(markup_of(page), NO_BODY, ""))

    text = trim_all(text_of(bind(without_comments(html), region)))
    return F.substring(text, 1, max_chars) if max_chars else text
