"""Page-corpus jobs. Input: pages(page_id, url, html). Each job is one narrow pass over the scan.

Every function adds columns, so a job that needs only contacts never evaluates the rest, and no job
needs a shuffle: a page is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.patterns import bind, java_pattern, labels_by_signature, lookup, string_array
from ..functions.rows import exploded, held
from ..functions.text import trim_all
from ..functions.urls import FRONT_PAGE, absolute_url, domain_of, host_of, path_of, strip_www
from ..rules import domain_lists, page_rules as rules
from .ordering import first_per_key, top_k_per_key
from .people import PERSON, add_people, people_in_markup
from .structured_data import organisation_of


def with_domain(pages: DataFrame) -> DataFrame:
    return pages.withColumn("domain", domain_of(F.col("url")))


def chosen_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The pages of `ids` (page_id). Only they are extracted: filters on what is read out of them stay behind the choice."""
    return held(pages.join(ids.select("page_id"), "page_id", "left_semi"))


def _markup(pages: DataFrame) -> Column:
    """The cleaned markup, computed once when several steps share it."""
    return F.col("_markup") if "_markup" in pages.columns else H.markup_of(F.col("html"))


def with_meta(pages: DataFrame) -> DataFrame:
    """title, description (og as fallback), keywords, og_title, og_description, canonical_url."""
    marked = pages.withColumn("_markup", _markup(pages))
    tagged = marked.withColumn("_metas", H.tags(F.col("_markup"), "meta")).withColumn(
        "_rels", H.tags(F.col("_markup"), "link")
    )

    def meta(key: str, value: str) -> Column:
        return H.first_tag_value(F.col("_metas"), key, value, "content")

    og_description = meta("property", "og:description")
    return tagged.select(
        *[c for c in pages.columns],
        H.title_of(F.col("_markup")).alias("title"),
        F.coalesce(meta("name", "description"), og_description).alias("description"),
        meta("name", "keywords").alias("keywords"),
        meta("property", "og:title").alias("og_title"),
        og_description.alias("og_description"),
        H.first_tag_value(F.col("_rels"), "rel", "canonical", "href").alias("canonical_url"),
    )


def with_headings(pages: DataFrame) -> DataFrame:
    return pages.withColumn("headings", H.headings_of(_markup(pages)))


def with_links(pages: DataFrame, limit: int | None = 100) -> DataFrame:
    """links, internal_links, external_links; the first `limit` links, or all. Internal means the URL contains the domain."""
    every = F.transform(F.col("_hrefs"), lambda h: absolute_url(h, F.col("domain")))
    found = pages.withColumn("_hrefs", H.hrefs_of(_markup(pages))).withColumn(
        "links", F.slice(every, 1, limit) if limit else every
    )
    return (
        found.withColumn("internal_links", F.filter("links", lambda u: u.contains(F.col("domain"))))
        .withColumn("external_links", F.filter("links", lambda u: ~u.contains(F.col("domain"))))
        .drop("_hrefs")
    )


def with_body_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    return pages.withColumn("body_text", H.body_text_of(F.col("html"), max_chars))


def emails_in(text: Column, deny: Sequence[str] = tuple(rules.EMAIL_DENY), limit: int = 5) -> Column:
    """Distinct addresses in order. The match may only start where a run of address characters
    starts (or the last match ended), which keeps long runs without '@' linear."""
    local = rules.EMAIL_LOCAL
    pattern = rf"(?:\G|(?<!{local})){local}++@{rules.EMAIL_HOST}"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    if deny:
        found = F.filter(found, lambda e: ~F.exists(string_array(deny), lambda w: e.contains(w)))
    return F.slice(found, 1, limit)


def phones_in(text: Column, limit: int = 3) -> Column:
    pattern = r"(?=[+(\s\d])" + rules.PHONE_PATTERN  # a cheap test of the first character
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(F.array_distinct(found), 1, limit)


def with_contacts(pages: DataFrame, deny: Sequence[str] = tuple(rules.EMAIL_DENY)) -> DataFrame:
    """emails and phones over html and body_text."""
    text = F.concat(F.col("html"), F.col("body_text"))
    return pages.withColumn("emails", emails_in(text, deny)).withColumn("phones", phones_in(text))


def with_technologies(pages: DataFrame, signatures=None) -> DataFrame:
    lowered = pages.withColumn("_low", F.lower("html"))
    found = labels_by_signature(F.col("_low"), signatures or rules.TECHNOLOGY_SIGNATURES)
    return lowered.withColumn("technologies", found).drop("_low")


def _first_matching(values: str, pattern: str) -> Column:
    return F.get(F.filter(values, lambda u: u.rlike(java_pattern(pattern))), F.lit(0))


def with_social_links(pages: DataFrame, patterns=None) -> DataFrame:
    """social_links: platform -> first link of that platform."""
    entries = F.array(
        *[
            F.struct(
                F.lit(platform).alias("key"),
                _first_matching("links", pattern).alias("value"),
            )
            for platform, pattern in (patterns or rules.SOCIAL_PATTERNS).items()
        ]
    )
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return pages.withColumn("social_links", F.map_from_entries(kept))


def with_structured_data(pages: DataFrame) -> DataFrame:
    """schema_org, and page_people: its people followed by new ones from the markup, 8 at most."""
    found = pages.withColumn("schema_org", organisation_of(F.col("html")))
    known = F.coalesce(F.col("schema_org.people"), F.array().cast(f"array<{PERSON}>"))
    in_markup = people_in_markup(_markup(pages))
    return (
        found.withColumn("_known", known)
        .withColumn("_markup_people", in_markup)
        .withColumn(
            "page_people",
            F.when(F.size("_markup_people") == 0, F.col("_known")).otherwise(
                add_people(F.col("_known"), F.col("_markup_people"), 8)
            ),
        )
        .drop("_known", "_markup_people")
    )


def page_profile(pages: DataFrame) -> DataFrame:
    """Everything known about a page in one row, without the html."""
    out = with_domain(pages).withColumn("_markup", H.markup_of(F.col("html")))
    for step in (
        with_meta, with_headings, with_links, with_body_text, with_contacts, with_technologies,
        with_social_links, with_structured_data,
    ):
        out = step(out)
    return out.drop("html", "_markup")


# --- links --------------------------------------------------------------------------------------


def page_links(pages: DataFrame, limit: int | None = 100) -> DataFrame:
    """One row per link: page_id, url, domain, pos, link, internal; the first `limit` of a page, or all."""
    linked = with_links(with_domain(pages), limit)
    rows = exploded(linked, ["page_id", "url", "domain"], "links", "link", "pos")
    return rows.withColumn("internal", F.col("link").contains(F.col("domain")))


def subpage_url(kind: str) -> Column:
    """The about or services page among `internal_links`: the first exact slug, else the first link with a looser word.

    For 'services' only links on the host of the page (`url`) count. A page is one row, so nothing is shuffled.
    """
    if kind == "about":
        words, excluded, usable = rules.ABOUT_WORDS, rules.ABOUT_EXCLUDED, F.col("internal_links")
    elif kind == "services":
        words, excluded = rules.SERVICE_WORDS, rules.SERVICE_EXCLUDED
        usable = F.filter("internal_links", lambda u: host_of(u) == host_of(F.col("url")))
    else:
        raise ValueError(f"unknown subpage kind: {kind}")

    def exact(path: Column) -> Column:
        if kind == "services":
            return F.regexp_replace(path, "/$", "").isin(rules.SERVICE_SLUGS)
        return F.exists(string_array(rules.ABOUT_SLUGS), lambda s: (path == F.regexp_replace(s, "/$", "")) | path.startswith(s))

    def loose(path: Column) -> Column:
        return F.exists(string_array(words), lambda w: path.contains(w)) & ~F.exists(string_array(excluded), lambda w: path.contains(w))

    placed = F.transform(usable, lambda u: F.struct(u.alias("link"), F.lower(path_of(u)).alias("path")))
    return bind(
        placed,
        lambda p: F.coalesce(F.get(F.filter(p, lambda x: exact(x["path"])), F.lit(0))["link"], F.get(F.filter(p, lambda x: loose(x["path"])), F.lit(0))["link"]),
    )


def choose_subpage(pages: DataFrame, kind: str) -> DataFrame:
    """(page_id, url, domain, subpage_url) of the pages that have such a page."""
    linked = with_links(with_domain(pages))
    return linked.select("page_id", "url", "domain", subpage_url(kind).alias("subpage_url")).filter("subpage_url IS NOT NULL")


def homepage_outlinks(links: DataFrame, blocked: Sequence[str] = tuple(domain_lists.CANDIDATE_BLOCKLIST)) -> DataFrame:
    """External links to the front page of a host that is not blocked."""
    front = links.filter(~F.col("internal") & F.col("link").rlike(FRONT_PAGE))
    target = strip_www(host_of(F.col("link")))
    kept = front.withColumn("target", target).filter(F.col("target").isNotNull())
    return kept.filter(~F.col("target").isin(list(blocked))) if blocked else kept


def secondary_urls(
    links: DataFrame, known: DataFrame, keys: Sequence[str] = ("page_id",), collect: int = 20, cap: int = 5,
    blocked: Sequence[str] = tuple(domain_lists.CANDIDATE_BLOCKLIST),
) -> DataFrame:
    """Per key the first distinct front-page targets, less those in known(secondary_url), capped.

    The first `collect` targets are fixed before known ones are dropped, as the feature defines it.
    """
    first = (
        homepage_outlinks(links, blocked)
        .withColumn("secondary_url", F.concat(F.lit("https://"), F.col("target")))
        .groupBy(*keys, "secondary_url")
        .agg(F.min("pos").alias("pos"))
    )
    collected = top_k_per_key(first, keys, [F.col("pos"), F.col("secondary_url")], collect)
    fresh = collected.join(known.select("secondary_url").distinct(), "secondary_url", "left_anti")
    return top_k_per_key(fresh, keys, [F.col("pos"), F.col("secondary_url")], cap, "rank")


def outlink_domains(links: DataFrame) -> DataFrame:
    """Inbound sources per external target; give it all links of the pages, not the first hundred. Distinct pairs are counted after a pre-aggregation, so
    a target that a third of all pages link to still arrives as partial sums."""
    pairs = homepage_outlinks(links, []).select(F.col("domain").alias("source"), "target").distinct()
    return pairs.groupBy("target").agg(F.count(F.lit(1)).alias("sources"))


# --- captured search results --------------------------------------------------------------------

RESULT = r"""(?is)<a\b[^>]*class=["'][^"']*result__a[^"']*["'][^>]*>.*?</a>"""


def decode_redirect(href: Column) -> Column:
    """Target of a result link: direct URLs stay, redirects give their decoded uddg value."""
    direct = href.startswith("http") & ~href.contains("duckduckgo.com/l/")
    encoded = F.regexp_extract(href, r"uddg=([^&]+)", 1)
    return F.when(direct, href).when(encoded != "", F.try_url_decode(encoded))


def serp_results(
    captured: DataFrame, cap: int = 15, blocked: Sequence[str] = tuple(domain_lists.RESULT_BLOCKLIST)
) -> DataFrame:
    """captured(query_id, html) -> query_id, rank, url, title, domain; ads and non-companies out."""
    found = F.regexp_extract_all("html", F.lit(RESULT), F.lit(0))
    anchors = exploded(captured, ["query_id"], found, "tag", "pos")
    parsed = anchors.select(
        "query_id",
        "pos",
        decode_redirect(H.attribute(F.regexp_extract("tag", r"(?s)^<[^>]*>", 0), "href")).alias("url"),
        trim_all(H.text_of(F.col("tag"))).alias("title"),
    ).filter(F.col("url").isNotNull() & (F.col("title") != ""))
    results = (
        parsed.filter(~F.lower("title").contains("advertisement"))
        .withColumn("domain", domain_of(F.col("url")))
        .filter(F.col("domain").contains(".") & ~F.col("domain").isin(list(blocked)))
    )
    first = first_per_key(results, ["query_id", "domain"], [F.col("pos")])
    return top_k_per_key(first, ["query_id"], [F.col("pos")], cap, "rank").drop("pos")


TOPICS = "array<struct<Text:string,FirstURL:string,Topics:array<struct<Text:string,FirstURL:string>>>>"


def topic_titles(captured: DataFrame) -> DataFrame:
    """captured(id, topics JSON) -> id, pos, title; one level of grouped topics is flattened."""
    topics = captured.select("id", F.from_json("topics", TOPICS).alias("t"))
    urls = F.flatten(
        F.transform(
            "t",
            lambda t: F.when(
                t["Topics"].isNotNull(), F.transform(t["Topics"], lambda s: s["FirstURL"])
            ).otherwise(F.array(t["FirstURL"])),
        )
    )
    flat = exploded(topics, ["id"], urls, "first_url", "pos")
    path = F.regexp_replace(path_of(F.col("first_url")), "^/", "")
    return flat.select("id", "pos", F.try_url_decode(path).alias("title"))


def title_to_domain(title: Column, known=None) -> Column:
    """Guessed site of a page title; null for titles that name no company."""
    cleaned = F.lower(trim_all(F.regexp_replace(title, r"\s*\([^)]+\)", "")))
    slug = F.regexp_replace(cleaned, "[^a-z0-9-]", "")
    listed = cleaned.rlike(r"(?i)\d{4}|list of|comparison|history of|wikipedia")
    usable = F.length(cleaned).between(2, 40) & ~listed & (slug != "")
    guess = F.coalesce(lookup(slug, known or domain_lists.KNOWN_TITLE_DOMAINS), F.concat(slug, F.lit(".com")))
    return F.when(usable, guess)
