"""Page-corpus queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from entitylake.functions.rows import exploded
from entitylake.functions.text import join_list
from entitylake.functions.urls import domain_of
from entitylake.operators import pages as P
from entitylake.rules import domain_lists as dl
from entitylake.rules import page_rules as pr
from entitylake.sources.tables import read_pages, spread

from . import sqltext as q
from .derived import spark_table
from .registry import checked


def par(sql):
    """Brackets around JSON arrows, which bind weaker than comparisons."""
    return re.sub(r"(\b[\w.]+->>?'[^']*')", r"(\1)", sql)


def pages(spark, sf):
    return spread(spark_table(spark, sf, "fx_pages"))


DOMAINS = f"""pg AS (SELECT page_id, url, html, {q.domain('url')} AS domain, {q.markup('html')} AS markup FROM fx_pages)"""


@checked("pages_scan", sql=f"""SELECT page_id, url, {q.domain('url')} AS domain, length(html) AS n_chars
FROM pages WHERE html <> ''""")
def pages_scan(spark, sf):
    scanned = P.with_domain(read_pages(spark, sf))
    return scanned.select("page_id", "url", "domain", F.length("html").cast("bigint").alias("n_chars"))


@checked("url_domain", "fx_pages", f"SELECT page_id, {q.domain('url')} AS domain, {q.path('url')} AS path FROM fx_pages")
def url_domain(spark, sf):
    from entitylake.functions.urls import path_of

    return pages(spark, sf).select("page_id", domain_of(F.col("url")).alias("domain"), path_of(F.col("url")).alias("path"))


def _meta(key, value, alias, tag="meta", attribute="content"):
    pattern = q.lit(rf"""(?is)\s{key}\s*=\s*(?:["']{value}["']|{value}[\s/>])""")
    hit = f"list_filter({tag}s, lambda t: regexp_matches(t, {pattern}))[1]"
    return f"{q.attr(hit, attribute)} AS {alias}"


META_SQL = f"""WITH {DOMAINS},
tg AS (SELECT *, regexp_extract_all(markup, '(?i)<meta\\s[^>]*>') AS metas, regexp_extract_all(markup, '(?i)<link\\s[^>]*>') AS links FROM pg),
mt AS (SELECT page_id, url, domain, {q.squash(q.decode("regexp_extract(markup, '(?is)<title\\b[^>]*>(.*?)</title>', 1)"))} AS title,
  {_meta('name', 'description', 'plain_description')}, {_meta('property', 'og:description', 'og_description')},
  {_meta('name', 'keywords', 'keywords')}, {_meta('property', 'og:title', 'og_title')},
  {_meta('rel', 'canonical', 'canonical_url', 'link', 'href')} FROM tg)
SELECT page_id, title, coalesce(plain_description, og_description) AS description, keywords, og_title, og_description, canonical_url FROM mt"""


@checked("page_meta", "fx_pages", META_SQL)
def page_meta(spark, sf):
    return P.with_meta(pages(spark, sf)).drop("url", "html")


HEADINGS = r"""hd AS (SELECT page_id, unnest(regexp_extract_all(markup, '(?is)<h([123])\b[^>]*>(.*?)</h[123]>', 1)) AS level,
  unnest(regexp_extract_all(markup, '(?is)<h([123])\b[^>]*>(.*?)</h[123]>', 2)) AS inner_html,
  generate_subscripts(regexp_extract_all(markup, '(?is)<h([123])\b[^>]*>(.*?)</h[123]>', 1), 1) AS seq FROM pg),
hx AS (SELECT page_id, CAST(level AS INT) AS level, seq, """ + q.trim(q.text_of("inner_html")) + """ AS text FROM hd),
headings AS (SELECT page_id, level, text, row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1 AS pos FROM hx WHERE text <> '')"""


@checked("page_headings", "fx_pages", f"WITH {DOMAINS}, {HEADINGS} SELECT page_id, pos, level, text FROM headings")
def page_headings(spark, sf):
    found = P.with_headings(pages(spark, sf))
    return exploded(found, ["page_id"], "headings", "h", "pos").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "h.level", "h.text"
    )


LINKS = rf"""an AS (SELECT page_id, url, domain, unnest(regexp_extract_all(markup, '(?i)<a\s[^>]*>')) AS tag,
  generate_subscripts(regexp_extract_all(markup, '(?i)<a\s[^>]*>'), 1) AS seq FROM pg),
hr AS (SELECT page_id, url, domain, seq, {q.attr('tag', 'href')} AS href FROM an),
ab AS (SELECT page_id, url, domain, seq, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN 'https:' || href
  WHEN href LIKE '/%' THEN 'https://' || domain || href ELSE 'https://' || domain || '/' || href END AS link
  FROM hr WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:)')),
nu AS (SELECT page_id, url, domain, row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1 AS pos,
  regexp_replace(link, '^(https?://[^/?#]+)($|[?#])', '\1/\2') AS link FROM ab),
links AS (SELECT page_id, url, domain, pos, link, contains(link, domain) AS internal FROM nu WHERE pos < 100)"""


@checked("page_links", "fx_pages", f"WITH {DOMAINS}, {LINKS} SELECT page_id, pos, link, internal FROM links")
def page_links(spark, sf):
    return P.page_links(pages(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link", "internal")


_CLASS = r"""class=(?:["'](?:[^"']*\s)?content(?:\s[^"']*)?["'][^>]*|content(?:\s[^>]*)?)>"""
_ID = r"""id=(?:["']content["'][^>]*|content(?:\s[^>]*)?)>"""
_CONTAINERS = [
    (r"<main\b[^>]*>", "main"), (r"<article\b[^>]*>", "article"), (rf"<div\b[^>]*{_CLASS}", "div"), (rf"<section\b[^>]*{_CLASS}", "section"),
    (rf"<div\b[^>]*{_ID}", "div"), (rf"<section\b[^>]*{_ID}", "section"), (r"<body\b[^>]*>", "body"),
]


def _case(made):
    return "CASE " + " ".join(f"WHEN regexp_matches(clean, {q.lit('(?i)' + o)}) THEN {made(o, n)}" for o, n in _CONTAINERS) + " END"


_MARKED = "string_split(regexp_replace(' ' || rest, '(?i)(</?' || element || '\\b)', chr(1) || '\\1', 'g'), chr(1))"
# the tags of the container's name are counted up and down; the element ends where the count is back at zero
BODY = f"""cl AS (SELECT page_id, url, domain, html, markup, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS clean FROM pg),
body_op AS (SELECT page_id, {_case(lambda o, n: q.lit(n))} AS element, {_case(lambda o, n: f"regexp_extract(clean, {q.lit(f'(?is){o}(.*)$')}, 1)")} AS rest FROM cl),
body_sg AS (SELECT page_id, unnest({_MARKED}) AS seg, generate_subscripts({_MARKED}, 1) AS i FROM body_op WHERE element IS NOT NULL),
body_dp AS (SELECT *, 1 + sum(CASE WHEN i = 1 THEN 0 WHEN starts_with(seg, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM body_sg),
body_en AS (SELECT page_id, min(i) FILTER (depth = 0) AS closing FROM body_dp GROUP BY page_id),
body_rg AS (SELECT page_id, string_agg(seg, '' ORDER BY i) FILTER (closing IS NULL OR i < closing) AS region FROM body_dp JOIN body_en USING (page_id) GROUP BY page_id),
rg AS (SELECT cl.*, coalesce(region, regexp_replace({q.markup('clean')}, '(?is)<head\\b.*?</head>|<title\\b.*?</title>|<noscript\\b.*?</noscript>', '', 'g')) AS region FROM cl LEFT JOIN body_rg USING (page_id)),
bodies AS (SELECT page_id, url, domain, html, markup, {q.trim(q.text_of('region'))} AS body_text FROM rg)"""


@checked("page_body_text", "fx_pages", f"WITH {DOMAINS}, {BODY} SELECT page_id, md5(body_text) AS body_md5, length(body_text) AS n_chars FROM bodies")
def page_body_text(spark, sf):
    found = P.with_body_text(pages(spark, sf))
    return found.select("page_id", F.md5("body_text").alias("body_md5"), F.length("body_text").cast("bigint").alias("n_chars"))


EMAIL = rf"{pr.EMAIL_LOCAL}+@{pr.EMAIL_HOST}"


def emails_sql(x, deny=True):
    kept = f"regexp_extract_all({x}, {q.lit(EMAIL)})"
    if deny:
        kept = f"list_filter({kept}, lambda e: NOT contains(e, 'example.com') AND NOT contains(e, 'test.com'))"
    return kept


CONTACTS = f"""tx AS (SELECT page_id, html || body_text AS t FROM bodies),
ct AS (SELECT page_id, {emails_sql('t')} AS em, regexp_extract_all(t, {q.lit(pr.PHONE_PATTERN)}) AS ph FROM tx)"""


@checked("page_emails", "fx_pages", f"WITH {DOMAINS}, {BODY}, {CONTACTS} SELECT page_id, {q.distinct_in_order('em', 5)} AS emails FROM ct")
def page_emails(spark, sf):
    found = P.with_contacts(P.with_body_text(pages(spark, sf)))
    return found.select("page_id", join_list(F.col("emails")).alias("emails"))


@checked("page_phones", "fx_pages", f"WITH {DOMAINS}, {BODY}, {CONTACTS} SELECT page_id, {q.distinct_in_order('ph', 3)} AS phones FROM ct")
def page_phones(spark, sf):
    found = P.with_contacts(P.with_body_text(pages(spark, sf)))
    return found.select("page_id", join_list(F.col("phones")).alias("phones"))


@checked("document_emails", sql=f"""WITH ct AS (SELECT doc_id, {emails_sql('text')} AS em, {emails_sql('text', False)} AS every FROM documents)
SELECT doc_id, {q.distinct_in_order('em', 5)} AS emails, {q.distinct_in_order('every', 5)} AS unfiltered FROM ct""")
def document_emails(spark, sf):
    docs = spread(spark_table(spark, sf, "documents"))
    return docs.select(
        "doc_id", join_list(P.emails_in(F.col("text"))).alias("emails"),
        join_list(P.emails_in(F.col("text"), deny=())).alias("unfiltered"),
    )


@checked("document_phones", sql=f"""WITH ct AS (SELECT doc_id, regexp_extract_all(text, {q.lit(pr.PHONE_PATTERN)}) AS ph FROM documents)
SELECT doc_id, {q.distinct_in_order('ph', 3)} AS phones FROM ct""")
def document_phones(spark, sf):
    return spread(spark_table(spark, sf, "documents")).select("doc_id", join_list(P.phones_in(F.col("text"))).alias("phones"))


_SIGS = q.values([(n, label, sig.lower()) for n, (label, sigs) in enumerate(pr.TECHNOLOGY_SIGNATURES.items()) for sig in sigs])
TECH = f"""sg(n, label, sig) AS (VALUES {_SIGS}),
tech AS (SELECT page_id, string_agg(label, '|' ORDER BY n) AS technologies FROM (
  SELECT DISTINCT page_id, n, label FROM fx_pages JOIN sg ON contains(lower(html), sig)) GROUP BY page_id)"""


@checked("page_technologies", "fx_pages", f"WITH {TECH} SELECT page_id, coalesce(technologies, '') AS technologies FROM fx_pages LEFT JOIN tech USING (page_id)")
def page_technologies(spark, sf):
    return P.with_technologies(pages(spark, sf)).select("page_id", join_list(F.col("technologies")).alias("technologies"))


_PLATFORMS = q.values([(p, "(?i)" + rx) for p, rx in pr.SOCIAL_PATTERNS.items()])
SOCIAL = f"""pf(platform, rx) AS (VALUES {_PLATFORMS}),
social AS (SELECT page_id, platform, min_by(link, pos) AS link FROM links JOIN pf ON regexp_matches(link, rx) GROUP BY page_id, platform)"""


@checked("page_social_links", "fx_pages", f"WITH {DOMAINS}, {LINKS}, {SOCIAL} SELECT page_id, platform, link FROM social")
def page_social_links(spark, sf):
    found = P.with_social_links(P.with_links(P.with_domain(pages(spark, sf))))
    return found.select("page_id", F.explode("social_links").alias("platform", "link"))


LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
SCHEMA = par(f"""bl AS (SELECT page_id, unnest(regexp_extract_all(html, {q.lit(LD)}, 1)) AS block,
  generate_subscripts(regexp_extract_all(html, {q.lit(LD)}, 1), 1) AS bpos FROM fx_pages),
js AS (SELECT page_id, bpos, TRY_CAST(block AS JSON) AS j FROM bl),
nd AS (SELECT page_id, bpos, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN json_type(j->'$."@graph"') = 'ARRAY' THEN CAST(j->'$."@graph"' AS JSON[]) ELSE [j] END AS nodes FROM js WHERE j IS NOT NULL),
ne AS (SELECT page_id, bpos, unnest(nodes) AS n, generate_subscripts(nodes, 1) AS npos FROM nd),
og AS (SELECT page_id, arg_min(n, bpos * 1000 + npos) AS n FROM ne WHERE regexp_matches(CAST(n->'$."@type"' AS VARCHAR), {q.i(pr.ORGANISATION_TYPES)}) GROUP BY page_id),
pp AS (SELECT page_id, n, list_concat(
  list_transform(CASE WHEN json_type(n->'$.founder') = 'ARRAY' THEN CAST(n->'$.founder' AS JSON[]) WHEN n->'$.founder' IS NULL THEN [] ELSE [n->'$.founder'] END, lambda p: struct_pack(p := p, role := 'Founder')),
  list_transform(CASE WHEN json_type(n->'$.employee') = 'ARRAY' THEN CAST(n->'$.employee' AS JSON[]) WHEN n->'$.employee' IS NULL THEN [] ELSE [n->'$.employee'] END, lambda p: struct_pack(p := p, role := 'Employee')),
  list_transform(CASE WHEN json_type(n->'$.member') = 'ARRAY' THEN CAST(n->'$.member' AS JSON[]) WHEN n->'$.member' IS NULL THEN [] ELSE [n->'$.member'] END, lambda p: struct_pack(p := p, role := 'Member'))) AS raw_people FROM og),
pf2 AS (SELECT page_id, n, list_filter(raw_people, lambda x: length(trim(x.p->>'$.name')) >= 3 AND (x.p->>'$."@type"' IS NULL OR x.p->>'$."@type"' ILIKE '%person%')) AS people FROM pp),
schema_org AS (SELECT page_id, n->>'$.name' AS org_name, n->>'$.description' AS org_description, n->>'$.foundingDate' AS founding_date,
  CASE WHEN json_type(n->'$.numberOfEmployees') = 'OBJECT' THEN coalesce(n->>'$.numberOfEmployees.value', n->>'$.numberOfEmployees.minValue') ELSE n->>'$.numberOfEmployees' END AS employees,
  nullif(CASE WHEN json_type(n->'$.address') = 'VARCHAR' THEN n->>'$.address' ELSE concat_ws(', ', n->>'$.address.addressLocality', n->>'$.address.addressRegion', n->>'$.address.addressCountry') END, '') AS address,
  array_to_string(list_transform(list_filter(CASE WHEN json_type(n->'$.sameAs') = 'ARRAY' THEN CAST(n->'$.sameAs' AS JSON[]) END, lambda u: json_type(u) = 'VARCHAR'), lambda u: u->>'$'), '|') AS same_as,
  array_to_string(list_transform(people, lambda x: trim(x.p->>'$.name') || ':' || coalesce(x.p->>'$.jobTitle', x.role)), '|') AS people,
  array_to_string(list_concat(
    list_filter(list_transform(coalesce(CAST(n->'$.hasOfferCatalog.itemListElement' AS JSON[]), []), lambda o: o->>'$.name'), lambda o: o IS NOT NULL),
    list_transform(coalesce(CAST(n->'$.knowsAbout' AS JSON[]), []), lambda k: CASE WHEN json_type(k) = 'VARCHAR' THEN k->>'$' ELSE coalesce(k->>'$.name', '') END))[1:8], '|') AS org_services FROM pf2)""")


@checked("page_schema_org", "fx_pages", f"WITH {SCHEMA} SELECT page_id, org_name, org_description, founding_date, employees, address, same_as, people, org_services FROM schema_org")
def page_schema_org(spark, sf):
    from entitylake.operators.structured_data import organisation_of

    found = pages(spark, sf).select("page_id", organisation_of(F.col("html")).alias("o")).filter("o IS NOT NULL")
    people = F.transform("o.people", lambda p: F.concat_ws(":", p["name"], p["role"]))
    return found.select(
        "page_id", F.col("o.name").alias("org_name"), F.col("o.description").alias("org_description"), "o.founding_date",
        "o.employees", "o.address", join_list(F.col("o.same_as")).alias("same_as"),
        join_list(people).alias("people"), join_list(F.col("o.services")).alias("org_services"),
    )


# --- people in markup ---------------------------------------------------------------------------

_ROLE = "(?i)" + pr.MARKUP_ROLES
_NOT_NAME = r"\b(" + "|".join(pr.NOT_A_NAME_MARKUP) + r")\b"
_CAPTION = (
    r"""(?is)<(?:figcaption\b|(?:p|div|span)\s[^>]*class=["'][^"']*(?:caption|credit|byline)[^"']*["'])"""
    r"""[^>]*>(.*?)</(?:figcaption|p|div|span)>"""
)
_PARTS = r"^([A-Z][a-zA-Z'-]+(?: [A-Z][a-zA-Z'-]+)+)\s*[|,]\s*([^|,\n]{3,60})"
_HS = r"(?is)<h[34]\b[^>]*>(.*?)</h[34]>\s*<[a-z0-9]+\b[^>]*>(.*?)</"
_BLOCK = r"(?is)<(?:p|li)\b[^>]*>(.*?)</(?:p|li)>"
_BOLD = r"(?is)<(?:strong|b)(?:\s[^>]*)?>(.*?)</(?:strong|b)>"


def _exploded(source, column, pattern, groups):
    cols = ", ".join(f"unnest(regexp_extract_all({column}, {q.lit(pattern)}, {g})) AS g{g}" for g in groups)
    return f"SELECT page_id, {cols}, generate_subscripts(regexp_extract_all({column}, {q.lit(pattern)}, {groups[0]}), 1) AS seq FROM {source}"


MARKUP_PEOPLE = f"""s1 AS (SELECT page_id, regexp_extract(markup, '(?is)<div class="our team-member x">(.*?)</div></div>', 1) AS a, regexp_extract(markup, '(?is)<li class="staff-card">(.*?)</li>', 1) AS b FROM pg),
p1 AS (SELECT page_id, 1 AS strategy, 1 AS seq, regexp_extract(a, '<h5>(.*?)</h5>', 1) AS name, regexp_extract(a, 'job-title">(.*?)<', 1) AS role FROM s1 WHERE a <> ''
  UNION ALL SELECT page_id, 1, 2, {q.text_of("regexp_extract(b, 'full-name\">(.*?)</p>', 1)")}, regexp_extract(b, '</p><p>(.*?)</p>', 1) FROM s1 WHERE b <> ''),
s2 AS ({_exploded('pg', 'markup', _HS, (1, 2))}),
p2 AS (SELECT page_id, 2 AS strategy, seq, {q.text_of('g1')} AS name, {q.text_of('g2')} AS role FROM s2),
s3 AS ({_exploded('pg', 'markup', _BLOCK, (1,))}),
l3 AS (SELECT page_id, seq, {q.trim(q.text_of(f"regexp_extract(g1, {q.lit(_BOLD)}, 1)"))} AS name, {q.trim(q.text_of('g1'))} AS line FROM s3 WHERE regexp_matches(g1, {q.lit(_BOLD)})),
r3 AS (SELECT page_id, seq, name, {q.trim("CASE WHEN instr(line, name) > 0 THEN substr(line, 1, instr(line, name) - 1) || substr(line, instr(line, name) + length(name)) ELSE line END")} AS rest FROM l3),
p3 AS (SELECT page_id, 3 AS strategy, seq, name, regexp_extract(rest, {q.lit(_ROLE)}, 0) AS role FROM r3 WHERE length(rest) <= 120),
s4 AS ({_exploded('pg', 'markup', _CAPTION, (1,))}),
c4 AS (SELECT page_id, seq, {q.trim(q.text_of('g1'))} AS c FROM s4),
p4 AS (SELECT page_id, 4 AS strategy, seq, regexp_extract(c, {q.lit(_PARTS)}, 1) AS name, {q.trim(f"regexp_extract(c, {q.lit(_PARTS)}, 2)")} AS role FROM c4),
pa AS (SELECT page_id, strategy, seq, {q.squash('name')} AS name, {q.squash('role')} AS role FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) WHERE regexp_matches(role, {q.lit(_ROLE)})),
pk AS (SELECT * FROM pa WHERE length(name) BETWEEN 4 AND 55 AND length(role) BETWEEN 3 AND 80 AND regexp_matches(name, '^[A-Z][a-z]') AND contains(name, ' ') AND NOT regexp_matches(name, {q.lit(_NOT_NAME)})),
ps AS (SELECT * FROM pk WHERE strategy IN (1, 4) OR NOT EXISTS (SELECT 1 FROM pk o WHERE o.page_id = pk.page_id AND o.strategy < pk.strategy)),
pd AS (SELECT page_id, strategy, seq, name, role, row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY strategy, seq) AS rn FROM ps),
markup_people AS (SELECT page_id, name, role, row_number() OVER (PARTITION BY page_id ORDER BY strategy, seq) AS pos FROM pd WHERE rn = 1)"""


@checked("page_people_markup", "fx_pages", f"WITH {DOMAINS}, {MARKUP_PEOPLE} SELECT page_id, pos, name, role FROM markup_people WHERE pos <= 8")
def page_people_markup(spark, sf):
    from entitylake.functions.html import markup_of
    from entitylake.operators.people import people_in_markup

    found = exploded(pages(spark, sf), ["page_id"], people_in_markup(markup_of(F.col("html"))), "p", "i")
    return found.select("page_id", (F.col("i") + 1).cast("bigint").alias("pos"), "p.name", "p.role")


# --- links --------------------------------------------------------------------------------------

_ABOUT_EXACT = " OR ".join(f"p = {q.lit(s.rstrip('/'))} OR starts_with(p, {q.lit(s)})" for s in pr.ABOUT_SLUGS)


def _loose(words, excluded):
    return "(" + " OR ".join(f"contains(p, {q.lit(w)})" for w in words) + ") AND NOT (" + " OR ".join(f"contains(p, {q.lit(w)})" for w in excluded) + ")"


SUBPAGES = f"""lp AS (SELECT *, lower({q.path('link')}) AS p FROM links WHERE internal),
ra AS (SELECT page_id, url, domain, pos, link, CASE WHEN {_ABOUT_EXACT} THEN 1 WHEN {_loose(pr.ABOUT_WORDS, pr.ABOUT_EXCLUDED)} THEN 2 END AS prio FROM lp),
rs AS (SELECT page_id, url, domain, pos, link, CASE WHEN regexp_replace(p, '/$', '') IN {q.inlist(pr.SERVICE_SLUGS)} THEN 1 WHEN {_loose(pr.SERVICE_WORDS, pr.SERVICE_EXCLUDED)} THEN 2 END AS prio
  FROM lp WHERE {q.host('link')} = {q.host('url')}),
subpages AS (SELECT page_id, 'about' AS kind, arg_min(link, prio * 1000 + pos) AS subpage_url FROM ra WHERE prio IS NOT NULL GROUP BY page_id
  UNION ALL SELECT page_id, 'services' AS kind, arg_min(link, prio * 1000 + pos) AS subpage_url FROM rs WHERE prio IS NOT NULL GROUP BY page_id)"""


@checked("subpage_choice", "fx_pages", f"WITH {DOMAINS}, {LINKS}, {SUBPAGES} SELECT page_id, kind, subpage_url FROM subpages")
def subpage_choice(spark, sf):
    linked = P.with_links(P.with_domain(pages(spark, sf)))
    both = F.array(*[F.struct(F.lit(k).alias("kind"), P.subpage_url(k).alias("subpage_url")) for k in ("about", "services")])
    return exploded(linked, ["page_id"], both, "s").select("page_id", "s.*").filter("subpage_url IS NOT NULL")


_CB = q.inlist(dl.CANDIDATE_BLOCKLIST)
OUTLINKS = f"""ou AS (SELECT page_id, domain, pos, regexp_replace({q.host('link')}, '^www\\.', '') AS target FROM links WHERE NOT internal AND {q.host('link')} IS NOT NULL AND {q.path('link')} = '/')"""
SECONDARY = f"""se AS (SELECT page_id, 'https://' || target AS secondary_url, min(pos) AS pos FROM ou WHERE target NOT IN {_CB} GROUP BY ALL),
sc AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, secondary_url) AS r FROM se),
sf AS (SELECT * FROM sc WHERE r <= 20 AND secondary_url NOT IN (SELECT 'https://' || domain FROM fx_seeds)),
secondary AS (SELECT page_id, secondary_url, row_number() OVER (PARTITION BY page_id ORDER BY pos, secondary_url) AS rank FROM sf)"""


@checked("secondary_urls", "fx_pages fx_seeds", f"WITH {DOMAINS}, {LINKS}, {OUTLINKS}, {SECONDARY} SELECT page_id, secondary_url, rank FROM secondary WHERE rank <= 5")
def secondary_urls(spark, sf):
    known = spark_table(spark, sf, "fx_seeds").select(F.concat(F.lit("https://"), "domain").alias("secondary_url"))
    found = P.secondary_urls(P.page_links(pages(spark, sf)), known)
    return found.select("page_id", "secondary_url", F.col("rank").cast("bigint").alias("rank"))


@checked("outlink_domains", "fx_pages", f"WITH {DOMAINS}, {LINKS.replace(' WHERE pos < 100', '')}, {OUTLINKS} SELECT target, count(DISTINCT domain) AS sources FROM ou GROUP BY target")
def outlink_domains(spark, sf):
    return P.outlink_domains(P.page_links(pages(spark, sf), limit=None))


# --- captured results ---------------------------------------------------------------------------

_RESULT = r"""(?is)<a\b[^>]*class=["'][^"']*result__a[^"']*["'][^>]*>.*?</a>"""
SERP = f"""ra AS (SELECT query_id, unnest(regexp_extract_all(html, {q.lit(_RESULT)})) AS tag, generate_subscripts(regexp_extract_all(html, {q.lit(_RESULT)}), 1) AS seq FROM fx_serp),
rh AS (SELECT query_id, seq, {q.attr("regexp_extract(tag, '(?s)^<[^>]*>', 0)", 'href')} AS href, {q.trim(q.text_of('tag'))} AS title FROM ra),
ru AS (SELECT query_id, seq, title, CASE WHEN starts_with(href, 'http') AND NOT contains(href, 'duckduckgo.com/l/') THEN href
  ELSE url_decode(nullif(regexp_extract(href, 'uddg=([^&]+)', 1), '')) END AS url FROM rh),
rd AS (SELECT query_id, seq, title, url, {q.domain('url')} AS domain FROM ru WHERE url IS NOT NULL AND title <> '' AND NOT contains(lower(title), 'advertisement')),
rf AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY seq) AS dr FROM rd WHERE contains(domain, '.') AND domain NOT IN {q.inlist(dl.RESULT_BLOCKLIST)}),
serp AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS rank, url, title, domain FROM rf WHERE dr = 1)"""


@checked("serp_results", "fx_serp", f"WITH {SERP} SELECT query_id, rank, url, title, domain FROM serp WHERE rank <= 15")
def serp_results(spark, sf):
    found = P.serp_results(spark_table(spark, sf, "fx_serp"))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "url", "title", "domain")


def title_sql(title):
    cleaned = f"lower({q.trim(f'''regexp_replace({title}, '\\s*\\([^)]+\\)', '', 'g')''')})"
    slug = f"regexp_replace({cleaned}, '[^a-z0-9-]', '', 'g')"
    known = " ".join(f"WHEN {slug} = {q.lit(k)} THEN {q.lit(v)}" for k, v in dl.KNOWN_TITLE_DOMAINS.items())
    return (f"CASE WHEN length({cleaned}) NOT BETWEEN 2 AND 40 OR regexp_matches({cleaned}, '\\d{{4}}|list of|comparison|history of|wikipedia') "
            f"OR {slug} = '' THEN NULL {known} ELSE {slug} || '.com' END")


@checked("title_domains", "fx_titles fx_topics", par(f"""
WITH tp AS (SELECT id, unnest(CAST(CAST(topics AS JSON) AS JSON[])) AS t, generate_subscripts(CAST(CAST(topics AS JSON) AS JSON[]), 1) AS a FROM fx_topics),
fl AS (SELECT id, a * 100 AS o, t->>'$.FirstURL' AS u FROM tp WHERE t->'$.Topics' IS NULL
  UNION ALL SELECT id, a * 100 + i AS o, s->>'$.FirstURL' AS u FROM (SELECT id, a, unnest(CAST(t->'$.Topics' AS JSON[])) AS s, generate_subscripts(CAST(t->'$.Topics' AS JSON[]), 1) AS i FROM tp WHERE t->'$.Topics' IS NOT NULL)),
ti AS (SELECT id, 'topic' AS kind, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS pos, url_decode(regexp_replace({q.path('u')}, '^/', '')) AS title FROM fl
  UNION ALL SELECT id, 'title' AS kind, 0 AS pos, title FROM fx_titles)
SELECT id, kind, pos, title, {title_sql('title')} AS domain FROM ti"""))
def title_domains(spark, sf):
    topics = P.topic_titles(spark_table(spark, sf, "fx_topics")).select("id", F.lit("topic").alias("kind"), "pos", "title")
    titles = spark_table(spark, sf, "fx_titles").select("id", F.lit("title").alias("kind"), F.lit(0).alias("pos"), "title")
    both = topics.union(titles)
    return both.select("id", "kind", F.col("pos").cast("bigint").alias("pos"), "title", P.title_to_domain(F.col("title")).alias("domain"))
