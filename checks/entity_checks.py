"""Entity extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylake.functions.rows import exploded
from entitylake.functions.text import join_list, split_list
from entitylake.operators import entities as E
from entitylake.operators import matching as M
from entitylake.operators import pages as P
from entitylake.operators import people as PP
from entitylake.operators import subpages as S
from entitylake.rules import page_rules as pr
from entitylake.session import stored
from entitylake.sources.tables import spread

from . import page_checks as pc
from . import sqltext as q
from .derived import spark_table
from .registry import checked


def docs(spark, sf):
    return spread(spark_table(spark, sf, "documents"))


def profiled(spark, sf):
    return P.page_profile(pc.pages(spark, sf))


def show_people(col):
    return join_list(F.transform(col, lambda p: F.concat_ws(":", p["name"], p["role"])))


def services_sql(text, limit=8):
    """text must be lower case"""
    pairs = q.items(pr.SERVICE_TERMS)
    return q.short_list(f"list_filter({pairs}, lambda t: contains({text}, lower(t)))", limit)


@checked("service_terms", sql=f"SELECT doc_id, {services_sql('lower(text)')} AS services FROM documents")
def service_terms(spark, sf):
    return docs(spark, sf).select("doc_id", join_list(E.service_terms(F.col("text"))).alias("services"))


_T = "|".join(pr.EXECUTIVE_TITLES)
_NAME = r"([A-Z][a-z]+(?: [A-Z][a-z]+)+)"
_P1 = rf"({_T})\s*[:\-–]\s*{_NAME}"
_P2 = rf"{_NAME}[,\s]+(?:\(|)({_T})(?:\)|)"
_P3 = rf"(?i){_NAME}\s+is\s+(?:the\s+)?({_T})"
_NOT = r"\b(" + "|".join(pr.NOT_A_NAME_TEXT) + r")\b"
_SHORT = " ".join(f"WHEN {q.lit(k)} THEN {q.lit(v)}" for k, v in pr.SHORT_TITLES.items())


def text_people_sql(source, key, text, limit=6):
    def one(n, pattern, name, role):
        rx = q.lit(pattern)
        return (f"SELECT {key}, {n} AS strategy, unnest(regexp_extract_all({text}, {rx}, {name})) AS name, unnest(regexp_extract_all({text}, {rx}, {role})) AS role, "
                f"generate_subscripts(regexp_extract_all({text}, {rx}, 0), 1) AS seq FROM {source}")

    return f"""tp1 AS ({one(1, _P1, 2, 1)} UNION ALL {one(2, _P2, 1, 2)} UNION ALL {one(3, _P3, 1, 2)}),
tp2 AS (SELECT {key}, strategy, seq, name, CASE role {_SHORT} ELSE role END AS role, row_number() OVER (PARTITION BY {key}, lower(name) ORDER BY strategy, seq) AS rn
  FROM tp1 WHERE length(name) >= 4 AND NOT regexp_matches(name, {q.lit(_NOT)})),
tp3 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY strategy, seq) AS pos FROM tp2 WHERE rn = 1),
text_people AS (SELECT {key}, string_agg(name || ':' || role, '|' ORDER BY pos) AS people FROM tp3 WHERE pos <= {limit} GROUP BY {key})"""


@checked("text_people", "fx_pages", f"""WITH {pc.DOMAINS}, {pc.BODY}, al AS (SELECT 'page' AS kind, page_id AS id, body_text AS text FROM bodies UNION ALL SELECT 'document', doc_id, text FROM documents),
ak AS (SELECT kind || CAST(id AS VARCHAR) AS k, text FROM al), {text_people_sql('ak', 'k', 'text')}
SELECT k, people FROM text_people""")
def text_people(spark, sf):
    body = P.with_body_text(pc.pages(spark, sf))
    both = body.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("k"), F.col("body_text").alias("text")).union(
        docs(spark, sf).select(F.concat(F.lit("document"), F.col("doc_id").cast("string")), "text")
    )
    return both.select("k", show_people(PP.people_in_text(F.col("text"))).alias("people")).filter("people <> ''")


def locations_sql(text):
    return q.distinct_in_order("list_concat(" + ", ".join(f"regexp_extract_all({text}, {q.lit(p)}, 1)" for p in pr.LOCATION_PATTERNS) + ")", 3)


def rating_sql(text):
    v = f"TRY_CAST({q.group(text, pr.RATING_PATTERN)} AS DOUBLE)"
    return f"CASE WHEN {v} <= 5 THEN {v} END"


def pricing_sql(text):
    return "coalesce(" + ", ".join(q.group(text, p, 0) for p in pr.PRICE_PATTERNS) + ")"


TEXTS = f"""al AS (SELECT 'page' || CAST(page_id AS VARCHAR) AS k, body_text AS text FROM bodies UNION ALL SELECT 'document' || CAST(doc_id AS VARCHAR), text FROM documents)"""


def all_texts(spark, sf):
    body = P.with_body_text(pc.pages(spark, sf))
    return body.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("k"), F.col("body_text").alias("text")).union(
        docs(spark, sf).select(F.concat(F.lit("document"), F.col("doc_id").cast("string")), "text")
    )


@checked("text_locations", "fx_pages", f"WITH {pc.DOMAINS}, {pc.BODY}, {TEXTS} SELECT k, {locations_sql('text')} AS locations FROM al")
def text_locations(spark, sf):
    return all_texts(spark, sf).select("k", join_list(E.text_locations(F.col("text"))).alias("locations"))


@checked("text_rating", "fx_pages", f"WITH {pc.DOMAINS}, {pc.BODY}, {TEXTS} SELECT k, {rating_sql('text')} AS rating FROM al")
def text_rating(spark, sf):
    return all_texts(spark, sf).select("k", E.text_rating(F.col("text")).alias("rating"))


@checked("text_pricing", "fx_pages", f"WITH {pc.DOMAINS}, {pc.BODY}, {TEXTS} SELECT k, {pricing_sql('text')} AS pricing FROM al")
def text_pricing(spark, sf):
    return all_texts(spark, sf).select("k", E.text_pricing(F.col("text")).alias("pricing"))


# --- assembled records --------------------------------------------------------------------------


def tagline(x):
    t = q.trim(x)
    return rf"(len(string_split_regex({t}, '\s+')) >= 6 OR regexp_matches({t}, {q.lit('(?i)^(?:' + pr.TAGLINE_STARTERS + ')')}))"


def stem(x):
    return q.trim(rf"regexp_replace({x}, '\s*[-|–]\s*.+$', '')")


def titled(x):
    return f"CASE WHEN {x} <> '' AND length({stem(x)}) > 1 AND NOT {tagline(stem(x))} THEN {stem(x)} END"


BRAND = "array_to_string(list_transform(string_split(replace(split_part(domain, '.', 1), '-', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"

_META = pc.META_SQL[len(f"WITH {pc.DOMAINS},\n"):].rsplit("SELECT page_id, title", 1)[0].rstrip()
PROFILE = f"""{pc.DOMAINS},
{_META},
{pc.HEADINGS},
{pc.LINKS},
{pc.SOCIAL},
{pc.BODY},
{pc.CONTACTS},
{pc.TECH},
{pc.SCHEMA},
{pc.MARKUP_PEOPLE},
{text_people_sql('bodies', 'page_id', 'body_text')},
hg AS (SELECT page_id, arg_min(text, pos) FILTER (level = 1) AS h1, arg_min(text, pos) FILTER (level = 2 AND length(text) < 40 AND NOT {tagline('text')}) AS h2,
  string_agg(text, ' ' ORDER BY pos) AS htext FROM headings GROUP BY page_id),
kp AS (SELECT page_id, strategy, pos, who, lower(split_part(who, ':', 1)) AS low FROM (
  SELECT page_id, 1 AS strategy, unnest(string_split(people, '|')) AS who, generate_subscripts(string_split(people, '|'), 1) AS pos FROM schema_org WHERE people <> ''
  UNION ALL SELECT page_id, 2, name || ':' || role, pos FROM markup_people WHERE pos <= 8)),
kq AS (SELECT page_id, who, row_number() OVER (PARTITION BY page_id ORDER BY strategy, pos) AS pos FROM kp k
  WHERE strategy = 1 OR NOT EXISTS (SELECT 1 FROM kp o WHERE o.page_id = k.page_id AND o.strategy = 1 AND o.low = k.low)),
page_people AS (SELECT page_id, string_agg(who, '|' ORDER BY pos) AS people FROM kq WHERE pos <= 6 GROUP BY page_id),
pr1 AS (SELECT b.page_id, b.url, b.domain, b.html, b.body_text, title, coalesce(plain_description, og_description) AS description, og_title, og_description, h1, h2, coalesce(htext, '') AS htext,
  s.org_name, s.org_description, s.address, s.same_as, s.org_services, coalesce(technologies, '') AS technologies,
  {q.distinct_in_order('em', 5)} AS emails, {q.distinct_in_order('ph', 3)} AS phones, ph[1] AS phone,
  coalesce(pp0.people, tp0.people, '') AS founders,
  (SELECT link FROM social x WHERE x.page_id = b.page_id AND platform = 'linkedin') AS s_linkedin, (SELECT link FROM social x WHERE x.page_id = b.page_id AND platform = 'twitter') AS s_twitter
  FROM bodies b JOIN mt USING (page_id) JOIN ct USING (page_id) LEFT JOIN hg USING (page_id) LEFT JOIN schema_org s USING (page_id) LEFT JOIN tech USING (page_id)
  LEFT JOIN page_people pp0 USING (page_id) LEFT JOIN text_people tp0 USING (page_id)),
pr2 AS (SELECT *, coalesce({titled('og_title')}, CASE WHEN length(h1) < 50 AND NOT {tagline('h1')} THEN h1 END, {titled('title')}, h2, {BRAND}) AS heuristic_name,
  coalesce(CASE WHEN length(coalesce(description, og_description)) > 20 THEN coalesce(description, og_description) END,
    list_filter(list_transform(string_split_regex(body_text, '[.!?]+'), lambda x: {q.trim('x')}), lambda x: length(x) > 50)[1]) AS heuristic_description,
  {services_sql("lower(body_text || ' ' || htext)")} AS scanned FROM pr1),
entities AS (SELECT page_id, url, domain, coalesce(org_name, heuristic_name) AS name, coalesce(org_description, heuristic_description) AS description,
  CASE WHEN coalesce(org_services, '') <> '' THEN org_services ELSE scanned END AS services, founders,
  coalesce(list_filter(string_split(same_as, '|'), lambda u: regexp_matches(u, '(?i)linkedin\\.com'))[1], s_linkedin) AS linkedin,
  coalesce(list_filter(string_split(same_as, '|'), lambda u: regexp_matches(u, '(?i)twitter\\.com|x\\.com'))[1], s_twitter) AS twitter,
  technologies, coalesce(address, {locations_sql('body_text')}) AS locations, emails, phones, title AS meta_title, description AS meta_description, body_text FROM pr2)"""


@checked("company_name", "fx_pages", f"WITH {PROFILE} SELECT page_id, heuristic_name AS name FROM pr2")
def company_name(spark, sf):
    page = P.with_headings(P.with_meta(P.with_domain(pc.pages(spark, sf))))
    return page.select("page_id", E.company_name().alias("name"))


@checked("company_description", "fx_pages", f"WITH {PROFILE} SELECT page_id, heuristic_description AS description FROM pr2")
def company_description(spark, sf):
    page = P.with_body_text(P.with_meta(pc.pages(spark, sf)))
    return page.select("page_id", E.company_description().alias("description"))


_COLUMNS = "page_id, domain, name, description, services, founders, linkedin, twitter, technologies, locations, emails, phones, meta_title, meta_description"


def flat(entities):
    lists = {c: join_list(F.col(c)) for c in ("services", "technologies", "locations", "emails", "phones")}
    return entities.withColumns(lists).withColumn("founders", show_people(F.col("founders")))


@checked("company_entities", "fx_pages", f"WITH {PROFILE} SELECT {_COLUMNS} FROM entities")
def company_entities(spark, sf):
    return flat(E.company_entities(profiled(spark, sf))).select(*_COLUMNS.split(", "))


@checked("local_business_entities", "fx_pages", f"""WITH {PROFILE} SELECT page_id, domain, heuristic_name AS name,
  coalesce(nullif(split_part({locations_sql('body_text')}, '|', 1), ''), 'Unknown') AS location, scanned AS services, {rating_sql('body_text')} AS rating, phone, url AS website FROM pr2""")
def local_business_entities(spark, sf):
    return E.local_business_entities(profiled(spark, sf)).withColumn("services", join_list(F.col("services")))


def category_sql(text):
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, {q.lit(w)})" for w in words) + f" THEN {q.lit(label)}" for words, label in pr.PRODUCT_CATEGORIES)
    return f"CASE {whens} ELSE {q.lit(pr.DEFAULT_PRODUCT_CATEGORY)} END"


@checked("product_entities", "fx_pages", f"""WITH {PROFILE} SELECT page_id, domain, heuristic_name AS name, {category_sql("lower(body_text || ' ' || title)")} AS category, {BRAND} AS brand,
  {pricing_sql('body_text')} AS pricing, url AS source, heuristic_description AS description FROM pr2""")
def product_entities(spark, sf):
    return E.product_entities(profiled(spark, sf))


# --- signals ------------------------------------------------------------------------------------

_ENG = ", ".join(f"regexp_matches(body_text, {q.i(p)}) AS {n}" for n, p in pr.ENGAGEMENT_PATTERNS.items())
ENGAGED = f"eng AS (SELECT page_id, domain, body_text, {_ENG} FROM bodies)"


@checked("engagement_flags", "fx_pages", f"WITH {pc.DOMAINS}, {pc.BODY}, {ENGAGED} SELECT page_id, {', '.join(pr.ENGAGEMENT_PATTERNS)} FROM eng")
def engagement_flags(spark, sf):
    found = E.with_engagement(P.with_body_text(pc.pages(spark, sf)))
    return found.select("page_id", *pr.ENGAGEMENT_PATTERNS)


def _rx(p):
    return f"regexp_matches(body_text, {q.i(p)})"


MATCHER_MODEL = f"CASE WHEN {q.hits('body_text', pr.MATCHER_TOOL_SIGNALS)} >= 2 THEN 'tool' WHEN {_rx(pr.MATCHER_AGENCY)} THEN 'agency' WHEN {_rx(pr.BRAND_SIGNAL)} THEN 'brand' ELSE 'unknown' END"
PROFILE_MODEL = f"""CASE WHEN {q.hits('body_text', pr.PROFILE_TOOL_SIGNALS)} >= 2 THEN 'tool'
  WHEN 2 * CAST(has_case_studies AS INT) + CAST(has_team_page AS INT) + CAST(has_testimonials AS INT) + {q.hits('body_text', pr.PROFILE_AGENCY_SIGNALS)} >= 3 THEN 'agency'
  WHEN {_rx(pr.PLATFORM_SIGNAL)} THEN 'platform' WHEN {_rx(pr.BRAND_SIGNAL)} THEN 'brand' ELSE 'unknown' END"""


@checked("business_model", "fx_pages", f"WITH {pc.DOMAINS}, {pc.BODY}, {ENGAGED} SELECT page_id, {MATCHER_MODEL} AS matcher_model, {PROFILE_MODEL} AS profile_model FROM eng")
def business_model(spark, sf):
    found = E.with_engagement(P.with_body_text(pc.pages(spark, sf)))
    text = F.col("body_text")
    return found.select("page_id", E.matcher_business_model(text).alias("matcher_model"), E.profile_business_model(text).alias("profile_model"))


_W = "regexp_replace(split_part(lower(service), ' ', 1), '[^a-z0-9]', '', 'g')"
PROMINENCE = f"""sv AS (SELECT page_id, body_text, lower(coalesce(description, '') || ' ' || coalesce(title, '')) AS meta,
  lower(array_to_string(list_transform(regexp_extract_all(html, '(?i)<h[12][^>]*>([^<]+)</h[12]>', 1), lambda h: {q.trim('h')}), ' ')) AS heads,
  unnest(string_split(scanned, '|')) AS service, generate_subscripts(string_split(scanned, '|'), 1) AS pos FROM pr2 WHERE scanned <> ''),
sw AS (SELECT *, {_W} AS w, CASE WHEN {_W} = '' THEN length(body_text) ELSE (length(lower(body_text)) - length(replace(lower(body_text), {_W}, ''))) / length({_W}) END AS n FROM sv),
sp AS (SELECT *, contains(heads, w) OR contains(meta, w) OR (contains(lower(substr(body_text, 1, 1400)), w) AND n >= 2) OR n >= 4 AS p FROM sw),
prominence AS (SELECT page_id, service, pos - 1 AS pos, p OR (NOT bool_or(p) OVER (PARTITION BY page_id) AND pos <= 3) AS is_primary FROM sp)"""


def prominent(spark, sf):
    raw = pc.pages(spark, sf)
    page = P.with_headings(P.with_body_text(P.with_meta(P.with_domain(raw)))).withColumn("services", E.page_services())
    return E.service_prominence(page)


@checked("service_prominence", "fx_pages", f"WITH {PROFILE}, {PROMINENCE} SELECT page_id, pos, service, is_primary FROM prominence")
def service_prominence(spark, sf):
    found = exploded(prominent(spark, sf), ["page_id"], "service_roles", "r", "pos")
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "r.service", F.col("r.primary").alias("is_primary"))


# --- subpages -----------------------------------------------------------------------------------

FIRST_URL = "fu AS (SELECT url AS subpage_url, min(page_id) AS sub_id FROM entities GROUP BY url)"


ABOUT = f"""apb AS (SELECT e.page_id, e.founders AS own, a.founders AS about FROM entities e LEFT JOIN (SELECT s.page_id, x.founders FROM subpages s JOIN fu USING (subpage_url) JOIN entities x ON x.page_id = sub_id WHERE kind = 'about') a
  ON a.page_id = e.page_id AND len({q.as_list('e.founders')}) < 2),
au AS (SELECT page_id, 1 AS s, unnest({q.as_list('own')}) AS who, generate_subscripts({q.as_list('own')}, 1) AS pos FROM apb UNION ALL
  SELECT page_id, 2 AS s, unnest({q.as_list('about')}) AS who, generate_subscripts({q.as_list('about')}, 1) AS pos FROM apb),
ad AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(split_part(who, ':', 1)) ORDER BY s, pos) AS rn FROM au),
ar AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s, pos) AS r FROM ad WHERE rn = 1),
about_people AS (SELECT apb.page_id, coalesce(string_agg(who, '|' ORDER BY r), '') AS founders FROM apb LEFT JOIN ar ON apb.page_id = ar.page_id AND r <= 8 GROUP BY apb.page_id)"""


@checked("about_page_people", "fx_pages", f"WITH {PROFILE}, {pc.SUBPAGES}, {FIRST_URL}, {ABOUT} SELECT page_id, founders FROM about_people")
def about_page_people(spark, sf):
    profile = profiled(spark, sf).withColumn("subpage_url", P.subpage_url("about"))
    entities = stored(E.company_entities(profile, "subpage_url"))
    merged = S.merge_about_people(entities, entities)
    return merged.select("page_id", show_people(F.col("founders")).alias("founders"))


@checked("services_page_text", "fx_pages", f"""WITH {pc.DOMAINS}, {pc.LINKS}, {pc.BODY}, {pc.SUBPAGES},
fu AS (SELECT url AS subpage_url, arg_min(body_text, page_id) AS st FROM bodies GROUP BY url)
SELECT b.page_id, md5(CASE WHEN st <> '' THEN st || chr(10) || chr(10) || body_text ELSE body_text END) AS text_md5
FROM bodies b LEFT JOIN (SELECT * FROM subpages WHERE kind = 'services') s USING (page_id) LEFT JOIN fu USING (subpage_url)""")
def services_page_text(spark, sf):
    raw = pc.pages(spark, sf)
    chosen = P.choose_subpage(raw, "services")
    found = S.with_services_text(P.with_body_text(raw).select("page_id", "url", "body_text"), chosen)
    return found.select("page_id", F.md5("body_text").alias("text_md5"))


# --- profiles -----------------------------------------------------------------------------------


def page_profiles(spark, sf):
    from entitylake.plans.competitors import page_profiles

    return page_profiles(pc.pages(spark, sf))


def stored_profiles(spark, sf):
    stored = spark_table(spark, sf, "fx_profiles")
    return stored.withColumns({c: split_list(F.col(c)) for c in ("primary_services", "secondary_services")})


PAGE_PROFILES = f"""{PROFILE}, {PROMINENCE}, {ENGAGED},
hp AS (SELECT domain, min(page_id) AS page_id FROM pg GROUP BY domain),
page_profiles AS (SELECT hp.domain, heuristic_name AS name, heuristic_description AS description, technologies AS tech_stack, {PROFILE_MODEL.replace('body_text', 'eng.body_text')} AS business_model,
  coalesce((SELECT string_agg(service, '|' ORDER BY pos) FROM prominence x WHERE x.page_id = hp.page_id AND is_primary), '') AS prim,
  coalesce((SELECT string_agg(service, '|' ORDER BY pos) FROM prominence x WHERE x.page_id = hp.page_id AND NOT is_primary), '') AS sec
  FROM hp JOIN pr2 ON pr2.page_id = hp.page_id JOIN eng ON eng.page_id = hp.page_id)"""


@checked("profile_merge", "fx_pages fx_profiles", f"""WITH {PAGE_PROFILES},
mg AS (SELECT coalesce(s.domain, p.domain) AS domain, coalesce(s.name, p.name) AS name, coalesce(s.description, p.description, '') AS description, s.industry,
  CASE WHEN coalesce(s.primary_services, '') <> '' THEN s.primary_services ELSE coalesce(p.prim, '') END AS primary_services,
  list_concat({q.as_list('s.secondary_services')}, {q.as_list('p.sec')}) AS sec, coalesce(p.tech_stack, '') AS tech_stack, coalesce(s.business_model, p.business_model, 'unknown') AS business_model
  FROM fx_profiles s FULL OUTER JOIN page_profiles p ON s.domain = p.domain),
mh AS (SELECT *, list_filter(sec, lambda x: NOT list_contains(string_split(primary_services, '|'), x)) AS sx FROM mg)
SELECT domain, name, description, industry, primary_services, {q.distinct_in_order('sx', 1000)} AS secondary_services, tech_stack, business_model FROM mh""")
def profile_merge(spark, sf):
    merged = M.merge_profiles(stored_profiles(spark, sf), page_profiles(spark, sf))
    return merged.withColumns({c: join_list(F.col(c)) for c in ("primary_services", "secondary_services", "tech_stack")})
