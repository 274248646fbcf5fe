"""Query-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylake.functions.patterns import first_label
from entitylake.functions.text import join_list, split_list
from entitylake.operators import queries as Q
from entitylake.operators import pages as P
from entitylake.rules import domain_lists as dl
from entitylake.rules import query_rules as qr
from entitylake.sources.tables import spread

from . import sqltext as q
from .derived import spark_table
from .page_checks import META_SQL, pages
from .registry import checked

YEAR = 2024


def log(spark, sf):
    return spread(spark_table(spark, sf, "fx_query_log"))


def analyzed(spark, sf, table="fx_query_log"):
    return Q.analyze_queries(spread(spark_table(spark, sf, table)))


_BARE = q.i(qr.BARE_DOMAIN)


def base(table="fx_query_log"):
    t = q.trim("raw")
    return rf"""q0 AS (SELECT query_id, raw, {t} AS trimmed FROM {table}),
q1 AS (SELECT *, regexp_extract(trimmed, '^\S+', 0) AS u, {q.trim(r"regexp_replace(trimmed, '^\S+', '')")} AS rest FROM q0),
q2 AS (SELECT *, regexp_replace({q.host('u')}, '^www\.', '') AS d FROM q1),
q3 AS (SELECT query_id, raw, CASE WHEN regexp_matches(trimmed, '(?i)^https?://') AND d IS NOT NULL THEN CASE WHEN rest <> '' THEN d || ' ' || rest ELSE d END ELSE trimmed END AS query FROM q2),
q4 AS (SELECT *, regexp_matches(lower({q.trim('query')}), {_BARE}) AND NOT contains(lower({q.trim('query')}), ' ') AS is_domain,
  regexp_replace(lower(nullif(regexp_extract({q.trim('query')}, {_BARE}, 1), '')), '^www\.', '') AS qdomain FROM q3)"""


@checked("query_domain", "fx_query_log", f"WITH {base()} SELECT query_id, md5(query) AS query_md5, is_domain, qdomain AS domain FROM q4")
def query_domain(spark, sf):
    out = log(spark, sf).withColumn("query", Q.normalized_query(F.col("raw")))
    return out.select(
        "query_id", F.md5("query").alias("query_md5"), Q.is_domain_query(F.col("query")).alias("is_domain"),
        Q.domain_in_query(F.col("query")).alias("domain"),
    )


_LOC = [q.trim(q.group("query", p)) for p in qr.QUERY_LOCATION_PATTERNS]
_LOCATION = ", ".join(f"CASE WHEN length({x}) > 2 AND NOT regexp_matches({x}, '^\\d+$') THEN {x} END" for x in _LOC)
_CITY = q.group("query", r"\b(" + "|".join(qr.CITIES) + r")\b")
ANALYSIS = f"""{{base}},
q5 AS (SELECT *, CASE WHEN is_domain THEN 'competitor_analysis' ELSE {q.INTENT('query')} END AS intent, {q.first_label('query', qr.QUERY_INDUSTRY_RULES)} AS industry,
  coalesce({_LOCATION}, {_CITY}) AS location FROM q4),
q6 AS (SELECT *, CASE WHEN intent = 'local_business_search' THEN 'local_business' WHEN intent = 'product_discovery' THEN 'product'
  WHEN regexp_matches(query, {q.i(qr.PERSON_WORDS)}) THEN 'person' ELSE 'company' END AS entity_type,
  list_filter(string_split_regex(split_part(coalesce(qdomain, query), '.', 1), '[-_]'), lambda p: length(p) > 2) AS dparts,
  list_filter(string_split_regex(regexp_replace(lower(query), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({q.items(qr.KEYWORD_STOP_WORDS)}, w)) AS words,
  coalesce(' in ' || replace(industry, '_', ' '), '') AS within FROM q5),
q7 AS (SELECT *, CASE WHEN is_domain THEN CASE WHEN len(dparts) > 0 THEN array_to_string(dparts, '|') ELSE coalesce(qdomain, query) END ELSE {q.distinct_in_order('words', 10)} END AS keywords,
  CASE WHEN is_domain THEN 'Discover direct competitors of ' || query || ' and analyze the competitive landscape'
    WHEN intent = 'competitor_analysis' THEN 'Discover direct competitors' || within || ' for: ' || query
    WHEN intent = 'market_discovery' THEN 'Map the market landscape' || within || ' for: ' || query
    WHEN intent = 'local_business_search' THEN 'Find local businesses matching: ' || query
    WHEN intent = 'agency_search' THEN 'Identify agencies' || within || ' matching: ' || query
    WHEN intent = 'product_discovery' THEN 'Discover products/tools matching: ' || query
    WHEN intent = 'brand_discovery' THEN 'Find brands/companies matching: ' || query
    ELSE 'General discovery for: ' || query END AS objective FROM q6)"""


def analysis(table="fx_query_log"):
    return ANALYSIS.replace("{base}", base(table))


def _part(name, columns):
    @checked(name, "fx_query_log", f"WITH {analysis()} SELECT query_id, {', '.join(columns)} FROM q7")
    def run(spark, sf):
        return analyzed(spark, sf).withColumn("keywords", join_list(F.col("keywords"))).select("query_id", *columns)

    return run


_part("query_intent", ["intent"])
_part("query_industry", ["industry"])
_part("query_location", ["location"])
_part("query_keywords", ["keywords"])
_part("query_analysis", ["is_domain", "intent", "industry", "location", "entity_type", "keywords", "objective"])


@checked("description_industry", "fx_pages", f"""{META_SQL.rsplit("SELECT page_id, title", 1)[0].rstrip()},
dd AS (SELECT page_id, coalesce(coalesce(plain_description, og_description), '') || ' ' || coalesce(title, '') AS text FROM mt)
SELECT 'document' AS kind, doc_id AS id, {q.first_label('text', qr.DESCRIPTION_INDUSTRY_RULES)} AS industry FROM documents
UNION ALL SELECT 'page' AS kind, page_id AS id, {q.first_label('text', qr.META_INDUSTRY_RULES)} AS industry FROM dd""")
def description_industry(spark, sf):
    docs = spread(spark_table(spark, sf, "documents")).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        first_label(F.col("text"), qr.DESCRIPTION_INDUSTRY_RULES).alias("industry"),
    )
    meta = P.with_meta(pages(spark, sf))
    text = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("title", F.lit("")))
    return docs.union(meta.select(F.lit("page"), "page_id", first_label(text, qr.META_INDUSTRY_RULES)))


_NAMED = q.group("query", r"(?:of|for)\s+([\w.-]+\.[\w]{2,})")
_IND = "replace(industry, '_', ' ')"


def _positions(lists, limit):
    """Rows (query_id, pos, phrase) of the first distinct non-null entries of list column `l`."""
    return f"""px AS (SELECT query_id, unnest(l) AS phrase, generate_subscripts(l, 1) AS i FROM {lists}),
py AS (SELECT query_id, phrase, min(i) AS i FROM px WHERE phrase IS NOT NULL GROUP BY ALL),
pz AS (SELECT query_id, phrase, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS pos FROM py)
SELECT query_id, pos, phrase FROM pz WHERE pos < {limit}"""


@checked("query_expansion", "fx_query_log", f"""WITH {analysis()},
e1 AS (SELECT *, coalesce(qdomain, query) AS dom, split_part(coalesce(qdomain, query), '.', 1) AS comp, CASE WHEN intent = 'competitor_analysis' THEN {_NAMED} END AS named,
  array_to_string(list_slice(string_split(keywords, '|'), 1, 3), ' ') AS three FROM q7),
e2 AS (SELECT query_id, CASE WHEN is_domain THEN ['"' || comp || '" competitors', 'alternatives to ' || dom, 'sites like ' || dom, 'companies similar to ' || comp,
    CASE WHEN industry IS NOT NULL THEN 'best ' || {_IND} || ' companies' ELSE comp || ' competitors {YEAR}' END, 'top ' || {_IND} || ' agencies 2024']
  ELSE [query, 'competitors of ' || named, 'alternatives to ' || named, '"' || split_part(named, '.', 1) || '" competitors', 'best ' || {_IND} || ' companies', 'top ' || {_IND} || ' agencies',
    three || ' in ' || location, CASE WHEN keywords <> '' THEN three || ' companies' END] END AS l FROM e1),
{_positions('e2', 6)}""")
def query_expansion(spark, sf):
    return Q.expand_queries(analyzed(spark, sf), YEAR).withColumn("pos", F.col("pos").cast("bigint"))


def company_cases(col, table):
    slug = f"regexp_replace(lower({col}), '[^a-z0-9-]', '', 'g')"
    return f"CASE {' '.join(f'WHEN {slug} = {q.lit(k)} THEN {q.lit(v)}' for k, v in table.items())} ELSE {slug} || '.com' END"


def target_sql(col, order="documented"):
    return "coalesce(" + ", ".join(q.group(col, p) for p in qr.TARGET_COMPANY_PATTERNS[order]) + ")"


@checked("query_target_company", "fx_query_log", f"SELECT query_id, {target_sql('raw')} AS documented, {target_sql('raw', 'literal')} AS literal_order, {target_sql('raw', 'enhancer')} AS enhancer_order FROM fx_query_log")
def query_target_company(spark, sf):
    raw = F.col("raw")
    return log(spark, sf).select(
        "query_id", Q.target_company(raw).alias("documented"), Q.target_company(raw, "literal").alias("literal_order"),
        Q.target_company(raw, "enhancer").alias("enhancer_order"),
    )


@checked("company_domain_guess", "fx_queries fx_titles", f"""WITH co AS (SELECT DISTINCT {target_sql('raw', 'literal')} AS company FROM fx_queries UNION SELECT DISTINCT title FROM fx_titles)
SELECT company, {company_cases('company', dl.KNOWN_COMPANY_DOMAINS)} AS domain,
  {q.trim(f"regexp_replace(regexp_replace(regexp_replace({company_cases('company', dl.KNOWN_COMPANY_DOMAINS)}, '^https?://', ''), '^www[.]', ''), {q.i(qr.NAME_TLDS)}, '')")} AS company_again FROM co WHERE company IS NOT NULL""")
def company_domain_guess(spark, sf):
    asked = spark_table(spark, sf, "fx_queries").select(Q.target_company(F.col("raw"), "literal").alias("company"))
    titles = spark_table(spark, sf, "fx_titles").select(F.col("title").alias("company"))
    names = asked.union(titles).filter("company IS NOT NULL").distinct()
    guessed = names.withColumn("domain", Q.company_to_domain(F.col("company")))
    return guessed.withColumn("company_again", Q.domain_to_company(F.col("domain")))


def queries_with_profiles(spark, sf):
    asked = spark_table(spark, sf, "fx_queries").withColumn("domain", Q.company_to_domain(Q.target_company(F.col("raw"), "literal")))
    profiles = spark_table(spark, sf, "fx_profiles").withColumn("primary_services", split_list(F.col("primary_services")))
    return asked.join(profiles, "domain", "left")


@checked("profile_queries", "fx_queries fx_profiles", f"""WITH pa AS (SELECT query_id, raw, {company_cases(target_sql('raw', 'literal'), dl.KNOWN_COMPANY_DOMAINS)} AS domain FROM fx_queries),
pb AS (SELECT query_id, raw, name, nullif(split_part(primary_services, '|', 1), '') AS svc, industry FROM pa LEFT JOIN fx_profiles USING (domain)),
pc AS (SELECT query_id, CASE WHEN name IS NULL THEN [raw] ELSE [raw, name || ' alternative', 'top ' || lower(svc) || ' companies {YEAR}', 'best ' || lower(svc) || ' agency', 'top ' || {_IND} || ' companies'] END AS l FROM pb),
{_positions('pc', 5)}""")
def profile_queries(spark, sf):
    return Q.profile_queries(queries_with_profiles(spark, sf), YEAR).withColumn("pos", F.col("pos").cast("bigint"))
