"""Candidate, serving, history and resolve queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from entitylake.functions.text import decode_json_list, join_list, normalize_text, split_list, text_similarity, truncate_text
from entitylake.operators import candidates as C
from entitylake.operators import history as H
from entitylake.operators import queries as Q
from entitylake.operators import resolve as R
from entitylake.operators import serve as SV
from entitylake.rules import domain_lists as dl
from entitylake.rules import query_rules as qr
from entitylake.sources.tables import find_by_key, spread

from . import sqltext as q
from .derived import spark_table
from .query_checks import analysis, analyzed, target_sql
from .registry import checked
from .score_checks import entities

AS_OF = datetime(2024, 2, 1)


def t(spark, sf, name):
    return spark_table(spark, sf, name)


# --- lookups, listing, export -------------------------------------------------------------------


@checked("entity_lookup", "fx_entities", "SELECT entity_id, domain, name FROM fx_entities WHERE domain IN ('brand5.com', 'clutch.co')")
def entity_lookup(spark, sf):
    return find_by_key(entities(spark, sf), "domain", ["brand5.com", "clutch.co"]).select("entity_id", "domain", "name")


@checked("entity_listing", "fx_entities", """SELECT entity_id, name, domain, relevance, CAST(NULL AS BOOLEAN) AS is_new FROM fx_entities WHERE is_valid AND confidence >= 0.3
AND (contains(lower(name), 'brand 1') OR contains(lower(domain), 'brand 1') OR coalesce(contains(lower(description), 'brand 1'), false)) ORDER BY relevance ASC, entity_id LIMIT 20 OFFSET 20""")
def entity_listing(spark, sf):
    page = SV.entity_listing(entities(spark, sf), search="Brand 1", min_score=0.3, sort="relevanceScore", order="asc", page=2)
    return page.select("entity_id", "name", "domain", "relevance", "is_new")


@checked("listing_pagination", "fx_entities", "SELECT count(*) AS total, 1 AS page, 20 AS \"limit\", CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM fx_entities WHERE is_valid AND confidence >= 0.3")
def listing_pagination(spark, sf):
    return SV.listing_pagination(SV.listing_filter(entities(spark, sf), min_score=0.3))


def merged_links(spark, sf):
    return H.merge_links(t(spark, sf, "fx_links"), ["ts", "l_orderkey", "l_linenumber"])


MERGED = """ml AS (SELECT query_id, entity_id, arg_max(score, (ts, l_orderkey, l_linenumber)) AS score, arg_min(is_new, (ts, l_orderkey, l_linenumber)) AS is_new FROM fx_links GROUP BY query_id, entity_id)"""


@checked("query_entity_upsert", "fx_links", f"WITH {MERGED} SELECT * FROM ml")
def query_entity_upsert(spark, sf):
    return merged_links(spark, sf)


@checked("entities_for_query", "fx_links fx_entities", f"WITH {MERGED} SELECT query_id, entity_id, domain, confidence, is_new, score AS link_score FROM ml JOIN (SELECT * FROM fx_entities WHERE is_valid) USING (entity_id)")
def entities_for_query(spark, sf):
    found = SV.entities_for_query(entities(spark, sf), merged_links(spark, sf))
    return found.select("query_id", "entity_id", "domain", "confidence", "is_new", "link_score")


EXPORT = """ex AS (SELECT * FROM fx_entities WHERE is_valid ORDER BY confidence DESC, entity_id LIMIT 1000)"""


@checked("export_csv_rows", "fx_entities", f"""WITH {EXPORT} SELECT name, domain, coalesce(description, '') AS description, coalesce(category, '') AS category, replace(services, '|', '; ') AS services, replace(technologies, '|', '; ') AS technologies,
coalesce(linkedin, '') AS linkedin, replace(emails, '|', '; ') AS emails, printf('%.2f', confidence) AS "confidenceScore", printf('%.2f', relevance) AS "relevanceScore",
strftime(first_seen, '%Y-%m-%dT%H:%M:%S.000Z') AS "firstSeen", strftime(last_seen, '%Y-%m-%dT%H:%M:%S.000Z') AS "lastSeen", coalesce(source, '') AS source FROM ex""")
def export_csv_rows(spark, sf):
    return SV.export_csv_rows(entities(spark, sf))


@checked("export_json_rows", "fx_entities", f"""WITH {EXPORT} SELECT entity_id, domain, services, technologies, emails, locations, CASE WHEN phones = '' THEN '[]' ELSE '["' || replace(phones, '|', '","') || '"]' END AS phones, confidence FROM ex""")
def export_json_rows(spark, sf):
    out = SV.export_json_rows(entities(spark, sf))
    lists = {c: join_list(F.col(c)) for c in ("services", "technologies", "emails", "locations")}
    return out.withColumns(lists).select("entity_id", "domain", *lists, "phones", "confidence")


@checked("json_lists_decode", "fx_entities", """SELECT entity_id, services, CASE WHEN entity_id % 7 = 0 THEN '' ELSE emails END AS emails FROM fx_entities""")
def json_lists_decode(spark, sf):
    stored = entities(spark, sf).select(
        "entity_id", F.to_json("services").alias("services"), F.when(F.col("entity_id") % 7 != 0, F.to_json("emails")).alias("emails")
    )
    return stored.select("entity_id", *[join_list(decode_json_list(F.col(c))).alias(c) for c in ("services", "emails")])


@checked("text_normalize", sql=rf"""SELECT doc_id, md5({q.squash('lower(text)')}) AS normal_md5, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 97) || '...' END AS short FROM documents""")
def text_normalize(spark, sf):
    return spread(t(spark, sf, "documents")).select("doc_id", F.md5(normalize_text(F.col("text"))).alias("normal_md5"), truncate_text(F.col("text"), 100).alias("short"))


_WORDS = r"list_distinct(string_split_regex(lower({}), '\s+'))"


@checked("text_similarity", sql=rf"""WITH pr AS (SELECT a.conv_id, a.turn, {_WORDS.format('a.text')} AS x, {_WORDS.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
c AS (SELECT *, len(list_intersect(x, y)) AS n FROM pr) SELECT conv_id, turn, n::DOUBLE / (len(x) + len(y) - n) AS similarity FROM c""")
def similarity_of_turns(spark, sf):
    turns = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", text_similarity(F.col("text"), F.col("next_text")).alias("similarity"))


@checked("key_phrases", sql=r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+')) AS phrase, generate_subscripts(string_split_regex(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+'), 1) AS i FROM documents),
g AS (SELECT doc_id, phrase, count(*) AS uses, min(i) AS i FROM w WHERE length(phrase) > 3 GROUP BY doc_id, phrase),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, i) AS pos FROM g) SELECT doc_id, pos, phrase, uses FROM r WHERE pos <= 10""")
def key_phrases(spark, sf):
    return SV.key_phrases(spread(t(spark, sf, "documents")), "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


# --- crawl logs, details ------------------------------------------------------------------------

LATEST = """la AS (SELECT log_id, arg_max(query_id, (updated_at, event_id)) AS query_id, arg_max(url, (updated_at, event_id)) AS url, arg_max(status, (updated_at, event_id)) AS status,
arg_max(duration, (updated_at, event_id)) AS duration, arg_max(entities_found, (updated_at, event_id)) AS entities_found, max(updated_at) AS updated_at, min(updated_at) AS created_at FROM fx_crawl_logs GROUP BY log_id)"""


@checked("crawl_latest_status", "fx_crawl_logs", f"WITH {LATEST} SELECT log_id, query_id, url, status, duration, entities_found FROM la")
def crawl_latest_status(spark, sf):
    return SV.crawl_latest(t(spark, sf, "fx_crawl_logs")).select("log_id", "query_id", "url", "status", "duration", "entities_found")


@checked("recent_logs", "fx_crawl_logs", f"WITH {LATEST} SELECT log_id, status, created_at FROM la ORDER BY created_at DESC, log_id DESC LIMIT 100")
def recent_logs(spark, sf):
    return SV.recent_logs(SV.crawl_latest(t(spark, sf, "fx_crawl_logs"))).select("log_id", "status", "created_at")


@checked("recent_queries", "fx_queries", "SELECT query_id, raw, created_at FROM fx_queries ORDER BY created_at DESC, query_id DESC LIMIT 50")
def recent_queries(spark, sf):
    return SV.recent_queries(t(spark, sf, "fx_queries"))


_STATS = "count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending"


@checked("crawl_stats", "fx_crawl_logs", f"WITH {LATEST}, st AS (SELECT {_STATS} FROM la) SELECT *, CAST(floor(success * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS success_rate FROM st")
def crawl_stats(spark, sf):
    return SV.crawl_stats(SV.crawl_latest(t(spark, sf, "fx_crawl_logs")))


@checked("query_detail", "fx_queries fx_links fx_entities fx_crawl_logs", f"""WITH {MERGED}, {LATEST}
SELECT query_id, 'query' AS kind, query_id AS item_id, raw AS label, CAST(NULL AS VARCHAR) AS status FROM fx_queries
UNION ALL SELECT query_id, 'entity', entity_id, domain, CASE WHEN is_new THEN 'new' ELSE 'known' END FROM (SELECT ml.query_id, ml.is_new, e.entity_id, e.domain FROM ml JOIN fx_entities e ON e.entity_id = ml.entity_id) WHERE query_id IN (SELECT query_id FROM fx_queries)
UNION ALL SELECT query_id, 'log', log_id, url, status FROM la WHERE query_id IN (SELECT query_id FROM fx_queries)""")
def query_detail(spark, sf):
    stored = entities(spark, sf).drop("is_new")
    return SV.query_detail(t(spark, sf, "fx_queries"), merged_links(spark, sf), stored, SV.crawl_latest(t(spark, sf, "fx_crawl_logs")))


# --- history ------------------------------------------------------------------------------------


def versions(spark, sf):
    return t(spark, sf, "fx_versions").withColumns({c: split_list(F.col(c)) for c in ("services", "emails")})


ORDER = ["version_ts", "version_id"]
VERSIONS_JSON = _JSON = "json_object('name', name, 'description', description, 'services', to_json(string_list), 'linkedin', linkedin, 'emails', to_json(email_list), 'category', category)"
VERSIONS = f"""vv AS (SELECT *, {q.as_list('services')} AS string_list, {q.as_list('emails')} AS email_list FROM fx_versions),
vh AS (SELECT *, md5(CAST({_JSON} AS VARCHAR)) AS hash FROM vv),
vl AS (SELECT *, lag(hash) OVER w AS p_hash, lag(name) OVER w AS p_name, lag(description) OVER w AS p_description, lag(CAST(to_json(string_list) AS VARCHAR)) OVER w AS p_services, lag(linkedin) OVER w AS p_linkedin,
  lag(CAST(to_json(email_list) AS VARCHAR)) OVER w AS p_emails, lag(category) OVER w AS p_category FROM vh WINDOW w AS (PARTITION BY domain ORDER BY version_ts, version_id))"""
_CH = " UNION ALL ".join(
    f"SELECT domain, version_id, version_ts, '{f}' AS field, p_{f} AS old_value, {f if f not in ('services', 'emails') else ('CAST(to_json(string_list) AS VARCHAR)' if f == 'services' else 'CAST(to_json(email_list) AS VARCHAR)')} AS new_value FROM vl WHERE p_hash IS NOT NULL"
    for f in H.TRACKED
)
CHANGES = f"""ch0 AS ({_CH}), changes AS (SELECT *, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'modified' END AS change_type FROM ch0 WHERE old_value IS DISTINCT FROM new_value),
snaps AS (SELECT domain, version_id, version_ts, hash FROM vl WHERE p_hash IS NULL OR p_hash <> hash)"""


@checked("snapshot_hash", "fx_versions", f"WITH {VERSIONS} SELECT version_id, hash FROM vh")
def snapshot_hash(spark, sf):
    return versions(spark, sf).select("version_id", H.snapshot_hash().alias("hash"))


@checked("entity_changes", "fx_versions", f"WITH {VERSIONS}, {CHANGES} SELECT domain, version_id, version_ts, field, old_value, new_value, change_type FROM changes")
def entity_changes(spark, sf):
    return H.entity_changes(versions(spark, sf), ORDER)


@checked("entity_snapshots", "fx_versions", f"WITH {VERSIONS}, {CHANGES} SELECT domain, version_id, hash FROM snaps")
def entity_snapshots(spark, sf):
    return H.entity_snapshots(versions(spark, sf), ORDER, hot_rows=0).select("domain", "version_id", "hash")


@checked("change_counts", "fx_versions", f"WITH {VERSIONS}, {CHANGES} SELECT domain, count(*) AS recent_changes FROM changes GROUP BY domain")
def change_counts(spark, sf):
    return H.change_counts(H.entity_changes(versions(spark, sf), ORDER))


@checked("entity_detail_topn", "fx_versions fx_validations fx_entities", f"""WITH {VERSIONS}, {CHANGES},
al AS (SELECT domain, 'snapshot' AS kind, version_ts AS ts, CAST(version_id AS VARCHAR) AS uid, hash AS label, 5 AS k FROM snaps
  UNION ALL SELECT domain, 'change', version_ts, CAST(version_id AS VARCHAR) || field, change_type, 10 FROM changes
  UNION ALL SELECT domain, 'validation', created_at, CAST(validation_id AS VARCHAR), CAST(passed AS VARCHAR), 5 FROM fx_validations),
rn AS (SELECT *, row_number() OVER (PARTITION BY domain, kind ORDER BY ts DESC, uid DESC) AS pos FROM al)
SELECT domain, kind, pos, ts AS "at", uid, label FROM rn WHERE pos <= k AND domain IN (SELECT domain FROM fx_entities)""")
def entity_detail_topn(spark, sf):
    v = versions(spark, sf)
    snaps = H.entity_snapshots(v, ORDER).select("domain", F.col("version_ts").alias("at"), F.col("version_id").cast("string").alias("uid"), F.col("hash").alias("label"))
    changes = H.entity_changes(v, ORDER).select("domain", F.col("version_ts").alias("at"), F.concat(F.col("version_id").cast("string"), "field").alias("uid"), F.col("change_type").alias("label"))
    checks = t(spark, sf, "fx_validations").select("domain", F.col("created_at").alias("at"), F.col("validation_id").cast("string").alias("uid"), F.col("passed").cast("string").alias("label"))
    return SV.entity_detail(entities(spark, sf), snaps, changes, checks).withColumn("pos", F.col("pos").cast("bigint"))


def newest_versions(spark, sf):
    """The last version of each domain as the incoming side of an upsert."""
    v = versions(spark, sf)
    from entitylake.operators.ordering import first_per_key

    return first_per_key(v, ["domain"], [F.col("version_ts").desc(), F.col("version_id").desc()])


def current_entities(spark, sf):
    """The stored side: one row per domain."""
    stored = R.dedup_by_domain(entities(spark, sf), [F.col("entity_id")])
    return stored.select("entity_id", "domain", "name", "description", "services", "linkedin", "emails", "category", "confidence", "first_seen", "last_seen", "is_valid")


_KEY = r"trim(regexp_replace(lower(domain), '^www\.', ''))"
DEDUP = f"de AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY entity_id) AS rn FROM fx_entities)"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@checked("entity_upsert", "fx_entities fx_versions", f"""WITH {DEDUP}, nv AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY version_ts DESC, version_id DESC) AS rn FROM fx_versions)
SELECT c.entity_id, coalesce(c.domain, i.domain) AS domain, CASE WHEN i.domain IS NOT NULL THEN i.name ELSE c.name END AS name, CASE WHEN i.domain IS NOT NULL THEN i.description ELSE c.description END AS description,
CASE WHEN i.domain IS NOT NULL THEN i.services ELSE c.services END AS services, CASE WHEN i.domain IS NOT NULL THEN i.linkedin ELSE c.linkedin END AS linkedin, CASE WHEN i.domain IS NOT NULL THEN i.emails ELSE c.emails END AS emails,
CASE WHEN i.domain IS NOT NULL THEN i.category ELSE c.category END AS category, CASE WHEN i.domain IS NOT NULL THEN i.confidence ELSE c.confidence END AS confidence, coalesce(c.first_seen, {NOW}) AS first_seen,
CASE WHEN i.domain IS NOT NULL THEN {NOW} ELSE c.last_seen END AS last_seen, i.domain IS NOT NULL OR c.is_valid AS is_valid
FROM (SELECT * FROM de WHERE rn = 1) c FULL OUTER JOIN (SELECT * FROM nv WHERE rn = 1) i ON c.domain = i.domain""")
def entity_upsert(spark, sf):
    incoming = newest_versions(spark, sf).select("domain", "name", "description", "services", "linkedin", "emails", "category", "confidence")
    merged = H.merge_entities(current_entities(spark, sf), incoming, AS_OF)
    return merged.withColumns({c: join_list(F.col(c)) for c in ("services", "emails")})


@checked("validation_audit", "fx_entities", f"SELECT entity_id, 'full' AS validation_type, true AS passed, confidence AS score, 'Passed validation' AS reason, {NOW} AS created_at FROM fx_entities WHERE is_valid")
def validation_audit(spark, sf):
    return H.validation_audit(entities(spark, sf).filter("is_valid"), AS_OF)


@checked("dedup_domain", "fx_entities", f"WITH {DEDUP} SELECT entity_id, domain FROM de WHERE rn = 1")
def dedup_domain(spark, sf):
    return R.dedup_by_domain(entities(spark, sf), [F.col("entity_id")]).select("entity_id", "domain")


_NK = "regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"


@checked("similar_entities", "fx_names", f"""WITH n AS (SELECT id, {_NK} AS name, {_KEY} AS key FROM fx_names),
u AS (SELECT name, min(id) AS id1 FROM n GROUP BY name),
sm AS (SELECT a.name AS a, min(b.id1) AS m FROM u a JOIN u b ON a.name <> b.name AND abs(length(a.name) - length(b.name)) < 0.16 * greatest(length(a.name), length(b.name))
  AND (greatest(length(a.name), length(b.name)) - levenshtein(a.name, b.name))::DOUBLE / greatest(length(a.name), length(b.name)) > 0.85::DOUBLE GROUP BY a.name),
rk AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM n), kk AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM n),
al AS (SELECT n.id, rk.id AS match_id, 'name' AS reason FROM n JOIN rk ON rk.name = n.name AND rk.r <= 2 AND rk.id <> n.id UNION ALL SELECT n.id, kk.id, 'domain' FROM n JOIN kk ON kk.key = n.key AND kk.r <= 2 AND kk.id <> n.id
  UNION ALL SELECT n.id, m, 'name' FROM n JOIN sm ON sm.a = n.name),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY match_id, reason) AS r FROM al) SELECT id, match_id, reason FROM b WHERE r = 1""")
def similar_entities(spark, sf):
    names = t(spark, sf, "fx_names")
    return R.similar_entities(names, names)


# --- candidates ---------------------------------------------------------------------------------

_CLEAN = r"regexp_replace(regexp_replace(lower({}), '^www\.', ''), '/$', '')"


def suggestions(spark, sf):
    return t(spark, sf, "fx_suggestions").withColumn("competitors", split_list(F.col("competitors")))


@checked("candidate_clean", "fx_suggestions", f"""WITH s AS (SELECT query_id, unnest(string_split(competitors, '|')) AS raw_domain, generate_subscripts(string_split(competitors, '|'), 1) - 1 AS pos FROM fx_suggestions)
SELECT query_id, pos, {_CLEAN.format('raw_domain')} AS domain FROM s WHERE contains({_CLEAN.format('raw_domain')}, '.')""")
def candidate_clean(spark, sf):
    rows = suggestions(spark, sf).select("query_id", F.posexplode("competitors").alias("pos", "domain"))
    return C.cleaned_candidates(rows).withColumn("pos", F.col("pos").cast("bigint"))


@checked("blocklist_anti", "fx_suggestions fx_entities fx_seeds", f"""SELECT entity_id, domain, domain NOT IN {q.inlist(dl.VERDICT_BLOCKLIST)} AS verdict_ok, domain NOT IN {q.inlist(dl.CANDIDATE_BLOCKLIST)} AS candidate_ok,
domain NOT IN {q.inlist(dl.SEARCH_BLOCKLIST)} AS search_ok, domain NOT IN {q.inlist(dl.RESULT_BLOCKLIST)} AS result_ok, domain NOT IN (SELECT domain FROM fx_seeds) AS table_ok FROM fx_entities""")
def blocklist_anti(spark, sf):
    rows = entities(spark, sf).select("entity_id", "domain")
    out = rows
    lists = {"verdict_ok": dl.VERDICT_BLOCKLIST, "candidate_ok": dl.CANDIDATE_BLOCKLIST, "search_ok": dl.SEARCH_BLOCKLIST, "result_ok": dl.RESULT_BLOCKLIST, "table_ok": t(spark, sf, "fx_seeds")}
    for name, listed in lists.items():
        kept = C.drop_blocked(rows, listed).select("entity_id", F.lit(True).alias(name))
        out = out.join(kept, "entity_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@checked("company_variant_filter", "fx_serp", f"""WITH c AS (SELECT query_id, company, unnest(['brand' || CAST((query_id * 7) % 97 AS STRING) || '.com', 'mybrand' || CAST((query_id * 7) % 97 AS STRING) || 'shop.io', 'brand' || CAST((query_id * 7) % 97 AS STRING) || 's.com', 'other.com']) AS domain FROM fx_serp),
v AS (SELECT *, split_part(domain, '.', 1) AS slug, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS cc FROM c)
SELECT query_id, domain FROM v WHERE NOT coalesce(length(cc) >= 3 AND (slug = cc OR slug = cc || 's' OR slug = cc || 'es' OR (length(slug) > length(cc) + 2 AND contains(slug, cc))), false)""")
def company_variant_filter(spark, sf):
    serp = t(spark, sf, "fx_serp")
    n = ((F.col("query_id") * 7) % 97).cast("string")
    domains = F.array(F.concat(F.lit("brand"), n, F.lit(".com")), F.concat(F.lit("mybrand"), n, F.lit("shop.io")), F.concat(F.lit("brand"), n, F.lit("s.com")), F.lit("other.com"))
    return C.drop_company_variants(serp.select("query_id", F.explode(domains).alias("domain")), serp.select("query_id", "company"))


_IK = r"regexp_replace(lower(industry), '[\s-]', '_', 'g')"
_ALIAS = " ".join(f"WHEN {_IK} = {q.lit(k)} THEN {q.lit(v)}" for k, v in dl.INDUSTRY_ALIASES.items())


@checked("industry_alias_map", "fx_entities fx_suggestions", f"""WITH s AS (SELECT DISTINCT industry FROM fx_suggestions WHERE industry IS NOT NULL UNION SELECT DISTINCT category FROM fx_entities WHERE category IS NOT NULL UNION SELECT DISTINCT p_type FROM part
UNION SELECT DISTINCT unnest(['SEO', 'B2B-SaaS', 'human resources', 'Real Estate', 'Dev Tools', 'ui design']) || substr(p_type, 1, 0) FROM part)
SELECT industry, CASE WHEN {_IK} IN {q.inlist(dl.INDUSTRY_KEYS)} THEN {_IK} {_ALIAS} END AS industry_key FROM s""")
def industry_alias_map(spark, sf):
    named = t(spark, sf, "part").select(F.explode(F.array(*[F.lit(x) for x in ("SEO", "B2B-SaaS", "human resources", "Real Estate", "Dev Tools", "ui design")])).alias("industry"))
    rows = t(spark, sf, "fx_suggestions").select("industry").union(entities(spark, sf).select("category")).union(t(spark, sf, "part").select("p_type")).union(named)
    return rows.filter("industry IS NOT NULL").distinct().withColumn("industry_key", C.industry_key(F.col("industry")))


def asked(spark, sf):
    return analyzed(spark, sf, "fx_queries")


@checked("seed_expansion", "fx_queries fx_seeds", f"WITH {analysis('fx_queries')} SELECT query_id, q7.industry, s.pos, s.domain FROM q7 JOIN fx_seeds s ON s.industry = q7.industry")
def seed_expansion(spark, sf):
    return C.seed_expansion(asked(spark, sf), t(spark, sf, "fx_seeds").drop("priority"))


KEYWORD = "kw AS (SELECT query_id, arg_min(industry, priority) AS kw_industry FROM fx_queries JOIN fx_seeds ON contains(lower(raw), split_part(domain, '.', 1)) GROUP BY query_id)"


@checked("seed_keyword_match", "fx_queries fx_seeds", f"WITH {KEYWORD} SELECT query_id, kw_industry AS industry FROM kw")
def seed_keyword_match(spark, sf):
    return C.seed_keyword_match(t(spark, sf, "fx_queries"), t(spark, sf, "fx_seeds"))


_BRANDS = q.values(list(dl.KNOWN_BRANDS.items()))
BRAND = f"""kb(word, site) AS (VALUES {_BRANDS}), bw AS (SELECT query_id, unnest(string_split_regex(regexp_replace(lower(raw), '[^a-z0-9\\s]', '', 'g'), '\\s+')) AS word, generate_subscripts(string_split_regex(regexp_replace(lower(raw), '[^a-z0-9\\s]', '', 'g'), '\\s+'), 1) AS i FROM fx_query_log),
bm AS (SELECT query_id, arg_min(site, i) AS brand FROM bw JOIN kb USING (word) GROUP BY query_id)"""


@checked("brand_match", "fx_query_log", f"WITH {BRAND} SELECT query_id, brand FROM bm")
def brand_match(spark, sf):
    return t(spark, sf, "fx_query_log").select("query_id", C.brand_domain(F.col("raw")).alias("brand")).filter("brand IS NOT NULL")


STORED_CATEGORY = "sc0 AS (SELECT q7.query_id, lower(regexp_replace(category, '\\s+', '_', 'g')) AS industry FROM q7 JOIN fx_entities e ON e.domain = q7.qdomain WHERE is_domain AND category <> '')"


@checked("category_lookup", "fx_queries fx_entities", f"WITH {analysis('fx_queries')}, {STORED_CATEGORY} SELECT query_id, industry FROM sc0")
def category_lookup(spark, sf):
    return C.category_industry(asked(spark, sf), entities(spark, sf))


def directories(spark):
    rows = [(industry, pos, url) for industry, urls in dl.DIRECTORY_PAGES.items() for pos, url in enumerate(urls)]
    return spark.createDataFrame(rows, "industry string, pos int, url string")


_DIR = q.values([(i, p, u) for i, us in dl.DIRECTORY_PAGES.items() for p, u in enumerate(us)])
_WEBI = q.inlist(qr.WEB_INTENTS)
_CBL = q.inlist(dl.CANDIDATE_BLOCKLIST)
_GUESS = f"regexp_replace(lower({target_sql('raw')}), '[^a-z0-9-]', '', 'g') || '.com'"
CANDIDATES = f"""{analysis('fx_queries')}, {STORED_CATEGORY}, {KEYWORD}, {BRAND.replace('fx_query_log', 'fx_queries')},
sind AS (SELECT DISTINCT industry FROM fx_seeds), sug AS (SELECT * FROM fx_suggestions WHERE confidence >= 0.5),
wi AS (SELECT query_id, arg_min(industry, pos) AS w FROM fx_web WHERE industry IS NOT NULL GROUP BY query_id),
st0 AS (SELECT query_id, min(industry) AS s FROM sc0 WHERE industry IN (SELECT industry FROM sind) GROUP BY query_id),
c1 AS (SELECT q7.*, coalesce(q7.industry, CASE WHEN NOT is_domain THEN sug.industry END, CASE WHEN NOT is_domain AND intent IN {_WEBI} THEN w END, CASE WHEN is_domain THEN s END) AS resolved, kw_industry, brand
  FROM q7 LEFT JOIN sug USING (query_id) LEFT JOIN wi USING (query_id) LEFT JOIN st0 USING (query_id) LEFT JOIN kw USING (query_id) LEFT JOIN bm USING (query_id)),
c2 AS (SELECT *, resolved IN (SELECT industry FROM sind) AND resolved IS NOT NULL AS has_seeds FROM c1),
c3 AS (SELECT *, CASE WHEN has_seeds THEN resolved ELSE coalesce(kw_industry, CASE WHEN intent = 'agency_search' THEN 'cro_agency' WHEN intent = 'local_business_search' THEN CASE WHEN regexp_matches(lower(location), 'delhi|india|mumbai') THEN 'apparel' ELSE 'food' END END) END AS seed_industry,
  CASE WHEN intent IN ('competitor_analysis', 'market_discovery') AND ({_GUESS}) NOT IN {_CBL} THEN {_GUESS} END AS guess FROM c2),
d1 AS (SELECT query_id, 1 AS tier, unnest(l) AS d, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT query_id, list_concat(string_split(competitors, '|'), CASE WHEN company <> '' THEN [company] ELSE [] END) AS l FROM sug WHERE query_id IN (SELECT query_id FROM c3 WHERE NOT is_domain))
  UNION ALL SELECT query_id, 2, domain, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM fx_web) WHERE r <= 10 AND query_id IN (SELECT query_id FROM c3 WHERE NOT is_domain AND intent IN {_WEBI})
  UNION ALL SELECT query_id, 3, qdomain, 0 FROM c3 WHERE is_domain
  UNION ALL SELECT query_id, 4, domain, pos FROM c3 JOIN fx_seeds s ON s.industry = c3.seed_industry
  UNION ALL SELECT query_id, CASE WHEN guess IS NOT NULL THEN 6 ELSE 7 END, coalesce(guess, brand), 0 FROM c3 WHERE seed_industry IS NULL),
d2 AS (SELECT query_id, tier, pos, 'https://' || {_CLEAN.format('d')} AS url, false AS links_only FROM d1 WHERE d IS NOT NULL AND {_CLEAN.format('d')} NOT IN {_CBL}
  UNION ALL SELECT query_id, 5, p, u, true FROM c3 JOIN (VALUES {_DIR}) x(i, p, u) ON i = seed_industry WHERE has_seeds),
d3 AS (SELECT query_id, url, min((tier, pos, links_only)) AS b FROM d2 GROUP BY query_id, url),
candidates AS (SELECT query_id, url, b[1] AS tier, b[3] AS links_only, row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], url) AS pos FROM d3)"""
CUSES = "fx_queries fx_entities fx_seeds fx_suggestions fx_web"


def candidates(spark, sf):
    return C.candidate_urls(asked(spark, sf), suggestions(spark, sf), t(spark, sf, "fx_web"), t(spark, sf, "fx_seeds"), entities(spark, sf), directories(spark))


@checked("candidate_urls", CUSES, f"WITH {CANDIDATES} SELECT query_id, pos, url, tier, links_only FROM candidates WHERE pos <= 15")
def candidate_urls(spark, sf):
    return candidates(spark, sf).withColumn("pos", F.col("pos").cast("bigint"))


_SBL = q.inlist(dl.SEARCH_BLOCKLIST)


@checked("candidate_fallback", "fx_queries fx_suggestions fx_web", f"""WITH l0 AS (SELECT query_id, 1 AS layer, unnest(string_split(competitors, '|')) AS d, generate_subscripts(string_split(competitors, '|'), 1) - 1 AS pos FROM fx_suggestions WHERE confidence >= 0.5
  UNION ALL SELECT query_id, 2, domain, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM fx_web) WHERE r <= 25),
l1 AS (SELECT query_id, layer, pos, {_CLEAN.format('d')} AS domain FROM l0), l2 AS (SELECT * FROM l1 WHERE contains(domain, '.') AND domain NOT IN {_SBL}),
l3 AS (SELECT * FROM l2 UNION ALL SELECT query_id, 99, 0, 'broad' || CAST(query_id % 9 AS STRING) || '.com' FROM fx_queries WHERE query_id NOT IN (SELECT query_id FROM l2)),
l4 AS (SELECT query_id, domain, min((layer, pos)) AS b FROM l3 GROUP BY query_id, domain), l5 AS (SELECT query_id, domain, b[1] AS layer, row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], domain) AS pos FROM l4)
SELECT query_id, pos, domain, layer FROM l5 WHERE pos <= 18""")
def candidate_fallback(spark, sf):
    from entitylake.operators.ordering import top_k_per_key

    suggested = suggestions(spark, sf).filter("confidence >= 0.5").select("query_id", F.lit(1).alias("layer"), F.posexplode("competitors").alias("pos", "domain"))
    web = top_k_per_key(t(spark, sf, "fx_web"), ["query_id"], [F.col("pos")], 25).select("query_id", F.lit(2).alias("layer"), "pos", "domain")
    broad = t(spark, sf, "fx_queries").select("query_id", F.lit(0).alias("pos"), F.concat(F.lit("broad"), (F.col("query_id") % 9).cast("string"), F.lit(".com")).alias("domain"))
    found = C.candidates_with_fallback(suggested.union(web), broad)
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@checked("search_merge", "fx_searches", """WITH e AS (SELECT query_id, ordinal, unnest(string_split(domains, '|')) AS domain FROM fx_searches), c AS (SELECT query_id, count(DISTINCT domain) AS domain_count FROM e GROUP BY query_id)
SELECT query_id, arg_min(industry, ordinal) FILTER (industry <> '') AS industry, arg_min(description, ordinal) FILTER (description <> '') AS description, coalesce(arg_max(source, ordinal) FILTER (source <> 'none'), 'none') AS source, any_value(domain_count) AS domain_count
FROM fx_searches JOIN c USING (query_id) GROUP BY query_id""")
def search_merge(spark, sf):
    rows = t(spark, sf, "fx_searches").withColumn("domains", split_list(F.col("domains")))
    return C.merge_searches(rows)[0]


@checked("search_merge_domains", "fx_searches", """WITH e AS (SELECT query_id, ordinal, unnest(string_split(domains, '|')) AS domain, generate_subscripts(string_split(domains, '|'), 1) - 1 AS pos FROM fx_searches),
m AS (SELECT query_id, domain, min((ordinal, pos)) AS b FROM e GROUP BY query_id, domain) SELECT query_id, domain, b[1] AS ordinal, b[2] AS pos FROM m""")
def search_merge_domains(spark, sf):
    rows = t(spark, sf, "fx_searches").withColumn("domains", split_list(F.col("domains")))
    return C.merge_searches(rows)[1].withColumn("pos", F.col("pos").cast("bigint"))


RERUN = """fd AS (SELECT DISTINCT p.query_id, raw, domain FROM fx_pairs p JOIN fx_queries USING (query_id) JOIN fx_entities USING (entity_id)),
nw AS (SELECT a.query_id, a.domain, NOT EXISTS (SELECT 1 FROM fd b WHERE b.raw IS NOT DISTINCT FROM a.raw AND b.domain = a.domain AND b.query_id < a.query_id) AS is_new FROM fd a)"""


@checked("rerun_new_entities", "fx_queries fx_entities fx_pairs", f"WITH {RERUN} SELECT * FROM nw")
def rerun_new_entities(spark, sf):
    return C.rerun_new_entities(t(spark, sf, "fx_queries"), t(spark, sf, "fx_pairs"), entities(spark, sf))


@checked("run_outcome", CUSES + " fx_pairs", f"""WITH {CANDIDATES}, {RERUN}, nc AS (SELECT query_id, count(*) AS n FROM candidates WHERE pos <= 15 GROUP BY query_id),
rr AS (SELECT q.query_id, coalesce(bool_or(o.query_id < q.query_id), false) AS again FROM fx_queries q LEFT JOIN (SELECT raw, min(query_id) AS query_id FROM fx_queries WHERE query_id IN (SELECT query_id FROM nw) GROUP BY raw) o ON o.raw IS NOT DISTINCT FROM q.raw GROUP BY q.query_id), sv AS (SELECT query_id, count(*) AS saved, count(*) FILTER (is_new) AS new_entities, bool_and(NOT is_new) AS all_known FROM nw GROUP BY query_id)
SELECT query_id, coalesce(saved, 0) AS saved, coalesce(new_entities, 0) AS new_entities, coalesce(all_known, false) AS all_known, CASE WHEN coalesce(n, 0) = 0 THEN 'unsupported' WHEN again AND coalesce(new_entities, 0) = 0 THEN 'no_new_results' ELSE 'completed' END AS outcome
FROM fx_queries JOIN rr USING (query_id) LEFT JOIN nc USING (query_id) LEFT JOIN sv USING (query_id)""")
def run_outcome(spark, sf):
    queries = t(spark, sf, "fx_queries")
    counted = candidates(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    saved = C.rerun_new_entities(queries, t(spark, sf, "fx_pairs"), entities(spark, sf))
    return SV.run_outcome(C.rerun_flags(queries, saved), counted, saved)
