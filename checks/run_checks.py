"""What a whole run leaves in its store, against one statement over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from entitylake.functions.text import join_list
from entitylake.plans.discovery import Inputs
from entitylake.plans.main_run import MainInputs, MainRun
from entitylake.plans.saved_run import Discovery, current_links, save_rows
from entitylake.rules import domain_lists as dl
from entitylake.rules import run_rules as rr
from entitylake.session import stored
from entitylake.sources.store import EntityStore
from entitylake.sources.tables import spread
from entitylake.streaming.run import new_folder

from . import page_checks as pc
from . import sqltext as q
from .derived import spark_table
from .entity_checks import ABOUT, FIRST_URL, PAGE_PROFILES, PROFILE, show_people, stored_profiles
from .plan_checks import inputs as first_round_inputs
from .query_checks import analysis, company_cases, target_sql
from .registry import checked
from .score_checks import ASKED, SCORE_SQL, VERDICT_SQL, entities, matched_sql
from .serve_checks import _CLEAN as CLEAN
from .serve_checks import CANDIDATES, CUSES, DEDUP, VERSIONS_JSON, suggestions

AS_OF, NOW = datetime(2024, 3, 1), "TIMESTAMP '2024-03-01 00:00:00'"
USES = CUSES + " fx_run_pages fx_pairs"


def inputs(spark, sf) -> Inputs:
    given = first_round_inputs(spark, sf)
    given.pages = spread(spark_table(spark, sf, "fx_run_pages"))
    return given


def earlier_links(spark, sf):
    """Links of runs before: the texts and domains of fx_pairs."""
    pairs, queries = spark_table(spark, sf, "fx_pairs"), spark_table(spark, sf, "fx_queries")
    linked = pairs.filter("entity_id % 3 = 0").join(queries.select("query_id", "raw"), "query_id")
    return linked.join(entities(spark, sf).select("entity_id", "domain"), "entity_id").select("query_id", "raw", "domain").distinct()


def new_store(spark, sf) -> EntityStore:
    """A store as earlier runs left it: one row per known domain, and their links."""
    from .serve_checks import R

    store = EntityStore(spark, new_folder(spark), buckets=16)
    store.load(R.dedup_by_domain(entities(spark, sf), [F.col("entity_id")]))
    first = {"score": F.lit(0.5), "is_new": F.lit(True), "linked_at": F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")}
    store.put("links", earlier_links(spark, sf).withColumns(first), "earlier")
    return store


_RUNS: dict[tuple, tuple] = {}


def after(spark, sf, kind, given):
    """(store, run, what it saved) after a run of one kind; one run serves all queries of a session that look at it."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _RUNS:
        store = new_store(spark, sf)
        found = kind(given(spark, sf), store.log("links").select("raw", "domain"))
        saved = stored(found.saved)
        save_rows(store, "march", saved, found.logs, AS_OF)
        _RUNS[key] = store, found, saved
    return _RUNS[key]


def after_run(spark, sf) -> EntityStore:
    return after(spark, sf, Discovery, inputs)[0]


def _on_run_pages(sql: str) -> str:
    return sql.replace("fx_pages", "fx_run_pages")


def shown_logs(store: EntityStore):
    return store.log("crawl_logs").drop("run_id", "created_at").withColumn("pos", F.col("pos").cast("bigint"))


_CB = q.inlist(dl.CANDIDATE_BLOCKLIST)
_OU = pc.OUTLINKS
FRONTIER = f"""{CANDIDATES},
{_on_run_pages(PROFILE)},
{_OU},
hm AS (SELECT domain, min(page_id) AS page_id FROM pg WHERE html <> '' GROUP BY domain),
dp AS (SELECT url, min(page_id) AS page_id FROM pg WHERE html <> '' GROUP BY url),
first_round AS (SELECT query_id, pos, url, links_only, {q.domain('url')} AS domain FROM candidates WHERE pos <= 15),
src AS (SELECT c.query_id, c.pos, dp.page_id FROM first_round c JOIN dp ON dp.url = c.url WHERE links_only
  UNION ALL SELECT c.query_id, c.pos, hm.page_id FROM first_round c JOIN q7 USING (query_id) JOIN hm ON hm.domain = c.domain WHERE NOT links_only AND (q7.is_domain OR q7.intent IN ('competitor_analysis', 'agency_search'))),
fr0 AS (SELECT s.query_id, 'https://' || o.target AS url, min(s.pos * 1000 + o.pos) AS place FROM src s JOIN ou o ON o.page_id = s.page_id WHERE o.target NOT IN {_CB} GROUP BY ALL),
fr1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM fr0),
fr2 AS (SELECT f.query_id, f.url, row_number() OVER (PARTITION BY f.query_id ORDER BY place) AS rank FROM fr1 f LEFT JOIN first_round c ON c.query_id = f.query_id AND c.url = f.url WHERE r <= 20 AND c.url IS NULL),
frontier AS (SELECT query_id, rank, url, {q.domain('url')} AS domain FROM fr2 WHERE rank <= 5),
both_rounds AS (SELECT query_id, 1 AS round, pos, url, links_only, domain FROM first_round UNION ALL SELECT query_id, 2, rank, url, false, domain FROM frontier)"""

SAVED = f"""{FRONTIER},
asked_pairs AS (SELECT c.query_id, c.round, c.pos, e.*, q7.raw, {ASKED}, replace(q7.industry, '_', ' ') AS category
  FROM both_rounds c JOIN entities e ON e.domain = c.domain JOIN hm ON hm.page_id = e.page_id JOIN q7 ON q7.query_id = c.query_id WHERE NOT links_only),
{SCORE_SQL},
{VERDICT_SQL},
{pc.SUBPAGES}, {FIRST_URL}, {ABOUT},
sv0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY round, pos) AS nth FROM verdict WHERE is_valid),
before_links AS (SELECT DISTINCT raw, e.domain FROM fx_pairs p JOIN fx_queries USING (query_id) JOIN fx_entities e USING (entity_id) WHERE entity_id % 3 = 0),
saved AS (SELECT s.* EXCLUDE (founders), a.founders, NOT EXISTS (SELECT 1 FROM sv0 b WHERE b.nth = 1 AND b.raw = s.raw AND b.domain = s.domain AND b.query_id < s.query_id)
    AND NOT EXISTS (SELECT 1 FROM before_links l WHERE l.raw = s.raw AND l.domain = s.domain) AS is_new
  FROM sv0 s JOIN about_people a ON a.page_id = s.page_id WHERE nth = 1)"""


@checked("discovery_secondary", USES, f"""WITH {SAVED} SELECT f.query_id, f.rank, f.url, s.domain IS NOT NULL AS saved, s.name, s.is_new
FROM frontier f LEFT JOIN saved s ON s.query_id = f.query_id AND s.round = 2 AND s.pos = f.rank""")
def discovery_secondary(spark, sf):
    _, run, saved = after(spark, sf, Discovery, inputs)
    second = saved.filter("round = 2").select("query_id", F.col("pos").alias("rank"), F.lit(True).alias("hit"), "name", "is_new")
    found = run.frontier.join(second, ["query_id", "rank"], "left")
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "url", F.coalesce("hit", F.lit(False)).alias("saved"), "name", "is_new")


_DATA = "name, description, services, founders, linkedin, twitter, technologies, locations, emails, phones, confidence, relevance, category, source"
_WAS = _DATA.replace("founders", "'' AS founders").replace("twitter", "CAST(NULL AS VARCHAR) AS twitter")
TIMELINE = f"""{SAVED}, {DEDUP},
versions AS (SELECT 0 AS step, CAST(NULL AS BIGINT) AS query_id, domain, {_WAS}, first_seen, last_seen, is_valid FROM de WHERE rn = 1
  UNION ALL SELECT 1, query_id, domain, {_DATA.replace('source', 'url AS source')}, NULL, {NOW}, true FROM saved)"""


@checked("discovery_entities", USES, f"""WITH {TIMELINE}, ln AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY step DESC, query_id DESC) AS r, coalesce(min(first_seen) OVER (PARTITION BY domain), {NOW}) AS seen_first FROM versions)
SELECT domain, {_DATA}, seen_first AS first_seen, last_seen, is_valid FROM ln WHERE r = 1""")
def discovery_entities(spark, sf):
    rows = after_run(spark, sf).entities()
    lists = {c: join_list(F.col(c)) for c in ("services", "technologies", "locations", "emails", "phones")}
    shown = rows.withColumns(lists).withColumn("founders", F.coalesce(show_people(F.col("founders")), F.lit("")))
    return shown.select("domain", *_DATA.split(", "), "first_seen", "last_seen", "is_valid")


_FIELDS = ("name", "description", "services", "linkedin", "emails", "category")


def _text(field: str) -> str:
    return f"CAST(to_json({q.as_list(field)}) AS VARCHAR)" if field in ("services", "emails") else field


_W = "OVER (PARTITION BY domain ORDER BY step, query_id)"
_CELLS = " UNION ALL ".join(f"SELECT domain, query_id, step, '{f}' AS field, lag({_text(f)}) {_W} AS old_value, {_text(f)} AS new_value, lag(step) {_W} AS before FROM versions" for f in _FIELDS)


@checked("discovery_changes", USES, f"""WITH {TIMELINE}, cells AS ({_CELLS})
SELECT domain, query_id, field, old_value, new_value, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'modified' END AS change_type
FROM cells WHERE step = 1 AND before IS NOT NULL AND old_value IS DISTINCT FROM new_value""")
def discovery_changes(spark, sf):
    return after_run(spark, sf).log("changes").select("domain", "query_id", "field", "old_value", "new_value", "change_type")


@checked("discovery_snapshots", USES, f"""WITH {TIMELINE}, hashed AS (SELECT *, md5(CAST({VERSIONS_JSON} AS VARCHAR)) AS hash FROM (SELECT *, {q.as_list('services')} AS string_list, {q.as_list('emails')} AS email_list FROM versions)),
lagged AS (SELECT *, lag(hash) {_W} AS p FROM hashed)
SELECT domain, query_id FROM lagged WHERE step = 1 AND (p IS NULL OR p <> hash)""")
def discovery_snapshots(spark, sf):
    return after_run(spark, sf).log("snapshots").select("domain", "query_id")


@checked("discovery_links", USES, f"""WITH {SAVED},
el AS (SELECT DISTINCT p.query_id, e.domain FROM fx_pairs p JOIN fx_queries USING (query_id) JOIN fx_entities e USING (entity_id) WHERE entity_id % 3 = 0)
SELECT coalesce(s.query_id, el.query_id) AS query_id, coalesce(s.domain, el.domain) AS domain, coalesce(s.relevance, 0.5) AS score, el.domain IS NOT NULL OR s.is_new AS is_new
FROM saved s FULL JOIN el ON el.query_id = s.query_id AND el.domain = s.domain""")
def discovery_links(spark, sf):
    return current_links(after_run(spark, sf)).select("query_id", "domain", "score", "is_new")


@checked("discovery_logs", USES, f"""WITH {SAVED},
cap AS (SELECT 'site ' || {q.domain('url')} AS of, html <> '' AS f FROM fx_run_pages UNION ALL SELECT 'page ' || url, html <> '' FROM fx_run_pages), kn AS (SELECT of, bool_or(f) AS f FROM cap GROUP BY of),
st AS (SELECT b.*, kn.f, CASE WHEN coalesce(kn.f, false) THEN CASE WHEN links_only THEN 'skipped' ELSE 'success' END ELSE 'failed' END AS status,
  CASE WHEN kn.f IS NULL THEN {q.lit(rr.NOT_CAPTURED)} WHEN NOT kn.f THEN {q.lit(rr.NO_CONTENT)} WHEN links_only THEN {q.lit(rr.DIRECTORY_ONLY)} END AS error
  FROM both_rounds b LEFT JOIN kn ON kn.of = CASE WHEN links_only THEN 'page ' || b.url ELSE 'site ' || b.domain END),
ag AS (SELECT query_id, count(*) FILTER (is_new) AS fresh FROM saved GROUP BY query_id), nc AS (SELECT query_id, count(*) AS n FROM first_round GROUP BY query_id),
oc AS (SELECT q.query_id, q.raw, coalesce(nc.n, 0) AS n, coalesce(ag.fresh, 0) AS fresh, EXISTS (SELECT 1 FROM before_links l WHERE l.raw = q.raw) OR EXISTS (SELECT 1 FROM saved s WHERE s.raw = q.raw AND s.query_id < q.query_id) AS again
  FROM fx_queries q LEFT JOIN nc USING (query_id) LEFT JOIN ag USING (query_id))
SELECT query_id, url, round, pos, 1 AS event, 'crawling' AS status, CAST(NULL AS VARCHAR) AS error, 0 AS entities_found FROM both_rounds
UNION ALL SELECT s.query_id, s.url, s.round, s.pos, 2, s.status, s.error, CASE WHEN v.is_new AND s.round = 1 THEN 1 ELSE 0 END FROM st s LEFT JOIN saved v ON v.query_id = s.query_id AND v.round = s.round AND v.pos = s.pos
UNION ALL SELECT query_id, {q.lit(rr.UNSUPPORTED_URL)}, 0, 0, 1, 'unsupported', replace({q.lit(rr.UNSUPPORTED_ERROR)}, '{{}}', raw), 0 FROM oc WHERE n = 0
UNION ALL SELECT query_id, {q.lit(rr.NO_NEW_URL)}, 0, 0, 1, 'no_new_results', {q.lit(rr.NO_NEW_ERROR)}, 0 FROM oc WHERE n > 0 AND again AND fresh = 0""")
def discovery_logs(spark, sf):
    return shown_logs(after_run(spark, sf))


# --- the main path ------------------------------------------------------------------------------

_SBL = q.inlist(dl.SEARCH_BLOCKLIST)
_PIK = r"regexp_replace(lower(t.profile_industry), '[\s-]', '_', 'g')"
_LOCK = f"CASE WHEN {_PIK} IN {q.inlist(dl.INDUSTRY_KEYS)} THEN {_PIK} " + " ".join(f"WHEN {_PIK} = {q.lit(k)} THEN {q.lit(v)}" for k, v in dl.INDUSTRY_ALIASES.items()) + " END"
_TARGET = company_cases(target_sql("raw", "literal"), dl.KNOWN_COMPANY_DOMAINS)
_HOST = f"regexp_replace({q.host('link')}, '^www\\.', '')"
MAIN = f"""{analysis('fx_queries')},
{_on_run_pages(PAGE_PROFILES)},
{pc.SUBPAGES}, {FIRST_URL}, {ABOUT},
merged_profiles AS (SELECT coalesce(s.domain, p.domain) AS domain, s.industry, CASE WHEN coalesce(s.primary_services, '') <> '' THEN s.primary_services ELSE coalesce(p.prim, '') END AS primary_services,
  coalesce(s.business_model, p.business_model, 'unknown') AS business_model FROM fx_profiles s FULL OUTER JOIN page_profiles p ON s.domain = p.domain),
tq AS (SELECT query_id, industry AS profile_industry FROM (SELECT query_id, {_TARGET} AS d FROM fx_queries) JOIN merged_profiles ON d = domain),
sug AS (SELECT * FROM fx_suggestions WHERE confidence >= 0.5), wi AS (SELECT query_id, arg_min(industry, pos) AS w FROM fx_web WHERE industry IS NOT NULL GROUP BY query_id),
ctx AS (SELECT q7.* EXCLUDE (industry), coalesce({_LOCK}, q7.industry, CASE WHEN t.profile_industry IS NULL THEN sug.industry END, w) AS industry
  FROM q7 LEFT JOIN tq t ON t.query_id = q7.query_id LEFT JOIN sug ON sug.query_id = q7.query_id LEFT JOIN wi ON wi.query_id = q7.query_id),
lay0 AS (SELECT query_id, 1 AS layer, unnest(l) AS d, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT query_id, list_concat(string_split(competitors, '|'), CASE WHEN company <> '' THEN [company] ELSE [] END) AS l FROM sug)
  UNION ALL SELECT query_id, 2, domain, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM fx_web) WHERE r <= 25),
lay2 AS (SELECT query_id, layer, pos, {CLEAN.format('d')} AS domain FROM lay0 WHERE contains({CLEAN.format('d')}, '.') AND {CLEAN.format('d')} NOT IN {_SBL}),
lay3 AS (SELECT * FROM lay2 UNION ALL SELECT query_id, 99, 0, 'brand' || CAST(query_id % 9 + 1 AS STRING) || '.com' FROM fx_queries WHERE query_id NOT IN (SELECT query_id FROM lay2)),
lay4 AS (SELECT query_id, domain, min((layer, pos)) AS b FROM lay3 GROUP BY query_id, domain),
mc AS (SELECT query_id, domain, row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], domain) AS pos FROM lay4 QUALIFY pos <= 18),
hm AS (SELECT domain, min(page_id) AS page_id FROM pg WHERE html <> '' GROUP BY domain),
pl AS (SELECT page_id, link, min(pos) AS lp FROM links WHERE NOT internal AND {q.host('link')} IS NOT NULL AND {_HOST} NOT IN {_SBL} GROUP BY page_id, link),
pt AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lp) AS r FROM pl QUALIFY r <= 4),
ml0 AS (SELECT mc.query_id, pt.link, min(mc.pos * 1000 + r) AS place FROM mc JOIN hm USING (domain) JOIN pt USING (page_id) GROUP BY ALL),
ml1 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place, link) AS pos, {q.domain('link')} AS domain FROM ml0 QUALIFY pos <= 4),
ma AS (SELECT query_id, 1 AS round, pos, domain FROM mc UNION ALL SELECT query_id, 2, pos, domain FROM ml1),
sx0 AS (SELECT url AS subpage_url, arg_min(body_text, page_id) AS st FROM bodies GROUP BY url),
site AS (SELECT e.*, substr(CASE WHEN st <> '' THEN substr(st, 1, 3000) || chr(10) || chr(10) || e.body_text ELSE e.body_text END, 1, 3000) AS match_text
  FROM entities e LEFT JOIN (SELECT * FROM subpages WHERE kind = 'services') s ON s.page_id = e.page_id LEFT JOIN sx0 USING (subpage_url)),
asked_pairs AS (SELECT ma.query_id, ma.round, ma.pos, ma.round * 1000 + ma.pos AS entity_id, e.*, q7.raw, {ASKED}, replace(q7.industry, '_', ' ') AS category
  FROM ma JOIN site e ON e.domain = ma.domain JOIN hm ON hm.page_id = e.page_id JOIN ctx q7 ON q7.query_id = ma.query_id),
{SCORE_SQL},
{VERDICT_SQL},
{matched_sql('merged_profiles', 'v.match_text', 'body_text')},
ac AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY round, pos) AS nth FROM tiered WHERE rejection_reason IS NULL),
before_links AS (SELECT DISTINCT raw, e.domain FROM fx_pairs p JOIN fx_queries USING (query_id) JOIN fx_entities e USING (entity_id) WHERE entity_id % 3 = 0),
saved AS (SELECT s.* EXCLUDE (founders), a.founders, NOT EXISTS (SELECT 1 FROM ac b WHERE b.nth = 1 AND b.raw = s.raw AND b.domain = s.domain AND b.query_id < s.query_id)
    AND NOT EXISTS (SELECT 1 FROM before_links l WHERE l.raw = s.raw AND l.domain = s.domain) AS is_new,
  row_number() OVER (PARTITION BY s.query_id ORDER BY match_score DESC, confidence DESC, domain) AS place FROM ac s JOIN about_people a ON a.page_id = s.page_id WHERE nth = 1)"""
MAIN_USES = "fx_queries fx_entities fx_suggestions fx_web fx_profiles fx_run_pages fx_pairs"
_PLACED = "CASE WHEN matched_services <> '' THEN 'Shares ' || len(string_split(matched_services, '|')) || ' key service' || CASE WHEN contains(matched_services, '|') THEN 's' ELSE '' END || ': ' || array_to_string(list_slice(string_split(matched_services, '|'), 1, 3), ', ') END"


def main_inputs(spark, sf) -> MainInputs:
    broader = spark_table(spark, sf, "fx_queries").select("query_id", F.lit(0).alias("pos"), F.concat(F.lit("brand"), (F.col("query_id") % 9 + 1).cast("string"), F.lit(".com")).alias("domain"))
    pages = spread(spark_table(spark, sf, "fx_run_pages"))
    return MainInputs(spark_table(spark, sf, "fx_queries"), pages, suggestions(spark, sf), spark_table(spark, sf, "fx_web"), broader, stored_profiles(spark, sf))


def after_main_run(spark, sf) -> EntityStore:
    return after(spark, sf, MainRun, main_inputs)[0]


@checked("main_run_saved", MAIN_USES, f"""WITH {MAIN} SELECT query_id, round, pos, place, domain, name, founders, match_score, confidence, relevance, category, is_new,
CASE WHEN profile_domain IS NOT NULL THEN competitor_tier END AS competitor_tier, {_PLACED} AS positioning FROM saved""")
def main_run_saved(spark, sf):
    saved = after(spark, sf, MainRun, main_inputs)[2]
    shown = saved.withColumns({"founders": show_people(F.col("founders")), "pos": F.col("pos").cast("bigint"), "place": F.col("place").cast("bigint")})
    return shown.drop("raw", "asked_at", *[c for c in saved.columns if c in ("description", "services", "linkedin", "twitter", "technologies", "locations", "emails", "phones", "source", "meta_title", "meta_description")])


@checked("main_run_entities", MAIN_USES, f"""WITH {MAIN}, {DEDUP},
last_saved AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY query_id DESC) AS r, {_PLACED} AS shares FROM saved)
SELECT coalesce(s.domain, d.domain) AS domain, CASE WHEN s.domain IS NULL THEN d.name ELSE s.name END AS name, CASE WHEN s.domain IS NULL THEN d.relevance ELSE s.relevance END AS relevance,
  CASE WHEN s.profile_domain IS NOT NULL THEN s.competitor_tier END AS competitor_tier, s.shares AS positioning, coalesce(d.first_seen, {NOW}) AS first_seen, CASE WHEN s.domain IS NULL THEN d.last_seen ELSE {NOW} END AS last_seen
FROM (SELECT * FROM last_saved WHERE r = 1) s FULL JOIN (SELECT * FROM de WHERE rn = 1) d ON d.domain = s.domain""")
def main_run_entities(spark, sf):
    return after_main_run(spark, sf).entities().select("domain", "name", "relevance", "competitor_tier", "positioning", "first_seen", "last_seen")


@checked("main_run_logs", MAIN_USES, f"""WITH {MAIN}, ag AS (SELECT query_id, count(*) FILTER (is_new) AS fresh FROM saved GROUP BY query_id),
oc AS (SELECT q.query_id, coalesce(ag.fresh, 0) AS fresh, EXISTS (SELECT 1 FROM before_links l WHERE l.raw = q.raw) OR EXISTS (SELECT 1 FROM saved s WHERE s.raw = q.raw AND s.query_id < q.query_id) AS again
  FROM fx_queries q LEFT JOIN ag USING (query_id))
SELECT query_id, 'https://' || domain AS url, round, pos, 'success' AS status, CAST(NULL AS VARCHAR) AS error, CAST(is_new AS INTEGER) AS entities_found FROM saved
UNION ALL SELECT query_id, 'https://' || domain, round, pos, 'skipped', rejection_reason, 0 FROM tiered WHERE rejection_reason IS NOT NULL
UNION ALL SELECT query_id, {q.lit(rr.NO_NEW_URL)}, 0, 0, 'no_new_results', {q.lit(rr.NO_NEW_ERROR)}, 0 FROM oc WHERE again AND fresh = 0""")
def main_run_logs(spark, sf):
    return shown_logs(after_main_run(spark, sf)).drop("event")
