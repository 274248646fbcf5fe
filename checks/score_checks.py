"""Scoring, verdict, matching and rank queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from entitylake.functions.text import join_list, split_list
from entitylake.operators import candidates as C
from entitylake.operators import entities as E
from entitylake.operators import matching as M
from entitylake.operators import pages as P
from entitylake.operators import queries as Q
from entitylake.operators import scoring as SC
from entitylake.operators import serve as SV
from entitylake.operators.ordering import first_per_key
from entitylake.plans import competitors as CO
from entitylake.rules import domain_lists as dl
from entitylake.rules import validation_rules as vr
from entitylake.session import stored
from entitylake.sources.tables import spread

from . import page_checks as pc
from . import sqltext as q
from .derived import spark_table
from .entity_checks import stored_profiles
from .query_checks import analysis, company_cases, target_sql
from .registry import checked

AS_OF = datetime(2024, 2, 1)
LISTS = ("services", "technologies", "locations", "emails", "phones")


def entities(spark, sf):
    return spark_table(spark, sf, "fx_entities").withColumns({c: split_list(F.col(c)) for c in LISTS})


def asked(spark, sf):
    found = Q.analyze_queries(spark_table(spark, sf, "fx_queries"))
    return found.select(
        "query_id", "raw", F.col("intent").alias("q_intent"), F.col("industry").alias("q_industry"),
        F.col("keywords").alias("q_keywords"), F.col("location").alias("q_location"),
    )


def candidates(spark, sf):
    return entities(spark, sf).drop("confidence", "relevance", "is_valid")


def pairs(spark, sf):
    links = spark_table(spark, sf, "fx_pairs")
    return links.join(asked(spark, sf), "query_id").join(SC.with_entity_signals(candidates(spark, sf)), "entity_id")


def validated(spark, sf):
    return SC.validate_entities(SC.score_entities(pairs(spark, sf)))


def pt(condition, weight):
    return f"CASE WHEN {condition} THEN {weight}::DOUBLE ELSE 0.0::DOUBLE END"


CONFIDENCE = "least(1.0::DOUBLE, " + " + ".join([
    pt("length(name) > 2", 0.15), pt("contains(domain, '.')", 0.15), pt("length(description) > 50", 0.15), pt("services <> ''", 0.15),
    pt("technologies <> ''", 0.1), pt("linkedin <> ''", 0.1), pt("emails <> ''", 0.1), pt("locations <> ''", 0.1)]) + ")"


def count_terms(terms):
    return f"len(list_filter({q.items(terms)}, lambda p: contains(txt, p)))"


ASKED = "intent AS q_intent, q7.industry AS q_industry, keywords AS q_keywords, q7.location AS q_location"
PAIRS = f"""asked_pairs AS (SELECT p.query_id, e.* EXCLUDE (confidence, relevance, is_valid), q7.raw, {ASKED}
  FROM fx_pairs p JOIN fx_entities e USING (entity_id) JOIN q7 ON q7.query_id = p.query_id)"""
SCORE_SQL = f"""pb AS (SELECT *, {CONFIDENCE} AS confidence,
  lower(name || ' ' || coalesce(description, '') || ' ' || coalesce(category, '') || ' ' || replace(services, '|', ' ') || ' ' || coalesce(meta_title, '') || ' ' || coalesce(meta_description, '')) AS txt,
  replace(q_industry, '_', ' ') AS slug, regexp_replace(lower(category), '\\s+', ' ', 'g') AS cat,
  list_filter(string_split(q_keywords, '|'), lambda k: length(k) > 2 AND NOT list_contains({q.items(vr.OPERATOR_WORDS)}, k)) AS kws FROM asked_pairs),
pd2 AS (SELECT *, CASE WHEN q_industry IS NULL THEN 0.3::DOUBLE ELSE len(list_filter(string_split(slug, ' '), lambda w: contains(txt, w)))::DOUBLE / len(string_split(slug, ' ')) * 0.35::DOUBLE
    + {pt("category <> '' AND (contains(cat, split_part(slug, ' ', 1)) OR contains(slug, split_part(cat, ' ', 1)))", 0.35)} END
  + CASE WHEN len(kws) > 0 THEN len(list_filter(kws, lambda k: contains(txt, k)))::DOUBLE / len(kws) * 0.3::DOUBLE ELSE 0.2::DOUBLE END
  + CASE WHEN q_location IS NULL THEN 0.1::DOUBLE ELSE {pt("contains(txt, lower(q_location))", 0.15)} END AS r0, {count_terms(vr.AGENCY_PHRASES)} AS ah, {count_terms(vr.TOOL_PHRASES)} AS th FROM pb),
scored AS (SELECT *, least(1.0::DOUBLE, greatest(0.05::DOUBLE, CASE WHEN q_intent IN {q.inlist(vr.SERVICE_INTENTS)}
  THEN r0 + CASE WHEN ah >= 2 THEN 0.15::DOUBLE WHEN ah >= 1 THEN 0.07::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN th >= 3 THEN 0.35::DOUBLE WHEN th >= 2 THEN 0.2::DOUBLE WHEN th >= 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END ELSE r0 END)) AS relevance FROM pd2)"""
SCORED = f"{analysis('fx_queries')},\n{PAIRS},\n{SCORE_SQL}"

USES = "fx_queries fx_entities fx_pairs"


@checked("confidence_score", "fx_entities", f"SELECT entity_id, {CONFIDENCE} AS confidence FROM fx_entities")
def confidence_score(spark, sf):
    return entities(spark, sf).select("entity_id", SC.confidence_score().alias("confidence"))


@checked("relevance_score", USES, f"WITH {SCORED} SELECT query_id, entity_id, relevance FROM scored")
def relevance_score(spark, sf):
    return SC.score_entities(pairs(spark, sf)).select("query_id", "entity_id", "relevance")


_SPAM = f"list_filter({q.items(vr.SPAM_TERMS)}, lambda t: contains(lower(spam_text), t))"


@checked("spam_flags", "fx_entities", f"""WITH al AS (SELECT 'entity' AS kind, entity_id AS id, name || ' ' || coalesce(description, '') AS spam_text FROM fx_entities UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, array_to_string({_SPAM}, ', ') AS spam FROM al WHERE len({_SPAM}) > 0""")
def spam_flags(spark, sf):
    names = entities(spark, sf).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.concat_ws(" ", "name", F.coalesce("description", F.lit(""))).alias("text"))
    docs = spread(spark_table(spark, sf, "documents")).select(F.lit("document"), "doc_id", "text")
    found = names.union(docs).select("kind", "id", F.array_join(SC.spam_terms(F.col("text")), ", ").alias("spam"))
    return found.filter("spam <> ''")


@checked("tool_agency_signals", "fx_entities", f"""WITH al AS (SELECT 'entity' AS kind, entity_id AS id, coalesce(description, '') || ' ' || coalesce(meta_description, '') || ' ' || coalesce(meta_title, '') AS t FROM fx_entities UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, {q.hits('t', vr.TOOL_SIGNALS)} AS tool, {q.hits('t', vr.AGENCY_SIGNALS)} AS agency FROM al""")
def tool_agency_signals(spark, sf):
    own = entities(spark, sf).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), SC.signal_text().alias("t"))
    docs = spread(spark_table(spark, sf, "documents")).select(F.lit("document"), "doc_id", "text")
    return own.union(docs).select("kind", "id", SC.tool_signal_count(F.col("t")).alias("tool"), SC.agency_signal_count(F.col("t")).alias("agency"))


_SENS = f"coalesce(q_industry IN {q.inlist(vr.SERVICE_INDUSTRIES)}, false)"
_DT = "coalesce(description, '') || ' ' || coalesce(meta_description, '') || ' ' || coalesce(meta_title, '')"


def _listed(entries):
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in entries) + "], lambda x: x IS NOT NULL)"


VERDICT_SQL = f"""v1 AS (SELECT *, domain IN {q.inlist(dl.VERDICT_BLOCKLIST)} AS blocked, list_filter({q.items(vr.SPAM_TERMS)}, lambda t: contains(lower(name || ' ' || coalesce(description, '')), t)) AS spam,
  length(name) < 2 AS no_name, NOT contains(domain, '.') AS bad_domain, q_intent IN {q.inlist(vr.SERVICE_INTENTS)} OR (q_intent = 'competitor_analysis' AND {_SENS}) AS svcq, {_SENS} AS sens,
  {q.hits(_DT, vr.TOOL_SIGNALS).replace(_DT, 'dt')} AS tool, {q.hits(_DT, vr.AGENCY_SIGNALS).replace(_DT, 'dt')} AS agency FROM (SELECT *, {_DT} AS dt FROM scored)),
v2 AS (SELECT *, NOT (blocked OR len(spam) > 0 OR no_name OR bad_domain) AS clean FROM v1),
v3 AS (SELECT *, clean AND svcq AND tool >= 2 AND agency = 0 AS pure_tool, clean AND svcq AND tool >= 3 AND NOT (tool >= 2 AND agency = 0) AS strong_tool, clean AND NOT svcq AND sens AND tool >= 3 AS soft_tool FROM v2),
v4 AS (SELECT *, clean AND NOT pure_tool AND NOT strong_tool AND confidence >= 0.2::DOUBLE AND relevance >= 0.1::DOUBLE AS is_valid FROM v3),
verdict AS (SELECT *, {_listed([
    ("blocked", "'Review/directory site — not a company entity'"), ("len(spam) > 0", "'Spam indicators found: ' || array_to_string(spam, ', ')"), ("no_name", "'Missing company name'"),
    ("bad_domain", "'Invalid domain'"), ("pure_tool", "'SaaS tool/platform, not a service agency (tool signals: ' || tool || ')'"),
    ("strong_tool", "'Self-serve platform detected (' || tool || ' tool signals override agency signals)'"), ("confidence < 0.2::DOUBLE", "'Confidence score too low'"),
    ("relevance < 0.1::DOUBLE", "'Not relevant to query'"), ("is_valid", "'Passed all validation checks'")])} AS reasons, {_listed([
    ("blocked", "'irrelevant'"), ("len(spam) > 0", "'spam'"), ("no_name", "'incomplete'"), ("bad_domain", "'incomplete'"), ("pure_tool OR strong_tool", "'tool_not_agency'"),
    ("soft_tool", "'possible_tool_not_agency'"), ("confidence < 0.2::DOUBLE", "'low_quality'"), ("relevance < 0.1::DOUBLE", "'irrelevant'"),
    ("is_valid AND confidence >= 0.8::DOUBLE AND relevance >= 0.7::DOUBLE", "'high_confidence'"), ("is_valid", "'verified'")])} AS flags FROM v4)"""
VERDICT = f"{SCORED},\n{VERDICT_SQL}"


@checked("entity_validation", USES, f"WITH {VERDICT} SELECT query_id, entity_id, confidence, relevance, is_valid, array_to_string(reasons, '|') AS reasons, array_to_string(flags, '|') AS flags FROM verdict")
def entity_validation(spark, sf):
    return validated(spark, sf).select(
        "query_id", "entity_id", "confidence", "relevance", "is_valid", join_list(F.col("reasons")).alias("reasons"), join_list(F.col("flags")).alias("flags")
    )


@checked("review_queue", USES, f"WITH {VERDICT} SELECT query_id, entity_id, confidence FROM verdict WHERE is_valid AND q_intent = 'agency_search' AND confidence < 0.7::DOUBLE AND description <> ''")
def review_queue(spark, sf):
    return SC.review_queue(validated(spark, sf).filter("is_valid")).select("query_id", "entity_id", "confidence")


# --- matching -----------------------------------------------------------------------------------


def match_pairs(spark, sf):
    """Linked entities as candidates of the company a query is about."""
    return CO.matched_candidates(spark_table(spark, sf, "fx_pairs"), candidates(spark, sf), asked(spark, sf), stored_profiles(spark, sf))


_WORDS = rf"list_filter(string_split_regex(regexp_replace(lower(service), '[^a-z0-9/ ]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({q.items(vr.SERVICE_STOP_WORDS)}, w))"
def phrases_sql(profiles="fx_profiles"):
    return f"""sx1 AS (SELECT domain, unnest(string_split(primary_services, '|')) AS service, generate_subscripts(string_split(primary_services, '|'), 1) AS pos, len(string_split(primary_services, '|')) AS n FROM {profiles} WHERE primary_services <> ''),
sx2 AS (SELECT *, {_WORDS} AS words FROM sx1),
phrases AS (SELECT domain, service, pos, n, unnest(words) AS phrase FROM sx2 UNION ALL
  SELECT domain, service, pos, n, words[i] || ' ' || words[i + 1] AS phrase FROM (SELECT *, unnest(range(1, len(words))) AS i FROM sx2))"""


PHRASES = phrases_sql()
_HIT = r"CASE WHEN contains(phrase, ' ') THEN contains(corpus, phrase) ELSE regexp_matches(corpus, '\b' || phrase || '\b') END"


def _align(a, b, unknown):
    return f"CASE WHEN {unknown} THEN 0.5::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def matched_sql(profiles="fx_profiles", text="coalesce(v.description, '')", model_text="bt"):
    return f"""{phrases_sql(profiles)},
tg0 AS (SELECT query_id, {company_cases(target_sql('raw', 'literal'), dl.KNOWN_COMPANY_DOMAINS)} AS pdom FROM fx_queries),
tg1 AS (SELECT query_id, pdom AS profile_domain, primary_services, business_model AS profile_model, industry AS profile_industry FROM tg0 JOIN {profiles} ON pdom = domain),
m1 AS (SELECT v.*, {text} AS bt, t.profile_domain, t.primary_services, t.profile_model, t.profile_industry, k.primary_services AS stored_services, k.business_model AS stored_model, k.industry AS stored_industry
  FROM verdict v LEFT JOIN tg1 t ON t.query_id = v.query_id LEFT JOIN fx_profiles k ON k.domain = v.domain),
m2 AS (SELECT *, lower(replace(CASE WHEN coalesce(stored_services, '') <> '' THEN stored_services ELSE services END, '|', ' ') || ' ' || bt) AS corpus FROM m1),
m3 AS (SELECT query_id, entity_id, string_agg(service, '|' ORDER BY pos) AS matched, count(*)::DOUBLE / any_value(n) AS share FROM (
  SELECT query_id, entity_id, p.service, p.pos, p.n FROM m2 JOIN phrases p ON p.domain = m2.profile_domain WHERE {_HIT} GROUP BY ALL) GROUP BY query_id, entity_id),
matched AS (SELECT m2.*, coalesce(matched, '') AS matched_services, CASE WHEN coalesce(primary_services, '') = '' THEN 0.5::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) * 0.6::DOUBLE
  + {_align('profile_model', "coalesce(stored_model, 'unknown')", "profile_model = 'unknown' OR coalesce(stored_model, 'unknown') = 'unknown'")} * 0.2::DOUBLE
  + {_align('profile_industry', 'stored_industry', 'profile_industry IS NULL OR stored_industry IS NULL')} * 0.2::DOUBLE END AS match_score,
  coalesce(stored_model, CASE WHEN {q.hits(model_text, E.rules.MATCHER_TOOL_SIGNALS)} >= 2 THEN 'tool' WHEN regexp_matches({model_text}, {q.i(E.rules.MATCHER_AGENCY)}) THEN 'agency' WHEN regexp_matches({model_text}, {q.i(E.rules.BRAND_SIGNAL)}) THEN 'brand' ELSE 'unknown' END) AS business_model
  FROM m2 LEFT JOIN m3 USING (query_id, entity_id)),
filtered AS (SELECT *, CASE WHEN NOT is_valid AND list_contains(flags, 'tool_not_agency') THEN 'tool' WHEN NOT is_valid THEN 'low_score' WHEN {_SENS} AND business_model = 'tool' THEN 'tool'
    WHEN coalesce(primary_services, '') <> '' AND match_score < 0.1::DOUBLE THEN 'no_match' END AS reason_class,
  CASE WHEN NOT is_valid AND list_contains(flags, 'tool_not_agency') THEN 'SaaS tool — not a service competitor' WHEN NOT is_valid THEN reasons[1] WHEN {_SENS} AND business_model = 'tool' THEN 'Self-serve tool — not an agency competitor'
    WHEN coalesce(primary_services, '') <> '' AND match_score < 0.1::DOUBLE THEN 'No service overlap with query company profile' END AS rejection_reason
  FROM matched WHERE profile_domain IS NULL OR domain <> profile_domain),
tiered AS (SELECT *, CASE WHEN match_score >= 0.6::DOUBLE AND business_model = profile_model THEN 'direct' WHEN match_score >= 0.2::DOUBLE THEN 'partial' ELSE 'broader' END AS competitor_tier FROM filtered)"""


MATCHED = f"{VERDICT},\n{matched_sql()}"
MUSES = USES + " fx_profiles"


@checked("match_score", MUSES, f"WITH {MATCHED} SELECT query_id, entity_id, matched_services, match_score FROM matched")
def match_score(spark, sf):
    return match_pairs(spark, sf).select("query_id", "entity_id", join_list(F.col("matched_services")).alias("matched_services"), "match_score")


@checked("service_overlap", "fx_pages fx_profiles", f"""WITH {pc.DOMAINS}, {pc.LINKS}, {pc.BODY}, {pc.OUTLINKS}, {PHRASES},
pp2 AS (SELECT DISTINCT page_id, target AS domain FROM ou WHERE target IN (SELECT domain FROM fx_profiles)),
hh AS (SELECT page_id, domain, service, pos FROM pp2 JOIN (SELECT page_id, ' ' || lower(body_text) AS corpus FROM bodies) USING (page_id) JOIN phrases USING (domain) WHERE {_HIT} GROUP BY ALL)
SELECT page_id, domain, coalesce(string_agg(service, '|' ORDER BY pos), '') AS matched_services FROM pp2 LEFT JOIN hh USING (page_id, domain) GROUP BY page_id, domain""")
def service_overlap(spark, sf):
    raw = pc.pages(spark, sf)
    linked = P.homepage_outlinks(P.page_links(raw), []).select("page_id", F.col("target").alias("domain")).distinct()
    wanted = stored_profiles(spark, sf).select("domain", "primary_services")
    text = P.with_body_text(raw).select("page_id", "body_text")
    rows = linked.join(wanted, "domain").join(text, "page_id")
    matched = M.matched_services(F.col("primary_services"), F.array().cast("array<string>"), F.col("body_text"))
    return rows.select("page_id", "domain", join_list(matched).alias("matched_services"))


def filtered(spark, sf):
    return M.relevancy_filter(match_pairs(spark, sf))


@checked("relevancy_filter", MUSES, f"WITH {MATCHED} SELECT query_id, entity_id, rejection_reason IS NULL AS accepted, rejection_reason, reason_class FROM filtered")
def relevancy_filter(spark, sf):
    return filtered(spark, sf).select("query_id", "entity_id", "accepted", "rejection_reason", "reason_class")


@checked("rejection_summary", MUSES, f"""WITH {MATCHED} SELECT query_id, count(*) FILTER (reason_class IS NULL) AS accepted, count(*) FILTER (reason_class = 'tool') AS rejected_tool,
count(*) FILTER (reason_class = 'low_score') AS rejected_low_score, count(*) FILTER (reason_class = 'no_match') AS rejected_no_match FROM filtered GROUP BY query_id""")
def rejection_summary(spark, sf):
    return SV.rejection_summary(filtered(spark, sf))


def tiered(spark, sf):
    return filtered(spark, sf).filter("accepted").withColumn("competitor_tier", F.when(F.col("profile_domain").isNotNull(), M.competitor_tier()))


@checked("competitor_tier", MUSES, f"WITH {MATCHED} SELECT query_id, entity_id, competitor_tier FROM tiered WHERE rejection_reason IS NULL AND profile_domain IS NOT NULL")
def competitor_tier(spark, sf):
    return tiered(spark, sf).filter("profile_domain IS NOT NULL").select("query_id", "entity_id", "competitor_tier")


@checked("tier_groups", MUSES, f"""WITH {MATCHED}, tt AS (SELECT query_id, CASE WHEN profile_domain IS NULL THEN 'untiered' ELSE competitor_tier END AS tier FROM tiered WHERE rejection_reason IS NULL)
SELECT query_id, tier, CASE tier WHEN 'direct' THEN 1 WHEN 'partial' THEN 2 WHEN 'broader' THEN 3 ELSE 4 END AS tier_rank, count(*) AS n FROM tt GROUP BY query_id, tier""")
def tier_groups(spark, sf):
    return SV.tier_groups(tiered(spark, sf))


@checked("positioning_text", MUSES, f"""WITH {MATCHED} SELECT query_id, entity_id, 'Shares ' || len(string_split(matched_services, '|')) || ' key service' || CASE WHEN contains(matched_services, '|') THEN 's' ELSE '' END || ': ' ||
array_to_string(list_slice(string_split(matched_services, '|'), 1, 3), ', ') AS positioning FROM matched WHERE matched_services <> ''""")
def positioning_text(spark, sf):
    found = match_pairs(spark, sf).select("query_id", "entity_id", M.positioning_text(F.col("matched_services")).alias("positioning"))
    return found.filter("positioning IS NOT NULL")


def competitors(spark, sf):
    return CO.run_competitors(spark_table(spark, sf, "fx_pairs"), candidates(spark, sf), asked(spark, sf), stored_profiles(spark, sf))


@checked("competitor_run", MUSES, f"""WITH {MATCHED} SELECT query_id, entity_id, CASE WHEN profile_domain IS NOT NULL THEN competitor_tier END AS competitor_tier, match_score,
CASE WHEN matched_services <> '' THEN 'Shares ' || len(string_split(matched_services, '|')) || ' key service' || CASE WHEN contains(matched_services, '|') THEN 's' ELSE '' END || ': ' || array_to_string(list_slice(string_split(matched_services, '|'), 1, 3), ', ') END AS positioning,
row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, confidence DESC, domain, entity_id) AS place FROM tiered WHERE rejection_reason IS NULL""")
def competitor_run(spark, sf):
    found = competitors(spark, sf).accepted
    return found.select("query_id", "entity_id", "competitor_tier", "match_score", "positioning", F.col("place").cast("bigint").alias("place"))


@checked("competitor_rejections", MUSES, f"""WITH {MATCHED} SELECT query_id, count(*) FILTER (reason_class IS NULL) AS accepted, count(*) FILTER (reason_class = 'tool') AS rejected_tool,
count(*) FILTER (reason_class = 'low_score') AS rejected_low_score, count(*) FILTER (reason_class = 'no_match') AS rejected_no_match FROM filtered GROUP BY query_id""")
def competitor_rejections(spark, sf):
    return competitors(spark, sf).rejections


# --- rank ---------------------------------------------------------------------------------------

_SEC = "date_diff('second', {}, TIMESTAMP '2024-02-01 00:00:00')"
RANKED = f"""rk1 AS (SELECT p.query_id, e.*, {_SEC.format('last_seen')} AS ls, {_SEC.format('first_seen')} AS fs FROM fx_pairs p JOIN fx_entities e USING (entity_id)),
rk2 AS (SELECT *, CASE WHEN ls < 3600 THEN 1.0::DOUBLE WHEN ls < 86400 THEN 0.9::DOUBLE WHEN ls < 259200 THEN 0.7::DOUBLE WHEN ls < 604800 THEN 0.5::DOUBLE WHEN ls < 2592000 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS freshness,
  fs < 172800 AS is_new, (1 + CAST(description IS NOT NULL AS INT) + CAST(services <> '' AS INT) + CAST(technologies <> '' AS INT) + CAST(linkedin IS NOT NULL AS INT) + CAST(emails <> '' AS INT))::DOUBLE / 6 AS completeness FROM rk1),
rk3 AS (SELECT *, confidence * 0.35::DOUBLE + relevance * 0.30::DOUBLE + freshness * 0.20::DOUBLE + completeness * 0.15::DOUBLE + CASE WHEN is_new THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS score FROM rk2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM rk3)"""
RUSES = "fx_entities fx_pairs"


def ranked(spark, sf):
    rows = spark_table(spark, sf, "fx_pairs").join(entities(spark, sf), "entity_id")
    return SC.rank_entities(rows, AS_OF, by=["query_id"], tie=["entity_id"])


@checked("entity_rank", RUSES, f"WITH {RANKED} SELECT query_id, entity_id, score, freshness, is_new, rank FROM ranked")
def entity_rank(spark, sf):
    return ranked(spark, sf).select("query_id", "entity_id", "score", "freshness", "is_new", "rank")


@checked("rank_by_freshness", RUSES, f"WITH {RANKED} SELECT query_id, entity_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY freshness DESC, rank) AS fresh_pos FROM ranked")
def rank_by_freshness(spark, sf):
    rows = stored(ranked(spark, sf).select("query_id", "entity_id", "freshness", "rank"))
    return SC.rank_by_freshness(rows, hot_rows=400).select("query_id", "entity_id", "rank", "fresh_pos")


@checked("rank_min_score", RUSES, f"WITH {RANKED} SELECT query_id, entity_id, score FROM ranked WHERE score >= 0.6::DOUBLE")
def rank_min_score(spark, sf):
    rows = spark_table(spark, sf, "fx_pairs").join(entities(spark, sf), "entity_id")
    return SC.filter_by_min_score(SC.with_rank_score(rows, AS_OF), 0.6).select("query_id", "entity_id", "score")


@checked("freshness_buckets", RUSES, f"WITH {RANKED} SELECT freshness, is_new, count(*) AS n FROM ranked GROUP BY ALL")
def freshness_buckets(spark, sf):
    rows = spark_table(spark, sf, "fx_pairs").join(entities(spark, sf), "entity_id")
    return SC.with_rank_score(rows, AS_OF).groupBy("freshness", "is_new").agg(F.count(F.lit(1)).alias("n"))


@checked("confidence_bands", "fx_entities", "SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS band, count(*) AS n FROM fx_entities GROUP BY band")
def confidence_bands(spark, sf):
    return SV.confidence_bands(entities(spark, sf))


# --- flagship -----------------------------------------------------------------------------------

from .entity_checks import PROFILE, flat, profiled  # noqa: E402


@checked("best_company_per_domain", "fx_pages", f"""WITH {PROFILE}, bs AS (SELECT *, {CONFIDENCE} AS confidence FROM entities),
bt AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, page_id) AS rn FROM bs)
SELECT page_id, domain, name, description, services, founders, technologies, confidence FROM bt WHERE rn = 1""")
def best_company_per_domain(spark, sf):
    found = E.company_entities(profiled(spark, sf)).withColumn("confidence", SC.confidence_score())
    best = first_per_key(found, ["domain"], [F.col("confidence").desc(), F.col("page_id")])
    return flat(best).select("page_id", "domain", "name", "description", "services", "founders", "technologies", "confidence")
