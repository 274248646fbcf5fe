"""The whole discovery run."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylake.plans.discovery import Inputs, run_discovery

from . import sqltext as q
from .derived import spark_table
from .entity_checks import PROFILE
from .page_checks import pages
from .registry import checked
from .score_checks import ASKED, SCORE_SQL, VERDICT_SQL, entities
from .serve_checks import CANDIDATES, CUSES, directories, suggestions


def inputs(spark, sf):
    def t(name):
        return spark_table(spark, sf, name)

    return Inputs(t("fx_queries"), pages(spark, sf), suggestions(spark, sf), t("fx_web"), t("fx_seeds"), directories(spark), entities(spark, sf))


DISCOVERY = f"""{CANDIDATES},
{PROFILE},
hm AS (SELECT domain, min(page_id) AS page_id FROM pg GROUP BY domain),
asked_pairs AS (SELECT c.query_id, c.pos, e.* EXCLUDE (page_id), q7.raw, {ASKED}, replace(q7.industry, '_', ' ') AS category
  FROM candidates c JOIN entities e ON e.domain = {q.domain('c.url')} JOIN hm ON hm.page_id = e.page_id JOIN q7 ON q7.query_id = c.query_id WHERE c.pos <= 15 AND NOT links_only),
{SCORE_SQL},
{VERDICT_SQL},
sv0 AS (SELECT query_id, raw, domain, min(pos) AS pos, any_value(name) AS name, any_value(confidence) AS confidence, any_value(relevance) AS relevance FROM verdict WHERE is_valid GROUP BY query_id, raw, domain),
saved AS (SELECT *, NOT EXISTS (SELECT 1 FROM sv0 b WHERE b.raw IS NOT DISTINCT FROM a.raw AND b.domain = a.domain AND b.query_id < a.query_id) AS is_new FROM sv0 a)"""


@checked("discovery_run", CUSES + " fx_pages", f"WITH {DISCOVERY} SELECT query_id, pos, domain, name, confidence, relevance, is_new FROM saved")
def discovery_run(spark, sf):
    saved = run_discovery(inputs(spark, sf)).saved
    return saved.select("query_id", F.col("pos").cast("bigint").alias("pos"), "domain", "name", "confidence", "relevance", "is_new")


@checked("discovery_outcome", CUSES + " fx_pages", f"""WITH {DISCOVERY},
rr AS (SELECT q.query_id, coalesce(bool_or(o.query_id < q.query_id), false) AS again FROM fx_queries q LEFT JOIN (SELECT raw, min(query_id) AS query_id FROM saved GROUP BY raw) o ON o.raw IS NOT DISTINCT FROM q.raw GROUP BY q.query_id), nc AS (SELECT query_id, count(*) AS n FROM candidates WHERE pos <= 15 GROUP BY query_id),
ag AS (SELECT query_id, count(*) AS saved, count(*) FILTER (is_new) AS new_entities, bool_and(NOT is_new) AS all_known FROM saved GROUP BY query_id)
SELECT query_id, coalesce(saved, 0) AS saved, coalesce(new_entities, 0) AS new_entities, coalesce(all_known, false) AS all_known,
CASE WHEN coalesce(n, 0) = 0 THEN 'unsupported' WHEN again AND coalesce(new_entities, 0) = 0 THEN 'no_new_results' ELSE 'completed' END AS outcome
FROM fx_queries JOIN rr USING (query_id) LEFT JOIN nc USING (query_id) LEFT JOIN ag USING (query_id)""")
def discovery_outcome(spark, sf):
    return run_discovery(inputs(spark, sf)).outcome
