"""Second round of a discovery run: links of the pages that the first round reached become candidates.

The frontier is (query_id, rank, url). Directory pages give links only; home pages give theirs where the query asks for
competitors, agencies or a domain. Only pages that some query asks for are read for links, each once, and a page is reduced
to its first targets before it meets the queries, so a directory that every query asks for stays one small row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import FRONT_PAGE, domain_of, host_of, strip_www
from ..operators.ordering import top_k_per_key
from ..operators.pages import chosen_pages, with_domain, with_links
from ..rules import domain_lists

#: Intents whose home pages give links.
LINK_INTENTS = ("competitor_analysis", "agency_search")


def first_pages(pages: DataFrame, by: str = "domain") -> DataFrame:
    """(domain or url, page_id): the first captured page with content (smallest page_id) of each."""
    key = domain_of(F.col("url")) if by == "domain" else F.col("url")
    return pages.filter(F.col("html") != "").select(key.alias(by), "page_id").groupBy(by).agg(F.min("page_id").alias("page_id"))


def page_targets(
    pages: DataFrame, page_ids: DataFrame, collect: int = 20, blocked: Sequence[str] = tuple(domain_lists.CANDIDATE_BLOCKLIST)
) -> DataFrame:
    """(page_id, targets): the first `collect` different hosts to whose front page a page links, in link order."""
    linked = with_links(with_domain(chosen_pages(pages, page_ids.select("page_id").distinct())))
    front = F.filter("external_links", lambda u: u.rlike(FRONT_PAGE) & host_of(u).isNotNull())
    hosts = F.array_distinct(F.transform(front, lambda u: strip_www(host_of(u))))
    kept = F.filter(hosts, lambda h: ~h.isin(list(blocked))) if blocked else hosts
    return linked.select("page_id", F.slice(kept, 1, collect).alias("targets")).filter(F.size("targets") > 0)


def link_sources(candidates: DataFrame, analysed: DataFrame, homes: DataFrame, by_url: DataFrame) -> DataFrame:
    """(query_id, pos, page_id): captured pages whose links count for a query.

    homes(domain, page_id) and by_url(url, page_id) are first_pages. A links-only candidate is its own page; another one is the
    home page of its domain, and counts for domain queries and LINK_INTENTS.
    """
    context = analysed.select("query_id", "is_domain", "intent")
    listed = candidates.filter("links_only").join(by_url, "url").select("query_id", "pos", "page_id")
    wanted = context.filter(F.col("is_domain") | F.col("intent").isin(*LINK_INTENTS)).select("query_id")
    domain = F.col("domain") if "domain" in candidates.columns else domain_of(F.col("url")).alias("domain")
    asked = candidates.filter("NOT links_only").select("query_id", "pos", domain)
    return listed.unionByName(asked.hint("merge").join(wanted, "query_id", "left_semi").hint("merge").join(homes, "domain").select("query_id", "pos", "page_id"))


def frontier(sources: DataFrame, targets: DataFrame, known: DataFrame, collect: int = 20, cap: int = 5) -> DataFrame:
    """(query_id, rank, url): the first `collect` different targets of a query, less those it has asked for, `cap` at most.

    known(query_id, url) are the URLs that the query already has.
    """
    rows = sources.join(targets, "page_id").select("query_id", "pos", F.posexplode("targets").alias("at", "target"))
    first = rows.groupBy("query_id", F.concat(F.lit("https://"), F.col("target")).alias("url")).agg(F.min(F.struct("pos", "at")).alias("b"))
    collected = top_k_per_key(first, ["query_id"], [F.col("b"), F.col("url")], collect)
    fresh = collected.hint("merge").join(known.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti")
    return top_k_per_key(fresh, ["query_id"], [F.col("b"), F.col("url")], cap, "rank").select("query_id", "rank", "url")
