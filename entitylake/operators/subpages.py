"""Joining a page with its about or services page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .entities import company_entities
from .ordering import first_per_key
from .pages import choose_subpage, chosen_pages, page_profile
from .people import add_people


def _one_per_url(pages: DataFrame) -> DataFrame:
    """A URL captured many times counts once, by its first capture."""
    return first_per_key(pages, ["url"], [F.col("page_id")])


def merge_about_people(entities: DataFrame, about: DataFrame, limit: int = 8) -> DataFrame:
    """Companies with fewer than two people take more from their about page; others with enough stay as they are.

    entities: founders and subpage_url (null for none); about: url, page_id, founders of pages, of which the first capture of a
    URL counts. A row without a URL to look for takes no part in the join. subpage_url is dropped.
    """
    found = _one_per_url(about.select("url", "page_id", "founders")).filter(F.size("founders") > 0).select(
        F.col("url").alias("_url"), F.col("founders").alias("_about")
    )
    wanted = F.when(F.size("founders") < 2, F.col("subpage_url"))
    # Rows that look for nothing would all have the same key; they get one of their own, which no URL equals.
    key = F.coalesce(wanted, F.concat(F.lit("\n"), F.xxhash64("page_id").cast("string")))
    joined = entities.withColumn("_key", key).join(found, F.col("_key") == F.col("_url"), "left")
    merged = F.when(F.col("_about").isNotNull(), add_people(F.col("founders"), F.col("_about"), limit)).otherwise(F.col("founders"))
    return joined.withColumn("founders", merged).drop("_key", "_url", "_about", "subpage_url")


def people_of_about_pages(entities: DataFrame, pages: DataFrame, limit: int = 8) -> DataFrame:
    """merge_about_people for a table of entities (page_id, url, founders, ...) that is small beside `pages`.

    Only the about pages that some entity with fewer than two people links to are extracted, each once: the pages of
    those entities are read for links, their targets are found by URL, and ids alone choose what is read.
    """
    poor = entities.filter(F.size("founders") < 2).select("page_id").distinct()
    chosen = stored(choose_subpage(chosen_pages(pages, poor), "about").select("page_id", "subpage_url"))
    asked = chosen.select(F.col("subpage_url").alias("url")).distinct()
    ids = pages.select("url", "page_id").join(asked, "url", "left_semi").groupBy("url").agg(F.min("page_id").alias("page_id"))
    about = company_entities(page_profile(chosen_pages(pages, ids)))
    with_url = entities.join(chosen.withColumnRenamed("page_id", "_page"), F.col("page_id") == F.col("_page"), "left").drop("_page")
    return merge_about_people(with_url, about, limit)


def with_services_text(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """body_text preceded by the text of the services page, when there is one with text."""
    texts = _one_per_url(pages.select("page_id", "url", "body_text")).filter(F.col("body_text") != "").select(
        F.col("url").alias("subpage_url"), F.col("body_text").alias("_services")
    )
    found = chosen.select("page_id", "subpage_url").join(texts, "subpage_url").select("page_id", "_services")
    return pages.join(found, "page_id", "left").withColumn(
        "body_text",
        F.when(F.col("_services").isNotNull(), F.concat("_services", F.lit("\n\n"), "body_text")).otherwise(F.col("body_text")),
    ).drop("_services")
