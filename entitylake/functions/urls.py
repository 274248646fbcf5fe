"""URL and domain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*"
HOST = SCHEME + r"://(?:[^/?#@\s]*@)?([^/?#:@\s]+)"
FRONT_PAGE = SCHEME + r"://[^/?#]+/?(?:[?#].*)?$"
PATH = SCHEME + r"://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host, or null when the text is not an absolute URL."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def strip_www(domain: Column) -> Column:
    return F.regexp_replace(domain, r"^www\.", "")


def domain_of(url: Column) -> Column:
    """Host without www.; a text that is no URL stays as it is."""
    return F.coalesce(strip_www(host_of(url)), url)


def path_of(url: Column) -> Column:
    """Path of an absolute URL ('/' when empty), or null when the text is not one."""
    path = F.regexp_extract(url, PATH, 1)
    return F.when(host_of(url).isNotNull(), F.when(path == "", F.lit("/")).otherwise(path))


def absolute_url(link: Column, domain: Column) -> Column:
    """Resolve a link against https://domain. No percent-encoding, no '..' folding."""
    base = F.concat(F.lit("https://"), domain)
    resolved = (
        F.when(link.rlike(SCHEME + ":"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(F.concat(base, F.lit("/"), link))
    )
    return F.regexp_replace(resolved, r"^(https?://[^/?#]+)($|[?#])", "$1/$2")


def domain_key(domain: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(domain), r"^www\.", ""))


def clean_candidate(domain: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(domain), r"^www\.", ""), "/$", "")


def stem_of(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)
