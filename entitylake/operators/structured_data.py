"""JSON-LD organisation blocks of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import bind, matches
from ..functions.text import trim_all
from ..rules import page_rules as rules
from .people import PERSON, person

LD_JSON = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _get(node: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, path, kind)


def _filled(node: Column, path: str) -> Column:
    value = _get(node, path)
    return F.when(value != "", value)


def _as_list(node: Column, path: str) -> Column:
    """A node list given either as an array or as one object."""
    single = _get(node, path, "variant")
    return F.coalesce(
        _get(node, path, "array<variant>"),
        F.when(single.isNotNull(), F.array(single)),
        F.array().cast("array<variant>"),
    )


def _profile_link(node: Column, pattern: str) -> Column:
    links = F.coalesce(
        _get(node, "$.sameAs", "array<string>"),
        F.when(_filled(node, "$.url").isNotNull(), F.array(_get(node, "$.url"))),
    )
    return F.get(F.filter(links, lambda u: matches(u, pattern)), F.lit(0))


def _people(node: Column, path: str, role: str) -> Column:
    persons = F.filter(
        _as_list(node, path),
        lambda p: (F.length(trim_all(_get(p, "$.name"))) >= 3)
        & F.coalesce(matches(_filled(p, '$["@type"]'), "Person"), F.lit(True)),
    )
    return F.transform(
        persons,
        lambda p: person(
            trim_all(_get(p, "$.name")),
            F.coalesce(_filled(p, "$.jobTitle"), F.lit(role)),
            _profile_link(p, r"linkedin\.com"),
            _profile_link(p, r"twitter\.com|x\.com"),
        ),
    )


def _key_people(node: Column) -> Column:
    """Founders first; employees and members only while fewer than six people are known."""
    people = _people(node, "$.founder", "Founder")
    for path, role in (("$.employee", "Employee"), ("$.member", "Member")):
        more = _people(node, path, role)
        people = bind(people, _unless_full(more))
    return people


def _unless_full(more: Column):
    return lambda known: F.when(F.size(known) >= 6, known).otherwise(F.concat(known, more))


def _services(node: Column) -> Column:
    offers = F.filter(
        F.transform(_as_list(node, "$.hasOfferCatalog.itemListElement"), lambda o: _filled(o, "$.name")),
        lambda n: n.isNotNull(),
    )
    known = F.transform(
        F.coalesce(_get(node, "$.knowsAbout", "array<variant>"), F.array().cast("array<variant>")),
        lambda k: F.when(F.schema_of_variant(k) == "STRING", _get(k, "$")).otherwise(
            F.coalesce(_get(k, "$.name"), F.lit(""))
        ),
    )
    return F.slice(F.concat(offers, known), 1, 8)


def organisation_of(html: Column) -> Column:
    """Struct of the first organisation node of a page, null when there is none.

    A block may hold one node, a list, or a @graph; a block that is no JSON is skipped.
    """
    blocks = F.transform(
        F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1)), lambda b: F.try_parse_json(b)
    )
    nodes = F.flatten(
        F.transform(
            F.filter(blocks, lambda v: v.isNotNull()),
            lambda v: F.coalesce(
                _get(v, "$", "array<variant>"), _get(v, '$["@graph"]', "array<variant>"), F.array(v)
            ),
        )
    )
    first = F.get(
        F.filter(nodes, lambda n: matches(_get(n, '$["@type"]'), rules.ORGANISATION_TYPES)), F.lit(0)
    )
    return bind(first, _organisation)


def _organisation(org: Column) -> Column:
    address_parts = F.filter(
        F.array(
            _get(org, "$.address.addressLocality"),
            _get(org, "$.address.addressRegion"),
            _get(org, "$.address.addressCountry"),
        ),
        lambda a: a != "",
    )
    address = F.when(
        F.schema_of_variant(_get(org, "$.address", "variant")) == "STRING", _filled(org, "$.address")
    ).otherwise(F.array_join(address_parts, ", "))
    employees = F.coalesce(
        _filled(org, "$.numberOfEmployees.value"),
        _filled(org, "$.numberOfEmployees.minValue"),
        F.when(
            ~F.schema_of_variant(_get(org, "$.numberOfEmployees", "variant")).startswith("OBJECT"),
            _filled(org, "$.numberOfEmployees"),
        ),
    )
    return F.when(
        org.isNotNull(),
        F.struct(
            _filled(org, "$.name").alias("name"),
            F.substring(_filled(org, "$.description"), 1, 400).alias("description"),
            _filled(org, "$.foundingDate").alias("founding_date"),
            employees.alias("employees"),
            F.when(address != "", address).alias("address"),
            F.transform(
                F.filter(
                    _get(org, "$.sameAs", "array<variant>"), lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
                ),
                lambda v: _get(v, "$"),
            ).alias("same_as"),
            _key_people(org).cast(f"array<{PERSON}>").alias("people"),
            _services(org).alias("services"),
        ),
    )
