import pytest
from pyspark.sql import functions as F

from entitylake.functions import html as H
from entitylake.functions import patterns as P
from entitylake.functions import text as T
from entitylake.functions import urls as U
from entitylake.operators import entities as E
from entitylake.operators import pages
from entitylake.operators import people as PP
from entitylake.operators import queries as Q
from entitylake.operators.structured_data import organisation_of
from entitylake.rules import query_rules


@pytest.fixture
def value(spark):
    def run(build, *args):
        names = [f"a{i}" for i in range(len(args))]
        df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} string" for n in names))
        return df.select(build(*[F.col(n) for n in names]).alias("x")).collect()[0][0]

    return run


def test_word_edge_is_ascii(value):
    assert value(lambda c: P.matches(c, r"\bcaf\b"), "caféx") is True
    assert value(lambda c: P.matches(c, r"\bcaf\b"), "cafx") is False


@pytest.mark.parametrize(
    "pattern, words",
    [
        (r"\bcro\b|a/b test", ["cro", "a/b test"]),
        (r"e-?commerce|online.*retail", ["commerce", "online"]),
        (r"per\s*(?:user|seat)\b", ["per"]),
        (r"d2c|(?:best|top)\s+(?:store|shop)", None),
    ],
)
def test_required_words(pattern, words):
    assert P.required_words(pattern) == words


def test_guards_change_no_label(spark):
    texts = ["Best online retail e-commerce", "video game agency", "a game here", "learning platform seo", "İstanbul AI",
             "top shopify stores", "SaaS software agency", "software", "", "docs and a tool"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (query_rules.QUERY_INDUSTRY_RULES, query_rules.DESCRIPTION_INDUSTRY_RULES, query_rules.META_INDUSTRY_RULES):
        plain = F.when(F.lit(False), F.lit(""))
        for pattern, label in rules:
            plain = plain.when(P.matches(F.col("t"), pattern), F.lit(label))
        rows = df.select(P.first_label(F.col("t"), rules).alias("a"), plain.alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


def test_trim_takes_every_white_space(value):
    assert value(T.trim_all, "\t a b \n") == "a b"
    assert value(T.squash, " a \n\n b ") == "a b"


def test_truncate(value):
    assert value(lambda c: T.truncate_text(c, 5), "abcdefgh") == "ab..."
    assert value(lambda c: T.truncate_text(c, 8), "abcdefgh") == "abcdefgh"


def test_similarity_of_texts(value):
    assert value(T.text_similarity, "a B c", "b c d") == 0.5


@pytest.mark.parametrize(
    "url, domain, path",
    [
        ("https://www.Acme.com:80/x?y=1", "acme.com", "/x"),
        ("http://acme.com", "acme.com", "/"),
        ("no url", "no url", None),
    ],
)
def test_urls(value, url, domain, path):
    assert value(U.domain_of, url) == domain
    assert value(U.path_of, url) == path


@pytest.mark.parametrize(
    "link, absolute",
    [
        ("/a", "https://x.com/a"), ("a", "https://x.com/a"), ("//c.net", "https://c.net/"),
        ("https://y.com?q=1", "https://y.com/?q=1"), ("https://y.com/a", "https://y.com/a"),
    ],
)
def test_absolute_url(value, link, absolute):
    assert value(U.absolute_url, link, "x.com") == absolute


def test_meta_in_either_order_and_quote(value):
    page = """<META content="it's" name='description'><meta property="og:title" content='a "b"'>"""
    tags = lambda c: H.tags(c, "meta")
    assert value(lambda c: H.first_tag_value(tags(c), "name", "description", "content"), page) == "it's"
    assert value(lambda c: H.first_tag_value(tags(c), "property", "og:title", "content"), page) == 'a "b"'
    assert value(lambda c: H.first_tag_value(tags(c), "name", "keywords", "content"), page) is None


def test_body_prefers_main_and_keeps_whole_text(value):
    page = "<body>x<article>no</article><main>" + "word " * 10000 + "end</main></body>"
    assert value(H.body_text_of, page).endswith("end")
    assert len(value(lambda c: H.body_text_of(c, 12000), page)) == 12000
    assert value(H.body_text_of, "<p>no body</p>") == "no body"


def test_emails(value):
    text = "a@b.com a@b.com1x@y.org q@example.com c@d.io"
    assert value(pages.emails_in, text) == ["a@b.com", "1x@y.org", "c@d.io"]
    assert value(lambda c: pages.emails_in(c, deny=()), text)[2] == "q@example.com"


def test_long_runs_stay_fast(value):
    assert value(pages.emails_in, "a" * 200000) == []
    assert value(PP.people_in_text, "word " * 40000 + "is the CEO")[0]["role"] == "CEO"


@pytest.mark.parametrize(
    "text, people",
    [
        ("CEO: John Smith", [("John Smith", "CEO")]),
        ("John Smith, Chief Executive Officer", [("John Smith", "CEO")]),
        ("john smith is the CTO", [("john smith", "CTO")]),
        ("Alice Brown Vice President", [("Alice Brown Vice", "President")]),
        ("Data Analytics, CEO", []),
        ("Ann Lee, CTO. ANN LEE is the CEO", [("Ann Lee", "CTO")]),
        ("Jane Doe Founder John Smith CTO", [("Jane Doe Founder John Smith", "CTO")]),
    ],
)
def test_people_in_text(value, text, people):
    assert [(p["name"], p["role"]) for p in value(PP.people_in_text, text)] == people


def test_people_cap(value):
    names = " ".join(f"CEO: Al{chr(97 + i)}n Smith." for i in range(9))
    assert len(value(PP.people_in_text, names)) == 6


def test_organisation_shapes(value):
    def page(body):
        return f'<script type="application/ld+json">{body}</script>'

    graph = page('{"@graph":[{"@type":"WebPage"},{"@type":["Organization"],"name":"G"}]}')
    assert value(organisation_of, page("{broken") + graph)["name"] == "G"
    assert value(organisation_of, page('[{"@type":"Company","name":"L","address":"Main"}]'))["address"] == "Main"
    assert value(organisation_of, page('{"@type":"Person","name":"P"}')) is None
    assert value(organisation_of, "<p>none</p>") is None


@pytest.mark.parametrize("text, rating", [("4.5 stars", 4.5), ("5/5", 5.0), ("6 stars", None), ("none", None)])
def test_rating(value, text, rating):
    assert value(E.text_rating, text) == rating


@pytest.mark.parametrize(
    "query, intent, industry, domain",
    [
        ("acme-tools.com", "competitor_analysis", None, True),
        ("https://www.acme.com/ competitor", "competitor_analysis", None, False),
        ("Best Shopify CRO agencies", "agency_search", "cro_agency", False),
        ("Sports jersey manufacturers in Delhi", "local_business_search", "apparel", False),
        ("game agency", "agency_search", None, False),
        ("something else", "general_search", None, False),
    ],
)
def test_query_analysis(spark, query, intent, industry, domain):
    row = Q.analyze_queries(spark.createDataFrame([(1, query)], "query_id long, raw string")).collect()[0]
    assert (row.intent, row.industry, row.is_domain) == (intent, industry, domain)


def test_location_needs_letters(spark):
    rows = [(1, "shops in 2024"), (2, "shops in Pune, India"), (3, "Tokyo or Singapore")]
    found = Q.analyze_queries(spark.createDataFrame(rows, "query_id long, raw string")).orderBy("query_id").collect()
    assert [r.location for r in found] == [None, "Pune", "Singapore"]


def test_redirects(value):
    assert value(pages.decode_redirect, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2F&rut=1") == "https://a.com/"
    assert value(pages.decode_redirect, "https://a.com/x") == "https://a.com/x"
    assert value(pages.decode_redirect, "/local") is None


@pytest.mark.parametrize(
    "title, domain", [("Twitch (service)", "twitch.tv"), ("Vimeo", "vimeo.com"), ("List of sites", None), ("A", None), ("Expo 2024", None)]
)
def test_title_domains(value, title, domain):
    assert value(pages.title_to_domain, title) == domain


@pytest.mark.parametrize(
    "markup, people",
    [
        ('<div class="team-member"><img src="x"><h3>Ann Lee</h3><p>CTO</p></div><h3>Not Taken</h3><p>CEO</p>', [("Ann Lee", "CTO")]),
        ('<section class="our-team"><h2>Meet Us</h2><div class="team-card"><div class="member-name">Bob Ray</div><div><span class="position">VP Sales</span></div></div></section>', [("Meet Us", "VP Sales"), ("Bob Ray", "VP Sales")]),
        ('<article itemtype="https://schema.org/Person"><b>Cy Young</b> and <i>Founder</i></article>', [("Cy Young", "Founder")]),
        ('<div class="staff-card"><b>Di Fox</b><br><span>CEO</span></div>', []),
        ('<div class="bio-card"><p>President of it</p><div><div><h4>Ed Poe</h4></div></div></div><p>CEO</p>', [("Ed Poe", "President of it")]),
        ('<div class="x leadership y"><p class="job-title">Director</p><div class="title">Flo Ash</div></div>', [("Flo Ash", "Director")]),
        ('<div class="team-member"><h3>Our Platform</h3><p>CTO</p></div><h3>Gus Orr</h3><p>CEO</p>', [("Gus Orr", "CEO")]),
        ("<h3>Hal Day</h3><p>CEO</p><p><b>Ivy Lux</b> CTO</p>", [("Hal Day", "CEO")]),
        ('<div class="team-member"', []),
    ],
)
def test_people_of_team_cards(value, markup, people):
    assert [(p["name"], p["role"]) for p in value(PP.people_in_markup, markup)] == people


def test_meta_without_quotes(spark):
    page = spark.createDataFrame([(1, "https://a.com", "<meta name=description content=Shoes><meta property=og:title content='T'/><meta content=k name=keywords>")], "page_id long, url string, html string")
    got = pages.with_meta(page).first()
    assert (got.description, got.og_title, got.keywords) == ("Shoes", "T", "k")


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div class=content>x<div>y</div>z</div>w", "xyz"),
        ("<section id=content class=a>x</section>w", "x"),
        ("<title>t</title><p>plain <b>text</b></p><script>no</script>", "plain text"),
        ("<head><title>t</title></head><p>plain</p>", "plain"),
        ("", ""),
    ],
)
def test_body_without_quotes_or_body_tag(value, html, text):
    assert value(H.body_text_of, html) == text
