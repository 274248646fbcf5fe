import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from entitylake.operators import candidates as C
from entitylake.operators import history as H
from entitylake.operators import matching as M
from entitylake.operators import ordering as O
from entitylake.operators import resolve as R
from entitylake.operators import scoring as S
from entitylake.operators import serve as SV
from entitylake.sources.tables import csv_lines, dealt, decode_lists, spread

NOW = datetime(2024, 2, 1)

from entitylake.functions import html as H_  # noqa: E402
from entitylake.operators import entities as E_, pages as P_, structured_data as SD_  # noqa: E402


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows, with many equal scores."""
    rng = random.Random(7)
    rows = [(1 if i % 10 else i, rng.choice([0.1, 0.5, 0.5, 0.9]), i) for i in range(4000)]
    return spark.createDataFrame(rows, "k long, score double, id long").cache()


@pytest.mark.parametrize("hot_rows", [0, O.HOT_KEY_ROWS])
def test_rank_equals_plain_window(skewed, hot_rows):
    ranked = O.rank_per_key(skewed, ["k"], [-F.col("score"), F.col("id")], hot_rows=hot_rows)
    plain = F.row_number().over(Window.partitionBy("k").orderBy(F.col("score").desc(), "id"))
    assert ranked.withColumn("plain", plain).filter("rank <> plain").count() == 0
    assert ranked.count() == 4000


def test_hot_key_is_cut(skewed):
    buckets = O.with_buckets(skewed, ["k"], [-F.col("score"), F.col("id")], hot_rows=400)
    largest = buckets.filter("k = 1").groupBy("_bucket").count().agg(F.max("count")).collect()[0][0]
    assert largest < 3600 / 3


@pytest.mark.parametrize("hot_rows", [0, O.HOT_KEY_ROWS])
def test_previous_equals_lag(skewed, hot_rows):
    found = O.previous_per_key(skewed, ["k"], [F.col("score"), F.col("id")], ["id"], hot_rows=hot_rows)
    lag = F.lag("id").over(Window.partitionBy("k").orderBy("score", "id"))
    assert found.withColumn("lag", lag).filter("NOT (prev.id <=> lag)").count() == 0


def test_order_on_empty_input(skewed):
    for hot_rows in (-1, 0, 10):
        assert O.rank_per_key(skewed.filter("k < 0"), ["k"], [F.col("id")], hot_rows=hot_rows).count() == 0


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("limit", [2000, 3])
def test_similar_names_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "SEGMENT_LIMIT", limit)
    rng = random.Random(3)
    names = set()
    for base in ("acmeholding", "brightpath", "northwindtradersinc", "ab", "zeta", "a" * 14, "abababababab"):
        for _ in range(14):
            letters = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(letters) + 1)
                kind = rng.choice("dis")
                if kind == "i" or at == len(letters):
                    letters.insert(at, rng.choice("abxyz"))
                elif kind == "d":
                    del letters[at]
                else:
                    letters[at] = rng.choice("abxyz")
            names.add("".join(letters))
    names = sorted(n for n in names if n)
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id long")
    got = {r["name"]: r["match_id"] for r in R._nearest_names(df.select("name"), df, 0.85).collect()}
    want = {}
    for a in names:
        for i, b in enumerate(names):
            longer = max(len(a), len(b))
            if a != b and (longer - _edit(a, b)) / longer > 0.85:
                want.setdefault(a, i)
    assert got == want and len(want) > 20


def test_similar_entities_uses_domain_and_name(spark):
    rows = [(1, "Acme Holding", "acme.com"), (2, "Acme Holdings", "b.com"), (3, "Other", "www.ACME.com "), (4, "Alone", "d.com"), (5, "acme holding!", "e.com")]
    df = spark.createDataFrame(rows, "id long, name string, domain string")
    got = {r.id: (r.match_id, r.reason) for r in R.similar_entities(df, df).collect()}
    assert got == {1: (2, "name"), 2: (1, "name"), 3: (1, "domain"), 5: (1, "name")}


ENTITY = "entity_id long, name string, domain string, description string, services array<string>, technologies array<string>, linkedin string, emails array<string>, locations array<string>, category string, meta_title string, meta_description string, q_intent string, q_industry string, q_keywords array<string>, q_location string"


def entity(**over):
    base = dict(
        entity_id=1, name="Acme", domain="acme.com", description="y" * 60, services=["SEO"], technologies=[], linkedin=None, emails=[], locations=[],
        category=None, meta_title=None, meta_description=None, q_intent="general_search", q_industry=None, q_keywords=[], q_location=None,
    )
    return tuple({**base, **over}.values())


@pytest.mark.parametrize(
    "over, valid, flags",
    [
        ({}, True, ["verified"]),
        ({"domain": "clutch.co"}, False, ["irrelevant"]),
        ({"description": "payday loan"}, False, ["spam"]),
        ({"name": "A"}, False, ["incomplete"]),
        ({"domain": "localhost"}, False, ["incomplete"]),
        ({"q_intent": "agency_search", "description": "Free trial and pricing plan"}, False, ["tool_not_agency"]),
        ({"q_intent": "agency_search", "description": "Free trial, pricing plan. Our team"}, True, ["verified"]),
        ({"q_intent": "agency_search", "description": "Free trial, pricing plan, self-serve. Our team"}, False, ["tool_not_agency"]),
        ({"q_intent": "market_discovery", "q_industry": "edtech", "description": "Free trial, pricing plan, self-serve edtech"}, True,
         ["possible_tool_not_agency", "verified"]),
        ({"technologies": ["a"], "linkedin": "l", "emails": ["e"], "locations": ["l"], "q_industry": "seo", "category": "seo"}, True,
         ["high_confidence", "verified"]),
    ],
)
def test_verdict(spark, over, valid, flags):
    df = spark.createDataFrame([entity(**over)], ENTITY)
    row = S.validate_entities(S.score_entities(df)).collect()[0]
    assert (row.is_valid, row.flags) == (valid, flags)
    assert 0.05 <= row.relevance <= 1 and 0 <= row.confidence <= 1


def test_confidence_is_summed_in_order(spark):
    row = entity(services=["s"], technologies=["t"], linkedin="l")
    got = spark.createDataFrame([row], ENTITY).select(S.confidence_score().alias("c")).collect()[0].c
    assert got == 0.15 + 0.15 + 0.15 + 0.15 + 0.10 + 0.10 < 0.8


@pytest.mark.parametrize("hours, value", [(0, 1.0), (1, 0.9), (24, 0.7), (72, 0.5), (168, 0.3), (720, 0.1)])
def test_freshness_edges(spark, hours, value):
    df = spark.createDataFrame([(NOW - timedelta(hours=hours),)], "t timestamp_ntz")
    assert df.select(S.freshness(F.col("t"), NOW).alias("f")).collect()[0].f == value


def test_match_without_profile(spark):
    schema = ("primary_services array<string>, profile_model string, profile_industry string, services array<string>, body_text string, "
              "stored_services array<string>, stored_model string, stored_industry string")
    rows = [
        (None, None, None, ["SEO"], "", None, None, None),
        (["Email Marketing"], "agency", "ai", [], "we do email marketing", None, "agency", "ai"),
        (["CRO"], "agency", None, [], "across the micro shop", None, None, None),
    ]
    got = [(r.match_score, r.matched_services) for r in M.match_scores(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == (0.5, []) and got[1] == (1.0, ["Email Marketing"])
    assert got[2][1] == [] and abs(got[2][0] - 0.2) < 1e-9


def test_changes_between_versions(spark):
    schema = "domain string, at int, name string, description string, services array<string>, linkedin string, emails array<string>, category string"
    rows = [
        ("a.com", 1, "A", None, ["x"], "l", [], None),
        ("a.com", 2, "A", "text", ["x", "y"], None, [], None),
        ("a.com", 3, "A", "text", ["x", "y"], None, [], None),
        ("b.com", 1, "B", None, [], None, [], None),
    ]
    versions = spark.createDataFrame(rows, schema)
    got = {(r.domain, r.at, r.field, r.change_type) for r in H.entity_changes(versions, ["at"]).collect()}
    assert got == {("a.com", 2, "description", "added"), ("a.com", 2, "services", "modified"), ("a.com", 2, "linkedin", "removed")}
    kept = {(r.domain, r.at) for r in H.entity_snapshots(versions, ["at"]).collect()}
    assert kept == {("a.com", 1), ("a.com", 2), ("b.com", 1)}


def test_upsert_twice_changes_nothing(spark):
    current = spark.createDataFrame(
        [(1, "a.com", "A", datetime(2024, 1, 1), datetime(2024, 1, 1), False)],
        "entity_id long, domain string, name string, first_seen timestamp_ntz, last_seen timestamp_ntz, is_valid boolean",
    )
    incoming = spark.createDataFrame([("a.com", "A2"), ("b.com", "B")], "domain string, name string")
    once = H.merge_entities(current, incoming, NOW)
    twice = H.merge_entities(once, incoming, NOW)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    a = once.filter("domain = 'a.com'").collect()[0]
    assert (a.entity_id, a.name, a.first_seen, a.last_seen, a.is_valid) == (1, "A2", datetime(2024, 1, 1), NOW, True)


def test_dedup_keeps_first_of_each_domain(spark):
    df = spark.createDataFrame([(1, "www.A.com"), (2, "a.com "), (3, "b.com")], "id long, domain string")
    assert {r.id for r in R.dedup_by_domain(df, [F.col("id")]).collect()} == {1, 3}


def test_rerun_flags(spark):
    queries = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "query_id long, raw string")
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 10)], "query_id long, entity_id long")
    entities = spark.createDataFrame([(10, "a.com"), (11, "b.com")], "entity_id long, domain string")
    got = {(r.query_id, r.domain): r.is_new for r in C.rerun_new_entities(queries, links, entities).collect()}
    assert got == {(1, "a.com"): True, (2, "a.com"): False, (2, "b.com"): True, (3, "a.com"): True}
    stored = spark.createDataFrame([("y", "a.com"), (None, "b.com")], "raw string, domain string")
    got = {(r.query_id, r.domain): r.is_new for r in C.rerun_new_entities(queries, links, entities, stored).collect()}
    assert got == {(1, "a.com"): True, (2, "a.com"): False, (2, "b.com"): True, (3, "a.com"): False}
    flags = {r.query_id: r.is_rerun for r in C.rerun_flags(queries, links, stored).collect()}
    assert flags == {1: False, 2: True, 3: True}


def test_company_variants(spark):
    df = spark.createDataFrame([("notion.so",), ("notions.com",), ("johnnienotions.com",), ("other.com",)], "d string")
    got = [r[0] for r in df.select(C.is_company_variant(F.col("d"), F.lit("Notion"))).collect()]
    assert got == [True, True, True, False]


def test_listing_whitelists_sort(spark):
    df = spark.createDataFrame(
        [(i, f"n{i}", f"d{i}.com", None, i / 10, True) for i in range(5)],
        "entity_id long, name string, domain string, description string, confidence double, is_valid boolean",
    )
    assert [r.entity_id for r in SV.entity_listing(df, sort="drop table", limit=2).collect()] == [4, 3]
    assert [r.entity_id for r in SV.entity_listing(df, sort="name", order="asc", limit=2, page=2).collect()] == [2, 3]


def test_csv_text(spark):
    df = spark.createDataFrame([('a "b"', None), ("c,d", "e")], "x string, y string").coalesce(1)
    assert [r.value for r in csv_lines(df).collect()] == ["x,y", '"a ""b""",""', '"c,d","e"']


def test_json_lists(spark):
    df = spark.createDataFrame([('["a"]',), (None,), ("broken",)], "services string")
    assert [r.services for r in decode_lists(df).collect()] == [["a"], [], []]


def test_spread_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide) is wide


def test_top_k_limits_before_the_shuffle(skewed):
    top = O.top_k_per_key(skewed, ["k"], [F.col("score").desc(), F.col("id")], 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("hot_rows", [1, O.HOT_KEY_ROWS])
def test_null_keys_stay_on_both_paths(spark, hot_rows):
    rows = [(None if i % 3 == 0 else i % 3, i) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, id long")
    ranked = O.rank_per_key(df, ["k"], [F.col("id")], hot_rows=hot_rows).collect()
    assert sorted(r["rank"] for r in ranked if r.k is None) == list(range(1, 11)) and len(ranked) == 30
    before = O.previous_per_key(df, ["k"], [F.col("id")], ["id"], hot_rows=hot_rows).collect()
    assert len(before) == 30 and {r.id: r.prev.id for r in before if r.k is None and r.prev} == {i: i - 3 for i in range(3, 30, 3)}


def test_body_text_is_the_whole_element(spark):
    pages = [
        '<body><div class="content"><div>first</div><p>second part</p></div><p>outside</p></body>',
        "<article>a<article>b</article>c</article>d", "<main>never closed <main>x</main> tail", "<body>plain</body>", "no container",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(H_.body_text_of(F.col("html"))).collect()] == ["firstsecond part", "abc", "never closed x tail", "plain", "no container"]


def test_links_without_quotes_and_beyond_the_first_hundred(spark):
    html = "<a href=/about>x</a>" + "".join(f'<a href="https://t{i}.com/">y</a>' for i in range(150))
    df = spark.createDataFrame([(1, "https://own.com/", html)], "page_id long, url string, html string")
    assert P_.page_links(df).count() == 100 and P_.page_links(df).where("link = 'https://own.com/about'").count() == 1
    assert P_.outlink_domains(P_.page_links(df, limit=None)).count() == 150


def test_same_as_keeps_texts_only(spark):
    html = '<script type="application/ld+json">{"@type":"Organization","name":"N","sameAs":["https://a.com",5,{"x":1},null]}</script>'
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(SD_.organisation_of(F.col("html")).alias("o")).first().o.same_as == ["https://a.com"]


def test_service_without_latin_letters(spark):
    df = spark.createDataFrame([("<h1>x</h1>", "t", "d", "body", ["日本語", "seo"])], "html string, title string, description string, body_text string, services array<string>")
    assert E_.service_prominence(df).count() == 1


def test_listing_of_a_query_keeps_its_order(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, f"n{i}", f"d{i}.com", None, i / 100, True) for i in range(60)], "entity_id long, name string, domain string, description string, confidence double, is_valid boolean")
        links = spark.createDataFrame([(7, i, i % 2 == 0) for i in range(60)], "query_id long, entity_id long, is_new boolean")
        page = SV.entity_listing(df, links, query_id=7, limit=10).collect()
        assert [r.entity_id for r in page] == list(range(59, 49, -1)) and page[0].is_new is False
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_json_export_decodes_founders(spark):
    row = (1, "n", True, 0.5, ["s"], None, None, None, [], '["Ann","Bo"]')
    df = spark.createDataFrame([row], "entity_id long, name string, is_valid boolean, confidence double, services array<string>, technologies array<string>, emails array<string>, locations array<string>, phones array<string>, founders string")
    assert SV.export_json_rows(df).first().founders == ["Ann", "Bo"]


def test_stored_results_need_a_shared_folder(spark, monkeypatch):
    from entitylake import session

    class Fake:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError):
        session.checkpoint_root(Fake)


def _no_broadcast(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pieces_and_queries_are_never_broadcast(spark):
    queries = spark.createDataFrame([(1, "best brand7 shops", True, "brand7.com")], "query_id long, raw string, is_domain boolean, query string")
    seeds = spark.createDataFrame([("ai", 0, 1, "brand7.com")], "industry string, priority int, pos int, domain string")
    entities = spark.createDataFrame([("brand7.com", "AI")], "domain string, category string")
    found = C.seed_keyword_match(queries, seeds)
    assert _no_broadcast(found) and [tuple(r) for r in found.collect()] == [(1, "ai")]
    stored_category = C.category_industry(queries, entities)
    assert _no_broadcast(stored_category) and [tuple(r) for r in stored_category.collect()] == [(1, "ai")]


def test_outcome_of_a_run_broadcasts_no_table_of_queries(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "query_id long, raw string")
    links = spark.createDataFrame([(1, 7), (2, 7)], "query_id long, entity_id long")
    entities = spark.createDataFrame([(7, "x.com")], "entity_id long, domain string")
    counted = spark.createDataFrame([(1, 2), (2, 1)], "query_id long, n_candidates long")
    saved = C.rerun_new_entities(queries, links, entities)
    found = SV.run_outcome(C.rerun_flags(queries, saved), counted, saved)
    assert _no_broadcast(found)
    assert sorted((r.query_id, r.outcome) for r in found.collect()) == [(1, "completed"), (2, "no_new_results"), (3, "unsupported")]


def test_rows_of_narrow_tables_are_dealt_by_their_number(spark, tmp_path):
    from checks.derived import spark_table

    customers = spark.range(12_000).selectExpr("id AS c_custkey", "'MACHINERY' AS c_mktsegment", "1.0D AS c_acctbal").coalesce(1)
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    phrases = spark_table(spark, str(tmp_path), "fx_queries")
    assert phrases.rdd.getNumPartitions() == 3 and phrases.count() == 12_000
    assert spark_table(spark, str(tmp_path), "fx_rich_pages").rdd.getNumPartitions() == 9
    few = spark.read.parquet(f"{tmp_path}/customer.parquet")
    assert dealt(few, 12_000) is few


def test_filters_on_what_dealt_rows_become_stay_behind_the_deal(spark, tmp_path):
    """A filter that Spark moves below the repartition takes the work with it into the one task that scans."""
    spark.range(12_000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/keys.parquet")
    made = dealt(spark.read.parquet(f"{tmp_path}/keys.parquet")).select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("html"))
    kept = made.filter("html LIKE 'a%'")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan.split("Repartition")[0] and "md5" not in plan.split("Repartition")[1]
    assert kept.rdd.getNumPartitions() == 3 and kept.count() == made.filter(F.col("html").startswith("a")).count()


def test_only_chosen_pages_are_extracted(spark, tmp_path):
    """A filter on what is read out of a page, moved below the choice by id, would extract from every page."""
    html = '<html><body><a href="/about-us">a</a><p>text</p></body></html>'
    spark.range(50).selectExpr("id AS page_id", "concat('https://brand', id, '.com/') AS url", f"'{html}' AS html").write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    ids = spark.createDataFrame([(3,), (7,)], "page_id long")
    about = P_.choose_subpage(P_.chosen_pages(pages, ids), "about")
    texts = P_.with_body_text(P_.chosen_pages(pages, ids)).filter("body_text <> ''")
    for found in (about, texts):
        above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")
        assert "regexp_replace" in above and "regexp" not in below
        assert sorted(r.page_id for r in found.collect()) == [3, 7]


def test_texts_of_entities_are_never_dealt_with_links(spark):
    """A row per link takes its query's columns to its entity; with the entity's texts the shuffles outgrow the input."""
    from entitylake.operators.queries import analyze_queries
    from entitylake.plans.competitors import FILTERED, matched_candidates, run_competitors

    entity = "entity_id long, name string, domain string, description string, services array<string>, technologies array<string>, locations array<string>, emails array<string>, linkedin string, category string, meta_title string, meta_description string"
    sites = [(i, f"Brand {i}", f"brand{i}.com", "We offer SEO and our team has case studies.", ["SEO"], [], [], [], None, "cro agency", None, None) for i in range(4)]
    entities = spark.createDataFrame(sites, entity)
    links = spark.createDataFrame([(q, e) for q in (1, 2) for e in range(4)], "query_id long, entity_id long")
    found = analyze_queries(spark.createDataFrame([(1, "brand1 alternative"), (2, "Best AI agencies")], "query_id long, raw string"))
    asked = found.select("query_id", "raw", F.col("intent").alias("q_intent"), F.col("industry").alias("q_industry"), F.col("keywords").alias("q_keywords"), F.col("location").alias("q_location"))
    profile = "domain string, primary_services array<string>, business_model string, industry string"
    profiles = spark.createDataFrame([("brand1.com", ["SEO", "Web"], "agency", "ai"), ("brand2.com", ["Toys"], "tool", None)], profile)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = matched_candidates(links, entities, asked, profiles)
        plan = spark._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "formatted")
        dealt_columns = [b for b in plan.split("\n\n") if ") Exchange" in b.split("\n")[0] or ") Exchange" in "".join(b.split("\n")[:2])]
        assert len(dealt_columns) >= 4
        assert not any("query_id" in b and ("description" in b or "body_text" in b) for b in dealt_columns)
        rows = {(r.query_id, r.entity_id): (r.matched_services, r.match_score) for r in pairs.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 8 and rows[1, 0] == (["SEO"], pytest.approx(0.5)) and rows[1, 2] == (["SEO"], pytest.approx(0.4)) and rows[2, 0] == ([], 0.5)
    out = run_competitors(links, entities, asked, profiles)
    assert out.filtered.columns == list(FILTERED) and out.filtered.count() == 7  # brand1.com is the company itself


def test_relevance_is_the_same_from_texts_held_ready(spark):
    schema = "name string, domain string, description string, services array<string>, technologies array<string>, linkedin string, emails array<string>, locations array<string>, category string, meta_title string, meta_description string, q_intent string, q_industry string, q_keywords array<string>, q_location string"
    rows = [
        ("Acme", "acme.com", "A full-service agency with case studies, our team.", ["SEO"], None, None, None, ["Delhi"], "cro agency", None, "Free trial", "agency_search", "cro_agency", ["cro", "best"], "Delhi"),
        ("Tool", "tool.io", "Free trial, pricing plan, self-serve dashboard.", [], None, None, None, None, None, "Plans", None, "agency_search", "software", [], None),
        (None, None, None, None, None, None, None, None, None, None, None, "market_discovery", None, ["toys"], None),
    ]
    df = spark.createDataFrame(rows, schema)
    ready = S.score_entities(S.with_entity_signals(df))
    assert "entity_text" not in ready.columns
    assert [r.relevance for r in ready.collect()] == [r.r for r in df.select(S.relevance_score().alias("r")).collect()]
