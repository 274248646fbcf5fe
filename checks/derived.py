"""Input tables derived from the given ones by deterministic SQL.

Each statement is written once in a subset both engines understand: `{name}` is a table, `$TS` the
timestamp type without zone. Lists are '|'-separated text. Nothing is random and nothing is dropped
to make a check cheap, so every derived table grows with the given ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from entitylake.sources.tables import dealt

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

#: Small tables of which each row becomes pages, phrases or titles.
NARROW = ("customer", "supplier", "part")

K = "CAST(c_custkey AS STRING)"
SLUG = "'brand' || CAST(c_custkey % 97 AS STRING)"

DERIVED: dict[str, str] = {}

DERIVED["fx_queries"] = f"""
SELECT c_custkey AS query_id,
  CASE c_custkey % 14
    WHEN 0 THEN 'Find competitors of ' || {SLUG} || '.com'
    WHEN 1 THEN {SLUG} || '.com'
    WHEN 2 THEN 'https://www.' || {SLUG} || '.com/ competitor'
    WHEN 3 THEN {SLUG} || ' alternative'
    WHEN 4 THEN 'Best Shopify CRO agencies'
    WHEN 5 THEN 'Sports jersey manufacturers in Delhi'
    WHEN 6 THEN 'Best AI agencies'
    WHEN 7 THEN 'Newly launched toy brands'
    WHEN 8 THEN 'CRO companies using Optimizely'
    WHEN 9 THEN 'Top marketing automation platforms'
    WHEN 10 THEN 'SaaS companies for email marketing'
    WHEN 11 THEN 'game agency near London'
    WHEN 12 THEN {SLUG} || ' founder and ceo'
    ELSE 'zzz ' || {SLUG} || ' nike' END AS raw,
  CAST('2024-01-01 00:00:00' AS $TS) + c_custkey * INTERVAL '1' MINUTE AS created_at
FROM {{customer}}"""

# The phrases above and every user turn of the conversations as a noisy query log.
DERIVED["fx_query_log"] = """
SELECT query_id, raw FROM {fx_queries}
UNION ALL
SELECT 1000000000 + conv_id * 1000 + turn AS query_id, text AS raw FROM {conversations} WHERE role = 'user'"""

DERIVED["fx_entities"] = f"""
SELECT c_custkey AS entity_id,
  CASE WHEN c_custkey % 13 = 5 THEN '' WHEN c_custkey % 17 = 3 THEN 'X'
    ELSE 'Brand ' || {K} || ' ' || lower(c_mktsegment) END AS name,
  CASE WHEN c_custkey % 29 = 7 THEN 'localhost' WHEN c_custkey % 41 = 3 THEN 'clutch.co'
    WHEN c_custkey % 11 = 4 THEN 'www.Brand' || CAST(c_custkey - 1 AS STRING) || '.com'
    ELSE 'brand' || {K} || '.com' END AS domain,
  CASE c_custkey % 7
    WHEN 1 THEN 'We help retailers. Our team is a full-service agency with case studies and client results.'
    WHEN 2 THEN 'Start your free trial of our heatmap tool today, see the pricing plan, no agency needed here.'
    WHEN 3 THEN 'Free trial, pricing plan, self-serve CRM software and dashboard with per user billing for all.'
    WHEN 4 THEN 'Online poker and casino betting with a payday loan for everyone who wants to play at night.'
    WHEN 5 THEN 'Short text.'
    WHEN 6 THEN 'A plain company that sells ' || lower(c_mktsegment) || ' goods and software in many places of the world.'
    END AS description,
  CASE c_custkey % 5 WHEN 1 THEN 'SEO|CRO' WHEN 2 THEN 'A/B Testing|Conversion Rate Optimization|Web Development'
    WHEN 3 THEN 'AI|Machine Learning' WHEN 4 THEN 'Consulting|Strategy|Branding|Design' ELSE '' END AS services,
  CASE c_custkey % 3 WHEN 1 THEN 'Shopify' WHEN 2 THEN 'React|Stripe' ELSE '' END AS technologies,
  CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'Delhi|' || n_name ELSE n_name END AS locations,
  CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'info@brand' || {K} || '.com|sales@brand' || {K} || '.com' END AS emails,
  CASE WHEN c_custkey % 6 = 0 THEN '555-010-' || {K} ELSE '' END AS phones,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN ''
    ELSE 'https://www.linkedin.com/company/brand' || {K} END AS linkedin,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'cro agency' WHEN 3 THEN 'software'
    WHEN 4 THEN 'ai' ELSE 'Digital  Marketing' END AS category,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'Brand ' || {K} || ' of ' || n_name || ', London' END AS meta_title,
  CASE WHEN c_custkey % 8 = 0 THEN 'Per month plans, split testing tool and 14-day free use' ELSE NULL END AS meta_description,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'https://brand' || {K} || '.com' END AS source,
  CAST((c_custkey * 37) % 101 AS DOUBLE) / 100 AS confidence,
  CAST((c_custkey * 53) % 101 AS DOUBLE) / 100 AS relevance,
  CAST('2024-02-01 00:00:00' AS $TS) - ((c_custkey % 900) * INTERVAL '1' HOUR)
    - ((c_custkey % 60) * INTERVAL '1' MINUTE) AS last_seen,
  CAST('2024-02-01 00:00:00' AS $TS) - ((c_custkey % 900 + c_custkey % 120) * INTERVAL '1' HOUR)
    - ((c_custkey % 60) * INTERVAL '1' MINUTE) AS first_seen,
  c_custkey % 8 <> 0 AS is_valid,
  c_mktsegment AS segment
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""

DERIVED["fx_links"] = """
SELECT o_custkey AS query_id, l_partkey AS entity_id, l_discount * 5 AS score, l_returnflag = 'N' AS is_new,
  l_shipdate AS ts, l_orderkey, l_linenumber
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

DERIVED["fx_pairs"] = """
SELECT DISTINCT query_id, entity_id FROM {fx_links}"""

DERIVED["fx_versions"] = """
SELECT 'brand' || CAST(o_custkey AS STRING) || '.com' AS domain, o_orderdate AS version_ts, o_orderkey AS version_id,
  'Brand ' || CAST(o_custkey AS STRING) || CASE WHEN o_orderpriority LIKE '1%' THEN ' Inc' ELSE '' END AS name,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Status ' || o_orderstatus || ' company' END AS description,
  CASE WHEN o_totalprice < 150000 THEN 'SEO' WHEN o_totalprice < 300000 THEN 'SEO|CRO' ELSE '' END AS services,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL
    ELSE 'https://www.linkedin.com/company/brand' || CAST(o_custkey AS STRING) END AS linkedin,
  CASE WHEN o_orderkey % 2 = 0 THEN 'info@brand' || CAST(o_custkey AS STRING) || '.com' ELSE '' END AS emails,
  CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE lower(o_orderpriority) END AS category,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence
FROM {orders}"""

DERIVED["fx_crawl_logs"] = """
SELECT event_id, CAST(floor(event_id / 2) AS BIGINT) AS log_id, user_id AS query_id,
  'https://brand' || CAST(user_id AS STRING) || '.com' AS url,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'crawling' WHEN 'click' THEN 'skipped'
    WHEN 'signup' THEN 'pending' ELSE 'failed' END AS status,
  CAST(floor(value * 100) AS BIGINT) AS duration,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS entities_found,
  ts AS updated_at
FROM {events}"""

DERIVED["fx_agent_events"] = """
SELECT event_id, user_id AS job_id,
  CASE event_id % 5 WHEN 0 THEN 'profile' WHEN 1 THEN 'search' WHEN 2 THEN 'match' WHEN 3 THEN 'filter' ELSE 'save' END AS stage,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'stage_done' WHEN 'signup' THEN 'stage_start'
    ELSE 'log' END AS type,
  event_id % 101 AS progress, ts
FROM {events}"""

DERIVED["fx_validations"] = """
SELECT o_orderkey AS validation_id, 'brand' || CAST(o_custkey AS STRING) || '.com' AS domain,
  o_orderstatus <> 'F' AS passed, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS score, o_orderdate AS created_at
FROM {orders}"""

Q = "chr(39)"
DERIVED["fx_rich_pages"] = f"""
SELECT 1000000000 + c_custkey AS page_id,
  CASE c_custkey % 3 WHEN 0 THEN 'https://www.brand' || {K} || '.com/' WHEN 1 THEN 'https://brand' || {K} || '.com'
    ELSE 'http://Brand' || {K} || '.com/home?x=1' END AS url,
  '<!DOCTYPE html><html><head><title>' ||
  CASE c_custkey % 4 WHEN 0 THEN 'Brand ' || {K} || ' | Home' WHEN 1 THEN 'Helping you grow'
    WHEN 2 THEN ' Brand ' || {K} || '  - Official site &amp; shop' ELSE '' END || '</title>' ||
  CASE c_custkey % 5
    WHEN 0 THEN '<meta name="description" content="We help brands: our team runs A/B test programs &amp; CRO audits.">'
    WHEN 1 THEN '<META content="Short one" name="description"><meta property="og:description" content="Online retail marketplace for ' || lower(c_mktsegment) || ' buyers and sellers.">'
    WHEN 2 THEN '<meta property="og:description" content="Digital marketing and SEO for ' || lower(c_mktsegment) || ' firms with a free trial.">'
    WHEN 3 THEN '<meta name=' || {Q} || 'description' || {Q} || ' content=' || {Q} || 'Cloud service and "devops platform" company' || {Q} || '>'
    ELSE '' END ||
  CASE WHEN c_custkey % 2 = 0 THEN '<meta name="keywords" content="a, b, ' || lower(c_mktsegment) || '">' ELSE '' END ||
  CASE c_custkey % 6 WHEN 0 THEN '<meta property="og:title" content="Brand ' || {K} || ' - Home">'
    WHEN 1 THEN '<meta property="og:title" content="Discover the world of ' || {K} || '">'
    WHEN 2 THEN '<meta property="og:title" content="E-commerce Hub">' ELSE '' END ||
  CASE WHEN c_custkey % 3 = 0 THEN '<link rel="canonical" href="https://brand' || {K} || '.com/">' ELSE '' END ||
  CASE c_custkey % 7
    WHEN 0 THEN '<script type="application/ld+json">{{{{"@type":"Organization","name":"Brand ' || {K} || ' Ltd","description":"Structured text","foundingDate":2001,"numberOfEmployees":{{{{"minValue":' || {K} || '}}}},"address":{{{{"addressLocality":"Pune","addressCountry":"IN"}}}},"sameAs":["https://x.com/b' || {K} || '","https://www.linkedin.com/company/b' || {K} || '"],"founder":{{{{"@type":"Person","name":" Jane Doe ","sameAs":["https://linkedin.com/in/jd"]}}}},"knowsAbout":["SEO",{{{{"name":"CRO"}}}}]}}}}</script>'
    WHEN 1 THEN '<script type="application/ld+json">[{{{{"@type":"WebSite","name":"no"}}}},{{{{"@type":"LocalBusiness","name":"Shop ' || {K} || '","address":"12 Main St","numberOfEmployees":5,"employee":[{{{{"name":"Bob Ray","jobTitle":"CTO","url":"https://x.com/bob"}}}},{{{{"@type":"Dog","name":"Rex"}}}},{{{{"name":"Al"}}}}],"hasOfferCatalog":{{{{"itemListElement":[{{{{"name":"Repairs"}}}},{{{{"price":3}}}}]}}}}}}}}]</script>'
    WHEN 2 THEN '<script type="application/ld+json">{{{{"@graph":[{{{{"@type":"WebPage"}}}},{{{{"@type":["Corporation","Brand"],"name":"Graph ' || {K} || '","member":{{{{"name":"Mia Wong"}}}}}}}}]}}}}</script>'
    WHEN 3 THEN '<script type="application/ld+json">{{{{"@type":"Organization", broken</script>'
    WHEN 4 THEN '<script type="application/ld+json">{{{{"@type":"Person","name":"Not Org"}}}}</script>'
    ELSE '' END ||
  CASE c_custkey % 4 WHEN 0 THEN '<script src="https://cdn.shopify.com/s.js"></script><script>var a="</p><h1>no</h1>";</script>'
    WHEN 1 THEN '<script src="/_next/static/x.js"></script><script src="https://js.stripe.com/v3"></script>'
    WHEN 2 THEN '<link href="/wp-content/a.css"><script src="https://www.googletagmanager.com/gtm.js"></script>' ELSE '' END ||
  '</head><body><!-- <a href="https://hidden.com/">x</a> --><nav><a href="#top">t</a><a class="n" href="/about-us?ref=1&amp;x=2">About</a>' ||
  '<a href="services">Services</a><a href="mailto:info@brand' || {K} || '.com">m</a><a href="tel:123">c</a>' ||
  CASE WHEN c_custkey % 2 = 0 THEN '<a href="https://brand' || {K} || '.com/our-team">Team</a><a href="https://www.linkedin.com/company/brand' || {K} || '">in</a><a href="https://x.com/brand' || {K} || '">x</a>'
    ELSE '<a href="/blog/about-people">b</a><a href="/company/people-and-work">p</a><a href="https://github.com/brand' || {K} || '">gh</a><a href="/what-we-offer-now">o</a>' END ||
  '<a href="https://brand' || CAST((c_custkey * 7) % 97 AS STRING) || '.com/">peer</a><a href="https://www.rival' || CAST(c_custkey % 50 AS STRING) || '.io">r</a>' ||
  '<a href=' || {Q} || '//cdn.brand' || {K} || '.com/x' || {Q} || '>c</a><a href="https://google.com/">g</a><a href="https://clutch.co/agencies">d</a></nav>' ||
  CASE c_custkey % 5 WHEN 0 THEN '<h1>Brand ' || {K} || '</h1>' WHEN 1 THEN '<h1>We build things for people who care a lot</h1><h2> <b>Brand</b> ' || {K} || ' Group </h2>'
    WHEN 2 THEN '<h2>Our services &amp; SEO</h2><h1>  </h1>' WHEN 3 THEN '<h1 class="t">Top marketplace</h1><h3>Jane Roe</h3><p>Chief Executive Officer</p>' ELSE '' END ||
  CASE c_custkey % 6 WHEN 0 THEN '<h4>Mary Major</h4><div>Head of Sales</div>' WHEN 1 THEN '<p><strong>Ann Lee</strong> is our VP of things</p><li><b>Platform Team</b> President</li>'
    WHEN 2 THEN '<figcaption>Tom Hanks | Founder | Acme</figcaption><p class="byline">Sue Storm, Managing Director</p>'
    WHEN 3 THEN '<div class="our team-member x"><span class="job-title">Chief Executive</span><div><h5>Cara Dunn</h5></div></div><ul><li class="staff-card"><p class="full-name">Bo <i>Derek</i></p><p>VP of Sales</p></li></ul>' ELSE '' END ||
  CASE c_custkey % 4 WHEN 0 THEN '<main>' WHEN 1 THEN '<article>' WHEN 2 THEN '<div class="big content">' ELSE '<section>' END ||
  '<p>Brand ' || {K} || ' is a company headquartered in Pune, India with a Berlin office. Contact info@brand' || {K} || '.com or sales@example.com, call (415) 555-' || substr(CAST(10000 + c_custkey % 9000 AS STRING), 2, 4) || ' now.</p>' ||
  CASE c_custkey % 5
    WHEN 0 THEN '<p>We help clients. Our team has case studies, testimonials and a portfolio of client work. Experts in conversion rate optimization and SEO, SEO, SEO and seo.</p><p>CEO: John Smith. Ann Ray, CTO. Jane Roe is the Founder of it. Alice Brown Vice President.</p>'
    WHEN 1 THEN '<p>Shop now and add to cart. Plans from $' || CAST(c_custkey % 90 AS STRING) || '.50 / month with a rating of ' || CAST(c_custkey % 7 AS STRING) || '.5 stars. Web development too.</p>'
    WHEN 2 THEN '<p>Free trial, then $20 /mo. See the pricing plan, per seat. Machine learning analytics software.</p>'
    WHEN 3 THEN '<p>A marketplace to buy and sell. It is free. Email marketing and social media.</p>'
    ELSE '<p>Starting at $40 we do it all! Tiny.</p>' END ||
  CASE c_custkey % 4 WHEN 0 THEN '</main>' WHEN 1 THEN '</article>' WHEN 2 THEN '</div>' ELSE '</section>' END ||
  '</body></html>' AS html
FROM {{customer}}
UNION ALL
SELECT 2000000000 + c_custkey AS page_id, 'https://brand' || {K} || '.com/about-us?ref=1&x=2' AS url,
  '<html><head><title>About</title></head><body><main><p>CEO: Peter Stone. Jane Roe, Founder. Lara Croft is the CTO. COO: ' ||
  CASE c_custkey % 3 WHEN 0 THEN 'Mary Major' WHEN 1 THEN 'Ann Lee' ELSE 'Omar Khan' END || '.</p></main></body></html>' AS html
FROM {{customer}} WHERE c_mktsegment <> 'AUTOMOBILE'
UNION ALL
SELECT 3000000000 + c_custkey AS page_id, 'https://brand' || {K} || '.com/services' AS url,
  '<html><head><title>Services</title></head><body><article><h2>What we do</h2><p>Email marketing, data engineering and ' || lower(c_mktsegment) ||
  ' logistics.</p></article></body></html>' AS html
FROM {{customer}} WHERE c_mktsegment <> 'BUILDING'"""

DERIVED["fx_pages"] = """
SELECT page_id, url, html FROM {pages}
UNION ALL
SELECT page_id, url, html FROM {fx_rich_pages}"""

# Captures of directory pages, several of each address; what they list includes hosts that nothing else names.
_LISTED = " || ".join(
    f"""'<a href="https://www.brand' || CAST((c_custkey * 31 + {i} * 17) % 150 + 1 AS STRING) || '.com/">x</a>'""" for i in range(9)
)
DERIVED["fx_directory_pages"] = f"""
SELECT 4000000000 + c_custkey AS page_id,
  CASE c_custkey % 6 WHEN 0 THEN 'https://clutch.co/agencies/conversion-rate-optimization' WHEN 1 THEN 'https://goodfirms.co/cro-companies'
    WHEN 2 THEN 'https://www.topdevelopers.co/blog/top-conversion-rate-optimization-companies' WHEN 3 THEN 'https://clutch.co/agencies/digital-marketing'
    WHEN 4 THEN 'https://goodfirms.co/digital-marketing-companies' ELSE 'https://empty' || {K} || '.com/' END AS url,
  CASE WHEN c_custkey % 6 = 5 THEN '' ELSE '<html><head><title>Directory</title></head><body><main><a href="/next">n</a><a href="https://google.com/">g</a>' ||
    '<a href="https://brand' || {K} || '.com/deep/page">d</a>' || {_LISTED} || '</main></body></html>' END AS html
FROM {{customer}}"""

DERIVED["fx_run_pages"] = """
SELECT page_id, url, html FROM {fx_pages}
UNION ALL
SELECT page_id, url, html FROM {fx_directory_pages}"""

DERIVED["fx_serp"] = """
SELECT query_id, CASE WHEN query_id % 3 = 0 THEN NULL ELSE 'brand' || CAST((query_id * 7) % 97 AS STRING) END AS company,
  '<div class="result"><a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.brand' ||
  CAST((query_id * 7) % 97 AS STRING) || '.com%2F&amp;rut=1">Brand <b>one</b></a></div>' ||
  '<div class="result"><a class="result__a" href="https://brand' || CAST((query_id * 11) % 97 AS STRING) || '.com/pricing">Direct</a></div>' ||
  '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fads.com%2F">An Advertisement</a>' ||
  '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.g2.com%2Fx">G2</a>' ||
  '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fmybrand' || CAST((query_id * 7) % 97 AS STRING) ||
  'shop.io%2Fa%3Fb%3D1&rut=2">Compound</a><a class="result__a" href="//duckduckgo.com/l/?q=1">None</a>' ||
  '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fbrand' || CAST((query_id * 11) % 97 AS STRING) ||
  '.com%2F">Again</a><a class="other" href="https://other.com/">Other</a>' AS html
FROM {fx_queries}"""

DERIVED["fx_titles"] = """
SELECT p_partkey AS id,
  CASE p_partkey % 8 WHEN 0 THEN p_name || ' (company)' WHEN 1 THEN 'List of ' || p_name WHEN 2 THEN 'Twitch (service)'
    WHEN 3 THEN p_name || ' 2024' WHEN 4 THEN 'GitLab' WHEN 5 THEN p_name || ' ' || p_type || ' holdings of the northern isles'
    WHEN 6 THEN '!!' ELSE initcap_free || '-' || lower(p_brand) END AS title
FROM (SELECT p_partkey, p_name, p_type, p_brand, upper(p_name) AS initcap_free FROM {part}) t"""

DERIVED["fx_topics"] = """
SELECT p_partkey AS id, '[{{"Text":"x","FirstURL":"https://duckduckgo.com/' || replace(p_name, ' ', '%20') ||
  '"}},{{"Name":"group","Topics":[{{"FirstURL":"https://duckduckgo.com/Twitch_%28service%29"}},{{"FirstURL":"https://duckduckgo.com/' ||
  lower(p_brand) || '"}}]}},{{"Text":"no url"}}]' AS topics
FROM {part}"""

DERIVED["fx_profiles"] = """
SELECT 'brand' || CAST(entity_id AS STRING) || '.com' AS domain, 'Profile ' || CAST(entity_id AS STRING) AS name,
  CASE entity_id % 4 WHEN 0 THEN 'cro_agency' WHEN 1 THEN 'software' WHEN 2 THEN NULL ELSE 'ai' END AS industry,
  CASE entity_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'CRO|A/B Testing' WHEN 2 THEN 'Conversion Rate Optimization|Web Development Services'
    WHEN 3 THEN 'SEO|Machine Learning Platform|Data' ELSE 'Email Marketing|Shopify Design' END AS primary_services,
  CASE entity_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'SEO|Branding' ELSE 'CRO|Design|SEO' END AS secondary_services,
  CASE entity_id % 4 WHEN 0 THEN 'agency' WHEN 1 THEN 'tool' WHEN 2 THEN 'unknown' ELSE 'agency' END AS business_model,
  CASE WHEN entity_id % 6 = 0 THEN NULL ELSE 'Stored text ' || segment END AS description
FROM {fx_entities} WHERE segment IN ('BUILDING', 'MACHINERY')"""

DERIVED["fx_suggestions"] = f"""
SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {SLUG} || '.com' END AS company,
  'rival' || CAST(c_custkey % 50 AS STRING) || '.io|www.Brand' || CAST((c_custkey * 5) % 97 AS STRING) || '.com/|google.com|nodot' AS competitors,
  CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence,
  CASE c_custkey % 4 WHEN 0 THEN 'software' WHEN 1 THEN 'cro_agency' WHEN 2 THEN 'gardening' ELSE NULL END AS industry
FROM {{customer}} WHERE c_acctbal > 0"""

DERIVED["fx_web"] = """
SELECT o_custkey AS query_id, o_orderkey AS pos, 'web' || CAST(o_orderkey % 53 AS STRING) || '.com' AS domain,
  CASE o_orderkey % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'travel' ELSE NULL END AS industry
FROM {orders}"""

DERIVED["fx_seeds"] = """
SELECT CASE s_suppkey % 8 WHEN 0 THEN 'cro_agency' WHEN 1 THEN 'software' WHEN 2 THEN 'ai' WHEN 3 THEN 'apparel' WHEN 4 THEN 'food'
    WHEN 5 THEN 'digital_marketing' WHEN 6 THEN 'toys' ELSE 'travel' END AS industry,
  s_suppkey % 8 AS priority, s_suppkey AS pos,
  CASE WHEN s_suppkey % 23 = 5 THEN 'clutch.co' ELSE 'brand' || CAST(s_suppkey * 3 AS STRING) || '.com' END AS domain
FROM {supplier}"""

DERIVED["fx_searches"] = """
SELECT o_custkey AS query_id, o_orderkey AS ordinal,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ai' WHEN o_orderkey % 3 = 1 THEN '' ELSE NULL END AS industry,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'About ' || o_orderpriority END AS description,
  CASE o_orderstatus WHEN 'F' THEN 'wikipedia' WHEN 'O' THEN 'duckduckgo' ELSE 'none' END AS source,
  'web' || CAST(o_orderkey % 53 AS STRING) || '.com|web' || CAST(o_orderkey % 7 AS STRING) || '.com' AS domains
FROM {orders}"""

DERIVED["fx_names"] = """
SELECT p_partkey AS id, p_name || ' ' || p_brand AS name, 'part' || CAST(p_partkey % 700 AS STRING) || '.com' AS domain FROM {part}
UNION ALL
SELECT 1000000000 + p_partkey AS id,
  substr(p_name, 1, CAST(p_partkey % length(p_name) AS INT)) || substr(p_name, CAST(p_partkey % length(p_name) AS INT) + 2, 100) || p_type AS name,
  'WWW.copy' || CAST(p_partkey AS STRING) || '.com' AS domain FROM {part}"""

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _depends(name: str) -> list[str]:
    return sorted(set(_REF.findall(DERIVED[name])))


def spark_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name in GIVEN:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    inputs = {d: spark_table(spark, folder, d) for d in _depends(name)}
    inputs |= {d: dealt(inputs[d]) for d in NARROW if d in inputs}
    return spark.sql(DERIVED[name].replace("$TS", "TIMESTAMP_NTZ"), **inputs)


def oracle_with(names: list[str]) -> str:
    """WITH list of the derived tables a statement reads, dependencies first; '' when there are none."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in GIVEN or name in ordered:
            return
        for d in _depends(name):
            visit(d)
        ordered.append(name)

    for n in names:
        visit(n)
    parts = []
    for n in ordered:
        sql = DERIVED[n].replace("$TS", "TIMESTAMP")
        parts.append(f"{n} AS ({sql.format(**{d: d for d in _depends(n)})})")
    return ",\n".join(parts)
