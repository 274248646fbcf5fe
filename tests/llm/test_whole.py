"""Cases in which a cut of the data, of the counts or of the pairs would show."""

import math

import pytest

from pyspark.sql import functions as F

from entitylake.llm import langid, wrapper

ALPHABETS = {"aa": "abcdefgh", "bb": "efghijkl"}


def written(lang: str, i: int) -> str:
    letters = ALPHABETS[lang]
    return " ".join("".join(letters[(i * 7 + j * k * 3 + k * k) % 8] for k in range(3 + (i + j) % 5)) for j in range(30))


def kneser_ney(texts: list[str], alphabet: int):
    """The entropy of a text by dictionaries, over all n-grams of `texts`."""

    def fives(text):
        codes = [0] * 4 + [ord(c) if c.isalpha() else 0 for c in " ".join(text.split()) + " "]
        return [tuple(codes[i - 4 : i + 1]) for i in range(4, len(codes))]

    counts, levels = {}, {}
    for text in texts:
        for g in fives(text):
            counts[g] = counts.get(g, 0) + 1
    for level in range(5, 0, -1):
        total, kinds, lower = {}, {}, {}
        for g, n in counts.items():
            total[g[:-1]] = total.get(g[:-1], 0) + n
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels[level] = counts, total, kinds
        counts = lower

    def entropy(text):
        grams, out = fives(text), 0.0
        for g in grams:
            p = 1 / alphabet
            for level in range(1, 6):
                n, total, kinds = levels[level]
                part = g[5 - level :]
                c = part[:-1]
                if c in total:
                    p = kinds[c] * 0.75 / total[c] * p + max(n.get(part, 0) - 0.75, 0) / total[c]
            out -= math.log(p)
        return out / len(grams)

    return entropy


def test_language_model_keeps_every_gram(spark, monkeypatch):
    """Most n-grams stay with the tables, and yet every one of them counts."""
    for name in ("MOST_SENT", "MOST_ENTRIES"):
        monkeypatch.setattr(langid, name, 60, raising=False)
    rows = [(i, written(lang, i), lang) for lang in ALPHABETS for i in range(60)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(learn)
    texts = [written("aa", 200), written("bb", 300), written("aa", 1) + " zzz", "a"]
    frame = spark.createDataFrame([(x,) for x in texts] * 2, "text string")
    got = langid.entropies(frame, model).withColumn("digest", F.hex("digest")).collect()
    known = {r.digest: r.d for r in [*frame.select(F.col("text").alias("d"), F.hex(langid.content_key("text", "text")[1]).alias("digest")).distinct().collect()]}
    of = {lang: kneser_ney([t for _, t, x in rows if x == lang], model.letters) for lang in model.langs}
    assert len(got) == len(texts)
    for row in got:
        for lang, value in zip(model.langs, row.entropy):
            assert math.isclose(value, of[lang](known[row.digest]), rel_tol=1e-5), (known[row.digest], lang)
    held = spark.createDataFrame([(i, written(lang, i), lang) for lang in ALPHABETS for i in range(400, 430)], learn.schema)
    assert all(r.lang == r.lang_pred for r in langid.predict(held, model).collect())


def page_texts(spark, pages: list[tuple[str, str]]) -> list[str]:
    frame = spark.createDataFrame([(i, url, html) for i, (url, html) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in wrapper.main_text(frame).orderBy("page_id").collect()]


def test_copies_of_pages_do_not_make_their_text_template(spark):
    plain, inside = "<body><div><p>text %s</p></div>", "<body><article><p>text %s</p></article>"
    pages = [("http://three.x/a", plain % 1)] * 3 + [("http://ten.x/a", plain % (i % 2)) for i in range(10)] + [("http://article.x/a", inside % 1)] * 10
    real = [("http://real.x/a", f"<body><div class='top'>same</div><div class='c'><p>text {i}</p></div>") for i in range(4)]
    got = page_texts(spark, pages + real)
    assert got == ["text 1"] * 3 + [f"text {i % 2}" for i in range(10)] + ["text 1"] * 10 + [f"text {i}" for i in range(4)]


def test_names_do_not_override_what_varies_or_holds_the_article(spark):
    around = [("http://around.x/", f'<body><div id="page" class="has-sidebar sidebar"><article><header class="entry-header"><h1>t{i}</h1></header><p>b{i}</p></article></div>') for i in range(2)]
    part = [("http://part.x/", '<body><div class="content no-sidebar"><p>words</p></div>')]
    varies = [("http://varies.x/", f'<body><div class="menu">same</div><div class="search"><p>found {i}</p></div>') for i in range(4)]
    single = [("http://single.x/", '<body><div class="sidebar">links</div><div class="c">body</div>')]
    assert page_texts(spark, around + part + varies + single) == ["t0 b0", "t1 b1", "words", *(f"found {i}" for i in range(4)), "body"]


@pytest.mark.parametrize("article", [True, False])
def test_varying_sidebars_adverts_and_comments_are_template(spark, article):
    tag = "article" if article else "div class='post'"
    inner = "<div class='advert'><p>Buy item {i}</p></div><section class='comments'><p>User{i} says {i}, at length and more than the story itself has to say</p></section>"
    page = f"<body><div class='sidebar'><p>Links of day {{i}}</p></div><{tag}><h1>T {{i}}</h1><p>Story {{i}} told here in full</p>{inner}</{tag.split()[0]}><div id='comments'><p>Reader {{i}} wrote</p></div></body>"
    for n in (1, 2, 20):
        got = page_texts(spark, [(f"http://many{n}.x/{i}", page.format(i=i)) for i in range(n)])
        assert got == [f"T {i} Story {i} told here in full" for i in range(n)], n


def test_broken_quotes_are_read_in_linear_time():
    import time

    started = time.time()
    for bad in ("<div " + "'\"" * 5000, "<div " + '"' * 10_001 + ">x", "<a b='\"" * 3000 + ">", "<script " + "\"'" * 3000 + ">"):
        wrapper.read("<p>before</p>" + bad)
    assert time.time() - started < 2


def test_sample_of_copies_is_never_empty(spark):
    from entitylake.llm.common import bounded_sample

    copies = spark.range(2000).selectExpr("id % 3 AS x")
    for bound in (1, 2, 5, 20):
        assert bounded_sample(copies, bound).count() == min(bound, 3)
    assert bounded_sample(copies, 20).count() == 3 and bounded_sample(copies.limit(0), 20).count() == 0


def test_language_limits_come_from_every_learning_row(spark, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 1, raising=False)
    plain = [("en", f"the cat number {i} sat on the mat and saw the dog") for i in range(40)]
    other = [("de", f"die katze nummer {i} lag auf der matte und sah den hund") for i in range(40)]
    long = [("en", "the quick zephyr jumps over vexing wizards " * 600)]  # longer than what was looked at before
    learn = spark.createDataFrame(plain + other + long, "lang string, text string")
    model = langid.fit(learn)
    scores = langid.entropies(learn.select("text"), model).collect()
    entropy = {bytes(r.digest): list(r.entropy) for r in scores}
    rows = learn.select("lang", langid.content_key("text", "text")[1]).collect()
    for i, lang in enumerate(model.langs):
        top = max(e[i] for r in rows if r.lang == lang and (e := entropy[bytes(r.digest)])[i] == min(e))
        assert model.limit[i] == pytest.approx(top + 0.5 * max(0.0, math.log(model.letters) - top))
    assert all(r.accepted for r in langid.predict(learn, model).collect())


def test_labels_meet_digests_not_texts(spark):
    """The machine is learnt without a shuffle of texts, from the sample that joined texts would give."""
    from entitylake.llm import toxicity

    noise = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.sha2(F.concat_ws("-", "doc_id", i), 256)))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 1, "worthless clown. ").otherwise("fine day. "), noise).alias("text"))
    docs = docs.union(docs.where("doc_id < 9"))
    labels = spark.range(400).select(F.col("id").alias("of"), (F.col("id") % 2).cast("int").alias("toxic"))
    shuffled = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        machine = toxicity.learn_by_id(docs, labels, rows=20)
        docs.groupBy("doc_id").count().collect()
        written = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert 0 < written < 1_000_000 < docs.select(F.sum(F.length("text"))).first()[0] / 5
    whole = toxicity.learn(docs.join(labels, F.col("doc_id") == F.col("of")).select("text", "toxic"), rows=20)
    assert sorted(machine.landmarks) == sorted(whole.landmarks) and abs(machine.scores(["worthless clown"]) - whole.scores(["worthless clown"])).max() < 1e-6


def test_posted_fingerprints_are_not_broadcast(spark):
    from entitylake.llm import simhash

    links = simhash.class_links(spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and links.count() == 2


def test_tables_that_grow_with_documents_are_never_broadcast(spark, monkeypatch):
    """Files are smaller than their rows, most of all behind an array of them, so sizes alone would send them through the driver."""
    from entitylake.llm import components, debruijn, repeats, simhash

    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (components, debruijn, langid, repeats, simhash):
        was = module.stored
        monkeypatch.setattr(module, "stored", lambda df, was=was: was(planned(df)))
    docs = spark.createDataFrame([(i, written(lang, i) + " " + written("aa", 99), lang) for i in range(12) for lang in ALPHABETS], "doc_id long, text string, lang string")
    for step in (simhash.keep_one, simhash.near_duplicates, langid.only_accepted, langid.split_predict, debruijn.without_repeats, debruijn.repeated_words):
        assert planned(step(docs)).count() > 0
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in "".join(plans) and [x for x in joins if "busy" not in x] == []  # sync points of more than 1,024 different pieces: few
