"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every corpus operator."""

import hashlib
import math
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entitylake.llm import bpe, debruijn, itq, langid, mixing, permutation, radix, simhash, toxicity, wrapper
from entitylake.llm.queries import tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 97} thing{i}" for i in range(3000))
PASSAGE = " ".join(f"part{i} of" for i in range(40))


def documents(spark):
    rows = [
        (1, "the cat sat on the mat and the dog ran", "en", "a"), (1, "the cat sat on the mat and the dog ran", "en", "a"), (2, None, "en", None), (3, "", None, "b"),
        (None, "le chat est sur la table et le chien court", "fr", "b"), (4, LONG, "en", "c"), (5, "start " + PASSAGE + " end one", "en", "a"),
        (6, PASSAGE + " other tail", "en", "a"), (30, PASSAGE, "en", "a"), (30, PASSAGE, "en", "a"), (30, PASSAGE, "en", "a"), (7, "  \t\n ", "en", "c"), (8, "12 34 !!", None, "c"), (9, "der hund und die katze sind auf dem tisch", "de", ""),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


def clashing(docs):
    """Columns with the names that the operators use inside."""
    names = "row id digest size key source_size target taken epochs rest low high at doc fp kept of_id score accepted lang_pred ids decoded place words"
    return docs.withColumns({n: F.lit("x") for n in names.split()})


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def brute(tokens: list[list], size: int) -> list[set]:
    seen = {}
    for i, t in enumerate(tokens):
        for p in range(len(t) - size + 1):
            seen.setdefault(tuple(t[p : p + size]), []).append((i, p))
    gone = [set() for _ in tokens]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + size))
    return gone


def test_repeated_words(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    words = [(r.text or "").encode().split() for r in rows]
    gone = brute(words, 35)
    want = sorted((str(r.doc_id), len(w), len(g), digest(b" ".join(x for i, x in enumerate(w) if i not in g))) for r, w, g in zip(rows, words, gone))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.repeated_words(clashing(docs)).collect())
    assert got == want and any(g for g in gone)
    assert debruijn.repeated_words(empty(spark)).count() == 0
    cleaned = debruijn.without_repeats(clashing(docs))
    assert cleaned.columns == clashing(docs).columns and cleaned.count() == docs.count()


def test_repeated_bytes(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    data = [(r.text or "").encode() for r in rows]
    gone = brute([list(x) for x in data], 200)
    want = sorted((str(r.doc_id), len(d), len(g), sum(i - 1 not in g for i in g), digest(bytes(x for i, x in enumerate(d) if i not in g))) for r, d, g in zip(rows, data, gone))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix.repeated_bytes(clashing(docs)).collect())
    assert got == want and any(gone)
    assert radix.repeated_bytes(empty(spark)).count() == 0


@pytest.mark.parametrize("unit", ["a", "ab ", "é"])
def test_periodic_texts(spark, unit):
    """One character over and over: every window is equal, and all sync points tie."""
    docs = spark.createDataFrame([(1, unit * 500), (2, unit * 150), (3, "x" + unit * 300)], "doc_id long, text string")
    rows = docs.collect()
    gone = brute([list(r.text.encode()) for r in rows], 200)
    got = {r.doc_id: r.n_removed for r in radix.repeated_bytes(docs).collect()}
    assert got == {r.doc_id: len(g) for r, g in zip(rows, gone)}


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    from entitylake.llm import rolling

    import numpy as np

    monkeypatch.setattr(rolling, "CHUNK", 300)
    data = np.random.default_rng(0).integers(0, 3, 2000).astype(np.uint8)
    offsets = np.array([0, 1700, 1700, 2000])
    text, low, n, _, _ = rolling.text_pieces(lambda a, b: rolling.BYTE_CODES[data[a:b]], offsets, 50, 12)
    windows = [(t, i) for t, l, c in zip(text.tolist(), low.tolist(), n.tolist()) for i in range(l, l + c)]
    assert sorted(windows) == [(0, i) for i in range(1651)] + [(2, i) for i in range(251)]


def test_bpe(spark):
    import tiktoken

    docs = documents(spark).union(spark.createDataFrame([(20, "naïve  日本語  x" + " " * 50_000 + "y'll 9", "en", "a", 1), (21, "z" * 70_000, "en", "a", 1), (22, ("word's  \n\n 12 " * 9000), "en", "a", 1)], DOCS))
    at = tokenizer()
    enc = bpe.encoder(bpe.rank_lines(at["path"]), at["pattern"])
    assert isinstance(enc, tiktoken.Encoding)
    rows = bpe.round_trip(clashing(docs), **at).collect()
    texts = [r.text or "" for r in docs.collect()]
    want = sorted((len(i), digest(struct.pack(f"<{len(i)}I", *i)), digest(t.encode())) for t in texts for i in [enc.encode_ordinary(t)])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.round_trip(empty(spark), **at).count() == 0
    apart = bpe.decode(bpe.encode(docs, **at), **at).select("doc_id", "decoded").collect()
    assert sorted(bytes(r.decoded) for r in apart) == sorted(t.encode() for t in texts)


def test_safe_pieces_join_to_the_text():
    text = "".join(f"word{i} \n" for i in range(5000))
    parts = list(bpe.safe_pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 100


def test_mixing(spark):
    docs = documents(spark)
    rows = mixing.mix_words(clashing(docs)).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert math.isclose(sum(t for _, t in targets), 1.5 * total, rel_tol=1e-9) and all(t <= 2 * s for s, t in targets)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_words(docs.repartition(7)).collect()))
    assert mixing.mix_words(empty(spark)).count() == 0
    mixed = mixing.mix_documents(clashing(docs))
    assert mixed.columns == clashing(docs).columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_words(nothing).collect()] == [0, 0] and mixing.mix_documents(nothing).count() == 0


def test_simhash(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(clashing(docs)).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[7] == {("0" * 16, 2)} and by[1] == {(by[1].copy().pop()[0], 1)}
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, None, 4, 5, 6, 8, 9]))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_language(spark):
    docs = documents(spark)
    rows = langid.split_predict(clashing(docs)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 7, 8)} == {"und"}
    assert langid.split_predict(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.split_predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.only_accepted(clashing(docs)).columns == clashing(docs).columns


def test_toxicity(spark):
    docs = spark.createDataFrame([(i, "you are a worthless clown. fine day" if i % 2 else f"a fine day in town {i}. good") for i in range(60)] + [(90, None), (91, ""), (92, "cl-own x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.split_score(clashing(docs), clashing(labels)).collect()
    assert len(rows) == 63 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id < 60)
    assert {r.predicted for r in rows if r.doc_id in (90, 91)} == {0}
    assert {r.score for r in toxicity.split_score(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.split_score(docs.limit(0), labels).count() == 0


def test_pages(spark):
    page = "<html><body><nav><a>Home</a></nav><article><h1>T&eacute;st %d</h1><p>One <b>bo</b>ld&nbsp;\n text %d<br>next<p>Two</article><footer>foot</footer>"
    given = [(i, f"http://h{i % 2}.x/{i}", page % (i, i)) for i in range(6)] + [(None, None, None), (7, "", ""), (7, "", ""), (8, "http://h0.x", "<p>un<closed <i>x"), (9, "http://deep.x", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(given, "page_id long, url string, html string")
    rows = wrapper.main_text(clashing(pages)).collect()
    assert len(rows) == len(given)
    assert {r.page_id: r.text for r in rows}[3] == "Tést 3 One bold text 3 next Two"
    assert all(r.n_chars == len(r.text) for r in rows) and {r.text for r in rows if r.page_id == 7} == {""}
    assert wrapper.main_text(pages.limit(0)).count() == 0


BAD = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("inf")] * 8), (905, []), (906, [1.0, 2.0])]


def vectors(spark):
    import numpy as np

    x = np.random.default_rng(5).standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400 + i, (x[i] * 3 + 0.02).tolist()) for i in range(40)] + [(500, x[0].tolist()), (500, x[0].tolist()), (None, x[1].tolist())]
    return spark.createDataFrame(rows + BAD, "vec_id long, embedding array<double>"), rows


def test_near_vectors(spark):
    import numpy as np

    frame, rows = vectors(spark)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    got = itq.near_vectors(clashing(frame)).collect()
    assert len(got) == len(rows) + len(BAD)
    assert {(r.n_links, r.component_id == r.vec_id, r.kept) for r in got if r.vec_id and r.vec_id >= 900} == {(0, True, True)}
    found = sum(r.n_links for r in got)
    assert 0.97 * (near.sum() - len(rows)) <= found <= near.sum() - len(rows)
    assert itq.near_vectors(frame.limit(0)).count() == 0
    assert itq.near_vectors(frame.where("vec_id >= 900 AND vec_id < 904")).count() == 4


def test_search(spark):
    import numpy as np

    frame, rows = vectors(spark)
    got = permutation.self_search(clashing(frame)).collect()
    x, ids = np.array([v for _, v in rows]), [i for i, _ in rows]
    hits = 0
    for q in (0, 100, 200, 400):
        far = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        want = [i for i in sorted(range(len(ids)), key=lambda i: (far[i], ids[i] is None, ids[i] or 0)) if ids[i] != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(a.score <= b.score for a, b in zip(mine, mine[1:]))
        hits += len({ids[i] for i in want} & {r.vec_id for r in mine})
    assert hits >= 36
    assert len([r for r in permutation.self_search(frame.where("vec_id IN (100, 101, 900)")).collect()]) == 1
    assert permutation.self_search(frame.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    clashing(documents(spark)).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in out)
    assert not {r.doc_id for r in out} & {2, 3, 7, 8}
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
