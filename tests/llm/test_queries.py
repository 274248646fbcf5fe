"""The registered corpus queries on the smallest tables: against SQL, or against brute force."""

import os
import re

import numpy as np
import pytest

from checks import compare
from entitylake.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    text, same = compare.compare(spark, compare.connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLE[name])
    assert same, text


def test_near_vectors_against_brute_force(spark):
    rows = sorted(queries.op1_itq_near_vectors(spark, FOLDER).collect(), key=lambda r: r.vec_id)
    given = sorted(spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x = np.array([r.embedding for r in given], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert [r.n_links for r in rows] == ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()


def test_search_recall(spark):
    rows = queries.op10_permutation_search(spark, FOLDER).collect()
    given = sorted(spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x, ids, hits = np.array([r.embedding for r in given], dtype=float), [r.vec_id for r in given], 0
    for q in [i for i in ids if i % 100 == 0]:
        far = ((x - x[ids.index(q)]) ** 2).sum(axis=1)
        far[ids.index(q)] = np.inf
        hits += len({ids[i] for i in np.argsort(far)[:10]} & {r.vec_id for r in rows if r.query_id == q})
    assert hits / len(rows) >= 0.9


def test_fingerprints_against_brute_force(spark):
    import xxhash

    rows = {r.doc_id: r for r in queries.op7_simhash_groups(spark, FOLDER).collect()}
    marks = {}
    for doc in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), doc.text or ""))
        hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))] if words else []
        marks[doc.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {i: f"{m:016x}" for i, m in marks.items()} == {i: r.fingerprint for i, r in rows.items()}
    ids = sorted(marks)
    x = np.array([marks[i] for i in ids], dtype=np.uint64)
    near, root = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, np.arange(len(ids))
    for _ in ids:
        root = np.where(near, root[None, :], len(ids)).min(axis=1)
    assert [rows[i].component_id for i in ids] == [ids[r] for r in root]


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r for r in queries.op8_language_id(spark, FOLDER).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_main_text_against_the_article_element(spark):
    import html

    rows = {r.page_id: r.text for r in queries.op6_wrapper_main_text(spark, FOLDER).collect()}
    for page in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page.html, re.S)[1]).replace("<br>", " ")
        parts = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert rows[page.page_id] == " ".join(x for x in parts if x)
