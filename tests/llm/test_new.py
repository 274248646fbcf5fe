"""Spelling variants, line runs and centroid clusters: brute force, and the cases that break such jobs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylake.llm import centroids, linedrop, spelling

DOCS = "doc_id bigint, text string"


def clashing(df):
    return df.withColumns({n: F.lit("x") for n in "word n near way back pos node h1 h2 r1 r2 gone kept n_lines lines coef cluster of m1 part".split()})


# --- spelling variants


def brute_words(rows, slip=199):
    found = Counter()
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def brute_groups(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v.encode()), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [n, len(near), form, words.get(form)]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return out


def groups_of(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in rows}


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = {}
    for length in (6, 7, 8):
        for _ in range(250):
            words["".join(rng.choice(list("abé"), length))] = int(rng.integers(5, 400))
    words |= {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "ÿ" * 6: 9, "ÿ" * 5 + "é": 9}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert groups_of(spelling.variant_groups(frame)) == brute_groups(words)


def test_words_longer_than_the_trie(spark):
    base = "abcdefghij"
    words = {base[:8]: 5, base[:9]: 30, base: 200, base + "k": 6, "x" + base: 40, base[:5] + "z" + base[6:]: 300, base + "é": 5, "m" * 3000: 7, "m" * 3001: 90, "aabbcc": 6, "aabbc": 60}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert groups_of(spelling.variant_groups(frame, levels=9)) == brute_groups(words)
    assert groups_of(spelling.variant_groups(frame.limit(0))) == {}


def test_vocabulary_of_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    words = [f"{a}{b}letter" for a in "abcdÀé" for b in "xyzÿ"] + ["short", "CAPITALS", "Àccented"]
    rows = [(i, " ".join(words[(i * 7 + j * j) % len(words)] + ",1"[j % 2] for j in range(60))) for i in range(300)]
    rows += [(None, "orphans " * 9)] * 2 + [(4, None), (5, ""), (5, ""), (6, "中" * 50 + "letters" * 9000)] + [(9, "repeated rows")] * 6
    got = spelling.vocabulary(clashing(spark.createDataFrame(rows, DOCS)).repartition(5))
    assert {r.word: r.n for r in got.collect()} == brute_words(rows)
    assert groups_of(spelling.spelling_groups(spark.createDataFrame(rows, DOCS))) == brute_groups(brute_words(rows))
    assert groups_of(spelling.spelling_groups(spark.createDataFrame([], DOCS))) == {}


# --- line runs


def brute_lines(rows, least=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    seen = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")})
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((str(doc_id), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def line_rows():
    rows = [(i, f"All rights reserved\nown line {i}\n\n  SHARED {i % 40}\t\nend") for i in range(300)]
    rows += [(1000 + i, "\r Nine times É\né") for i in range(9)] + [(2000 + i, "ten TIMES\x0b\nTen times\n ten times") for i in range(10)]
    rows += [(None, None), (None, ""), (3, "end"), (3, "end"), (7, "\n" * 5000 + "end"), (8, "end\n" * 20_000)] + [(9, "same row\nx")] * 12
    return rows


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_against_brute_force(spark, batches):
    rows = line_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(6))
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in linedrop.line_digests(docs, batches=batches).collect())
    assert got == brute_lines(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_lines_keep_columns_and_nulls(spark):
    docs = clashing(spark.createDataFrame(line_rows(), DOCS))
    out = linedrop.without_common_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id IS NULL").collect()} == {None, ""}
    assert linedrop.line_digests(docs.limit(0)).count() == 0


def test_runs_are_levelled_and_settled_lines_leave(spark):
    runs = linedrop.LineRuns(spark, least=3, buckets=4)
    for batch in range(5):
        rows = [(i, -i) for i in range(20) for _ in range(1 + (i == 0) * 5)] if batch < 4 else [(99, 1)]
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    plan = spark.table(runs.runs()[1]).join(spark.table(runs.runs()[0]).hint("merge"), ["h1", "h2"], "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.h1: r.n for r in runs.settled().collect()}
    runs.close()
    assert set(got) == set(range(20)) and got[0] == 6 and all(3 <= got[i] <= 4 for i in range(1, 20))


# --- centroid clusters


def brute_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"2:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), kept[i][1]))
    centres = [list(kept[i][1]) for i in order[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept]
        return [(min(range(len(centres)), key=lambda c: (f[c], c)), min(f)) for f in far]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), (x, _) in zip(kept, at) if x == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at, out = assign(), []
    for (i, _), (c, d) in zip(kept, at):
        out.append((str(i), c, d, sum(y for x, y in at if x == c), sum(y for _, y in at), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()))
    return sorted(out)


def clusters_of(frame):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect())


@pytest.mark.parametrize("ties", [False, True])
def test_clusters_against_brute_force(spark, ties):
    rng = np.random.default_rng(1)
    made = rng.integers(-2, 3, (160, 8)) / 256 if ties else rng.standard_normal((160, 8)) * rng.choice([0.2, 1, 5], (160, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(500, made[0].tolist())] * 60 + [(None, made[1].tolist()), (700, [0.0] * 8)]
    bad = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] * 8)]
    frame = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5))
    want = brute_clusters(rows + bad, 12, 3, 8)
    assert clusters_of(centroids.cluster_vectors(frame, k=12, rounds=3, width=8)) == want
    assert centroids.cluster_vectors(frame.where("vec_id >= 900"), width=8).count() == 0
    few = frame.where("vec_id < 5")
    assert clusters_of(centroids.cluster_vectors(few, k=12, rounds=2, width=8)) == brute_clusters(rows[:5], 12, 2, 8)


def test_search_leaves_out_the_strictly_worse_only():
    rng = np.random.default_rng(2)
    turn = centroids.hadamard(64)
    assert (turn @ turn.T == 64 * np.eye(64, dtype=np.int64)).all() and (np.diff(np.sign(turn), axis=1) != 0).sum(axis=1).tolist() == list(range(64))
    x, c = rng.integers(-3, 4, (300, 64)), rng.integers(-3, 4, (40, 64))
    c[7] = c[3]
    cluster, far = centroids.nearest(x @ turn.T, c @ turn.T)
    want = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cluster == want.argmin(axis=1)).all() and (far == 64 * want.min(axis=1)).all()


def test_huge_components_stay_within_longs(spark):
    frame = spark.createDataFrame([(i, [1e300 * (-1) ** (i + j) for j in range(8)]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = centroids.cluster_vectors(frame, k=2, rounds=1, width=8).collect()
    assert len(rows) == 6 and all(r.distance >= 0 and r.inertia >= r.cluster_inertia >= r.distance for r in rows)


# --- busy sync points of the repeat operators


@pytest.mark.parametrize("most", [0, 2, 1024])
def test_repeats_where_many_pieces_meet(spark, monkeypatch, most):
    """One passage in most documents, after and before different texts, and within itself."""
    from entitylake.llm import debruijn, radix, repeats

    monkeypatch.setattr(repeats, "MOST_PIECES", most)
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(120))
    words = ["aa", "bb", "cc", "dd"]
    rows = []
    for i in range(60):
        before, after = (" ".join(rng.choice(words, int(rng.integers(0, 40)))) for _ in range(2))
        cut = int(rng.integers(0, 60)) if i % 3 else 0
        rows.append((i, f"{before} {' '.join(passage.split()[cut:])} {after}{' x' * (i % 7)}"))
    rows.append((99, passage + " " + passage))
    docs = spark.createDataFrame(rows, DOCS)

    def brute(tokens, size):
        seen = {}
        for i, t in enumerate(tokens):
            for p in range(len(t) - size + 1):
                seen.setdefault(tuple(t[p : p + size]), []).append((i, p))
        gone = [set() for _ in tokens]
        for places in seen.values():
            if len(places) > 1:
                for i, p in places:
                    gone[i].update(range(p, p + size))
        return [len(g) for g in gone]

    bytes_gone = brute([text.encode() for _, text in rows], 200)
    words_gone = brute([text.encode().split() for _, text in rows], 35)
    got = {r.doc_id: r.n_removed for r in radix.repeated_bytes(docs).collect()}
    assert [got[i] for i, _ in rows] == bytes_gone and max(bytes_gone) > 300
    got = {r.doc_id: r.n_removed for r in debruijn.repeated_words(docs).collect()}
    assert [got[i] for i, _ in rows] == words_gone and max(words_gone) > 100


@pytest.mark.parametrize("kind", ["centre", "common"])
def test_near_vectors_that_share_a_direction(spark, kind):
    """Most vectors around one centre, or all with a large common component: links, components and what is kept."""
    from entitylake.llm import itq

    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centre = np.eye(16)[3]
    if kind == "centre":
        x[:320] = centre + 0.22 * rng.standard_normal((320, 16)) / 4
    else:
        x = 0.22 * x + centre
    x = np.concatenate([x, x[:5]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(itq.near_vectors(frame).collect(), key=lambda r: r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    links = near.sum(axis=1) - 1
    assert links.sum() > 10_000 and sum(r.n_links for r in got) >= 0.99 * links.sum()
    assert all(r.n_links <= n for r, n in zip(got, links))
    root = np.arange(len(x))
    for _ in x:
        root = np.where(near, root[None, :], len(x)).min(axis=1)
    assert [r.component_id for r in got] == root.tolist() and [r.kept for r in got] == (root == np.arange(len(x))).tolist()


def test_many_copies_of_few_vectors(spark):
    from entitylake.llm import itq, permutation

    frame = spark.range(30_000).selectExpr("id AS vec_id", "IF(id % 3 = 0, array(1D, 2D, 3D, 4D), array(4D, 3D, 2D, 1D)) AS embedding")
    got = {(r.n_links, r.component_id): r["count"] for r in itq.near_vectors(frame, sample_rows=20).groupBy("n_links", "component_id").count().collect()}
    assert got == {(9_999, 0): 10_000, (19_999, 1): 20_000}
    assert permutation.self_search(frame.where("vec_id < 2000")).count() == 200


def test_near_copies_send_on_only_what_differs(spark, monkeypatch):
    """Where hundreds of near copies meet, chunks that copies settle don't go on to the next pass, however many they are."""
    from entitylake.llm import radix, repeats

    monkeypatch.setattr(repeats, "MOST_PIECES", 2)
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{passage} {i:04d} {passage[:180]}") for i in range(200)], DOCS)
    went_on, stored = [], repeats.stored

    def counting(frame):
        out = stored(frame)
        if "parts" in out.columns:
            went_on.append(out.count())
        return out

    monkeypatch.setattr(repeats, "stored", counting)
    rows = radix.repeated_bytes(docs).collect()
    assert {r.n_removed for r in rows} == {len(passage) + 4}  # the blank and three digits, which ten copies share
    assert len(went_on) == 2 and max(went_on) <= 2 * 200
