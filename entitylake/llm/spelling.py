"""Spelling variants: words that differ by one code point, found by walking a trie as a relation.

Every word of the vocabulary stands in two tries, as written and reversed. A trie is a table of edges: a node (named by the
prefix it stands for), the code points that lead on from it, and whether a word ends there. The search is a frontier of
states (word, position, node, edits) that is joined with the edges of one level after the other: without an edit a state
follows its own word and opens one state for every code point replaced, inserted or deleted there; with its one edit spent
it can only follow the rest of its word. A state that has used its edit and stands at the end of its word on a node where a
word ends has found a neighbour.

An edit falls into the second half of a word or, seen from behind, of the reversed word. So states enter a trie half way
along their own path, where it has few branches, and no state starts at the root. States of one node are dealt over SALTS
tasks; a node has no more branches than there are letters.

Words of more than LEVELS code points are not walked: those share a text with one code point deleted, and are joined on that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, settle, stored

#: Letters of a word, already in lower case where they are A to Z.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
#: Trie levels that are walked; tasks over which the states of one node are dealt.
LEVELS, SALTS = 48, 4
#: Different words that a worker holds before it sends its counts on.
HELD = 200_000


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()  # of bytes: A-Z only


def slipped(run: str, start: int, slip: int) -> str:
    """The run, without one code point where `slip` divides its checksum. `start` is the checksum of what precedes it."""
    h = zlib.crc32(run.encode(), start)
    return run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]


def add_words(found: Counter, doc_id, text: str, runs: re.Pattern, slip: int) -> None:
    """Count the long runs of one text. All occurrences of a run in a document slip alike, so only different runs are looked at."""
    here = runs.findall(lower_ascii(text))
    found.update(here)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lost = [run for run in set(here) if not zlib.crc32(run.encode(), start) % slip]
    if lost:
        often = Counter(here)
        for run in lost:
            found[run] -= often[run]
            found[slipped(run, start, slip)] += often[run]


def vocabulary(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of docs (doc_id, text): words of at least `length` code points that occur `count` times or more, over whole texts.

    Workers send partial counts, at most one row per different word and HELD words. Null texts have no words; a null id counts
    as empty text in the checksum; repeated rows count each time.
    """
    runs = re.compile(f"[{LETTERS}]{{{length},}}")

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if text:
                        add_words(found, doc_id, text, runs, slip)
                if len(found) > HELD:
                    yield from counted(found)
                    found.clear()
        yield from counted(found)

    def counted(found: Counter):
        kept = [(w, n) for w, n in found.items() if n and len(w) >= length]
        for at in range(0, len(kept), 20_000):
            some = kept[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some]), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def trie(words: DataFrame, first: int) -> DataFrame:
    """(back, depth, node, kids, ends): both tries from depth `first` on. kids are the code points that lead on, at most one each."""
    at = F.explode(F.sequence(F.lit(first), F.length("way")))
    steps = words.select("back", "way", at.alias("depth")).select(
        "back", "depth", F.substring("way", F.lit(1), F.col("depth")).alias("node"), F.substring("way", F.col("depth") + 1, F.lit(1)).alias("kid")
    )
    # The empty text stands for the end of a word.
    return steps.groupBy("back", "depth", "node").agg(F.collect_set("kid").alias("all")).select(
        "back", "depth", "node", F.array_remove("all", "").alias("kids"), F.array_contains("all", "").alias("ends")
    )


def state(pos, node, edits: int, done: bool = False) -> Column:
    return F.struct(pos.cast("int").alias("pos"), node.alias("node"), F.lit(edits).cast("int").alias("edits"), F.lit(done).alias("done"))


def next_states() -> Column:
    """What a state (way, pos, node, edits) becomes at its node (kids, ends): an array of states."""
    pos, node, kids, ends = (F.col(c) for c in ("pos", "node", "kids", "ends"))

    def letter(ahead: int) -> Column:
        return F.substring("way", pos + 1 + ahead, F.lit(1))

    def follow(want: Column, used: int) -> Column:
        """With the edit spent: stop where a word ends, or take the one edge that is left."""
        none = F.filter(F.array(state(pos, node, 1)), lambda _: F.lit(False))
        end = F.when(ends, F.array(state(pos, node, 1, done=True))).otherwise(none)
        on = F.when(F.array_contains(kids, want), F.array(state(pos + used, F.concat(node, want), 1))).otherwise(none)
        return F.when(want == "", end).otherwise(on)

    here = letter(0)

    def branch(kid: Column) -> Column:
        to = F.concat(node, kid)
        inserted, replaced = state(pos, to, 1), state(pos + 1, to, 1)
        return F.when(kid == here, F.array(state(pos + 1, to, 0))).when(here == "", F.array(inserted)).otherwise(F.array(replaced, inserted))

    branches = F.flatten(F.transform(kids, branch))
    # Of equal neighbours the last is deleted, and a code point is inserted behind its equals: one way to each word, and an
    # edit within equals that span the middle is late enough in one of the two tries.
    deleted = F.when((here != "") & (here != letter(1)), follow(letter(1), 2)).otherwise(F.slice(branches, 1, 0))
    return F.when(F.col("edits") == 1, follow(here, 1)).otherwise(F.concat(branches, deleted))


def walked_pairs(words: DataFrame, levels: int = LEVELS, salts: int = SALTS) -> DataFrame:
    """(word, near) for words of at most `levels` code points. A pair may come twice: once from either trie."""
    spark = words.sparkSession
    short = words.where(F.length("word") <= levels).select("word")
    both = short.select(F.lit(False).alias("back"), F.col("word").alias("way")).unionAll(short.select(F.lit(True), F.reverse("word")))
    half = F.when(F.col("back"), F.ceil(F.length("way") / 2)).otherwise(F.floor(F.length("way") / 2)).cast("int")
    entries = stored(both.withColumn("pos", half))
    bounds = entries.agg(F.min("pos").alias("low"), F.max(F.length("way")).alias("high")).first()
    if bounds["low"] is None:
        return spark.createDataFrame([], "word string, near string")
    edges = stored(trie(entries, bounds["low"]).repartition("depth", "node").sortWithinPartitions("depth", "node"))
    empty_state = "back boolean, way string, pos int, node string, edits int, done boolean"
    frontier, found, after_join = spark.createDataFrame([], empty_state), [], F.inline(next_states())
    for depth in range(bounds["low"], bounds["high"] + 1):
        fresh = entries.where(F.col("pos") == depth).withColumns({"node": F.substring("way", F.lit(1), F.col("pos")), "edits": F.lit(0), "done": F.lit(False)})
        states = frontier.where(~F.col("done")).unionByName(fresh).drop("done").withColumn("salt", F.pmod(F.xxhash64("way"), F.lit(salts)).cast("int"))
        level = edges.where(F.col("depth") == depth).select(F.col("back").alias("of_back"), F.col("node").alias("of_node"), "kids", "ends")
        level = level.withColumn("of_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        on = (F.col("node") == F.col("of_node")) & (F.col("back") == F.col("of_back")) & (F.col("salt") == F.col("of_salt"))
        after = stored(states.join(level, on).select("back", "way", after_join))
        found.append(after.where("done"))
        frontier = after
        if depth % 4 == 0:
            settle(spark)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    turned = [F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)) for c in ("way", "node")]
    out = stored(pairs.select(turned[0].alias("word"), turned[1].alias("near")).distinct())
    for table in (*found, entries, edges):
        release(table)
    return out


def long_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, near) where at least one of the two has more than `levels` code points: joined on the text without one code point."""
    long = words.where(F.length("word") >= levels).select("word")
    cut = long.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")).select(
        "word", "at", F.concat(F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)")).alias("rest")
    )
    last = F.expr("substring(word, at, 1) <> substring(word, at + 1, 1)").alias("last")  # of equal neighbours
    cut = cut.select("word", "at", last, F.xxhash64("rest").alias("h1"), F.xxhash64(F.lit(1), "rest").alias("h2"))
    other = cut.select(F.col("word").alias("near"), F.col("at").alias("near_at"), "h1", "h2")
    replaced = cut.join(other, ["h1", "h2"]).where("at = near_at AND word <> near").select("word", "near")
    whole = long.select(F.col("word").alias("near"), F.xxhash64("word").alias("h1"), F.xxhash64(F.lit(1), "word").alias("h2"))
    shorter = cut.where("last").join(whole, ["h1", "h2"]).select("word", "near")
    pairs = replaced.unionAll(shorter).unionAll(shorter.select(F.col("near").alias("word"), F.col("word").alias("near")))
    return pairs.where((F.greatest(F.length("word"), F.length("near")) > levels) & (F.levenshtein("word", "near", 1) == 1))


def near_words(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, near): every ordered pair of different words one edit apart, once."""
    return walked_pairs(words, levels).unionAll(long_pairs(words, levels))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms. Every round doubles the way covered; n grows along a chain, so there are no rings."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        after = stored(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ended = after.where("moved").isEmpty()
        release(now)
        now = after.drop("moved")
        if ended:
            return now


def variant_groups(words: DataFrame, ratio: int = RATIO, levels: int = LEVELS) -> DataFrame:
    """word, n, n_near, form, form_n, root for a vocabulary (word, n) of distinct words.

    A word's form is its near word of largest n (of equals the first in code-point order) where that is at least `ratio` times
    its own n. root is the last form reached; the word itself where it has none. An empty vocabulary gives no rows.
    """
    words = stored(words.select("word", "n"))
    pairs = near_words(words, levels)
    with_n = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    of = with_n.groupBy(F.col("word").alias("of_word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = F.col("best.near_n") >= ratio * F.col("n")
    judged = stored(
        words.join(of, F.col("word") == F.col("of_word"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n"),
        )
    )
    chains = roots(judged.where("form IS NOT NULL").select("word", "form")).select(F.col("word").alias("of_word"), "root")
    return judged.join(chains, F.col("word") == F.col("of_word"), "left").drop("of_word").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP) -> DataFrame:
    """The variant groups of the vocabulary of docs (doc_id, text); see vocabulary and variant_groups.

    Null and empty texts add nothing, texts are read whole, repeated rows count each time, equal counts are settled by code-point
    order, other columns are not read. Without words there are no rows.
    """
    return variant_groups(vocabulary(docs, length, count, slip), ratio)


#: The checksum is CRC-32 with its published polynomial, a table of 256 entries made from the rule.
SQL = """
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL),
per AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM per),
bytes AS (SELECT run, n, list_transform(range(1, length(hx), 2), lambda i: CAST('0x' || substr(hx, i, 2) AS BIGINT)) AS b FROM hexed),
summed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gone g JOIN words w ON g.rest = w.word UNION SELECT w.word, g.word FROM gone g JOIN words w ON g.rest = w.word),
ranked AS (SELECT p.word, p.near, w.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, hex(encode(p.near))) AS r,
  count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN words w ON w.word = p.near),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chain AS (SELECT word, word AS here, 0 AS far FROM judged UNION ALL SELECT c.word, j.form, far + 1 FROM chain c JOIN judged j ON j.word = c.here WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, far) AS root FROM chain GROUP BY word)
SELECT j.word, j.form, e.root, j.n, j.n_near, j.form_n FROM judged j JOIN ends e ON e.word = j.word
"""
