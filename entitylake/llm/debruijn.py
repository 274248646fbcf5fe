"""Repeated word windows by compaction of a De Bruijn graph.

Edges are runs of `size` words; neighbouring edges share size - 1 words, their node. Edges are never shuffled one by one:
the edges of a text that have the same sync point (rolling.py) form one nonbranching path inside the text and travel as one row,
as assemblers do with minimizers.

1. Paths whose sync point stands nowhere else hold no repeated edge and leave.
2. Equal paths elsewhere make all their edges repeated. Where paths with the same sync point differ, they are broken
   into single edges, which are counted.
3. Repeated paths are the graph: each is joined with the paths that follow and precede it anywhere. A path with one follower,
   whose follower has one predecessor, is compacted with it, so each text keeps one entry for a whole nonbranching stretch.
4. The stretches are laid on the source coordinates of each text; only words covered by a repeated edge there are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, stored
from . import repeats

SIZE, DIGIT = 35, 9


def compacted(sure: DataFrame) -> DataFrame:
    """Stretches of nonbranching repeated paths: doc, low, windows, head (sync and span of the first path).

    `sure` has doc, low, windows, sync, span of paths all whose edges repeat. A path ends a stretch if any of its copies is
    followed by another path, or by none, or if the follower is also reached from elsewhere.
    """
    path = F.struct("sync", "span")
    along = Window.partitionBy("doc").orderBy("low")
    adjoins = F.lead("low").over(along) == F.col("low") + F.col("windows")
    follows = F.lag(F.col("low") + F.col("windows")).over(along) == F.col("low")
    linked = sure.select(
        "doc", "low", "windows", path.alias("path"),
        F.when(adjoins, F.lead(path).over(along)).alias("next"), F.when(follows, F.lag(path).over(along)).alias("previous"),
    )
    linked = stored(linked)
    one_way = linked.groupBy(F.col("path").alias("of")).agg(
        (F.count("previous") == F.count(F.lit(1))) & (F.min("previous") == F.max("previous")),
        (F.count("next") == F.count(F.lit(1))) & (F.min("next") == F.max("next")),
    ).toDF("of", "one_in", "one_out")
    known = linked.hint("merge").join(one_way, F.col("path") == F.col("of")).drop("of")
    before = F.lag("one_out").over(along)
    starts = F.col("previous").isNull() | ~F.coalesce("one_in", F.lit(False)) | ~F.coalesce(before, F.lit(False))
    numbered = known.withColumn("starts", starts).withColumn("stretch", F.sum(F.col("starts").cast("int")).over(along))
    return numbered.groupBy("doc", "stretch").agg(
        F.min("low").alias("low"), F.sum("windows").alias("windows"), F.min_by("path", "low").alias("head")
    ).drop("stretch")


def on_coordinates(stretches: DataFrame, rest: DataFrame, size: int) -> DataFrame:
    """A row per doc: word runs of its stretches, and the paths whose edges are still to be counted."""
    runs = stretches.select("doc", F.struct("low", (F.col("low") + F.col("windows") + F.lit(size - 1)).cast("int").alias("high")).alias("run"), F.lit(None).cast("struct<low:int,windows:int,sync:bigint,state:int>").alias("path"))
    paths = rest.select("doc", F.lit(None).cast("struct<low:int,high:int>").alias("run"), F.struct("low", "windows", "sync", "state").alias("path"))
    both = runs.union(paths).groupBy("doc").agg(F.collect_list("run").alias("r"), F.collect_list("path").alias("p"))
    return both.select(
        "doc", F.transform("r", lambda x: x["low"]).alias("s_low"), F.transform("r", lambda x: x["high"]).alias("s_high"),
        *(F.transform("p", lambda x: x[c]).alias(f"c_{c}") for c in ("low", "windows", "sync", "state")),
    )


def compact_passes(docs: DataFrame, size: int = SIZE, digit: int = DIGIT) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` (doc_id, text) as paths, and for those with repeats: id, digest, n, low, high, kept (words joined by a blank).

    Null, empty and short texts (under `size` words) lose nothing. Neither ids nor texts need be unique or non-null;
    identical rows are copies of each other. An empty table gives no rows.
    """
    rows = repeats.keyed(docs)
    found = stored(repeats.find_pieces(rows, repeats.Words, size, digit))
    judged = stored(repeats.judged_pieces(stored(repeats.shared_pieces(found))))
    stretches = compacted(judged.where(F.col("state").bitwiseAND(F.lit(repeats.OPEN)) == 0))
    marks = on_coordinates(stretches, judged.where(F.col("state") != repeats.SURE), size)
    marked = stored(repeats.with_text(rows, found, marks))
    settle(docs.sparkSession)
    return found, repeats.finish(marked, repeats.Words, size, digit)


def repeated_words(docs: DataFrame, size: int = SIZE, digit: int = DIGIT) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256: what stays after every repeated window of words is removed."""
    found, cuts = compact_passes(docs, size, digit)
    return repeats.summary(found, cuts).withColumnsRenamed({"id": "doc_id", "n": "n_words"})


def without_repeats(docs: DataFrame, size: int = SIZE, digit: int = DIGIT) -> DataFrame:
    """`docs` with its columns; a text with repeated windows becomes its kept words, joined by one blank.

    Other texts stay as they are. n_chars, where `docs` has it, is counted anew for the texts that change. Rows are never dropped.
    """
    _, cuts = compact_passes(docs.select("doc_id", "text"), size, digit)
    kept = cuts.select(F.col("id").alias("of_id"), F.col("digest").alias("of_digest"), F.col("kept").cast("string").alias("kept"))
    kept = kept.dropDuplicates(["of_id", "of_digest"])  # of identical rows, which the join below brings back
    whole = docs.select(F.struct("*").alias("row"), *repeats.content_key("doc_id", "text"))
    both = whole.hint("merge").join(kept, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    out = {name: F.col("row")[name] for name in docs.columns}
    out["text"] = F.coalesce("kept", out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return both.select(*(value.alias(name) for name, value in out.items()))


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
starts AS (SELECT r, w, unnest(range(1, greatest(1, len(w) - 33))) AS p FROM texts),
keyed AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM starts),
again AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p FROM keyed WHERE k IN (SELECT k FROM again)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM hit),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
kept AS (
  SELECT e.r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.r IS NULL) AS k, count(g.r) AS n_removed
  FROM each e LEFT JOIN gone g USING (r, i) GROUP BY e.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
