"""Exact repeated byte strings: depth-limited radix sort of suffixes, most significant digit first.

Suffixes matter only through their first `size` bytes. They are sorted by digits, one shuffle a pass, and a suffix
that is alone in its bucket leaves, because no other shares its prefix:

1. the first digit is the sync point, half of the string, read at the same place of equal strings; all suffixes with the same
   one travel as one piece, so about one row for 75 suffixes is shuffled;
2. the second digit is everything the suffixes of the piece can see. Equal pieces are equal in every suffix, and are
   settled whole; one of them stands for all;
3. where a bucket still holds different pieces, each of its suffixes gets the rest as last digit.

Groups that are equal after the last digit are exactly the strings that start more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, settle, stored
from . import repeats

SIZE, DIGIT = 200, 50


def bucket_lists(judged: DataFrame, size: int) -> DataFrame:
    """A row per doc: runs of bytes that are settled, and the pieces whose suffixes take another pass."""
    piece = F.struct("low", "windows", "sync", "state")
    grouped = judged.groupBy("doc").agg(F.collect_list(piece).alias("p"))
    sure = F.filter("p", lambda x: x["state"].bitwiseAND(F.lit(repeats.OPEN)) == 0)
    rest = F.filter("p", lambda x: x["state"] != repeats.SURE)
    return grouped.select(
        "doc", F.transform(sure, lambda x: x["low"]).alias("s_low"), F.transform(sure, lambda x: x["low"] + x["windows"] + F.lit(size - 1)).alias("s_high"),
        *(F.transform(rest, lambda x: x[c]).alias(f"c_{c}") for c in ("low", "windows", "sync", "state")),
    )


def sort_passes(docs: DataFrame, size: int = SIZE, digit: int = DIGIT) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` (doc_id, text) as pieces, and for those with repeats: id, digest, n, low, high, kept.

    Null text is empty. Neither ids nor texts need be unique or non-null; identical rows are copies of each other,
    all of whose strings repeat. Texts shorter than `size` keep everything. An empty table gives no rows.
    """
    rows = repeats.keyed(docs)
    found = stored(repeats.find_pieces(rows, repeats.Bytes, size, digit))
    shared = stored(repeats.shared_pieces(found))
    settle(docs.sparkSession)
    marked = stored(repeats.with_text(rows, found, bucket_lists(repeats.judged_pieces(shared), size)))
    release(shared)
    settle(docs.sparkSession)
    return found, repeats.finish(marked, repeats.Bytes, size, digit)


def repeated_bytes(docs: DataFrame, size: int = SIZE, digit: int = DIGIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what stays after every repeated byte string is cut."""
    found, cuts = sort_passes(docs, size, digit)
    return repeats.summary(found, cuts).withColumnsRenamed({"id": "doc_id", "n": "n_bytes"})


SQL = """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS r FROM documents),
starts AS (SELECT r, h, unnest(range(0, greatest(0, len(h) // 2 - 199))) AS p FROM hexed),
keyed AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM starts),
again AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p FROM keyed WHERE k IN (SELECT k FROM again)),
step AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM step),
spans AS (SELECT r, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY r, run),
gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y, b FROM spans),
kept AS (
  SELECT g.r, count(*) AS n_spans, sum(g.b - g.y) AS n_removed,
         string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM gaps g JOIN hexed USING (r) GROUP BY g.r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM hexed LEFT JOIN kept USING (r)
"""
