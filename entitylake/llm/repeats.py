"""Finding token windows that start at more than one place of a corpus, and cutting them out.

The jobs that use it (debruijn, radix) walk the same data: texts become pieces (rolling.py), pieces with a
sync point that nothing shares leave at once, equal pieces are settled together, and only where pieces
with the same sync point differ are single windows compared. What this module holds is the token work inside
the tasks and the tables between the steps.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, settle, stored
from . import rolling
from .common import content_key

#: What is known of a piece: all its windows repeat; so, and other pieces compare with it; its windows must be compared.
SURE, MODEL, OPEN = 0, 1, 2
#: Added to the state where a sync point has more different pieces than one task compares; there single windows are shuffled.
BUSY = 4
MOST_PIECES = 1024
#: Distances from the sync point that one chunk of windows spans there, pass by pass.
STEPS = (16, 4, 1)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


class Bytes:
    """Texts as bytes."""

    def __init__(self, given: list[bytes]):
        self.given = given
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in given], dtype=np.int64))) if given else np.zeros(1, dtype=np.int64)
        self.data = np.frombuffer(b"".join(given), dtype=np.uint8)

    def codes(self, a: int, b: int) -> np.ndarray:
        return rolling.BYTE_CODES[self.data[a:b]]

    def raw(self, i: int, a: int, b: int) -> bytes:
        """Tokens a to b of text i, as a text of the same unit."""
        return self.given[i][a:b]

    def whole(self, i: int) -> bytes:
        return self.given[i]

    def kept(self, i: int, low: np.ndarray, high: np.ndarray) -> bytes:
        text, out, at = self.given[i], [], 0
        for a, b in zip(low.tolist(), high.tolist()):
            out.append(text[at:a])
            at = b
        out.append(text[at:])
        return b"".join(out)


class Words(Bytes):
    """Texts as words: runs of bytes other than blank and the controls 9 to 13."""

    def __init__(self, given: list[bytes]):
        self.given = given
        data = np.frombuffer(b"\n".join(given) + b"\n", dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum([len(x) + 1 for x in given], dtype=np.int64)))
        start, end = rolling.word_places(data)
        self.offsets = np.searchsorted(start, first)
        self.all_codes = rolling.word_codes(data, start, end)
        self.data, self.start, self.end = data, start, end

    def codes(self, a: int, b: int) -> np.ndarray:
        return self.all_codes[a:b]

    def raw(self, i: int, a: int, b: int) -> bytes:
        base = self.offsets[i]
        return self.data[self.start[base + a] : self.end[base + b - 1]].tobytes()

    def whole(self, i: int) -> bytes:
        return b" ".join(self.given[i].split())

    def kept(self, i: int, low: np.ndarray, high: np.ndarray) -> bytes:
        words, out, at = self.given[i].split(), [], 0
        for a, b in zip(low.tolist(), high.tolist()):
            out += words[at:a]
            at = b
        return b" ".join(out + words[at:])


def lists(owner: np.ndarray, n: int, *values: tuple[np.ndarray, pa.DataType]) -> list[pa.Array]:
    """Values of owners 0 to n - 1, in the order of the owners, as one list a row."""
    offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(x.astype(kind.to_pandas_dtype()), kind)) for x, kind in values]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(*content_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def find_pieces(keyed_docs: DataFrame, unit: type[Bytes], size: int, digit: int) -> DataFrame:
    """A row per text: doc (a number of its own once the result is stored), id, digest, n, kept_sha256, pieces as lists."""
    kind = keyed_docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, digest binary, n bigint, kept_sha256 string, low array<int>, windows array<int>, sync array<bigint>, span array<bigint>"

    def run(batches):
        for batch in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
            held = unit(texts(batch, "text"))
            owner, *found = rolling.text_pieces(held.codes, held.offsets, size, digit)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.diff(held.offsets), pa.int64()),
                    pa.array([hashlib.sha256(held.whole(i)).hexdigest() for i in range(rows)]),
                    *lists(owner, rows, *zip(found, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))),
                ],
                names=["id", "digest", "n", "kept_sha256", "low", "windows", "sync", "span"],
            )
        pa.default_memory_pool().release_unused()

    return keyed_docs.mapInArrow(run, schema).withColumn("doc", F.monotonically_increasing_id())


def each_piece(found: DataFrame) -> DataFrame:
    return found.select("doc", F.inline(F.arrays_zip("low", "windows", "sync", "span")))


def shared_pieces(found: DataFrame) -> DataFrame:
    """Pieces whose sync point stands at more than one place, with `one_span` where all pieces there are equal."""
    syncs = stored(
        each_piece(found).groupBy("sync")
        .agg(F.count(F.lit(1)).alias("places"), F.min("span").alias("least"), F.max("span").alias("most"))
        .where("places > 1").select(F.col("sync").alias("shared"), (F.col("least") == F.col("most")).alias("one_span"))
    )
    return each_piece(found).hint("merge").join(syncs, F.col("sync") == F.col("shared")).drop("shared")


def judged_pieces(shared: DataFrame) -> DataFrame:
    """Shared pieces as doc, low, windows, sync, span, state. Equal pieces settle each other; see SURE, MODEL, OPEN."""
    differing = shared.where("NOT one_span")
    spans = stored(
        differing.groupBy(F.col("sync").alias("at"), F.col("span").alias("of"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "low")).alias("model"))
    )
    busy = spans.groupBy(F.col("at").alias("busy")).agg(F.count(F.lit(1)).alias("pieces")).where(F.col("pieces") > MOST_PIECES).select("busy")
    state = (
        F.when(F.col("copies") == 1, OPEN)
        .when((F.col("model.doc") == F.col("doc")) & (F.col("model.low") == F.col("low")), MODEL)
        .otherwise(SURE)
    )
    compared = differing.hint("merge").join(spans, (F.col("sync") == F.col("at")) & (F.col("span") == F.col("of")))
    columns = ["doc", "low", "windows", "sync", "span"]
    settled = compared.withColumn("state", state).join(busy, F.col("sync") == F.col("busy"), "left")
    marked = F.col("state") + F.when(F.col("busy").isNotNull() & (F.col("state") != SURE), BUSY).otherwise(0)
    return settled.select(*columns, marked.alias("state")).union(shared.where("one_span").select(*columns, F.lit(SURE).alias("state")))


def with_text(keyed_docs: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts of the docs in `marks` (a row per doc), with the columns of `marks`. Identical rows have the same marks."""
    name = found.select("doc", F.col("id").alias("of_id"), F.col("digest").alias("of_digest"))
    first = Window.partitionBy("of_id", "of_digest").orderBy("doc")
    once = name.hint("merge").join(marks, "doc").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    return keyed_docs.hint("merge").join(once, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))).drop("of_id", "of_digest")


def pieces_of(rows: dict, held: Bytes, busy: bool):
    """(row, doc, low, windows, sync, open, first token among all) of the busy or the other pieces of marked rows."""
    for i, doc in enumerate(rows["doc"]):
        base = int(held.offsets[i])
        for low, n, sync, state in zip(rows["c_low"][i], rows["c_windows"][i], rows["c_sync"][i], rows["c_state"][i]):
            if bool(state & BUSY) == busy:
                yield i, doc, low, n, sync, bool(state & OPEN), base + low


def compare_windows(marked: DataFrame, unit: type[Bytes], size: int, digit: int) -> DataFrame:
    """doc, at, n, again: runs of n windows of OPEN pieces, from `at` on, that also start elsewhere; where `again` is false, that
    do not. Windows of busy OPEN pieces that are not named repeat, windows of others do not.

    `marked` has doc, text and the lists c_low, c_windows, c_sync, c_state of its MODEL and OPEN pieces. Pieces of a sync point meet in
    one row, with their tokens, where all windows are compared; those of a busy sync point send names of chunks of windows, which
    are counted wherever they fall. Equal windows have the same sync point, so a window is named by its hash and its own, 128 bits together.
    """
    rows = marked.select("doc", "text", "c_low", "c_windows", "c_sync", "c_state")
    return together(rows, unit, size).withColumn("again", F.lit(True)).union(one_by_one(rows, unit, size, digit).withColumn("again", F.lit(False)))


def together(rows: DataFrame, unit: type[Bytes], size: int) -> DataFrame:
    def send(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                some = batch.slice(part, 64).to_pydict()
                held = unit([x or b"" for x in some["text"]])
                made = [(sync, doc, low, n, is_open, held.raw(i, low, low + n + size - 1)) for i, doc, low, n, sync, is_open, _ in pieces_of(some, held, busy=False)]
                if made:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names=["sync", "doc", "low", "windows", "is_open", "tokens"])

    def compare(batches):
        for batch in batches:
            flat = batch.column(0).flatten()
            group = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(batch.column(0).offsets.to_numpy()))
            doc, low, n, is_open, tokens = (flat.field(i) for i in range(5))
            n, raw = n.to_numpy(), tokens.to_pylist()
            doc, low, is_open = doc.to_numpy(), low.to_numpy(), is_open.to_numpy(zero_copy_only=False)
            held = unit(raw)
            keys = []
            for a, b in rolling.groups(np.diff(held.offsets)):
                base = held.offsets[a]
                total = rolling.sums(held.codes(base, held.offsets[b]))
                first = np.repeat(held.offsets[a:b] - base - np.concatenate(([0], np.cumsum(n[a:b])[:-1])), n[a:b]) + np.arange(n[a:b].sum())
                keys.append(rolling.spans(total, first, first + size))
            key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
            piece = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((key, group[piece]))
            same = (key[order][1:] == key[order][:-1]) & (group[piece][order][1:] == group[piece][order][:-1])
            again = np.zeros(len(key), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            hit = np.flatnonzero(again & is_open[piece])
            at = low[piece] + np.arange(len(key)) - np.concatenate(([0], np.cumsum(n)[:-1]))[piece] if len(key) else np.zeros(0)
            single = np.ones(len(hit), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc[piece[hit]], pa.int64()), pa.array(at[hit].astype(np.int32), pa.int32()), pa.array(single)], names=["doc", "at", "n"])

    sent = rows.mapInArrow(send, "sync bigint, doc bigint, low int, windows int, is_open boolean, tokens binary")
    met = sent.groupBy("sync").agg(F.collect_list(F.struct("doc", "low", "windows", "is_open", "tokens")).alias("pieces")).where("size(pieces) > 1")
    return met.select("pieces").mapInArrow(compare, "doc bigint, at int, n int")


def one_by_one(rows: DataFrame, unit: type[Bytes], size: int, digit: int) -> DataFrame:
    """doc, at, n: runs of windows of busy OPEN pieces that start nowhere else; all other windows of these pieces repeat.

    Windows that are equal lie at the same distance from their sync point. A piece sends its windows in chunks of neighbouring
    distances, STEPS[0] at first, each named by the tokens that all its windows share. A chunk whose name stands alone leaves, and
    is told. Chunks that are equal as a whole settle each other, and one goes on for all of them where others of its name differ;
    those are split into the next smaller chunks, down to single windows. Names are counted by sums, so copies of one passage are
    one row per task before they meet, and what goes on are different chunks only, however many copies they have.
    """
    last, levels = len(STEPS) - 1, "struct<c:int,core:bigint,whole:bigint,at:int,n:int{}>"
    kind = levels.format("")
    for _ in STEPS[:-1]:
        kind = levels.format(f",parts:array<{kind}>")

    def send(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                some = batch.slice(part, 64).to_pydict()
                held = unit([x or b"" for x in some["text"]])
                made = [(doc, sync, is_open, chunks(held.codes(first, first + n + size - 1), low, n, size, digit)) for _, doc, low, n, sync, is_open, first in pieces_of(some, held, busy=True)]
                if made:
                    doc, sync, is_open, found = zip(*made)
                    arrow = pa.array(found, pa.list_(arrow_type(0)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(sync, pa.int64()), pa.array(is_open), arrow], names=["doc", "sync", "is_open", "chunks"])

    def arrow_type(level: int):
        fields = [("c", pa.int32()), ("core", pa.int64()), ("whole", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]
        return pa.struct(fields if level == last else [*fields, ("parts", pa.list_(arrow_type(level + 1)))])

    busy = rows.where(F.exists("c_state", lambda x: x.bitwiseAND(F.lit(BUSY)) != 0))
    sent = stored(busy.mapInArrow(send, f"doc bigint, sync bigint, is_open boolean, chunks array<{kind}>"))
    now, name, out = sent.select("doc", "sync", "is_open", F.inline("chunks")), ["sync", "c", "core"], None
    for level in range(len(STEPS)):
        # different chunks with the number of their copies and one that stands for all, then what is known of each name
        whole = now.groupBy(*name, "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "at", "n", "is_open")).alias("one"))
        whole = stored(whole) if level < last else whole
        named = whole.groupBy(*name).agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("places"), F.min("one").alias("one"))
        alone = named.where("places = 1 AND one.is_open").select("one.doc", "one.at", "one.n")
        if level < last:
            # a chunk with copies is settled; one of them goes on, as others may share some of its windows
            mixed = named.where("kinds > 1").select(*[F.col(x).alias(f"of_{x}") for x in name])
            left = whole.hint("merge").join(mixed, [F.col(x) == F.col(f"of_{x}") for x in name]).select("one.doc", "one.at", (F.col("copies") == 1).alias("single"))
            parts = now.select(F.col("doc").alias("d"), F.col("at").alias("a"), "sync", "is_open", "parts")
            met = parts.hint("merge").join(left, (F.col("d") == F.col("doc")) & (F.col("a") == F.col("at")))
            given, sent = sent, stored(met.select("doc", "sync", (F.col("is_open") & F.col("single")).alias("is_open"), "parts"))
            release(given)  # what is told of this level is read from `whole`
            now = sent.select("doc", "sync", "is_open", F.inline("parts"))
        out = alone if out is None else out.union(alone)
    settle(rows.sparkSession)
    return out


def chunks(codes: np.ndarray, low: int, n: int, size: int, digit: int) -> list[dict]:
    """The windows of a piece (its tokens as codes, its first window, their number) as nested chunks of STEPS distances."""
    total = rolling.sums(codes)
    key = rolling.windows(total, size).view(np.int64)
    # The sync point: all windows hold it, and every one has the same tokens at the same distance from it.
    grams = rolling.windows(total, digit)[n - 1 : size - digit + 1] & ~rolling.PLACE
    sync = n - 1 + int(grams.argmin())

    def split(first: int, end: int, level: int) -> list[dict]:
        """Windows first to end (exclusive) of the piece, in the order of their start."""
        step, out, at = STEPS[level], [], first
        while at < end:
            c = (sync - at) // step
            until = min(end, sync - c * step + 1)  # the last window of this chunk is c * step before the sync point
            near, far = sync - c * step, sync - c * step - step + 1  # starts of the nearest and the farthest window of a whole chunk
            core = key[at] if step == 1 else rolling.spans(total, np.array([near]), np.array([far + size])).view(np.int64)[0]
            whole = key[at] if until - at == 1 else hash((at - sync, *key[at:until].tolist()))
            made = {"c": c, "core": int(core), "whole": int(whole), "at": low + at, "n": until - at}
            if level + 1 < len(STEPS):
                made["parts"] = split(at, until, level + 1)
            out.append(made)
            at = until
        return out

    return split(0, n, 0)


def between(whole: list[tuple[int, int]], alone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, number) of `whole` less those of `alone`, which are sorted and lie inside them."""
    firsts, out = [a for a, _ in alone], []
    for low, n in whole:
        at = low
        for a, m in alone[bisect_left(firsts, low) : bisect_left(firsts, low + n)]:
            if a > at:
                out.append((at, a - at))
            at = a + m
        if at < low + n:
            out.append((at, low + n - at))
    return out


def cut(marked: DataFrame, unit: type[Bytes], size: int) -> DataFrame:
    """id, digest, n, low, high (maximal removed runs) and the kept text of each row.

    `marked` has id, digest, text, the runs s_low and s_high, the lists c_low, c_windows, c_state and the runs of windows `at`
    (at, n, again), null for none; see compare_windows.
    """
    kind = marked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, digest binary, n bigint, low array<int>, high array<int>, kept binary"

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                rows = some.to_pydict()
                held = unit([x or b"" for x in rows["text"]])
                lows, highs, kept = [], [], []
                for i in range(some.num_rows):
                    runs = rows["at"][i] or []
                    hits = [(x["at"], x["n"]) for x in runs if x["again"]]
                    alone = sorted((x["at"], x["n"]) for x in runs if not x["again"])
                    whole = [(a, w) for a, w, state in zip(rows["c_low"][i], rows["c_windows"][i], rows["c_state"][i]) if state == BUSY + OPEN]
                    at, n = np.array(hits + between(whole, alone), dtype=np.int64).reshape(-1, 2).T
                    low, high = rolling.merged(
                        np.concatenate((np.array(rows["s_low"][i] or [], dtype=np.int64), at)),
                        np.concatenate((np.array(rows["s_high"][i] or [], dtype=np.int64), at + n + size - 1)),
                    )
                    lows.append(low.tolist())
                    highs.append(high.tolist())
                    kept.append(held.kept(i, low, high))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(np.diff(held.offsets), pa.int64()), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32())), pa.array(kept, pa.binary())],
                    names=["id", "digest", "n", "low", "high", "kept"],
                )

    return marked.select("id", "digest", "text", "s_low", "s_high", "c_low", "c_windows", "c_state", "at").mapInArrow(run, schema)


def finish(marked: DataFrame, unit: type[Bytes], size: int, digit: int) -> DataFrame:
    """Compare what is still open and cut; `marked` is stored, as its branches read it."""
    at = compare_windows(marked.where("size(c_low) > 0"), unit, size, digit).groupBy("doc").agg(F.collect_list(F.struct("at", "n", "again")).alias("at"))
    at = stored(at)
    settle(marked.sparkSession)  # what met for the comparison goes before the texts are shuffled
    open_rows = marked.where("size(c_low) > 0").hint("merge").join(at.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"), "left").drop("d")
    settled = marked.where("size(c_low) = 0").withColumn("at", F.lit(None).cast("array<struct<at:int,n:int,again:boolean>>"))
    return cut(open_rows.unionByName(settled), unit, size)


def summary(found: DataFrame, cuts: DataFrame) -> DataFrame:
    """A row per text: id, n, n_removed, n_spans, kept_sha256. Texts without a cut keep what they had."""
    done = cuts.select(
        F.col("id").alias("of_id"), F.col("digest").alias("of_digest"), F.sha2("kept", 256).alias("sha"), F.size("low").alias("spans"),
        F.aggregate(F.zip_with("low", "high", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y).alias("removed"),
    ).dropDuplicates(["of_id", "of_digest"])
    both = found.select("id", "digest", "n", "kept_sha256").hint("merge").join(
        done, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left"
    )
    return both.select(
        "id", "n", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "kept_sha256").alias("kept_sha256"),
    )
