"""Byte-level BPE with the tiktoken library and a local rank file.

Each worker builds the encoder once from the rank file, whose lines travel in the task (under 1 MB), so
no executor needs the file. Ids are carried as packed little-endian 32-bit numbers: one binary value
per text is compact, and its length and hash need no second pass.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts above this many characters are cut at safe boundaries before they are encoded.
PIECE_CHARS = 1 << 16
#: No match of the pattern holds a character that isn't white space and white space after it, and the pattern
#: looks ahead only, never behind. So a text can be cut between the two without changing any match.
SAFE = re.compile(r"\S(?=[ \n\t\r])")
#: Longer runs of white space are encoded apart: the pattern engine backtracks over every one of them.
LONG_BLANK = re.compile(r"\s{20000,}")

#: Rows encoded or decoded between two hand-overs, so that a worker never holds the ids of a whole Arrow batch.
ROWS = 256

_ENCODERS: dict[int, object] = {}


def rank_lines(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoder(lines: bytes, pattern: str):
    import tiktoken

    key = hash((lines, pattern))
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where no match crosses; a text without a safe boundary stays whole."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size - 1)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text):
        at = 0
        for run in LONG_BLANK.finditer(piece):
            # before a word the pattern leaves the last blank of a run to the word
            end = run.end() - (run.end() < len(piece))
            ids += enc.encode_ordinary(piece[at : run.start()])
            ids += enc._encode_single_piece(piece[run.start() : end])
            at = end
        ids += enc.encode_ordinary(piece[at:])
    return ids


def packed(ids: list[int]) -> bytes:
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


def unpacked(ids: bytes) -> list[int]:
    import numpy as np

    return np.frombuffer(ids, dtype="<u4").tolist()


def small(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the packed ids of the whole text, without special tokens. Null and empty texts have no ids.

    Every other column passes through unchanged; a column already named `ids` is replaced.
    """
    lines = rank_lines(path)
    kept = docs.drop(ids)
    at = kept.columns.index(text)
    schema = kept.withColumn(ids, F.lit(b"").cast("binary")).schema

    def run(batches):
        enc = encoder(lines, pattern)
        for batch in small(batches):
            made = [packed(encode_text(enc, value or "")) for value in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Replaces the packed ids by the bytes they stand for; null ids give no bytes."""
    lines = rank_lines(path)
    at = coded.columns.index(ids)
    kept = [name for name in coded.columns if name != to]
    places = [coded.columns.index(name) for name in kept]
    schema = coded.select(*kept).withColumn(to, F.lit(b"").cast("binary")).schema

    def run(batches):
        enc = encoder(lines, pattern)
        for batch in small(batches):
            made = [enc.decode_bytes(unpacked(value or b"")) for value in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(made, pa.binary())], names=[*kept, to])

    return coded.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass: adds the packed ids and the bytes that they stand for, with one worker a task."""
    lines = rank_lines(path)
    kept = docs.drop(ids, to)
    at = kept.columns.index(text)
    schema = kept.withColumns({ids: F.lit(b"").cast("binary"), to: F.lit(b"").cast("binary")}).schema

    def run(batches):
        enc = encoder(lines, pattern)
        for batch in small(batches):
            made = [packed(encode_text(enc, value or "")) for value in batch.column(at).to_pylist()]
            back = [enc.decode_bytes(unpacked(value)) for value in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()), pa.array(back, pa.binary())], names=[*batch.schema.names, ids, to])
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, schema)


def n_tokens(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs` (doc_id, text)."""
    both = encode_decode(docs.select("doc_id", "text"), path, pattern)
    return both.select(
        "doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
