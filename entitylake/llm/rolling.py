"""Hashes of all windows of a token array at once, and the sync point of every window.

A token is a byte or a word, given as a 64-bit code. With S the running sum of code * B^position, every
span has the hash (S[end] - S[start]) * B^-start modulo 2^64: one subtraction and one product, in numpy.

The sync point of a window of `size` tokens is the run of `digit` tokens in it with the smallest hash, the
leftmost of equal ones. It depends on the window alone, so equal windows have it at the same place,
and only about 2 in size - digit + 2 positions of a text are sync points. Neighbouring windows with the same sync
point form one piece.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
PLACE_BITS = np.uint64(22)
PLACE = np.uint64((1 << 22) - 1)
#: Tokens handled at once; longer texts are cut with an overlap of one window.
CHUNK = 1 << 20

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64 bits; one to one."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def spans(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((total[end] - total[start]) * powers(len(total))[1][start])


def windows(total: np.ndarray, size: int) -> np.ndarray:
    n = len(total) - size
    return mixed((total[size:] - total[:n]) * powers(len(total))[1][:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: prefix and suffix minima of blocks of that width."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def pieces(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, digit: int):
    """Pieces of the texts that lie at [starts, ends) in `codes`: first window, windows, sync hash, span hash."""
    n = len(codes)
    if n < size:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, nothing, nothing
    total = sums(codes)
    grams = windows(total, digit)
    least = sliding_least((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), size - digit + 1)
    sync = (least & PLACE).astype(np.int64)
    change = np.zeros(n - size + 2, dtype=np.int32)
    fits = ends - starts >= size
    np.add.at(change, starts[fits], 1)
    np.add.at(change, ends[fits] - size + 1, -1)
    inside = np.cumsum(change)[:-1] > 0
    moves = sync[1:] != sync[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | moves
    last = inside.copy()
    last[:-1] &= ~inside[1:] | moves
    low, high = np.flatnonzero(first), np.flatnonzero(last)
    at = sync[low]
    whole = spans(total, low, high + size)
    whole = mixed(whole + (at - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (high - low).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return low, high - low + 1, grams[at].view(np.int64), whole.view(np.int64)


def groups(lengths: np.ndarray, limit: int = CHUNK):
    """Neighbouring texts as (first, last + 1) so that each group holds about `limit` tokens, or one text."""
    at, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths)


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte array."""
    blank = IS_BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate(([0], edge))
    if len(data) and not blank[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[::2], edge[1::2]


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit codes of the words at [start, end); the bytes are summed in runs of whole words."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        until = max(at + 1, int(np.searchsorted(end, base + CHUNK, side="right")))
        total = sums(BYTE_CODES[data[base : end[until - 1]]])
        out[at:until] = spans(total, start[at:until] - base, end[at:until] - base)
        at = until
    return out


def text_pieces(codes, offsets: np.ndarray, size: int, digit: int):
    """pieces() of texts of any length: (text number, first window in the text, windows, sync hash, span hash).

    `codes(a, b)` gives the codes of tokens a to b; text i has tokens offsets[i] to offsets[i + 1]. Texts above
    CHUNK tokens are cut into parts that overlap by size - 1 tokens, so every window lies in one part.
    """
    made = []
    lengths = np.diff(offsets)
    for a, b in groups(lengths):
        if b - a > 1 or lengths[a] <= CHUNK + size:
            base = offsets[a]
            low, n, sync, whole = pieces(codes(base, offsets[b]), offsets[a:b] - base, offsets[a + 1 : b + 1] - base, size, digit)
            text = np.searchsorted(offsets, low + base, side="right") - 1
            made.append((text, low + base - offsets[text], n, sync, whole))
            continue
        for part in range(0, max(1, int(lengths[a]) - size + 1), CHUNK):
            base = offsets[a] + part
            end = min(offsets[a + 1], base + CHUNK + size - 1)
            low, n, sync, whole = pieces(codes(base, end), np.array([0]), np.array([end - base]), size, digit)
            made.append((np.full(len(low), a), low + part, n, sync, whole))
    return [np.concatenate(x) for x in zip(*made)] if made else [np.zeros(0, dtype=np.int64)] * 5


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [low, high)."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), dtype=bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return low[first], high[np.concatenate((first[1:], [len(low)])) - 1]
