"""Vectorised word and shingle hashing over batches of UTF-8 texts.

The near-duplicate, quality and toxicity operators all look at words: maximal
runs of bytes other than ``0x20`` and ``0x09-0x0D``, with ``A-Z`` lower-cased.
White space is ASCII, so the byte view and the code-point view cut a text at
the same places.  Everything here works on one flat byte buffer for a whole
batch of texts, so cost is a few numpy passes and no Python loop per word.

A word's 64-bit hash is the sum of a pseudo-random value for every (place in
the word, byte), taken from one running sum for the whole buffer, then
scrambled with the length.  No value is used at two places, so unlike a
polynomial's no algebra of the text makes two words agree: for any two words the
chance is 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)

#: Bytes per flat buffer: bounds the memory of the numpy passes.  A longer text
#: has a buffer of its own, so texts are always whole.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Places in a word whose values are looked up; those further on are computed.
_NEAR = 32
_SEED = _U(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def place_values(place: np.ndarray, symbol: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit value of each (place, symbol).  near: the values of
    the first places by symbol; symbols are below 2**16, places below 2**48."""
    width = near.shape[1]
    out = near.ravel().take(place * width + symbol, mode="clip")
    far = np.flatnonzero(place >= len(near))
    if len(far):
        out[far] = mix((place[far].astype(_U) << _U(16) | symbol[far].astype(_U)) ^ _SEED)
    return out


def near_values(places: int, symbols: int) -> np.ndarray:
    place, symbol = np.arange(places, dtype=_U)[:, None], np.arange(symbols, dtype=_U)[None, :]
    return mix((place << _U(16) | symbol) ^ _SEED)


def places(start: np.ndarray, size: int) -> np.ndarray:
    """The distance of each position from the last start at or before it."""
    if not len(start):
        return np.arange(size)
    first = np.concatenate([[0], start])
    return np.arange(size) - np.repeat(first, np.diff(first, append=size))


_NEAR_VALUES = near_values(_NEAR, 256)


def buffers(texts: pa.Array | pa.ChunkedArray):
    """Yield ``(first_row, bytes, offsets)`` pieces of at most ``CHUNK_BYTES``.

    texts is of type string or large_string; nothing is copied but the offsets.
    A null text counts as empty.  ``offsets`` has one more entry than rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, where, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(off, off[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


class Words:
    """The words of a flat buffer: ``start``/``end`` byte places, ``hash``,
    ``doc`` (row of each word) and ``first`` (word offsets by row)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, letters_only: bool = False):
        """letters_only: words are runs of ASCII letters and bytes above ASCII,
        and the two-byte Latin capitals are lower-cased as well."""
        low = _LOWER[raw]
        if letters_only and len(low) > 1:
            capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
            low[capital] += 0x20
        self.raw, self.off = low, off
        inside = _LETTER[low] if letters_only else ~_SPACE[low]
        size = len(low)
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            before[off[:-1][off[:-1] < size]] = False
            after[off[1:][off[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.total = np.zeros(size + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(place_values(places(self.start, size), low, _NEAR_VALUES), out=self.total[1:])
        self.hash = self.span_hash(self.start, self.end)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start, where a word starts, to end; the same
        wherever the word stands."""
        with np.errstate(over="ignore"):
            return mix(self.total[end] - self.total[start] + (end - start).astype(np.uint64) * _GOLD)

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of every run of ``width`` words; a row with fewer words
    (but one at least) has its whole sequence as its only shingle."""
    count = words.count()
    h = words.hash
    with np.errstate(over="ignore"):
        if len(h) >= width:
            n = len(h) - width + 1
            acc = h[:n].copy()
            for j in range(1, width):
                acc *= _GOLD
                acc += h[j : j + n]
            whole = words.doc[:n] == words.doc[width - 1 :]
            out, row = mix(acc[whole]), words.doc[:n][whole]
        else:
            out, row = np.zeros(0, _U), np.zeros(0, words.doc.dtype)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            acc = np.zeros(len(short), _U)
            for j in range(width - 1):
                has = count[short] > j
                at = words.first[short][has] + j
                acc[has] = acc[has] * _GOLD + h[at]
            extra = mix(acc ^ mix(count[short].astype(np.uint64)))
            out, row = np.concatenate([out, extra]), np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            out, row = out[order], row[order]
    return out, row


def distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, with their rows."""
    if not len(values):
        return values, row
    cut = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], row[keep]
