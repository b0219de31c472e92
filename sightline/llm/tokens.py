"""Token ids of many texts at the cost of their distinct pieces.

The byte-level vocabulary never merges across the pieces into which its pattern
splits a text, so the ids of a text are its pieces' ids in a row.  Pieces are
found for a whole batch with a few passes over its code points and known ones
come from a table, which compares their characters; the tokenizer is asked only for
pieces not seen before.  A
text with a code point whose class might differ between Unicode versions goes
to the tokenizer whole.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from .textvec import mix, near_values, place_values, places

_OTHER, _LETTER, _NUMBER, _WHITE, _UNSURE = range(5)
_LIMIT = 0x3000
#: Known pieces kept by a worker before it starts anew, and the slots in which
#: it looks for them; a piece whose slot another one takes is learnt again.
TABLE_SIZE = 700_000
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
CHUNK_CHARS = 1 << 18
#: The byte-level vocabulary shows bytes as printable characters: those that are
#: printable in Latin-1 as themselves, the others from code point 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


@cache
def _classes() -> np.ndarray:
    kind = np.full(_LIMIT + 1, _UNSURE, np.uint8)
    white = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
    for cp in range(_LIMIT):
        now, old = unicodedata.category(chr(cp)), unicodedata.ucd_3_2_0.category(chr(cp))
        if cp in white:
            kind[cp] = _WHITE
        elif cp < 0x20 and cp not in white:
            kind[cp] = _UNSURE if 0x1C <= cp <= 0x1F else _OTHER
        elif now[0] == old[0] and now != "Cn" and now[0] != "Z":
            kind[cp] = {"L": _LETTER, "N": _NUMBER}.get(now[0], _OTHER)
    return kind


@cache
def _near() -> np.ndarray:
    """Values of the first places of a piece, by code point (1.5 MB)."""
    return near_values(16, _LIMIT)


def pieces(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts start.  cp: code points of the texts in a
    row, all below the limit; first: where each nonempty text starts."""
    kind = _classes()[cp]
    n = len(cp)
    new_text = np.zeros(n + 1, bool)
    new_text[first] = True
    new_text[n] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= new_text
    run = np.flatnonzero(start)  # the last is n
    a, b = run[:-1], run[1:]
    k = kind[a]
    joined = np.zeros(n + 1, bool)
    # white space before something: its last character stands alone or, a blank, goes with what follows
    w = (k == _WHITE) & ~new_text[b]
    start[b[w] - 1] = True
    blank = b[w][cp[b[w] - 1] == 0x20]
    start[blank] = False
    joined[blank] = True
    # an apostrophe of its own before letters: 's 't 'm 'd 're 've 'll
    q = (k == _OTHER) & (b - a == 1) & (cp[a] == 0x27) & ~joined[a]
    q[:-1] &= (k[1:] == _LETTER)
    q[-1:] = False
    q &= ~new_text[b]
    if q.any():
        at = a[q]
        stop = b[1:][q[:-1]]
        c1 = cp[at + 1]
        c2 = np.where(at + 2 < stop, cp[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c2 == ord("e")) & ((c1 == ord("r")) | (c1 == ord("v")))) | ((c1 == ord("l")) & (c2 == ord("l")))
        hit = one | two
        start[at[hit] + 1] = False
        rest = at[hit] + 1 + np.where(one[hit], 1, 2)
        start[rest] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """ids of texts by a tokenizer file; special strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.index = np.zeros(SLOTS, np.int32)
        self.count = 0
        self.size = np.zeros(1 << 12, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.filled = 0
        # the characters of each entry
        self.chars = np.zeros(1 << 12, np.int64)
        self.chars_at = np.zeros(1 << 12, np.int64)
        self.text = np.zeros(1 << 14, np.uint16)
        self.written = 0

    def _learn(self, texts: list[str]) -> np.ndarray:
        """New entries for these pieces; where they are in size and at."""
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(x.encode().decode("latin-1").translate(_SHOWN))] for x in texts]
        size = np.array([len(x) for x in ids], np.int32)
        flat = np.array([y for x in ids for y in x], np.uint32)
        k = self.count
        while k + len(ids) > len(self.size):
            self.size, self.at, self.chars, self.chars_at = (np.resize(x, 2 * len(x)) for x in (self.size, self.at, self.chars, self.chars_at))
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.size[k : k + len(ids)] = size
        self.at[k : k + len(ids)] = self.filled + np.cumsum(size) - size
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        while self.written + len(letters) > len(self.text):
            self.text = np.resize(self.text, 2 * len(self.text))
        long = np.array([len(x) for x in texts], np.int64)
        self.chars[k : k + len(ids)] = long
        self.chars_at[k : k + len(ids)] = self.written + np.cumsum(long) - long
        self.text[self.written : self.written + len(letters)] = letters
        self.written += len(letters)
        self.count += len(ids)
        return np.arange(k, self.count)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text; an empty text has none."""
        out: list[np.ndarray | None] = [None] * len(texts)
        todo, chars = [], 0
        for i, t in enumerate(texts):
            todo.append(i)
            chars += len(t)
            if chars >= CHUNK_CHARS or i == len(texts) - 1:
                self._chunk(texts, todo, out)
                todo, chars = [], 0
        return out

    def _chunk(self, texts: list[str], rows: list[int], out: list) -> None:
        whole = "".join(texts[i] for i in rows)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum([len(texts[i]) for i in rows])
        kind = _classes()
        odd = np.flatnonzero((cp >= _LIMIT) | (kind[np.minimum(cp, _LIMIT)] == _UNSURE))
        if len(odd):
            bad = set(np.searchsorted(end, odd, side="right").tolist())
            for k in bad:
                out[rows[k]] = np.array(self._plain(texts[rows[k]]), np.uint32)
            rows = [r for k, r in enumerate(rows) if k not in bad]
            if rows:
                self._chunk(texts, rows, out)
            return
        if not len(cp):
            for i in rows:
                out[i] = np.zeros(0, np.uint32)
            return
        begin = end - np.diff(end, prepend=0)
        start = pieces(cp, begin[begin < end])
        stop = np.append(start[1:], len(cp))
        place = places(start, len(cp))
        with np.errstate(over="ignore"):
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(place_values(place, cp, _near()), out=total[1:])
            h = mix(total[stop] - total[start] + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if self.count > TABLE_SIZE:
            self._forget()
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        index = self.index[slot].astype(np.int64)
        new = np.flatnonzero(self.key[slot] != h)
        if len(new):
            u, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            where = new[where]
            learnt = self._learn([whole[a:b] for a, b in zip(start[where].tolist(), stop[where].tolist(), strict=True)])
            index[new] = learnt[back]
            self.key[slot[where]], self.index[slot[where]] = u, learnt
        # an entry counts only if its characters are the piece's
        other = self.chars[index] != stop - start
        at = np.repeat(self.chars_at[index] - start, stop - start) + np.arange(len(cp))
        unlike = np.flatnonzero(self.text.take(at, mode="clip") != cp)
        if len(unlike):
            other[np.searchsorted(start, unlike, side="right") - 1] = True
        other = np.flatnonzero(other)
        if len(other):
            index[other] = self._learn([whole[a:b] for a, b in zip(start[other].tolist(), stop[other].tolist(), strict=True)])
        size = self.size[index]
        done = np.cumsum(size)
        ids = self.pool[np.arange(done[-1]) + np.repeat(self.at[index] - (done - size), size)]
        piece_end = np.searchsorted(start, end)
        cut = np.concatenate([[0], done])[piece_end]
        for i, a, b in zip(rows, np.concatenate([[0], cut[:-1]]).tolist(), cut.tolist(), strict=True):
            out[i] = ids[a:b]


@cache
def encoder(path: str) -> Encoder:
    """The encoder of this worker process: its table serves all its tasks."""
    return Encoder(path)
