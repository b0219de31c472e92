"""Token ids of two public vocabularies at the cost of their distinct pieces.

Both vocabularies cut a text into pieces that no token crosses: a pattern's
matches (words, digits, marks) for the word vocabulary, words with the blanks
before them for the sentence vocabulary.  A worker keeps the ids of the pieces
it has met; the tokenizer is asked for new ones only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

from .tokens import _LETTER, _LIMIT, _NUMBER, _OTHER, _SHOWN, _UNSURE, _classes

#: Known pieces a worker keeps before it starts anew, and the characters of the
#: longest that it keeps.
MOST_PIECES = 400_000
LONG_PIECE = 48


class Known(dict):
    """Pieces to the bytes of their ids (little-endian, 32 bits each)."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece), "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), "<u4")


def _chars(*kinds: int) -> str:
    """The code points of these classes, as a character class's ranges."""
    kind = _classes()[:_LIMIT]
    at = np.flatnonzero(np.diff(np.isin(kind, kinds).astype(np.int8), prepend=0, append=0))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(at[::2].tolist(), at[1::2].tolist(), strict=True))


class WordEncoder:
    """ids by the word vocabulary's file: lower case, white space dropped;
    special strings are ordinary text.

    A text with a code point whose class might differ between Unicode versions
    goes to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        tokenize = self.tokenizer.model.tokenize
        self.known = Known(lambda x: [t.id for t in tokenize(x.encode().decode("latin-1").translate(_SHOWN))])
        self.unsure = re.compile(f"[{_chars(_UNSURE)}\\U{_LIMIT:08x}-\\U0010ffff]")
        letter, number, rest = _chars(_LETTER), _chars(_NUMBER), _chars(_OTHER)
        self.piece = re.compile(f"'(?:[stmd]|re|ve|ll)|[{letter}]+|[{number}]|[{rest}]+")

    def encode(self, text: str) -> np.ndarray:
        if self.unsure.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if not text.isascii():
            # each character on its own, so a sigma at a word's end is one as elsewhere
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.known.ids(self.piece.findall(text.lower()))


class SentenceEncoder:
    """ids by the sentence vocabulary's file, which puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        #: The bytes of each id, U+2581 being a blank.
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a blank is only ever at the front of a token, so no token crosses the front of a word's blanks
        apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.piece = re.compile(" *[^ ]+| +" if apart else "(?s).+")
        blank = model.piece_to_id("▁")
        self.known = Known(lambda x: model.encode(x[1:]) if len(x) > 1 else [blank])

    def encode(self, text: str) -> np.ndarray:
        return self.known.ids(self.piece.findall(" " + text)) if text else np.zeros(0, "<u4")


@cache
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process: what it knows serves all its tasks."""
    return WordEncoder(path)


@cache
def sentence_encoder(path: str) -> SentenceEncoder:
    return SentenceEncoder(path)
