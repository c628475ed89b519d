"""Token ids of whole texts by the tokenizers library, with worker caches.

A byte-level tokenizer cuts a text before every single space that stands
between visible characters, whatever surrounds it.  So a text whose spaces
all stand so is cut there.  The pieces repeat a lot and are looked up in a
cache; a new piece is cut into pre-tokens, which have a cache of their own,
and only a new pre-token goes to the library's model.  Any other text (rare
separators, runs of spaces, special strings) goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

from . import memory

#: Pieces and pre-tokens that one Python worker keeps; a full cache keeps what
#: it has, and the rest is encoded each time.
PIECES, PRE_TOKENS = 400_000, 400_000
#: Characters of a piece that is kept, and characters and bytes of ids that one
#: cache keeps: long pieces seldom come again, and few of them would fill a worker.
LONGEST, CACHE_BYTES = 64, 16 << 20

#: White space other than a space or a line feed, and control characters.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u3000]")

#: Characters for which Python's classes might differ from the library's.
_FAR = re.compile("[^\x00-\x7e\xa1-\u024f]|[\xb2\xb3\xb9\xbc-\xbe]|[\x1c-\x1f]")

# The pre-token pattern of byte-level BPE, as in
# public_tokenizers.PATTERN, written for characters that _FAR lets through.
_PRE_TOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_ENCODERS: dict[str, "PieceEncoder"] = memory.cache()


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: a printable byte is itself, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + n for n, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    """A cache of bounded entries and bytes."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.room = entries, CACHE_BYTES

    def keep(self, key: str, made: bytes) -> bytes:
        if len(key) <= LONGEST and len(self) < self.entries and self.room > 0:
            self[key] = made
            self.room -= len(key) + len(made)
        return made


class _PreTokens(_Kept):
    def __init__(self, tokenizer):
        super().__init__(PRE_TOKENS)
        model = tokenizer.model
        model._resize_cache(0)  # new words only come here, so its own cache would not be hit
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        return self.keep(word, _packed([x.id for x in self.tokenize(word.encode().decode("latin-1").translate(self.letters))]))


class _Pieces(_Kept):
    def __init__(self, tokenizer):
        super().__init__(PIECES)
        self.tokenizer, self.words = tokenizer, _PreTokens(tokenizer)

    def __missing__(self, piece: str) -> bytes:
        if not piece.isascii() and _FAR.search(piece):
            made = _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        elif piece[1:].isalpha() and piece[0] == " ":
            made = self.words[piece]
        elif (body := piece.rstrip(_MARKS))[1:].isalpha() and body[0] == " ":
            made = self.words[body] + self.words[piece[len(body) :]]  # letters, then marks only
        else:
            made = b"".join(map(self.words.__getitem__, _PRE_TOKEN.findall(piece)))
        return self.keep(piece, made)


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit integers, for byte-level BPE files."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """A null text counts as an empty one."""
        if not text:
            return b""
        if "  " in text or "\n \n" in text or "<|" in text or _ODD.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, [first, *[" " + x for x in rest]]))


def encoder(path: str) -> PieceEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        memory.release()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
