"""Fast exact ids of word_bpe_49k: the tokenizers library's model, asked once for each distinct pre-token.

Texts whose characters all lie below U+0250 are split here; everything else (rarer scripts, control
characters that libraries class differently, the special tokens' strings) goes through the library whole. Tests
hold both ways against each other over every code point of the range.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import partial

import numpy as np

from .common import hold

#: What the quick way does not cover: these characters, and the strings that start the special tokens.
ODD, SPECIAL = re.compile(r"[^\t-\r\x20-\x7e\x80-ɏ]"), "<|"
#: The tokenizer's split pattern, written for characters below U+0250 with this module's idea of letters and numbers.
PUNCT = r"(?:[^\s\w\xb2\xb3\xb9\xbc-\xbe]|_)+"
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|" + PUNCT)
#: Words of each of two generations that a worker remembers: a full one becomes the old one, so memory stays bounded and frequent words stay in.
MEMORY = 350_000
#: Punctuation that often ends a word; such words are looked up without it.
ENDS = ".,;:!?"
WORD = partial(array, "I" if sys.byteorder == "little" and array("I").itemsize == 4 else "unsupported machine")


def odd(text: str) -> bool:
    return SPECIAL in text or ODD.search(text) is not None


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others get characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """whitespace-separated lower-case word -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.chars = byte_chars()
        self.old: dict[str, bytes] = {}
        self.ends = {c: self._pack([c]) for c in ENDS}

    def _pack(self, pieces: list[str]) -> bytes:
        ids = []
        for p in pieces:
            ids += [t.id for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.chars))]
        return WORD(ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        end = self.ends.get(word[-1])
        if end is not None and (stem := word[:-1]).isalpha():
            got = self[stem] + end
            if len(word) > 6:  # short ones come often enough to be kept as they are
                return got
        else:
            got = self.old.get(word)
            if got is None:
                got = self._pack([word] if word.isalpha() else PIECES.findall(word))
        if len(word) < 64:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        """All ids of a whole text (null: none), as the library's encode(text, add_special_tokens=False)."""
        if not text:
            return b""
        if odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


def words(path: str) -> WordIds:
    """This worker's memory for a vocabulary file."""
    return hold(("words", path), lambda: WordIds(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
