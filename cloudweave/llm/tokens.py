"""Token ids of whole texts, word by word: each distinct word is tokenized once a worker."""

from __future__ import annotations

from array import array
from functools import lru_cache
from string import punctuation

import numpy as np
import regex

WINDOW, END = 4096, 2

#: Latin-1 bytes for which splitting at white space is what the tokenizer does (fixed values): printable ASCII,
#: tab, line feed, carriage return and the printable upper half.
_SAFE = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])


def _byte_letters() -> dict[int, int]:
    """Each byte's letter in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class _Words(dict):
    """Ids of words as little-endian 32-bit bytes, found as they are first asked for; at most limit of them."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = self.make(word)
        return out


class WordTokenizer:
    """Ids of the tokenizers file at path, without special tokens.

    The file's rule drops white space, lower-cases and merges within a letter run, a digit or a run of marks,
    so a text of ordinary characters has the ids of its words in a row. Any other text (other scripts'
    characters, control characters, a special token's string) goes to the library whole.
    """

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        merge = self.whole.model.tokenize
        piece = _Words(lambda p: array("i", [t.id for t in merge(p.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes(), words)

        def word(w: str) -> bytes:
            core = w.rstrip(punctuation)
            if core.isalpha():  # a letter run, and marks perhaps
                return piece[core] + piece[w[len(core) :]] if len(core) < len(w) else piece[core]
            return b"".join([piece[p] for p in pieces(w)])

        self.words = _Words(word, words)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit bytes."""
        if "<|" not in text:
            try:
                if not text.encode("latin-1").translate(None, _SAFE):
                    words = self.words
                    return b"".join([words[w] for w in text.lower().split()])
            except UnicodeEncodeError:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<i4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
