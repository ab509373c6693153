"""Token ids of whole texts by a ``tokenizers`` file, with a cache of words.

For vocabularies whose pre-tokenizer drops white space, no token spans a space or line feed, so texts are cut
there and each distinct piece is encoded once.
"""

from __future__ import annotations

import functools
import gc
import os
from array import array
from collections.abc import Iterator


_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which may begin a token with a letter


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class _WordIds(dict):
    """Ids of words (little-endian unsigned 32-bit), learned when first asked for; short ones are kept."""

    longest = 32

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.marks: dict[str, bytes] = {}
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize

    def whole(self, word: str) -> bytes:
        return array("I", self.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        """Marks after a Latin letter are tokens of their own, and A-Z are lower-cased: such words share their stem's ids."""
        stem = word.rstrip(_MARKS)
        if not stem or not stem[-1].isalpha() or stem[-1] > "\xff":
            found = self.whole(word)
        elif len(stem) < len(word):
            mark = word[len(stem) :]
            if mark not in self.marks:
                self.marks[mark] = self.whole(mark)
            found = self[stem] + self.marks[mark]
        elif stem.isascii():
            low = stem.lower()
            if low != stem:
                found = self[low]
            elif stem.isalpha():  # Latin letters in lower case: normalizer and pre-tokenizer leave them as they are
                found = array("I", [t.id for t in self.tokenize(stem)]).tobytes()
            else:
                found = self.whole(stem)
        elif stem.isalpha() and max(stem) <= "\xff":
            low = stem.lower()
            found = array("I", [t.id for t in self.tokenize(low.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
        else:
            found = self.whole(stem)
        if len(word) <= self.longest:
            self[word] = found
        return found

    def clear(self) -> None:
        super().clear()
        self[""] = b""
        self.marks.clear()


class WordTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids; words are forgotten when more than ``cache_words`` are known."""

    cache_words = 300_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._ids = _WordIds(self.tokenizer)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, one after another. Cycles are not searched for meanwhile: there are none, and many strings."""
        searching = gc.isenabled()
        gc.disable()
        ids = self._ids
        of = ids.__getitem__
        try:
            for text in texts:
                if len(ids) > self.cache_words:
                    ids.clear()
                yield b"".join(map(of, text.replace("\n", " ").split(" ")))
        finally:
            if searching:
                gc.enable()

    def forget(self) -> None:
        """Let go of the words, when a task ends: the worker may serve other stages next."""
        self._ids.clear()


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker and file."""
    return WordTokenizer(path)
