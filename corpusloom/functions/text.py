"""Words, stems and word shingles of Kannada and Latin text.

The word sequence that shingles are made of: NFC, maximal runs outside white space and the marks
below, stop words dropped, the longest listed suffix taken off each word.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

# Word separators, stop words, suffixes, shingle width.
WORD_PATTERN = r"[^\s.,!?;:\"'()\[\]{}।॥]+"
STOP_WORDS = ("ಮತ್ತು", "ಅಥವಾ", "ಈ", "ಆ", "ಒಂದು", "ಅವರು", "ಅವನು", "ಅವಳು", "ಇದು", "ಅದು", "ಎಂದು", "ಆದರೆ", "ಹಾಗೂ", "ಗೆ", "ದ", "ನ")
SUFFIXES = ("ಗಳು", "ಗಳಲ್ಲಿ", "ದಲ್ಲಿ", "ನಲ್ಲಿ", "ಗೆ", "ನ್ನು", "ರಿಂದ", "ಕ್ಕೆ", "ವನ್ನು", "ದಿಂದ", "ಯಲ್ಲಿ", "ರ", "ದ", "ನ", "ವು", "ಗಳ")
SHINGLE_WORDS = 5
MIN_STEM = 2

_words = re.compile(WORD_PATTERN).findall
_stop = frozenset(STOP_WORDS)
_by_length = sorted(SUFFIXES, key=len, reverse=True)


def words(text: str) -> list[str]:
    return _words(unicodedata.normalize("NFC", text))


def stem(word: str) -> str:
    """word without its longest listed suffix; whole where fewer than MIN_STEM characters would be left."""
    for s in _by_length:
        if word.endswith(s):
            return word[: -len(s)] if len(word) - len(s) >= MIN_STEM else word
    return word


def content_words(text: str) -> list[str]:
    return [stem(w) for w in words(text) if w not in _stop]


def shingles(text: str, width: int = SHINGLE_WORDS) -> set[str]:
    """The distinct runs of width content words; all of them as one shingle if there are fewer; none if there is none."""
    ws = content_words(text)
    if len(ws) < width:
        return {" ".join(ws)} if ws else set()
    return {" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)}


def shingle_hashes(text: str, width: int = SHINGLE_WORDS) -> list[str]:
    """SHA-256 of each shingle, sorted."""
    return sorted(hashlib.sha256(s.encode()).hexdigest() for s in shingles(text, width))


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the public SplitMix64 finaliser)."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds64(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants made from a salt."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt)) | _U(1)


def word_id(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class ShingleHasher:
    """Sorted distinct 64-bit shingle keys of texts: the sets of shingles(), a key for each string.

    Word keys are cached; the cache is emptied when it holds most words, so memory stays bounded.
    """

    def __init__(self, width: int = SHINGLE_WORDS, most: int = 500_000):
        self.width, self.most, self.seen = width, most, {}
        self.odd = seeds64(width, 5)

    def _ids(self, ws: Iterable[str]) -> list[int]:
        if len(self.seen) > self.most:
            self.seen.clear()
        seen, out = self.seen, []
        for w in ws:
            k = seen.get(w)
            if k is None:
                k = seen[w] = 0 if w in _stop else word_id(stem(w)) | 1
            if k:
                out.append(k)
        return out

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The key set of each text; empty for a null text."""
        parts = [self._ids(words(t)) if t else [] for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((k for p in parts for k in p), _U, int(size.sum()))
        w = self.width
        if len(flat) >= w:
            runs = np.zeros(len(flat) - w + 1, _U)
            for j in range(w):
                runs += mix64(flat[j : len(flat) - w + 1 + j] * self.odd[j])
            runs = mix64(runs)
        at = 0
        for n in size.tolist():
            if n >= w:
                yield np.unique(runs[at : at + n - w + 1])
            elif n:
                k = np.array([n], _U)
                for j in range(n):
                    k = mix64(k + flat[at + j : at + j + 1] * self.odd[j])
                yield k
            else:
                yield np.empty(0, _U)
            at += n


def bytes_id(data: bytes) -> int:
    """A signed 64-bit key of a byte string."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
