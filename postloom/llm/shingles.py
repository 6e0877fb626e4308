"""Word shingles of whole texts as sorted arrays of 64-bit codes (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Words whose codes a task keeps at a time.
KEPT_WORDS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class WordCodes(dict):
    """Codes of words, computed on first use; emptied when it holds ``KEPT_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def shingle_set(text: str | None, codes: WordCodes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles of ``width`` words, A-Z lower-cased, sorted.

    Bytes split and lower-case by ASCII alone, which is the rule wanted. Fewer words than ``width`` make
    one shingle of their own length; no words make none.
    """
    words = text.encode("utf-8").lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    end = len(words) - span + 1
    mixed = hashed[:end] + np.uint64(span)
    for k in range(1, span):
        mixed ^= mixed >> _SHIFT
        mixed *= _ODD
        mixed += hashed[k:end + k]
    mixed ^= mixed >> _SHIFT
    mixed *= _ODD
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)
