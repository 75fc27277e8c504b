"""The binary Golay code (23, 12): decoding, and the keys of a segment.

Every 23-bit word is within three bits of exactly one codeword.  The keys of a word are
the codewords that it or a word one bit away decodes to: one key, or six where the word
is three bits from its codeword.  Words one bit apart always share a key, words a few
bits apart mostly.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np

#: Fixed value of the code: its generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
LENGTH, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for i in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte at each of three places, and the error of each syndrome."""
    bits = [_remainder(1 << i) for i in range(LENGTH)] + [0]
    places = np.array([[reduce(lambda a, b: a ^ b, (bits[8 * p + i] for i in range(8) if v >> i & 1), 0) for v in range(256)] for p in range(3)])
    errors = np.zeros(1 << CHECKS, np.int64)
    for weight in range(4):
        for at in combinations(range(LENGTH), weight):
            errors[reduce(lambda a, b: a ^ b, (bits[i] for i in at), 0)] = sum(1 << i for i in at)
    return places, errors


PLACES, ERRORS = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word."""
    syndrome = PLACES[0][words & 255] ^ PLACES[1][words >> 8 & 255] ^ PLACES[2][words >> 16 & 255]
    return (words ^ ERRORS[syndrome]) >> CHECKS


def near(words: np.ndarray, width: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words of ``width`` bits, one row a word, and which entries of a row count (the others repeat one)."""
    keys = np.sort(np.stack([decode(words), *(decode(words ^ (1 << i)) for i in range(width))], axis=1), axis=1)
    return keys, np.concatenate([np.ones((len(words), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
