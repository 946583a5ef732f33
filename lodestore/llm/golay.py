"""Fuzzy hash keys from the binary Golay code of length 23.

The code is perfect: every 23-bit word lies within distance 3 of exactly one codeword. The
keys of a word are the codewords to which the word itself and its one-bit neighbours decode:
one key if the word is within distance 2 of its codeword, else at most six. Two words that
differ in at most two bits have a common neighbour-or-self, hence share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0xC75
LENGTH, CHECKS = 23, 11
MAX_KEYS = 6


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each single bit; error pattern (weight 3 at most) of each remainder."""
    one = np.array([_remainder(1 << i) for i in range(LENGTH)], np.uint32)
    errors = np.zeros(1 << CHECKS, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            errors[np.bitwise_xor.reduce(one[list(bits)])] = sum(1 << b for b in bits)
    return one, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    one, errors = _tables()
    syndrome = np.zeros(words.shape, np.uint32)
    for i in range(LENGTH):
        syndrome ^= ((words >> np.uint32(i)) & np.uint32(1)) * one[i]
    return (words ^ errors[syndrome]) >> np.uint32(CHECKS)


def keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Distinct codeword indices near each ``bits``-bit word (the higher bits are zero): n x 6, filled up with -1."""
    words = words.astype(np.uint32)
    near = np.stack([words, *(words ^ np.uint32(1 << i) for i in range(bits))], 1)
    found = np.sort(decode(near).astype(np.int32), 1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(words), MAX_KEYS), -1, np.int32)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, 1) - 1)[row, col]] = found[row, col]
    return out
