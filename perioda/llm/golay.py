"""Nearest and nearby codewords of the binary Golay code of length 23."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE = 23, 12
#: The code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words modulo the generator; 0 for codewords."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - (LENGTH - MESSAGE)))
    return rest


@cache
def error_patterns() -> np.ndarray:
    """For each of the 2048 syndromes, the errors that lead to codewords at distance 4 or less.

    Column 0 is the only error of weight 3 or less.  Where it weighs 3 there
    are five more of weight 4; elsewhere none, and column 0 stands in.
    """
    table = np.full((1 << (LENGTH - MESSAGE), 6), -1, np.int64)
    filled = np.zeros(len(table), np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for pattern, syndrome in zip(patterns.tolist(), syndromes(patterns).tolist()):
            table[syndrome, filled[syndrome]] = pattern
            filled[syndrome] += 1
    assert set(filled.tolist()) == {1, 6}
    return np.where(table < 0, table[:, :1], table)


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """Message bits of the codewords at distance 4 or less, six a word, repeats included.

    Two words that differ in one bit have one in common.  Let c be nearest to
    u, so at distance 3 or less, and so 4 or less from v.
    """
    words = words.astype(np.int64)
    return (words[:, None] ^ error_patterns()[syndromes(words)]) >> (LENGTH - MESSAGE)
