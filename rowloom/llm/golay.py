"""The binary Golay code of 23 bits, as tables made from its generator polynomial.

Every word of 23 bits is within three bits of exactly one of the 4,096 codewords. A word at
distance three from it has five more codewords at distance four. ``keys`` are those: one
codeword up to distance two, six at distance three. Two words that differ in at most two bits
always have a key in common; if they differ in one bit at most, the nearest codeword of either
is among the keys of the other.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

BITS, DATA_BITS = 23, 12
CHECK_BITS = BITS - DATA_BITS
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
#: keys of a word, at most
MOST = 6


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each word (as a polynomial over two elements) by the generator."""
    rest = words.astype(np.uint32)
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        rest = rest ^ (((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - CHECK_BITS)))
    return rest


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome the errors that lead to a key (the nearest first, rows filled up with it), and how many there are."""
    patterns = [np.array([sum(1 << b for b in c) for c in combinations(range(BITS), w)], np.uint32) for w in range(5)]
    errors = np.zeros((1 << CHECK_BITS, MOST), np.uint32)
    counts = np.ones(1 << CHECK_BITS, np.int64)
    for near in patterns[:4]:
        errors[syndromes(near)] = near[:, None]
    far, three = patterns[4], syndromes(patterns[3])
    at = syndromes(far)
    order = np.argsort(at, kind="stable")
    far, at = far[order], at[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    errors[at, place + 1] = far
    counts[three] = MOST
    return errors, counts


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices within the distances above, nearest first: (words x MOST), and how many of each row count."""
    errors, counts = tables()
    at = syndromes(words)
    return (words.astype(np.uint32)[:, None] ^ errors[at]) >> np.uint32(CHECK_BITS), counts[at]
