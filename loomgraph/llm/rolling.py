"""Rolling hashes of consecutive words, on 64 bits."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of two independent rolling hashes, and of the mixing of their bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXER = 0xFF51AFD7ED558CCD
MODULUS = 1 << 64


def rolled(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """The hash of each ``k`` consecutive of ``words``, by doubling."""
    found, length, power, long = None, 0, words, 1
    while True:
        if k & long:
            if found is None:
                found, length = power, long
            else:
                n = len(words) - length - long + 1
                found = found[:n] * np.uint64(pow(base, long, MODULUS)) + power[length : length + n]
                length += long
        if 2 * long > k:
            return found
        n = len(power) - long
        power = power[:n] * np.uint64(pow(base, long, MODULUS)) + power[long:]
        long *= 2


def mixed(hashes: np.ndarray) -> np.ndarray:
    """``hashes`` with every bit spread over all."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(MIXER)
    return hashes ^ (hashes >> np.uint64(29))
