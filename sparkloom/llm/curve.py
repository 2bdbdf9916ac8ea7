"""Keys along a Hilbert curve."""

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of `cells` (n x dims, whole numbers below 2**bits) along the Hilbert curve, dims * bits <= 63.

    After J. Skilling, Programming the Hilbert curve (2004): undo the excess work of each level, Gray encode, and
    interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key
