"""64-bit hashes of runs of bytes, for all runs of an array at once."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: all bits of the input reach all of the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random number for each byte, so that runs are sums of products of unlike numbers.
BYTES = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
FACTOR = U(0xD6E8FEB86659FD93)
#: Its inverse modulo 2 ** 64.
INVERSE = U(pow(int(FACTOR), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = powers(FACTOR, 1 << 21), powers(INVERSE, 1 << 21)


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, numbers: np.ndarray = BYTES) -> np.ndarray:
    """Hash of each run of bytes from begin to before end; ``numbers`` has one for each byte."""
    global POWERS, INVERSES
    if len(data) > len(POWERS):
        POWERS, INVERSES = powers(FACTOR, len(data)), powers(INVERSE, len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(numbers[data] * POWERS[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[begin]) * INVERSES[begin] + (end - begin).astype(U))
