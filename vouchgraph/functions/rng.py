"""Counter-based random numbers: a pure function of (seed, ego, walk, step), alike in numpy, Spark and DuckDB.

Every state is below 2**31 - 1 and every product below 2**62, so 64-bit signed integers are enough anywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = (1 << 31) - 1
_A, _B = 48_271, 69_621


def _reduced(x: np.ndarray) -> np.ndarray:
    """x % P in place, for 0 <= x < 2**61: P is a Mersenne prime, so high bits are added to low ones, less than P twice."""
    high = x >> 31
    x &= P
    x += high
    np.subtract(x, P, out=high)
    u = x.view(np.uint64)
    np.minimum(u, high.view(np.uint64), out=u)  # below zero wraps to more than x
    return x


def begun(h: np.ndarray) -> np.ndarray:
    """What :func:`drawn` needs of states: they are multiplied once for all values."""
    return h * _A + 11


def drawn(begun_: np.ndarray, v: int) -> np.ndarray:
    """:func:`mix` of the states behind ``begun_`` and the value v."""
    return _finished(begun_ + v % P * _A)


def _finished(x: np.ndarray) -> np.ndarray:
    """The rest of :func:`mix` from (h + v) * _A + 11 < 2**49 on, in place."""
    x = _reduced(x)
    for by, factor in ((13, _B), (11, _A)):
        x ^= x >> by
        x *= factor
        x = _reduced(x)
    x ^= x >> 15
    return x


def mix(h, v):
    """numpy or int: the next state from state h and value v."""
    if isinstance(h, np.ndarray) and h.dtype == np.int64:
        return _finished((h + v % P) * _A + 11)
    h = ((h + v % P) % P * _A + 11) % P
    h = (h ^ (h >> 13)) * _B % P
    h = (h ^ (h >> 11)) * _A % P
    return h ^ (h >> 15)


def mix_col(h: Column, v: Column) -> Column:
    """The same on Spark columns."""
    h = ((h + v % P) % P * _A + 11) % P
    h = h.bitwiseXOR(F.shiftright(h, 13)) * _B % P
    h = h.bitwiseXOR(F.shiftright(h, 11)) * _A % P
    return h.bitwiseXOR(F.shiftright(h, 15))


def mix_sql(h: str, v: str) -> str:
    """The same as SQL text."""
    a = f"((({h}) + ({v}) % {P}) % {P} * {_A} + 11) % {P}"
    b = f"xor({a}, ({a}) >> 13) * {_B} % {P}"
    c = f"xor({b}, ({b}) >> 11) * {_A} % {P}"
    return f"xor({c}, ({c}) >> 15)"


def go_on_below(alpha: float) -> int:
    """A walk goes on iff its draw is below this."""
    return int(np.floor(alpha * P))
