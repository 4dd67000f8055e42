"""Stop axes: one order of stops that holds several sequences, and how a sequence lies on it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_places(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence: of several the one that stands furthest back in a."""
    lengths = [[0] * (len(b) + 1)]
    for x in a:
        above, row = lengths[-1], [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        lengths.append(row)
    found, i, j = [], len(a), len(b)
    while lengths[i][j]:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif lengths[i - 1][j] == lengths[i][j]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def supersequence(a: Sequence, b: Sequence) -> tuple:
    """A shortest sequence that has both as subsequences. Between two common names stand b's own, then a's; before the first and after the last common one too."""
    out, i, j = [], 0, 0
    for at_a, at_b in [*common_places(a, b), (len(a), len(b))]:
        out += b[j:at_b]
        out += a[i : at_a + 1]  # up to the common name itself
        i, j = at_a + 1, at_b + 1
    return tuple(out)


@lru_cache(1 << 14)
def with_sequence(axis: tuple, seq: tuple) -> tuple:
    """Their supersequence; the axis itself where it has the sequence."""
    rest = iter(axis)
    return axis if all(x in rest for x in seq) else supersequence(axis, seq)


def stop_axis(sequences: Iterable[Sequence]) -> tuple:
    """An axis that has every sequence as a subsequence: the longest one, with the others folded in from long to short."""
    axis: tuple = ()
    for n, seq in enumerate(sorted({tuple(s) for s in sequences}, key=lambda s: (-len(s), s))):
        axis = with_sequence(axis, seq) if n else seq
    return axis


def places_on(seq: Sequence, axis: Sequence) -> list[int]:
    """The first place on the axis for each name, in order; -1 for a name that has none there any more."""
    out, start = [], 0
    for name in seq:
        at = next((k for k in range(start, len(axis)) if axis[k] == name), -1)
        out.append(at)
        start = start if at < 0 else at + 1
    return out


def gaps(places: Iterable[int]) -> int:
    """How often a column stops showing times between its first and last: what makes it hard to read."""
    return sum(later - earlier > 1 for earlier, later in pairwise([p for p in places if p >= 0]))


@lru_cache(1 << 14)
def gaps_on(seq: tuple, axis: tuple) -> int:
    """The gaps of a sequence on an axis."""
    return gaps(places_on(seq, axis))


def is_within(a: Column, b: Column) -> Column:
    """Whether an array is a subsequence of another, its names not needing to stand side by side."""
    rest = lambda at: F.slice(b, at, F.greatest(F.size(b), F.lit(1)))
    step = lambda at, x: F.when(at == 0, at).otherwise(F.when(F.array_contains(rest(at), x), at + F.array_position(rest(at), x).cast("int")).otherwise(0))
    return F.aggregate(a, F.lit(1), step) > 0
