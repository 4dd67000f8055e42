"""Comparisons of sequences of names: longest common subsequence, order agreement, edits."""

from __future__ import annotations

from difflib import SequenceMatcher


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, in one row of the table."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            above = row[j]
            row[j] = corner + 1 if x == y else max(above, row[j - 1])
            corner = above
    return row[-1]


def order_share(a: list, b: list) -> float | None:
    """Share of pairs of common names (by first place) that stand in the same order; None with under two common names."""
    first = {}
    for i, x in enumerate(b):
        first.setdefault(x, i)
    places = [first[x] for x in dict.fromkeys(a) if x in first]
    n = len(places)
    if n < 2:
        return None
    same = sum(places[i] < places[j] for i in range(n) for j in range(i + 1, n))
    return same / (n * (n - 1) / 2)


def edits(a: list, b: list) -> list[tuple[str, list, str]]:
    """(kind, names, end) of what turns a into b: names put on or taken off at an end alone extend or truncate it,
    and what is left of a changed stretch is told as names removed and names inserted, one or a run."""
    out = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        start, end = i1 == j1 == 0, i2 == len(a) and j2 == len(b)
        if tag != "replace" and (start or end):
            out.append(("PATTERN_EXTENDED" if tag == "insert" else "PATTERN_TRUNCATED", b[j1:j2] or a[i1:i2], "start" if start else "end"))
            continue
        for names, one, run in ((a[i1:i2], "STOP_REMOVED_FROM_PATTERN", "DETOUR_REMOVED"), (b[j1:j2], "STOP_INSERTED_IN_PATTERN", "DETOUR_ADDED")):
            if names:
                out.append((one if len(names) == 1 else run, names, ""))
    return out
