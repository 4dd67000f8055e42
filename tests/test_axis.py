import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gantline.functions import axis as A

names = st.lists(st.sampled_from("ABCDE"), max_size=9)


def holds(axis, seq):
    rest = iter(axis)
    return all(x in rest for x in seq)


def shortest(a, b, memo=None):
    """Length of the shortest sequence that holds both, by trying."""
    memo = {} if memo is None else memo
    if not a or not b:
        return len(a) + len(b)
    if (a, b) not in memo:
        memo[a, b] = 1 + (shortest(a[1:], b[1:], memo) if a[0] == b[0] else min(shortest(a[1:], b, memo), shortest(a, b[1:], memo)))
    return memo[a, b]


@settings(max_examples=300, deadline=None)
@given(names, names)
def test_two_sequences(a, b):
    found = A.supersequence(a, b)
    assert holds(found, a) and holds(found, b) and len(found) == shortest(tuple(a), tuple(b))
    if holds(a, b):
        assert list(found) == a


@settings(max_examples=150, deadline=None)
@given(st.lists(names, max_size=6))
def test_an_axis_holds_all_sequences_in_any_order(seqs):
    found = A.stop_axis(seqs)
    assert A.stop_axis(seqs[::-1]) == found
    for s in seqs:
        at = A.places_on(s, found)
        assert -1 not in at and at == sorted(set(at)) and [found[k] for k in at] == s


def test_what_stands_first():
    assert A.supersequence("ABCDE", "ABC") == tuple("ABCDE")
    assert A.supersequence("ABCD", "ABXD") == tuple("ABXCD")  # between common stops those of the second come first
    assert A.stop_axis([]) == ()
    assert A.places_on("CBA", "ABC") == [2, -1, -1]  # the opposite direction isn't forced on an axis


def test_gaps():
    assert A.gaps([0, 1, 2]) == A.gaps([]) == A.gaps([4]) == 0
    assert A.gaps([0, 2, 3, 7]) == 2 and A.gaps([0, -1, 1]) == 0


def test_being_within(spark):
    rng = random.Random(3)
    draw = lambda n: [rng.choice("ABCD") for _ in range(rng.randint(0, n))]
    rows = [(draw(4), draw(7)) for _ in range(400)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>").select("i", A.is_within(F.col("a"), F.col("b")).alias("x")).collect()
    want = [holds(b, a) for a, b in rows]
    assert [r["x"] for r in sorted(got)] == want and 50 < sum(want) < 350
