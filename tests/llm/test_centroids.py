import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gantline.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, n string"


def by_hand(rows, clusters=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    means = [v for _, v in first]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(means))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(means)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                means[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    told = [(i, *near(v)[::-1]) for i, v in kept]
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, j, d, sum(x[2] for x in told if x[1] == j), sum(x[2] for x in told), names[j]) for i, j, d in told), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(n, seed, levels=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [rng.choice(levels) if levels else x + rng.gauss(0, 0.7) for x in c]))
    return out


@pytest.mark.parametrize("levels", [None, [0.0, 1 / 1024]])  # the second: ties of distances everywhere
def test_clusters_agree_with_brute_force_and_sql(spark, levels):
    rows = vectors(150, 5, levels)
    rows += [rows[3], rows[3], (None, rows[5][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, []), (904, [None] + [1.0] * 63), (905, [math.nan] + [1.0] * 63), (906, [math.inf] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    want = by_hand(rows)
    assert got(C.cluster(df)) == want
    embeddings = df.select("vec_id", "embedding").toArrow()  # noqa: F841
    told = duckdb.sql(C.sql()).fetchall()
    assert sorted(told, key=str) == want


def test_few_vectors_none_and_huge_ones(spark):
    assert C.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    few = vectors(3, 1)
    assert got(C.cluster(spark.createDataFrame([(*r, "x", "y", "z") for r in few], SCHEMA))) == by_hand(few)
    huge = [(i, [(-1.0) ** i * 1e300] * 64) for i in range(4)]
    out = got(C.cluster(spark.createDataFrame([(*r, "x", "y", "z") for r in huge], SCHEMA)))
    assert [r[2] for r in out] == [0] * 4 and len({r[5] for r in out}) == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 60), st.integers(0, 30), st.integers(0, 2**32 - 1))
def test_the_walk_finds_the_nearest_with_ties(k, dims, n, spread, seed):
    rng = np.random.default_rng(seed)
    centres, x = rng.integers(-spread, spread + 1, (k, dims)), rng.integers(-2 * spread, 2 * spread + 1, (n, dims))
    gaps = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    winner, best, measured = C.SortedLists(centres).nearest(x)
    assert (winner == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all() and measured <= n * k


def test_the_walk_measures_few_centroids():
    rng = np.random.default_rng(2)
    centres = rng.integers(-10_000, 10_000, (500, 2))
    x = rng.integers(-10_000, 10_000, (400, 2))
    winner, _, measured = C.SortedLists(centres).nearest(x)
    assert (winner == ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all() and measured < 0.2 * 400 * 500
