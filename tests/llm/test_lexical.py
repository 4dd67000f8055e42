import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from gantline.llm import lexical as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, items, top=10):
    bags = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in docs]
    bags = [(i, len(w), Counter(w)) for i, w in bags if w]
    count, length, df = len(bags), sum(n for _, n, _ in bags), Counter(t for _, _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, n, bag in bags:
            m = 10 + 90 * n * count // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(WORD.findall((text or "").translate(LOWER))) if bag[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], "doc_id long, text string, item_id string, score string, n string").repartition(4)
    return d, spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, doc_id string, terms string")


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "über", "漢字", "ÀB", "x1"]
    return [(i, rng.choice([" ", ", ", "\x00", "-"]).join(rng.choice(words[: rng.choice([5, 65])]) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def test_ranks_agree_with_brute_force_and_sql(spark):
    docs = corpus(300, 4)
    docs += [docs[7]] * 15 + [(1000 + i, "W1 w2 rare") for i in range(40)] + [(None, "w1 w2 rare"), (None, None), (2000, None), (2001, ""), (2002, " .,;[]"), (2003, "w3 " * 50_000 + "rare")]
    items = [(i, t) for i, t in corpus(30, 9)] + [(100, "rare W1"), (100, "rare W1"), (100, "w60 Été"), (101, None), (102, ""), (103, "unheardof"), (None, "rare"), (104, "w1 " * 30_000 + "漢字")]
    d, i = tables(spark, docs, items)
    want = by_hand(docs, items)
    assert got(L.search(d, i)) == want
    assert got(L.search(d, i, block_terms=40)) == want  # items in many blocks
    documents, benchmark = d.select("doc_id", "text").toArrow(), i.select("item_id", "text").toArrow()  # noqa: F841
    plain = [r for r in items if "\x00" not in (r[1] or "")]
    assert len(plain) > 20
    assert sorted(duckdb.sql(L.SQL).fetchall(), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    some, none = [(1, "a b")], []
    for docs, items in ((none, some), (some, none), (none, none), ([(1, None)], some)):
        assert got(L.search(*tables(spark, docs, items))) == []


def test_a_tiles_scores_are_exact(monkeypatch):
    monkeypatch.setattr(L, "SLAB", 7)
    rng = np.random.default_rng(0)
    weights = rng.integers(1, 50_000, 40)
    rows = [sorted(rng.choice(40, 25, replace=False).tolist()) for _ in range(9)]
    tile = L.Tile(rows, weights)
    dense = np.where(rng.random((40, 13)) < 0.4, rng.integers(1, 1_000_000, (40, 13)), 0)
    term, document = np.nonzero(dense)
    want = [[sum(int(weights[t]) * int(dense[t, d]) for t in r) for d in range(13)] for r in rows]
    assert tile.scores(document, term, dense[term, document], 13).tolist() == want


def test_bounds_keep_sums_of_a_slab_exact():
    most_weight = L.weight(1 << 62, 0)
    most_impact = int(L.impact(np.array([9_000_000_000]), np.array([10]))[0])
    assert most_weight < 1 << 16 and most_impact < 1 << 20
    assert L.SLAB * most_weight * most_impact < 1 << 53
