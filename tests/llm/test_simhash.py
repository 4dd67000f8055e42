import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gantline.llm import simhash as S
from gantline.sources.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(codes):
    """The smallest place that links reach, of each code."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    whole = np.array(codes, np.uint64)
    for i in range(len(codes)):
        for j in (np.nonzero(np.bitwise_count(whole[i + 1 :] ^ whole[i]) <= 3)[0] + i + 1).tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(codes))]


def near_codes(rng, n, balls=4, flips=6):
    centres = [rng.getrandbits(64) for _ in range(balls)]
    out = set()
    while len(out) < n:
        code = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, flips)):
            code ^= 1 << rng.randrange(64)
        out.add(code)
    return sorted(out, key=lambda _: rng.random())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abAB \n\t\x0b."), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_fingerprints(text):
    assert S.fingerprint(text.encode()) == fingerprint_by_hand(text)


def test_long_and_short_texts():
    rng = random.Random(2)
    words = ["One", "two", "Été", "drei", "x" * 50]
    long = " ".join(rng.choice(words) for _ in range(S.COUNTED + 77))
    for text in (long, "", None, " \n ", "One", "one two", "one two three", "a\xa0b c d"):
        assert S.fingerprint(text.encode() if text is not None else None) == fingerprint_by_hand(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 5), st.integers(0, 2**32))
def test_the_tree_finds_all_near_codes_of_each_group(n, groups, seed):
    rng = random.Random(seed)
    code = np.array(near_codes(rng, n), np.uint64)
    group = np.array([rng.randrange(groups) for _ in range(n)])
    index = S.GrayIndex(group, code)
    a, b = index.near(0, n)
    where = dict(zip(index.order.tolist(), range(n), strict=True))
    want = {tuple(sorted((where[i], where[j]))) for i in range(n) for j in range(i) if group[i] == group[j] and int(code[i] ^ code[j]).bit_count() <= 3}
    found = list(zip(a.tolist(), b.tolist(), strict=True))
    assert len(found) == len(set(found)) and set(found) == want


def test_gray_ranks():
    rng = random.Random(1)
    ranks = [0, 1, 2, 3, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(50)]
    codes = np.array([r ^ (r >> 1) for r in ranks], np.uint64)
    assert S.gray_rank(codes).tolist() == ranks


def test_any_two_near_codes_share_a_group():
    rng = random.Random(6)
    for n in (10, S.FOUR_PARTS + 1, S.FIVE_PARTS + 1):
        masks = S.group_masks(n)
        for _ in range(300):
            differ = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & differ == 0 for m in masks)
    assert [len(S.group_masks(n)) for n in (10, S.FOUR_PARTS + 1, S.FIVE_PARTS + 1)] == [4, 10, 20]


@pytest.mark.parametrize("leaf,parts", [(4096, 4), (16, 4), (50, 5)])
def test_links_join_what_near_codes_reach(spark, monkeypatch, leaf, parts):
    if parts == 5:
        monkeypatch.setattr(S, "FOUR_PARTS", 10)
    rng = random.Random(leaf)
    codes = near_codes(rng, 1500)
    prints = spark.createDataFrame([(S.signed(c),) for c in codes], "fp long")
    found = S.links(prints, Scratch(spark, "test"), leaf).collect()
    place = {S.signed(c): i for i, c in enumerate(codes)}
    assert all(((r["a"] ^ r["b"]) != 0) for r in found) and len(found) < 10 * len(codes)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = sorted((find(place[r["a"]]), find(place[r["b"]])))
        root[b] = a
    assert [find(i) for i in range(len(codes))] == components_by_hand(codes)


def test_documents_whole(spark, documents):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 4)):
            rows.append((rng.randrange(10**6), " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(5, None), (4, ""), (3, " \n"), (None, "alone in the world"), (None, rows[0][1]), rows[1], rows[1], (8, "WORD " * 90_000)]
    got = S.link(documents(rows)).collect()
    assert got[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"} and len(got) == len(rows)
    codes = [fingerprint_by_hand(t) for _, t in rows]
    reach = components_by_hand(codes)
    least = {}
    for (i, _), r in zip(rows, reach, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{c:016x}", least[r]) for (i, _), c, r in zip(rows, codes, reach, strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert S.link(documents([])).count() == 0
