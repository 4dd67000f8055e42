import itertools
import random
import re

from gantline.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), (least.get(find(i)) if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def make_rows(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 40)))) for i in range(40)]
    return rows


def test_components_agree_with_brute_force(spark, documents):
    rows = make_rows()
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (906, "a b c d e"), (907, "A B C\x0bd e"), (907, "A B C\x0bd e"), (None, "one two"), (None, "alone here now"), (908, "x\xa0y z q r s")]
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(documents(rows)).collect()), key=str)
    assert out == brute(rows)


def test_a_large_group_of_near_copies(spark, documents):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(250):
        copy = list(base)
        copy[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(copy)))
    out = jaccard_join.link(documents(rows)).collect()
    assert {r["component_id"] for r in out} == {0} and len(out) == 250


def test_a_crowd_about_the_threshold(spark, documents):
    """Near copies of which few pairs are similar enough: their tokens are crowded, so sketches decide who meets."""
    rng = random.Random(2)
    base, rows = [f"b{i}" for i in range(110)], []
    for k in range(90):
        copy = list(base)
        for at in rng.sample(range(110), rng.randint(1, 4)):
            copy[at] = f"n{k}-{at}"
        rows.append((k, " ".join(copy)))
    for lot in (jaccard_join.LOT, 7):  # in lots of 7, the crowd is dealt to a dozen
        out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(documents(rows), lot).collect()), key=str)
        assert out == brute(rows)


def test_rows_meet_once_whatever_the_lots(spark):
    rng = random.Random(6)
    rows = [(t, n, rng.getrandbits(60) - (1 << 59)) for t, n in ((1, 40), (2, 3), (3, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "token long, classes long, cls long")
    want = sorted((t, *sorted(p)) for t in (1, 2, 3) for p in itertools.combinations([r[2] for r in rows if r[0] == t], 2))
    for lot in (1, 5, 100):
        assert sorted(map(tuple, jaccard_join.meeting(df, df, lot).select("token", "cls_a", "cls_b").collect())) == want


def test_long_text_and_empty_table(spark, documents):
    long = " ".join(f"l{i % 5000}" for i in range(600_000))
    out = {r["doc_id"]: r for r in jaccard_join.link(documents([(1, long), (2, long + " end"), (3, "other words are in this one")])).collect()}
    assert out[2]["component_id"] == 1 and out[1]["n_shingles"] == 5000 and out[3]["component_id"] == 3
    assert jaccard_join.link(documents([(1, "x")]).limit(0)).count() == 0


def test_prefixes_of_similar_sets_share_enough():
    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, 1 << 8).astype(np.int32)
    for _ in range(400):
        common = rng.integers(0, 1 << 63, rng.integers(3, 60)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(2))
        if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
            continue
        (p, m), (q, n) = (jaccard_join.prefix(x, counts, 8) for x in (a, b))
        assert len(np.intersect1d(p, q)) >= min(m, n)
        # In the prefixes that the two sizes need, too; and sketches differ in no more cells than the sets in tokens.
        need, least = -(-75 * (len(a) + len(b)) // 175), min(m, n)
        assert len(np.intersect1d(p[: len(a) - need + least], q[: len(b) - need + least])) >= least
        differ = sum(int(x).bit_count() for x in (jaccard_join.sketch_of(a) ^ jaccard_join.sketch_of(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b)) <= len(a) + len(b) - 2 * need


def test_one_of_each_stays(spark, documents):
    rows = make_rows(7) + [(800, None), (801, " "), (802, "same text twice here now"), (802, "same text twice here now")]
    docs = documents(rows)
    kept = sorted(r["doc_id"] for r in jaccard_join.keep_one(docs).collect())
    want = sorted({c for _, n, c in brute(rows) if n} | {800, 801})
    assert kept == want and jaccard_join.keep_one(docs).columns == docs.columns
