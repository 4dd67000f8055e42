import numpy as np

from gantline.llm import neighbours as N


def brute(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).round(3).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]  # equal vectors
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string")
    found = {}
    for r in sorted(N.nearest(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute([(i, np.float32(v).tolist()) for i, v in rows], 50, 5)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    for q, got in found.items():
        assert len(got) == 5 and q not in [i for i, _ in got] and got == sorted(got, key=lambda x: (-x[1], x[0]))


def test_several_shards_and_blocks(spark):
    from gantline.llm.common import Scratch

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    scratch = Scratch(spark, "test")
    listed = scratch.put(N.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "v")
    graph = N.index(listed, scratch, 4, shard_rows=150)
    out = N.search(graph, listed.filter("vec_id % 20 = 0"), 3, query_rows=10).collect()
    want = brute(rows, 20, 3)
    assert sum(r["vec_id"] in [i for i, _ in want[r["query_id"]]] for r in out) >= 0.95 * 90 and len(out) == 90


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, [1.0, 1.0]), (7, [None, 1.0]), (50, [2.0, 0.0]), (8, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in N.nearest(df).collect())
    assert out == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert N.nearest(df.limit(0)).count() == 0


def test_near_and_scaled_copies_are_told_apart_in_double_precision(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    rows += [(1000 + i, (base + rng.normal(size=16) * 1e-6).tolist()) for i in range(40)]  # float32 can't order these
    rows += [(2000 + i, (base * 2.0**i).tolist()) for i in range(12)]
    found = {}
    for r in N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = brute(rows, 50, 5)
    for q in (1000, 2000):
        assert [found[q][k] for k in range(1, 6)] == [i for i, _ in want[q]]


def test_groups_larger_than_the_beam(spark):
    """Near copies at three scales of noise and scaled ones, over several shards; a query in each."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=64)) for i in range(1, 2000) if i % 50]
    for g, (size, noise) in enumerate([(300, 1e-2), (300, 1e-4), (300, 1e-6), (300, 1e-9), (5000, 1e-4), (5000, 1e-7)]):
        base = rng.normal(size=64)
        rows += [((g + 1) * 10_000 + i, base + noise * rng.normal(size=64)) for i in range(size) if i % 500 == 0 or i % 50]
    base = rng.normal(size=64)
    scaled = [(100_000 + i, base * rng.uniform(0.3, 3)) for i in range(1200) if i % 300 == 0 or i % 50]
    rows += scaled
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for r in N.nearest(df).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids, whole = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = {}
    for q, v in rows:
        if q % 50 == 0:
            scores = N.cosine(np.broadcast_to(v, whole.shape), whole)
            order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:5]
            if q >= 100_000:
                assert [found[q][k] for k in range(1, 6)] == [(ids[k], scores[k]) for k in order]
            hits.setdefault(q // 10_000, []).append(len({int(ids[k]) for k in order} & {x for x, _ in found[q].values()}) / 5)
    assert min(np.mean(h) for h in hits.values()) >= 0.95, {g: np.mean(h) for g, h in hits.items()}
