import random
from collections import defaultdict

from gantline.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in stopped]
        if not left:
            break
        level = (total - sum(most * sizes[s] for s in stopped)) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > most * sizes[s]}
        if not over:
            break
        stopped |= over
    return {s: most * sizes[s] if s in stopped else weight[s] * level for s in names}


def make_rows(seed=2):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([1, 2, 3, 5, 8, 40, 300]), None, rng.choice(["a", "a", "a", "a", "b", "c", "é", None])) for i in range(500)]
    return rows + [(900, None, None, "a"), (901, "", None, "tiny"), (902, "one", None, "tiny"), (903, "x " * 90_000, None, "long"), (904, "same", None, "c"), (904, "same", None, "c"), (None, "none here", None, "c")]


def test_targets_and_takings(spark, documents):
    rows = make_rows()
    out = mixing.mix(documents(rows)).collect()
    assert len(out) == len(rows)
    sizes, taken, least = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        if r["size"]:
            least[r["source"]] = min(least.get(r["source"], r["size"]), r["size"])
    want = targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s], least.get(s, 0) if s != "long" else 45_000), (s, taken[s], want[s])
    again = mixing.mix(documents(rows).repartition(3)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(out) == key(again)


def test_rates_tilt_exponentially(spark, documents):
    import math

    out = [r for r in mixing.mix(documents(make_rows())).collect() if r["source"] == "a" and r["size"] and r["rate"] < 3]
    slopes = {round(math.log(r["rate"]) / r["size"], 9) for r in out}
    assert max(slopes) - min(slopes) < 1e-6


def test_documents_are_taken_as_often_as_told(spark, documents):
    docs = documents(make_rows())
    told = defaultdict(int)
    for r in mixing.mix(docs).collect():
        told[(r["doc_id"], r["source"])] += r["copies"]
    got = defaultdict(int)
    taken = mixing.take(docs)
    for r in taken.select("doc_id", "source").collect():
        got[(r["doc_id"], r["source"])] += 1
    assert {k: v for k, v in told.items() if v} == got and taken.columns == docs.columns


def test_empty_table(spark, documents):
    assert mixing.mix(documents([(1, "x")]).limit(0)).count() == 0


def test_repeated_ids_take_the_same_texts_again(spark, documents):
    rows = [(i % 3 if i % 4 else None, f"text number {i} " + "w " * (i % 5), None, "ab"[i % 2]) for i in range(200)]  # few ids, many texts, many of one size
    told = [sorted(str(r["text"]) for r in mixing.take(documents(random.Random(seed).sample(rows, len(rows))).repartition(3 + seed)).select("text").collect()) for seed in (1, 2)]
    assert told[0] == told[1] and len(told[0]) > 50


def test_rates_solve_the_dual(spark, documents):
    """A second solution: bisection in plain Python on the words that one multiplier gives a source; rates of the operator are its, within the half word that it stops at."""
    import math

    out = mixing.mix(documents(make_rows(7))).collect()
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append((r["size"], r["rate"]))
    want = targets({s: sum(size for size, _ in rows) for s, rows in by.items()})
    for source, rows in by.items():
        total, mean = sum(size for size, _ in rows), sum(size for size, _ in rows) / len(rows)
        if not total:
            continue
        words = lambda lam, rows=rows, mean=mean: sum(size * min(3.0, math.exp(max(-700.0, min(700.0, lam * size / mean)))) for size, _ in rows)
        lo, hi = -1e6, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < want[source] else (lo, mid)
        assert abs(sum(size * rate for size, rate in rows) - want[source]) <= 0.51
        inside = [(size, math.log(rate)) for size, rate in rows if size and 1e-300 < rate < 3]
        slopes = [log / size for size, log in inside]
        assert not slopes or max(slopes) - min(slopes) <= 1e-9 * max(1.0, max(map(abs, slopes)))
        exact = {size: min(3.0, math.exp(max(-700.0, min(700.0, lo * size / mean)))) for size, _ in rows}
        assert sum(size * abs(rate - exact[size]) for size, rate in rows) <= 0.6  # all move the same way with the multiplier
