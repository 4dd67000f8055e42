"""What keeps work in step with the input: each way against the plain one on small data."""

import random

from pyspark.sql import functions as F

from gantline.functions.axis import stop_axis
from gantline.operators import graphs, groups
from gantline.plans import pages, sheets
from gantline.sources.scratch import Scratch


def test_folds_cut_groups_from_batches(spark):
    """groups that batches cut, and more groups than a batch gives back."""
    data = [(None if g % 900 == 0 else f"g{g}", [f"s{(g * k) % 5}" for k in range(n)]) for g in range(2500) for n in range(3)]
    df = spark.createDataFrame(data, "g string, seq array<string>")
    of = {}
    for g, s in data:
        of.setdefault(g, set()).add(tuple(s))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = pages.axes(df, ["g"])
        got = [(r["g"], tuple(r["axis"])) for r in found.collect()]
        counts = groups.folded(df, ["g"], lambda rows: [(len(rows),)], "n long").agg(F.sum("n")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(((g, stop_axis(q)) for g, q in of.items()), key=str) and counts == len(data)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # no data frame for each group


def test_columns_are_made_once(spark):
    """the columns of a timetable go through one fold, which gives them back with their places, instead of being made twice and joined."""
    t = ["08:00:00", "09:00:00"]
    df = spark.createDataFrame([("p", f"o{i}", f"n{i}", ["A", "B"], ["A", "B"], t, t) for i in range(3)], "page string, old_id string, new_id string, old_seq array<string>, new_seq array<string>, old_times array<string>, new_times array<string>")
    found = sheets.timetables(df, ["page"], 1.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "FlatMapGroups" not in plan
    assert [(r["number"], r["old_id"], r["old_times"], r["changed"]) for r in found.orderBy("number").collect()] == [(i, f"o{i}", t, []) for i in range(3)]


def test_pairs_of_near_points(spark):
    """F8: many points on few places, the same pairs as by measuring all."""
    rng = random.Random(8)
    at = [(35 + rng.randrange(60) / 10000, 139 + rng.randrange(60) / 10000) for _ in range(25)]
    points = [(i, *rng.choice(at[:3] if i % 2 else at)) for i in range(300)]
    left = spark.createDataFrame([p for p in points if p[0] % 3], "a long, lat double, lon double")
    right = spark.createDataFrame([p for p in points if p[0] % 3 == 0], "b long, lat2 double, lon2 double")
    metres = graphs.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    cell = 300 / 111000.0
    touch = lambda x, y: F.abs(F.floor(F.col(x) / cell) - F.floor(F.col(y) / cell)) <= 1
    want = left.crossJoin(right).withColumn("m", metres).filter((F.col("m") <= 300) & touch("lat", "lat2") & touch("lon", "lon2"))
    want = sorted((r["a"], r["b"], round(r["m"], 6)) for r in want.collect())
    list_, task = graphs.PLACE_LIST, graphs.TASK_PAIRS
    graphs.PLACE_LIST, graphs.TASK_PAIRS = 7, 100
    try:
        found = graphs.near_pairs(left, right, cell, 300, Scratch(spark, "t"))
        assert found.rdd.getNumPartitions() >= len(want) // 100 > 4
        assert sorted((r["a"], r["b"], round(r["metres"], 6)) for r in found.collect()) == want
    finally:
        graphs.PLACE_LIST, graphs.TASK_PAIRS = list_, task


def test_components_by_two_edges_a_node(spark):
    """dense and sparse graphs, labels along two edges of a node, then along what is left."""
    rng = random.Random(9)
    for n, m in ((60, 40), (60, 400), (200, 260)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [(f"x{i}", f"x{j}") for i in range(8) for j in range(8)] + [("x7", "y0"), ("y0", "y1"), ("z", "z")]
        of = {x: x for e in edges for x in e}
        for _ in edges:
            for a, b in edges:
                of[a] = of[b] = min(of[a], of[b])
        df = spark.createDataFrame(edges, "a string, b string")
        for few in (0, graphs.FEW_EDGES):
            assert {r["node"]: r["component"] for r in graphs.components(df, Scratch(spark, "t"), few).collect()} == of


def test_items_in_common_by_lists(spark):
    """lists of an item's sets, longer than a list may be, and sets in pieces."""
    rng = random.Random(10)
    sets = {(side, n): {rng.choice(range(30)) for _ in range(rng.randint(1, 12))} | {99} for side in ("old", "new") for n in range(40)}
    df = spark.createDataFrame([(*k, i) for k, v in sets.items() for i in v], "side string, name long, item int")
    want = sorted((a[1], b[1], len(x & y)) for a, x in sets.items() for b, y in sets.items() if a[0] == "old" and b[0] == "new" and len(x & y) / len(x | y) >= 0.05 - 1e-12)
    most = graphs.LIST, graphs.TASK_ITEMS
    graphs.LIST, graphs.TASK_ITEMS = 3, 4
    try:
        for counted in (True, None):
            assert sorted((r["a"], r["b"], r["both"]) for r in graphs.set_jaccard(df, 0.05, counted=counted).collect()) == want
    finally:
        graphs.LIST, graphs.TASK_ITEMS = most


def test_systems_alike_on_small_and_large_pages(spark):
    """the pairs of pages that are joined by page, and of those that meet by rare stops."""
    rng = random.Random(11)
    data = [(f"p{p}", f"p{p}\x1fs{s}", [rng.choice("ABCDEFG") for _ in range(rng.randint(1, 7))]) for p in range(6) for s in range(3 + 4 * p)]
    df = spark.createDataFrame(data, "page string, node string, stops array<string>")
    want = []
    for p, a, x in data:
        for q, b, y in data:
            both = len(set(x) & set(y))
            if p == q and a < b and both >= 3 and both / len(set(x) | set(y)) >= 0.6 - 1e-12:
                want.append((a, b, x, y))
    for few in (0, 10, 200):
        got = pages.alike(df, 0.6, 3, Scratch(spark, "t"), few).collect()
        assert sorted((r["a"], r["b"], r["stops_a"], r["stops_b"]) for r in got) == sorted(want)
