"""Connected components and one-to-one assignment by DataFrame rounds; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_M, haversine
from ..sources.scratch import Scratch


#: Edges for each node up to which labels travel along all of them.
FEW_EDGES = 4


def components(edges: DataFrame, scratch: Scratch, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) from edges (a, b): the smallest node that edges reach.

    Where there are many edges for each node, labels travel first along two edges of a node only, to its smallest and its largest neighbour. All edges are then read once more: what
    still joins two components is a graph of components, with fewer than half the nodes, and goes the same way.
    """
    whole = scratch.put(edges.select("a", "b"), "edges")
    end = lambda n, other: whole.groupBy(F.col(n).alias("node")).agg(F.min(other).alias("lo"), F.max(other).alias("hi"))
    ends = end("a", "b").unionByName(end("b", "a")).groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = scratch.put(ends, "ends")
    turned = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if whole.count() <= few * ends.count():
        return spread(scratch.put(turned(whole).distinct(), "both"), scratch)
    two = ends.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b"))
    labels = spread(scratch.put(turned(two).distinct(), "both"), scratch)
    of = lambda n: labels.select(F.col("node").alias(n), F.col("component").alias(f"_{n}"))
    apart = whole.join(of("a"), "a").select("b", "_a").join(of("b"), "b").filter("_a <> _b")
    rest = scratch.put(apart.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "rest")
    if not rest.limit(1).count():
        return labels
    up = components(rest, scratch, few).select(F.col("node").alias("component"), F.col("component").alias("up"))
    return labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))


def spread(both: DataFrame, scratch: Scratch) -> DataFrame:
    """The components of edges (a, b) that are written both ways.

    A round takes the smallest label among a node and its neighbours, and then that label's own label, so labels
    travel twice as far each round.
    """
    labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("m", "component")).alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("up"))
        best = F.least("next", F.coalesce("up", "next"))
        new = scratch.put(least.join(up, "next", "left").select("node", best.alias("component"), (best != F.col("component")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = new
        if not labels.filter("moved").limit(1).count():
            return labels.select("node", "component")


def greedy_assignment(candidates: DataFrame, scratch: Scratch, order: list[str]) -> DataFrame:
    """One-to-one pairs out of candidates (block, old_id, new_id, *order), as a greedy walk in the order (block aside) picks them.

    A pair that is the best of both its ends is one the walk picks; such pairs are taken and their ends leave,
    until no candidate is left. Under a strict total order this is the walk's result, in a few rounds of windows
    that Spark deals out by block and end.
    """
    keys = [*order, "old_id", "new_id"]
    left = scratch.put(candidates, "candidates")
    picked = []
    while left.limit(1).count():
        rank = lambda end: F.row_number().over(Window.partitionBy("block", end).orderBy(*keys))
        ranked = left.withColumn("_o", rank("old_id")).withColumn("_n", rank("new_id"))
        pairs = scratch.put(ranked.filter("_o = 1 AND _n = 1").drop("_o", "_n"), "pairs")
        picked.append(pairs)
        rest = left.join(pairs.select("block", "old_id"), ["block", "old_id"], "left_anti").join(pairs.select("block", "new_id"), ["block", "new_id"], "left_anti")
        after = scratch.put(rest, "candidates")
        scratch.drop(left)
        left = after
    out = left
    for p in picked:
        out = out.unionByName(p)
    return out


#: Meetings of an item of a set, on average, up to which all are counted.
FEW_MEETINGS = 16


def set_jaccard(sets: DataFrame, least: float, left: str = "old", right: str = "new", scratch: Scratch | None = None, counted: bool | None = None) -> DataFrame:
    """(a, b, both, jaccard) of sets of two sides, from rows (side, name, item), with a similarity of at least ``least`` over 0.

    Items stand rarest first. Of sets that similar the first n - ceil(least * n) + 1 items share one. Either all shared items are
    counted, in one equi-join by item; or only those first items meet and each pair that meets is compared as a whole. Both give the same
    pairs. What they cost is summed up over items beforehand: with a low threshold nearly all items are first ones, and comparing pairs again is waste,
    while with a high one the common items never meet. Where all items together meet few others, they are counted without more ado; ``counted`` takes one of the ways without asking.
    """
    rows = (scratch or Scratch(sets.sparkSession, "jaccard")).put(sets.select("side", "name", "item").repartition("side", "name").distinct().withColumn("size", F.count("*").over(Window.partitionBy("side", "name"))), "sets")
    half = lambda df, side, name, *more: df.filter(F.col("side") == side).select(F.col("name").alias(name), *more)
    sides = lambda df: half(df, left, "a", "item", F.col("size").alias("n_a")).join(half(df, right, "b", "item", F.col("size").alias("n_b")), "item").filter(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    common = rows.groupBy("item").agg(F.count("*").alias("sets"), F.sum((F.col("side") == left).cast("double")).alias("l"), F.sum((F.col("side") == right).cast("double")).alias("r"))
    if counted is None:
        whole, items, most = common.agg(F.sum(F.col("l") * F.col("r")), F.sum(F.col("l") + F.col("r")), F.max(F.greatest("l", "r"))).first()
        counted = not items or whole <= FEW_MEETINGS * items or None
        if counted is None:
            # An item that isn't among a set's first ones spares no more meetings than the item has sets on the other side.
            n_sets, later = rows.agg(F.sum(1 / F.col("size")), F.sum((F.ceil(F.col("size") * least - 1e-9) - 1) / F.col("size"))).first()
            counted = whole <= (whole - later * most) * (1 + items / n_sets) or None
    if not counted:
        place = F.row_number().over(Window.partitionBy("side", "name").orderBy("sets", "item"))
        placed = rows.join(common.select("item", "sets"), "item").withColumn("place", place)
        early = placed.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("side", "name", "item", "size")
        if counted is None:
            of = lambda side: F.sum((F.col("side") == side).cast("double"))
            met = early.groupBy("item").agg((of(left) * of(right)).alias("met")).agg(F.sum("met")).first()[0]
            counted = whole <= met * (1 + items / n_sets)
    if counted:
        both = common_items(half(rows, left, "a", "item", F.col("size").alias("n_a")), half(rows, right, "b", "item", F.col("size").alias("n_b")), least)
    else:
        met = sides(early).select("a", "b", "n_a", "n_b").distinct()
        whole = rows.groupBy("side", "name").agg(F.collect_list("item").alias("items"))
        both = met.join(half(whole, left, "a", F.col("items").alias("_a")), "a").join(half(whole, right, "b", F.col("items").alias("_b")), "b")
        both = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("_a", "_b")).cast("long").alias("both")).filter("both > 0")
    jaccard = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return both.select("a", "b", "both", jaccard.alias("jaccard")).filter(F.col("jaccard") >= least - 1e-12)


#: Names that a list of an item's sets may hold, and items of a set that meet their lists in one task.
LIST, TASK_ITEMS = 1024, 100_000


def common_items(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, n_a, n_b, both): how many items sets have in common, from rows (a, item, n_a) and (b, item, n_b), where their sizes allow a similarity of ``least``.

    An item's sets of the other side travel as lists to each set that has it, not as a row for each meeting, and are counted where they arrive; the items of very large sets are counted in pieces.
    """
    numbered = b.withColumn("_list", F.floor((F.row_number().over(Window.partitionBy("item").orderBy("b")) - 1) / LIST))
    lists = numbered.groupBy("item", "_list").agg(F.collect_list(F.struct("b", "n_b")).alias("m"))
    lists = lists.select("item", F.transform("m", lambda x: x["b"]).alias("b"), F.transform("m", lambda x: x["n_b"]).alias("n_b"))  # two plain arrays are a third of one of structs
    piece = F.pmod(F.xxhash64("item"), F.ceil(F.col("n_a") / TASK_ITEMS)).cast("int")
    met = a.withColumn("_piece", piece).join(lists, "item").select("a", "n_a", "_piece", "b", "n_b").repartition("a", "_piece").select("a", "n_a", "_piece", F.inline(F.arrays_zip("b", "n_b")))
    met = met.filter(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    found = met.groupBy("a", "_piece", "b", "n_a", "n_b").agg(F.count("*").alias("both"))
    if (a.agg(F.max("n_a")).first()[0] or 0) > TASK_ITEMS:
        return found.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    return found.drop("_piece")


def similar_sets(sets: DataFrame, least: float, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, both, jaccard) with a < b, of sets (name, item) of one kind."""
    twice = sets.select(F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side"), "name", "item")
    return set_jaccard(twice, least, scratch=scratch).filter("a < b")


def walk(claims: DataFrame, scratch: Scratch, order: list[str], prefer: list[Column]) -> DataFrame:
    """(old_id, new_id): each old id's first claim, as a walk over old ids in ``order`` picks it: what no old id has picked yet comes before the
    rest where ``prefer`` ties.

    claims is (old_id, new_id, *) where order names columns of the old id. In a round all old ids pick of which no earlier old id with a
    common claim is left; what such ids have picked is all that the walk knows of when it comes to them.
    """
    left = scratch.put(claims.withColumn("_taken", F.lit(False)), "claims")
    picked = []
    while left.limit(1).count():
        turn = F.row_number().over(Window.partitionBy("new_id").orderBy(*order, "old_id"))
        ready = F.max("_turn").over(Window.partitionBy("old_id")) == 1
        place = F.row_number().over(Window.partitionBy("old_id").orderBy(*prefer, "_taken", "new_id"))
        first = left.withColumn("_turn", turn).withColumn("_ready", ready).filter("_ready").withColumn("_place", place).filter("_place = 1")
        now = scratch.put(first.select("old_id", "new_id"), "picked")
        picked.append(now)
        rest = left.join(now.select("old_id"), "old_id", "left_anti").join(now.select("new_id", F.lit(True).alias("_now")), "new_id", "left")
        after = scratch.put(rest.withColumn("_taken", F.col("_taken") | F.coalesce("_now", F.lit(False))).drop("_now"), "claims")
        scratch.drop(left)
        left = after
    out = left.select("old_id", "new_id")
    for p in picked:
        out = out.unionByName(p)
    return out


def grid_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of points (lat, lon and lat2, lon2) whose grid cells touch: each left point goes to nine cells, then an equi-join."""
    floor = lambda c: F.floor(F.col(c) / cell).cast("long")
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = left.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)).withColumn("_y", floor("lat") + F.col("_dy")).withColumn("_x", floor("lon") + F.col("_dx")).drop("_dy", "_dx")
    return spread.join(right.withColumn("_y", floor("lat2")).withColumn("_x", floor("lon2")), ["_y", "_x"]).drop("_y", "_x")


#: Points of one place that travel as one list, and pairs that a task makes.
PLACE_LIST, TASK_PAIRS = 1000, 5_000_000


def near_pairs(left: DataFrame, right: DataFrame, cell: float, radius: float, scratch: Scratch) -> DataFrame:
    """(a, b, metres) of points (a, lat, lon) and (b, lat2, lon2) whose grid cells touch and that lie within ``radius`` metres.

    Distances are measured once for each two places, however many points share them. Points of a place travel as lists; pairs of lists are dealt to tasks by how many pairs
    of points they make, which is as many as there are results.
    """

    def lists(points: DataFrame, key: str, at: list[str]) -> DataFrame:
        counts = points.groupBy(*at).agg(F.count("*").alias("_n"))
        part = F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / PLACE_LIST))
        return scratch.put(points.join(counts, at).groupBy(*at, part.alias("_part")).agg(F.collect_list(key).alias(f"_{key}")), f"places-{key}")

    of_a, of_b = lists(left.select("a", "lat", "lon"), "a", ["lat", "lon"]), lists(right.select("b", "lat2", "lon2"), "b", ["lat2", "lon2"])
    met = grid_join(of_a.select("lat", "lon").distinct(), of_b.select("lat2", "lon2").distinct(), cell)
    near = met.withColumn("metres", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).filter(F.col("metres") <= radius)
    pairs = scratch.put(near.join(of_a.drop("_part"), ["lat", "lon"]).join(of_b.drop("_part"), ["lat2", "lon2"]).select("_a", "_b", "metres"), "near")
    made = pairs.agg(F.sum(F.size("_a").cast("long") * F.size("_b"))).first()[0] or 0
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-made // TASK_PAIRS))
    return pairs.repartition(parts).select(F.explode("_a").alias("a"), "_b", "metres").select("a", F.explode("_b").alias("b"), "metres")


def date_runs(dates: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """Runs of consecutive days (start, end, days) of each group, broken at year ends."""
    w = Window.partitionBy(*by, F.year(day)).orderBy(day)
    numbered = dates.select(*by, day).distinct().withColumn("_run", F.date_sub(F.col(day), F.row_number().over(w)))
    grouped = numbered.groupBy(*by, F.year(day).alias("_year"), "_run").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("days"))
    return grouped.drop("_year", "_run")


def leaders(points: DataFrame, radius: float, scratch: Scratch) -> DataFrame:
    """(grp, ord, leader) of points (grp, ord, lat, lon): in the order of ``ord``, a point joins the first leader of its group within ``radius`` metres, or becomes one.

    Points lie in cubes of the radius' size, so that what is near lies in the same cube or one beside it. In a round the first open point of a cube leads if the first ones of all
    cubes beside it come later; then all open points near a new leader are settled. Leaders stand apart, so each point meets few of them.
    """
    lat, lon = F.radians("lat"), F.radians("lon")
    at = {"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)}
    cubes = ["grp", *at]
    left = scratch.put(points.select("grp", "ord", "lat", "lon", *[F.floor(v * EARTH_M / radius).alias(k) for k, v in at.items()]), "points")
    whole, found = left, None
    step = F.array(*map(F.lit, (-1, 0, 1)))

    def around(rows: DataFrame) -> DataFrame:
        """Each row in its own cube and those beside it."""
        for k in at:
            rows = rows.withColumn("_d", F.explode(step)).withColumn(k, F.col(k) + F.col("_d")).drop("_d")
        return rows

    near = lambda heads: around(heads.select("grp", *at, F.col("ord").alias("leader"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")))
    within = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= radius
    while left.limit(1).count():
        first = left.groupBy(*cubes).agg(F.min("ord").alias("ord"))
        least = around(first).groupBy(*cubes).agg(F.min("ord").alias("least"))
        heads = first.join(least, cubes).filter("ord = least").select(*cubes, "ord").join(left.select("grp", "ord", "lat", "lon"), ["grp", "ord"])
        heads = scratch.put(heads, "leaders")
        found = heads if found is None else found.unionByName(heads)
        settled = left.join(near(heads), cubes).filter(within).select("grp", "ord").distinct()
        after = scratch.put(left.join(settled, ["grp", "ord"], "left_anti"), "points")
        if left is not whole:
            scratch.drop(left)
        left = after
    if found is None:
        return points.select("grp", "ord", F.col("ord").alias("leader"))
    return whole.join(near(found), cubes).filter(within).groupBy("grp", "ord").agg(F.min("leader").alias("leader"))
