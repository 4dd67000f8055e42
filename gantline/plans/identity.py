"""What is the same in two generations: stops, route families, stop patterns, whatever their ids.

Each function takes a feed or tables with the columns it names and returns DataFrames; names are compared by
Python helpers on distinct values only.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import EARTH_M, haversine
from ..functions.sequences import lcs_length, order_share
from ..operators.graphs import components, grid_join, leaders, set_jaccard, walk
from ..sources.feed import Feed
from ..sources.scratch import Scratch

NAME, CONTENT, CANDIDATE = "name_exact", "content", "candidate"


def column(feed: Feed, table: str, name: str):
    return F.col(name) if name in feed.columns(table) else F.lit("").alias(name)


def route_families(feed: Feed) -> DataFrame:
    """(route_id, family): routes with one display name are a family; short name, else long name, else id."""
    names = [F.nullif(F.trim(column(feed, "routes", c)), F.lit("")) for c in ("route_short_name", "route_long_name")]
    return feed.table("routes").select("route_id", F.coalesce(*names, F.trim("route_id")).alias("family")).dropDuplicates(["route_id"])


#: Places of one base name that one task looks through; more of them are looked through in rounds of joins.
PLACES = 1000


def near_leaders(stops: DataFrame, radius: float, scratch: Scratch, places: int = PLACES) -> DataFrame:
    """(base_name, stop_id, number, leader_id, leader_line) of stops (base_name, stop_id, _line, lat, lon): stops of a base name join, in id order, the first
    cluster whose first stop is within the radius; clusters are numbered in that order. Stops of one place are one."""
    order = F.struct("stop_id", "_line")
    spots = scratch.put(stops.groupBy("base_name", "lat", "lon").agg(F.min(order).alias("ord")), "places")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["stop_id", "_line"], ignore_index=True)
        heads: list[int] = []
        of = np.zeros(len(pdf), int)
        lat, lon = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
        for i in range(len(pdf)):
            h = np.array(heads, int)
            a = np.sin((lat[h] - lat[i]) / 2) ** 2 + np.cos(lat[h]) * np.cos(lat[i]) * np.sin((lon[h] - lon[i]) / 2) ** 2
            near = np.flatnonzero(2 * EARTH_M * np.arcsin(np.sqrt(a)) <= radius)
            of[i] = h[near[0]] if len(near) else i
            if not len(near):
                heads.append(i)
        return pd.DataFrame({"base_name": pdf["base_name"], "stop_id": pdf["stop_id"], "_line": pdf["_line"], "leader_id": pdf["stop_id"].to_numpy()[of], "leader_line": pdf["_line"].to_numpy()[of]})

    crowded = spots.groupBy("base_name").count().filter(F.col("count") > places).select("base_name")
    few = spots.join(crowded, "base_name", "left_anti").select("base_name", "lat", "lon", "ord.stop_id", "ord._line")
    led = few.groupBy("base_name").applyInPandas(gather, "base_name string, stop_id string, _line long, leader_id string, leader_line long")
    led = led.select("base_name", F.struct("stop_id", "_line").alias("ord"), F.struct(F.col("leader_id").alias("stop_id"), F.col("leader_line").alias("_line")).alias("leader"))
    if crowded.limit(1).count():
        many = leaders(spots.join(crowded, "base_name").select(F.col("base_name").alias("grp"), "ord", "lat", "lon"), radius, scratch)
        led = led.unionByName(many.select(F.col("grp").alias("base_name"), "ord", "leader"))
    led = scratch.put(led, "led")
    number = F.row_number().over(Window.partitionBy("base_name").orderBy("leader")) - 1
    numbered = led.select("base_name", "leader").distinct().withColumn("number", number)
    of = spots.join(led, ["base_name", "ord"]).join(numbered, ["base_name", "leader"]).select("base_name", "lat", "lon", "number", F.col("leader.stop_id").alias("leader_id"), F.col("leader._line").alias("leader_line"))
    return stops.select("base_name", "stop_id", "lat", "lon").join(of, ["base_name", "lat", "lon"]).select("base_name", "stop_id", "number", "leader_id", "leader_line")


def stop_clusters(feed: Feed, families: DataFrame, radius: float, scratch: Scratch | None = None) -> DataFrame:
    """(cluster_id, name, base_name, lat, lon, platforms, families): stations with their platforms, and stops of one base name near each other, as ``near_leaders`` gathers them."""

    @F.pandas_udf("string")
    def base(names: pd.Series) -> pd.Series:
        return names.map(T.base_name)

    stops = feed.table("stops").select(
        "stop_id", "stop_name", F.coalesce(F.col("stop_lat").try_cast("double"), F.lit(0.0)).alias("lat"), F.coalesce(F.col("stop_lon").try_cast("double"), F.lit(0.0)).alias("lon"),
        F.trim(column(feed, "stops", "location_type")).alias("kind"), F.trim(column(feed, "stops", "parent_station")).alias("parent"), "_line",
    )
    names = stops.select("stop_name").distinct().withColumn("base_name", base("stop_name"))
    stops = stops.join(names, "stop_name")
    stations = stops.filter("kind = '1'").select(F.col("stop_id").alias("parent"), F.col("stop_name").alias("name"), "base_name", "lat", "lon")
    boarding = stops.filter("kind IN ('', '0')")
    in_station = boarding.select("stop_id", "parent").join(stations, "parent").select("stop_id", F.concat(F.lit("parent:"), "parent").alias("cluster_id"), "name", "base_name", "lat", "lon")

    alone = boarding.join(in_station.select("stop_id"), "stop_id", "left_anti")
    led = near_leaders(alone, radius, scratch or Scratch(feed.spark, "clusters"))
    head = boarding.select(F.col("stop_id").alias("leader_id"), F.col("_line").alias("leader_line"), F.col("stop_name").alias("name"), "lat", "lon")
    alone = led.join(head, ["leader_id", "leader_line"]).select("stop_id", F.concat("base_name", F.lit("#"), F.col("number").cast("string")).alias("cluster_id"), "name", "base_name", "lat", "lon")
    serves = feed.table("stop_times").select("stop_id", "trip_id").distinct().join(feed.table("trips").select("trip_id", "route_id"), "trip_id").join(families, "route_id").select("stop_id", "family").distinct()
    platforms = in_station.unionByName(alone)
    served = platforms.select("stop_id", "cluster_id").join(serves, "stop_id").groupBy("cluster_id").agg(F.array_sort(F.collect_set("family")).alias("families"))
    grouped = platforms.groupBy("cluster_id", "base_name", "lat", "lon", "name").agg(F.array_sort(F.collect_set("stop_id")).alias("platforms"))
    return grouped.join(served, "cluster_id", "left").withColumn("families", F.coalesce("families", F.array().cast("array<string>")))


def link_stops(old: DataFrame, new: DataFrame, c: dict) -> DataFrame:
    """(old_id, new_id, confidence, method) of stop clusters that are near or share a platform id.

    Candidates come from touching grid cells and from shared ids, both equi-joins. Cells are of one size in degrees
    both ways, as the threshold's, so far from the equator they are narrower than the radius from west to east.
    """
    cell = c["inter_generation_radius_m"] / 111_000.0
    point = lambda df, n: df.select(F.col("cluster_id").alias(f"{n}_id"), F.col("lat").alias("lat" + "2" * (n == "new")), F.col("lon").alias("lon" + "2" * (n == "new")))
    ids = lambda df, n: df.select(F.col("cluster_id").alias(f"{n}_id"), F.explode("platforms").alias("stop_id"))
    near = grid_join(point(old, "old"), point(new, "new"), cell).select("old_id", "new_id")
    shared = ids(old, "old").join(ids(new, "new"), "stop_id").select("old_id", "new_id")
    side = lambda df, n: df.select(F.col("cluster_id").alias(f"{n}_id"), *[F.col(x).alias(f"{n}_{x}") for x in ("base_name", "lat", "lon", "platforms", "families")])
    pairs = near.union(shared).distinct().join(side(old, "old"), "old_id").join(side(new, "new"), "new_id")
    ratio = lambda a, b: F.size(F.array_intersect(a, b))
    pairs = pairs.withColumn("metres", haversine(F.col("old_lat"), F.col("old_lon"), F.col("new_lat"), F.col("new_lon"))).withColumn("common", ratio("old_platforms", "new_platforms"))
    pairs = pairs.filter((F.col("metres") <= c["inter_generation_radius_m"]) | (F.col("common") > 0))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([T.likeness(x, y) for x, y in zip(a, b, strict=True)])

    names = pairs.select("old_base_name", "new_base_name").distinct().withColumn("name_score", alike("old_base_name", "new_base_name"))
    union = F.size(F.array_union("old_families", "new_families"))
    score = (
        c["weight_shared_platform"] * F.col("common") / F.greatest(F.size("old_platforms"), F.size("new_platforms"))
        + c["weight_route_similarity"] * F.when(union > 0, ratio("old_families", "new_families") / union).otherwise(0.0)
        + c["weight_distance"] * F.greatest(F.lit(0.0), 1 - F.col("metres") / c["inter_generation_radius_m"])
        + c["weight_name_similarity"] * F.col("name_score")
    )
    scored = pairs.join(names, ["old_base_name", "new_base_name"]).withColumn("score", score).filter(F.col("score") >= c["link_floor"])
    method = F.when(F.col("old_base_name") == F.col("new_base_name"), NAME).otherwise("composite")
    return scored.select("old_id", "new_id", F.round(F.least(F.lit(1.0), "score"), 4).alias("confidence"), method.alias("method"))


def best(edges: DataFrame, end: str, least: float) -> DataFrame:
    """Each end's best edge of at least that confidence; ties go to the other end's smaller id."""
    other = "new_id" if end == "old_id" else "old_id"
    place = F.row_number().over(Window.partitionBy(end).orderBy(F.desc("confidence"), other))
    return edges.filter(F.col("confidence") >= least).withColumn("_p", place).filter("_p = 1").drop("_p")


def trip_sequences(feed: Feed, families: DataFrame, clusters: DataFrame) -> DataFrame:
    """(trip_id, route_id, family, direction, service_id, shape_id, headsign, base_seq, times) of each trip.

    Stops stand by their number, those that have none last and otherwise as in the file; each is known by its cluster's base name.
    """
    base = clusters.select(F.explode("platforms").alias("stop_id"), "base_name").dropDuplicates(["stop_id"])
    st = feed.table("stop_times").join(base, "stop_id", "left")
    number = F.col("stop_sequence").try_cast("double")
    stop = F.struct(number.isNull().alias("none"), number.alias("number"), F.col("_line").alias("line"), F.coalesce("base_name", "stop_id").alias("name"), F.col("arrival_time").alias("arr"), F.col("departure_time").alias("dep"))
    seqs = st.groupBy("trip_id").agg(F.array_sort(F.collect_list(stop)).alias("stops"))
    trips = feed.table("trips").dropDuplicates(["trip_id"]).join(families, "route_id", "left").join(seqs, "trip_id", "left")
    none = F.array().cast("array<string>")
    times = F.transform("stops", lambda s: F.struct(s["arr"].alias("arr"), s["dep"].alias("dep")))
    return trips.select(
        "trip_id", "route_id", F.coalesce("family", F.lit("")).alias("family"), F.trim(column(feed, "trips", "direction_id")).alias("direction"), F.col("service_id").alias("raw_service"), F.trim("service_id").alias("service_id"),
        column(feed, "trips", "shape_id").alias("shape_id"), F.coalesce(F.transform("stops", lambda s: s["name"]), none).alias("base_seq"),
        F.coalesce(times, F.array().cast("array<struct<arr:string,dep:string>>")).alias("times"),
    )


def patterns(trips: DataFrame) -> DataFrame:
    """(pattern_id, family, direction, base_seq, trip_count): distinct sequences, numbered by trips and then names."""
    counted = trips.filter("family <> '' AND size(base_seq) > 0").groupBy("family", "direction", "base_seq").agg(F.count("*").alias("trip_count"))
    place = F.row_number().over(Window.partitionBy("family", "direction").orderBy(F.desc("trip_count"), "base_seq"))
    return counted.withColumn("pattern_id", F.concat("family", F.lit("|"), "direction", F.lit("|p"), (place - 1).cast("string")))


def pattern_likeness(a: list, b: list, c: dict) -> float:
    if not a or not b or a == b:
        return float(bool(a) and bool(b))
    x, y = set(a), set(b)
    share = order_share(a, b)
    inside = min(len(a), len(b)) / max(len(a), len(b)) if x <= y or y <= x else 0.0
    return min(1.0, c["lcs_weight"] * 2 * lcs_length(a, b) / (len(a) + len(b)) + c["direction_weight"] * (0.5 if share is None else share) + c["containment_weight"] * inside)


def likeness_of(pairs: DataFrame, c: dict) -> DataFrame:
    """Add ``sim`` to rows with base_seq_a and base_seq_b; each distinct pair of sequences is compared once."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pattern_likeness(list(x), list(y), c) for x, y in zip(a, b, strict=True)])

    seqs = pairs.select("base_seq_a", "base_seq_b").distinct().withColumn("sim", score("base_seq_a", "base_seq_b"))
    return pairs.join(seqs, ["base_seq_a", "base_seq_b"])


def pattern_clusters(found: DataFrame, c: dict, scratch: Scratch) -> DataFrame:
    """(cluster_id, family, direction, base_seq, trip_count, members): patterns of a family and direction that are alike, with the commonest.

    Where a family and direction has more patterns than the switch, only those with the same ends and about the same length are compared.
    """
    many = F.count("*").over(Window.partitionBy("family", "direction")) > c["hierarchical_switch_patterns"]
    bucket = F.when(many, F.concat_ws("\x1f", F.get("base_seq", F.lit(0)), F.get("base_seq", F.size("base_seq") - 1), F.floor(F.size("base_seq") / 5).cast("string"))).otherwise("")
    keyed = scratch.put(found.withColumn("bucket", bucket), "patterns")
    side = lambda n: keyed.select("family", "direction", "bucket", F.col("pattern_id").alias(n), F.col("base_seq").alias(f"base_seq_{n}"))
    pairs = side("a").join(side("b"), ["family", "direction", "bucket"]).filter("a < b")
    edges = likeness_of(pairs, c).filter(F.col("sim") >= c["similarity_threshold"]).select("a", "b")
    labels = components(edges, scratch)
    labelled = keyed.join(labels.withColumnRenamed("node", "pattern_id"), "pattern_id", "left").withColumn("component", F.coalesce("component", "pattern_id"))
    first = F.min_by("base_seq", F.struct(-F.col("trip_count"), F.size("base_seq"), F.col("pattern_id")))
    grouped = labelled.groupBy("family", "direction", "component").agg(first.alias("base_seq"), F.sum("trip_count").alias("trip_count"), F.array_sort(F.collect_list("pattern_id")).alias("members"))
    place = F.row_number().over(Window.partitionBy("family", "direction").orderBy(F.desc("trip_count"), F.col("members")[0]))
    return grouped.withColumn("cluster_id", F.concat("family", F.lit("|"), "direction", F.lit("|c"), (place - 1).cast("string"))).drop("component")


def link_patterns(old: DataFrame, new: DataFrame, family_edges: DataFrame, c: dict) -> DataFrame:
    side = lambda df, n, k: df.select(F.col("family").alias(f"{n}_family"), F.col("cluster_id").alias(f"{n}_id"), F.col("base_seq").alias(f"base_seq_{k}"))
    fe = family_edges.select(F.col("old_id").alias("old_family"), F.col("new_id").alias("new_family"), F.col("confidence").alias("of_family"))
    pairs = fe.join(side(old, "old", "a"), "old_family").join(side(new, "new", "b"), "new_family")
    scored = likeness_of(pairs, c).withColumn("confidence", F.col("sim") * F.col("of_family")).filter(F.col("confidence") >= c["link_floor"])
    return scored.select("old_id", "new_id", F.round("confidence", 4).alias("confidence"), F.lit("pattern_similarity").alias("method"))


def stop_translation(old: DataFrame, new: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(old_base, new_base) of names that changed: each old name's best edge."""
    name = lambda df, n: df.select(F.col("cluster_id").alias(f"{n}_id"), F.col("base_name").alias(f"{n}_base"))
    rows = edges.filter(F.col("confidence") >= least).join(name(old, "old"), "old_id").join(name(new, "new"), "new_id")
    place = F.row_number().over(Window.partitionBy("old_base").orderBy(F.desc("confidence"), "new_base"))
    return rows.withColumn("_p", place).filter("_p = 1 AND old_base <> new_base").select("old_base", "new_base")


def family_stops(found: DataFrame) -> DataFrame:
    return found.select("family", F.explode("base_seq").alias("stop")).distinct()


def link_families(old: DataFrame, new: DataFrame, old_stops: DataFrame, new_stops: DataFrame, translation: DataFrame, c: dict) -> DataFrame:
    """(old_id, new_id, confidence, method): same names, and by content families whose sets of stops are alike, once old names are translated."""
    names = lambda df: df.select("family").distinct()
    same = names(old).join(names(new), "family")
    moved = old_stops.join(translation.withColumnRenamed("old_base", "stop"), "stop", "left").select("family", F.coalesce("new_base", "stop").alias("stop")).distinct()
    item = lambda df, side: df.join(same, "family", "left_anti").select(F.lit(side).alias("side"), F.col("family").alias("name"), F.col("stop").alias("item"))
    pairs = set_jaccard(item(moved, "old").unionByName(item(new_stops, "new")), c["link_floor"])
    rid = lambda df, n: df.select(F.col("family").alias(n), "route_id")
    shared = rid(old, "a").join(rid(new, "b"), "route_id").select("a", "b").distinct().withColumn("shared", F.lit(True))
    least = F.when(F.col("shared"), c["link_min_similarity"] - c["id_bonus"]).otherwise(c["link_min_similarity"])
    by_content = pairs.join(shared, ["a", "b"], "left").select(
        F.col("a").alias("old_id"), F.col("b").alias("new_id"), F.round("jaccard", 4).alias("confidence"), F.when(F.col("jaccard") >= least, CONTENT).otherwise(CANDIDATE).alias("method")
    )
    return same.select(F.col("family").alias("old_id"), F.col("family").alias("new_id"), F.lit(1.0).alias("confidence"), F.lit(NAME).alias("method")).unionByName(by_content)


def longest_sequence(found: DataFrame) -> DataFrame:
    """(family, seq): the stops of each family's longest pattern, of several the greatest by name."""
    return found.groupBy("family").agg(F.max_by("base_seq", F.struct(F.size("base_seq"), F.col("base_seq"))).alias("seq"))


def tied_first(edges: DataFrame, old_seqs: DataFrame, new_seqs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Each old family's best edge. Of edges as confident, the one whose stops stand in the same order comes first (0.5 where fewer than two are
    shared), then the likeliest name, then a new family that no old one before it has taken, the surest first, then the smaller id."""

    @F.pandas_udf("double")
    def order(a: pd.Series, b: pd.Series) -> pd.Series:
        shares = (order_share([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True))
        return pd.Series([0.5 if s is None else round(s, 4) for s in shares], dtype="float64")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(T.likeness(x, y), 4) for x, y in zip(a, b, strict=True)], dtype="float64")

    top = F.max("confidence").over(Window.partitionBy("old_id"))
    tied = edges.withColumn("_top", top).filter("confidence = _top").select("old_id", "new_id", (-F.col("confidence")).alias("_unsure")).distinct()
    seq = lambda df, end: df.select(F.col("family").alias(end), F.col("seq").alias(f"_{end}"))
    told = tied.join(seq(old_seqs, "old_id"), "old_id", "left").join(seq(new_seqs, "new_id"), "new_id", "left")
    told = told.select("old_id", "new_id", "_unsure", order("_old_id", "_new_id").alias("_order"), alike("old_id", "new_id").alias("_alike"))
    picked = walk(told, scratch or Scratch(edges.sparkSession, "tied"), ["_unsure"], [F.desc("_order"), F.desc("_alike")])
    return edges.join(picked, ["old_id", "new_id"], "left_semi")


def family_components(edges: DataFrame, groups: DataFrame, most_groups: int, scratch: Scratch, old_seqs: DataFrame, new_seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, edges): families that content edges tie together, their shape, and edges with too large components cut.

    A component over ``most_groups`` route groups keeps each old family's best content edge; where it is too large even so,
    it is demoted and its edges are candidates. groups is (gen, family, group), sequences are (family, seq).
    """
    linked = edges.filter(F.col("method") != CANDIDATE)

    def grouped(rows: DataFrame) -> DataFrame:
        ends = rows.select(F.concat(F.lit("o:"), "old_id").alias("a"), F.concat(F.lit("n:"), "new_id").alias("b"))
        labels = components(ends, scratch).select(F.col("node").alias("a"), "component")
        return scratch.put(rows.withColumn("a", F.concat(F.lit("o:"), "old_id")).join(labels, "a").drop("a"), "grouped")

    def sized(rows: DataFrame) -> DataFrame:
        in_group = lambda gen, col: groups.filter(F.col("gen") == gen).select(F.col("family").alias(col), F.col("group").alias(f"{col}_group"))
        both = rows.join(in_group("old", "old_id"), "old_id", "left").join(in_group("new", "new_id"), "new_id", "left")
        of = both.select("component", "method", F.explode(F.array(F.coalesce("old_id_group", "old_id"), F.coalesce("new_id_group", "new_id"))).alias("group"))
        return of.groupBy("component").agg(F.count_distinct("group").alias("n_groups"), F.max((F.col("method") == CONTENT).cast("int")).alias("content"))

    whole = grouped(linked)
    sizes = scratch.put(sized(whole), "sizes")
    fits = whole.join(sizes.filter((F.col("n_groups") <= most_groups) & (F.col("content") == 1)).select("component"), "component", "left_semi")
    large = whole.join(sizes.filter((F.col("n_groups") > most_groups) & (F.col("content") == 1)).select("component"), "component", "left_semi")
    one_each = tied_first(large.filter(F.col("method") == CONTENT), old_seqs, new_seqs, scratch)
    pruned = scratch.put(one_each.unionByName(large.filter(F.col("method") == NAME)).drop("component"), "pruned")
    rest = grouped(pruned)
    again = scratch.put(sized(rest).filter("content = 1").withColumn("demoted", F.col("n_groups") > most_groups).drop("content", "n_groups"), "sizes")
    members = fits.withColumn("demoted", F.lit(False)).withColumn("pruned", F.lit(False)).unionByName(rest.join(again, "component").withColumn("pruned", F.lit(True)))
    found = members.groupBy("component", "demoted", "pruned").agg(
        F.array_sort(F.collect_set("old_id")).alias("old"), F.array_sort(F.collect_set("new_id")).alias("new"), F.min(F.when(F.col("method") == CONTENT, F.col("confidence"))).alias("similarity")
    )
    n, m = F.size("old"), F.size("new")
    shape = F.when((n == 1) & (m == 1), "renamed").when(m == 1, "merged").when(n == 1, "split").otherwise("restructured")
    found = scratch.put(found.withColumn("shape", shape), "components")
    kept = members.filter("NOT demoted").select("old_id", "new_id").distinct().withColumn("kept", F.lit(True))
    cut = edges.join(kept, ["old_id", "new_id"], "left")
    method = F.when((F.col("method") == CONTENT) & F.col("kept").isNull(), CANDIDATE).otherwise(F.col("method"))
    return found, cut.select("old_id", "new_id", "confidence", method.alias("method"))


def route_groups(gens: dict[str, DataFrame], c: dict) -> DataFrame:
    """(gen, family, group): families under the stem of their names."""

    @F.pandas_udf("string")
    def stem(names: pd.Series) -> pd.Series:
        return T.stems(names, c["min_stem_len"], c["stem_stopwords"])

    rows = [df.select(F.lit(gen).alias("gen"), "family").distinct() for gen, df in gens.items()]
    whole = rows[0].unionByName(rows[1])
    return whole.join(whole.select("family").distinct().withColumn("group", stem("family")), "family").select("gen", "family", "group")


def group_cohesion(groups: DataFrame, stops: DataFrame) -> DataFrame:
    """(group, families, cohesion): the median Jaccard similarity of a group's families' stops; null for one family. stops is (family, stop)."""
    of = groups.select("family", "group").distinct()
    a, b = of.withColumnRenamed("family", "a"), of.withColumnRenamed("family", "b")
    pairs = a.join(b, "group").filter("a < b")
    sets = stops.groupBy("family").agg(F.collect_set("stop").alias("s"))
    both = pairs.join(sets.select(F.col("family").alias("a"), F.col("s").alias("sa")), "a", "left").join(sets.select(F.col("family").alias("b"), F.col("s").alias("sb")), "b", "left")
    none = F.array().cast("array<string>")
    sa, sb = F.coalesce("sa", none), F.coalesce("sb", none)
    union = F.size(F.array_union(sa, sb))
    scored = both.withColumn("j", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(sa, sb)) / union)).groupBy("group").agg(F.round(F.percentile("j", F.lit(0.5)), 4).alias("cohesion"))
    return of.groupBy("group").agg(F.array_sort(F.collect_set("family")).alias("families")).join(scored, "group", "left")


@dataclass
class Side:
    """What one generation's identity rests on."""

    families: DataFrame
    clusters: DataFrame
    trips: DataFrame
    patterns: DataFrame
    pattern_clusters: DataFrame


@dataclass
class Identity:
    old: Side
    new: Side
    stop_edges: DataFrame
    family_edges: DataFrame
    pattern_edges: DataFrame
    service_edges: DataFrame
    groups: DataFrame
    cohesion: DataFrame
    components: DataFrame


def side(feed: Feed, types: DataFrame, config: dict, scratch: Scratch) -> Side:
    c = config["identity"]
    families = scratch.put(route_families(feed), "families")
    clusters = scratch.put(stop_clusters(feed, families, c["stop_clustering"]["intra_generation_radius_m"], scratch), "clusters")
    trips = trip_sequences(feed, families, clusters).join(types.select(F.col("service_id").alias("raw_service"), "day_type"), "raw_service", "left").withColumn("day_type", F.coalesce("day_type", F.lit("irregular")))
    trips = scratch.put(trips, "trips")
    found = scratch.put(patterns(trips), "patterns")
    return Side(families, clusters, trips, found, scratch.put(pattern_clusters(found, c["pattern_clustering"], scratch), "pattern-clusters"))


def build(old_feed: Feed, new_feed: Feed, old_types: DataFrame, new_types: DataFrame, config: dict, scratch: Scratch) -> Identity:
    c = config["identity"]
    old, new = scratch.together(lambda: side(old_feed, old_types, config, scratch), lambda: side(new_feed, new_types, config, scratch))
    stop_edges, groups = scratch.together(
        lambda: scratch.put(link_stops(old.clusters, new.clusters, c["stop_clustering"]), "stop-edges"), lambda: scratch.put(route_groups({"old": old.families, "new": new.families}, c["route_group"]), "groups")
    )
    translation = stop_translation(old.clusters, new.clusters, stop_edges, c["route_family"]["stop_link_min"])
    edges = scratch.put(link_families(old.families, new.families, family_stops(old.patterns), family_stops(new.patterns), translation, c["route_family"]), "family-edges")
    found, edges = family_components(edges, groups, c["route_family"]["max_component_groups"], scratch, longest_sequence(old.patterns), longest_sequence(new.patterns))
    edges = scratch.put(edges, "family-edges")
    pattern_edges = scratch.put(link_patterns(old.pattern_clusters, new.pattern_clusters, edges, c["pattern_clustering"]), "pattern-edges")
    labels = old_types.select("day_type").intersect(new_types.select("day_type"))
    service_edges = labels.select(F.col("day_type").alias("old_id"), F.col("day_type").alias("new_id"), F.lit(1.0).alias("confidence"), F.lit("day_type").alias("method"))
    cohesion = group_cohesion(groups, family_stops(new.patterns).unionByName(family_stops(old.patterns)).distinct())
    return Identity(old, new, stop_edges, edges, pattern_edges, service_edges, groups, scratch.put(cohesion, "cohesion"), found)


def blocks(identity: Identity, scratch: Scratch) -> DataFrame:
    """(gen, family, block): route groups that accepted family edges tie together share a block."""
    of = lambda gen, end: identity.groups.filter(F.col("gen") == gen).select(F.col("family").alias(end), F.col("group").alias(f"{end}_group"))
    ties = identity.family_edges.filter(F.col("method") != CANDIDATE).join(of("old", "old_id"), "old_id").join(of("new", "new_id"), "new_id")
    labels = components(ties.select(F.col("old_id_group").alias("a"), F.col("new_id_group").alias("b")), scratch)
    return identity.groups.join(labels.withColumnRenamed("node", "group"), "group", "left").select("gen", "family", F.coalesce("component", "group").alias("block"))


def statistics(identity: Identity, accept: float) -> DataFrame:
    """(entity, old, new, matched_old, edges): how much of each kind was matched."""
    rows = []
    for entity, edges, o, n in (
        ("stop_cluster", identity.stop_edges, identity.old.clusters.select("cluster_id"), identity.new.clusters.select("cluster_id")),
        ("route_family", identity.family_edges.filter(F.col("method") != CANDIDATE), identity.old.families.select("family").distinct(), identity.new.families.select("family").distinct()),
        ("pattern_cluster", identity.pattern_edges, identity.old.pattern_clusters.select("cluster_id"), identity.new.pattern_clusters.select("cluster_id")),
    ):
        count = lambda df, name: df.agg(F.count("*").alias(name))
        matched = edges.filter(F.col("confidence") >= accept).agg(F.count_distinct("old_id").alias("matched_old"), F.count("*").alias("edges"))
        rows.append(count(o, "old").join(count(n, "new")).join(matched).select(F.lit(entity).alias("entity"), "old", "new", "matched_old", "edges"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
