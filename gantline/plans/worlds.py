"""Day worlds: services of one day type that share operating days, and how their timetables carry over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import components
from ..sources.scratch import Scratch

CELL = ["family", "direction", "day_type"]


def day_worlds(types: DataFrame, dates: DataFrame, scratch: Scratch) -> DataFrame:
    """(service_id, day_type, world, n_worlds): services connected by a shared day, numbered by their first day in each day type."""
    node = lambda kind, c: F.concat_ws("\x1f", "day_type", F.lit(kind), c)
    edges = types.join(dates, "service_id").select(node("s", "service_id").alias("a"), node("d", F.col("day").cast("string")).alias("b"))
    labels = components(edges, scratch)
    of = types.withColumn("node", node("s", "service_id")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = dates.groupBy("service_id").agg(F.min("day").alias("first"))
    whole = of.join(first, "service_id", "left").groupBy("day_type", "component").agg(F.min("first").alias("first"), F.array_sort(F.collect_set("service_id")).alias("services"))
    place = F.row_number().over(Window.partitionBy("day_type").orderBy(F.col("first").asc_nulls_last(), "services"))
    n = F.count("*").over(Window.partitionBy("day_type"))
    numbered = whole.withColumn("world", F.concat("day_type", F.lit("#"), place.cast("string"))).withColumn("n_worlds", n)
    return scratch.put(numbered.select("day_type", "world", "n_worlds", F.explode("services").alias("service_id")), "worlds")


def world_patterns(trips: DataFrame, worlds: DataFrame, dates: DataFrame) -> DataFrame:
    """(cell, digest, worlds, dates, trips_per_day): worlds of a cell with the same timetable are one pattern."""
    of = trips.join(worlds.select("service_id", "world"), "service_id", "left").withColumn("world", F.coalesce("world", F.lit("")))
    content = of.groupBy(*CELL, "world", "base_seq", "times").agg(F.count("*").alias("n"))
    digest = F.substring(F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct("base_seq", "times", "n"))))), 1, 12)
    per_world = content.groupBy(*CELL, "world").agg(digest.alias("digest"), F.sum("n").alias("trips"))
    days = worlds.join(dates, "service_id").select("world", "day").distinct()
    held = per_world.join(days, "world", "left").groupBy(*CELL, "digest").agg(
        F.array_sort(F.collect_set("world")).alias("worlds"), F.array_sort(F.collect_set("day")).alias("dates"), F.min_by("trips", "world").alias("trips_per_day")
    )
    place = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.get("dates", F.lit(0)).asc_nulls_last(), "digest"))
    return held.withColumn("place", place)


def match_patterns(old: DataFrame, new: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """(cell, old_place, new_place, signal): patterns with one content, the first of several on either side, then those of the same days in order, then the rest alone."""
    side = lambda df, n: df.select(*cell, F.col("digest").alias(f"{n}_digest"), F.col("dates").alias(f"{n}_dates"), F.col("place").alias(f"{n}_place"))
    a, b = side(old, "old"), side(new, "new")
    first = lambda df, n: df.withColumn("_i", F.row_number().over(Window.partitionBy(*cell, f"{n}_digest").orderBy(f"{n}_place"))).filter("_i = 1").drop("_i")
    content = first(a, "old").join(first(b, "new").withColumnRenamed("new_digest", "old_digest"), [*cell, "old_digest"]).select(*cell, "old_place", "new_place", F.lit("content").alias("signal"))
    rest = lambda df, n: df.join(content.select(*cell, f"{n}_place"), [*cell, f"{n}_place"], "left_anti")
    number = lambda df, n: df.filter(F.size(f"{n}_dates") > 0).withColumn("_i", F.row_number().over(Window.partitionBy(*cell, f"{n}_dates").orderBy(f"{n}_place"))).withColumnRenamed(f"{n}_dates", "_dates")
    ra, rb = rest(a, "old"), rest(b, "new")
    by_dates = number(ra, "old").join(number(rb, "new"), [*cell, "_dates", "_i"]).select(*cell, "old_place", "new_place", F.lit("dates").alias("signal"))
    paired = content.unionByName(by_dates)
    none = F.lit(None)
    alone_a = ra.join(by_dates.select(*cell, "old_place"), [*cell, "old_place"], "left_anti").select(*cell, "old_place", none.cast("int").alias("new_place"), none.cast("string").alias("signal"))
    alone_b = rb.join(by_dates.select(*cell, "new_place"), [*cell, "new_place"], "left_anti").select(*cell, none.cast("int").alias("old_place"), "new_place", none.cast("string").alias("signal"))
    return paired.unionByName(alone_a).unionByName(alone_b)
