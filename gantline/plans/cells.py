"""Day cells of a page: which timetable of a day type in one generation is shown beside which of the other.

Where the services of a day type run on different days (worlds), each distinct timetable is a pattern of the worlds that have it. Patterns of
the generations meet by content, then by days, and what is left by the trips that went over: most trips first, one to one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import greedy_assignment
from ..sources.scratch import Scratch
from .worlds import match_patterns

PAGE_CELL = ["page", "direction", "day_type"]


def page_patterns(patterns: DataFrame, pages: DataFrame) -> DataFrame:
    """World patterns of families (family, direction, day_type, digest, worlds, dates) by page, numbered in each cell by their first day."""
    of = patterns.join(pages.select("family", "page"), "family")
    place = F.row_number().over(Window.partitionBy(*PAGE_CELL).orderBy(F.get("dates", F.lit(0)).asc_nulls_first(), "family", "digest"))
    return of.select(*PAGE_CELL, "family", "digest", "worlds", "dates").withColumn("place", place)


def world_flows(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, old_world, new_world, trips) from a row for each pair of trips that are each other's."""
    return pairs.groupBy(*by, "old_world", "new_world").agg(F.count("*").alias("trips"))


def pattern_pairs(old: DataFrame, new: DataFrame, flows: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, old_place, new_place, signal) with signal content, dates, flow, old_only or new_only. flows is (cell, old_world, new_world, trips)."""
    met = scratch.put(match_patterns(old, new, PAGE_CELL), "matched")
    world = lambda df, g: df.select(*PAGE_CELL, F.col("place").alias(f"{g}_place"), F.explode("worlds").alias(f"{g}_world"))
    free = met.filter("signal IS NULL")
    alone = lambda g: free.filter(F.col(f"{g}_place").isNotNull()).select(*PAGE_CELL, f"{g}_place")
    by_place = flows.join(world(old, "old"), [*PAGE_CELL, "old_world"]).join(world(new, "new"), [*PAGE_CELL, "new_world"]).groupBy(*PAGE_CELL, "old_place", "new_place").agg(F.sum("trips").alias("trips"))
    wanted = by_place.join(alone("old"), [*PAGE_CELL, "old_place"], "left_semi").join(alone("new"), [*PAGE_CELL, "new_place"], "left_semi")
    block = F.to_json(F.struct(*PAGE_CELL))
    chosen = greedy_assignment(wanted.select(block.alias("block"), F.col("old_place").alias("old_id"), F.col("new_place").alias("new_id"), (-F.col("trips")).alias("few"), *PAGE_CELL), scratch, ["few"])
    flow = scratch.put(chosen.select(*PAGE_CELL, F.col("old_id").alias("old_place"), F.col("new_id").alias("new_place"), F.lit("flow").alias("signal")), "flow-pairs")
    rest = lambda g, name: alone(g).join(flow.select(*PAGE_CELL, f"{g}_place"), [*PAGE_CELL, f"{g}_place"], "left_anti").withColumn("signal", F.lit(name))
    out = met.filter("signal IS NOT NULL").unionByName(flow)
    return out.unionByName(rest("old", "old_only"), allowMissingColumns=True).unionByName(rest("new", "new_only"), allowMissingColumns=True)


@dataclass
class DayCells:
    """cells is (page, day_type, label, signal, old_dates, new_dates); shown says how a world is shown (gen, family, direction, day_type, world, label, repeated), repeated where
    another world has the same timetable and stands for it."""

    cells: DataFrame
    shown: DataFrame


def day_cells(old: DataFrame, new: DataFrame, flows: DataFrame, scratch: Scratch) -> DayCells:
    """Cells of pages from the patterns of both generations (as ``page_patterns`` gives them), labelled x@1, x@2, ... by their first days where a page has several of a day type."""
    old, new = scratch.put(old, "old-patterns"), scratch.put(new, "new-patterns")
    pairs = pattern_pairs(old, new, flows, scratch)
    side = lambda df, g: df.select(*PAGE_CELL, F.col("place").alias(f"{g}_place"), F.col("dates").alias(f"{g}_dates"), F.col("worlds").alias(f"{g}_worlds"), F.col("family").alias(f"{g}_family"))
    whole = pairs.join(side(old, "old"), [*PAGE_CELL, "old_place"], "left").join(side(new, "new"), [*PAGE_CELL, "new_place"], "left")
    none = F.array().cast(dict(old.dtypes)["dates"])
    whole = scratch.put(whole.withColumn("old_dates", F.coalesce("old_dates", none)).withColumn("new_dates", F.coalesce("new_dates", none)), "pairs")
    # Directions whose timetables hold on the same days share a cell; the surest signal of them is told.
    strength = F.when(F.col("signal") == "content", 3).when(F.col("signal") == "dates", 2).when(F.col("signal") == "flow", 1).otherwise(0)
    cells = whole.groupBy("page", "day_type", "old_dates", "new_dates").agg(F.max_by("signal", F.struct(strength, F.col("signal"))).alias("signal"))
    first = lambda d: F.get(d, F.lit(0)).asc_nulls_last()
    here = Window.partitionBy("page", "day_type")
    number = F.row_number().over(here.orderBy(first("old_dates"), first("new_dates"), "old_dates", "new_dates"))
    label = F.when(F.count("*").over(here) > 1, F.concat("day_type", F.lit("@"), number.cast("string"))).otherwise(F.col("day_type"))
    cells = scratch.put(cells.withColumn("label", label), "cells")
    named = whole.join(cells.select("page", "day_type", "old_dates", "new_dates", "label"), ["page", "day_type", "old_dates", "new_dates"])
    shown = None
    for g in ("old", "new"):
        of = named.filter(F.col(f"{g}_family").isNotNull()).select(F.lit(g).alias("gen"), F.col(f"{g}_family").alias("family"), "direction", "day_type", F.posexplode(f"{g}_worlds").alias("at", "world"), "label")
        of = of.select("gen", "family", "direction", "day_type", "world", "label", (F.col("at") > 0).alias("repeated"))
        shown = of if shown is None else shown.unionByName(of)
    return DayCells(cells, scratch.put(shown, "shown"))


def twins(trips: DataFrame, patterns: DataFrame) -> DataFrame:
    """(gen, trip_id, twin): trips of a world whose timetable an earlier world has, and the trip of that one which stands for each.

    trips is (gen, family, direction, day_type, world, trip_id, base_seq, times), patterns (gen, family, direction, day_type, worlds). Both worlds' trips are paired
    in the order of times, stops and ids.
    """
    cell = ["gen", "family", "direction", "day_type"]
    of = patterns.filter(F.size("worlds") > 1).select(*cell, F.col("worlds")[0].alias("stands"), F.explode("worlds").alias("world"))
    nth = F.row_number().over(Window.partitionBy(*cell, "world").orderBy("times", "base_seq", "trip_id"))
    placed = trips.join(of, [*cell, "world"]).withColumn("nth", nth)
    chief = placed.filter("world = stands").select(*cell, "stands", "nth", F.col("trip_id").alias("twin"))
    return placed.filter("world <> stands").join(chief, [*cell, "stands", "nth"]).select("gen", "trip_id", "twin")


def shown_trips(trips: DataFrame, found: DataFrame, twin: DataFrame) -> DataFrame:
    """(gen, trip_id, shown_id, label): each trip as the page shows it: itself or its twin, under the label of its world, its day type where its world isn't shown apart.

    trips is (gen, family, direction, day_type, world, trip_id), found the ``shown`` worlds of the day cells.
    """
    cell = ["gen", "family", "direction", "day_type", "world"]
    to = trips.join(twin, ["gen", "trip_id"], "left").withColumn("shown_id", F.coalesce("twin", "trip_id"))
    own = trips.join(found.filter("NOT repeated").select(*cell, "label"), cell, "left").select("gen", F.col("trip_id").alias("shown_id"), F.coalesce("label", "day_type").alias("label"))
    return to.select("gen", "trip_id", "shown_id").join(own, ["gen", "shown_id"])


def page_pairs(trips: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page, label, old_id, new_id, relation): every trip that a page shows, once.

    trips is (gen, page, label, trip_id) as shown, pairs (old_id, new_id, relation). Two trips stand together only where both are on the page and under one label; else the old one is
    removed there and the new one added, so that what a page shows adds up to its trips.
    """
    rows = trips.distinct()
    side = lambda g: rows.filter(F.col("gen") == g).select("page", "label", F.col("trip_id").alias(f"{g}_id"))
    # Twins fold several pairs into one; each end keeps its first.
    first = lambda df, end, *by: df.withColumn("_p", F.row_number().over(Window.partitionBy("page", "label", end).orderBy("relation", *by))).filter("_p = 1").drop("_p")
    met = side("old").join(pairs.distinct(), "old_id").join(side("new"), ["page", "label", "new_id"])
    met = first(first(met, "old_id", "new_id"), "new_id", "old_id")
    told = met.select("page", "label", "old_id", "new_id", "relation")
    for g, name in (("old", "removed"), ("new", "added")):
        alone = side(g).join(met.select("page", "label", f"{g}_id"), ["page", "label", f"{g}_id"], "left_anti").withColumn("relation", F.lit(name))
        told = told.unionByName(alone, allowMissingColumns=True)
    return told


def unlike_totals(trips: DataFrame, told: DataFrame) -> DataFrame:
    """(page, label, gen, trips, columns): what doesn't add up, which is nothing: the trips of a page and label against the columns that show them."""
    count = trips.distinct().groupBy("page", "label", "gen").agg(F.count("*").alias("trips"))
    sides = F.explode(F.array(F.struct(F.lit("old").alias("gen"), F.col("old_id").alias("id")), F.struct(F.lit("new").alias("gen"), F.col("new_id").alias("id"))))
    columns = told.select("page", "label", sides.alias("s")).filter("s.id IS NOT NULL").groupBy("page", "label", F.col("s.gen").alias("gen")).agg(F.count("*").alias("columns"))
    both = count.join(columns, ["page", "label", "gen"], "full_outer")
    return both.filter(~F.col("trips").eqNullSafe(F.col("columns")))
