"""All that is shown of a comparison, page by page: systems and directions, lines, key stops, timetables, and what changed in five levels."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..sources.scratch import Scratch
from . import cells, pages
from . import worlds as W
from .compare import Comparison
from .timetables import pair_labels


@dataclass
class Presentation:
    """contents is (page, rank, state) with state 0 for pages that come or go, 1 for others that changed, 2 for the rest; cells is None where every day type has one timetable a
    generation. What the other tables hold is told where they are made."""

    contents: DataFrame
    systems: pages.Systems
    groups: DataFrame
    views: DataFrame
    rows: DataFrame
    key_stops: DataFrame
    cells: cells.DayCells | None
    pairs: DataFrame
    timetables: DataFrame
    units: DataFrame
    levels: DataFrame
    headlines: DataFrame
    day_totals: DataFrame
    unlike_totals: DataFrame


def shown_as(c: Comparison, of: DataFrame, scratch: Scratch) -> tuple[cells.DayCells | None, DataFrame]:
    """The day cells, and (gen, trip_id, shown_id, label) of every trip."""
    sides = {"old": c.delta.old, "new": c.delta.new}
    if not c.worlds:
        plain = [df.select(F.lit(g).alias("gen"), "trip_id", F.col("trip_id").alias("shown_id"), F.col("day_type").alias("label")) for g, df in sides.items()]
        return None, plain[0].unionByName(plain[1])
    several = c.worlds["old"].filter("n_worlds > 1").select("day_type").union(c.worlds["new"].filter("n_worlds > 1").select("day_type")).distinct()
    page = lambda g: of.filter(F.col("gen") == g)
    whole, patterns, in_world = None, {}, {}
    for g, df in sides.items():
        trips = df.join(c.worlds[g].select("service_id", "world"), "service_id", "left").withColumn("world", F.coalesce("world", F.lit(""))).withColumn("gen", F.lit(g))
        in_world[g] = trips.select("gen", "family", "direction", "day_type", "world", "trip_id", "base_seq", "times")
        whole = in_world[g] if whole is None else whole.unionByName(in_world[g])
        patterns[g] = scratch.put(W.world_patterns(df.join(several, "day_type", "left_semi"), c.worlds[g], c.dates[g]), f"{g}-world-patterns")
    end = lambda g: in_world[g].select(F.col("trip_id").alias(f"{g}_id"), "family", F.col("direction").alias(f"{g}_direction"), F.col("day_type").alias(f"{g}_day"), F.col("world").alias(f"{g}_world")).join(page(g).select("family", F.col("page").alias(f"{g}_page")), "family").drop("family")
    met = c.delta.pairs.join(end("old"), "old_id").join(end("new"), "new_id").filter("old_page = new_page AND old_direction = new_direction AND old_day = new_day")
    flows = cells.world_flows(met.select(F.col("old_page").alias("page"), F.col("old_direction").alias("direction"), F.col("old_day").alias("day_type"), "old_world", "new_world"), cells.PAGE_CELL)
    found = cells.day_cells(cells.page_patterns(patterns["old"], page("old")), cells.page_patterns(patterns["new"], page("new")), flows, scratch)
    held = patterns["old"].withColumn("gen", F.lit("old")).unionByName(patterns["new"].withColumn("gen", F.lit("new")))
    twin = scratch.put(cells.twins(whole, held.select("gen", *W.CELL, "worlds")), "twins")
    return found, scratch.put(cells.shown_trips(whole.drop("base_seq", "times"), found.shown, twin), "shown")


def notes(c: Comparison, of: DataFrame) -> DataFrame:
    """(page, kind, count): lines on the map that moved, and texts on vehicles that changed."""
    family = of.select("family", "page").dropDuplicates(["family"])
    read = lambda path: F.get_json_object("quantification", path)
    shapes = c.events.filter("type = 'SHAPE_CHANGED'").filter(read("$.significant") == "true").select("event_id", F.explode(F.from_json(F.get_json_object("subject", "$.route_families"), "array<string>")).alias("family"))
    moved = shapes.join(family, "family").select("event_id", "page").distinct().groupBy("page").agg(F.count("*").alias("count")).withColumn("kind", F.lit("shape_changed"))
    signs = c.events.filter("type = 'HEADSIGN_CHANGED'").select(F.get_json_object("subject", "$.route_family").alias("family"), F.coalesce(read("$.changed_fields").cast("long"), F.lit(1)).alias("n"))
    return moved.unionByName(signs.join(family, "family").groupBy("page").agg(F.sum("n").alias("count")).withColumn("kind", F.lit("headsign_changed")))


def build(c: Comparison, scratch: Scratch | None = None) -> Presentation:
    scratch = scratch or Scratch(c.diffs.sparkSession, "presentation")
    conf = c.config["presentation"]
    of = pages.family_pages(c, scratch)
    found = pages.systems(c, of, scratch)
    groups = pages.direction_groups(found.systems, conf, scratch)
    views = pages.leg_views(groups, found.patterns, scratch)
    calls = found.patterns.select("page", F.explode("seq").alias("stop"))
    day_cells, shown = shown_as(c, of, scratch)
    shown = scratch.put(shown, "shown-trips")
    labels = shown.filter("trip_id = shown_id").select("gen", "trip_id", "label")
    trips = scratch.put(found.trips.select("gen", "page", "trip_id").join(shown, ["gen", "trip_id"]).select("gen", "page", "label", F.col("shown_id").alias("trip_id")).distinct(), "page-trips")
    to = lambda g: shown.filter(F.col("gen") == g).select(F.col("trip_id").alias(f"{g}_id"), F.col("shown_id").alias(f"{g}_shown"))
    mapped = c.delta.pairs.join(to("old"), "old_id").join(to("new"), "new_id").select(F.col("old_shown").alias("old_id"), F.col("new_shown").alias("new_id"), "relation")
    pairs = scratch.put(cells.page_pairs(trips, mapped), "page-pairs")

    # What became of each: pairs by their stops and times, the rest by what they are.
    ends = lambda df, g: df.select(F.col("trip_id").alias(f"{g}_id"), F.col("base_seq").alias(f"{g}_seq"), F.col("at").alias(f"{g}_at"))
    both = pairs.filter("old_id IS NOT NULL AND new_id IS NOT NULL").join(ends(c.delta.old, "old"), "old_id").join(ends(c.delta.new, "new"), "new_id")
    told = scratch.put(pair_labels(both.withColumnRenamed("label", "day_type"), conf["retime_minor_max_min"]), "pair-labels")
    # Exact pairs are unchanged, whatever their seconds say.
    of_pairs = told.select("page", "day_type", F.when(F.col("relation") == "exact", "unchanged").otherwise(F.col("label")).alias("label"))
    alone = pairs.filter("old_id IS NULL OR new_id IS NULL").select("page", F.col("label").alias("day_type"), F.col("relation").alias("label"))
    day_labels = scratch.put(of_pairs.unionByName(alone).groupBy("page", "day_type", "label").agg(F.count("*").alias("trips")), "day-labels")
    count = lambda g: F.count(F.when(F.col("gen") == g, 1)).alias(g)
    totals = found.trips.groupBy("page").agg(count("old"), count("new"))
    day_totals = scratch.put(trips.groupBy("page", F.col("label").alias("day_type")).agg(count("old"), count("new")).withColumn("unsure", F.lit(False)), "day-totals")

    system = lambda g: found.trips.filter(F.col("gen") == g).select("page", F.col("trip_id").alias(f"{g}_id"), F.col("system").alias(f"{g}_system"))
    moved = told.filter("old_seq <> new_seq").join(system("new"), ["page", "new_id"], "left").join(system("old"), ["page", "old_id"], "left").withColumn("system", F.coalesce("new_system", "old_system"))
    size = found.systems.select("page", "system", F.when(F.col("trips_new") > 0, F.col("trips_new")).otherwise(F.col("trips_old")).alias("trips"))
    least = conf["system_min_trips"]
    announced = found.systems.filter(f"(status = 'added' AND trips_new >= {least}) OR (status = 'removed' AND trips_old >= {least})").select("page", "system")
    units = scratch.put(pages.change_units(moved, size, announced, conf["full_coverage"]), "units")
    levels = scratch.put(pages.summary_levels(totals, found.systems, units, day_labels, notes(c, of), least), "levels")

    @F.pandas_udf("string")
    def natural(names: pd.Series) -> pd.Series:
        return names.map(natural_key)

    state = levels.groupBy("page").agg(F.when(F.min("level") == 1, 0).otherwise(1).alias("state"))
    listed = totals.select("page").join(state, "page", "left").withColumn("state", F.coalesce("state", F.lit(2))).withColumn("key", natural("page"))
    contents = pages.ranked(listed, scratch)
    return Presentation(
        contents, found, groups, views, pages.axis_rows(views, groups), pages.key_stops(groups, found.patterns, calls, conf["hub_min_groups"]), day_cells, pairs,
        pages.page_timetables(c, found, groups, labels, pairs), units, levels, pages.headlines(levels, day_labels, day_totals), day_totals, cells.unlike_totals(trips, pairs),
    )


def write(shown: Presentation, path: str) -> None:
    """Each table as compressed JSON lines in a folder of its name."""
    tables = {n: getattr(shown, n) for n in ("contents", "groups", "views", "rows", "key_stops", "pairs", "timetables", "units", "levels", "headlines", "day_totals")}
    tables["systems"] = shown.systems.systems
    if shown.cells:
        tables["day_cells"] = shown.cells.cells
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")
