"""Timetables of both generations side by side: what became of each trip, its times stop by stop, and what changed of stops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import edits
from .compare import Comparison

#: What became of a trip, in the order of reports.
LABELS = ["added", "removed", "rerouted", "shortened", "extended", "retimed", "retimed_minor", "unchanged"]
CELL = ["family", "direction", "day_type"]


def trip_pairs(c: Comparison) -> DataFrame:
    """(old_id, new_id, cell, old_seq, new_seq, old_at, new_at, group) of trips that are each other's; the cell is the new one's."""
    old = c.delta.old.select(F.col("trip_id").alias("old_id"), F.col("base_seq").alias("old_seq"), F.col("at").alias("old_at"))
    new = c.delta.new.select(F.col("trip_id").alias("new_id"), F.col("base_seq").alias("new_seq"), F.col("at").alias("new_at"), *CELL)
    groups = c.identity.groups.filter("gen = 'new'").select("family", "group")
    return c.delta.pairs.select("old_id", "new_id").join(old, "old_id").join(new, "new_id").join(groups, "family", "left").withColumn("group", F.coalesce("group", "family"))


def pair_labels(pairs: DataFrame, minor_min: int = 5) -> DataFrame:
    """Rows with old_seq, new_seq, old_at and new_at, and the label of each: other stops count before other times; times are compared as minutes, and a time that only one has is
    no minor change. Distinct pairs of sequences are compared once."""

    @F.pandas_udf("string")
    def rerouted(a: pd.Series, b: pd.Series) -> pd.Series:
        kinds = ({k for k, _, _ in edits(list(x), list(y))} for x, y in zip(a, b, strict=True))
        return pd.Series(["shortened" if k == {"PATTERN_TRUNCATED"} else "extended" if k == {"PATTERN_EXTENDED"} else "rerouted" for k in kinds])

    other = pairs.filter("old_seq <> new_seq").select("old_seq", "new_seq").distinct().withColumn("other", rerouted("old_seq", "new_seq"))
    minute = lambda x: F.floor(x / 60)
    apart = F.transform(F.arrays_zip("old_at", "new_at"), lambda t: F.when(t["old_at"].isNull() & t["new_at"].isNull(), 0).when(t["old_at"].isNull() | t["new_at"].isNull(), 1 << 30).otherwise(F.abs(minute(t["old_at"]) - minute(t["new_at"]))))
    most = F.coalesce(F.array_max(apart), F.lit(0))
    retimed = F.when(most == 0, "unchanged").when(most <= minor_min, "retimed_minor").otherwise("retimed")
    return pairs.join(other, ["old_seq", "new_seq"], "left").withColumn("label", F.coalesce("other", retimed)).drop("other")


def trip_labels(c: Comparison, minor_min: int = 5) -> DataFrame:
    """(group, direction, day_type, old_id, new_id, label): one label for each trip of either generation."""
    told = pair_labels(trip_pairs(c), minor_min).select("group", "direction", "day_type", "old_id", "new_id", "label")
    for gen, rows, label in (("old", c.delta.removed, "removed"), ("new", c.delta.added, "added")):
        groups = c.identity.groups.filter(F.col("gen") == gen).select("family", "group")
        ids = [F.col("trip_id").alias(f"{gen}_id"), F.lit(None).cast("string").alias("new_id" if gen == "old" else "old_id")]
        alone = rows.join(groups, "family", "left").select(F.coalesce("group", "family").alias("group"), "direction", "day_type", *ids, F.lit(label).alias("label"))
        told = told.unionByName(alone)
    return told


def label_counts(c: Comparison, minor_min: int = 5) -> DataFrame:
    """Trips by route group, direction, day type and label."""
    return trip_labels(c, minor_min).groupBy("group", "direction", "day_type", "label").agg(F.count("*").alias("trips"))


def day_cells(c: Comparison) -> DataFrame:
    """(group, direction, day_type, old_id, new_id, stop, visit, old_place, new_place, old_time, new_time, moved_min): every stop of every trip.

    The two times of a pair of trips meet by stop and visit; what only one trip has keeps the other side null.
    """
    pairs = trip_pairs(c).select("group", "direction", "day_type", "old_id", "new_id")

    def stops(trips: DataFrame, gen: str) -> DataFrame:
        seq, at = F.col("base_seq"), F.col("at")
        rows = trips.select("trip_id", *CELL, F.posexplode(F.arrays_zip(seq.alias("stop"), at.alias("at"))).alias("place", "s"), seq.alias("seq"))
        visit = F.size(F.filter(F.slice("seq", 1, F.col("place") + 1), lambda x: x == F.col("s.stop")))
        return rows.select(F.col("trip_id").alias(f"{gen}_id"), *CELL, F.col("s.stop").alias("stop"), visit.alias("visit"), F.col("place").alias(f"{gen}_place"), F.col("s.at").alias(f"{gen}_time"))

    old, new = stops(c.delta.old, "old"), stops(c.delta.new, "new")
    met = pairs.join(old.drop(*CELL), "old_id").join(pairs.select("old_id", "new_id").join(new.drop(*CELL), "new_id"), ["old_id", "new_id", "stop", "visit"], "full_outer")
    cell = pairs.withColumnsRenamed({x: f"_{x}" for x in ("group", "direction", "day_type")})
    whole = met.drop("group", "direction", "day_type").join(cell, ["old_id", "new_id"]).withColumnsRenamed({f"_{x}": x for x in ("group", "direction", "day_type")})
    columns = ["group", "direction", "day_type", "old_id", "new_id", "stop", "visit", "old_place", "new_place", "old_time", "new_time"]
    out = whole.select(*columns)
    for gen, rows, gone in (("old", old, c.delta.removed), ("new", new, c.delta.added)):
        groups = c.identity.groups.filter(F.col("gen") == gen).select("family", "group")
        alone = rows.join(gone.select(F.col("trip_id").alias(f"{gen}_id")), f"{gen}_id", "left_semi").join(groups, "family", "left").withColumn("group", F.coalesce("group", "family")).drop("family")
        out = out.unionByName(alone, allowMissingColumns=True)
    return out.withColumn("moved_min", F.round((F.col("new_time") - F.col("old_time")) / 60, 1))


def stop_changes(c: Comparison) -> DataFrame:
    """(kind, groups, name, was, moved_m, lat, lon, changes): renamed and moved stops one by one with the route groups that call there,
    new and gone ones, and platform changes by kind."""
    of = lambda rows, path: F.get_json_object(rows, path)
    kinds = ["STOP_RENAMED", "STOP_RELOCATED", "STOP_ADDED", "STOP_REMOVED", "PLATFORM_CHANGED", "PLATFORM_ADDED", "PLATFORM_REMOVED"]
    told = c.events.filter(F.col("type").isin(*kinds)).select(
        F.col("type").alias("kind"), of("subject", "$.stop_cluster").alias("base_name"), of("subject", "$.name").alias("own"), of("old_ref", "$.name").alias("was"), of("new_ref", "$.name").alias("now"), of("quantification", "$.moved_m").cast("double").alias("moved_m"),
    )
    told = told.groupBy("kind", "base_name", "was", "moved_m").agg(F.first(F.coalesce("now", "own", "base_name")).alias("name"), F.count("*").alias("changes"))
    side = lambda s: s.clusters.groupBy("base_name").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    places = side(c.identity.old).withColumn("gone", F.lit(True)).unionByName(side(c.identity.new).withColumn("gone", F.lit(False)))
    calls = None
    for gen, found in (("old", c.identity.old), ("new", c.identity.new)):
        rows = found.patterns.select("family", F.explode("base_seq").alias("base_name")).distinct().join(c.identity.groups.filter(F.col("gen") == gen).select("family", "group"), "family").select("base_name", "group")
        calls = rows if calls is None else calls.unionByName(rows)
    calls = calls.groupBy("base_name").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    marked = told.withColumn("gone", F.col("kind") == "STOP_REMOVED").join(places, ["base_name", "gone"], "left").join(calls, "base_name", "left")
    return marked.select("kind", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"), "name", "was", "moved_m", "lat", "lon", "changes")
