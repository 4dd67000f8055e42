"""What the raw differences mean: rules in a fixed order, each a few DataFrames of events and of the differences they claim.

A rule tells events (key, ord, type, subject, old_ref, new_ref, quantification, confidence, severity) and evidence
(key, rawdiff_id). Where it may only take what no earlier rule has taken, it reads ``free``, an anti-join on the
claims so far. Each rule's tables are written before the next rule reads them.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.columns import clock_seconds, haversine, time_band
from ..functions.events import EVENT_TYPES
from ..functions.sequences import edits
from ..operators import groups
from ..operators.diff import top_k
from ..sources.feed import Feed
from ..sources.scratch import Scratch, global_rank
from . import identity as I
from . import worlds as W
from .calendars import DAYS, PERIOD
from .scope import Scope
from .trips import TripDelta

EVENT = "key string, ord array<string>, type string, subject string, old_ref string, new_ref string, quantification string, confidence double, severity string"
TIMES = ["arrival_time", "departure_time"]
CELL = W.CELL
#: Claims are entered into one ledger after so many steps, so that a rule reads that and the few tables since.
ENTER_EVERY = 6


def no_json() -> Column:
    return F.lit(None).cast("string")


def json(**parts) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts.items()]))


def sorted_set(c) -> Column:
    return F.array_sort(F.collect_set(c))


@dataclass
class Context:
    old: Feed
    new: Feed
    config: dict
    diffs: DataFrame
    identity: I.Identity
    delta: TripDelta
    types: dict[str, DataFrame]
    scratch: Scratch
    worlds: dict[str, DataFrame] | None = None
    dates: dict[str, DataFrame] | None = None
    scope: Scope | None = None
    left_out: DataFrame | None = None
    steps: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    taken: DataFrame | None = None
    entered: int = 0

    def file(self, *names: str) -> DataFrame:
        return self.diffs.filter(F.col("file").isin(*[f"{n}.txt" for n in names])).withColumn("key0", F.get("key", F.lit(0)))

    def cells(self, table: str, *columns: str) -> DataFrame:
        return self.file(table).filter((F.col("kind") == "field_changed") & F.col("column").isin(*columns))

    def claims(self) -> DataFrame | None:
        """(rawdiff_id) of all that is claimed so far: the ledger, and what the last rules have added to it."""
        rows = [found.select("rawdiff_id") for _, found in self.steps[self.entered :]]
        rows = [self.taken, *rows] if self.taken is not None else rows
        return functools.reduce(DataFrame.unionByName, rows) if rows else None

    def free(self, rows: DataFrame) -> DataFrame:
        """The rows whose rawdiff_id no earlier rule has claimed."""
        claims = self.claims()
        return rows if claims is None else rows.join(claims, "rawdiff_id", "left_anti")

    def cascade(self, keyed: DataFrame) -> DataFrame:
        """(key, rawdiff_id) of what differs in trips and stop times of rows (key, trip_id)."""
        return keyed.withColumnRenamed("trip_id", "key0").join(self.file("trips", "stop_times").select("key0", "rawdiff_id"), "key0").select("key", "rawdiff_id").distinct()

    def emit(self, events: DataFrame, evidence: DataFrame) -> None:
        names = [part.split(" ")[0] for part in EVENT.split(", ")]
        for n in names:
            if n not in events.columns:
                events = events.withColumn(n, F.lit(1.0) if n == "confidence" else F.array("key") if n == "ord" else no_json())
        step = len(self.steps)
        told, found = self.scratch.together(lambda: self.scratch.put(events.select(*names), f"events-{step}"), lambda: self.scratch.put(evidence.select("key", "rawdiff_id").distinct(), f"evidence-{step}"))
        self.steps.append((told, found))
        if len(self.steps) - self.entered >= ENTER_EVERY:
            self.taken, self.entered = self.scratch.put(self.claims().distinct(), "taken"), len(self.steps)

    def trips(self) -> DataFrame:
        return self.delta.old.select("trip_id", *CELL).withColumn("gen", F.lit("old")).unionByName(self.delta.new.select("trip_id", *CELL).withColumn("gen", F.lit("new")))


def has_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    return events.join(evidence.select("key").distinct(), "key", "left_semi")


# Stops


def platforms_of(clusters: DataFrame, gen: str) -> DataFrame:
    return clusters.select(F.col("cluster_id").alias(f"{gen}_id"), F.explode("platforms").alias("stop_id"))


def stops(ctx: Context) -> None:
    accept = ctx.config["events"]["accept_confidence"]
    edges = ctx.identity.stop_edges
    best = I.best(edges, "old_id", accept)
    reached = edges.filter(F.col("confidence") >= accept).select("new_id").distinct()
    old, new = ctx.identity.old.clusters, ctx.identity.new.clusters
    diffs = ctx.file("stops").select("key0", "kind", "column", "rawdiff_id").withColumnRenamed("key0", "stop_id")

    def alone(clusters: DataFrame, gen: str, matched: DataFrame, type_: str, kind: str) -> None:
        left = clusters.withColumnRenamed("cluster_id", f"{gen}_id").join(matched, f"{gen}_id", "left_anti").withColumn("key", F.concat(F.lit(type_ + "|"), f"{gen}_id"))
        ref = json(cluster_id=F.col(f"{gen}_id"), platform_ids=F.col("platforms"))
        told = left.select("key", F.lit(type_).alias("type"), json(stop_cluster=F.col("base_name"), name=F.col("name")).alias("subject"), ref.alias(f"{gen}_ref"), json(platform_count=F.size("platforms")).alias("quantification"))
        found = left.select("key", F.explode("platforms").alias("stop_id")).join(diffs.filter(F.col("kind") == kind), "stop_id")
        ctx.emit(told, found)

    alone(old, "old", best.select("old_id"), "STOP_REMOVED", "row_removed")
    side = lambda df, n: df.select(F.col("cluster_id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}_{c}") for c in ("base_name", "name", "lat", "lon", "platforms")])
    pairs = best.join(side(old, "old"), "old_id").join(side(new, "new"), "new_id").withColumn("metres", haversine(F.col("old_lat"), F.col("old_lon"), F.col("new_lat"), F.col("new_lon")))
    pairs = ctx.scratch.put(pairs, "stop-pairs")
    shared = pairs.select("old_id", F.explode(F.array_intersect("old_platforms", "new_platforms")).alias("stop_id")).join(diffs.filter("kind = 'field_changed'"), "stop_id")
    subject = {"stop_cluster": F.col("new_base_name")}

    def changed(tag: str, columns: list[str], type_: Column, **parts) -> None:
        found = shared.filter(F.col("column").isin(*columns)).select(F.concat(F.lit(tag + "|"), "old_id").alias("key"), "rawdiff_id")
        told = pairs.withColumn("key", F.concat(F.lit(tag + "|"), "old_id")).select("key", type_.alias("type"), "confidence", *[v.alias(k) for k, v in parts.items()])
        ctx.emit(has_evidence(told, found), found)

    changed("renamed", ["stop_name"], F.lit("STOP_RENAMED"), subject=json(**subject), old_ref=json(name=F.col("old_name")), new_ref=json(name=F.col("new_name")))
    far = F.col("metres") > ctx.config["events"]["stops"]["relocated_threshold_m"]
    changed("moved", ["stop_lat", "stop_lon"], F.when(far, "STOP_RELOCATED").otherwise("PLATFORM_CHANGED"), subject=json(**subject, name=F.col("new_name")), quantification=json(moved_m=F.round("metres", 1)), severity=F.when(~far, "info"))
    for type_, kind, a, b in (("PLATFORM_REMOVED", "row_removed", "old_platforms", "new_platforms"), ("PLATFORM_ADDED", "row_added", "new_platforms", "old_platforms")):
        some = pairs.withColumn("ids", F.array_sort(F.array_except(a, b))).filter("size(ids) > 0").withColumn("key", F.concat(F.lit(type_ + "|"), "old_id"))
        found = some.select("key", F.explode("ids").alias("stop_id")).join(diffs.filter(F.col("kind") == kind), "stop_id")
        told = some.select("key", F.lit(type_).alias("type"), json(**subject).alias("subject"), json(platform_ids=F.col("ids")).alias("quantification"), "confidence")
        ctx.emit(has_evidence(told, found), found)
    changed("access", ["wheelchair_boarding"], F.lit("ACCESSIBILITY_CHANGED"), subject=json(**subject))
    alone(new, "new", reached, "STOP_ADDED", "row_added")
    # Stop times that went to another platform of the same or a linked stop.
    cluster = lambda df, n: df.select(F.explode("platforms").alias(f"{n}_value"), F.col("cluster_id").alias(f"{n}_id"), F.col("base_name").alias(f"{n}_base")).dropDuplicates([f"{n}_value"])
    swaps = ctx.free(ctx.cells("stop_times", "stop_id")).join(cluster(old, "old"), "old_value").join(cluster(new, "new"), "new_value")
    linked = edges.filter(F.col("confidence") >= accept).select("old_id", "new_id").withColumn("linked", F.lit(True))
    swaps = swaps.join(linked, ["old_id", "new_id"], "left").filter("old_base = new_base OR linked").select(F.col("new_base").alias("key"), "rawdiff_id")
    told = swaps.groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit("PLATFORM_CHANGED").alias("type"), json(stop_cluster=F.col("key")).alias("subject"), json(stop_time_rows=F.col("n")).alias("quantification"))
    ctx.emit(told, swaps)


# Routes


def routes(ctx: Context) -> None:
    ident = ctx.identity
    names = lambda side: side.families.select("family").distinct()
    old_names, new_names = names(ident.old), names(ident.new)
    families = ident.old.families.withColumn("gen", F.lit("old")).unionByName(ident.new.families.withColumn("gen", F.lit("new")))
    on_routes = ctx.file("routes").select(F.col("key0").alias("route_id"), "rawdiff_id", "kind", "column")
    swapped = ctx.cells("trips", "route_id").select(F.col("key0").alias("trip_id"), "rawdiff_id")
    new_trips = ctx.delta.new.select("family", "trip_id")
    comps = ctx.scratch.put(ident.components.filter("NOT demoted").withColumn("key", F.concat_ws("|", F.array_join("old", ","), F.array_join("new", ","))), "shapes")
    members = comps.select("key", F.explode(F.concat(F.transform("old", lambda f: F.struct(F.lit("old").alias("gen"), f.alias("family"))), F.transform("new", lambda f: F.struct(F.lit("new").alias("gen"), f.alias("family"))))).alias("m")).select("key", "m.gen", "m.family").distinct()
    handled = members.join(new_names.withColumn("gen", F.lit("old")).unionByName(old_names.withColumn("gen", F.lit("new"))), ["gen", "family"], "left_anti")
    handled = ctx.scratch.put(handled, "handled")
    by_route = members.join(families, ["gen", "family"]).select("key", "route_id").distinct().join(on_routes, "route_id").select("key", "rawdiff_id")
    by_trip = handled.filter("gen = 'new'").join(new_trips, "family").join(swapped, "trip_id").select("key", "rawdiff_id")
    type_ = F.element_at(F.create_map(*[F.lit(x) for kv in (("renamed", "ROUTE_RENAMED"), ("merged", "ROUTE_MERGED"), ("split", "ROUTE_SPLIT"), ("restructured", "ROUTE_RESTRUCTURED")) for x in kv]), F.col("shape"))
    subject = F.when(F.size("new") == 1, json(route_family=F.col("new")[0])).otherwise(json(route_families=F.col("new")))
    ctx.emit(
        comps.select("key", type_.alias("type"), subject.alias("subject"), json(names=F.col("old")).alias("old_ref"), json(names=F.col("new")).alias("new_ref"), json(stop_set_similarity=F.col("similarity")).alias("quantification"), F.col("similarity").alias("confidence")),
        by_route.unionByName(by_trip),
    )
    both = old_names.join(new_names, "family")
    ids = families.join(both, "family").groupBy("family").agg(sorted_set(F.when(F.col("gen") == "old", F.col("route_id"))).alias("o"), sorted_set(F.when(F.col("gen") == "new", F.col("route_id"))).alias("n"))
    churn = ids.select(F.col("family").alias("key"), F.array_except("o", "n").alias("gone"), F.array_except("n", "o").alias("come"), F.array_intersect("o", "n").alias("kept"))
    churn = ctx.scratch.put(churn, "route-ids")
    moved = churn.filter("size(gone) + size(come) > 0")
    jp = ctx.file("routes", "routes_jp").select(F.col("key0").alias("route_id"), "rawdiff_id")
    found = moved.select("key", F.explode(F.concat("gone", "come")).alias("route_id")).join(jp, "route_id").select("key", "rawdiff_id")
    found = found.unionByName(moved.select(F.col("key").alias("family")).join(new_trips, "family").join(swapped, "trip_id").select(F.col("family").alias("key"), "rawdiff_id"))
    told = moved.select("key", F.lit("TECHNICAL_ID_CHURN").alias("type"), json(route_family=F.col("key"), entity="route_id").alias("subject"), json(removed_route_ids=F.col("gone"), added_route_ids=F.col("come")).alias("quantification"))
    ctx.emit(has_evidence(told, found), found)
    for gen, own, other, type_name, change in (("old", ident.old, new_names, "ROUTE_DISCONTINUED", "disappeared"), ("new", ident.new, old_names, "ROUTE_ADDED", "appeared")):
        trips = (ctx.delta.old if gen == "old" else ctx.delta.new).select("family", "trip_id", "day_type")
        left = own.families.join(other, "family", "left_anti").join(handled.filter(F.col("gen") == gen).select("family"), "family", "left_anti")
        ids = left.groupBy("family").agg(sorted_set("route_id").alias("route_ids"))
        counted = trips.groupBy("family").agg(F.count("*").alias("trips"), F.bool_and(F.col("day_type") == "irregular").alias("odd"))
        whole = ids.join(counted, "family", "left").withColumn("key", F.col("family")).withColumn("trips", F.coalesce("trips", F.lit(0))).withColumn("odd", F.coalesce("odd", F.lit(False)))
        found = left.join(on_routes, "route_id").select(F.col("family").alias("key"), "rawdiff_id").unionByName(ctx.cascade(left.select("family").distinct().join(trips, "family").select(F.col("family").alias("key"), "trip_id")))
        ctx.emit(
            whole.select("key", F.when(F.col("odd"), "SEASONAL_SERVICE_CHANGED").otherwise(type_name).alias("type"), json(route_family=F.col("family")).alias("subject"), json(route_ids=F.col("route_ids"), trip_count=F.col("trips")).alias(f"{gen}_ref"),
                         json(trip_count=F.col("trips"), change=change).alias("quantification"), F.when(F.col("odd"), 0.6).otherwise(1.0).alias("confidence")),
            found,
        )
    renamed = on_routes.filter("kind = 'field_changed'").filter(F.col("column").isin("route_short_name", "route_long_name"))
    found = churn.select("key", F.explode("kept").alias("route_id")).join(renamed, "route_id").select("key", "rawdiff_id")
    told = found.select("key").distinct().select("key", F.lit("ROUTE_RENAMED").alias("type"), json(route_family=F.col("key")).alias("subject"), json(scope="route_long_name").alias("quantification"))
    ctx.emit(told, found)


# Modified trips: patterns and times


def modified(ctx: Context) -> DataFrame:
    """(old_id, new_id, family, direction, day_type, old_seq, new_seq, old_times, new_times) of modified pairs."""
    side = lambda df, n: df.select(F.col("trip_id").alias(f"{n}_id"), F.col("base_seq").alias(f"{n}_seq"), F.col("times").alias(f"{n}_times"), F.col("at").alias(f"{n}_at"))
    pairs = ctx.delta.pairs.filter("relation = 'modified'").select("old_id", "new_id")
    return pairs.join(side(ctx.delta.old, "old"), "old_id").join(side(ctx.delta.new, "new"), "new_id").join(ctx.delta.new.select(F.col("trip_id").alias("new_id"), *CELL), "new_id")


def patterns(ctx: Context) -> None:
    rows = modified(ctx).filter("old_seq <> new_seq")

    @F.pandas_udf("array<struct<type:string,stops:array<string>,end:string>>")
    def told_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"type": t, "stops": s, "end": e} for t, s, e in edits(list(x), list(y))] for x, y in zip(a, b, strict=True)])

    seqs = rows.select("old_seq", "new_seq").distinct().withColumn("edits", told_of("old_seq", "new_seq"))
    each = rows.join(seqs, ["old_seq", "new_seq"]).select("*", F.explode("edits").alias("e")).withColumn("key", F.concat_ws("\x1f", *CELL, "e.type", F.array_join("e.stops", ">"), "e.end"))
    each = ctx.scratch.put(each, "pattern-edits")
    grouped = each.groupBy("key", *CELL, "e").agg(F.count_distinct("new_id").alias("n"), F.min_by("old_seq", F.struct("old_id", "new_id")).alias("o"), F.min_by("new_seq", F.struct("old_id", "new_id")).alias("w"))
    quant = F.when(F.col("e.end") != "", json(trip_count=F.col("n"), stops=F.col("e.stops"), end=F.col("e.end"))).otherwise(json(trip_count=F.col("n"), stops=F.col("e.stops")))
    told = grouped.select("key", F.col("e.type").alias("type"), json(route_family=F.col("family"), direction=F.col("direction"), day_type=F.col("day_type")).alias("subject"), quant.alias("quantification"), json(pattern=F.col("o")).alias("old_ref"), json(pattern=F.col("w")).alias("new_ref"))
    ctx.emit(told, ctx.cascade(each.select("key", F.col("old_id").alias("trip_id")).union(each.select("key", "new_id")).distinct()))


def cell_subject() -> Column:
    return json(route_family=F.col("family"), direction=F.col("direction"), day_type=F.col("day_type"))


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60))


def frequency(ctx: Context) -> None:
    """Trips that went and came, by time band; where a day type has several worlds, by matched timetables of worlds."""
    c = ctx.config["events"]["frequency"]
    band = time_band(F.col("departure"), c["time_bands"])
    on_trips = ctx.file("trips").select(F.col("key0").alias("trip_id"), "rawdiff_id")
    unclaimed = ctx.free(on_trips).select("trip_id").distinct()
    taken = on_trips.select("trip_id").distinct().join(unclaimed, "trip_id", "left_anti")
    slot = lambda df, gen: _slots(ctx, df, gen).withColumn("band", band)
    pool = slot(ctx.delta.removed.join(taken, "trip_id", "left_anti"), "old").select("slot", *CELL, "band", "trip_id", F.lit("old").alias("gen"))
    pool = ctx.scratch.put(pool.unionByName(slot(ctx.delta.added.join(taken, "trip_id", "left_anti"), "new").select("slot", *CELL, "band", "trip_id", F.lit("new").alias("gen"))), "pool")
    every = slot(ctx.delta.old, "old").select("slot", *CELL, "band", "departure", F.lit("old").alias("gen")).unionByName(slot(ctx.delta.new, "new").select("slot", *CELL, "band", "departure", F.lit("new").alias("gen")))
    is_old = F.col("gen") == "old"
    side = lambda what, name: [F.count(F.when(is_old, 1)).alias(f"old_{name}"), F.count(F.when(~is_old, 1)).alias(f"new_{name}")]
    by_band = every.groupBy("slot", *CELL, "band").agg(*side(every, "n"))
    by_cell = every.groupBy("slot", *CELL).agg(
        *side(every, "total"), *groups.ends(F.col("departure"), is_old)
    )
    by_cell = ctx.scratch.put(by_cell, "cells")
    pooled = pool.groupBy("slot", *CELL, "band").agg(F.count(F.when(is_old, 1)).alias("changed"))
    key = lambda *more: F.concat_ws("\x1f", *CELL, "slot", *more)
    whole = pooled.join(by_band, ["slot", *CELL, "band"]).join(by_cell, ["slot", *CELL]).withColumn("key", key("band"))
    less, more = F.col("new_n") < F.col("old_n"), F.col("new_n") > F.col("old_n")
    numbers = dict(time_band=F.col("band"), old_count=F.col("old_n"), new_count=F.col("new_n"), group_old_total=F.col("old_total"), group_new_total=F.col("new_total"))
    quant = F.when(less | more, json(**numbers)).otherwise(json(**numbers, uniform=False, trips_changed=F.col("changed")))
    days = _service_days(ctx, pool)
    spoken = days[0].select("slot", *CELL) if days else None
    if spoken is not None:  # worlds whose timetable went to other days, whole
        whole = whole.join(spoken, ["slot", *CELL], "left_anti")
    told = whole.select(
        "key", F.array(F.col("family"), F.col("direction"), F.col("day_type"), F.col("slot"), F.lit("0"), F.col("band")).alias("ord"),
        F.when(less, "SERVICE_REDUCED").when(more, "SERVICE_INCREASED").otherwise("TIMETABLE_SHIFTED").alias("type"), cell_subject().alias("subject"), quant.alias("quantification"),
        F.when(less, F.when(F.col("band").isin(*c["major_bands"]), "major").otherwise("minor")).alias("severity"),
    )
    found = ctx.cascade(has_evidence(pool.withColumn("key", key("band")), told).select("key", "trip_id"))
    ends = by_cell.join(pool.select("slot", *CELL).distinct(), ["slot", *CELL], "left_semi")
    if spoken is not None:
        ends = ends.join(spoken, ["slot", *CELL], "left_anti")
    first, last = (F.col("new_first") - F.col("old_first")) / 60, (F.col("new_last") - F.col("old_last")) / 60
    ends = groups.moved_ends(ends, 60 * c["first_last_threshold_min"])
    shift = json(first_shift_min=F.round(first, 1), last_shift_min=F.round(last, 1), old_first=clock(F.col("old_first")), new_first=clock(F.col("new_first")), old_last=clock(F.col("old_last")), new_last=clock(F.col("new_last")))
    told = told.unionByName(ends.select(
        key(F.lit("ends")).alias("key"), F.array(F.col("family"), F.col("direction"), F.col("day_type"), F.col("slot"), F.lit("1"), F.lit("")).alias("ord"),
        F.lit("FIRST_LAST_CHANGED").alias("type"), cell_subject().alias("subject"), shift.alias("quantification"), no_json().alias("severity"),
    ))
    if days:
        extra = days[0].select(key(F.lit("days")).alias("key"), F.array(F.col("family"), F.col("direction"), F.col("day_type"), F.col("slot"), F.lit("0"), F.lit("")).alias("ord"),
                               F.lit("SERVICE_DAYS_CHANGED").alias("type"), cell_subject().alias("subject"), "quantification", no_json().alias("severity"))
        told = told.unionByName(extra)
        found = found.unionByName(ctx.cascade(pool.join(spoken, ["slot", *CELL], "left_semi").select(key(F.lit("days")).alias("key"), "trip_id")))
    ctx.emit(told, found)


def _pattern_slots(ctx: Context) -> DataFrame | None:
    """(gen, cell, world, slot, signal): the matched timetable that a world of a cell belongs to, in day types with several worlds."""
    if ctx.worlds is None:
        return None
    of = {g: W.world_patterns(d, ctx.worlds[g], ctx.dates[g]) for g, d in (("old", ctx.delta.old), ("new", ctx.delta.new))}
    matched = W.match_patterns(of["old"], of["new"]).withColumn("slot", F.concat_ws("~", F.coalesce(F.col("old_place").cast("string"), F.lit("-")), F.coalesce(F.col("new_place").cast("string"), F.lit("-"))))
    rows = [of[g].select(*CELL, F.col("place").alias(f"{g}_place"), F.explode("worlds").alias("world"), "dates", "trips_per_day").join(matched.select(*CELL, f"{g}_place", "slot", "signal"), [*CELL, f"{g}_place"]).select(F.lit(g).alias("gen"), *CELL, "world", "slot", "signal", "dates", "trips_per_day") for g in of]
    return ctx.scratch.put(rows[0].unionByName(rows[1]), "slots")


def _several(ctx: Context) -> DataFrame:
    both = ctx.worlds["old"].unionByName(ctx.worlds["new"])
    return both.filter("n_worlds > 1").select("day_type").distinct()


def _slots(ctx: Context, trips: DataFrame, gen: str) -> DataFrame:
    """Add the slot that a trip counts in: one for its cell, or one for its matched timetable where its day type has several worlds."""
    if ctx.worlds is None:
        return trips.withColumn("slot", F.lit(""))
    if not hasattr(ctx, "_slot_table"):
        ctx._slot_table = _pattern_slots(ctx)
    slots = ctx._slot_table.filter(F.col("gen") == gen).join(_several(ctx), "day_type", "left_semi").select(*CELL, "world", "slot")
    of = trips.join(ctx.worlds[gen].select("service_id", "world"), "service_id", "left").withColumn("world", F.coalesce("world", F.lit("")))
    return of.join(slots, [*CELL, "world"], "left").withColumn("slot", F.coalesce("slot", F.lit("")))


def _service_days(ctx: Context, pool: DataFrame) -> tuple[DataFrame] | None:
    """Cells whose timetable is the same but runs on other days, with trips in the pool."""
    if ctx.worlds is None:
        return None
    most = ctx.config["events"]["service_days"]["dates_list_max"]
    text = lambda c: F.transform(c, lambda d: F.date_format(d, "yyyyMMdd"))
    slots = ctx._slot_table.filter("signal = 'content'").join(_several(ctx), "day_type", "left_semi")
    side = lambda g: slots.filter(F.col("gen") == g).select(*CELL, "slot", F.col("dates").alias(f"{g}_dates"), F.col("trips_per_day").alias(f"{g}_trips")).dropDuplicates([*CELL, "slot"])
    moved = side("old").join(side("new"), [*CELL, "slot"]).filter("old_dates <> new_dates").join(pool.select(*CELL, "slot").distinct(), [*CELL, "slot"], "left_semi")
    quant = json(trips_per_day=F.col("old_trips"), dates_old=text(F.slice("old_dates", 1, most)), dates_new=text(F.slice("new_dates", 1, most)), dates_old_total=F.size("old_dates"), dates_new_total=F.size("new_dates"))
    return (ctx.scratch.put(moved.select(*CELL, "slot", quant.alias("quantification")), "service-days"),)


def times(ctx: Context) -> None:
    """Modified trips with the same stops: shifted as a whole, or with other running times."""
    rows = modified(ctx).filter("old_seq = new_seq")
    kept = ctx.cells("stop_times", *TIMES).select(F.col("key0").alias("trip_id"), "rawdiff_id")
    pair = F.concat_ws("\x1f", "old_id", "new_id")
    same, other = rows.filter("old_id = new_id"), rows.filter("old_id <> new_id")
    found = same.select(pair.alias("key"), F.col("new_id").alias("trip_id")).join(kept, "trip_id").select("key", "rawdiff_id")
    found = ctx.scratch.put(found.unionByName(ctx.cascade(other.select(pair.alias("key"), F.col("old_id").alias("trip_id")).union(other.select(pair, "new_id")))), "pair-evidence")
    shift = F.zip_with("new_at", "old_at", lambda a, b: a - b)
    known = (F.size("old_at") == F.size("new_at")) & F.forall(shift, lambda x: x.isNotNull())
    rows = rows.withColumn("key", pair).join(found.select("key").distinct(), "key", "left_semi").withColumn("shift", F.when(known, shift).otherwise(F.array().cast("array<int>")))
    mean, spread = groups.mean_and_spread(F.col("shift"))
    uniform = F.coalesce(spread <= ctx.config["events"]["timetable"]["uniform_shift_max_std_sec"], F.lit(False))
    rows = rows.withColumn("mean", mean).withColumn("uniform", uniform).withColumn("minutes", F.when(F.col("uniform"), F.bround(F.col("mean") / 60).cast("long")).otherwise(0))
    rows = ctx.scratch.put(rows.withColumn("pair", F.col("key")).withColumn("key", F.concat_ws("\x1f", *CELL, F.col("uniform").cast("string"), F.col("minutes").cast("string"))), "time-pairs")
    stats = segment_stats(rows.filter("NOT uniform"))
    grouped = rows.groupBy("key", *CELL, "uniform", "minutes").agg(F.count("*").alias("n")).join(stats, "key", "left")
    quant = F.when(F.col("uniform"), json(trip_count=F.col("n"), shift_min=F.col("minutes"), uniform=True)).otherwise(json(trip_count=F.col("n"), segments=F.col("segments")))
    told = grouped.select("key", F.when(F.col("uniform"), "TIMETABLE_SHIFTED").otherwise("TRAVEL_TIME_CHANGED").alias("type"), cell_subject().alias("subject"), quant.alias("quantification"))
    ctx.emit(told, rows.select("key", "pair").join(found.withColumnRenamed("key", "pair"), "pair").select("key", "rawdiff_id"))


def segment_stats(rows: DataFrame, most: int = 5) -> DataFrame:
    """(key, segments): medians and 90th percentiles of running times between neighbouring stops whose median changed, the largest changes first."""
    def runs(seq: str, times_: str, side: str) -> DataFrame:
        i = F.sequence(F.lit(0), F.size(seq) - 2)
        step = F.transform(i, lambda k: F.struct(
            F.concat_ws("→", F.get(seq, k), F.get(seq, k + 1)).alias("segment"),
            (clock_seconds(_either(F.get(times_, k + 1), "arr", "dep")) - clock_seconds(_either(F.get(times_, k), "dep", "arr"))).alias("s"),
        ))
        return rows.filter(F.size(seq) > 1).select("key", F.explode(step).alias("x")).select("key", "x.segment", "x.s").filter("s IS NOT NULL").withColumn("side", F.lit(side))

    whole = runs("old_seq", "old_times", "old").unionByName(runs("new_seq", "new_times", "new"))
    of = lambda g, c: F.max(F.when(F.col("side") == g, F.col(c)))
    ranked = groups.middle_and_rank(whole, ["key", "segment", "side"], "s")
    agg = ranked.groupBy("key", "segment").agg(*[of(g, "middle").cast("int").alias(f"{g}_median_sec") for g in ("old", "new")], *[of(g, "ranked").alias(f"{g}_p90") for g in ("old", "new")])
    changed = agg.filter("old_median_sec <> new_median_sec")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.abs(F.col("new_median_sec") - F.col("old_median_sec"))), "segment"))
    top = changed.withColumn("place", place).filter(F.col("place") <= most)
    return top.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "segment", "old_median_sec", "new_median_sec", "old_p90", "new_p90"))), lambda x: x.dropFields("place")).alias("segments"))


def _either(t: Column, a: str, b: str) -> Column:
    return F.when(t[a] != "", t[a]).otherwise(t[b])


# Calendars


def calendars(ctx: Context) -> None:
    spark = ctx.diffs.sparkSession
    labels = {g: [r[0] for r in ctx.types[g].select("day_type").distinct().orderBy("day_type").collect()] for g in ("old", "new")}  # day types: a few dozen at most
    on_calendar = ctx.file("calendar")
    if labels["old"] != labels["new"]:
        rows = F.col("kind").isin("row_added", "row_removed") | (F.col("kind") == "field_changed") & F.col("column").isin(*DAYS)
        told = spark.range(1).select(F.lit("feed").alias("key"), F.lit("DAYTYPE_RESTRUCTURED").alias("type"), json(scope="feed").alias("subject"), json(day_types=F.array(*map(F.lit, labels["old"]))).alias("old_ref"), json(day_types=F.array(*map(F.lit, labels["new"]))).alias("new_ref"), F.lit(0.8).alias("confidence"))
        ctx.emit(told, ctx.free(on_calendar.filter(rows)).select(F.lit("feed").alias("key"), "rawdiff_id"))
    found = ctx.free(ctx.cells("calendar", *PERIOD)).select(F.lit("calendar").alias("key"), "rawdiff_id")
    told = found.groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit("FEED_VALIDITY_CHANGED").alias("type"), json(files=F.array(F.lit("calendar.txt"))).alias("subject"), json(changed_rows=F.col("n")).alias("quantification"))
    ctx.emit(told, found)
    overlap = _overlap(ctx)
    side = lambda g: ctx.types[g].select(F.col("service_id").alias("key0"), F.col("day_type").alias(f"{g}_type"))
    rows = ctx.file("calendar_dates").withColumn("date", F.coalesce(F.get("key", F.lit(1)), F.lit(""))).join(side("old"), "key0", "left").join(side("new"), "key0", "left").withColumn("day_type", F.coalesce("old_type", "new_type", F.lit("irregular")))
    bucket = F.when(F.col("date").between(*overlap), "within_overlap").otherwise("outside_overlap") if overlap else F.lit("unknown_window")
    bucket = F.when(F.col("date") == "", "unknown_window").otherwise(bucket)
    rows = rows.withColumn("bucket", bucket)
    found = ctx.free(rows).select(F.col("day_type").alias("key"), "rawdiff_id")
    names = ["outside_overlap", "unknown_window", "within_overlap"]
    counted = rows.groupBy(F.col("day_type").alias("key")).agg(*[F.nullif(F.count(F.when(F.col("bucket") == n, 1)), F.lit(0)).alias(n) for n in names])
    parts = {n: F.col(n) for n in names} | ({"overlap_window": F.array(*map(F.lit, overlap))} if overlap else {}) | {"substantive": F.col("within_overlap").isNotNull()}
    told = counted.select("key", F.lit("HOLIDAY_EXCEPTION_CHANGED").alias("type"), json(day_type=F.col("key")).alias("subject"), json(**parts).alias("quantification"), F.lit(1.0 if overlap else 0.8).alias("confidence"))
    ctx.emit(has_evidence(told, found), found)


def _period(feed: Feed) -> tuple[str, str] | None:
    """The publication's dates, or the smallest and largest date text of the calendars."""
    told = tuple(feed.meta.get(k, "").replace("-", "") for k in ("from_date", "to_date"))
    if all(told):
        return told
    texts = [feed.table("calendar").select(F.trim(c).alias("d")) for c in PERIOD] if feed.has("calendar", *PERIOD) else []
    if feed.has("calendar_dates", "date"):
        texts.append(feed.table("calendar_dates").select(F.trim("date").alias("d")))
    if not texts:
        return None
    whole = texts[0]
    for t in texts[1:]:
        whole = whole.unionByName(t)
    lo, hi = whole.filter("d <> ''").agg(F.min("d"), F.max("d")).first()
    return (lo, hi) if lo else None


def _overlap(ctx: Context) -> tuple[str, str] | None:
    a, b = _period(ctx.old), _period(ctx.new)
    if not a or not b:
        return None
    start, end = max(a[0], b[0]), min(a[1], b[1])
    return (start, end) if start <= end else None


# Shapes


def polylines(feed: Feed, most: int, wanted: DataFrame | None = None) -> DataFrame:
    """(shape_id, line): points in order, thinned; of the shapes (shape_id) that are wanted, or of all."""
    if not feed.has("shapes", "shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"):
        return feed.spark.createDataFrame([], "shape_id string, line array<array<double>>")
    number = lambda c: F.col(c).try_cast("double")
    points = feed.table("shapes").select("shape_id", number("shape_pt_sequence").alias("i"), "_line", number("shape_pt_lat").alias("lat"), number("shape_pt_lon").alias("lon")).dropna(subset=["i", "lat", "lon"])
    points = points if wanted is None else points.join(wanted, "shape_id", "left_semi")
    lines = points.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_line", "lat", "lon"))), lambda p: F.array(p["lat"], p["lon"])).alias("line"))

    @F.pandas_udf("array<array<double>>")
    def thin(lines_: pd.Series) -> pd.Series:
        return lines_.map(lambda line: geo.thin([list(p) for p in line], most))

    return lines.withColumn("line", thin("line"))


def shapes(ctx: Context) -> None:
    """Shapes that trips were given in place of others, then shapes that changed themselves. Of pairs that could claim a difference the first does."""
    c = ctx.config["events"]["shape"]
    swaps = ctx.cells("trips", "shape_id").select(F.coalesce("old_value", F.lit("")).alias("o"), F.coalesce("new_value", F.lit("")).alias("n"), "rawdiff_id")
    swaps = ctx.scratch.put(swaps, "swaps")
    points = ctx.file("shapes").select("key0", "rawdiff_id")
    pairs = swaps.groupBy("o", "n").agg(F.count("*").alias("trips"))
    of_shape = pairs.select("o", "n", F.explode(F.array("o", "n")).alias("key0")).join(points, "key0").select("o", "n", "rawdiff_id")
    first = F.row_number().over(Window.partitionBy("rawdiff_id").orderBy("o", "n"))
    claimed = ctx.free(swaps.unionByName(of_shape)).withColumn("first", first).filter("first = 1").drop("first")
    claimed = ctx.scratch.put(claimed, "swap-claims")
    changed = ctx.free(points).join(claimed.select("rawdiff_id"), "rawdiff_id", "left_anti").select(F.col("key0").alias("o"), F.col("key0").alias("n"), "rawdiff_id")
    old, new = polylines(ctx.old, c["max_polyline_points"]), polylines(ctx.new, c["max_polyline_points"])

    @F.pandas_udf("struct<frechet_m:double,max_deviation_m:double,lat:double,lon:double>")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = [tuple(p) for p in x], [tuple(p) for p in y]
            far, at = geo.departure(x, y)
            out.append((round(geo.frechet(x, y), 1), round(far, 1), round(at[0], 6), round(at[1], 6)))
        return pd.DataFrame(out, columns=["frechet_m", "max_deviation_m", "lat", "lon"])

    both = claimed.select("o", "n").distinct().withColumn("swap", F.lit(True)).unionByName(changed.select("o", "n").distinct().withColumn("swap", F.lit(False)))
    line = lambda df, k: df.select(F.col("shape_id").alias(k), F.col("line").alias(f"{k}_line"))
    lined = both.join(line(old, "o"), "o").join(line(new, "n"), "n").withColumn("g", compare("o_line", "n_line")).select("o", "n", "swap", "g")
    both = both.join(lined, ["o", "n", "swap"], "left").join(pairs, ["o", "n"], "left")
    served = lambda feed, s: s.trips.filter(F.trim("shape_id") != "").select(F.col("shape_id").alias("n"), "family")
    fams = served(ctx.old, ctx.identity.old).unionByName(served(ctx.new, ctx.identity.new)).filter("family <> ''").groupBy("n").agg(sorted_set("family").alias("fams"))
    both = both.join(fams, "n", "left").withColumn("fams", F.coalesce("fams", F.array().cast("array<string>")))
    near = F.col("g.frechet_m") < c["frechet_threshold_m"]
    churn = F.col("swap") & F.coalesce(near, F.lit(False))
    geometry = dict(frechet_m=F.col("g.frechet_m"), max_deviation_m=F.col("g.max_deviation_m"), max_deviation_at=F.when(F.col("g").isNotNull(), F.array("g.lat", "g.lon")))
    key = F.concat_ws("\x1f", F.when(F.col("swap"), "0").otherwise("1"), "o", "n")
    told = both.select(
        key.alias("key"), F.when(churn, "TECHNICAL_ID_CHURN").otherwise("SHAPE_CHANGED").alias("type"),
        F.when(churn, json(entity="shape_id", route_families=F.col("fams"))).otherwise(json(shape_id=F.when(F.col("n") != "", F.col("n")).otherwise(F.col("o")), route_families=F.col("fams"))).alias("subject"),
        F.when(churn, json(**geometry, old_shape=F.col("o"), new_shape=F.col("n"), trips_changed=F.col("trips")))
        .when(F.col("swap"), json(**geometry, significant=True, old_shape=F.col("o"), new_shape=F.col("n"))).otherwise(json(**geometry, significant=~F.coalesce(near, F.lit(False)))).alias("quantification"),
        F.when(~F.col("swap"), F.when(F.coalesce(near, F.lit(False)), "info").otherwise("minor")).alias("severity"),
    )
    ctx.emit(told, claimed.select(F.concat_ws("\x1f", F.lit("0"), "o", "n").alias("key"), "rawdiff_id").unionByName(changed.select(F.concat_ws("\x1f", F.lit("1"), "o", "n").alias("key"), "rawdiff_id")))


# Fares, demand, signs, whole files


def fares(ctx: Context, most: int = 20) -> None:
    found = ctx.free(ctx.file("fare_attributes", "fare_rules")).select(F.lit("feed").alias("key"), "rawdiff_id")
    price = lambda feed, n: (feed.table("fare_attributes").select("fare_id", I.column(feed, "fare_attributes", "price").alias(n)) if feed.has("fare_attributes", "fare_id") else feed.spark.createDataFrame([], f"fare_id string, {n} string"))
    both = price(ctx.old, "o").join(price(ctx.new, "n"), "fare_id", "full_outer")
    o, n = F.col("o"), F.col("n")
    what = F.when(n.isNull(), "removed_fares").when(o.isNull(), "added_fares").when(o != n, "price_changes")
    shown = top_k(both.withColumn("what", what).filter("what IS NOT NULL"), ["what"], [F.col("fare_id")], most)  # no more than these leave a task
    listed = lambda w, **cols: F.array_sort(F.collect_list(F.when(F.col("what") == w, F.struct(F.col("fare_id"), *[F.col(v).alias(k) for k, v in cols.items()]))))
    lists = shown.agg(listed("removed_fares", price="o").alias("removed_fares"), listed("added_fares", price="n").alias("added_fares"), listed("price_changes", old_price="o", new_price="n").alias("price_changes"))
    size = F.when(F.col("kind").endswith("_bulk"), F.coalesce("old_value", "new_value").cast("long")).otherwise(1)
    rules = ctx.file("fare_rules").agg(F.coalesce(F.sum(size), F.lit(0)).alias("fare_rules_diffs"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    told = found.select("key").distinct().join(lists.join(rules)).select("key", F.lit("FARE_CHANGED").alias("type"), json(scope="feed").alias("subject"), json(fare_rules_diffs=F.col("fare_rules_diffs"), **{c: some(c) for c in ("removed_fares", "added_fares", "price_changes")}).alias("quantification"))
    ctx.emit(told, found)


def demand(ctx: Context) -> None:
    value = lambda c: F.trim(F.coalesce(c, F.lit(""))).isin("2", "3")  # noqa: E731  2: phone ahead, 3: arrange with the driver
    flags = ctx.cells("stop_times", "pickup_type", "drop_off_type").filter(value("new_value") | value("old_value")).withColumn("signal", F.lit("pickup/drop_off_type"))
    whole = flags.unionByName(ctx.cells("stop_times", "continuous_pickup", "continuous_drop_off").unionByName(ctx.cells("routes", "continuous_pickup", "continuous_drop_off")).withColumn("signal", F.lit("continuous_pickup/drop_off")))
    whole = whole.unionByName(ctx.file("booking_rules", "location_groups", "location_group_stops", "frequencies").withColumn("signal", F.col("file")))
    found = ctx.scratch.put(ctx.free(whole).select(F.lit("feed").alias("key"), "signal", "rawdiff_id"), "demand")
    n = F.size("signals")
    told = found.groupBy("key").agg(sorted_set("signal").alias("signals")).select("key", F.lit("DEMAND_RESPONSIVE_CHANGE").alias("type"), json(scope="feed").alias("subject"), json(signals=F.col("signals")).alias("quantification"), F.least(F.lit(0.9), 0.5 + 0.15 * (n - 1)).alias("confidence"), F.when(n >= 2, "major").otherwise("minor").alias("severity"))
    ctx.emit(told, found)


def headsigns(ctx: Context, samples: int = 5) -> None:
    family = ctx.trips().groupBy(F.col("trip_id").alias("key0")).agg(F.max_by("family", F.col("gen") == "new").alias("family"))
    rows = ctx.free(ctx.cells("trips", "trip_headsign").unionByName(ctx.cells("stop_times", "stop_headsign"))).join(family, "key0", "left").withColumn("key", F.coalesce("family", F.lit("")))
    text = lambda c: F.coalesce(c, F.lit(""))
    seen = rows.select("key", text("old_value").alias("o"), text("new_value").alias("n")).distinct()
    first = top_k(seen, ["key"], [F.col("o"), F.col("n")], samples).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("seen"))
    told = rows.groupBy("key").agg(F.count("*").alias("n")).join(first, "key").select("key", "n", F.transform("seen", lambda s: F.concat(s["o"], F.lit(" → "), s["n"])).alias("samples"))
    subject = F.when(F.col("key") != "", json(route_family=F.col("key"))).otherwise(json(scope="feed"))
    ctx.emit(told.select("key", F.lit("HEADSIGN_CHANGED").alias("type"), subject.alias("subject"), json(changed_fields=F.col("n"), samples=F.col("samples")).alias("quantification")), rows.select("key", "rawdiff_id"))


def whole_files(ctx: Context) -> None:
    for type_, files in (("FEED_VALIDITY_CHANGED", ["feed_info"]), ("AGENCY_INFO_CHANGED", ["agency", "agency_jp"]), ("TRANSLATION_CHANGED", ["translations"])):
        rows = ctx.file(*files)
        found = ctx.free(rows).select(F.lit("files").alias("key"), "rawdiff_id")
        last = rows.filter("kind = 'field_changed'").groupBy("column").agg(F.max_by(F.concat("old_value", F.lit(" → "), "new_value"), "seq").alias("said"))
        fields = last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "said")))).alias("fields"))
        quant = F.when(F.size("fields") > 0, json(changed_fields=F.col("fields")))
        told = found.select("key").distinct().join(fields).select("key", F.lit(type_).alias("type"), json(files=F.array(*[F.lit(f"{f}.txt") for f in files])).alias("subject"), quant.alias("quantification"))
        ctx.emit(told, found)


# Ids, scope, rest


def technical(ctx: Context) -> None:
    pairs = ctx.delta.pairs.filter("relation = 'exact' AND old_id <> new_id").join(ctx.delta.new.select(F.col("trip_id").alias("new_id"), "family", "day_type"), "new_id").withColumn("key", F.concat_ws("\x1f", "family", "day_type"))
    found = ctx.free(ctx.cascade(pairs.select("key", F.col("old_id").alias("trip_id")).union(pairs.select("key", "new_id"))))
    told = pairs.groupBy("key", "family", "day_type").agg(F.count("*").alias("n"))
    told = told.select("key", F.lit("TECHNICAL_ID_CHURN").alias("type"), json(route_family=F.col("family"), day_type=F.col("day_type"), entity="trip_id").alias("subject"), json(trip_pairs=F.col("n")).alias("quantification"))
    ctx.emit(has_evidence(told, found), found)


def generations(ctx: Context) -> None:
    """What belongs to services and trips that the comparison leaves out; with several periods, also the calendar rows of services that stay."""
    if ctx.scope is None:
        return
    by = lambda rows, ids, c: rows.join(ids.select(F.col(c).alias("key0")).distinct(), "key0", "left_semi").select("rawdiff_id")
    on_services = ctx.file("calendar", "calendar_dates")
    found = by(on_services, ctx.scope.excluded, "service_id").union(by(ctx.file("trips", "stop_times", "frequencies"), ctx.left_out, "trip_id"))
    if ctx.scope.several:
        found = found.union(by(on_services.filter(F.col("kind").isin("row_added", "row_removed")), ctx.scope.universe, "service_id"))
    found = ctx.free(found.distinct()).select(F.lit("feed").alias("key"), "rawdiff_id")
    told = ctx.scope.told.select(F.lit("feed").alias("key"), F.lit("GENERATION_SCOPE").alias("type"), json(scope="feed").alias("subject"), F.to_json(F.struct("*")).alias("quantification"))
    ctx.emit(told if ctx.scope.several else has_evidence(told, found), found)


CASCADE = (stops, routes, patterns, frequency, times, calendars, shapes, fares, demand, headsigns, whole_files, technical, generations)


def run(ctx: Context) -> tuple[DataFrame, DataFrame]:
    """(events, claims): events with event_id and event_seq in the order told, the residual's last; claims (rawdiff_id, event_seq, event_id)."""
    for rule in CASCADE:
        rule(ctx)
    left = ctx.free(ctx.diffs.select("file", "rawdiff_id")).select(F.col("file").alias("key"), "rawdiff_id")
    told = left.groupBy("key").agg(F.count("*").alias("n"))
    ctx.emit(told.select("key", F.lit("UNEXPLAINED_RESIDUAL").alias("type"), json(file=F.col("key")).alias("subject"), json(rawdiff_count=F.col("n")).alias("quantification")), left)
    events = evidence = None
    for i, (told, found) in enumerate(ctx.steps):
        told, found = told.withColumn("step", F.lit(i)), found.withColumn("step", F.lit(i))
        events = told if events is None else events.unionByName(told)
        evidence = found if evidence is None else evidence.unionByName(found)
    usual = F.create_map(*[F.lit(x) for t, (_, s) in EVENT_TYPES.items() for x in (t, s)])
    category = F.create_map(*[F.lit(x) for t, (k, _) in EVENT_TYPES.items() for x in (t, k)])
    events = global_rank(events, ctx.scratch, [F.col("step"), F.col("ord"), F.col("key")], "event_seq").withColumn("event_seq", F.col("event_seq") + 1)
    events = events.withColumn("event_id", F.format_string("evt_%06d", "event_seq"))
    events = events.withColumn("severity", F.coalesce("severity", F.element_at(usual, F.col("type")))).withColumn("category", F.element_at(category, F.col("type")))
    events = ctx.scratch.put(events, "events")
    claims = evidence.join(events.select("step", "key", "event_seq", "event_id"), ["step", "key"]).select("rawdiff_id", "event_seq", "event_id")
    return events, ctx.scratch.put(claims, "claims")
