"""Pages of route groups: which systems run there, in which directions, along which lines, and what changed, from the whole down to single times.

A page is a route group of the new generation, with old families where their trips went. Everything is keyed by page, so that Spark deals
pages, and legs of a page, to tasks; what runs as Python on one group sees a leg's distinct stop sequences, not its trips.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.axis import is_within, stop_axis
from ..functions.sequences import order_share
from ..operators.graphs import components, similar_sets
from ..operators.groups import folded
from ..sources.scratch import Scratch, global_rank
from . import identity as I
from .compare import Comparison
from .sheets import timetables

#: How directions are named.
LOOP, BOTH_WAYS, ONE_WAY, FIRST_AROUND, SECOND = "%s 循環", "%s ⇄ %s", "%s → %s", "%s（%s先回り）", "（2）"
LEG = ["page", "dgroup", "leg"]
#: Systems of a page up to which each is compared with each; those of larger pages meet by rare stops.
FEW_SYSTEMS = 200


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of pairs of common stops that stand in the same order; null with under two common stops."""
    return pd.Series([None if x is None or y is None else order_share(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def text(pattern: str, *parts: Column) -> Column:
    return F.format_string(pattern, *parts)


def family_pages(c: Comparison, scratch: Scratch) -> DataFrame:
    """(gen, family, page): a new family's own group; an old family's is that of its best accepted new family, or its own where it has none."""
    accepted = c.identity.family_edges.filter(F.col("method") != I.CANDIDATE)
    best = I.tied_first(accepted, I.longest_sequence(c.identity.old.patterns), I.longest_sequence(c.identity.new.patterns), scratch)
    own = lambda gen: c.identity.groups.filter(F.col("gen") == gen).select("family", "group")
    to = best.join(own("new").withColumnRenamed("family", "new_id"), "new_id", "left").select(F.col("old_id").alias("family"), F.coalesce("group", "new_id").alias("page"))
    old = own("old").join(to, "family", "left").select(F.lit("old").alias("gen"), "family", F.coalesce("page", "group").alias("page"))
    return scratch.put(old.unionByName(own("new").select(F.lit("new").alias("gen"), "family", F.col("group").alias("page"))), "pages")


@dataclass
class Systems:
    """systems is (page, system, family, direction, stops, status, trips_old, trips_new, trips, earliest); of says which a cluster belongs to (gen, cluster_id, page, system);
    patterns are all sequences of a system (page, system, seq); trips place every trip (gen, trip_id, page, system, day_type, departure, base_seq)."""

    systems: DataFrame
    of: DataFrame
    patterns: DataFrame
    trips: DataFrame


def systems(c: Comparison, pages: DataFrame, scratch: Scratch) -> Systems:
    """The systems of each page: new pattern clusters with the old ones that go over into them, several it may be, and old ones that end."""
    clusters, sequences, trips = None, None, None
    for gen, side, delta in (("old", c.identity.old, c.delta.old), ("new", c.identity.new, c.delta.new)):
        page = pages.filter(F.col("gen") == gen).select("gen", "family", "page")
        found = side.pattern_clusters.join(page, "family").select("gen", "page", "cluster_id", "family", "direction", F.col("base_seq").alias("stops"), "members")
        of = found.select("gen", "page", "cluster_id", F.explode("members").alias("pattern_id")).join(side.patterns.select("pattern_id", "family", "direction", "base_seq"), "pattern_id").drop("pattern_id")
        mine = delta.select("trip_id", "family", "direction", "base_seq", "day_type", "departure").join(of, ["family", "direction", "base_seq"]).drop("family", "direction")
        clusters, sequences, trips = (mine_ if all_ is None else all_.unionByName(mine_) for all_, mine_ in ((clusters, found.drop("members")), (sequences, of), (trips, mine)))
    clusters = scratch.put(clusters, "clusters")
    best = I.best(c.identity.pattern_edges, "old_id", c.config["events"]["accept_confidence"]).select(F.col("old_id").alias("cluster_id"), F.col("new_id").alias("to"))
    there = clusters.filter("gen = 'new'").select(F.col("cluster_id").alias("to"), "page", F.lit(True).alias("linked"))
    old = clusters.filter("gen = 'old'").join(best, "cluster_id", "left").join(there, ["to", "page"], "left")
    of_old = old.select("gen", "cluster_id", "page", F.when(F.col("linked"), F.col("to")).otherwise(F.concat(F.lit("old:"), "cluster_id")).alias("system"), "family", "direction", "stops")
    of_new = clusters.filter("gen = 'new'").select("gen", "cluster_id", "page", F.col("cluster_id").alias("system"), "family", "direction", "stops")
    whole = scratch.put(of_old.unionByName(of_new), "system-of")
    of = whole.select("gen", "cluster_id", "page", "system")
    placed = scratch.put(trips.join(of, ["gen", "cluster_id", "page"]).drop("cluster_id"), "page-trips")
    count = lambda gen: F.count(F.when(F.col("gen") == gen, 1))
    figures = placed.groupBy("page", "system").agg(count("old").alias("trips_old"), count("new").alias("trips_new"), F.count("*").alias("trips"), F.min("departure").alias("earliest"))
    # A system is drawn as its new cluster, or as the old one that it was.
    shown = whole.groupBy("page", "system").agg(F.min_by(F.struct("family", "direction", "stops"), F.struct("gen", "cluster_id")).alias("n"), F.collect_set("gen").alias("gens"))  # new before old
    status = F.when(F.size("gens") == 2, "continued").when(F.array_contains("gens", "new"), "added").otherwise("removed")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    told = shown.join(figures, ["page", "system"], "left").select("page", "system", "n.family", "n.direction", "n.stops", status.alias("status"), zero("trips_old"), zero("trips_new"), zero("trips"), "earliest")
    patterns = sequences.join(of, ["gen", "cluster_id", "page"]).select("page", "system", F.col("base_seq").alias("seq")).distinct()
    return Systems(scratch.put(told, "systems"), of, scratch.put(patterns, "system-patterns"), placed)


def alike(rows: DataFrame, least: float, shared: int, scratch: Scratch, few: int = FEW_SYSTEMS) -> DataFrame:
    """(a, b, stops_a, stops_b) with a < b: the nodes of a page with so many common stops and a similarity of at least ``least``, from rows (page, node, stops).

    Systems of a page meet each other in one join by page; on pages with more than ``few`` of them only those that share rare stops meet.
    """
    side = lambda df, n: df.select("page", F.col("node").alias(n), F.col("stops").alias(f"stops_{n}"), F.array_distinct("stops").alias(f"set_{n}"))
    crowded = rows.groupBy("page").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("page")
    some = crowded.limit(1).count() > 0
    small = (rows.join(crowded, "page", "left_anti") if some else rows).filter(F.size(F.array_distinct("stops")) >= shared)
    both, all_ = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    sized = F.least(F.size("set_a"), F.size("set_b")) >= least * F.greatest(F.size("set_a"), F.size("set_b")) - 1e-9
    pairs = side(small, "a").join(side(small, "b"), "page").filter((F.col("a") < F.col("b")) & sized & (both >= shared) & (both / (all_ - both) >= least - 1e-12))
    found = pairs.select("a", "b", "stops_a", "stops_b")
    if some:
        large = scratch.put(rows.join(crowded, "page", "left_semi"), "crowded")
        sets = large.select(F.col("node").alias("name"), "page", F.explode(F.array_distinct("stops")).alias("stop")).select("name", F.concat_ws("\x1f", "page", "stop").alias("item"))
        met = similar_sets(sets, least, scratch).filter(F.col("both") >= shared).select("a", "b")
        found = found.unionByName(met.join(side(large, "a").select("a", "stops_a"), "a").join(side(large, "b").select("b", "stops_b"), "b").select("a", "b", "stops_a", "stops_b"))
    return found


def direction_groups(rows: DataFrame, c: dict, scratch: Scratch) -> DataFrame:
    """(page, system, stops, trips, dgroup, leg, kind, label, leg_label, canonical) from rows (page, system, stops, trips, earliest).

    Systems of a page belong together where their stops are alike and most common stops stand in the same order, or most in the opposite one; what lies
    between keeps them apart. The system with the most trips gives the forward direction, and those that run against it are its reverse leg; a
    loop has legs too, each named by where it goes first.
    """
    key = lambda name: F.concat_ws("\x1f", "page", name)
    rows = scratch.put(rows.select("page", "system", "stops", "trips", "earliest", key("system").alias("node")), "systems")
    met = scratch.put(alike(rows, c["direction_pair_jaccard"], c["direction_min_shared_stops"], scratch), "alike")
    shares = met.select("stops_a", "stops_b").distinct().withColumn("share", agreement("stops_a", "stops_b"))  # each distinct pair of sequences once
    turned, same = F.col("share") <= c["direction_reversed_max_agreement"], F.col("share") >= c["direction_same_min_agreement"]
    labels = components(met.join(shares.filter(turned | same), ["stops_a", "stops_b"]).select("a", "b"), scratch)
    grouped = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    whole = Window.partitionBy("page", "component").orderBy(F.desc("trips"), F.col("earliest").asc_nulls_last(), "system").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    led = grouped.repartition("page").withColumn("canonical", F.first("stops").over(whole))
    other = lambda name: F.when(F.col("stops") != F.col("canonical"), F.col(name))  # noqa: E731 - a sequence isn't compared with itself
    against = F.coalesce(agreement(other("stops"), other("canonical")) <= c["direction_reversed_max_agreement"], F.lit(False))
    legs = scratch.put(led.withColumn("leg", F.when(against, "reverse").otherwise("forward")), "legs")
    legs = legs.repartition("page").withColumn("back", F.first(F.when(F.col("leg") == "reverse", F.col("stops")), ignorenulls=True).over(whole))

    first, last = F.get("canonical", F.lit(0)), F.get("canonical", F.size("canonical") - 1)
    loop, two = first == last, F.col("back").isNotNull()
    kind = F.when(loop, "loop").when(two, "bidirectional").otherwise("one_way")
    label = F.when(loop, text(LOOP, first)).when(two, text(BOTH_WAYS, first, last)).otherwise(text(ONE_WAY, first, last))

    def around(mine: str, other: str) -> Column:
        """Named by the first stop at which one way around is unlike the other."""
        own = F.transform(F.arrays_zip(F.col(mine).alias("x"), F.col(other).alias("y")), lambda p: F.when((p["x"] != p["y"]) & (p["x"] != first), p["x"]))
        named = F.get(F.filter(own, lambda x: x.isNotNull()), F.lit(0))
        return F.when(named.isNull(), label).otherwise(text(FIRST_AROUND, label, named))

    ahead, back = around("canonical", "back"), around("back", "canonical")
    forward = F.when(loop & two, ahead).otherwise(F.when(loop, label).otherwise(text(ONE_WAY, first, last)))
    reverse = F.when(loop & two, F.when(ahead == back, F.concat(back, F.lit(SECOND))).otherwise(back)).otherwise(text(ONE_WAY, last, first))
    named = legs.withColumn("kind", kind).withColumn("label", label).withColumn("leg_label", F.when(F.col("leg") == "forward", forward).otherwise(reverse))
    # The busiest group of a page is dg0. All of it is dealt by page, so these windows need no further shuffle.
    group = Window.partitionBy("page", "component")
    sized = named.withColumn("all", F.sum("trips").over(group)).withColumn("least", F.min(F.struct(F.col("system").startswith("old:").alias("old"), "system")).over(group))
    place = F.dense_rank().over(Window.partitionBy("page").orderBy(F.desc("all"), "least")) - 1
    numbered = sized.withColumn("dgroup", F.concat(F.lit("dg"), place.cast("string")))
    return scratch.put(numbered.select("page", "system", "stops", "trips", "earliest", "dgroup", "leg", "kind", "label", "leg_label", "canonical"), "direction-groups")


def maximal(sequences: DataFrame, by: list[str]) -> DataFrame:
    """The distinct rows (by, seq) whose sequence is no subsequence of another of their group. Only sequences that hold the first stop of one are compared with it."""
    rows = sequences.select(*by, "seq").distinct()
    inner = rows.filter(F.size("seq") > 0).withColumn("stop", F.get("seq", F.lit(0)))
    outer = rows.select(*by, F.col("seq").alias("outer"), F.explode(F.array_distinct("seq")).alias("stop"))
    held = inner.join(outer, [*by, "stop"]).filter((F.size("outer") > F.size("seq")) & is_within(F.col("seq"), F.col("outer")))
    return rows.join(held.select(*by, "seq").distinct(), [*by, "seq"], "left_anti")


def axes(sequences: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis): one stop axis for the distinct sequences (by, seq) of each group."""
    fold = lambda rows: [(list(stop_axis(seq for (seq,) in rows)),)]
    return folded(sequences.select(*by, "seq").distinct(), by, fold, f"axis {dict(sequences.dtypes)['seq']}")


def leg_views(groups: DataFrame, patterns: DataFrame, scratch: Scratch) -> DataFrame:
    """(page, dgroup, leg, leg_label, axis, lines): of each leg the axis of all its sequences, and as lines those that no other holds. patterns is (page, system, seq)."""
    legs = groups.groupBy(*LEG).agg(F.min("leg_label").alias("leg_label"))
    of = scratch.put(patterns.join(groups.select(*LEG, "system"), ["page", "system"]).select(*LEG, "seq").distinct(), "leg-patterns")
    lines = maximal(of, LEG).groupBy(*LEG).agg(F.array_sort(F.collect_list("seq")).alias("lines"))
    return scratch.put(legs.join(axes(of, LEG), LEG, "left").join(lines, LEG, "left"), "leg-views")


def axis_rows(views: DataFrame, groups: DataFrame) -> DataFrame:
    """(page, dgroup, kind, label, stops): a row for each leg, or one for both where one axis is the other's mirror image."""
    both = groups.groupBy("page", "dgroup").agg(F.min("label").alias("label"))
    of = views.groupBy("page", "dgroup").agg(F.max(F.when(F.col("leg") == "forward", F.col("axis"))).alias("there"), F.max(F.when(F.col("leg") == "reverse", F.col("axis"))).alias("back"))
    mirrored = of.filter(F.col("there") == F.reverse("back")).select("page", "dgroup", "there")
    pair = mirrored.join(both, ["page", "dgroup"]).select("page", "dgroup", F.lit("pair").alias("kind"), "label", F.col("there").alias("stops"))
    legs = views.join(mirrored, ["page", "dgroup"], "left_anti").select("page", "dgroup", F.lit("leg").alias("kind"), F.col("leg_label").alias("label"), F.col("axis").alias("stops"))
    return pair.unionByName(legs)


def key_stops(groups: DataFrame, patterns: DataFrame, calls: DataFrame, hub_pages: int) -> DataFrame:
    """(page, stop, tier): 1 for the ends of a direction group's busiest system and stops of so many pages, 2 for the ends of any sequence and where lines of the forward leg part or
    meet. patterns is (page, system, seq), calls (page, stop) over all pages."""
    ends = lambda seq: F.array(F.get(seq, F.lit(0)), F.get(seq, F.size(seq) - 1))
    terminal = groups.select("page", F.explode(ends(F.col("canonical"))).alias("stop")).select("page", "stop", F.lit(1).alias("tier"))
    # Ends and steps of sequences are dealt by page once; what is counted of them needs no further shuffle.
    of = patterns.filter(F.size("seq") > 0).join(groups.select("page", "system", "dgroup", "leg"), ["page", "system"]).select("page", "dgroup", "leg", "seq").repartition("page")
    n = F.size("seq")
    steps = F.when((F.col("leg") == "forward") & (n > 1), F.arrays_zip(F.slice("seq", 1, n - 1).alias("a"), F.slice("seq", 2, n).alias("b"))).otherwise(F.array())
    told = lambda end, a, b: F.struct(F.lit(end).alias("end"), a.alias("a"), b.alias("b"))
    facts = F.concat(F.transform(ends(F.col("seq")), lambda x: told(True, x, x)), F.transform(steps, lambda s: told(False, s["a"], s["b"])))
    distinct = of.select("page", "dgroup", F.explode(facts).alias("f")).select("page", "dgroup", "f.end", "f.a", "f.b").distinct()
    at = lambda way, stop: F.struct(F.lit(way).alias("way"), F.col(stop).alias("stop"))
    sides = distinct.select("page", "dgroup", F.explode(F.when(F.col("end"), F.array(at("end", "a"))).otherwise(F.array(at("out", "a"), at("in", "b")))).alias("s"))
    parted = sides.groupBy("page", "dgroup", "s.way", "s.stop").agg(F.count("*").alias("n")).filter("way = 'end' OR n > 1").select("page", "stop", F.lit(2).alias("tier"))
    hubs = calls.distinct().groupBy("stop").agg(F.count("*").alias("n")).filter(F.col("n") >= hub_pages).select("stop")
    hub = groups.select("page", F.explode("stops").alias("stop")).distinct().join(hubs, "stop").select("page", "stop", F.lit(1).alias("tier"))
    return terminal.unionByName(parted).unionByName(hub).groupBy("page", "stop").agg(F.min("tier").alias("tier"))


def change_units(moved: DataFrame, totals: DataFrame, announced: DataFrame, full: float) -> DataFrame:
    """(page, added_stops, removed_stops, affected_trips, system_trips, coverage, full_coverage, told_above, systems): one row for each change of stops that a reader sees.

    moved is (page, system, old_seq, new_seq), a row for each pair of trips whose stops differ, the system null where it is none; totals is (page, system, trips), announced
    (page, system) of systems that are told of as a whole. All pairs that gain and lose the same stops are one change, whatever their direction and system;
    it covers the trips of every system it is in, counted once.
    """
    gained = lambda a, b: F.array_sort(F.array_distinct(F.array_except(a, b)))
    keyed = moved.select("page", "system", gained(F.col("new_seq"), F.col("old_seq")).alias("added_stops"), gained(F.col("old_seq"), F.col("new_seq")).alias("removed_stops"))
    by_system = keyed.groupBy("page", "added_stops", "removed_stops", "system").agg(F.count("*").alias("affected"))
    known = by_system.join(totals.select("page", "system", "trips"), ["page", "system"], "left").join(announced.select("page", "system", F.lit(True).alias("above")).distinct(), ["page", "system"], "left")
    all_of = F.coalesce("trips", "affected")
    unit = known.groupBy("page", "added_stops", "removed_stops").agg(
        F.sum("affected").alias("affected_trips"), F.sum(all_of).alias("system_trips"), F.array_sort(F.collect_list("system")).alias("systems"),
        (F.coalesce(F.min(F.when(F.col("trips").isNotNull(), F.coalesce("above", F.lit(False)))), F.lit(False))).alias("told_above"),
    )
    share = F.when(F.col("system_trips") > 0, F.col("affected_trips") / F.col("system_trips"))
    return unit.select("page", "added_stops", "removed_stops", "affected_trips", "system_trips", F.round(share, 3).alias("coverage"), F.coalesce(share >= full, F.lit(False)).alias("full_coverage"), "told_above", "systems")


def summary_levels(totals: DataFrame, systems: DataFrame, units: DataFrame, day_labels: DataFrame, notes: DataFrame, least_trips: int = 2) -> DataFrame:
    """(page, level, kind, subject, lost, gained): what changed of a page, from the whole down to minutes.

    Level 1 is a page that comes or goes, and then nothing else is told of it; 2 systems of at least so many trips that come or go; 3 changes of stops, with the trips that have
    them and those that could (lost, gained); 4 trips lost and gained by day type; 5 trips whose times alone changed, and other notes. totals is (page, old, new), systems (page,
    system, status, trips_old, trips_new), day_labels (page, day_type, label, trips), notes (page, kind, count).
    """
    row = lambda df, level, kind, subject, lost, gained: df.select("page", F.lit(level).alias("level"), kind.alias("kind"), subject.cast("string").alias("subject"), lost.cast("long").alias("lost"), gained.cast("long").alias("gained"))
    none, zero = F.lit(None), F.lit(0)
    comes, goes = (F.col("old") == 0) & (F.col("new") > 0), (F.col("new") == 0) & (F.col("old") > 0)
    whole = row(totals.filter(comes | goes), 1, F.when(comes, "added").otherwise("removed"), none, F.col("old"), F.col("new"))
    new, old = (F.col("status") == "added") & (F.col("trips_new") >= least_trips), (F.col("status") == "removed") & (F.col("trips_old") >= least_trips)
    out = row(systems.filter(new | old), 2, F.when(new, "system_added").otherwise("system_removed"), F.col("system"), F.col("trips_old"), F.col("trips_new"))
    stops = F.concat_ws(" ", F.transform("added_stops", lambda s: F.concat(F.lit("+"), s)), F.transform("removed_stops", lambda s: F.concat(F.lit("-"), s)))
    out = out.unionByName(row(units, 3, F.when(F.col("told_above"), "stops_of_new_systems").otherwise("stops"), stops, F.col("affected_trips"), F.col("system_trips")))
    of = lambda *labels: F.coalesce(F.sum(F.when(F.col("label").isin(*labels), F.col("trips"))), zero)
    by_day = day_labels.groupBy("page", "day_type").agg(of("removed").alias("lost"), of("added").alias("gained")).filter("lost > 0 OR gained > 0")
    out = out.unionByName(row(by_day, 4, F.lit("trips"), F.col("day_type"), F.col("lost"), F.col("gained")))
    times = day_labels.filter(F.col("label").isin("retimed", "retimed_minor")).groupBy("page", "label").agg(F.sum("trips").alias("n"))
    out = out.unionByName(row(times, 5, F.col("label"), none, F.col("n"), F.col("n"))).unionByName(row(notes, 5, F.col("kind"), none, F.col("count"), F.col("count")))
    return whole.unionByName(out.join(whole.select("page").distinct(), "page", "left_anti"))


def headlines(levels: DataFrame, day_labels: DataFrame, day_totals: DataFrame, most: int = 3) -> DataFrame:
    """(page, rank, kind, lost, gained): a page's first facts: that it comes or goes; systems; routes of trips; numbers of trips; times; or else notes. day_totals is
    (page, day_type, old, new, unsure), unsure days saying nothing of numbers."""
    fact = lambda df, order, kind: df.withColumn("order", F.lit(order)).withColumn("kind", kind).select("page", "order", "kind", F.col("lost").cast("long").alias("lost"), F.col("gained").cast("long").alias("gained"))
    by_page = lambda df, lost, gained: df.groupBy("page").agg(lost.alias("lost"), gained.alias("gained"))
    n = F.count("*")
    out = fact(levels.filter("level = 1"), 1, F.concat(F.lit("route_"), "kind"))
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    out = out.unionByName(fact(by_page(levels.filter("level = 2"), of("system_removed"), of("system_added")), 2, F.lit("systems")))
    trips = F.sum("trips")
    routed = by_page(day_labels.filter(F.col("label").isin("rerouted", "shortened", "extended")), trips, trips)
    out = out.unionByName(fact(routed, 3, F.lit("reroute")))
    counted = by_page(day_totals.filter("old <> new AND NOT coalesce(unsure, false)"), F.sum("old"), F.sum("new"))
    out = out.unionByName(fact(counted, 4, F.lit("trips")))
    for order, label in ((5, "retimed"), (6, "retimed_minor")):
        out = out.unionByName(fact(by_page(day_labels.filter(F.col("label") == label), trips, trips), order, F.lit(label)))
    noted = by_page(levels.filter("level = 5").filter(~F.col("kind").isin("retimed", "retimed_minor")), n, F.sum("gained"))
    out = out.unionByName(fact(noted, 7, F.lit("notes_only")))
    known = Window.partitionBy("page")
    has = lambda order: F.max(F.col("order") == order).over(known)
    # A page that comes or goes is told of by that alone; small moves of times only without large ones, notes only without anything.
    fits = (F.col("order") == 1) | ~has(1) & ((F.col("order") != 6) | ~has(5)) & ((F.col("order") != 7) | (F.min("order").over(known) == 7))
    place = F.row_number().over(known.orderBy("order"))
    return out.withColumn("fits", fits).filter("fits").withColumn("rank", place).filter(F.col("rank") <= most).select("page", "rank", "kind", "lost", "gained")


def page_timetables(c: Comparison, found: Systems, groups: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The timetables of all pages, columns (page, dgroup, leg, label, ...) as ``sheets.timetables`` gives them.

    labels is (gen, trip_id, label) of the trips that are shown, pairs (page, label, old_id, new_id, relation) as ``cells.page_pairs`` tells them. A pair stands in the leg of its new trip.
    """
    leg = groups.select("page", "system", "dgroup", "leg")
    placed = found.trips.join(leg, ["page", "system"]).join(labels, ["gen", "trip_id"], "left_semi")
    clock = F.transform("times", lambda t: F.when(t["dep"] != "", t["dep"]).otherwise(t["arr"]))
    times = lambda df, g: df.select(F.col("trip_id").alias(f"{g}_id"), F.col("base_seq").alias(f"{g}_seq"), clock.alias(f"{g}_times"))
    whole = pairs.join(times(c.delta.old, "old"), "old_id", "left").join(times(c.delta.new, "new"), "new_id", "left")
    of = lambda g: placed.filter(F.col("gen") == g).select("page", F.col("trip_id").alias(f"{g}_id"), F.col("dgroup").alias(f"{g}_dgroup"), F.col("leg").alias(f"{g}_leg"))
    told = whole.join(of("old"), ["page", "old_id"], "left").join(of("new"), ["page", "new_id"], "left")
    rows = told.select("page", F.coalesce("new_dgroup", "old_dgroup").alias("dgroup"), F.coalesce("new_leg", "old_leg").alias("leg"), "label", "old_id", "new_id", "old_seq", "new_seq", "old_times", "new_times")
    return timetables(rows.filter(F.col("dgroup").isNotNull()), [*LEG, "label"], c.config["presentation"]["sheet_max_gap_per_trip"])


def ranked(listed: DataFrame, scratch: Scratch) -> DataFrame:
    """(page, rank, state) in the order of state and key, from rows (page, state, key)."""
    return global_rank(listed, scratch, [F.col("state"), F.col("key"), F.col("page")]).select("page", (F.col("rank") + 1).alias("rank"), "state")
