"""On which days a feed runs, and how that changed: days with another day's timetable, without any, or with other trips than before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ymd
from ..operators.graphs import date_runs
from ..sources.feed import Feed
from ..sources.scratch import Scratch
from . import calendars
from .compare import Comparison

SPECIAL = ("irregular", "inactive")


def day_set(day_type: Column) -> Column:
    """The weekdays (0 Monday) of a day type, as an array; null where it names none."""
    numbers = lambda *days: F.array(*map(F.lit, days))
    bits = F.split(F.regexp_extract(day_type, "^dow_([01]{7})$", 1), "")
    named = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: F.get(bits, i) == "1")
    out = F.when(day_type.rlike("^dow_[01]{7}$"), named)
    for name, days in (("weekday", range(5)), ("daily", range(7)), ("weekend", (5, 6)), ("saturday", (5,)), ("sunday_holiday", (6,))):
        out = out.when(day_type == name, numbers(*days))
    return out


def running(feed: Feed, types: DataFrame, most_days: int) -> tuple[tuple[str, str], DataFrame] | None:
    """The feed's window, and (service_id, day_type, day) of services that have trips, within it. None of windows that aren't known or are longer than ``most_days``."""
    window = calendars.snapshot_window(feed)
    lo, hi = (ymd(F.lit(w)) for w in window) if window else (None, None)
    if not window or not 0 <= (length := feed.spark.range(1).select(F.datediff(hi, lo)).first()[0]) < most_days:
        return None
    used = feed.table("trips").select("service_id").distinct()
    dates = calendars.service_dates(feed, types).join(used, "service_id", "left_semi").filter(F.col("day").between(lo, hi))
    return window, dates.join(types, "service_id", "left").withColumn("day_type", F.coalesce("day_type", F.lit("irregular"))).distinct()


def per_day(runs: DataFrame) -> DataFrame:
    """(day, services, swap, special): swap where week-long types run, but none of that weekday; special where an irregular service runs."""
    regular = ~F.col("day_type").isin(*SPECIAL)
    fits = F.coalesce(F.array_contains(day_set(F.col("day_type")), F.weekday("day")), F.lit(False))
    return runs.groupBy("day").agg(
        F.array_sort(F.collect_set("service_id")).alias("services"), (F.max(regular) & ~F.max(regular & fits)).alias("swap"), F.max(F.col("day_type") == "irregular").alias("special")
    )


def all_days(feed: Feed, lo: str, hi: str) -> DataFrame:
    return feed.spark.range(1).select(F.explode(F.sequence(ymd(F.lit(lo)), ymd(F.lit(hi)))).alias("day"))


def trip_contents(trips: DataFrame) -> DataFrame:
    """(service_id, content, n): how often a service runs a trip of the same direction, stops and times."""
    content = F.xxhash64(F.to_json(F.struct("direction", "base_seq", "times")))
    return trips.groupBy("service_id", content.alias("content")).agg(F.count("*").alias("n"))


def changed_days(old: DataFrame, new: DataFrame, days: DataFrame, old_trips: DataFrame, new_trips: DataFrame, scratch: Scratch) -> DataFrame:
    """(day) of those whose trips aren't the same multiset in both. Each distinct pair of sets of services is compared once, however many days have it."""
    none = F.array().cast("array<string>")
    side = lambda df, name: df.select("day", F.col("services").alias(name))
    both = days.join(side(old, "old"), "day", "left").join(side(new, "new"), "day", "left").select("day", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    both = scratch.put(both.withColumn("pair", F.sha2(F.to_json(F.struct("old", "new")), 256)), "days")
    pairs = both.select("pair", "old", "new").dropDuplicates(["pair"])
    of = lambda name, trips, sign: pairs.select("pair", F.explode(name).alias("service_id")).join(trip_contents(trips), "service_id").select("pair", "content", (sign * F.col("n")).alias("n"))
    apart = of("old", old_trips, -1).unionByName(of("new", new_trips, 1)).groupBy("pair", "content").agg(F.sum("n").alias("n")).filter("n <> 0").select("pair").distinct()
    return both.join(apart, "pair", "left_semi").select("day")


def notes(c: Comparison, old: Feed, new: Feed, scratch: Scratch, most_days: int = 550) -> DataFrame | None:
    """(kind, gen, start, end, days): runs of days that a reader should know of.

    swap and no_service are told of each generation, changed of the days that both are valid in. None where a window isn't known or is too long.
    """
    feeds, found = {"old": old, "new": new}, {}
    for gen, feed in feeds.items():
        if (known := running(feed, c.types[gen], most_days)) is None:
            return None
        found[gen] = (known[0], scratch.put(per_day(known[1]), f"{gen}-service-days"))
    rows = None
    for gen, (window, days) in found.items():
        none = all_days(feeds[gen], *window).join(days, "day", "left_anti")
        for kind, which in (("swap", days.filter("swap").select("day")), ("no_service", none)):
            told = which.select(F.lit(kind).alias("kind"), F.lit(gen).alias("gen"), "day")
            rows = told if rows is None else rows.unionByName(told)
    (a, old_days), (b, new_days) = found["old"], found["new"]
    lo, hi = max(a[0], b[0]), min(a[1], b[1])
    if lo <= hi:
        sides = c.identity.old.trips, c.identity.new.trips
        changed = changed_days(old_days, new_days, all_days(old, lo, hi), *sides, scratch)
        rows = rows.unionByName(changed.select(F.lit("changed").alias("kind"), F.lit("both").alias("gen"), "day"))
    return date_runs(rows, ["kind", "gen"])


def special_dates(c: Comparison, gen: str, feed: Feed) -> DataFrame:
    """(route_group, day) of a route group's irregular services."""
    dates = calendars.service_dates(feed, c.types[gen]).join(c.types[gen].filter("day_type = 'irregular'").select("service_id"), "service_id", "left_semi")
    groups = c.identity.groups.filter(F.col("gen") == gen).select("family", "group")
    side = c.identity.old if gen == "old" else c.identity.new
    of = side.trips.select("service_id", "family", "route_id").distinct().join(groups, "family", "left")
    name = F.coalesce("group", F.when(F.col("family") != "", F.col("family")), "route_id")
    return of.join(dates, "service_id").select(name.alias("route_group"), "day").distinct()


def special_services(feed: Feed, types: DataFrame) -> DataFrame:
    """(service_id, day_type, trips, dates, first_date, last_date, replaces_regular) of irregular and inactive services that have trips.

    A service replaces the regular one where all its days are taken out of some other.
    """
    trips = feed.table("trips").groupBy("service_id").agg(F.count("*").alias("trips"))
    named = types.filter(F.col("day_type").isin(*SPECIAL)).join(trips, "service_id")
    dates = calendars.service_dates(feed, types).join(named.select("service_id"), "service_id", "left_semi").distinct()
    removed = calendars.exceptions(feed, "2").select(F.col("service_id").alias("other"), ymd(F.col("text")).alias("day"))
    # Of each day two services that don't run are enough to tell of any service whether another doesn't.
    out = removed.groupBy("day").agg(F.min("other").alias("a"), F.max("other").alias("b"))
    marked = dates.join(out, "day", "left").withColumn("instead", F.coalesce((F.col("a") != F.col("service_id")) | (F.col("b") != F.col("service_id")), F.lit(False)))
    told = marked.groupBy("service_id").agg(F.count("*").alias("dates"), F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.min("instead").alias("instead"))
    return named.join(told, "service_id", "left").select(
        "service_id", "day_type", "trips", F.coalesce("dates", F.lit(0)).alias("dates"), "first_date", "last_date", F.coalesce("instead", F.lit(False)).alias("replaces_regular")
    )
