"""What a comparison leaves out where a feed bundles timetables of several periods.

Either a generation switch is found (of every regular day type with several worlds, the old feed's last world is in the
new feed and its first isn't, and the other way round), or services are left out that don't run in the common window or
that belong to another unit of it than the one compared, if what they serve is served without them. A feed of one period has
no scope, and nothing changes for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.feed import Feed
from ..sources.scratch import Scratch
from .calendars import comparison_units, snapshot_window

IRREGULAR = ("irregular", "inactive")


@dataclass
class Scope:
    """(gen, service_id) that are left out and that stay, and one row that says so."""

    excluded: DataFrame
    universe: DataFrame
    told: DataFrame
    several: bool


def multiset(*columns: str):
    """A fingerprint of a group's rows whatever their order: sums of two hashes, and the count. No group's rows meet in one place."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return F.concat_ws("|", part(1).cast("string"), part(2).cast("string"), F.count("*").cast("string"))


def known_services(feeds: dict[str, Feed]) -> DataFrame:
    out = None
    for gen, feed in feeds.items():
        for name in ("calendar", "calendar_dates"):
            if feed.has(name, "service_id"):
                rows = feed.table(name).select(F.lit(gen).alias("gen"), "service_id")
                out = rows if out is None else out.unionByName(rows)
    return out.distinct() if out is not None else next(iter(feeds.values())).spark.createDataFrame([], "gen string, service_id string")


def scope_row(spark, window, primary, identical, excluded: DataFrame, trips: dict[str, DataFrame]) -> DataFrame:
    counts = excluded.agg(*[F.count(F.when(F.col("gen") == g, 1)).alias(f"{g}_excluded_services") for g in ("old", "new")])
    periods = lambda rows: F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in rows]) if rows else F.array().cast("array<array<string>>")
    row = counts.select(F.array(*map(F.lit, window)).alias("comparison_window"), periods(primary).alias("primary_periods"), periods(identical).alias("identical_periods"), "*")
    for g in ("old", "new"):
        out = trips[g].join(excluded.filter(F.col("gen") == g).select("service_id"), "service_id", "left_semi")
        row = row.join(out.agg(F.count("*").alias(f"{g}_excluded_trips")))
    return row


def switch(feeds: dict[str, Feed], trips: dict[str, DataFrame], worlds: dict[str, DataFrame], dates: dict[str, DataFrame], scratch: Scratch) -> Scope | None:
    rows = None
    for gen in feeds:
        world = worlds[gen].filter(~F.col("day_type").isin(*IRREGULAR))
        days = world.join(dates[gen], "service_id").groupBy("day_type", "world").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
        print_ = trips[gen].join(world.select("service_id", "world"), "service_id").groupBy("world").agg(multiset("family", "direction", "base_seq", "times").alias("digest"))
        services = world.groupBy("world").agg(F.collect_set("service_id").alias("services"))
        part = days.join(print_, "world").join(services, "world").select(F.lit(gen).alias("gen"), "day_type", "world", "lo", "hi", "digest", "services")
        rows = part if rows is None else rows.unionByName(part)
    labels: dict[str, dict[str, list]] = {}
    for r in rows.orderBy("lo", "world").collect():  # a row for each world: services of regular day types, grouped
        labels.setdefault(r["day_type"], {"old": [], "new": []})[r["gen"]].append(r)
    several = {k: v for k, v in labels.items() if len(v["old"]) > 1 or len(v["new"]) > 1}
    if not several:
        return None
    left_out, kept, turned = [], {"old": [], "new": []}, []
    for sides in several.values():
        # Each side's stays: the old one's first world, the new one's last. The others must be, and the ones that stay must not be, on the other side.
        for gen, other, stays, end in (("old", "new", 0, -1), ("new", "old", -1, 0)):
            mine, theirs = sides[gen], {w["digest"] for w in sides[other]}
            if not mine or not theirs:
                return None
            if len(mine) > 1:
                if mine[end]["digest"] not in theirs or mine[stays]["digest"] in theirs:
                    return None
                out = mine[1:] if gen == "old" else mine[:-1]
                left_out += [(gen, s) for w in out for s in w["services"]]
                turned.append(mine[1]["lo"] if gen == "old" else mine[-1]["lo"])
            kept[gen].append(mine[stays])
    a, b = (snapshot_window(f) for f in feeds.values())
    if not left_out or not a or not b or max(a[0], b[0]) > min(a[1], b[1]):
        return None
    spark = feeds["old"].spark
    excluded = scratch.put(spark.createDataFrame(left_out, "gen string, service_id string").distinct(), "excluded")
    text = lambda d: d.strftime("%Y%m%d")
    primary = [(text(min(w["lo"] for w in kept[g])), text(max(w["hi"] for w in kept[g]))) for g in ("old", "new")]
    told = scope_row(spark, (max(a[0], b[0]), min(a[1], b[1])), primary, [], excluded, trips)
    universe = known_services(feeds).join(excluded, ["gen", "service_id"], "left_anti")
    return Scope(excluded, universe, told.withColumn("switch_date", F.lit(text(min(turned)))), True)


def window(feeds: dict[str, Feed], trips: dict[str, DataFrame], blocks: DataFrame, types: dict[str, DataFrame], least: float, scratch: Scratch) -> Scope | None:
    spark = feeds["old"].spark
    common, units = comparison_units(feeds["old"], feeds["new"])
    if common is None:
        return None
    units = scratch.put(units.withColumn("unit", F.row_number().over(Window.orderBy("start"))), "units")  # as many as calendar boundaries
    active = scratch.put(units.select("unit", F.explode(F.array(*[F.struct(F.lit(g).alias("gen"), F.col(f"{g}_services").alias("s")) for g in ("old", "new")])).alias("x")).select("unit", "x.gen", F.explode("x.s").alias("service_id")), "active")
    any_active = active.select("gen", "service_id").distinct()
    serves = None
    for gen in feeds:
        rows = trips[gen].join(blocks.filter(F.col("gen") == gen).select("family", "block"), "family", "left").select(F.lit(gen).alias("gen"), "service_id", F.coalesce("block", "family").alias("block")).distinct()
        serves = rows if serves is None else serves.unionByName(rows)
    serves = scratch.put(serves, "serves")
    regular = types["old"].withColumn("gen", F.lit("old")).unionByName(types["new"].withColumn("gen", F.lit("new"))).filter(~F.col("day_type").isin(*IRREGULAR)).select("gen", "service_id")

    def covered(rows: DataFrame, by: DataFrame) -> DataFrame:
        """Regular services of rows whose blocks are served, in a large enough share, by the services of ``by``."""
        have = serves.join(by, ["gen", "service_id"], "left_semi").select("gen", "block").distinct().withColumn("hit", F.lit(1))
        of = rows.join(regular, ["gen", "service_id"], "left_semi").join(serves, ["gen", "service_id"]).join(have, ["gen", "block"], "left")
        return of.groupBy("gen", "service_id").agg((F.count("hit") / F.count("*")).alias("share")).filter(F.col("share") >= least).select("gen", "service_id")

    idle = covered(known_services(feeds).join(any_active, ["gen", "service_id"], "left_anti"), any_active)
    listed = units.orderBy("unit").collect()
    whole = [u for u in listed if all(set(u["old_services"]) >= set(v["old_services"]) and set(u["new_services"]) >= set(v["new_services"]) for v in listed)]
    primary, identical, carried = (whole or listed)[0], [], None
    if not whole and len(listed) > 1:
        sums = None
        for gen in feeds:
            part = trips[gen].join(active.filter(F.col("gen") == gen).select("unit", "service_id"), "service_id").groupBy("unit").agg(multiset("family", "direction", "day_type", "base_seq", "times").alias(gen))
            sums = part if sums is None else sums.join(part, "unit", "full_outer")
        changed = {r["unit"] for r in sums.filter("NOT (old <=> new)").collect()}
        identical = [u for u in listed if u["unit"] not in changed]
        primary = max([u for u in listed if u["unit"] in changed] or listed, key=lambda u: (u["days"], u["start"]))
        if changed:
            mine = active.filter(F.col("unit") == primary["unit"]).select("gen", "service_id")
            carried = covered(any_active.join(mine, ["gen", "service_id"], "left_anti"), mine)
    excluded = scratch.put(idle if carried is None else idle.unionByName(carried).distinct(), "excluded")
    if not excluded.limit(1).count():
        return None
    spans = lambda us: [(i["lo"].strftime("%Y%m%d"), i["hi"].strftime("%Y%m%d")) for u in us for i in u["intervals"]]
    told = scope_row(spark, common, spans([primary]), spans(identical), excluded, trips)
    return Scope(excluded, any_active.join(excluded, ["gen", "service_id"], "left_anti"), told, len(listed) > 1)


def keep(trips: DataFrame, gen: str, scope: Scope | None) -> DataFrame:
    return trips if scope is None else trips.join(scope.excluded.filter(F.col("gen") == gen).select("service_id"), "service_id", "left_anti")


def left_out(trips: DataFrame, gen: str, scope: Scope) -> DataFrame:
    return trips.join(scope.excluded.filter(F.col("gen") == gen).select("service_id"), "service_id", "left_semi").select("trip_id")
