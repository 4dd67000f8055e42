"""From two feeds to change events and the ledger of what they explain."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger
from ..sources.config import load
from ..sources.feed import Feed
from ..sources.scratch import Scratch
from . import calendars, identity, rules, scope, trips, worlds
from .differences import enumerate_diffs


@dataclass
class Comparison:
    diffs: DataFrame
    events: DataFrame
    claims: DataFrame
    identity: identity.Identity
    delta: trips.TripDelta
    types: dict[str, DataFrame]
    config: dict
    worlds: dict[str, DataFrame] | None = None
    dates: dict[str, DataFrame] | None = None

    def explained(self) -> DataFrame:
        """(total, explained, ratio); the residual's claims explain nothing."""
        return ledger.accounting(self.diffs, self.claims.join(self.events.filter("type <> 'UNEXPLAINED_RESIDUAL'").select("event_id"), "event_id", "left_semi"))

    def residual(self) -> DataFrame:
        told = self.claims.join(self.events.filter("type <> 'UNEXPLAINED_RESIDUAL'").select("event_id"), "event_id", "left_semi")
        return ledger.residual_by(self.diffs, told, "file")


def compare(old: Feed, new: Feed, config: dict | None = None, scratch: Scratch | None = None) -> Comparison:
    config = config or load()
    scratch = scratch or Scratch(old.spark, "compare")
    feeds = {"old": old, "new": new}
    by_feed = lambda f: dict(zip(feeds, scratch.together(*[functools.partial(f, g) for g in feeds]), strict=True))

    def matched() -> tuple[dict[str, DataFrame], identity.Identity, DataFrame]:
        types = by_feed(lambda g: scratch.put(calendars.day_types(feeds[g], config), f"{g}-day-types"))
        found = identity.build(old, new, types["old"], types["new"], config, scratch)
        return types, found, scratch.put(identity.blocks(found, scratch), "blocks")

    diffs, (types, found, blocks) = scratch.together(lambda: enumerate_diffs(old, new, scratch, config["diff0"]["bulk_row_threshold"]), matched)
    sides = {"old": found.old.trips, "new": found.new.trips}
    dates = by_feed(lambda g: scratch.put(calendars.service_dates(feeds[g], types[g]), f"{g}-dates"))
    of = by_feed(lambda g: worlds.day_worlds(types[g], dates[g], scratch))
    several = any(of[g].filter("n_worlds > 1").limit(1).count() for g in of)
    left = scope.switch(feeds, sides, of, dates, scratch) if several else None
    left = left or scope.window(feeds, sides, blocks, types, config["events"]["windows"]["carryover_coverage_min"], scratch)
    delta = trips.match(scope.keep(sides["old"], "old", left), scope.keep(sides["new"], "new", left), blocks, config["matching"], scratch)
    out = scope.left_out(sides["old"], "old", left).union(scope.left_out(sides["new"], "new", left)).distinct() if left else None
    ctx = rules.Context(old, new, config, diffs, found, delta, types, scratch, worlds=of if several else None, dates=dates, scope=left, left_out=out)
    events, claims = rules.run(ctx)
    if unknown := ledger.unknown(diffs, claims).limit(1).count():
        raise AssertionError(f"{unknown} claims are on differences that don't exist")
    return Comparison(diffs, events, claims, found, delta, types, config, of if several else None, dates)


def by_route_group(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Events with the route group of their family: the new generation's where both know it."""
    of = lambda g: groups.filter(F.col("gen") == g).select(F.col("family").alias("_f"), F.col("group").alias(f"_{g}"))
    named = events.withColumn("_f", F.get_json_object("subject", "$.route_family"))
    return named.join(of("new"), "_f", "left").join(of("old"), "_f", "left").withColumn("route_group", F.coalesce("_new", "_old")).drop("_f", "_new", "_old")
