"""A feed that bundles two periods against the one that follows it."""

import feeds
from pyspark.sql import functions as F

from gantline.plans.compare import compare
from gantline.sources.feed import read_feed
from gantline.sources.scratch import Scratch



def feed(tmp_path, name, *parts):
    """Parts are (service, start, end, prefix, hours)."""
    return feeds.write(
        tmp_path, name, calendar=feeds.BASE["calendar"].split("\n")[0] + "\n" + "".join(f"{s},1,1,1,1,1,0,0,{a},{b}\n" for s, a, b, _, _ in parts),
        trips="route_id,service_id,trip_id,trip_headsign\n" + "".join(f"bay,{s},{p}{h},Cape\n" for s, _, _, p, hours in parts for h in hours),
        stop_times=feeds.times(*((f"{p}{h}", 60 * h, list(feeds.PIERS)) for _, _, _, p, hours in parts for h in hours)),
    )


def test_a_bundled_next_period_is_left_out(spark, tmp_path):
    scratch = Scratch(spark, "scope")
    old = feed(tmp_path, "old", ("A", "20260401", "20260710", "a", (8, 9)), ("B", "20260711", "20261231", "b", (8, 9, 10)))
    new = feed(tmp_path, "new", ("B", "20260711", "20261231", "b", (8, 9, 10)))
    result = compare(read_feed(spark, old, scratch), read_feed(spark, new, scratch), scratch=scratch)
    kinds = {r["type"]: r for r in result.events.collect()}
    # The old period's two trips are found again in the new one and one comes on top; the bundled period isn't counted.
    assert "SERVICE_INCREASED" in kinds and "SERVICE_REDUCED" not in kinds
    assert sorted(r["new_id"] for r in result.delta.pairs.collect()) == ["b8", "b9"] and [r["trip_id"] for r in result.delta.added.collect()] == ["b10"]
    # The next period begins on a Saturday; its first day of service is the Monday after.
    assert '"switch_date":"20260713"' in kinds["GENERATION_SCOPE"]["quantification"]
    assert result.delta.old.count() == 2 and result.explained().first()["ratio"] == 1
