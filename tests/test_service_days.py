"""Days of service, generations by name, the command line, and families that tie."""

import datetime as dt
from types import SimpleNamespace as Stub

import feeds
import pytest
from pyspark.sql import functions as F

from gantline.__main__ import main
from gantline.plans import calendars, identity, service_days
from gantline.sources import config, generations
from gantline.sources.feed import FeedError, read_feed
from gantline.sources.scratch import Scratch

CALENDAR = feeds.BASE["calendar"].split("\n")[0] + "\n"


def test_weekdays_of_day_types(spark):
    want = {"weekday": [0, 1, 2, 3, 4], "saturday": [5], "sunday_holiday": [6], "weekend": [5, 6], "daily": list(range(7)), "dow_1010001": [0, 2, 6], "irregular": None, "inactive": None, "dow_10": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", service_days.day_set(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == want


def feed_of(spark, tmp_path, name, scratch, dates, late=0):
    """Week days from 5 to 18 April 2027, a Sunday service that dates alone tell, and a service of one day."""
    trips = "route_id,service_id,trip_id,trip_headsign\nbay,week,w,Cape\nbay,sun,s,Cape\nbay,fair,f,Cape\n"
    path = feeds.write(
        tmp_path, name, calendar=CALENDAR + "week,1,1,1,1,1,0,0,20270405,20270418\nsun,0,0,0,0,0,0,1,20270405,20270418\n", trips=trips,
        stop_times=feeds.times(("w", 480 + late, list(feeds.PIERS)), ("s", 540, list(feeds.PIERS)), ("f", 600, list(feeds.PIERS))),
        calendar_dates="service_id,date,exception_type\n" + "".join(f"{s},{d},{k}\n" for s, d, k in dates), feed_info="feed_publisher_name,feed_start_date,feed_end_date\nBay,20270405,20270418\n",
    )
    feed = read_feed(spark, path, scratch)
    return feed, scratch.put(calendars.day_types(feed, config.load()), "types")


def days(rows):
    """(kind, gen) and each of its days."""
    out = {}
    for r in rows:
        assert (r["end"] - r["start"]).days + 1 == r["days"]
        out.setdefault((r["kind"], r["gen"]), []).extend(r["start"] + dt.timedelta(i) for i in range(r["days"]))
    return {k: sorted(d.day for d in v) for k, v in out.items()}


def test_notes_on_days(spark, tmp_path):
    scratch = Scratch(spark, "days")
    # In the old one Tuesday the 13th runs as a Sunday and the 9th not at all; in the new one the fair runs on the 9th beside the rest.
    old, old_types = feed_of(spark, tmp_path, "old", scratch, [("sun", "20270413", 1), ("week", "20270413", 2), ("week", "20270409", 2), ("fair", "20270410", 1)])
    new, new_types = feed_of(spark, tmp_path, "new", scratch, [("fair", "20270409", 1)])
    assert {r["service_id"]: r["day_type"] for r in old_types.collect()} == {"week": "weekday", "sun": "sunday_holiday", "fair": "irregular"}
    families = identity.route_families(old)
    clusters = identity.stop_clusters(old, families, 100)
    side = lambda feed: Stub(trips=scratch.put(identity.trip_sequences(feed, families, clusters), "trips"))
    groups = families.select("family").distinct().withColumn("group", F.lit("Bay")).withColumn("gen", F.lit("old"))
    c = Stub(types={"old": old_types, "new": new_types}, identity=Stub(old=side(old), new=side(new), groups=groups))
    got = days(service_days.notes(c, old, new, scratch).collect())
    assert got == {("swap", "old"): [13], ("no_service", "old"): [9, 17], ("no_service", "new"): [10, 17], ("changed", "both"): [9, 10, 13]}
    assert service_days.notes(c, old, new, scratch, most_days=13) is None
    assert [tuple(r) for r in service_days.special_dates(c, "old", old).collect()] == [("Bay", dt.date(2027, 4, 10))]
    (fair,) = service_days.special_services(old, old_types).collect()
    assert (fair["service_id"], fair["trips"], fair["dates"], fair["first_date"], fair["replaces_regular"]) == ("fair", 1, 1, dt.date(2027, 4, 10), False)
    instead, types = feed_of(spark, tmp_path, "instead", scratch, [("fair", "20270409", 1), ("week", "20270409", 2)])
    assert [r["replaces_regular"] for r in service_days.special_services(instead, types).collect()] == [True]
    # The same trips at other times: every day of the week service differs.
    late, late_types = feed_of(spark, tmp_path, "late", scratch, [("fair", "20270409", 1)], late=5)
    c = Stub(types={"old": new_types, "new": late_types}, identity=Stub(old=side(new), new=side(late)))
    assert days(service_days.notes(c, new, late, scratch).collect())[("changed", "both")] == [5, 6, 7, 8, 9, 12, 13, 14, 15, 16]


def test_generations_by_name(spark, tmp_path):
    assert sorted(["prev_2", "x", "current", "next_1", "prev_10", "prev_x"], key=generations.recency) == ["next_1", "current", "prev_2", "prev_10", "x", "prev_x"]
    for name in ("prev_1", "current", "prev_2"):
        feeds.write(tmp_path, name)
    known = generations.in_folder(spark, f"file://{tmp_path}")
    assert list(known) == ["current", "prev_1", "prev_2"] and generations.pair(known)[0].endswith("/prev_1.zip") and generations.pair(known, "prev_2", "prev_1")[1].endswith("/prev_1.zip")
    for old, new, says in (("prev_3", "current", "prev_3"), ("current", "prev_1", "not older"), ("current", "current", "not older")):
        with pytest.raises(FeedError, match=says):
            generations.pair(known, old, new)


def test_command_line(spark, tmp_path, capsys):
    feeds.write(tmp_path, "prev_1")
    feeds.write(tmp_path, "current", stops=feeds.BASE["stops"].replace("Mill Pier", "Old Mill Pier"), trips=feeds.BASE["trips"].replace("bay,week,dusk,Cape\n", ""), stop_times=feeds.BASE["stop_times"].split("dusk")[0])
    folder, out = f"file://{tmp_path}", f"file://{tmp_path}/out"
    assert main(["check", "--folder", folder], spark) == 0 and "stop_times\t12" in capsys.readouterr().out
    assert main(["compare", "--folder", folder, "--markdown", "--out", out], spark) == 0
    said = capsys.readouterr().out
    assert "trips.txt\t1" in said and "SERVICE_REDUCED: 1" in said and "differences explained" in said
    assert spark.read.json(f"{out}/rawdiffs").count() == 6 and spark.read.json(f"{out}/events").filter("type = 'SERVICE_REDUCED'").count() == 1
    assert main(["identity", f"{folder}/prev_1.zip", f"{folder}/current.zip"], spark) == 0 and "route_family\t1\t1\t1\t1" in capsys.readouterr().out
    assert main(["compare", "one"], spark) == 2 and "two feeds" in capsys.readouterr().err


def test_ties_go_by_the_order_of_stops_then_names(spark):
    edges = spark.createDataFrame([("a1", "x1", 0.8, "c"), ("a1", "x2", 0.8, "c"), ("a1", "x3", 0.7, "c"), ("b1", "y1", 0.6, "c"), ("b1", "b2", 0.6, "c"), ("c1", "zx", 0.9, "c"), ("c1", "zy", 0.9, "c"), ("d1", "zx", 0.9, "c"), ("d1", "zy", 0.9, "c")], "old_id string, new_id string, confidence double, method string")
    seqs = lambda **s: spark.createDataFrame(list(s.items()), "family string, seq array<string>")
    old = seqs(a1=["p", "q", "r"], b1=["s"], c1=["t", "u"], d1=["t", "u"])
    new = seqs(x1=["r", "q", "p"], x2=["p", "q", "r"], x3=["p", "q", "r"], y1=["s"], zx=["t", "u"], zy=["t", "u"])
    got = {r["old_id"]: r["new_id"] for r in identity.tied_first(edges, old, new).collect()}
    # Against the order of stops; by name, as one shared stop tells no order; the smaller id, and for the next old family the one that is left.
    assert got == {"a1": "x2", "b1": "b2", "c1": "zx", "d1": "zy"}
