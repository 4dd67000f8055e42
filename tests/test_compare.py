"""One pair of feeds that holds many changes, compared once."""

import feeds
import pytest
from pyspark.sql import functions as F

from gantline.functions import columns
from gantline.plans import report, timetables
from gantline.plans.compare import compare
from gantline.sources.feed import read_feed
from gantline.sources.scratch import Scratch

STOPS = "stop_id,stop_name,stop_lat,stop_lon,wheelchair_boarding\n" + "".join(f"S{i},Stop {n},{35 + i / 100},{139 + i / 100},0\n" for i, n in enumerate("ほてらまきみふぬ"))
ROUTES = "route_id,agency_id,route_short_name,route_long_name,route_type\nR1,A,10,Ten,3\nR2,A,20,Twenty,3\nR3,A,30,Thirty,3\n"


def trips(rows):
    return "route_id,service_id,trip_id,trip_headsign\n" + "".join(f"{r},{s},{t},{h}\n" for r, s, t, h in rows)


def times(rows):
    out = "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    for trip, start, stops in rows:
        for i, s in enumerate(stops):
            m = start + 5 * i
            out += f"{trip},{m // 60:02d}:{m % 60:02d}:00,{m // 60:02d}:{m % 60:02d}:00,S{s},{i + 1}\n"
    return out


OLD = dict(
    stops=STOPS, routes=ROUTES, trips=trips([("R1", "week", f"a{i}", "East") for i in range(4)] + [("R2", "week", f"b{i}", "West") for i in range(3)] + [("R3", "week", "c0", "North")]),
    stop_times=times([(f"a{i}", 420 + 60 * i, [0, 1, 2, 3]) for i in range(4)] + [(f"b{i}", 450 + 90 * i, [4, 5, 6]) for i in range(3)] + [("c0", 600, [1, 4, 7])]),
    fare_attributes="fare_id,price\nF1,200\nF2,300\n", feed_info="feed_publisher_name,feed_version\nTown,1\n",
)
NEW = dict(
    stops=STOPS.replace("S3,Stop ま,35.03,139.03,0", "S3,Stop New,35.03,139.03,1"), routes=ROUTES.replace("R3,A,30,Thirty,3\n", "R4,A,40,Forty,3\n"),
    # a0, a1 stay (a1 under another id), a2 is 10 minutes later, a3 is gone; b's run on to stop 7; 40 is new
    trips=trips([("R1", "week", "a0", "East"), ("R1", "week", "x1", "East"), ("R1", "week", "a2", "Far East")] + [("R2", "week", f"b{i}", "West") for i in range(3)] + [("R4", "week", "d0", "South")]),
    stop_times=times([("a0", 420, [0, 1, 2, 3]), ("x1", 480, [0, 1, 2, 3]), ("a2", 550, [0, 1, 2, 3])] + [(f"b{i}", 450 + 90 * i, [4, 5, 6, 7]) for i in range(3)] + [("d0", 700, [0, 7])]),
    fare_attributes="fare_id,price\nF1,210\nF3,300\n", feed_info="feed_publisher_name,feed_version\nTown,2\n",
)


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    at, scratch = tmp_path_factory.mktemp("pair"), Scratch(spark, "pair")
    # The renamed stop is one place in both generations, so its name is mapped back to keep a's sequences the same.
    new = dict(NEW, stops=NEW["stops"].replace("Stop New", "Stop ま 2"))
    return compare(read_feed(spark, feeds.write(at, "old", **OLD), scratch), read_feed(spark, feeds.write(at, "new", **new), scratch), scratch=scratch)


def events(result, type_):
    return [r.asDict() for r in result.events.filter(F.col("type") == type_).orderBy("event_seq").collect()]


def test_every_difference_is_told(result):
    total, explained, _ = result.explained().first()
    residual = result.residual().agg(F.coalesce(F.sum("residual"), F.lit(0))).first()[0]
    assert total == result.diffs.count() > 0 and explained + residual == total
    assert result.claims.select("rawdiff_id").distinct().count() == total


def test_events(result):
    types = {r["type"] for r in result.events.select("type").distinct().collect()}
    assert {"STOP_RENAMED", "ACCESSIBILITY_CHANGED", "ROUTE_DISCONTINUED", "ROUTE_ADDED", "PATTERN_EXTENDED", "SERVICE_REDUCED", "TIMETABLE_SHIFTED", "TECHNICAL_ID_CHURN", "FARE_CHANGED", "HEADSIGN_CHANGED", "FEED_VALIDITY_CHANGED"} <= types
    (gone,), (come,) = events(result, "ROUTE_DISCONTINUED"), events(result, "ROUTE_ADDED")
    assert '"30"' in gone["subject"] and '"40"' in come["subject"] and gone["severity"] == "major"
    (longer,) = events(result, "PATTERN_EXTENDED")
    assert '"trip_count":3' in longer["quantification"] and '"end":"end"' in longer["quantification"]
    assert any('"shift_min":10' in e["quantification"] and '"uniform":true' in e["quantification"] for e in events(result, "TIMETABLE_SHIFTED"))
    (fare,) = events(result, "FARE_CHANGED")
    assert '"price_changes":[{"fare_id":"F1","old_price":"200","new_price":"210"}]' in fare["quantification"]


def test_trips(result):
    pairs = {(r["old_id"], r["new_id"]): r["relation"] for r in result.delta.pairs.collect()}
    assert pairs[("a0", "a0")] == pairs[("a1", "x1")] == "exact" and pairs[("a2", "a2")] == pairs[("b0", "b0")] == "modified"
    assert sorted(r["trip_id"] for r in result.delta.removed.collect()) == ["a3", "c0"] and [r["trip_id"] for r in result.delta.added.collect()] == ["d0"]


def test_reports(result):
    relations = {(r["entity"], r["relation"]): r["n"] for r in report.mapping(result).groupBy("entity", "relation").agg(F.count("*").alias("n")).collect()}
    assert relations[("trip", "exact")] == 1 and relations[("trip", "id_churn")] == 1 and relations[("trip", "modified")] == 4 and relations[("route", "removed")] == relations[("route", "added")] == 1
    matrix = report.band_matrix(result)
    whole = matrix.filter("direction IS NULL AND system IS NULL").agg(F.sum("old_count"), F.sum("new_count")).first()
    assert tuple(whole) == (8, 7) and report.day_totals(result).first()["old_count"] == 8
    assert report.coverage(result).agg(F.sum("differences")).first()[0] == result.diffs.count()
    assert report.get_events(result, severity="major", most=2).first()["total"] == result.events.count() and report.map_ids(result, "x1").count() == 1
    text = report.markdown(result)
    assert "ROUTE_ADDED: 1" in text and "## Unexplained" in text
    assert "\n### 10\n" in text and "- SERVICE_REDUCED (" in text and "| weekday | 09:00-16:00 | 2 | 1 |" in text


def test_timetables_side_by_side(result):
    labels = {(r["old_id"], r["new_id"]): r["label"] for r in timetables.trip_labels(result).collect()}
    assert labels == {("a0", "a0"): "unchanged", ("a1", "x1"): "unchanged", ("a2", "a2"): "retimed", ("b0", "b0"): "extended", ("b1", "b1"): "extended", ("b2", "b2"): "extended", ("a3", None): "removed", ("c0", None): "removed", (None, "d0"): "added"}
    assert {r["label"] for r in timetables.trip_labels(result, 10).filter("old_id = 'a2'").collect()} == {"retimed_minor"}
    cells = timetables.day_cells(result).collect()
    old, new = result.delta.old, result.delta.new
    stops = lambda df: df.agg(F.sum(F.size("base_seq"))).first()[0]
    assert sum(r["old_place"] is not None for r in cells) == stops(old) and sum(r["new_place"] is not None for r in cells) == stops(new)
    assert {r["moved_min"] for r in cells if r["old_id"] == "a2"} == {10.0} and {r["moved_min"] for r in cells if r["old_id"] == "a0"} == {0.0}
    assert sum(r["old_id"] == "b0" and r["old_place"] is None for r in cells) == 1 and all(r["group"] for r in cells)
    assert timetables.label_counts(result).agg(F.sum("trips")).first()[0] == 9


def test_stop_changes(result):
    told = {(r["kind"], r["name"]): r for r in timetables.stop_changes(result).collect()}
    (renamed,) = [r for (kind, _), r in told.items() if kind == "STOP_RENAMED"]
    assert renamed["was"] == "Stop ま" and renamed["lat"] and renamed["groups"]


def test_order_of_day_types(spark):
    names = ["weekday", "saturday", "saturday@2", "saturday@10", "sunday_holiday", "weekend", "daily", "dow_1100000", "dow_1010000", "dow_0000110", "irregular", "inactive", "other"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "t string")
    assert [r["t"] for r in df.orderBy(columns.day_order(F.col("t"))).collect()] == names


def test_pages_of_a_comparison(result, spark):
    from gantline.plans import cells, pages

    scratch = Scratch(spark, "pages")
    of = pages.family_pages(result, scratch)
    assert {(r["gen"], r["family"]): r["page"] for r in of.collect()} == {("old", "10"): "10", ("old", "20"): "20", ("old", "30"): "30", ("new", "10"): "10", ("new", "20"): "20", ("new", "40"): "40"}
    found = pages.systems(result, of, scratch)
    told = {r["page"]: (r["status"], r["trips_old"], r["trips_new"], len(r["stops"])) for r in found.systems.collect()}
    assert told == {"10": ("continued", 4, 3, 4), "20": ("continued", 3, 3, 4), "30": ("removed", 1, 0, 3), "40": ("added", 0, 1, 2)}
    groups = pages.direction_groups(found.systems, result.config["presentation"], scratch)
    assert rows_of(groups, "page", "dgroup", "leg", "kind") == [(p, "dg0", "forward", "one_way") for p in ("10", "20", "30", "40")]
    views = {r["page"]: len(r["axis"]) for r in pages.leg_views(groups, found.patterns, scratch).collect()}
    assert views == {"10": 4, "20": 4, "30": 3, "40": 2}
    labels = found.trips.select("gen", "trip_id", F.col("day_type").alias("label"))
    shown = found.trips.select("gen", "page", F.col("day_type").alias("label"), "trip_id")
    pairs = scratch.put(cells.page_pairs(shown, result.delta.pairs), "shown")
    assert cells.unlike_totals(shown, pairs).count() == 0
    table = pages.page_timetables(result, found, groups, labels, pairs)
    ten = [(r["old_id"], r["new_id"], r["changed"]) for r in table.filter("page = '10'").orderBy("number").collect()]
    assert ten == [("a0", "a0", []), ("a1", "x1", []), ("a2", "a2", [0, 1, 2, 3]), ("a3", None, [])]
    (longer, *_) = table.filter("page = '20'").orderBy("number").collect()
    assert longer["old_times"][3] is None and longer["new_times"][3] == "07:45:00" and longer["changed"] == [3]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_the_whole_presentation(result, spark, tmp_path):
    from gantline.plans import presentation

    shown = presentation.build(result, Scratch(spark, "shown"))
    assert [(r["page"], r["state"]) for r in shown.contents.orderBy("rank").collect()] == [("30", 0), ("40", 0), ("10", 1), ("20", 1)]
    levels = {(r["page"], r["level"], r["kind"], r["subject"], r["lost"], r["gained"]) for r in shown.levels.collect()}
    assert {x for x in levels if x[1] == 1} == {("30", 1, "removed", None, 1, 0), ("40", 1, "added", None, 0, 1)} and not {x for x in levels if x[0] in ("30", "40") and x[1] > 1}
    assert ("10", 4, "trips", "weekday", 1, 0) in levels and ("10", 5, "retimed", None, 1, 1) in levels
    (unit,) = [r for r in shown.units.collect()]
    assert (unit["page"], len(unit["added_stops"]), unit["removed_stops"], unit["affected_trips"], unit["coverage"], unit["full_coverage"]) == ("20", 1, [], 3, 1.0, True)
    heads = rows_of(shown.headlines, "page", "rank", "kind", "lost", "gained")
    assert ("20", 1, "reroute", 3, 3) in heads and ("10", 1, "trips", 4, 3) in heads and ("30", 1, "route_removed", 1, 0) in heads
    assert shown.unlike_totals.count() == 0 and shown.cells is None
    presentation.write(shown, f"file://{tmp_path}/shown")
    assert spark.read.json(f"file://{tmp_path}/shown/timetables").count() == shown.timetables.count() == 4 + 3 + 1 + 1


@pytest.fixture(scope="module")
def digested(result, spark, tmp_path_factory):
    from gantline.plans import digest, presentation

    at, scratch = tmp_path_factory.mktemp("digest"), Scratch(spark, "digest-test")
    old, new = (read_feed(spark, feeds.write(at, g, **files), scratch) for g, files in (("old", OLD), ("new", dict(NEW, stops=NEW["stops"].replace("Stop New", "Stop ま 2")))))
    return old, new, digest.build(result, presentation.build(result, scratch), old, new, scratch)


def test_the_whole_digest(result, digested, tmp_path):
    from gantline.plans import digest

    old, new, d = digested
    t = d.totals.first()
    assert (t["pages"], t["pages_changed"], t["total"]) == (4, 4, result.diffs.count()) and t["new_or_gone"] == round(2 / 15, 4) and d.checks.count() == 0
    briefs = {r["gen"]: r for r in d.briefs.collect()}
    assert briefs["old"]["version"] == "1" and briefs["new"]["version"] == "2" and briefs["old"]["agencies"] == ["Bay Ferry"]
    statuses = {(r["page"], r["status"]): r["n"] for r in d.columns.groupBy("page", "status").agg(F.count("*").alias("n")).collect()}
    assert statuses == {("10", "retimed"): 1, ("10", "removed"): 1, ("20", "rerouted"): 3, ("30", "removed"): 1, ("40", "added"): 1}
    assert {(r["page"], r["unchanged"], r["id_changed"]) for r in d.column_counts.collect()} == {("10", 1, 1), ("20", 0, 0), ("30", 0, 0), ("40", 0, 0)}
    assert {r["stops_added"] for r in d.columns.filter("page = '20'").collect()} == {1}
    files = {r["file"]: r for r in d.files.collect()}
    assert (files["trips.txt"]["rows_old"], files["trips.txt"]["rows_new"], files["trips.txt"]["status"]) == (8, 7, "continued") and files["routes.txt"]["row_added"] == files["routes.txt"]["row_removed"] == 1
    assert sum(r["count"] for r in d.types.collect()) == result.events.count() and {r["type"] for r in d.feed_events.collect()} >= {"FARE_CHANGED", "FEED_VALIDITY_CHANGED"}
    parts = {r["part"]: r["n"] for r in report.event_parts(result).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(parts.values()) == result.events.count() and d.feed_events.count() == parts[1] and sum(r["count"] for r in d.others.collect()) == parts.get(4, 0)
    text = digest.markdown(d)
    assert "pages: 4, changed: 4" in text and "### 30" in text and "- gone, 1 trips" in text and "- renamed: Stop ま -> Stop ま 2" in text and "| trips.txt | 8 | 7 |" in text
    short = digest.markdown(d, most_pages=1, most_stops=0)
    assert "and 3 more pages that changed" in short and "more renamed stops" in short
    ten = digest.route_markdown(result, d, "10")
    assert "retimed, 4 times changed, before 09:00 (trip a2 -> a2)" in ten and "removed (trip a3 -> -)" in ten and "- unchanged 1, other id only 1" in ten and "Route ids: R1 -> R1" in ten
    assert "3 of 3 trips" in digest.route_markdown(result, d, "20")
    with pytest.raises(KeyError, match="10"):
        digest.route_markdown(result, d, "no such page")
    digest.write(d, f"file://{tmp_path}/digest")
    assert result.diffs.sparkSession.read.json(f"file://{tmp_path}/digest/columns").count() == d.columns.count()


def test_chapters_of_the_report(result):
    text = report.markdown(result)
    assert "- New routes: 40" in text and "- Discontinued routes: 30" in text and "- Renamed stops: Stop ま -> Stop ま 2" in text and "- Fares changed" in text
    assert "## Stops" in text and "| STOP_RENAMED |" in text and "- Changed ids that mean nothing: " in text and "- Validity of the feed: " in text
    assert "-" + report.more(report.route_digest(result).count(), 1) in report.markdown(result, 1)


def test_lines_of_changed_shapes(spark, tmp_path):
    lines = lambda way: "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\n" + "".join(f"L,{35 + (way if 0 < i < 9 else 0)},{139 + i / 100},{i}\n" for i in range(10)) + "M,35,139,1\nM,35,140,2\n"
    shaped = "route_id,service_id,trip_id,shape_id\n" + "".join(f"bay,week,{t},L\n" for t in ("dawn", "noon", "dusk"))
    scratch = Scratch(spark, "lines")
    old, new = (read_feed(spark, feeds.write(tmp_path, n, shapes=lines(way), trips=shaped), scratch) for n, way in (("old", 0), ("new", 0.02)))
    c = compare(old, new, scratch=scratch)
    (event,) = events(c, "SHAPE_CHANGED")
    assert '"significant":true' in event["quantification"]
    drawn = {(r["generation"], r["shape_id"]): r["geojson"] for r in report.shape_lines(c, old, new).collect()}
    assert set(drawn) == {("old", "L"), ("new", "L")} and '"coordinates":[[139.0,35.0],[139.01,35.02]' in drawn[("new", "L")] and '[139.01,35.0]' in drawn[("old", "L")]
