"""Digests: names of pages, tables of files and columns against plain Python, streams of generations, and lines on the map."""

import random

import pytest

from gantline.functions import geo
from gantline.plans import digest, names
from gantline.streaming.generations import KeyedChanges, latest


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_names_of_pages(spark):
    rng = random.Random(5)
    rows = sorted({(f"c{rng.randrange(6)}", rng.choice(("old", "new")), f"f{rng.randrange(14)}") for _ in range(90)})
    at = {g: {f"f{i}": f"p{rng.randrange(5)}" for i in range(14) if rng.random() < 0.8} for g in ("old", "new")}
    pages = {g: spark.createDataFrame(sorted(at[g].items()), "family string, page string") for g in at}
    got = names.renamed(spark.createDataFrame(rows, "component string, side string, family string"), pages["old"], pages["new"])
    want = set()
    for c in {r[0] for r in rows}:
        old, new = ({f for k, s, f in rows if k == c and s == side} for side in ("old", "new"))
        for page in {at["new"].get(f, f) for f in new}:
            want |= {(page, "former" if at["old"].get(f, f) == page else "related", f) for f in old - new}
    assert rows_of(got, "page", "kind", "name") == sorted(want, key=str) and {k for _, k, _ in want} == {"former", "related"}
    none = spark.createDataFrame([], "component string, side string, family string")
    assert names.renamed(none, pages["old"], pages["new"]).count() == 0


def test_similar_names_and_contradictions(spark):
    edges = spark.createDataFrame([("a", "x", 0.4), ("a", "y", 0.4), ("a", "z", 0.3), ("b", "x", 1.0), ("a", "w", 0.2), ("a", "x", 0.1), ("q", "v", 0.9)], "old_id string, new_id string, confidence double")
    groups = spark.createDataFrame([("old", "a", "A"), ("old", "b", "B"), ("new", "x", "X"), ("new", "y", "Y")], "gen string, family string, group string")
    alone = spark.createDataFrame([("A", "removed"), ("X", "added"), ("Y", "added"), ("q", "removed")], "page string, kind string")
    like = names.similar(edges, groups, alone)
    # B goes on, so it is like nothing; q has no group and stands for itself.
    assert rows_of(like, "page", "place", "name", "similarity") == [("A", 1, "x", 0.4), ("A", 2, "y", 0.4), ("A", 3, "z", 0.3), ("X", 1, "b", 1.0), ("X", 2, "a", 0.4), ("Y", 1, "a", 0.4), ("q", 1, "v", 0.9)]
    former = spark.createDataFrame([("Y", "former", "n"), ("Y", "related", "m"), ("A", "former", "k")], "page string, kind string, name string")
    assert rows_of(names.contradictions(former, like, alone), "page", "kind", "names") == [("X", "added", ["b"]), ("Y", "added", ["n"])]


def test_files(spark):
    kinds = [("a.txt", "row_added", None, None)] * 3 + [("a.txt", "rows_removed_bulk", "40", None), ("a.txt", "rows_changed_bulk", "7", "7"), ("a.txt", "field_changed", "x", "y"), ("b.txt", "column_added", None, None), ("b.txt", "rows_added_bulk", None, "5")]
    diffs = spark.createDataFrame(kinds, "file string, kind string, old_value string, new_value string")
    side = lambda rows: spark.createDataFrame(rows, "file string, rows long")
    got = rows_of(digest.file_table(diffs, side([("a.txt", 50), ("c.txt", 0)]), side([("a.txt", 13), ("b.txt", 5)])), "file", "status", "rows_old", "rows_new", "row_added", "row_removed", "field_changed", "column_changes")
    assert got == [("a.txt", "continued", 50, 13, 3, 40, 8, 0), ("b.txt", "added", None, 5, 5, 0, 0, 1), ("c.txt", "removed", 0, None, 0, 0, 0, 0)]
    assert digest.file_table(diffs.limit(0), side([]), side([])).count() == 0


def test_statuses_of_columns(spark):
    rows = [
        ("t1", "t1", ["08:00:00", "08:05:00"], ["08:00:00", "08:05:00"], [], "exact"), ("t2", "u2", ["08:00:00", None], ["08:00:00", None], [], "exact"),
        ("t3", "t3", ["8:00:00", "08:05:00"], ["08:10:00", "08:15:00"], [0, 1], "modified"), ("t4", "t4", ["09:00:00", "09:05:00", None], ["09:00:00", None, "09:09:00"], [1, 2], "modified"),
        ("t5", None, ["", "10:05:00"], None, [], "removed"), (None, "t6", None, [None, "25:05:00"], [], "added"), ("t7", "t7", ["11:00:10"], ["11:00:20"], [], "modified"),
    ]
    found = spark.createDataFrame(rows, "old_id string, new_id string, old_times array<string>, new_times array<string>, changed array<int>, relation string")
    from pyspark.sql import functions as F

    got = {r["old_id"] or r["new_id"]: tuple(r[c] for c in ("status", "departure_old", "departure_new", "changed_stops", "stops_added", "stops_removed")) for r in digest.column_statuses(found, F.col("relation")).collect()}
    assert got == {
        "t1": ("unchanged", "08:00", "08:00", None, None, None), "t2": ("id_changed", "08:00", "08:00", None, None, None), "t3": ("retimed", "8:00", "08:10", 2, None, None),
        "t4": ("rerouted", "09:00", "09:00", 2, 1, 1), "t5": ("removed", "10:05", None, None, None, None), "t6": ("added", None, "25:05", None, None, None), "t7": ("retimed", "11:00", "11:00", 0, None, None),
    }


def test_furthest_point_is_of_the_first_line():
    a = [(35.0, 139.0 + i / 1000) for i in range(20)]
    spur = [*a[:10], (35.02, 139.0095), *a[10:]]
    far, at = geo.departure(a, spur)
    assert far == 0 and at == a[0]
    far, at = geo.departure(spur, a)
    assert 2000 < far < 2300 and at == (35.02, 139.0095)


def test_latest_is_the_same_whatever_the_order(spark):
    rows = [("k", 1, "z"), ("k", 2, "b"), ("k", 2, "a"), ("k", 2, None), ("l", None, "x"), (None, 3, "y")]
    schema = "k string, v int, x string"
    want = {(r["k"], r["v"], r["x"]) for r in latest(spark.createDataFrame(rows, schema), ["k"], "v").collect()}
    assert len(want) == 3 and want == {(r["k"], r["v"], r["x"]) for r in latest(spark.createDataFrame(rows[::-1], schema).repartition(3), ["k"], "v").collect()}
    assert latest(spark.createDataFrame([], schema), ["k"], "v").count() == 0


@pytest.mark.parametrize("again", [False, True])
def test_changes_of_a_stream(spark, tmp_path, again):
    """Batches of a stream: the second changes, repeats and adds keys; a batch that is run again writes the same."""
    schema = "k string, v int, x string"
    sink = KeyedChanges(["k"], "v", str(tmp_path / "out"))
    for n, rows in enumerate(([("a", 1, "p"), ("b", 1, "q")], [("a", 2, "r"), ("b", 0, "late"), ("c", 2, "s")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        stream.awaitTermination()
        if again:
            sink(spark.createDataFrame(rows, schema), n)
    changes = spark.read.parquet(str(tmp_path / "out/changes/1"))
    assert sorted((r["kind"], r["key"][0], r["column"], r["old_value"], r["new_value"]) for r in changes.collect() if r["kind"] == "field_changed") == [("field_changed", "a", "x", "p", "r")]
    assert sorted((r["kind"], r["key"][0]) for r in changes.collect() if r["kind"] != "field_changed") == [("row_added", "c")]
    assert rows_of(spark.read.parquet(str(tmp_path / "out/state/1")), "k", "v", "x") == [("a", 2, "r"), ("b", 1, "q"), ("c", 2, "s")]


def test_a_stream_keeps_two_states(spark, tmp_path):
    sink = KeyedChanges(["k"], "v", str(tmp_path))
    for n in range(4):
        sink(spark.createDataFrame([("a", n), ("b", 1)], "k string, v int"), n)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["2", "3"] and len(list((tmp_path / "changes").iterdir())) == 4
    assert rows_of(spark.read.parquet(str(tmp_path / "state/3")), "k", "v") == [("a", 3), ("b", 1)]


def test_scratch_tables_go(spark):
    from gantline.sources.scratch import Scratch

    scratch = Scratch(spark, "gone")
    first, second = (scratch.put(spark.range(3), n) for n in ("a", "b"))
    scratch.drop(first)
    assert second.count() == 3
    scratch.clear()
    scratch.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_digests_from_the_command_line(spark, tmp_path, capsys):
    import feeds

    from gantline.__main__ import main

    stops = list(feeds.PIERS)
    old = feeds.write(tmp_path, "old")
    new = feeds.write(tmp_path, "new", stop_times=feeds.times(("dawn", 395, stops), ("noon", 755, stops), ("dusk", 1070, stops[:3])))
    assert main(["compare", old, new, "--digest", "--page", "F", "--out", f"file://{tmp_path}/out"], spark) == 0
    said = capsys.readouterr().out
    assert "# Digest\n" in said and "- old: Bay Ferry" in said and "pages: 1, changed: 1" in said and "# Digest of F" in said
    assert "12:35 retimed, 4 times changed, before 12:15 (trip noon -> noon)" in said and "17:50 rerouted, 0 stops more, 1 less (trip dusk -> dusk)" in said and "- unchanged 1, other id only 0" in said
    assert spark.read.json(f"file://{tmp_path}/out/digest/columns").count() == 2 and spark.read.json(f"file://{tmp_path}/out/rawdiffs").count() > 0
