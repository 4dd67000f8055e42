import datetime
import math
import random

from pyspark.sql import functions as F

from gantline.functions import columns as C
from gantline.functions import geo, sequences, text
from gantline.operators import diff, graphs, groups, ledger
from gantline.plans.calendars import label_dates
from gantline.sources.scratch import Scratch, global_rank


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_keyed_diff(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", None), ("3", "c", "z")], "k string, u string, v string")
    new = spark.createDataFrame([("1", "a", "x"), ("2", "B", ""), ("4", "d", "w")], "k string, u string, v string")
    got = rows(diff.keyed_diff(old, new, ["k"]), "kind", F.col("key")[0], "column", "old_value", "new_value")
    assert got == sorted([("field_changed", "2", "u", "b", "B"), ("row_added", "4", "", None, None), ("row_removed", "3", "", None, None)], key=str)
    assert diff.keyed_diff(old, old, ["k"]).count() == 0


def test_multiset_diff_and_collapse(spark):
    old = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "v string")
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    found = diff.multiset_diff(old, new)
    assert rows(found, "kind", F.col("key")[1], F.coalesce("old_value", "new_value")) == [("row_added", "0", "c"), ("row_removed", "0", "a"), ("row_removed", "1", "a")]
    assert rows(diff.collapse(found, 2, Scratch(spark, "bulk")), "kind", "old_value", "new_value") == [("rows_added_bulk", None, "1"), ("rows_removed_bulk", "2", None)]
    assert diff.collapse(found, 3, Scratch(spark, "bulk")).count() == 3


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int")
    got = global_rank(df, Scratch(spark, "t"), [F.col("v")]).orderBy("v").collect()
    assert [r["rank"] for r in got] == list(range(1000))


def test_components(spark):
    edges = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [("b", "c"), ("d", "c")]
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect()}
    assert {got[f"a{i}"] for i in range(41)} == {"a0"} and {got[x] for x in "bcd"} == {"b"}


def test_assignment_is_the_greedy_walk(spark):
    rng = random.Random(2)
    pairs = [(f"B{b}", f"o{b}{i}", f"n{b}{j}", rng.randint(0, 5)) for b in range(4) for i in range(7) for j in range(7) if rng.random() < 0.7]
    got = {(r["old_id"], r["new_id"]) for r in graphs.greedy_assignment(spark.createDataFrame(pairs, "block string, old_id string, new_id string, cost int"), Scratch(spark, "t"), ["cost"]).collect()}
    used, want = set(), set()
    for _, o, n, _ in sorted(pairs, key=lambda p: (p[0], p[3], p[1], p[2])):
        if o not in used and n not in used:
            used |= {o, n}
            want.add((o, n))
    assert got == want


def test_date_runs_break_at_year_ends(spark):
    days = [datetime.date(2025, 12, 30) + datetime.timedelta(days=i) for i in (0, 1, 2, 3, 5)]
    got = graphs.date_runs(spark.createDataFrame([("s", d) for d in days], "id string, day date"), ["id"]).orderBy("start").collect()
    assert [(str(r["start"]), r["days"]) for r in got] == [("2025-12-30", 2), ("2026-01-01", 2), ("2026-01-04", 1)]


def test_label_of_dates(spark):
    def dates(name, pick):
        return [(name, d) for i in range(90) if pick(d := datetime.date(2026, 4, 1) + datetime.timedelta(days=i))]

    df = spark.createDataFrame(
        dates("wed", lambda d: d.weekday() == 2) + dates("week", lambda d: d.weekday() < 5) + dates("all", lambda d: True) + dates("few", lambda d: d.day == 5) + dates("sun", lambda d: d.weekday() == 6), "id string, day date"
    )
    got = {r["id"]: r["day_type"] for r in label_dates(df, ["id"]).collect()}
    assert got == {"wed": "dow_0010000", "week": "weekday", "all": "daily", "few": "irregular", "sun": "sunday_holiday"}


def test_clock_and_bands(spark):
    bands = ["05:00-07:00", "07:00-09:00", "22:00-29:00"]
    df = spark.createDataFrame([("08:15:30",), ("25:00:00",), ("1:30",), ("",), ("x:y",), ("12:00:00",), ("06:59:59",)], "t string")
    s = C.clock_seconds(F.col("t"))
    got = [tuple(r) for r in df.select(s, C.time_band(s, bands)).collect()]
    assert got == [(29730, "07:00-09:00"), (90000, "22:00-29:00"), (5400, "22:00-29:00"), (None, "other"), (None, "other"), (43200, "other"), (25199, "05:00-07:00")]


def test_ledger(spark):
    diffs = spark.createDataFrame([(f"d{i}", "f") for i in range(4)], "rawdiff_id string, file string")
    claims = spark.createDataFrame([("d0", 2, "e2"), ("d0", 1, "e1"), ("d1", 2, "e2")], "rawdiff_id string, event_seq int, event_id string")
    assert rows(ledger.primary(claims), "rawdiff_id", "event_id") == [("d0", "e1"), ("d1", "e2")]
    assert ledger.accounting(diffs, claims).first()[:] == (4, 2, 0.5) and ledger.accounting(diffs.limit(0), claims).first()["ratio"] == 1
    assert ledger.unknown(diffs.limit(1), claims).count() == 1 and ledger.residual_by(diffs, claims, "file").first()["residual"] == 2


def test_names():
    assert [text.base_name(x) for x in ("駅前 1番線", "市役所のりば A", "Hall B", "A", " 港２ ")] == ["駅前", "市役所", "Hall", "A", "港"]
    assert text.stem("10 港線", 2, ["線"]) == "港線" and text.stem("10線", 2, ["線"]) == "10線" and text.stem("１２ Harbour", 2, []) == "12 Harbour"
    assert sorted(["r10", "r9", "a"], key=text.natural_key) == ["a", "r9", "r10"]
    assert sorted(["105", "10", "2", "００1", "1", "上31", "上9", "上", "x1b", "x1a", "x01a"], key=text.natural_key) == ["1", "００1", "2", "10", "105", "x01a", "x1a", "x1b", "上", "上9", "上31"]


def test_sequences():
    assert sequences.lcs_length(list("abcde"), list("xbxdx")) == 2 and sequences.order_share(list("abc"), list("cba")) == 0 and sequences.order_share(["a"], ["a"]) is None
    assert sequences.edits(list("abc"), list("abcd")) == [("PATTERN_EXTENDED", ["d"], "end")] and sequences.edits(list("abc"), list("bc")) == [("PATTERN_TRUNCATED", ["a"], "start")]
    assert sequences.edits(list("abc"), list("axbc")) == [("STOP_INSERTED_IN_PATTERN", ["x"], "")] and sequences.edits(list("abcd"), list("ad")) == [("DETOUR_REMOVED", ["b", "c"], "")]


def test_lines_on_the_map():
    a = [(35.0, 139.0 + i / 1000) for i in range(20)]
    detour = [(35.0 + (0.005 if 8 < i < 12 else 0), 139.0 + i / 1000) for i in range(20)]
    assert geo.frechet(a, a) == 0 and 500 < geo.frechet(a, detour) < 600 and len(geo.thin(a, 5)) == 5 and geo.thin(a, 5)[-1] == a[-1]
    assert 500 < geo.deviation(a, detour)[0] < 600


def test_platform_marks_at_the_end_of_names():
    names = {"Station A": "Station", " Hall 3番線 ": "Hall", "駅前　のりば①": "駅前", "A": "A", "のりば": "のりば", "1番線": "1", "B A": "B", "Mall１２": "Mall", "": "", "Quay 10": "Quay 10", "Dock\n2": "Dock"}
    assert {n: text.base_name(n) for n in names} == names

    def rounds(name):
        """Mark by mark, until none is left."""
        base = name.strip()
        while found := [m for m in text.PLATFORM_MARKS if base.endswith(m) and base != m]:
            base = base.removesuffix(found[0]).strip()
        return base

    rng = random.Random(5)
    for _ in range(3000):
        name = "".join(rng.choice([*text.PLATFORM_MARKS, " ", "　", "駅", "x", "0"]) for _ in range(rng.randint(0, 7)))
        assert text.base_name(name) == rounds(name)


def test_similar_sets_by_prefixes(spark):
    rng = random.Random(4)
    sets = {(side, name): {rng.choice(range(12 if rng.random() < 0.5 else 60)) for _ in range(rng.randint(1, 12))} for side in ("old", "new") for name in range(25)}
    sets[("old", 99)], sets[("new", 98)] = {1, 2, 3, 4}, {1, 2, 3, 4}
    df = spark.createDataFrame([(*k, i) for k, v in sets.items() for i in v] * 2, "side string, name int, item int")
    for least in (0.05, 0.3, 0.5, 0.8, 1.0):
        want = sorted((a[1], b[1], len(x & y)) for a, x in sets.items() for b, y in sets.items() if a[0] == "old" and b[0] == "new" and len(x & y) / len(x | y) >= least - 1e-12)
        assert rows(graphs.set_jaccard(df, least), "a", "b", "both") == sorted(want, key=str)


def test_figures_of_groups(spark):
    rng = random.Random(7)
    data = [(g, rng.randint(0, 30)) for g in range(6) for _ in range(rng.randint(1, 40))]
    df = spark.createDataFrame(data, "g int, v int")
    got = {r["g"]: (r["n"], r["middle"], r["ranked"]) for r in groups.middle_and_rank(df, ["g"], "v").collect()}
    for g in range(6):
        v = sorted(x for h, x in data if h == g)
        assert got[g] == (len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, v[min(len(v) - 1, int(len(v) * 0.9))])
    (found,) = spark.createDataFrame([([1, 2, 3, 6],)], "a array<int>").select(*groups.mean_and_spread(F.col("a"))).collect()
    assert found[0] == 3 and abs(found[1] - 3.5**0.5) < 1e-12
    assert tuple(spark.createDataFrame([([],)], "a array<int>").select(*groups.mean_and_spread(F.col("a"))).first()) == (None, None)
    assert [tuple(r) for r in groups.search(df, [F.col("g") == 0], [F.col("v"), F.col("g")], 2).select("matched", "total").collect()] == [(got[0][0], len(data))] * min(2, got[0][0])


def test_leaders_are_those_of_a_walk(spark):
    from gantline.functions.columns import EARTH_M

    rng = random.Random(11)
    spots = [(g, f"s{k:05d}", base + rng.random() * spread, lon + rng.random() * spread) for g, base, lon, spread, n in (("town", 35.0, 139.0, 0.02, 600), ("dense", 60.0, 179.999, 0.001, 300), ("", 0.0, 0.0, 0.003, 200), ("pole", 89.9995, 10.0, 0.0005, 40), ("one", 1.0, 1.0, 0, 1)) for k in range(n)]
    rng.shuffle(spots)
    got = {(r["grp"], r["ord"]): r["leader"] for r in graphs.leaders(spark.createDataFrame(spots, "grp string, ord string, lat double, lon double"), 100.0, Scratch(spark, "t")).collect()}

    def metres(a, b):
        (y1, x1), (y2, x2) = ((math.radians(v) for v in p) for p in (a, b))
        return 2 * EARTH_M * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))

    want = {}
    for g in {s[0] for s in spots}:
        heads = []
        for _, k, lat, lon in sorted(s for s in spots if s[0] == g):
            near = [h for h, at in heads if metres(at, (lat, lon)) <= 100]
            if not near:
                heads.append((k, (lat, lon)))
            want[g, k] = near[0] if near else k
    assert got == want and 1 < len(set(want.values())) < len(want) / 2
    assert graphs.leaders(spark.createDataFrame([], "grp string, ord string, lat double, lon double"), 100.0, Scratch(spark, "t")).count() == 0


def test_stop_clusters_by_tasks_and_by_rounds(spark):
    from gantline.plans.identity import near_leaders

    rng = random.Random(3)
    stops = [(rng.choice(["Park", "Hall", ""]), f"s{i}", i, round(35 + rng.random() * 0.01, 4), round(139 + rng.random() * 0.01, 4)) for i in range(500)]
    stops += [("", f"zero{i}", 1000 + i, 0.0, 0.0) for i in range(300)]  # stops without a place
    df = spark.createDataFrame(stops, "base_name string, stop_id string, _line long, lat double, lon double")
    one, many = (rows(near_leaders(df, 100.0, Scratch(spark, "t"), places), "base_name", "stop_id", "number", "leader_id") for places in (1000, 10))
    assert one == many and len(one) == len(stops) and len({(b, n) for b, _, n, _ in one}) > 100


def test_ranks_of_large_groups(spark):
    left = spark.createDataFrame([(g, i) for g in "ab" for i in range(300)], "g string, x int").repartition(5)
    right = spark.createDataFrame([(g, 2 * i) for g in "ab" for i in range(250)], "g string, y int").repartition(3)
    few, split = (rows(diff.rank_zip(left, right, ["g"], ["x"], ["y"], s, 100), "g", "x", "y") for s in (None, Scratch(spark, "t")))
    assert few == split == sorted(((g, i, 2 * i) for g in "ab" for i in range(250)), key=str)
