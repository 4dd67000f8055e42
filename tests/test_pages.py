"""Pages on small made tables, against plain Python."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gantline.functions.axis import gaps, places_on, stop_axis
from gantline.operators import graphs
from gantline.plans import cells, pages, sheets
from gantline.sources.config import load
from gantline.sources.scratch import Scratch

C = load()["presentation"]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def within(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def share(a, b):
    """Of all pairs of common stops the share in the same order, by first calls."""
    common = [s for s in dict.fromkeys(a) if s in b]
    pairs = list(combinations(common, 2))
    return sum(b.index(x) < b.index(y) for x, y in pairs) / len(pairs) if pairs else None


@pytest.fixture
def systems(spark):
    def make(found):
        """From {page: [(system, stops, trips)]}."""
        data = [(p, s, list(stops), n, f"{8 + i:02d}:00") for p, of in found.items() for i, (s, stops, n) in enumerate(of)]
        return spark.createDataFrame(data, "page string, system string, stops array<string>, trips long, earliest string")

    return make


@pytest.fixture
def grouped(spark, systems):
    return lambda found: pages.direction_groups(systems(found), C, Scratch(spark, "test"))


def test_kinds_of_direction_groups(grouped):
    found = {
        "both": [("f", "ABCDE", 9), ("b", "EDCBX", 4)],  # the way back goes on beyond the start
        "short": [("f", "ABCDE", 9), ("h", "BCD", 2)],
        "between": [("f", "ABCDE", 9), ("g", "CDFAB", 2)],  # neither the same way nor the opposite one
        "loop": [("cw", "ABCDEFGHIJKLA", 9), ("ccw", "ALKJIHGFEDCBA", 8)],
        "twice": [("x", "ABC", 1), ("y", "PQRS", 5), ("old:z", "KLMN", 5)],
        "unlike": [("x", "ABCDEFGHIJ", 3), ("y", "ABC", 2)],
    }
    got = {(r["page"], r["system"]): r for r in grouped(found).collect()}
    told = lambda page: sorted((r["dgroup"], r["system"], r["leg"], r["kind"], r["label"]) for (p, _), r in got.items() if p == page)
    assert told("both") == [("dg0", "b", "reverse", "bidirectional", "A ⇄ E"), ("dg0", "f", "forward", "bidirectional", "A ⇄ E")]
    assert told("short") == [("dg0", "f", "forward", "one_way", "A → E"), ("dg0", "h", "forward", "one_way", "A → E")]
    assert [x[:2] for x in told("between")] == [("dg0", "f"), ("dg1", "g")]
    assert told("loop") == [("dg0", "ccw", "reverse", "loop", "A 循環"), ("dg0", "cw", "forward", "loop", "A 循環")]
    assert got["loop", "cw"]["leg_label"] == "A 循環（B先回り）" and got["loop", "ccw"]["leg_label"] == "A 循環（L先回り）"
    assert got["both", "b"]["leg_label"] == "E → A" and got["both", "f"]["leg_label"] == "A → E"
    assert [x[:2] for x in told("twice")] == [("dg0", "y"), ("dg1", "old:z"), ("dg2", "x")]  # as many trips: what is still there comes first
    assert len({x[0] for x in told("unlike")}) == 2


def test_direction_groups_against_a_plain_walk(grouped):
    rng = random.Random(8)
    found = {}
    for p in range(40):
        stops = "ABCDEFG"[: rng.randint(3, 7)]
        line = lambda s=stops: "".join(rng.sample(s, rng.randint(2, len(s))) if rng.random() < 0.3 else sorted(rng.sample(s, rng.randint(2, len(s))), reverse=rng.random() < 0.5))
        found[f"p{p}"] = [(f"s{i}", line(), rng.randint(0, 9)) for i in range(rng.randint(1, 6))]
    got = {}
    for r in grouped(found).collect():
        got.setdefault(r["page"], {})[r["system"]] = (r["dgroup"], r["leg"])
    for page, of in found.items():
        root = list(range(len(of)))
        for i, j in combinations(range(len(of)), 2):
            a, b = of[i][1], of[j][1]
            both, s = set(a) & set(b), share(a, b)
            if len(both) >= 3 and len(both) / len(set(a) | set(b)) >= 0.6 and (s <= 0.2 or s >= 0.8):
                root = [root[i] if r == root[j] else r for r in root]
        groups = {r: [k for k in range(len(of)) if root[k] == r] for r in root}
        order = sorted(groups.values(), key=lambda g: (-sum(of[k][2] for k in g), of[min(g)][0]))
        want = {}
        for n, g in enumerate(order):
            chief = min(g, key=lambda k: (-of[k][2], k))
            for k in g:
                s = share(of[k][1], of[chief][1])
                want[of[k][0]] = (f"dg{n}", "reverse" if s is not None and s <= 0.2 else "forward")
        assert got[page] == want


def test_lines_axes_and_rows(spark, systems, grouped):
    found = {"line": [("f", "ABCDE", 9), ("h", "BCD", 2), ("x", "ABXDE", 1)], "mirror": [("f", "ABC", 5), ("b", "CBA", 4)], "uneven": [("f", "ABCDE", 5), ("b", "EDCBX", 4)]}
    groups = grouped(found)
    patterns = systems(found).select("page", "system", F.col("stops").alias("seq"))
    views = {(r["page"], r["leg"]): (r["axis"], r["lines"]) for r in pages.leg_views(groups, patterns, Scratch(spark, "test")).collect()}
    assert views["line", "forward"] == (list("ABXCDE"), [list("ABCDE"), list("ABXDE")])  # the short turn draws no line of its own
    drawn = {(r["page"], r["kind"], r["label"], "".join(r["stops"])) for r in pages.axis_rows(pages.leg_views(groups, patterns, Scratch(spark, "test")), groups).collect()}
    assert drawn == {("line", "leg", "A → E", "ABXCDE"), ("mirror", "pair", "A ⇄ C", "ABC"), ("uneven", "leg", "A → E", "ABCDE"), ("uneven", "leg", "E → A", "EDCBX")}


def test_maximal_sequences_and_axes(spark):
    rng = random.Random(5)
    data = [(g, [rng.choice("ABCDE") for _ in range(rng.randint(0, 6))]) for g in range(12) for _ in range(rng.randint(1, 12))]
    df = spark.createDataFrame(data, "g int, seq array<string>")
    of = {g: {tuple(s) for h, s in data if h == g} for g in range(12)}
    assert rows(pages.maximal(df, ["g"]), "g", "seq") == sorted(((g, list(s)) for g, q in of.items() for s in q if not s or not any(s != t and within(s, t) for t in q)), key=str)
    assert rows(pages.axes(df, ["g"]), "g", "axis") == sorted(((g, list(stop_axis(q))) for g, q in of.items()), key=str)


def test_key_stops(spark, systems, grouped):
    found = {
        "a": [("f", "ABCDE", 9), ("x", "ABXDE", 3), ("h", "BCD", 1), ("b", "EDCBA", 8), ("c", "EDYBA", 1)], "b": [("g", "HIJK", 4)], "c": [("g", "HIL", 4)], "d": [("g", "MHI", 4)],
    }
    groups = grouped(found)
    patterns = systems(found).select("page", "system", F.col("stops").alias("seq"))
    got = {(r["page"], r["stop"]): r["tier"] for r in pages.key_stops(groups, patterns, patterns.select("page", F.explode("seq").alias("stop")), 3).collect()}
    assert {s: t for (p, s), t in got.items() if p == "a"} == {"A": 1, "E": 1, "B": 2, "D": 2}  # B parts and D joins the lines; Y lies on the way back
    assert got["b", "H"] == got["b", "I"] == got["d", "I"] == 1 and got["b", "K"] == 1 and ("b", "J") not in got


def test_the_walk_over_tied_claims(spark):
    rng = random.Random(6)
    for _ in range(3):
        claims = [(f"o{o}", f"n{n}", rng.randint(0, 2), rng.randint(0, 1)) for o in range(40) for n in rng.sample(range(25), rng.randint(1, 4))]
        first = {o: min(u for a, _, u, _ in claims if a == o) for o, *_ in claims}
        claims = [(o, n, first[o], like) for o, n, _, like in claims]
        got = dict(map(tuple, graphs.walk(spark.createDataFrame(claims, "old_id string, new_id string, unsure int, alike int"), Scratch(spark, "t"), ["unsure"], [F.desc("alike")]).collect()))
        taken, want = set(), {}
        for o in sorted(first, key=lambda o: (first[o], o)):
            want[o] = min((-like, n in taken, n) for a, n, _, like in claims if a == o)[2]
            taken.add(want[o])
        assert got == want


def test_both_ways_of_comparing_sets(spark):
    rng = random.Random(4)
    sets = {(side, n): {rng.choice(range(12 if rng.random() < 0.5 else 60)) for _ in range(rng.randint(1, 12))} for side in ("old", "new") for n in range(25)}
    df = spark.createDataFrame([(*k, i) for k, v in sets.items() for i in v], "side string, name int, item int")
    for least in (0.05, 0.5, 0.9):
        want = sorted(((a[1], b[1], len(x & y)) for a, x in sets.items() for b, y in sets.items() if a[0] == "old" and b[0] == "new" and len(x & y) / len(x | y) >= least - 1e-12), key=str)
        for counted in (True, False, None):
            assert rows(graphs.set_jaccard(df, least, counted=counted), "a", "b", "both") == want
    own = df.filter("side = 'old'").select("name", "item")
    of = {n: s for (side, n), s in sets.items() if side == "old"}
    want = [(a, b) for a, b in combinations(sorted(of), 2) if len(of[a] & of[b]) / len(of[a] | of[b]) >= 0.4]
    assert rows(graphs.similar_sets(own, 0.4), "a", "b") == sorted(want, key=str)
    assert graphs.set_jaccard(df.limit(0), 0.5).count() == 0


def test_changes_of_stops(spark):
    moved = [("p", "s1", "ABC", "ABXC")] * 3 + [("p", "s2", "CBA", "CXBA")] * 2 + [("p", "s1", "ABC", "AC")] + [("p", None, "ABC", "ABXC")] + [("q", "s3", "AB", "BA")]
    df = spark.createDataFrame([(p, s, list(a), list(b)) for p, s, a, b in moved], "page string, system string, old_seq array<string>, new_seq array<string>")
    totals = spark.createDataFrame([("p", "s1", 3), ("p", "s2", 4), ("q", "s3", 1)], "page string, system string, trips long")
    above = spark.createDataFrame([("p", "s1"), ("q", "s3")], "page string, system string")
    got = {(r["page"], "".join(r["added_stops"]), "".join(r["removed_stops"])): tuple(r)[3:] for r in pages.change_units(df, totals, above, 0.9).collect()}
    assert got == {
        ("p", "X", ""): (6, 8, 0.75, False, False, ["s1", "s2"]),  # both directions are one change; trips without a system count for themselves
        ("p", "", "B"): (1, 3, 0.333, False, True, ["s1"]), ("q", "", ""): (1, 1, 1.0, True, True, ["s3"]),
    }


def test_levels_and_headlines(spark):
    made = lambda data, schema: spark.createDataFrame(data, schema)
    totals = made([("come", 0, 4), ("gone", 3, 0), ("some", 5, 6), ("calm", 2, 2)], "page string, old long, new long")
    systems_ = made([("come", "s", "added", 0, 4), ("some", "t", "added", 0, 2), ("some", "u", "removed", 1, 0), ("some", "v", "removed", 2, 0)], "page string, system string, status string, trips_old long, trips_new long")
    units = made([("some", ["X"], ["B", "C"], 2, 4, False)], "page string, added_stops array<string>, removed_stops array<string>, affected_trips long, system_trips long, told_above boolean")
    labels = made([("come", "daily", "added", 4), ("some", "weekday", "added", 2), ("some", "weekday", "removed", 1), ("some", "daily", "rerouted", 2), ("some", "daily", "retimed", 1), ("some", "daily", "retimed_minor", 3)], "page string, day_type string, label string, trips long")
    notes = made([("some", "shape_changed", 2), ("calm", "headsign_changed", 1)], "page string, kind string, count long")
    levels = pages.summary_levels(totals, systems_, units, labels, notes, 2)
    assert rows(levels, *levels.columns) == sorted(
        [
            ("come", 1, "added", None, 0, 4), ("gone", 1, "removed", None, 3, 0), ("some", 2, "system_added", "t", 0, 2), ("some", 2, "system_removed", "v", 2, 0), ("some", 3, "stops", "+X -B -C", 2, 4),
            ("some", 4, "trips", "weekday", 1, 2), ("some", 5, "retimed", None, 1, 1), ("some", 5, "retimed_minor", None, 3, 3), ("some", 5, "shape_changed", None, 2, 2), ("calm", 5, "headsign_changed", None, 1, 1),
        ], key=str,
    )
    days = made([("some", "weekday", 3, 4, False), ("some", "daily", 2, 9, True), ("calm", "daily", 2, 2, False)], "page string, day_type string, old long, new long, unsure boolean")
    got = rows(pages.headlines(levels, labels, days), "page", "rank", "kind", "lost", "gained")
    assert got == [("calm", 1, "notes_only", 1, 1), ("come", 1, "route_added", 0, 4), ("gone", 1, "route_removed", 3, 0), ("some", 1, "systems", 1, 1), ("some", 2, "reroute", 2, 2), ("some", 3, "trips", 3, 4)]


def test_day_cells(spark):
    schema = "page string, direction string, day_type string, family string, digest string, worlds array<string>, dates array<string>, place int"
    pattern = lambda place, digest, worlds, dates, d="0", family="f": ("p", d, "weekday", family, digest, worlds, dates, place)
    old = [pattern(1, "same", ["w1", "w2"], ["01", "02"]), pattern(2, "x", ["w3"], ["03"]), pattern(3, "y", ["w4"], ["04"]), pattern(4, "z", ["w5"], ["05"])]
    new = [pattern(1, "q", ["v1"], ["03"]), pattern(2, "same", ["v2"], ["06"]), pattern(3, "r", ["v3"], ["07"]), pattern(4, "s", ["v4"], ["08"])]
    flows = [("p", "0", "weekday", a, b, n) for a, b, n in [("w4", "v3", 5), ("w4", "v4", 9), ("w5", "v4", 8), ("w5", "v3", 1), ("w1", "v4", 50)]]
    f = spark.createDataFrame(flows, "page string, direction string, day_type string, old_world string, new_world string, trips long")
    found = cells.day_cells(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), f, Scratch(spark, "t"))
    assert rows(found.cells, "label", "signal", "old_dates", "new_dates") == [
        ("weekday@1", "content", ["01", "02"], ["06"]), ("weekday@2", "dates", ["03"], ["03"]), ("weekday@3", "flow", ["04"], ["08"]), ("weekday@4", "flow", ["05"], ["07"])
    ]
    assert rows(found.shown.filter("gen = 'old'"), "world", "label", "repeated") == [("w1", "weekday@1", False), ("w2", "weekday@1", True), ("w3", "weekday@2", False), ("w4", "weekday@3", False), ("w5", "weekday@4", False)]
    one = cells.day_cells(spark.createDataFrame(old[:1], schema), spark.createDataFrame(new[1:2], schema), f, Scratch(spark, "t"))
    assert rows(one.cells, "label", "signal") == [("weekday", "content")]


def test_assignment_of_patterns_is_the_greedy_walk(spark):
    rng = random.Random(3)
    schema = "page string, direction string, day_type string, family string, digest string, worlds array<string>, dates array<string>, place int"
    side = lambda g: [(f"p{p}", "0", "daily", "f", f"{g}{p}{k}", [f"{g}{k}"], [f"{g}{k}"], k) for p in range(6) for k in range(5)]
    flows = [(f"p{p}", "0", "daily", f"o{i}", f"n{j}", rng.randint(1, 4)) for p in range(6) for i in range(5) for j in range(5) if rng.random() < 0.6]
    f = spark.createDataFrame(flows, "page string, direction string, day_type string, old_world string, new_world string, trips long")
    got = rows(cells.pattern_pairs(spark.createDataFrame(side("o"), schema), spark.createDataFrame(side("n"), schema), f, Scratch(spark, "t")), "page", "old_place", "new_place", "signal")
    want = []
    for p in range(6):
        free = {"o": set(range(5)), "n": set(range(5))}
        for _, i, j in sorted((-n, int(a[1]), int(b[1])) for q, _, _, a, b, n in flows if q == f"p{p}"):
            if i in free["o"] and j in free["n"]:
                free["o"].remove(i)
                free["n"].remove(j)
                want.append((f"p{p}", i, j, "flow"))
        want += [(f"p{p}", i, None, "old_only") for i in free["o"]] + [(f"p{p}", None, j, "new_only") for j in free["n"]]
    assert got == sorted(want, key=str)


def test_twins_and_what_a_page_shows(spark):
    trips = [("old", "f", "0", "daily", w, f"{w}-{k}", ["A", "B"], f"0{9 - k}:00") for w in ("w1", "w2") for k in range(3)]
    cols = "gen string, family string, direction string, day_type string, world string, trip_id string, base_seq array<string>, times string"
    t = spark.createDataFrame(trips, cols)
    twin = cells.twins(t, spark.createDataFrame([("old", "f", "0", "daily", ["w1", "w2"])], "gen string, family string, direction string, day_type string, worlds array<string>"))
    assert rows(twin, "trip_id", "twin") == [(f"w2-{k}", f"w1-{k}") for k in range(3)]
    shown = spark.createDataFrame([("old", "f", "0", "daily", "w1", "daily@1", False), ("old", "f", "0", "daily", "w2", "daily@1", True)], "gen string, family string, direction string, day_type string, world string, label string, repeated boolean")
    assert rows(cells.shown_trips(t, shown, twin), "trip_id", "shown_id", "label") == [(f"{w}-{k}", f"w1-{k}", "daily@1") for w in ("w1", "w2") for k in range(3)]


def test_what_a_page_shows_adds_up(spark):
    rng = random.Random(9)
    trips = [(g, f"p{rng.randint(0, 2)}", rng.choice("ab"), f"{g}{k}") for g in ("old", "new") for k in range(60)]
    pairs = [(f"old{rng.randint(0, 59)}", f"new{rng.randint(0, 59)}", rng.choice(["exact", "modified"])) for _ in range(50)]  # some name a trip twice, as twins do
    t = spark.createDataFrame(trips + trips[:5], "gen string, page string, label string, trip_id string")
    told = cells.page_pairs(t, spark.createDataFrame(pairs, "old_id string, new_id string, relation string"))
    got = told.collect()
    place = {i: (p, x) for _, p, x, i in trips}
    for r in got:
        assert all(place[i] == (r["page"], r["label"]) for i in (r["old_id"], r["new_id"]) if i)
        assert r["relation"] == ("removed" if not r["new_id"] else "added" if not r["old_id"] else r["relation"])
    assert sorted(i for r in got for i in (r["old_id"], r["new_id"]) if i) == sorted(place) and any(r["old_id"] and r["new_id"] for r in got)
    assert cells.unlike_totals(t, told).count() == 0
    assert cells.unlike_totals(t, told.filter("relation <> 'added'")).count() > 0


def group(*specs):
    """Rows of a sheet group from (old, new, n)."""
    return [(tuple(o) if o else None, tuple(n) if n else None, k, f"{o}{n}") for o, n, k in specs]


def test_sheets():
    corridors = [group(("SAMBE", "SAMBE", 4)), group(("SCMDE", "SCMDE", 4))]
    apart = sheets.fewest_sheets(corridors, 1.5)
    assert len(apart) == 2 and set(sheets.sheet_names(apart)) == {"A・B経由", "C・D経由"}
    contained = [group(("ABCDE", "ABCDE", 2)), group(("BCD", "BCD", 2))]
    assert len(sheets.fewest_sheets(contained, 1.5)) == 1 and sheets.sheet_names(sheets.fewest_sheets(contained, 1.5)) == [None]
    around = sheets.fewest_sheets([group(("123456", "123456", 2)), group(("132546", "132546", 2))], 0.5)
    assert sheets.sheet_names(around) == ["2先回り", "3先回り"]
    # What can't be read even alone is joined with its like, and not with what can.
    gappy = lambda n: group(("SXTYU", "SPTQU", n))
    found = sheets.fewest_sheets([gappy(2), [(o, n, k, "z") for o, n, k, _ in gappy(2)], group(("SVWU", "SVWU", 4))], 1.5)
    assert sorted(s.size for s in found) == [4, 4]


def test_sheets_against_trying_all_pairs():
    rng = random.Random(2)
    for _ in range(60):
        most = rng.choice([0.3, 0.8, 1.5])
        seqs = list({"".join(rng.sample("ABCDEFGH", rng.randint(2, 6))) for _ in range(rng.randint(1, 7))})
        groups = [group((rng.choice([None, s, rng.choice(seqs)]), s, rng.randint(1, 5))) for s in sorted(seqs)]

        def figures(g):
            q = [x for o, n, k, _ in g for x in (o, n) if x for _ in range(k)]
            axis = stop_axis(q)
            total = sum(gaps(places_on(x, axis)) for x in q)
            return total, total / max(1, len(q)), sum(k for _, _, k, _ in g)

        left = [list(g) for g in groups]
        if figures(sum(left, []))[1] <= most:
            left = [sum(left, [])]
        while True:
            options = []
            for i, j in combinations(range(len(left)), 2):
                (ga, ma, na), (gb, mb, nb), (g, m, _) = figures(left[i]), figures(left[j]), figures(left[i] + left[j])
                if m <= most or ma > most and mb > most and m <= max(ma, mb):
                    options.append(((g - ga - gb) / (na + nb), i, j))
            if not options:
                break
            _, i, j = min(options)
            left[i] += left.pop(j)
        assert sorted(sorted(map(str, s.rows)) for s in sheets.fewest_sheets(groups, most)) == sorted(sorted(map(str, g)) for g in left)


def test_order_of_columns():
    n = None
    full, short = [480, 500, 520], [n, 490, 505]
    assert sheets.settled([full, short]) == [1, 0]  # the short turn starts later, but is first where both call
    whole, up, down = [420, 430, 440, 450], [490, 500, n, n], [n, n, 540, 550]
    assert sheets.settled([whole, up, down]) == sheets.settled([whole, up, down]) == [0, 1, 2]
    assert [sheets.before(up, down), sheets.before(down, up), sheets.before([n, n, n, n], up), sheets.before([1, n, 3, n], [n, 2, n, 4])] == [-1, 1, 0, 0]
    assert sheets.before([1, 9, 5], [1, 2, 6]) == -1 and sheets.before([1, 9, 5], [1, 2, 5]) == 1  # leaving together, the first to arrive; then in between
    circle = [[1, n, 9], [2, 5, n], [n, 6, 8]]
    assert sorted(sheets.settled(circle)) == [0, 1, 2]


def test_timetables_on_axes(spark):
    t = lambda *m: [f"{x // 60:02d}:{x % 60:02d}:{30 if x % 2 else 0:02d}" for x in m]
    data = [
        ("p", "o1", "n1", list("ABC"), list("ABC"), t(480, 490, 500), t(480, 492, 500)), ("p", None, "n2", None, list("BC"), None, t(486, 496)), ("p", "o3", None, list("ABXC"), None, t(600, 610, 620, 630), None),
        ("p", "n2", None, list("ABC"), None, ["08:20:00", "", None], None), ("q", "o9", "n9", [], [], [], []),
    ]
    df = spark.createDataFrame(data, "page string, old_id string, new_id string, old_seq array<string>, new_seq array<string>, old_times array<string>, new_times array<string>")
    got = sheets.timetables(df, ["page"], 1.5).orderBy("page", "sheet", "number").collect()
    assert [(r["page"], r["sheet"], r["number"], r["old_id"], r["new_id"]) for r in got] == [("p", 0, 0, None, "n2"), ("p", 0, 1, "o1", "n1"), ("p", 0, 2, "n2", None), ("p", 0, 3, "o3", None), ("q", 0, 0, "o9", "n9")]
    by = {(r["old_id"], r["new_id"]): r for r in got}
    assert all(r["axis"] == list("ABXC") for r in got[:4]) and got[4]["axis"] == []
    assert by["o1", "n1"]["new_times"] == ["08:00:00", "08:12:00", None, "08:20:00"] and by["o1", "n1"]["changed"] == [1]
    assert by["n2", None]["old_times"] == ["08:20:00", "", None, ""] and by["n2", None]["new_times"] is None and by[None, "n2"]["changed"] == []


def test_trips_of_several_worlds_are_shown_by_cells(spark):
    from types import SimpleNamespace

    from gantline.plans.presentation import shown_as

    def trips(*rows):
        data = [(t, "f", "0", "weekday", s, list("AB"), at) for t, s, at in rows]
        return spark.createDataFrame(data, "trip_id string, family string, direction string, day_type string, service_id string, base_seq array<string>, times string")

    def worlds(**of):
        return spark.createDataFrame([(s, "weekday", w, len(set(of.values()))) for s, w in of.items()], "service_id string, day_type string, world string, n_worlds int")

    dates = lambda **of: spark.createDataFrame([(s, d) for s, days in of.items() for d in days], "service_id string, day string")
    c = SimpleNamespace(
        delta=SimpleNamespace(
            old=trips(("a1", "s1", "08:00"), ("a2", "s1", "09:00"), ("b1", "s2", "08:00"), ("b2", "s2", "09:00")), new=trips(("a1", "n1", "08:00"), ("a2", "n1", "09:00"), ("c1", "n2", "10:00")),
            pairs=spark.createDataFrame([("a1", "a1", "exact"), ("b2", "a2", "exact")], "old_id string, new_id string, relation string"),
        ),
        worlds={"old": worlds(s1="weekday#1", s2="weekday#2"), "new": worlds(n1="weekday#1", n2="weekday#2")},
        dates={"old": dates(s1=["01", "02"], s2=["10"]), "new": dates(n1=["01", "02"], n2=["20"])},
    )
    of = spark.createDataFrame([("old", "f", "p"), ("new", "f", "p")], "gen string, family string, page string")
    found, shown = shown_as(c, of, Scratch(spark, "t"))
    assert rows(found.cells, "label", "signal", "old_dates", "new_dates") == [("weekday@1", "content", ["01", "02", "10"], ["01", "02"]), ("weekday@2", "new_only", [], ["20"])]
    assert rows(shown, "gen", "trip_id", "shown_id", "label") == [
        ("new", "a1", "a1", "weekday@1"), ("new", "a2", "a2", "weekday@1"), ("new", "c1", "c1", "weekday@2"),
        ("old", "a1", "a1", "weekday@1"), ("old", "a2", "a2", "weekday@1"), ("old", "b1", "a1", "weekday@1"), ("old", "b2", "a2", "weekday@1"),
    ]
