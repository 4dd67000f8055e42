"""Timetables of a page old against new on stop axes, dealt into as few sheets as can be read, with columns in an order that time allows.

A table is what a leg runs under one day label. Its distinct pairs of stop sequences, with how many columns have each, go to one task; trips join what
is found there. A sheet's columns are put in order by themselves.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import gaps_on, places_on, stop_axis
from ..functions.columns import clock_seconds
from ..operators.groups import folded

#: How sheets are named: by the stops that only they have, by what they pass first, by a number.
VIA, JOINED, FIRST, NUMBER, AGAIN = "%s経由", "・", "%s先回り", "経路%d", "%s（%d）"


class Sheet:
    """Rows that stand on one axis: how many time columns each sequence has, and how many rows there are."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.columns: Counter = Counter()
        for old, new, n, _ in rows:
            for seq in (old, new):
                if seq is not None:
                    self.columns[seq] += n
        self.size = sum(n for _, _, n, _ in rows)
        self.axis = stop_axis(self.columns)
        self.gaps = sum(n * gaps_on(seq, self.axis) for seq, n in self.columns.items())
        self.mean = self.gaps / max(1, sum(self.columns.values()))

    def with_(self, other: Sheet) -> Sheet:
        return Sheet(self.rows + other.rows)


def fewest_sheets(groups: list[list[tuple]], most: float) -> list[Sheet]:
    """Groups of rows (old sequence, new sequence, number of columns, least id) as sheets of at most so many gaps a column.

    All that fits on one sheet is one. Otherwise the two groups that together gain the fewest gaps for each row are joined, again and again, as long as the
    result can be read. Groups that can't be read even alone are joined with each other where that makes neither worse.
    """
    one = Sheet([r for g in groups for r in g])
    if one.mean <= most:
        return [one]
    sheets = dict(enumerate(Sheet(g) for g in groups))
    price: dict[tuple[int, int], tuple[float, Sheet]] = {}
    fresh = [(i, j) for i in sheets for j in sheets if i < j]
    while True:
        for i, j in fresh:
            a, b = sheets[i], sheets[j]
            both = a.with_(b)
            if both.mean <= most or min(a.mean, b.mean) > most and both.mean <= max(a.mean, b.mean):
                price[i, j] = (both.gaps - a.gaps - b.gaps) / (a.size + b.size), both
        if not price:
            return list(sheets.values())
        i, j = min(price, key=lambda k: (price[k][0], k))
        merged = price[i, j][1]
        price = {k: v for k, v in price.items() if not {i, j} & set(k)}
        sheets[i] = merged
        del sheets[j]
        fresh = [(min(i, k), max(i, k)) for k in sheets if k != i]


def sheet_names(sheets: list[Sheet]) -> list[str | None]:
    """A name for each of several sheets: the stops that no other has, the commonest two; else the first stop at which it goes another way."""
    if len(sheets) < 2:
        return [None] * len(sheets)
    seen, whole = [], []
    for s in sheets:
        shown: Counter = Counter()
        for old, new, n, _ in s.rows:
            shown[new if new is not None else old] += n
        whole.append(max(shown, key=lambda q: (shown[q], q)))
        stops: Counter = Counter()
        for q, n in shown.items():
            stops.update(dict.fromkeys(q, n))
        seen.append(stops)
    holders = Counter(stop for stops in seen for stop in stops)
    names = []
    for i, stops in enumerate(seen):
        own = sorted((s for s in stops if holders[s] == 1), key=lambda s: (-stops[s], s))
        apart = next((a for a, b in zip(whole[i], whole[0 if i else 1], strict=False) if a != b), None)
        names.append(VIA % JOINED.join(own[:2]) if own else FIRST % apart if apart is not None else NUMBER % (i + 1))
    told: Counter = Counter()
    for i, name in enumerate(names):
        told[name] += 1
        names[i] = name if told[name] == 1 else AGAIN % (name, told[name])
    return names


def before(a: list, b: list) -> int:
    """-1 where column a stands left of b, 1 where right of it, 0 where time doesn't say. Columns are minutes or None for each stop of the axis.

    The first common stop decides, then the last, then those between. Without one, columns of different stretches stand in the order of travel if the earlier stretch is left in time.
    """
    for x, y in zip(a, b, strict=True):
        if x is not None and y is not None:
            if x != y:
                return -1 if x < y else 1
            break
    common = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
    if common:
        return next((-1 if x < y else 1 for x, y in (common[0], common[-1], *common) if x != y), 0)
    at = [[k for k, x in enumerate(v) if x is not None] for v in (a, b)]
    if not all(at):
        return 0
    if at[0][-1] < at[1][0]:
        return -1 if a[at[0][-1]] <= b[at[1][0]] else 1
    if at[1][-1] < at[0][0]:
        return 1 if b[at[1][-1]] <= a[at[0][0]] else -1
    return 0


def settled(columns: list[list]) -> list[int]:
    """An order of the columns: each is put before the first that it stands left of, then neighbours change places until none is the wrong way round, or as often as
    there are columns, since three may stand in a circle."""
    order: list[int] = []
    for k, column in enumerate(columns):
        at = next((i for i, other in enumerate(order) if before(column, columns[other]) < 0), len(order))
        order.insert(at, k)
    for _ in order:
        calm = True
        for i in range(len(order) - 1):
            left, right = order[i : i + 2]
            if before(columns[left], columns[right]) > 0:
                order[i], order[i + 1] = right, left
                calm = False
        if calm:
            break
    return order


def sheets(rows: DataFrame, by: list[str], most: float) -> DataFrame:
    """(by, sheet, sheet_label, old_seq, new_seq, axis, old_places, new_places) of each table, from a row for each of its columns (by, id, old_seq, new_seq), where one sequence may be null."""
    kinds = dict(rows.dtypes)
    counted = rows.groupBy(*by, "old_seq", "new_seq").agg(F.count("*").alias("n"), F.min("id").alias("least"))

    def deal(found_rows: list[tuple]) -> list[tuple]:
        seq = lambda x: None if x is None else tuple(x)
        groups: dict[tuple, list[tuple]] = {}
        for old, new, n, least in ((seq(o), seq(w), n, least) for o, w, n, least in found_rows):
            groups.setdefault(new if new is not None else old, []).append((old, new, n, least))
        found = fewest_sheets([groups[k] for k in sorted(groups)], most)
        found.sort(key=lambda s: (-s.size, min(r[3] for r in s.rows)))
        out = []
        for number, (sheet, label) in enumerate(zip(found, sheet_names(found), strict=True)):
            on = lambda q, axis=sheet.axis: None if q is None else places_on(q, axis)
            out += [(number, label, o, w, sheet.axis, on(o), on(w)) for o, w, _, _ in sheet.rows]
        return out

    schema = ", ".join(["sheet int, sheet_label string", *[f"{c} {kinds['old_seq']}" for c in ("old_seq", "new_seq", "axis")], "old_places array<int>, new_places array<int>"])
    return folded(counted.select(*by, "old_seq", "new_seq", "n", "least"), by, deal, schema)


def ordered(columns: DataFrame, by: list[str]) -> DataFrame:
    """The columns with ``number``, the place of each in its sheet, from rows (by, key, first, id, minutes, *). Columns start in the order of their first time and id."""
    more = [c for c in columns.columns if c not in {*by, "key", "first", "id", "minutes"}]

    def settle(found: list[tuple]) -> list[tuple]:
        last = lambda x: (x is None, x)
        found.sort(key=lambda r: (last(r[1]), last(r[2]), r[0]))
        number = [0] * len(found)
        for place, k in enumerate(settled([r[3] for r in found])):
            number[k] = place
        return [(*r[4:], n) for r, n in zip(found, number, strict=True)]

    kinds = dict(columns.dtypes)
    return folded(columns.select(*by, "key", "first", "id", "minutes", *more), by, settle, ", ".join([*(f"`{c}` {kinds[c]}" for c in more), "number int"]))


def on_axis(axis: Column, places: Column, times: Column) -> Column:
    """A text of time for each place of the axis: "" where a trip calls without one, null where it doesn't call."""
    each = F.when(F.size(axis) > 0, F.sequence(F.lit(0), F.size(axis) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.array_position(places, i).cast("int")
    return F.when(times.isNotNull(), F.transform(each, lambda i: F.when(at(i) > 0, F.coalesce(F.get(times, at(i) - 1), F.lit("")))))


def timetables(rows: DataFrame, by: list[str], most: float) -> DataFrame:
    """(by, sheet, sheet_label, axis, number, old_id, new_id, old_times, new_times, changed): the tables column by column, as they are read.

    rows is (by, old_id, new_id, old_seq, new_seq, old_times, new_times) with a text of time for each stop, one side null for trips that come or go. Times stand on
    the axis; changed are the places whose minute is another.
    """
    named = rows.withColumn("id", F.coalesce("new_id", "old_id")).withColumn("key", F.to_json(F.struct("new_id", "old_id")))
    dealt = sheets(named, by, most)
    met = named.alias("r").join(dealt.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "old_seq", "new_seq")])
    side = lambda g: on_axis(F.col("s.axis"), F.col(f"s.{g}_places"), F.col(f"r.{g}_times")).alias(f"{g}_times")
    cells = met.select(*[F.col(f"r.{b}").alias(b) for b in by], "s.sheet", "s.sheet_label", "s.axis", "r.id", "r.key", "r.old_id", "r.new_id", side("old"), side("new"))
    seconds = lambda g: F.transform(f"{g}_times", clock_seconds)
    timed = cells.withColumn("_old", seconds("old")).withColumn("_new", seconds("new"))
    minute = lambda t: F.floor(t / 60)
    moved = F.transform(F.arrays_zip("_old", "_new"), lambda t, i: F.when(~minute(t["_old"]).eqNullSafe(minute(t["_new"])), i))
    changed = F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.filter(moved, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    shown = F.coalesce("_new", "_old")
    first = F.get(F.filter(shown, lambda t: t.isNotNull()), F.lit(0))
    timed = timed.withColumn("changed", changed).withColumn("minutes", F.transform(shown, minute)).withColumn("first", first).drop("_old", "_new")
    return ordered(timed, [*by, "sheet"]).select(*by, "sheet", "sheet_label", "axis", "number", "old_id", "new_id", "old_times", "new_times", "changed")
