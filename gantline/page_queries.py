"""What pages are made of, as queries over the driver's tables, each with its SQL where SQL can express it.

A customer is a page, and an order runs over the classes of its lines' parts, of which there are seven: orders with the same classes are one system. The old generation lacks orders or
lines whose key is divisible by 11, the new one those divisible by 13.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.diff import keyed_diff
from .plans import cells, digest, identity, names, pages, sheets
from .sources.config import load
from .sources.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")).alias("stop"))


def order_runs(spark, sf_dir) -> DataFrame:
    """(page, o_orderkey, seq, day): the classes of each order's parts, in the order of its lines."""
    modes = lines(spark, sf_dir).select("l_orderkey", F.struct("l_linenumber", "stop").alias("l")).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["stop"]).alias("seq"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("page"), "o_orderkey", F.col("o_orderdate").alias("day"))
    return orders.join(modes, F.col("o_orderkey") == F.col("l_orderkey")).select("page", "o_orderkey", "seq", "day")


def order_systems(spark, sf_dir) -> DataFrame:
    runs = order_runs(spark, sf_dir).groupBy("page", F.col("seq").alias("stops")).agg(F.count("*").alias("trips"), F.min("day").alias("earliest"))
    return runs.withColumn("system", F.array_join("stops", ">"))


SYSTEMS_SQL = """
runs AS (SELECT CAST(o_custkey AS VARCHAR) AS page, o_orderkey, min(o_orderdate) AS day, list(stop ORDER BY l_linenumber, stop) AS seq FROM orders JOIN (SELECT *, 'm' || (l_partkey % 7) AS stop FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
s AS MATERIALIZED (SELECT page, seq AS stops, array_to_string(seq, '>') AS system, count(*) AS trips, min(day) AS earliest FROM runs GROUP BY page, seq)"""
#: Places in {b} of the stops that {a} has too, in the order of {a}, each at its first call.
PLACES_SQL = "[list_position({b}, {a}[i]) FOR i IN range(1, len({a}) + 1) IF list_position({a}, {a}[i]) = i AND list_contains({b}, {a}[i])]"
SHARE_SQL = "(SELECT count(*) FILTER (WHERE x.v < y.v) / nullif(count(*), 0) FROM (SELECT unnest(p) AS v, generate_subscripts(p, 1) AS i) x JOIN (SELECT unnest(p) AS v, generate_subscripts(p, 1) AS i) y ON x.i < y.i)"


@query(f"""
WITH RECURSIVE {SYSTEMS_SQL},
met AS (
    SELECT page, a, b, {PLACES_SQL.format(a="sa", b="sb")} AS p FROM (
        SELECT x.page, x.system AS a, y.system AS b, x.stops AS sa, y.stops AS sb, len(list_distinct(list_intersect(x.stops, y.stops))) AS n, len(list_distinct(x.stops || y.stops)) AS u
        FROM s x JOIN s y ON x.page = y.page AND x.system <> y.system) WHERE n >= 3 AND n >= 0.6 * u - 1e-12),
e AS MATERIALIZED (SELECT page, a, b FROM (SELECT page, a, b, {SHARE_SQL} AS share FROM met) WHERE share <= 0.2 OR share >= 0.8),
reach AS (SELECT page, system AS x, system AS y FROM s UNION SELECT r.page, r.x, e.b FROM reach r JOIN e ON e.page = r.page AND e.a = r.y),
c AS (SELECT page, x AS system, min(y) AS component FROM reach GROUP BY page, x),
led AS (SELECT *, first_value(stops) OVER (PARTITION BY page, component ORDER BY trips DESC, earliest, system) AS canonical FROM s JOIN c USING (page, system)),
turned AS (SELECT *, CASE WHEN {SHARE_SQL} <= 0.2 THEN 'reverse' ELSE 'forward' END AS leg FROM (SELECT *, {PLACES_SQL.format(a="stops", b="canonical")} AS p FROM led)),
numbered AS (SELECT page, component, 'dg' || (row_number() OVER (PARTITION BY page ORDER BY sum(trips) DESC, min(system)) - 1) AS dgroup, bool_or(leg = 'reverse') AS two FROM turned GROUP BY page, component)
SELECT page, system, trips, dgroup, leg, CASE WHEN canonical[1] = canonical[-1] THEN 'loop' WHEN two THEN 'bidirectional' ELSE 'one_way' END AS kind,
    CASE WHEN canonical[1] = canonical[-1] THEN canonical[1] || ' 循環' WHEN two THEN canonical[1] || ' ⇄ ' || canonical[-1] ELSE canonical[1] || ' → ' || canonical[-1] END AS label
FROM turned JOIN numbered USING (page, component)""")
def direction_groups(spark, sf_dir):
    """Which systems of a page run the same way, against each other, or on their own."""
    found = pages.direction_groups(order_systems(spark, sf_dir), load()["presentation"], Scratch(spark, "directions"))
    return found.select("page", "system", "trips", "dgroup", "leg", "kind", "label")


@query(f"""
WITH {SYSTEMS_SQL},
t AS (SELECT page, system, '|' || array_to_string(stops, '||') || '|' AS whole, '%|' || array_to_string(stops, '|%|') || '|%' AS inside FROM s)
SELECT a.page, a.system FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.page = a.page AND b.system <> a.system AND b.whole LIKE a.inside)""")
def maximal_sequences(spark, sf_dir):
    """The sequences of a page that no other of it holds: the lines on its map."""
    found = pages.maximal(order_systems(spark, sf_dir).select("page", F.col("stops").alias("seq")), ["page"])
    return found.select("page", F.array_join("seq", ">").alias("system"))


@query()
def stop_axes(spark, sf_dir):
    """One axis for all sequences of a page."""
    return pages.axes(order_systems(spark, sf_dir).select("page", F.col("stops").alias("seq")), ["page"]).select("page", F.array_join("axis", ">").alias("axis"))


@query()
def key_stops(spark, sf_dir):
    """Ends, hubs and branches of each page."""
    scratch = Scratch(spark, "stops")
    systems = scratch.put(order_systems(spark, sf_dir).repartition("page"), "systems")  # what is then counted of a page is mostly counted where it lies
    groups = pages.direction_groups(systems, load()["presentation"], scratch)
    calls = systems.select("page", F.explode("stops").alias("stop"))
    return pages.key_stops(groups, systems.select("page", "system", F.col("stops").alias("seq")), calls, load()["presentation"]["hub_min_groups"])


def both_runs(spark, sf_dir) -> DataFrame:
    """(page, system, old_seq, new_seq): orders of which either generation lacks lines; the system is named by the first of all stops."""
    rows = lines(spark, sf_dir)
    k = F.col("l_orderkey") + F.col("l_linenumber")
    run = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("l_linenumber", "stop")))), lambda x: x["stop"])
    runs = rows.groupBy("l_orderkey").agg(run(k % 11 != 0).alias("old_seq"), run(k % 13 != 0).alias("new_seq"), F.min_by("stop", F.struct("l_linenumber", "stop")).alias("system"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("page"))
    return orders.join(runs, F.col("o_orderkey") == F.col("l_orderkey")).select("page", "system", "old_seq", "new_seq")


@query("""
WITH r AS (
    SELECT o_orderkey, any_value(o_orderpriority) AS page, arg_min(stop, (l_linenumber, stop)) AS system,
        coalesce(list(stop ORDER BY l_linenumber, stop) FILTER (WHERE (l_orderkey + l_linenumber) % 11 <> 0), []) AS o,
        coalesce(list(stop ORDER BY l_linenumber, stop) FILTER (WHERE (l_orderkey + l_linenumber) % 13 <> 0), []) AS n
    FROM orders JOIN (SELECT *, 'm' || (l_partkey % 7) AS stop FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey),
totals AS (SELECT page, system, count(*) AS trips FROM r WHERE system <> 'm3' GROUP BY page, system),
keyed AS (SELECT page, system, list_sort(list_distinct([x FOR x IN n IF NOT list_contains(o, x)])) AS plus, list_sort(list_distinct([x FOR x IN o IF NOT list_contains(n, x)])) AS minus FROM r WHERE o <> n),
by_system AS (SELECT page, plus, minus, system, count(*) AS affected FROM keyed GROUP BY ALL),
units AS (
    SELECT page, plus, minus, CAST(sum(affected) AS BIGINT) AS affected_trips, CAST(sum(coalesce(trips, affected)) AS BIGINT) AS system_trips, string_agg(system, ',' ORDER BY system) AS systems,
        coalesce(bool_and(system IN ('m1', 'm2')) FILTER (WHERE trips IS NOT NULL), false) AS told_above
    FROM by_system LEFT JOIN totals USING (page, system) GROUP BY page, plus, minus)
SELECT page, array_to_string(plus, ',') AS added_stops, array_to_string(minus, ',') AS removed_stops, affected_trips, system_trips, round(affected_trips / system_trips, 3) AS coverage,
    affected_trips / system_trips >= 0.1 AS full_coverage, told_above, systems FROM units""")
def change_units(spark, sf_dir):
    """Each change of stops once: what it adds and takes away, and the share of its systems' trips that have it."""
    runs = Scratch(spark, "units").put(both_runs(spark, sf_dir), "runs")
    totals = runs.filter("system <> 'm3'").groupBy("page", "system").agg(F.count("*").alias("trips"))
    found = pages.change_units(runs.filter("old_seq <> new_seq"), totals, runs.filter("system IN ('m1', 'm2')").select("page", "system"), 0.1)
    text = lambda c: F.array_join(c, ",").alias(c)
    return found.select("page", text("added_stops"), text("removed_stops"), "affected_trips", "system_trips", "coverage", "full_coverage", "told_above", text("systems"))


def page_facts(spark, sf_dir) -> dict[str, DataFrame]:
    """Orders by customer and priority as pages, by status as systems; keys decide what becomes of an order."""
    k = F.col("o_orderkey")
    label = F.when(k % 11 == 0, "added").when(k % 13 == 0, "removed").when(k % 7 == 0, "retimed").when(k % 5 == 0, "retimed_minor").when(k % 3 == 0, "rerouted").otherwise("unchanged")
    orders = table(spark, sf_dir, "orders").filter((k % 11 != 0) | (k % 13 != 0)).select(
        F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("page"), F.col("o_orderstatus").alias("system"), F.date_format("o_orderdate", "E").alias("day_type"), label.alias("label")
    )
    orders = Scratch(spark, "facts").put(orders, "orders")
    old, new = (F.count(F.when(F.col("label") != x, 1)) for x in ("added", "removed"))
    status = F.when(F.col("trips_old") == 0, "added").when(F.col("trips_new") == 0, "removed").otherwise("continued")
    return {
        "totals": orders.groupBy("page").agg(old.alias("old"), new.alias("new")), "systems": orders.groupBy("page", "system").agg(old.alias("trips_old"), new.alias("trips_new")).withColumn("status", status),
        "day_labels": orders.groupBy("page", "day_type", "label").agg(F.count("*").alias("trips")), "day_totals": orders.groupBy("page", "day_type").agg(old.alias("old"), new.alias("new")).withColumn("unsure", F.col("day_type") == "Sun"),
        "notes": orders.filter("system = 'P'").groupBy("page").agg(F.count("*").alias("count")).withColumn("kind", F.lit("shape_changed")),
    }


def page_levels(facts: dict[str, DataFrame]) -> DataFrame:
    """No stops change among these facts, so there are no units."""
    none = facts["totals"].limit(0).select("page", F.array(F.lit("")).alias("added_stops"), F.array(F.lit("")).alias("removed_stops"), F.lit(0).alias("affected_trips"), F.lit(0).alias("system_trips"), F.lit(False).alias("told_above"))
    return pages.summary_levels(facts["totals"], facts["systems"], none, facts["day_labels"], facts["notes"], 1)


FACTS_SQL = """
f AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) || '/' || o_orderpriority AS page, o_orderstatus AS system, strftime(o_orderdate, '%a') AS day_type,
    CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'retimed' WHEN o_orderkey % 5 = 0 THEN 'retimed_minor' WHEN o_orderkey % 3 = 0 THEN 'rerouted' ELSE 'unchanged' END AS label
    FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 13 <> 0),
pg AS (SELECT page, count(*) FILTER (WHERE label <> 'added') AS o, count(*) FILTER (WHERE label <> 'removed') AS n FROM f GROUP BY page),
sy AS (SELECT page, system, count(*) FILTER (WHERE label <> 'added') AS o, count(*) FILTER (WHERE label <> 'removed') AS n FROM f GROUP BY page, system),
below AS (
    SELECT page, 2 AS level, CASE WHEN o = 0 THEN 'system_added' ELSE 'system_removed' END AS kind, system AS subject, o AS lost, n AS gained FROM sy WHERE o = 0 OR n = 0
    UNION ALL SELECT page, 4, 'trips', day_type, count(*) FILTER (WHERE label = 'removed'), count(*) FILTER (WHERE label = 'added') FROM f WHERE label IN ('added', 'removed') GROUP BY page, day_type
    UNION ALL SELECT page, 5, label, NULL, count(*), count(*) FROM f WHERE label LIKE 'retimed%' GROUP BY page, label
    UNION ALL SELECT page, 5, 'shape_changed', NULL, count(*), count(*) FROM f WHERE system = 'P' GROUP BY page),
lev AS MATERIALIZED (
    SELECT page, 1 AS level, CASE WHEN o = 0 THEN 'added' ELSE 'removed' END AS kind, NULL AS subject, o AS lost, n AS gained FROM pg WHERE o = 0 OR n = 0
    UNION ALL SELECT * FROM below WHERE page NOT IN (SELECT page FROM pg WHERE o = 0 OR n = 0))"""


@query(f"WITH {FACTS_SQL} SELECT page, level, kind, subject, lost, gained FROM lev")
def summary_levels(spark, sf_dir):
    """What changed of each page; a higher level silences the lower ones."""
    return page_levels(page_facts(spark, sf_dir))


@query(f"""
WITH {FACTS_SQL},
facts AS (
    SELECT page, 1 AS ord, 'route_' || kind AS kind, lost, gained FROM lev WHERE level = 1
    UNION ALL SELECT page, 2, 'systems', count(*) FILTER (WHERE kind = 'system_removed'), count(*) FILTER (WHERE kind = 'system_added') FROM lev WHERE level = 2 GROUP BY page
    UNION ALL SELECT page, 3, 'reroute', count(*), count(*) FROM f WHERE label = 'rerouted' GROUP BY page
    UNION ALL SELECT page, 4, 'trips', sum(o), sum(n) FROM (SELECT page, day_type, count(*) FILTER (WHERE label <> 'added') AS o, count(*) FILTER (WHERE label <> 'removed') AS n FROM f WHERE day_type <> 'Sun' GROUP BY page, day_type) WHERE o <> n GROUP BY page
    UNION ALL SELECT page, 5, 'retimed', count(*), count(*) FROM f WHERE label = 'retimed' GROUP BY page
    UNION ALL SELECT page, 6, 'retimed_minor', count(*), count(*) FROM f WHERE label = 'retimed_minor' AND page NOT IN (SELECT page FROM f WHERE label = 'retimed') GROUP BY page
    UNION ALL SELECT page, 7, 'notes_only', count(*), sum(gained) FROM lev WHERE kind = 'shape_changed' GROUP BY page),
fits AS (SELECT *, min(ord) OVER (PARTITION BY page) AS least FROM facts)
SELECT page, CAST(rank AS INTEGER) AS rank, kind, CAST(lost AS BIGINT) AS lost, CAST(gained AS BIGINT) AS gained FROM (
    SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS rank FROM fits WHERE (ord = 1 OR least > 1) AND (ord <> 7 OR least = 7)) WHERE rank <= 3""")
def page_headlines(spark, sf_dir):
    """The first three facts of each page."""
    facts = page_facts(spark, sf_dir)
    return pages.headlines(page_levels(facts), facts["day_labels"], facts["day_totals"])


def shown_orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as trips of a page (a customer), under their priority, which differs between generations where the key is divisible by 7; and pairs of one key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), "o_orderpriority", F.col("o_orderkey").alias("k"))
    side = lambda g, label, which: orders.filter(which).select(F.lit(g).alias("gen"), "page", label.alias("label"), F.col("k").cast("string").alias("trip_id"))
    k = F.col("k")
    trips = side("old", F.col("o_orderpriority"), k % 11 != 0).unionByName(side("new", F.when(k % 7 == 0, "0-CHANGED").otherwise(F.col("o_orderpriority")), k % 13 != 0))
    both = orders.filter((k % 11 != 0) & (k % 13 != 0)).select(k.cast("string").alias("old_id"), k.cast("string").alias("new_id"), F.lit("exact").alias("relation"))
    return trips, both


@query("""
WITH o AS (SELECT o_custkey AS page, o_orderpriority AS label, CAST(o_orderkey AS VARCHAR) AS old_id FROM orders WHERE o_orderkey % 11 <> 0),
n AS (SELECT o_custkey AS page, CASE WHEN o_orderkey % 7 = 0 THEN '0-CHANGED' ELSE o_orderpriority END AS label, CAST(o_orderkey AS VARCHAR) AS new_id FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(o.page, n.page) AS page, coalesce(o.label, n.label) AS label, old_id, new_id, CASE WHEN new_id IS NULL THEN 'removed' WHEN old_id IS NULL THEN 'added' ELSE 'exact' END AS relation
FROM o FULL JOIN n ON old_id = new_id AND o.page = n.page AND o.label = n.label""")
def page_pairs(spark, sf_dir):
    """Pairs that are shown as pairs, and the trips of a page that are left, each once."""
    return cells.page_pairs(*shown_orders(spark, sf_dir))


@query("SELECT 0 AS page, '' AS label, '' AS gen, CAST(0 AS BIGINT) AS trips, CAST(0 AS BIGINT) AS columns WHERE false")
def page_closure(spark, sf_dir):
    """Pages whose columns don't add up to their trips: none."""
    trips, pairs = shown_orders(spark, sf_dir)
    scratch = Scratch(spark, "closure")
    trips = scratch.put(trips, "trips")
    return cells.unlike_totals(trips, scratch.put(cells.page_pairs(trips, pairs), "pairs"))


def world_pairs(spark, sf_dir) -> DataFrame:
    """Orders of both generations: a world is a year, and in the new generation some orders stand 200 days later."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    moved = F.when(k % 3 == 0, F.date_add(day, 200)).otherwise(day)
    year = lambda d: F.year(d).cast("string")
    orders = table(spark, sf_dir, "orders").filter((k % 11 != 0) & (k % 13 != 0))
    return orders.select(F.col("o_orderpriority").alias("page"), F.col("o_orderstatus").alias("direction"), F.lit("daily").alias("day_type"), year(day).alias("old_world"), year(moved).alias("new_world"))


@query("""
SELECT o_orderpriority AS page, o_orderstatus AS direction, CAST(year(o_orderdate) AS VARCHAR) AS old_world,
    CAST(year(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 200 DAY ELSE o_orderdate END) AS VARCHAR) AS new_world, count(*) AS trips
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 GROUP BY ALL""")
def world_flows(spark, sf_dir):
    """Trips from each old world to each new one."""
    return cells.world_flows(world_pairs(spark, sf_dir), cells.PAGE_CELL).drop("day_type")


@query()
def day_cells(spark, sf_dir):
    """Years of the generations side by side: by content, then days, then where most orders went."""
    scratch = Scratch(spark, "cells")
    pairs = scratch.put(world_pairs(spark, sf_dir), "pairs")

    def patterns(gen: str) -> DataFrame:
        """A year's timetable is how many orders it has, in hundreds; it holds on the days since 1990 of its first and last."""
        sized = pairs.groupBy("page", "direction", "day_type", F.col(f"{gen}_world").alias("world")).agg(F.floor(F.count("*") / 100).cast("string").alias("digest"))
        held = sized.groupBy("page", "direction", "day_type", "digest").agg(F.array_sort(F.collect_list("world")).alias("worlds"))
        held = held.select("page", F.col("direction").alias("family"), "direction", "day_type", "digest", "worlds", F.transform("worlds", lambda w: F.concat(w, F.lit(gen))).alias("dates"))
        return cells.page_patterns(held.withColumnRenamed("page", "_page").withColumn("family", F.concat_ws("/", "_page", "family")), held.select(F.concat_ws("/", "page", "family").alias("family"), "page").distinct())

    found = cells.day_cells(patterns("old"), patterns("new"), cells.world_flows(pairs, cells.PAGE_CELL), scratch)
    return found.cells.select("page", "day_type", "label", "signal", F.array_join("old_dates", ",").alias("old_dates"), F.array_join("new_dates", ",").alias("new_dates"))


def user_columns(spark, sf_dir) -> DataFrame:
    """A user's events as a table: a day is a column, its event types (at their first time) the stops; the old generation lacks events divisible by 11, the new one those by 13."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "ts", "event_id")
    sides = events.select("user_id", "day", "event_type", "ts", F.explode(F.filter(F.array(F.when(F.col("event_id") % 11 != 0, "old"), F.when(F.col("event_id") % 13 != 0, "new")), lambda g: g.isNotNull())).alias("gen"))
    first = sides.groupBy("user_id", "day", "gen", "event_type").agg(F.min("ts").alias("ts"))
    runs = first.groupBy("user_id", "day", "gen").agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("r"))
    side = lambda g: runs.filter(F.col("gen") == g).select("user_id", "day", F.date_format("day", "yyyyMMdd").alias(f"{g}_id"), F.transform("r", lambda x: x["event_type"]).alias(f"{g}_seq"), F.transform("r", lambda x: F.date_format(x["ts"], "HH:mm:ss")).alias(f"{g}_times"))
    return side("old").join(side("new"), ["user_id", "day"], "full_outer").drop("day")


@query()
def timetable_sheets(spark, sf_dir):
    """Old and new columns of each user's table, dealt into sheets and put in order."""
    found = sheets.timetables(Scratch(spark, "sheets").put(user_columns(spark, sf_dir), "columns"), ["user_id"], load()["presentation"]["sheet_max_gap_per_trip"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ").alias(c)
    return found.select("user_id", "sheet", "sheet_label", text("axis"), "number", "old_id", "new_id", text("old_times"), text("new_times"), text("changed"))


@query("""
WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, min(ts) AS ts FROM events WHERE event_id % 11 <> 0 GROUP BY ALL),
n AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, min(ts) AS ts FROM events WHERE event_id % 13 <> 0 GROUP BY ALL),
os AS (SELECT user_id, day, list(event_type ORDER BY ts, event_type) AS seq, list(strftime(ts, '%H:%M:%S') ORDER BY ts, event_type) AS t FROM o GROUP BY ALL),
ns AS (SELECT user_id, day, list(event_type ORDER BY ts, event_type) AS seq, list(strftime(ts, '%H:%M:%S') ORDER BY ts, event_type) AS t FROM n GROUP BY ALL)
SELECT user_id, CASE WHEN os.seq IS NOT NULL THEN strftime(day, '%Y%m%d') END AS old_id, CASE WHEN ns.seq IS NOT NULL THEN strftime(day, '%Y%m%d') || CASE WHEN day(day) % 5 = 0 THEN 'x' ELSE '' END END AS new_id,
    CASE WHEN os.seq IS NULL THEN 'added' WHEN ns.seq IS NULL THEN 'removed' WHEN os.seq <> ns.seq THEN 'rerouted' WHEN os.t <> ns.t THEN 'retimed' WHEN day(day) % 5 = 0 THEN 'id_changed' ELSE 'unchanged' END AS status,
    os.t[1][1:5] AS departure_old, ns.t[1][1:5] AS departure_new
FROM os FULL JOIN ns USING (user_id, day)""")
def column_statuses(spark, sf_dir):
    """What became of each column of the users' tables; the new generation calls every fifth day by another id."""
    scratch = Scratch(spark, "statuses")
    fifth = F.col("new_id").substr(7, 2).cast("int") % 5 == 0
    rows = scratch.put(user_columns(spark, sf_dir).withColumn("new_id", F.when(fifth, F.concat("new_id", F.lit("x"))).otherwise(F.col("new_id"))), "columns")
    found = sheets.timetables(rows, ["user_id"], load()["presentation"]["sheet_max_gap_per_trip"])
    same = rows.filter("old_seq = new_seq AND old_times = new_times").select("user_id", "old_id", "new_id", F.lit("exact").alias("relation"))
    told = digest.column_statuses(found.join(same, ["user_id", "old_id", "new_id"], "left"), F.coalesce("relation", F.lit("modified")))
    return told.select("user_id", "old_id", "new_id", "status", "departure_old", "departure_new")


@query("""
WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 11 <> 0),
new AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 7 = 0 THEN '0-CHANGED' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 13 <> 0),
m AS (SELECT o.k AS ok, n.k AS nk, o.p AS op, n.p AS np FROM old o FULL JOIN new n ON o.k = n.k)
SELECT 'orders.txt' AS file, 'continued' AS status, (SELECT count(*) FROM old) AS rows_old, (SELECT count(*) FROM new) AS rows_new, count(*) FILTER (WHERE ok IS NULL) AS row_added,
    count(*) FILTER (WHERE nk IS NULL) AS row_removed, count(*) FILTER (WHERE op <> np) AS field_changed, CAST(0 AS BIGINT) AS column_changes FROM m
UNION ALL SELECT 'lineitem.txt', 'continued', count(*) FILTER (WHERE l_orderkey % 11 <> 0), count(*) FILTER (WHERE l_orderkey % 13 <> 0), count(*) FILTER (WHERE l_orderkey % 11 = 0 AND l_orderkey % 13 <> 0),
    count(*) FILTER (WHERE l_orderkey % 13 = 0 AND l_orderkey % 11 <> 0), 0, 1 FROM lineitem
UNION ALL SELECT 'customer.txt', 'removed', count(*), NULL, 0, 0, 0, 0 FROM customer
UNION ALL SELECT 'supplier.txt', 'added', NULL, count(*), 0, 0, 0, 0 FROM supplier""")
def file_overview(spark, sf_dir):
    """The files of two generations: orders are compared row by row, of lineitem only how many rows come and go is kept, and one column; customers are in the old one alone, suppliers in the new one."""
    orders, lines_ = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    side = lambda which, priority: orders.filter(which).select(k.cast("string").alias("o_orderkey"), "o_orderstatus", priority.alias("o_orderpriority"))
    old, new = side(k % 11 != 0, F.col("o_orderpriority")), side(k % 13 != 0, F.when(k % 7 == 0, "0-CHANGED").otherwise(F.col("o_orderpriority")))
    diffs = keyed_diff(old, new, ["o_orderkey"]).select(F.lit("orders.txt").alias("file"), "kind", "old_value", "new_value")
    o, n = F.col("l_orderkey") % 11 != 0, F.col("l_orderkey") % 13 != 0
    count = lambda which: F.count(F.when(which, 1))
    of = lines_.agg(count(o).alias("old"), count(n).alias("new"), count(n & ~o).cast("string").alias("come"), count(o & ~n).cast("string").alias("gone"))
    none = F.lit(None).cast("string")
    told = lambda kind, gone, come: F.struct(F.lit(kind).alias("kind"), gone.alias("old_value"), come.alias("new_value"))
    bulk = of.select(F.inline(F.array(told("rows_added_bulk", none, F.col("come")), told("rows_removed_bulk", F.col("gone"), none), told("column_added", none, none)))).select(F.lit("lineitem.txt").alias("file"), "kind", "old_value", "new_value")
    rows = lambda df, file, n=None: df.agg(F.lit(f"{file}.txt").alias("file"), F.count("*").alias("rows")) if n is None else df.select(F.lit(f"{file}.txt").alias("file"), F.col(n).alias("rows"))
    old_rows = rows(old, "orders").unionByName(rows(of, "lineitem", "old")).unionByName(rows(table(spark, sf_dir, "customer"), "customer"))
    new_rows = rows(new, "orders").unionByName(rows(of, "lineitem", "new")).unionByName(rows(table(spark, sf_dir, "supplier"), "supplier"))
    return digest.file_table(diffs.unionByName(bulk), old_rows, new_rows)


@query("""
WITH s AS (SELECT c_nationkey AS component, CAST(c_custkey % 60 AS VARCHAR) AS family, c_custkey % 3 AS r FROM customer),
old AS (SELECT DISTINCT component, family FROM s WHERE r <> 0), new AS (SELECT DISTINCT component, family FROM s WHERE r <> 1),
gone AS (SELECT component, family AS name, CASE WHEN CAST(family AS INTEGER) % 4 = 0 THEN family ELSE 'p' || (CAST(family AS INTEGER) % 10) END AS stood FROM old ANTI JOIN new USING (component, family))
SELECT DISTINCT 'p' || (CAST(n.family AS INTEGER) % 10) AS page, CASE WHEN stood = 'p' || (CAST(n.family AS INTEGER) % 10) THEN 'former' ELSE 'related' END AS kind, name FROM gone JOIN new n USING (component)""")
def page_names(spark, sf_dir):
    """Former and related names of pages: nations tie customers of two generations together."""
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("component"), (F.col("c_custkey") % 60).cast("string").alias("family"), (F.col("c_custkey") % 3).alias("r"))
    side = lambda gen, which: s.filter(which).select("component", F.lit(gen).alias("side"), "family").distinct()
    known = s.select("family", F.concat(F.lit("p"), (F.col("family").cast("int") % 10).cast("string")).alias("page")).distinct()
    return names.renamed(side("old", "r <> 0").unionByName(side("new", "r <> 1")), known.filter("cast(family AS int) % 4 <> 0"), known)


@query("""
WITH e AS (SELECT 'c' || (o_custkey % 200) AS old_id, 'o' || (o_orderkey % 200) AS new_id, round(o_totalprice / 1000000, 4) AS confidence, o_custkey % 20 AS og, o_orderkey % 20 AS ng FROM orders),
b AS (SELECT 'g' || og AS page, new_id AS name, max(confidence) AS similarity FROM e WHERE og % 3 = 0 GROUP BY ALL UNION ALL SELECT 'h' || ng, old_id, max(confidence) FROM e WHERE ng % 3 = 1 GROUP BY ALL),
r AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY similarity DESC, name) AS INTEGER) AS place, name, similarity FROM b)
SELECT * FROM r WHERE place <= 3""")
def similar_pages(spark, sf_dir):
    """The likest names of the other generation for pages that come or go; orders are the candidates, of families of customers and of orders."""
    orders = table(spark, sf_dir, "orders")
    of = lambda letter, key, by: F.concat(F.lit(letter), (F.col(key) % by).cast("string"))
    edges = orders.select(of("c", "o_custkey", 200).alias("old_id"), of("o", "o_orderkey", 200).alias("new_id"), F.round(F.col("o_totalprice") / 1000000, 4).alias("confidence"))
    old = orders.select(F.lit("old").alias("gen"), of("c", "o_custkey", 200).alias("family"), of("g", "o_custkey", 20).alias("group")).distinct()
    new = orders.select(F.lit("new").alias("gen"), of("o", "o_orderkey", 200).alias("family"), of("h", "o_orderkey", 20).alias("group")).distinct()
    groups = old.unionByName(new)
    number = F.substring("group", 2, 2).cast("int") % 3
    kind = F.when((F.col("gen") == "old") & (number == 0), "removed").when((F.col("gen") == "new") & (number == 1), "added")
    return names.similar(edges, groups, groups.select(F.col("group").alias("page"), kind.alias("kind")).dropna().distinct())


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, list(event_type ORDER BY ts, event_id) AS seq FROM events GROUP BY ALL),
c AS (SELECT 'u' || (user_id % 5) AS family, CAST(day(day) % 2 AS VARCHAR) AS direction, seq, count(*) AS trip_count FROM d GROUP BY ALL)
SELECT family || '|' || direction || '|p' || (row_number() OVER (PARTITION BY family, direction ORDER BY trip_count DESC, seq) - 1) AS pattern_id, array_to_string(seq, '>') AS stops, trip_count FROM c""")
def numbered_patterns(spark, sf_dir):
    """Distinct sequences of users' days, numbered in their family and direction by how often they occur."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", "event_type").alias("e"))
    days = events.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["event_type"]).alias("base_seq"))
    trips = days.select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("family"), (F.dayofmonth("day") % 2).cast("string").alias("direction"), "base_seq")
    return identity.patterns(trips).select("pattern_id", F.array_join("base_seq", ">").alias("stops"), "trip_count")
