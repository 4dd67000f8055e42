"""Tables that explain a comparison: band profiles, id mapping, coverage, overviews, digests, and searches in them.

All are DataFrames over what ``compare`` wrote; the writers at the end store them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day_order, time_band
from ..functions.events import EVENT_TYPES
from ..operators import ledger
from ..operators.diff import top_k
from ..operators.groups import search, subtotals
from ..sources.feed import Feed
from ..sources.scratch import Scratch, global_rank
from . import identity as I
from .compare import Comparison, by_route_group
from .rules import polylines

CELL = ["family", "direction", "day_type"]
RESIDUAL = "UNEXPLAINED_RESIDUAL"


def both_sides(c: Comparison) -> DataFrame:
    cols = [*CELL, "trip_id", "base_seq", "departure", "service_id"]
    return c.delta.old.select(F.lit("old").alias("gen"), *cols).unionByName(c.delta.new.select(F.lit("new").alias("gen"), *cols))


def old_new_counts() -> list[Column]:
    return [F.count(F.when(F.col("gen") == g, 1)).alias(f"{g}_count") for g in ("old", "new")]


def band_profiles(c: Comparison) -> DataFrame:
    """Trips of each generation by family, direction, day type and time band."""
    band = time_band(F.col("departure"), c.config["events"]["frequency"]["time_bands"])
    return both_sides(c).groupBy(*CELL, band.alias("band")).agg(*old_new_counts())


def band_matrix(c: Comparison) -> DataFrame:
    """The same by route group, with subtotals by system (a stop pattern), direction and day type."""
    band = time_band(F.col("departure"), c.config["events"]["frequency"]["time_bands"])
    groups = c.identity.groups.select("gen", "family", "group")
    rows = both_sides(c).join(groups, ["gen", "family"], "left").select("gen", F.coalesce("group", "family").alias("group"), "day_type", "direction", F.array_join("base_seq", ">").alias("system"), band.alias("band"))
    sets = [["group", "day_type", "direction", "system", "band"], ["group", "day_type", "direction", "band"], ["group", "day_type", "band"]]
    return subtotals(rows, sets, *old_new_counts())


def day_totals(c: Comparison) -> DataFrame:
    return both_sides(c).groupBy("day_type").agg(*old_new_counts())


def family_structure(c: Comparison, least_trips: int = 2) -> DataFrame:
    """(family, clusters, least_jaccard): families whose pattern clusters of at least so many trips are several, and how unlike the most unlike two are."""
    big = c.identity.new.pattern_clusters.filter(F.col("trip_count") >= least_trips).select("family", "cluster_id", F.array_distinct("base_seq").alias("s"))
    a, b = big.select("family", F.col("cluster_id").alias("a"), F.col("s").alias("sa")), big.select("family", F.col("cluster_id").alias("b"), F.col("s").alias("sb"))
    jaccard = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    pairs = a.join(b, "family").filter("a < b").groupBy("family").agg(F.round(F.min(jaccard), 4).alias("least_jaccard"))
    return big.groupBy("family").agg(F.count("*").alias("clusters")).join(pairs, "family")


#: Events of the feed as a whole.
OF_FEED = ["DAYTYPE_RESTRUCTURED", "HOLIDAY_EXCEPTION_CHANGED", "SEASONAL_SERVICE_CHANGED", "FEED_VALIDITY_CHANGED", "AGENCY_INFO_CHANGED", "TRANSLATION_CHANGED", "FARE_CHANGED", "DEMAND_RESPONSIVE_CHANGE", "GENERATION_SCOPE"]


def destination(event_type: Column, group: Column) -> Column:
    """The part of a report that tells of an event: 1 the feed as a whole, 2 stops, 3 the pages of routes, 4 what is counted only. Events of routes and timetables need a route group or family to be told of."""
    of = lambda letters: [t for t, (letter, _) in EVENT_TYPES.items() if letter in letters]
    routed = [t for t in of("ABC") if t != "SHAPE_CHANGED"] + ["HEADSIGN_CHANGED"]
    return F.when(event_type.isin(OF_FEED), 1).when(event_type.isin(of("D")), 2).when(event_type.isin(routed) & (F.coalesce(group, F.lit("")) != ""), 3).otherwise(4)


def event_parts(c: Comparison) -> DataFrame:
    """(event_id, type, part)."""
    return c.events.select("event_id", "type", destination(F.col("type"), F.get_json_object("subject", "$.route_family")).alias("part"))


def coverage(c: Comparison) -> DataFrame:
    """(part, differences): how many differences each part of a report accounts for, each counted at its first event."""
    return ledger.primary(c.claims).join(event_parts(c), "event_id").groupBy("part").agg(F.count("*").alias("differences"))


def evidence_sample(c: Comparison) -> DataFrame:
    """(event_id, evidence_count, sample): the first differences of each event."""
    most = c.config["report"]["evidence_sample_max"]
    counts = c.claims.groupBy("event_id").agg(F.count("*").alias("evidence_count"))
    sample = top_k(c.claims.select("event_id", "rawdiff_id"), ["event_id"], [F.col("rawdiff_id")], most).groupBy("event_id").agg(F.array_sort(F.collect_list("rawdiff_id")).alias("sample"))
    return counts.join(sample, "event_id")


def file_sample(c: Comparison) -> DataFrame:
    """The first differences of each file and kind, each with its first explainer."""
    most = c.config["report"]["file_diff_sample_max"]
    return top_k(c.diffs, ["file", "kind"], [F.col("seq")], most).join(ledger.primary(c.claims), "rawdiff_id", "left").drop("rank")


def file_overview(c: Comparison) -> DataFrame:
    """(file, differences, rows_bulk, unexplained): bulk differences count as the rows they stand for."""
    size = F.when(F.col("kind").endswith("_bulk"), F.coalesce("old_value", "new_value").cast("long")).otherwise(1)
    told = c.diffs.groupBy("file").agg(F.sum(size).alias("differences"), F.count(F.when(F.col("kind").endswith("_bulk"), 1)).alias("rows_bulk"))
    return told.join(c.residual(), "file", "left").withColumn("residual", F.coalesce("residual", F.lit(0)))


def id_rows(entity: str, pairs: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """(entity, old_ids, new_ids, relation, confidence) from pairs (old_id, new_id, relation, confidence) and the ids of what has no partner.

    Pairs of the same id are exact and of others id_churn, unless they are modified.
    """
    none, no_figure = F.array().cast("array<string>"), F.lit(None).cast("double")
    relation = F.when(F.col("relation") == "modified", "modified").when(F.col("old_id") == F.col("new_id"), "exact").otherwise("id_churn")
    row = lambda df, old, new, relation, figure: df.select(F.lit(entity).alias("entity"), old.alias("old_ids"), new.alias("new_ids"), relation.alias("relation"), figure.alias("confidence"))
    out = row(pairs, F.array("old_id"), F.array("new_id"), relation, F.col("confidence"))
    out = out.unionByName(row(gone.toDF("id"), F.array("id"), none, F.lit("removed"), no_figure))
    return out.unionByName(row(come.toDF("id"), none, F.array("id"), F.lit("added"), no_figure))


def mapping(c: Comparison) -> DataFrame:
    """(entity, old_ids, new_ids, relation, confidence) of stops, routes, trips and day types; several to several stay arrays."""
    ident, accept = c.identity, c.config["events"]["accept_confidence"]
    one = lambda x: F.array(x)
    none = F.array().cast("array<string>")
    best = I.best(ident.stop_edges, "old_id", accept)
    name = lambda df, n: df.select(F.col("cluster_id").alias(f"{n}_id"), F.col("base_name").alias(f"{n}_name"))
    pairs = best.join(name(ident.old.clusters, "old"), "old_id").join(name(ident.new.clusters, "new"), "new_id")
    stops = pairs.select(F.lit("stop").alias("entity"), one("old_id").alias("old_ids"), one("new_id").alias("new_ids"), F.when(F.col("old_name") == F.col("new_name"), "continued").otherwise("renamed").alias("relation"), "confidence")
    reached = ident.stop_edges.filter(F.col("confidence") >= accept).select(F.col("new_id").alias("cluster_id")).distinct()
    gone = ident.old.clusters.join(best.select(F.col("old_id").alias("cluster_id")), "cluster_id", "left_anti")
    come = ident.new.clusters.join(reached, "cluster_id", "left_anti")
    alone = lambda df, entity, col, old: df.select(F.lit(entity).alias("entity"), (one(col) if old else none).alias("old_ids"), (none if old else one(col)).alias("new_ids"), F.lit("removed" if old else "added").alias("relation"), F.lit(None).cast("double").alias("confidence"))
    out = stops.unionByName(alone(gone, "stop", "cluster_id", True)).unionByName(alone(come, "stop", "cluster_id", False))
    comps = ident.components.filter("NOT demoted")
    out = out.unionByName(comps.select(F.lit("route").alias("entity"), F.col("old").alias("old_ids"), F.col("new").alias("new_ids"), F.col("shape").alias("relation"), F.col("similarity").alias("confidence")))
    families = lambda s: s.families.select("family").distinct()
    old, new = families(ident.old), families(ident.new)
    in_comp = lambda side: comps.select(F.explode(side).alias("family")).distinct()
    same = old.join(new, "family").join(in_comp("old"), "family", "left_anti")
    out = out.unionByName(same.select(F.lit("route").alias("entity"), one("family").alias("old_ids"), one("family").alias("new_ids"), F.lit("continued").alias("relation"), F.lit(1.0).alias("confidence")))
    out = out.unionByName(alone(old.join(new, "family", "left_anti").join(in_comp("old"), "family", "left_anti"), "route", "family", True))
    out = out.unionByName(alone(new.join(old, "family", "left_anti").join(in_comp("new"), "family", "left_anti"), "route", "family", False))
    out = out.unionByName(id_rows("trip", c.delta.pairs.withColumn("confidence", F.lit(1.0)), c.delta.removed.select("trip_id"), c.delta.added.select("trip_id")))
    labels = {g: c.types[g].select(F.col("day_type").alias("d")).distinct() for g in c.types}
    kept = labels["old"].join(labels["new"], "d").select(F.lit("day_type").alias("entity"), one("d").alias("old_ids"), one("d").alias("new_ids"), F.lit("continued").alias("relation"), F.lit(1.0).alias("confidence"))
    return out.unionByName(kept).unionByName(alone(labels["old"].subtract(labels["new"]), "day_type", "d", True)).unionByName(alone(labels["new"].subtract(labels["old"]), "day_type", "d", False))


def map_ids(c: Comparison, text: str, most: int = 20) -> DataFrame:
    """Rows of the mapping that name an id or part of one, how many there are, and whether some aren't shown."""
    named = F.exists(F.concat("old_ids", "new_ids"), lambda x: x.contains(text))
    found = search(mapping(c), [named], ["entity", "old_ids", "new_ids"], most).drop("total").withColumnRenamed("matched", "total")
    return found.withColumn("truncated", F.col("total") > most)


def get_events(c: Comparison, type_: str | None = None, severity: str | None = None, route: str | None = None, most: int = 50) -> DataFrame:
    """Events by type, severity and part of a subject, at most 200, with how many match and how many there are."""
    wanted = [F.col(column) == value for value, column in ((type_, "type"), (severity, "severity")) if value] + ([F.col("subject").contains(route)] if route else [])
    return search(c.events, wanted, ["event_seq"], min(200, max(1, most)))


def route_digest(c: Comparison) -> DataFrame:
    """(route_group, events, majors, types): what changed of each route group, the most changed first in ``rank``."""
    grouped = by_route_group(c.events, c.identity.groups).filter("route_group IS NOT NULL")
    told = grouped.groupBy("route_group").agg(F.count("*").alias("events"), F.count(F.when(F.col("severity") == "major", 1)).alias("majors"), F.array_sort(F.collect_set("type")).alias("types"))
    placed = global_rank(told, Scratch(told.sparkSession, "digest"), [F.desc("majors"), F.desc("events"), F.col("route_group")])
    return placed.withColumn("rank", F.col("rank") + 1)


def group_events(c: Comparison, group: str) -> DataFrame:
    """The events of one route group, in order."""
    return by_route_group(c.events, c.identity.groups).filter(F.col("route_group") == group).orderBy("event_seq").select("event_id", "type", "severity", "subject", "quantification")


def unchanged_groups(c: Comparison) -> DataFrame:
    """Route groups of both generations of which no event tells."""
    changed = by_route_group(c.events, c.identity.groups).select(F.col("route_group").alias("group")).dropna()
    return c.identity.groups.groupBy("group").agg(F.count_distinct("gen").alias("gens")).filter("gens = 2").select("group").join(changed, "group", "left_anti")


def agency_names(feed: Feed) -> list[str]:
    """The names of a feed's agencies, each once, in the order of the file."""
    if not feed.has("agency", "agency_name"):
        return []
    named = feed.table("agency").select(F.trim("agency_name").alias("name"), "_line").filter("name <> ''")
    return [r["name"] for r in named.groupBy("name").agg(F.min("_line").alias("at")).orderBy("at").collect()]  # a feed has few agencies


def version(feed: Feed) -> str | None:
    """What a feed says of its version."""
    row = feed.table("feed_info").orderBy("_line").select(F.trim("feed_version")).first() if feed.has("feed_info", "feed_version") else None
    return row[0] or None if row else None


def shape_lines(c: Comparison, old: Feed, new: Feed) -> DataFrame:
    """(generation, shape_id, geojson): the lines that events on shapes speak of, as they were and as they are."""
    told = c.events.filter(F.col("type").isin("SHAPE_CHANGED", "TECHNICAL_ID_CHURN"))
    subject, most = F.get_json_object("subject", "$.shape_id"), c.config["events"]["shape"]["max_polyline_points"]
    out = None
    for gen, feed in (("old", old), ("new", new)):
        wanted = told.select(F.coalesce(F.get_json_object("quantification", f"$.{gen}_shape"), subject).alias("shape_id")).filter("shape_id <> ''").distinct()
        lines = polylines(feed, most, wanted)
        line = F.struct(F.lit("LineString").alias("type"), F.transform("line", lambda p: F.array(p[1], p[0])).alias("coordinates"))
        about = F.struct("shape_id", F.lit(gen).alias("generation"), F.lit("shape").alias("kind"))
        rows = lines.select(F.lit(gen).alias("generation"), "shape_id", F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), about.alias("properties"))).alias("geojson"))
        out = rows if out is None else out.unionByName(rows)
    return out


def stop_points(c: Comparison) -> DataFrame:
    """(status, geojson) of stops that are in both generations, gone or new."""
    best = I.best(c.identity.stop_edges, "old_id", c.config["events"]["accept_confidence"])
    reached = c.identity.stop_edges.filter(F.col("confidence") >= c.config["events"]["accept_confidence"]).select("new_id").distinct()
    old, new = c.identity.old.clusters, c.identity.new.clusters
    gone = old.join(best.select(F.col("old_id").alias("cluster_id")), "cluster_id", "left_anti").withColumn("status", F.lit("removed"))
    marked = new.join(reached.select(F.col("new_id").alias("cluster_id"), F.lit(1).alias("hit")), "cluster_id", "left").withColumn("status", F.when(F.col("hit").isNull(), "added").otherwise("matched"))
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("name", "status").alias("properties")))
    return gone.select("cluster_id", "name", "lat", "lon", "status").unionByName(marked.select("cluster_id", "name", "lat", "lon", "status")).select("status", point.alias("geojson"))


def write(c: Comparison, path: str) -> None:
    """Events with their evidence, differences and the mapping as compressed JSON lines, a folder each."""
    evidence = c.claims.groupBy("event_id").agg(F.array_sort(F.collect_set("rawdiff_id")).alias("evidence"))
    for name, rows in (("events", c.events.join(evidence, "event_id", "left").drop("step", "key", "ord")), ("rawdiffs", c.diffs), ("mapping", mapping(c)), ("accounting", c.explained())):
        rows.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")


def chapters(c: Comparison, most: int, most_events: int = 20) -> list[str]:
    """Lines of a chapter for each of the first route groups: its first events, and trips by day type and time band where their number changed."""
    names = [r["route_group"] for r in route_digest(c).orderBy("rank").limit(most).collect()]
    told = by_route_group(c.events, c.identity.groups).filter(F.col("route_group").isin(names))
    events: dict[str, list] = {n: [] for n in names}
    for r in top_k(told, ["route_group"], [F.col("event_seq")], most_events).orderBy("event_seq").collect():
        events[r["route_group"]].append(r)
    bands: dict[str, list] = {n: [] for n in names}
    changed = band_matrix(c).filter("direction IS NULL AND system IS NULL AND old_count <> new_count").filter(F.col("group").isin(names))
    for r in changed.orderBy("group", day_order(F.col("day_type")), "band").collect():  # day types times bands of the named groups
        bands[r["group"]].append(r)
    lines = []
    for name in names:
        lines += ["", f"### {name}", "", *[f"- {r['type']}{' (' + r['severity'] + ')' if r['severity'] else ''}: {r['quantification'] or r['subject']}" for r in events[name]]]
        if bands[name]:
            lines += ["", "| day type | time band | before | after |", "|-|-|-|-|", *[f"| {r['day_type']} | {r['band']} | {r['old_count']} | {r['new_count']} |" for r in bands[name]]]
    return lines


#: Lists of a report's summary: what is said, the type of event, and where the event names its subject.
SUMMARY = [
    ("New routes", "ROUTE_ADDED", "route_family"), ("Discontinued routes", "ROUTE_DISCONTINUED", "route_family"), ("Renamed routes", "ROUTE_RENAMED", None),
    ("New stops", "STOP_ADDED", "stop_cluster"), ("Removed stops", "STOP_REMOVED", "stop_cluster"), ("Renamed stops", "STOP_RENAMED", None),
]


def more(n: int, most: int) -> str:
    return f" and {n - most} more" if n > most else ""


def summary(c: Comparison, most: int) -> list[str]:
    """Lines that name what comes, goes and is renamed, and the major events; of each list the first, and how many more there are."""
    was, now = (F.get_json_object(f"{g}_ref", "$.name") for g in ("old", "new"))
    own = F.coalesce(*[F.when(F.col("type") == t, F.get_json_object("subject", f"$.{path}")) for _, t, path in SUMMARY if path])
    of = c.events.filter(F.col("type").isin(*[t for _, t, _ in SUMMARY])).withColumn("said", F.coalesce(F.when(was.isNotNull() & now.isNotNull() & F.col("type").endswith("RENAMED"), F.concat(was, F.lit(" -> "), now)), own)).dropna(subset=["said"])
    counts = {r["type"]: r["n"] for r in of.groupBy("type").agg(F.count("*").alias("n")).collect()}
    named: dict[str, list[str]] = {}
    for r in top_k(of, ["type"], [F.col("said"), F.col("event_seq")], most).orderBy("type", "rank").collect():
        named.setdefault(r["type"], []).append(r["said"])
    lines = [f"- {title}: {', '.join(named[t])}{more(counts[t], most)}" for title, t, _ in SUMMARY if t in named]
    lines += ["- Fares changed"] if c.events.filter("type = 'FARE_CHANGED'").limit(1).count() else []
    majors = c.events.filter("severity = 'major'")
    first = majors.orderBy("event_seq").limit(most).collect()
    lines += ["", "### Major", "", "| type | of | what |", "|-|-|-|", *[f"| {r['type']} | {r['subject']} | {r['quantification'] or ''} |" for r in first]] if first else []
    n = majors.count() if len(first) == most else 0
    return lines + ([f"{more(n, most).strip()}"] if n > most else [])


def stop_chapter(c: Comparison, most: int) -> list[str]:
    """Lines of the events of stops, by type and subject."""
    told = c.events.join(event_parts(c).filter("part = 2").select("event_id"), "event_id", "left_semi")
    first, n = told.orderBy("type", "subject", "event_seq").limit(most).collect(), told.count()
    row = lambda r: f"| {r['type']} | {r['subject']} | {r['quantification'] or ''} |"
    return ["", "## Stops", "", "| type | stop | what |", "|-|-|-|", *map(row, first)] + ([more(n, most).strip()] if n > most else []) if first else []


def validation_chapter(c: Comparison, most: int, most_ids: int = 10) -> list[str]:
    """Lines on changes of ids and of validity, and the first differences of each file that stay unexplained."""
    lines = []
    for title, kind in (("Changed ids that mean nothing", "TECHNICAL_ID_CHURN"), ("Validity of the feed", "FEED_VALIDITY_CHANGED")):
        told = c.events.filter(F.col("type") == kind)
        if n := told.count():
            lines += [f"- {title}: {n}", *[f"  - {r['subject']}: {r['quantification'] or ''}" for r in told.orderBy("event_seq").limit(most).collect()]] + ([f"  - {more(n, most).strip()}"] if n > most else [])
    lines += ["", "## Unexplained", ""]
    left = c.claims.join(c.events.filter(F.col("type") == RESIDUAL).select("event_id", F.get_json_object("subject", "$.file").alias("file")), "event_id")
    counts = left.groupBy("file").agg(F.count("*").alias("n"))
    ids = top_k(left.select("file", "rawdiff_id"), ["file"], [F.col("rawdiff_id")], most_ids).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("rawdiff_id")), ", ").alias("ids"))
    rows = counts.join(ids, "file").orderBy("file").collect()  # a feed has few files
    return lines + ([f"- {r['file']}: {r['n']} ({r['ids']}{', ...' if r['n'] > most_ids else ''})" for r in rows] or ["none"])


def markdown(c: Comparison, most: int = 200) -> str:
    """A report: figures, a summary, route groups with those with a major event first, a chapter for each, unchanged ones by name, stops, and what is unexplained. Lists over ``most`` say how many more there are."""
    total, explained, ratio = c.explained().first()
    lines = ["# Changes", "", f"{total} differences, {explained} explained ({ratio:.4f}).", "", "## Summary", "", *summary(c, most), "", "## By type", ""]
    lines += [f"- {r['type']}: {r['count']}" for r in c.events.groupBy("type").count().orderBy("type").collect()]
    digest = route_digest(c)
    groups = digest.count()
    lines += ["", "## Route groups", ""]
    lines += [f"- {r['route_group']}: {r['events']} events, {r['majors']} major ({', '.join(r['types'])})" for r in digest.orderBy("rank").limit(most).collect()]
    lines += [f"-{more(groups, most)}"] if groups > most else []
    lines += chapters(c, most)
    same = unchanged_groups(c)
    lines += ["", "Unchanged: " + (", ".join(r[0] for r in same.orderBy("group").limit(most).collect()) or "none") + more(same.count(), most)]
    lines += [*stop_chapter(c, most), "", "## Validation", "", *validation_chapter(c, most)]
    return "\n".join(lines) + "\n"
