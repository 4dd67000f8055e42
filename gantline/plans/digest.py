"""Digests of a comparison: what changed of the feed and of each page, in tables that are written whole and in Markdown that says what it leaves out."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import day_order
from ..functions.events import EVENT_TYPES
from ..operators.diff import top_k
from ..sources.feed import Feed
from ..sources.scratch import Scratch
from . import calendars, names, pages, report
from .compare import Comparison
from .presentation import Presentation
from .timetables import stop_changes

#: What became of a column of a timetable that a digest tells one by one; the others are counted.
QUIET = ["unchanged", "id_changed"]
#: Stop changes by the word that a digest has for them.
STOP_KINDS = {"STOP_RENAMED": "renamed", "STOP_ADDED": "new", "STOP_REMOVED": "gone", "STOP_RELOCATED": "moved"}


def row_counts(feed: Feed) -> DataFrame:
    """(file, rows) of a feed."""
    out = None
    for name in sorted(feed.tables):
        rows = feed.table(name).agg(F.lit(name).alias("file"), F.count("*").alias("rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


def file_table(diffs: DataFrame, old_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """(file, status, rows_old, rows_new, row_added, row_removed, field_changed, column_changes): every file of either generation; differences that stand for many rows count as those."""

    def count(one: list[str], bulk: str | None = None, value: str = "new_value") -> Column:
        own = F.count(F.when(F.col("kind").isin(*one), 1))
        return own + F.coalesce(F.sum(F.when(F.col("kind") == bulk, F.col(value).cast("long"))), F.lit(0)) if bulk else own

    told = diffs.groupBy("file").agg(
        count(["row_added"], "rows_added_bulk").alias("row_added"), count(["row_removed"], "rows_removed_bulk", "old_value").alias("row_removed"),
        count(["field_changed"], "rows_changed_bulk", "old_value").alias("field_changed"), count(["column_added", "column_removed"]).alias("column_changes"),
    )
    known = old_rows.withColumnRenamed("rows", "rows_old").join(new_rows.withColumnRenamed("rows", "rows_new"), "file", "full_outer").join(told, "file", "full_outer")
    status = F.when(F.col("rows_old").isNull(), "added").when(F.col("rows_new").isNull(), "removed").otherwise("continued")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.select("file", status.alias("status"), "rows_old", "rows_new", *map(none, ("row_added", "row_removed", "field_changed", "column_changes")))


def column_statuses(timetables: DataFrame, relation: Column) -> DataFrame:
    """The columns of timetables with status, departure_old, departure_new, changed_stops, stops_added and stops_removed.

    relation says ``exact`` of pairs that are the same trip. Other pairs are retimed where both call at the same places of the axis, else rerouted.
    """
    called = lambda c: F.transform(F.col(c), lambda t: t.isNotNull())
    only = lambda a, b: F.size(F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda t: t["x"].isNotNull() & t["y"].isNull()))
    status = (
        F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed")
        .when(relation == "exact", F.when(F.col("old_id") == F.col("new_id"), "unchanged").otherwise("id_changed"))
        .when(called("old_times") == called("new_times"), "retimed").otherwise("rerouted")
    )
    first = lambda c: F.substring_index(F.get(F.filter(F.col(c), lambda t: t.isNotNull() & (t != "")), F.lit(0)), ":", 2)
    pair = F.col("status").isin("retimed", "rerouted")
    other = lambda a, b: F.when(F.col("status") == "rerouted", only(a, b))
    told = timetables.withColumn("status", status).withColumn("departure_old", first("old_times")).withColumn("departure_new", first("new_times"))
    return told.withColumns({"changed_stops": F.when(pair, F.size("changed")), "stops_added": other("new_times", "old_times"), "stops_removed": other("old_times", "new_times")})


def event_types(events: DataFrame) -> DataFrame:
    """(type, category, count)."""
    category = F.create_map(*[F.lit(x) for kind, (letter, _) in EVENT_TYPES.items() for x in (kind, letter)])
    return events.groupBy("type").agg(F.count("*").alias("count")).select("type", category[F.col("type")].alias("category"), "count")


@dataclass
class Digest:
    """briefs is (gen, agencies, version, start, end); totals one row (pages, pages_changed, total, explained, ratio, told_ratio, new_or_gone); days (day_type, old, new); types (type, category, count);
    stops (kind, name, was, groups); pages (page, rank, state, former_names, related_names, similar, day_totals, facts) of pages that changed; columns the timetable columns that changed and
    column_counts how many didn't; units (page, added_stops, removed_stops, systems, ...); ids (page, gen, route_ids); feed_events the events that are of no route or stop; others (type, count) of what no part of
    a report shows one by one; files as ``file_table`` has them; residual (file, residual); checks (check, page, kind, names) of what contradicts itself."""

    briefs: DataFrame
    totals: DataFrame
    days: DataFrame
    types: DataFrame
    stops: DataFrame
    pages: DataFrame
    columns: DataFrame
    column_counts: DataFrame
    units: DataFrame
    ids: DataFrame
    feed_events: DataFrame
    others: DataFrame
    files: DataFrame
    residual: DataFrame
    checks: DataFrame


def briefs(feeds: dict[str, Feed]) -> DataFrame:
    rows = []
    for gen, feed in feeds.items():
        window = calendars.snapshot_window(feed) or (None, None)
        rows.append((gen, report.agency_names(feed), report.version(feed), *window))
    return next(iter(feeds.values())).spark.createDataFrame(rows, "gen string, agencies array<string>, version string, start string, end string")


def page_facts(shown: Presentation, former: DataFrame, like: DataFrame) -> DataFrame:
    """A row for each page that changed; what a row holds is bounded by the page's day types, names and headlines."""
    none = F.array().cast("array<string>")
    of = lambda kind: former.filter(F.col("kind") == kind).groupBy("page").agg(F.array_sort(F.collect_set("name")).alias(f"{kind}_names"))
    alike = like.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "name", "similarity"))).alias("similar"))
    days = shown.day_totals.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(day_order(F.col("day_type")).alias("key"), "day_type", "old", "new"))).alias("day_totals"))
    facts = shown.headlines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "lost", "gained"))).alias("facts"))
    out = shown.contents.filter("state < 2")
    for more in (of("former"), of("related"), alike, days, facts):
        out = out.join(more, "page", "left")
    plain = F.transform("day_totals", lambda d: F.struct(d["day_type"].alias("day_type"), d["old"].alias("old"), d["new"].alias("new")))
    names_ = [F.coalesce(f"{k}_names", none).alias(f"{k}_names") for k in ("former", "related")]
    return out.select("page", "rank", "state", *names_, "similar", plain.alias("day_totals"), "facts")


def build(c: Comparison, shown: Presentation, old: Feed, new: Feed, scratch: Scratch | None = None) -> Digest:
    scratch = scratch or Scratch(c.diffs.sparkSession, "digest")
    of = pages.family_pages(c, scratch)
    alone = shown.levels.filter("level = 1").select("page", "kind")
    former, like = (scratch.put(df, name) for df, name in zip(names.of_comparison(c, of, alone), ("renamed", "similar"), strict=True))
    facts = scratch.put(page_facts(shown, former, like), "page-facts")

    relation = shown.pairs.select("page", "label", F.col("old_id").alias("_old"), F.col("new_id").alias("_new"), "relation")
    met = F.col("old_id").eqNullSafe(F.col("_old")) & F.col("new_id").eqNullSafe(F.col("_new"))
    table = shown.timetables.alias("t").join(relation.alias("p"), (F.col("t.page") == F.col("p.page")) & (F.col("t.label") == F.col("p.label")) & met, "left").select("t.*", "relation")
    columns = scratch.put(column_statuses(table, F.col("relation")).drop("relation", "axis", "old_times", "new_times", "changed"), "columns")
    sheet = ["page", "dgroup", "leg", "label", "sheet", "sheet_label"]
    quiet = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in QUIET]

    trips = lambda rows: rows.agg(F.coalesce(F.sum(F.col("old") + F.col("new")), F.lit(0))).first()[0]
    part_of_alone, all_trips = trips(shown.day_totals.join(alone.select("page").distinct(), "page", "left_semi")), trips(shown.day_totals)
    parts = report.event_parts(c)
    told = parts.agg(F.coalesce(F.avg(F.when(F.col("part") < 4, 1.0).otherwise(0.0)), F.lit(1.0))).first()[0]
    counts = shown.contents.agg(F.count("*"), F.count(F.when(F.col("state") < 2, 1))).first()
    figures = (*counts, *c.explained().first(), told, round(part_of_alone / all_trips, 4) if all_trips else 0.0)
    totals = c.diffs.sparkSession.createDataFrame([figures], "pages long, pages_changed long, total long, explained long, ratio double, told_ratio double, new_or_gone double")

    kind = F.create_map(*[F.lit(x) for pair in STOP_KINDS.items() for x in pair])
    stops = stop_changes(c).filter(F.col("kind").isin(*STOP_KINDS)).select(kind[F.col("kind")].alias("kind"), "name", "was", "groups")
    evidence = c.claims.groupBy("event_id").agg(F.count("*").alias("evidence_count"))
    feed_events = c.events.join(parts.filter("part = 1").select("event_id"), "event_id", "left_semi").join(evidence, "event_id", "left")
    feed_events = feed_events.select("event_seq", "type", "subject", "quantification", "old_ref", "new_ref", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))
    routes = None
    for gen, side in (("old", c.identity.old), ("new", c.identity.new)):
        rows = of.filter(F.col("gen") == gen).select("family", "page").join(side.families.select("family", "route_id"), "family").select("page", F.lit(gen).alias("gen"), "route_id")
        routes = rows if routes is None else routes.unionByName(rows)
    checks = names.contradictions(former, like, alone).withColumn("check", F.lit("level1_with_counterpart"))
    unlike = shown.unlike_totals.select("page", F.lit("trips_and_columns").alias("check"), F.lit(None).cast("string").alias("kind"), F.array("label").alias("names"))
    return Digest(
        briefs({"old": old, "new": new}), totals, shown.day_totals.groupBy("day_type").agg(F.sum("old").alias("old"), F.sum("new").alias("new")), event_types(c.events), scratch.put(stops, "stops"), facts,
        columns.filter(~F.col("status").isin(*QUIET)), columns.groupBy(*sheet).agg(*quiet, F.count("*").alias("all")), shown.units, routes.groupBy("page", "gen").agg(F.array_sort(F.collect_set("route_id")).alias("route_ids")),
        scratch.put(feed_events, "feed-events"), parts.filter("part = 4").groupBy("type").agg(F.count("*").alias("count")), scratch.put(file_table(c.diffs, *[row_counts(f).withColumn("file", F.concat("file", F.lit(".txt"))) for f in (old, new)]), "files"), c.residual(),
        scratch.put(checks.unionByName(unlike), "checks"),
    )


def write(d: Digest, path: str) -> None:
    """Each table whole, as compressed JSON lines in a folder of its name."""
    for f in fields(d):
        getattr(d, f.name).write.mode("overwrite").json(f"{path}/{f.name}", compression="gzip")


# Markdown


def left(n: int, most: int, what: str) -> list[str]:
    """A line that says how many are left out, where some are."""
    return [f"- and {n - most} more {what}, all of them in the tables"] if n > most else []


def day_text(days: list[Row] | None) -> str:
    return ", ".join(f"{d['day_type']} {d['old']} -> {d['new']}" if d["old"] != d["new"] else f"{d['day_type']} {d['new']}" for d in days or []) or "none"


def fact_text(kind: str, lost: int, gained: int) -> str:
    said = {
        "route_added": f"new, {gained} trips", "route_removed": f"gone, {lost} trips", "systems": f"systems: {gained} new, {lost} gone", "reroute": f"{gained} trips call elsewhere",
        "trips": f"trips: {lost} -> {gained}", "retimed": f"{gained} trips at other times", "retimed_minor": f"{gained} trips moved by a few minutes", "notes_only": f"lines on the map or signs only: {gained}",
    }
    return said.get(kind, f"{kind}: {lost} -> {gained}")


def markdown(d: Digest, most_pages: int = 200, most_stops: int = 50, most_events: int = 50) -> str:
    """The digest of the feed. What is over a limit is counted; the driver holds no more than the limits."""
    lines = ["# Digest", ""]
    for b in d.briefs.collect():  # two rows
        span = f", {b['start']} to {b['end']}" if b["start"] else ""
        lines.append(f"- {b['gen']}: {', '.join(b['agencies']) or 'no agency'}{', version ' + b['version'] if b['version'] else ''}{span}")
    t = d.totals.first()
    lines += ["", "## Totals", "", f"- trips by day type: {day_text(d.days.orderBy(day_order(F.col('day_type'))).collect())}", f"- pages: {t['pages']}, changed: {t['pages_changed']}"]
    lines += [f"- differences: {t['total']}, explained: {t['explained']} ({t['ratio']:.4f})", f"- events shown one by one: {t['told_ratio']:.4f}; trips on pages that come or go: {t['new_or_gone']:.4f}"]
    lines += ["", "## Events", "", "| type | count |", "|-|-|", *[f"| {r['type']} | {r['count']} |" for r in d.types.orderBy("type").collect()], "", "## Stops", ""]  # as many as there are types
    counts = {r["kind"]: r["count"] for r in d.stops.groupBy("kind").count().collect()}
    first = top_k(d.stops, ["kind"], [F.col("name"), F.col("was")], most_stops).orderBy("kind", "rank").collect()
    for kind in STOP_KINDS.values():
        for r in first:
            if r["kind"] == kind:
                name = f"{r['was']} -> {r['name']}" if kind == "renamed" else r["name"]
                lines.append(f"- {kind}: {name}" + (f" ({', '.join(r['groups'])})" if r["groups"] else ""))
        lines += left(counts.get(kind, 0), most_stops, f"{kind} stops")
    lines += [] if counts else ["none"]
    lines += ["", "## Pages", ""]
    for p in d.pages.orderBy("rank").limit(most_pages).collect():
        lines += [f"### {p['page']}", ""]
        lines += [f"- {said}: {', '.join(p[n])}" for said, n in (("former names", "former_names"), ("of the same rebuilding", "related_names")) if p[n]]
        lines += [f"- like {s['name']} ({s['similarity']})" for s in p["similar"] or []]
        lines += [f"- trips: {day_text(p['day_totals'])}", *[f"- {fact_text(f['kind'], f['lost'], f['gained'])}" for f in p["facts"] or []], ""]
    lines += [*left(t["pages_changed"], most_pages, "pages that changed"), f"Unchanged pages: {t['pages'] - t['pages_changed']}", "", "## Of no page", ""]
    of_feed = d.feed_events.orderBy("event_seq").limit(most_events).collect()
    others = d.others.orderBy("type").collect()  # as many as there are types
    lines += [f"- {e['type']}: {e['quantification'] or e['subject']}" for e in of_feed] + left(d.feed_events.count(), most_events, "events of the feed")
    lines += [f"- {o['type']}: {o['count']}" for o in others] or ([] if of_feed else ["none"])
    lines += ["", "## Files", "", "| file | rows before | rows after | new | gone | changed | columns |", "|-|-|-|-|-|-|-|"]
    number = lambda v: "-" if v is None else str(v)
    lines += [f"| {f['file']} | {number(f['rows_old'])} | {number(f['rows_new'])} | {f['row_added']} | {f['row_removed']} | {f['field_changed']} | {f['column_changes']} |" for f in d.files.orderBy("file").collect()]  # a feed has few files
    lines += ["", "## Validation", "", *[f"- unexplained in {r['file']}: {r['residual']}" for r in d.residual.orderBy("file").collect()], f"- contradictions: {d.checks.count()}"]
    return "\n".join(lines) + "\n"


def similar_pages(d: Digest, text: str, most: int = 10) -> list[str]:
    """Names of pages that hold a part of one, or else the first ones."""
    at = F.when(F.col("page").contains(text), 0).otherwise(1)
    return [r["page"] for r in d.column_counts.select("page").distinct().orderBy(at, "page").limit(most).collect()]


def route_markdown(c: Comparison, d: Digest, page: str, most: int = 500) -> str:
    """The digest of one page: its changed trips one by one (those over the limit are counted), the rest by number. A page that isn't there raises a KeyError that names some that are."""
    counted = d.column_counts.filter(F.col("page") == page).orderBy("dgroup", "leg", day_order(F.col("label")), "sheet").collect()  # the tables of one page
    if not counted:
        raise KeyError(f"no page {page!r}; there are {', '.join(similar_pages(d, page))}")
    lines = [f"# Digest of {page}", ""]
    for p in d.pages.filter(F.col("page") == page).collect():
        lines += [f"Former names: {', '.join(p['former_names'])}", ""] if p["former_names"] else []
        lines += [f"Trips: {day_text(p['day_totals'])}", *[f"- {fact_text(f['kind'], f['lost'], f['gained'])}" for f in p["facts"] or []], ""]
    ids = {r["gen"]: r["route_ids"] for r in d.ids.filter(F.col("page") == page).collect()}
    lines += [f"Route ids: {', '.join(ids.get('old', [])) or 'none'} -> {', '.join(ids.get('new', [])) or 'none'}", "", "## Trips", ""]
    changed = d.columns.filter(F.col("page") == page)
    listed: dict[tuple, list[Row]] = {}
    for r in changed.orderBy("dgroup", "leg", "label", "sheet", "number").limit(most).collect():
        listed.setdefault((r["dgroup"], r["leg"], r["label"], r["sheet"]), []).append(r)
    for s in counted:
        lines += [f"### {s['dgroup']} {s['leg']}, {s['label']}" + (f" ({s['sheet_label']})" if s["sheet_label"] else ""), ""]
        for r in listed.get((s["dgroup"], s["leg"], s["label"], s["sheet"]), []):
            said = [f"{r['departure_new'] or r['departure_old'] or '?'} {r['status']}"]
            said += [f"{r['changed_stops']} times changed"] if r["status"] == "retimed" else []
            said += [f"{r['stops_added']} stops more, {r['stops_removed']} less"] if r["status"] == "rerouted" else []
            said += [f"before {r['departure_old']}"] if r["departure_old"] and r["departure_new"] and r["departure_old"] != r["departure_new"] else []
            lines.append(f"- {', '.join(said)} (trip {r['old_id'] or '-'} -> {r['new_id'] or '-'})")
        lines += [f"- unchanged {s['unchanged']}, other id only {s['id_changed']}", ""]
    lines += left(changed.count(), most, "trips that changed")
    bands = report.band_matrix(c).filter("direction IS NULL AND system IS NULL AND old_count <> new_count").filter(F.col("group") == page)
    rows = bands.orderBy(day_order(F.col("day_type")), "band").collect()  # day types times bands
    lines += ["## Time bands", "", "| day type | time band | before | after |", "|-|-|-|-|", *[f"| {r['day_type']} | {r['band']} | {r['old_count']} | {r['new_count']} |" for r in rows], ""] if rows else []
    units = top_k(d.units.filter(F.col("page") == page), ["page"], [F.desc("affected_trips"), F.col("added_stops"), F.col("removed_stops")], most).orderBy("rank").collect()
    if units:
        lines += ["## Stops", ""]
        for u in units:
            said = [f"{word}: {', '.join(u[col])}" for word, col in (("also calls at", "added_stops"), ("no longer calls at", "removed_stops")) if u[col]]
            lines.append(f"- {'; '.join(said) or 'calls in another order'} ({u['affected_trips']} of {u['system_trips']} trips)")
    return "\n".join(lines) + "\n"
