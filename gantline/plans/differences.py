"""All raw differences of two feeds, numbered in one fixed order."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff
from ..sources.feed import Feed
from ..sources.scratch import Scratch, global_rank

#: The columns that name a row; () is a file of one row. Files that aren't here are compared as multisets.
KEYS: dict[str, tuple[str, ...]] = {
    "agency": ("agency_id",), "agency_jp": ("agency_id",), "stops": ("stop_id",), "routes": ("route_id",), "routes_jp": ("route_id",), "trips": ("trip_id",),
    "stop_times": ("trip_id", "stop_sequence"), "calendar": ("service_id",), "calendar_dates": ("service_id", "date"), "fare_attributes": ("fare_id",),
    "fare_rules": ("fare_id", "route_id", "origin_id", "destination_id", "contains_id"), "shapes": ("shape_id", "shape_pt_sequence"),
    "frequencies": ("trip_id", "start_time"), "transfers": ("from_stop_id", "to_stop_id"), "feed_info": (),
    "translations": ("table_name", "field_name", "language", "record_id", "record_sub_id", "field_value"), "office_jp": ("office_id",), "levels": ("level_id",),
    "pathways": ("pathway_id",), "attributions": ("attribution_id",), "booking_rules": ("booking_rule_id",), "location_groups": ("location_group_id",),
}
#: Tables of which rules need every row, so that they never collapse into counts.
WHOLE = {
    "agency", "agency_jp", "stops", "routes", "routes_jp", "trips", "stop_times", "calendar", "calendar_dates", "shapes", "frequencies", "transfers", "feed_info", "office_jp",
}


def table_diff(name: str, old: Feed, new: Feed, bulk: int, scratch: Scratch) -> list[DataFrame]:
    """The differences of one table, as parts to be put together."""
    spark = old.spark
    said = lambda rows: spark.createDataFrame(rows, diff.SCHEMA)
    if name not in old.tables or name not in new.tables:
        return [said([(diff.FILE_ADDED if name not in old.tables else diff.FILE_REMOVED, [], "", None, None, 0, [])])]
    a, b = set(old.columns(name)), set(new.columns(name))
    columns = [(diff.COLUMN_REMOVED, [], c, None, None, 0, []) for c in a - b] + [(diff.COLUMN_ADDED, [], c, None, None, 1, []) for c in b - a]
    parts = [said(columns)] if columns else []
    shared = sorted(a & b)
    if not shared:
        return parts
    left, right = (diff.strings(f.table(name), shared) for f in (old, new))
    spec = KEYS.get(name)
    keys = [k for k in spec or () if k in shared]
    if spec == () and left.limit(2).count() == right.limit(2).count() == 1:  # a row each
        one = lambda df: df.withColumn("_one", F.lit("1"))
        rows = diff.keyed_diff(one(left), one(right), ["_one"], shared).withColumn("key", diff.no_key()).withColumn("sort", diff.no_key())
    elif keys and not diff.has_repeated_keys(left, keys) and not diff.has_repeated_keys(right, keys):
        rows = diff.keyed_diff(left, right, keys, shared)
    else:
        rows = diff.multiset_diff(left, right, shared)
    if bulk and name not in WHOLE:
        rows = diff.collapse(rows, bulk, scratch)
    return [*parts, rows]


def enumerate_diffs(old: Feed, new: Feed, scratch: Scratch, bulk: int = 0) -> DataFrame:
    """(rawdiff_id, seq, file, kind, key, column, old_value, new_value) of everything that differs."""
    parts, names = [], sorted(old.tables.keys() | new.tables.keys())
    for name, found in zip(names, scratch.together(*[functools.partial(table_diff, n, old, new, bulk, scratch) for n in names]), strict=True):
        for part in found:
            parts.append(part.select(F.lit(f"{name}.txt").alias("file"), *[p.split(" ")[0] for p in diff.SCHEMA.split(", ")]))
    whole = scratch.put(functools.reduce(DataFrame.unionByName, parts), "differences")
    ranked = global_rank(whole, scratch, [F.col(c) for c in ("file", "phase", "sort", "column")], "seq")
    out = ranked.select(F.format_string("rawdiff_%06d", F.col("seq") + 1).alias("rawdiff_id"), "seq", "file", "kind", "key", "column", "old_value", "new_value")
    return scratch.put(out, "rawdiffs")
