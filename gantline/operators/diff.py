"""Exhaustive differences between two generations of a table.

A difference is (kind, key, column, old_value, new_value) with ``sort`` and ``phase`` giving its place in the
fixed order: removed rows, added rows, changed cells, each by key and then column. Cells are strings, a missing
one is "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, global_rank

ROW_REMOVED, ROW_ADDED, FIELD_CHANGED = "row_removed", "row_added", "field_changed"
COLUMN_REMOVED, COLUMN_ADDED = "column_removed", "column_added"
FILE_REMOVED, FILE_ADDED = "file_removed", "file_added"
ROWS_REMOVED_BULK, ROWS_ADDED_BULK, ROWS_CHANGED_BULK = "rows_removed_bulk", "rows_added_bulk", "rows_changed_bulk"

SCHEMA = "kind string, key array<string>, column string, old_value string, new_value string, phase int, sort array<string>"


def no_key() -> Column:
    return F.array().cast("array<string>")


def strings(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])


def has_repeated_keys(df: DataFrame, keys: list[str]) -> bool:
    return df.groupBy(*[f"`{k}`" for k in keys]).count().filter("count > 1").limit(1).count() > 0


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Row and cell differences of tables whose keys are unique: one full outer join, and one row out for each difference.

    Only ``columns`` are compared (default: those that both tables have), so nothing else is read.
    """
    columns = sorted(columns or set(old.columns) & set(new.columns))
    key = F.array(*[F.col(f"`{k}`") for k in keys])
    side = lambda df, name: strings(df, sorted({*keys, *columns})).select(key.alias("key"), F.struct(*[f"`{c}`" for c in columns]).alias(name))
    both = side(old, "o").join(side(new, "n"), "key", "full_outer")
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col("o")[c].alias("old_value"), F.col("n")[c].alias("new_value"))
    none = F.lit(None).cast("string")
    row = F.array(F.struct(F.lit("").alias("column"), none.alias("old_value"), none.alias("new_value")))
    changed = F.filter(F.array(*map(cell, columns)), lambda x: x["old_value"] != x["new_value"])
    missing = F.col("n").isNull() | F.col("o").isNull()
    found = both.filter(missing | (F.col("o") != F.col("n"))).select(
        "key",
        F.when(F.col("n").isNull(), ROW_REMOVED).when(F.col("o").isNull(), ROW_ADDED).otherwise(FIELD_CHANGED).alias("kind"),
        F.explode(F.when(missing, row).otherwise(changed)).alias("d"),
    )
    phase = F.when(F.col("kind") == ROW_REMOVED, 2).when(F.col("kind") == ROW_ADDED, 3).otherwise(4)
    return found.select("kind", "key", "d.column", "d.old_value", "d.new_value", phase.alias("phase"), F.col("key").alias("sort"))


def multiset_diff(old: DataFrame, new: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row differences of tables without a key, with multiplicity: one aggregation over both sides.

    The key is (start of the row's SHA-1, occurrence); the row itself, joined by commas, is the value.
    """
    columns = sorted(columns or set(old.columns) & set(new.columns))
    row = F.array(*[F.col(f"`{c}`") for c in columns])
    side = lambda df, n: strings(df, columns).select(row.alias("row"), F.lit(n).alias("n"))
    counted = side(old, -1).unionByName(side(new, 1)).groupBy("row").agg(F.sum("n").alias("n")).filter("n <> 0")
    each = counted.select("row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.abs("n") - 1)).alias("i"))
    removed, value = F.col("n") < 0, F.array_join("row", ",")
    return each.select(
        F.when(removed, ROW_REMOVED).otherwise(ROW_ADDED).alias("kind"),
        F.array(F.substring(F.sha1(F.array_join("row", "\x1f")), 1, 12), F.col("i").cast("string")).alias("key"),
        F.lit("").alias("column"),
        F.when(removed, value).alias("old_value"),
        F.when(~removed, value).alias("new_value"),
        F.when(removed, 2).otherwise(3).alias("phase"),
        F.concat("row", F.array(F.lpad(F.col("i").cast("string"), 12, "0"))).alias("sort"),
    )


def collapse(rows: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """At most three count rows in place of more than ``threshold`` row differences; changed rows count, not cells. The differences are written, and so found once."""
    rows = scratch.put(rows, "differences")
    n = rows.groupBy("kind").agg(F.count_distinct("key").alias("n")).collect()  # three rows at most
    counts = {r["kind"]: r["n"] for r in n}
    if not threshold or sum(counts.values()) <= threshold:
        return rows
    spark = rows.sparkSession
    said = []
    for kind, bulk, phase in ((ROW_REMOVED, ROWS_REMOVED_BULK, 2), (ROW_ADDED, ROWS_ADDED_BULK, 3), (FIELD_CHANGED, ROWS_CHANGED_BULK, 4)):
        if c := counts.get(kind):
            said.append((bulk, [], "", None if kind == ROW_ADDED else str(c), None if kind == ROW_REMOVED else str(c), phase, []))
    return spark.createDataFrame(said, SCHEMA)


def count_by(diffs: DataFrame, *columns: str) -> DataFrame:
    return diffs.groupBy(*columns).agg(F.count("*").alias("n"))


#: A group with more rows on a side than this is numbered by ranges of a sort, not in one task.
LARGE_GROUP = 100_000


def rank_zip(left: DataFrame, right: DataFrame, by: list[str], order_left: list[str], order_right: list[str], scratch: Scratch | None = None, large: int = LARGE_GROUP) -> DataFrame:
    """Pair the i-th row of each side in each group. Columns of both sides must differ but for ``by``. With a scratch, large groups are dealt to many tasks."""

    def number(df: DataFrame, order: list[str]) -> DataFrame:
        if scratch is not None and df.groupBy(*by).count().filter(F.col("count") > large).limit(1).count():
            ranked = global_rank(df, scratch, [F.col(c) for c in (*by, *order)], "_rank")
            first = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"))
            return ranked.join(first, by).withColumn("_i", F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first")
        return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))

    return number(left, order_left).join(number(right, order_right), [*by, "_i"]).drop("_i")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; map tasks keep no more than k for a group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
