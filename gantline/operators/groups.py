"""Figures of groups: exact ranks, first and last values, subtotals, and searches with counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a fold gives back.
FOLDED = 2000


def folded(rows: DataFrame, by: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """(by, schema): what ``fold`` gives for the rows of each group, as tuples of what stands beside ``by``.

    Rows are sorted by group in each task, so that it holds one group at a time, and groups are cut from whole batches: many small groups cost no data frame each.
    """
    k, kinds = len(by), dict(rows.dtypes)
    out = StructType.fromDDL(", ".join([*(f"`{b}` {kinds[b]}" for b in by), schema]))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), arrow, strict=True)], schema=arrow)
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for key, group in groupby(each, lambda row: row[:k]):
            told += [(*key, *r) for r in fold([row[k:] for row in group])]
            if len(told) >= FOLDED:
                yield batch()
                told = []
        if told:
            yield batch()

    ordered = rows.select(*by, *[c for c in rows.columns if c not in by])
    return ordered.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, out)


def middle_and_rank(rows: DataFrame, by: list[str], value: str, share: float = 0.9) -> DataFrame:
    """(by, n, middle, ranked): the median of each group's values, and the one at floor(share * n), at most the last.

    A row for each distinct value and how often it occurs, so that no group gathers all its values.
    """
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    placed = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy(value))).withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value)))
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2
    return placed.groupBy(*by, "n").agg(middle.alias("middle"), at(F.least(F.col("n"), F.floor(F.col("n") * share) + 1)).alias("ranked"))


def ends(value: Column, is_old: Column) -> list[Column]:
    """old_first, old_last, new_first and new_last of a value, as aggregates."""
    return [f(F.when(side, value)).alias(f"{g}_{n}") for g, side in (("old", is_old), ("new", ~is_old)) for n, f in (("first", F.min), ("last", F.max))]


def moved_ends(rows: DataFrame, least: float) -> DataFrame:
    """The rows whose first or last value moved by at least so much."""
    return rows.filter((F.abs(F.col("new_first") - F.col("old_first")) >= least) | (F.abs(F.col("new_last") - F.col("old_last")) >= least))


def mean_and_spread(values: Column) -> tuple[Column, Column]:
    """The mean and the standard deviation of an array's numbers; null of an empty one."""
    n = F.when(F.size(values) > 0, F.size(values))
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    return mean, F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.pow(x - mean, 2)) / n)


def subtotals(rows: DataFrame, sets: list[list[str]], *figures: Column) -> DataFrame:
    """Figures of each set of columns, the first of which holds all others; what a set leaves out is null."""
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *sets[0]).agg(*figures)


def search(rows: DataFrame, wanted: list[Column], order: list[Column], most: int) -> DataFrame:
    """The first rows that meet all conditions in a total order, with how many meet them (``matched``) and how many there are (``total``)."""
    found = rows
    for condition in wanted:
        found = found.filter(condition)
    counts = found.agg(F.count("*").alias("matched")).join(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row each
    return found.orderBy(*order).limit(most).join(F.broadcast(counts))
