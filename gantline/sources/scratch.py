"""Scratch tables in the shared folder, and exact global ranks."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gantline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, at: str) -> None:
    """Delete a folder, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables that cut lineage; a lost executor costs no more than the tasks it ran.

    ``put`` writes a DataFrame as Parquet below the shared folder and gives the table that reads it,
    ``drop`` deletes what is no longer read, ``clear`` all tables, once no result that reads them is wanted any more.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        self.numbers = itertools.count(1)  # tables may be written by several threads

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by`` names a column that gets a folder for each value."""
        path = f"{self.at}/{next(self.numbers):03d}-{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def together(self, *calls: Callable[[], T]) -> list[T]:
        """What calls give that don't depend on each other: their jobs run side by side and share the executors. The first failure is raised once all have ended."""
        inherit = inheritable_thread_target(self.spark)
        with ThreadPoolExecutor(len(calls)) as pool:
            return [f.result() for f in [pool.submit(inherit(c)) for c in calls]]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._scratch_path)  # type: ignore[attr-defined]

    def clear(self) -> None:
        delete(self.spark, self.at)


def global_rank(df: DataFrame, scratch: Scratch, by: list[Column], name: str = "rank") -> DataFrame:
    """Add the 0-based place of each row in the order ``by``, without one task that sees all rows.

    The rows are dealt by range and sorted; the place in a range is written, and what stands in
    earlier ranges is added from one count per range.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = scratch.put(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return (
        placed.join(F.broadcast(before), "_range")  # a row for each range at most
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_range", "_at", "_before")
    )
