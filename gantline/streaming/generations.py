"""A feed's rows as a stream: the latest generation of each key, and what each batch changed.

The unit of comparison is a pair of whole generations; a stream of rows is brought to that by keeping, for each key,
the newest row, and comparing each micro-batch with what was kept before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.diff import keyed_diff
from ..sources.scratch import delete


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key, of several the first by its columns in the order of their names; map tasks keep one for a key."""
    ties = [F.to_json(F.struct(c)) for c in sorted(rows.columns) if c not in (*keys, version)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), *ties))
    return rows.withColumn("_p", place).filter("_p = 1").drop("_p")


class KeyedChanges:
    """A ``foreachBatch`` sink: writes each batch's differences from the rows kept so far below ``path``, and keeps the new rows.

    State and differences are written under the batch's number, so a batch that is run again writes the same. The state before the last one is deleted, since
    only the last batch may be run again.
    """

    def __init__(self, keys: list[str], version: str, path: str):
        self.keys, self.version, self.path = keys, version, path

    def state(self, spark, batch: int) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/state/{batch}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self.state(spark, number - 1)
        rows = latest(batch, self.keys, self.version)
        kept = rows if before is None else latest(before.unionByName(rows), self.keys, self.version)
        kept.write.mode("overwrite").parquet(f"{self.path}/state/{number}")
        now = spark.read.parquet(f"{self.path}/state/{number}")
        was = now.limit(0) if before is None else before
        columns = [c for c in now.columns if c != self.version]
        keyed_diff(was, now, self.keys, columns).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/changes/{number}")
        delete(spark, f"{self.path}/state/{number - 2}")


__all__ = ["KeyedChanges", "latest"]
