"""Which event explains which difference. A claim is (rawdiff_id, event_seq, event_id); the first in event order is primary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary(claims: DataFrame) -> DataFrame:
    """(rawdiff_id, event_id): the first event that claimed each difference, one aggregation."""
    return claims.groupBy("rawdiff_id").agg(F.min_by("event_id", "event_seq").alias("event_id"))


def unclaimed(diffs: DataFrame, claims: DataFrame) -> DataFrame:
    return diffs.join(claims.select("rawdiff_id").distinct(), "rawdiff_id", "left_anti")


def unknown(diffs: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims on differences that don't exist; any is an error in a rule."""
    return claims.join(diffs.select("rawdiff_id"), "rawdiff_id", "left_anti")


def residual_by(diffs: DataFrame, claims: DataFrame, *columns: str) -> DataFrame:
    return unclaimed(diffs, claims).groupBy(*columns).agg(F.count("*").alias("residual"))


def accounting(diffs: DataFrame, claims: DataFrame) -> DataFrame:
    """(total, explained, ratio); a ratio of 1 where there is nothing to explain."""
    marked = diffs.select("rawdiff_id").join(claims.select("rawdiff_id").distinct().withColumn("hit", F.lit(1)), "rawdiff_id", "left")
    sums = marked.agg(F.count("*").alias("total"), F.count("hit").alias("explained"))
    return sums.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("explained") / F.col("total")))
