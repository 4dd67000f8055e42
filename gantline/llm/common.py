"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, global_rank, shared_dir

__all__ = ["Scratch", "global_rank", "packed", "shared_dir", "table", "unpacked"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns, and all others as one struct, whose names can't clash with what an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    return docs.select(*keep, (F.struct(*rest) if rest else F.lit(None)).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], keep: dict[str, Column], *more: Column) -> DataFrame:
    """The columns in their order again, the kept ones as given, and then more."""
    own = [keep[c].alias(c) if c in keep else F.col("_row").getField(c).alias(c) for c in columns]
    return rows.select(*own, *more)
