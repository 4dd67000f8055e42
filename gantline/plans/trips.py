"""Which trip of one generation is which of the other: exact content first, then the cheapest pairs of each block."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clock_seconds
from ..functions.sequences import lcs_length
from ..operators.diff import rank_zip
from ..operators.graphs import greedy_assignment
from ..sources.scratch import Scratch

SIGNATURE = ["family", "direction", "day_type", "base_seq", "times"]


@dataclass
class TripDelta:
    """pairs is (old_id, new_id, relation) with relation exact or modified; removed and added hold what has no partner."""

    old: DataFrame
    new: DataFrame
    pairs: DataFrame
    removed: DataFrame
    added: DataFrame


def seconds_at(times: Column) -> Column:
    """Departures, else arrivals, in seconds."""
    return F.transform(times, lambda t: clock_seconds(F.when(t["dep"] != "", t["dep"]).otherwise(t["arr"])))


def profiled(trips: DataFrame, band: Column | None = None) -> DataFrame:
    """Add ``at`` (seconds at each stop), ``departure`` (the first) and a hash of the signature."""
    return trips.withColumn("at", seconds_at(F.col("times"))).withColumn("departure", F.get("at", F.lit(0))).withColumn("sig", F.sha2(F.to_json(F.struct(*SIGNATURE)), 256))


def exact_pairs(old: DataFrame, new: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Trips of one signature: those that keep their id first, the rest in the order of ids."""
    a, b = old.select("sig", F.col("trip_id").alias("old_id")), new.select("sig", F.col("trip_id").alias("new_id"))
    same = a.join(b, (a["sig"] == b["sig"]) & (a["old_id"] == b["new_id"])).select(a["sig"], "old_id", "new_id")
    rest = lambda df, c: df.join(same.select("sig", c), ["sig", c], "left_anti")
    return same.unionByName(rank_zip(rest(a, "old_id"), rest(b, "new_id"), ["sig"], ["old_id"], ["new_id"], scratch)).select("old_id", "new_id")


def candidates(old: DataFrame, new: DataFrame, c: dict) -> DataFrame:
    """(block, old_id, new_id, cost, dt) of pairs in a block that pass both gates. Distinct pairs of sequences are compared once, before trips meet."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(x), list(y)) / max(len(x), len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b, strict=True)])

    @F.pandas_udf("double")
    def apart(a: pd.Series, x: pd.Series, b: pd.Series, y: pd.Series) -> pd.Series:
        """Median minutes between two trips at the stops they share (first visits), else between their departures."""
        from statistics import median

        out = []
        for sa, ta, sb, tb in zip(a, x, b, y, strict=True):
            first, other = {}, {}
            for s, t in zip(sa, ta, strict=True):
                first.setdefault(s, t)
            for s, t in zip(sb, tb, strict=True):
                other.setdefault(s, t)
            known = [abs(t - first[s]) / 60 for s, t in other.items() if t == t and t is not None and first.get(s) is not None and first[s] == first[s]]
            if known:
                out.append(median(known))
            else:
                ends = [t[0] if len(t) and t[0] is not None and t[0] == t[0] else None for t in (ta, tb)]
                out.append(None if None in ends else abs(ends[1] - ends[0]) / 60)
        return pd.Series(out, dtype="float64")

    seqs = lambda df, n: df.select("block", "day_type", F.col("base_seq").alias(n)).distinct()
    alike = seqs(old, "sa").join(seqs(new, "sb"), ["block", "day_type"]).withColumn("sim", ratio("sa", "sb")).filter(F.col("sim") >= c["min_route_sim"])
    side = lambda df, n, s: df.select("block", "day_type", F.col("trip_id").alias(f"{n}_id"), F.col("base_seq").alias(s), F.col("at").alias(f"at_{n}"))
    pairs = alike.join(side(old, "old", "sa"), ["block", "day_type", "sa"]).join(side(new, "new", "sb"), ["block", "day_type", "sb"])
    pairs = pairs.withColumn("dt", apart("sa", "at_old", "sb", "at_new")).filter(F.col("dt") <= c["max_shift_min"])
    cost = F.least(F.col("dt"), F.lit(float(c["time_cap_min"]))) / c["time_cap_min"] + c["w_route"] * (1 - F.col("sim")) - F.when(F.col("old_id") == F.col("new_id"), c["w_id"]).otherwise(0.0)
    return pairs.select(F.concat_ws("\x1f", "block", "day_type").alias("block"), "old_id", "new_id", F.round(cost, 6).alias("cost"), F.round("dt", 3).alias("dt"))


def match(old: DataFrame, new: DataFrame, block: DataFrame, c: dict, scratch: Scratch) -> TripDelta:
    """block is (gen, family, block); trips of a block and day type may be each other's."""
    of = lambda df, gen: df.join(block.filter(F.col("gen") == gen).select("family", "block"), "family", "left").withColumn("block", F.coalesce("block", "family"))
    old, new = scratch.together(lambda: scratch.put(profiled(of(old, "old")), "old-trips"), lambda: scratch.put(profiled(of(new, "new")), "new-trips"))
    exact = scratch.put(exact_pairs(old, new, scratch), "exact")
    rest = lambda df, c: scratch.put(df.join(exact.select(F.col(c).alias("trip_id")), "trip_id", "left_anti"), "rest")
    left, right = scratch.together(lambda: rest(old, "old_id"), lambda: rest(new, "new_id"))
    modified = scratch.put(greedy_assignment(candidates(left, right, c), scratch, ["cost", "dt"]).select("old_id", "new_id"), "modified")
    pairs = exact.withColumn("relation", F.lit("exact")).unionByName(modified.withColumn("relation", F.lit("modified")))
    gone = lambda df, c: scratch.put(df.join(modified.select(F.col(c).alias("trip_id")), "trip_id", "left_anti"), "alone")
    return TripDelta(old, new, *scratch.together(lambda: scratch.put(pairs, "pairs"), lambda: gone(left, "old_id"), lambda: gone(right, "new_id")))
