"""Which generations of a feed are compared: by relative names, current, prev_1 (the one before), next_1 and so on."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from .feed import FeedError

#: What names no generation counts as older than all that do.
OLDEST = 1_000_000


def recency(name: str) -> int:
    """0 for the current generation, more for older ones, less for those to come."""
    if name == "current":
        return 0
    found = re.fullmatch(r"(prev|next)_(\d+)", name)
    return (int(found[2]) if found[1] == "prev" else -int(found[2])) if found else OLDEST


def in_folder(spark: SparkSession, folder: str) -> dict[str, str]:
    """Path by name of the .zip files in a folder of any store that Spark reads, the newest generation first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = {f.getPath().getName().removesuffix(".zip"): f.getPath().toString() for f in found if f.getPath().getName().endswith(".zip")}
    return {n: names[n] for n in sorted(names, key=lambda n: (recency(n), n))}


def pair(known: dict[str, str], old: str = "prev_1", new: str = "current") -> tuple[str, str]:
    """The paths of an older and a newer generation. Where one isn't there and no others were asked for, those are the two newest."""
    if (old, new) == ("prev_1", "current") and not {old, new} <= set(known):
        named = [n for n in known if recency(n) < OLDEST]
        if len(named) >= 2:
            new, old = named[:2]
    if missing := [n for n in (old, new) if n not in known]:
        raise FeedError(f"there is no generation {' nor '.join(missing)}; there are {', '.join(known) or 'none'}")
    if recency(old) <= recency(new):
        raise FeedError(f"{old} is not older than {new}")
    return known[old], known[new]
