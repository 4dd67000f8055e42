"""Removal of lines that are boilerplate across sites, in DataFrame functions alone.

A line's spread is the number of distinct sites (sources) that have it. HyperLogLog sketches of sites, one
for each line hash, merge by aggregation. A line whose estimate is clearly over or under the threshold is
settled by it; for one near the threshold sites are counted exactly. What is boilerplate goes from every
document, so a notice of several lines goes with all of them.

Copies of one document spread over sites too. Where they haven't been removed before, ``once`` lets all copies
of a text count for one of their sites alone.

Defined results: a document counts once for a line; blank lines stay and count for nothing; white space
around a line doesn't count; null text stays null, with 0 lines; a null site is a site; very long texts come
whole; repeated rows are documents of their own with the same result; an empty table gives an empty one.
Other columns stay as they are in ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, packed, unpacked

#: From so many sites on, a line may be boilerplate.
SITES = 10
#: 2 ** LG_K registers: a standard error of 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over six standard errors.
NEAR = 0.1
#: Line hashes that are broadcast, at most (8 bytes each); beyond that the rows are shuffled.
BROADCAST_LINES = 1_000_000
#: White space that doesn't count around a line: line feeds part lines, all other characters of that property are here.
WHITE = "\t\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), bare)


def occurrences(docs: DataFrame, site: str) -> DataFrame:
    """(line, site, th) as hashes, one for each document and distinct line of it; th is the text's."""
    distinct = docs.select(F.xxhash64(site).alias("site"), F.xxhash64("text").alias("th"), F.filter(F.array_distinct(lines_of(F.col("text"))), lambda x: x != "").alias("lines"))
    return distinct.select("site", "th", F.explode("lines").alias("line")).select(F.xxhash64("line").alias("line"), "site", "th")


def among(rows: DataFrame, few: DataFrame) -> DataFrame:
    """The rows whose line is in a written table of lines: broadcast where that is small, else by a join that Spark can split."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_LINES else few, "line", "left_semi")


def boilerplate(docs: DataFrame, scratch: Scratch, site: str = "source", sites: int = SITES, once: bool = False) -> DataFrame:
    """(line), the hashes of lines on so many sites."""
    rows = occurrences(docs, site)
    if once:
        # The site is drawn by text and site, or texts that all stand on the same sites would all count for the same one.
        rows = rows.groupBy("line", "th").agg(F.min_by("site", F.xxhash64("th", "site")).alias("site"))
    rows = scratch.put(rows.select("line", "site"), "lines")
    # Most lines stand in few documents; these need no sketch.
    often = scratch.put(rows.groupBy("line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= sites).select("line"), "often")
    sketched = among(rows, often).groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    sketched = scratch.put(sketched, "sketched")
    clear, out = F.col("sites") >= sites * (1 + NEAR), F.col("sites") < sites * (1 - NEAR)
    near = scratch.put(sketched.filter(~clear & ~out).select("line"), "near")
    # Exact counts: distinct pairs first, so that a line of many documents is many small groups.
    exact = among(rows, near).distinct().groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= sites)
    return scratch.put(sketched.filter(clear).select("line").unionByName(exact.select("line")), "boilerplate")


def clean(docs: DataFrame, site: str = "source", sites: int = SITES, once: bool = False) -> DataFrame:
    """The documents with boilerplate lines taken out of text; adds n_lines and n_removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    found = boilerplate(docs, scratch, site, sites, once)
    key = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th")]
    hashes = F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(x)))
    hit = among(docs.select(*key, F.explode(hashes).alias("line")), found).groupBy("_id", "_th").agg(F.collect_set("line").alias("_gone"))
    hit = scratch.put(hit, "documents")  # rows of a document that hold boilerplate
    whole = packed(docs, "doc_id", "text").withColumn("_th2", F.xxhash64("text"))
    # The same plan at every size: what is known of documents grows with them, so it isn't broadcast.
    joined = whole.join(hit.hint("merge"), F.expr("doc_id <=> _id AND _th2 = _th"), "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x: ~F.array_contains("_gone", F.xxhash64(bare(x))))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    n_removed = F.when(F.col("_gone").isNull() | F.col("text").isNull(), 0).otherwise(F.size(parts) - F.size(kept))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return unpacked(joined, columns, {"doc_id": F.col("doc_id"), "text": text}, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
