"""Other names of pages: what their routes were called before, names of the same rebuilding that went to other pages, and what a page that comes or goes is like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diff import top_k
from . import identity as I
from .compare import Comparison


def renamed(components: DataFrame, old_pages: DataFrame, new_pages: DataFrame) -> DataFrame:
    """(page, kind, name): old names of a component that the new generation doesn't have, ``former`` at the page that has their trips and ``related`` at the component's other pages.

    components is (component, side, family) of components that hold, pages are (family, page); an old family without a page keeps its name as one.
    """
    old = components.filter("side = 'old'").select("component", "family")
    new = components.filter("side = 'new'").select("component", "family")
    gone = old.join(new, ["component", "family"], "left_anti").join(old_pages.withColumnRenamed("page", "at"), "family", "left")
    gone = gone.select("component", F.col("family").alias("name"), F.coalesce("at", "family").alias("at"))
    shown = new.join(new_pages, "family", "left").select("component", F.coalesce("page", "family").alias("page")).distinct()
    told = gone.join(shown, "component").select("page", F.when(F.col("at") == F.col("page"), "former").otherwise("related").alias("kind"), "name")
    return told.distinct()


def similar(edges: DataFrame, groups: DataFrame, alone: DataFrame, most: int = 3) -> DataFrame:
    """(page, place, name, similarity): the likest families of the other generation for pages that come or go, which no accepted edge reaches.

    edges are candidates (old_id, new_id, confidence), groups (gen, family, group), alone (page, kind) with kind added or removed.
    """
    of = lambda gen, end: groups.filter(F.col("gen") == gen).select(F.col("family").alias(end), F.col("group").alias("page"))

    def seen(gen: str, end: str, other: str, kind: str) -> DataFrame:
        placed = edges.join(of(gen, end), end, "left").withColumn("page", F.coalesce("page", end)).join(alone.filter(F.col("kind") == kind).select("page"), "page", "left_semi")
        return placed.groupBy("page", F.col(other).alias("name")).agg(F.max("confidence").alias("similarity"))

    both = seen("old", "old_id", "new_id", "removed").unionByName(seen("new", "new_id", "old_id", "added"))
    return top_k(both, ["page"], [F.desc("similarity"), F.col("name")], most).select("page", F.col("rank").alias("place"), "name", "similarity")


def of_comparison(c: Comparison, of: DataFrame, alone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``renamed`` and ``similar`` of a comparison; ``of`` is (gen, family, page), as ``pages.family_pages`` gives it."""
    comps = c.identity.components.filter("NOT demoted").withColumn("component", F.to_json(F.struct("old", "new")))
    sides = [comps.select("component", F.lit(s).alias("side"), F.explode(s).alias("family")) for s in ("old", "new")]
    at = lambda gen: of.filter(F.col("gen") == gen).select("family", "page")
    candidates = c.identity.family_edges.filter(F.col("method") == I.CANDIDATE)
    return renamed(sides[0].unionByName(sides[1]), at("old"), at("new")), similar(candidates, c.identity.groups, alone)


def contradictions(former: DataFrame, like: DataFrame, alone: DataFrame) -> DataFrame:
    """(page, kind, names): pages that are told as new or gone although former names or a candidate that is the same say otherwise. There should be none."""
    exact = like.filter("similarity >= 1.0").select("page", "name")
    was = former.filter("kind = 'former'").join(alone.filter("kind = 'added'").select("page"), "page", "left_semi").select("page", "name")
    named = exact.unionByName(was).groupBy("page").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return alone.join(named, "page").select("page", "kind", "names")
