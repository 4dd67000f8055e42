"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, exp(lambda * size / mean size) stopped at ``most``, with one lambda for a
source. That is the solution nearest to "each document once" (in relative entropy, within the box)
whose expected words meet the source's target. The dual is convex with one unknown for a source;
safeguarded Newton steps run over a histogram of (source, size), a Spark aggregation each.
The rates are then rounded to whole copies: a size class takes its words and what larger classes left
over, so a source ends within about half its smallest document of the target.

Defined results: null text has size 0; a null source is a source of its own, last in order; documents
of size 0 take 0 words; an empty table gives an empty one; repeated rows are documents of their own;
ties are broken by a hash of the id (of the text, where there is none), then the id, then the text's hash. Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, global_rank, packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
#: Parts that a (source, size) class is split into, so that no group of copies is one task's.
SALTS = 64


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Weights repeat over the sources in code point order, null last. Sources share all words by weight;
    one that would pass ``most`` times its size stops there and the others share the excess.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(by_source, scratch, [F.col("source").asc_nulls_last()])
    cases = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    listed = scratch.put(ranked.select("source", "source_size", cases.cast("double").alias("weight")), "sources")
    total = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * level > most * F.col("source_size")
        full, left, n = listed.agg(
            F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(over, 1)),
        ).first()
        if n == stopped or not left:
            break
        stopped, level = n, (total - full) / left
    return listed.withColumn("target", F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double")))


def tilt(histogram: DataFrame, targets: DataFrame, scratch: Scratch, most: int = 3, rounds: int = 60) -> DataFrame:
    """(source, lambda): Newton steps on each source's dual at once, kept inside a bracket that shrinks.

    A source is done when its words are within half a word of the target; lambda is then rounded, so
    that the order in which sums are added does not show.
    """
    moments = histogram.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )
    reach = F.coalesce(F.col("mean") / F.col("least"), F.lit(1.0))
    state = scratch.put(
        targets.alias("t").join(moments.alias("m"), F.expr("t.source <=> m.source")).select(
            "t.source", "target", "mean", F.lit(0.0).alias("lam"), (-700 * reach).alias("lo"), (F.log(F.lit(float(most))) * reach).alias("hi"), F.lit(False).alias("done")
        ), "state"
    )
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * x))), F.lit(float(most)))
        words = F.col("size") * F.col("n") * rate
        sums = (
            histogram.alias("h").join(state.alias("s"), F.expr("h.source <=> s.source"))
            .filter("NOT done AND size > 0")
            .groupBy("s.source").agg(F.sum(words).alias("f"), F.sum(F.when(rate < most, words * x).otherwise(0.0)).alias("slope"))
        )
        off = F.coalesce(F.col("f"), F.lit(0.0)) - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - off / F.col("slope")
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        done = F.col("done") | (F.abs(off) <= 0.5) | (hi - lo < 1e-12)
        new = scratch.put(
            state.alias("s").join(sums.alias("q"), F.expr("s.source <=> q.source"), "left").select(
                "s.source", "target", "mean", F.when(done, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")
            ), "state"
        )
        scratch.drop(state)
        state = new
        if not state.filter("NOT done").limit(1).count():
            break
    return state.select("source", "mean", F.round("lam", 9).alias("lam"))


def _carry(most: int):
    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole copies for each size class of one source, from large to small; what is left over goes on."""
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        left, out = 0.0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            want = rate * n + (left / size if size else 0.0)
            copies = int(min(most * n, max(0, round(want))))
            left += (rate * n - copies) * size
            out.append(copies)
        return pdf[["source", "size", "n"]].assign(m=out)

    return spread


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """Rows of (doc_id, size, source, source_size, target, rate, copies, taken, th), one for each document; th is a hash of its text."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.put(
        docs.select("doc_id", "source", word_count().alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("h"), F.xxhash64("text").alias("th")).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")), "sizes"
    )
    salted = scratch.put(sizes.groupBy("source", "size", "salt").agg(F.count("*").alias("n_salt")), "histogram")
    histogram = scratch.put(salted.groupBy("source", "size").agg(F.sum("n_salt").alias("n")), "sizes")
    targets = source_targets(histogram.select("source", (F.col("size") * F.col("n")).alias("size")), scratch, weights, most)
    lam = tilt(histogram, targets, scratch, most)
    rated = histogram.alias("h").join(lam.alias("l"), F.expr("h.source <=> l.source")).select(
        "h.source", "size", "n", F.least(F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)))), F.lit(float(most))).alias("rate")
    )
    rated = scratch.put(rated, "rates")
    # A source's distinct sizes, not its documents, go to one task.
    whole = rated.groupBy("source").applyInPandas(_carry(most), "source string, size long, n long, m long")
    earlier = Window.partitionBy("source", "size").orderBy("salt")
    classes = (
        salted.withColumn("before", F.sum("n_salt").over(earlier) - F.col("n_salt")).alias("a")
        .join(whole.alias("b"), F.expr("a.source <=> b.source AND a.size = b.size"))
        .join(rated.alias("r"), F.expr("a.source <=> r.source AND a.size = r.size"))
        .join(targets.alias("t"), F.expr("a.source <=> t.source"))
        .select("a.source", "a.size", "a.salt", "before", "b.n", "m", "rate", "source_size", "target")
    )
    classes = scratch.put(classes, "classes")
    k = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("h", "doc_id", "th")).cast("long")
    dealt = sizes.withColumn("k", k).alias("d").join(classes.alias("c"), F.expr("d.source <=> c.source AND d.size = c.size AND d.salt = c.salt"))
    copies = F.expr("((before + k) * m) div n - ((before + k - 1) * m) div n")
    return dealt.select("doc_id", "d.size", "d.source", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"), "th")


def take(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "taken")
    keys = ["doc_id", "source", "th"]
    rows = scratch.put(mix(docs, weights, most).select(*keys, "copies"), "copies")
    keyed = packed(docs, "doc_id", "source", "text").withColumn("_th", F.xxhash64("text"))
    on = "d.doc_id <=> c.doc_id AND d.source <=> c.source AND d._th = c.th"
    if rows.groupBy(*keys).count().filter("count > 1").limit(1).count():  # repeated rows: number them on both sides
        rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("copies")))
        keyed = keyed.withColumn("_i", F.row_number().over(Window.partitionBy("doc_id", "source", "_th").orderBy("_th")))
        on += " AND d._i = c._i"
    taken = keyed.alias("d").join(rows.filter("copies > 0").hint("merge").alias("c"), F.expr(on)).withColumn("_copy", F.explode(F.expr("sequence(1L, c.copies)")))
    return unpacked(taken, docs.columns, {c: F.col(f"d.{c}") for c in ("doc_id", "source", "text")})
