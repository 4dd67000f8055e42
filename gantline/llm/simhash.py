"""Near duplicates by SimHash: fingerprints of 64 bits, linked at 3 differing bits or fewer through a Gray-order index.

Equal fingerprints are one. Two that differ in 3 bits agree on at least one of four parts, so each goes to a group for
every part (with more fingerprints: for every two of five, or three of six, parts), and pairs are looked for in groups. In a
group fingerprints are sorted by their rank in Gray code, where neighbours share most bits. Runs of them are nodes of a tree: the
bits that all below a node share are held there once, as mask and pattern, and a child holds what it shares beyond that. A
search adds up the differences on its way down, and a node at which they exceed 3 is left out with all below it. What a
task finds it sends on as a forest, not as pairs.

A group of more than ``LEAF`` fingerprints is cut, in Gray order, into chunks of so many. Chunks whose common bits already
differ too much don't meet; the others meet two by two, each pair in a group of its own.

Defined results: null and empty texts, and those without words, have the fingerprint zero, which links like any other; texts
are read whole; rows that repeat are documents of their own with one result; a null doc_id is left out of the smallest id of
its component, and is null only where all its ids are; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .common import Scratch, global_rank

#: Words of a shingle, the hash's seed, and the bits in which linked fingerprints may differ.
WORDS, SEED, NEAR = 3, 42, 3
#: Children of a node, fingerprints of a group that is searched whole, and fingerprints that a task searches at once.
FANOUT, LEAF, BATCH = 8, 4096, 1 << 16
#: Queries that walk the tree together: with a whole group each they hold some millions of pairs at most.
QUERIES = 512
#: Hashes whose bits are counted at once.
COUNTED = 1 << 17
#: Up to so many fingerprints one of 4 parts names a group, beyond them two of 5, then three of 6.
FOUR_PARTS, FIVE_PARTS = 1 << 26, 1 << 36
#: Groups that are broadcast as too large, at most (12 bytes each).
BROADCAST_GROUPS = 1_000_000
U = np.uint64


def shingle_hashes(text: bytes | None) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, some at a time."""
    words = text.lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), COUNTED):
        pairs = zip(starts[i : i + COUNTED].tolist(), ends[i : i + COUNTED].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], U)


def majority(hashes: list[np.ndarray], owner: list[int], n: int) -> np.ndarray:
    """A fingerprint for each of n texts: the bits that are set in over half of its hashes, in arrays with their texts' numbers, ascending."""
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    pending, held = [], 0

    def count() -> None:
        nonlocal pending, held
        if pending:
            bits = np.unpackbits(np.concatenate([h for _, h in pending]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = 0
            for o, h in pending:
                ones[o] += bits[at : at + len(h)].sum(axis=0, dtype=np.int32)
                at += len(h)
        pending, held = [], 0

    for o, h in zip(owner, hashes, strict=True):
        total[o] += len(h)
        pending.append((o, h))
        held += len(h)
        if held >= COUNTED:
            count()
    count()
    return ((2 * ones > total[:, None]).astype(U) << np.arange(64, dtype=U)).sum(axis=1, dtype=U)


def fingerprint(text: bytes | None) -> int:
    found = list(shingle_hashes(text))
    return int(majority(found, [0] * len(found), 1)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, found, owner, held, first = [], [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                for h in shingle_hashes(text.as_py()):
                    found.append(h)
                    owner.append(i - first)
                    held += len(h)
                if held >= 8 * COUNTED or i + 1 == batch.num_rows:
                    out.append(majority(found, owner, i + 1 - first))
                    found, owner, held, first = [], [], 0, i + 1
            prints = np.concatenate([np.zeros(0, U), *out])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    out = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> U(shift)
    return out


def gray_rank_column(code: Column) -> Column:
    """The same as a signed long, whose order is that of the ranks."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Trees over groups of codes, built for all groups level by level.

    ``levels`` go from the roots down to the codes. A level has for each node the first child (of the level below), the bits that
    it shares beyond its parent's, and their values; and the place behind its last code.
    """

    def __init__(self, group: np.ndarray, code: np.ndarray):
        order = np.lexsort((gray_rank(code), group))
        self.order, self.code = order, code[order]
        group = group[order]
        n = len(code)
        low, high, owner, end = self.code, self.code, group, np.arange(1, n + 1)
        child = None
        levels = []
        while True:
            levels.append((child, low, high, end))
            if len(owner) == len(np.unique(owner)):
                break
            head = np.concatenate([[True], owner[1:] != owner[:-1]])
            start = np.nonzero(head)[0]
            place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
            child = np.nonzero(place % FANOUT == 0)[0]
            last = np.append(child[1:], len(owner)) - 1
            low, high, owner, end = np.bitwise_and.reduceat(low, child), np.bitwise_or.reduceat(high, child), owner[child], end[last]
        self.levels = []
        above = np.zeros(len(owner), U)  # bits that the parents hold
        for child, low, high, end in reversed(levels):
            shared = ~(low ^ high)
            own = shared & ~above
            self.levels.append((child, own, low & own, end))
            if child is not None:
                below = len(levels[len(levels) - len(self.levels) - 1][1])
                above = np.repeat(shared, np.diff(np.append(child, below)))
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        self.root = np.cumsum(starts) - 1

    def near(self, first: int, last: int, most: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """Places i < j of codes of one group that differ in at most so many bits, i being from first to before last."""
        query = np.arange(first, last)
        node = self.root[query]
        apart = np.zeros(len(query), np.uint8)
        for level, (child, own, pattern, end) in enumerate(self.levels):
            apart = apart + np.bitwise_count((self.code[query] & own[node]) ^ pattern[node])
            stay = (apart <= most) & (end[node] > query + 1)
            query, node, apart = query[stay], node[stay], apart[stay]
            if child is not None:
                below = np.append(child, len(self.levels[level + 1][1]))
                count = below[node + 1] - below[node]
                query, apart = np.repeat(query, count), np.repeat(apart, count)
                within = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
                node = np.repeat(below[node], count) + within
        return query, node


def forest(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of codes that join, within each group, all that near codes reach: one for each code but one of a tree."""
    index = GrayIndex(group, code)
    parent = np.arange(len(code))
    for first in range(0, len(code), QUERIES):
        a, b = index.near(first, min(first + QUERIES, len(code)))
        while len(a):
            while True:  # to the roots
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            a, b = parent[a], parent[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    joined = np.nonzero(parent != np.arange(len(code)))[0]
    return index.code[joined], index.code[parent[joined]]


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows (part, key, fp) sorted by part and key; whole groups are searched together."""

    def told(rows: np.ndarray) -> pa.RecordBatch:
        change = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        group = np.concatenate([[0], np.cumsum(change)]) if len(rows) else np.zeros(0, np.int64)
        several = np.bincount(group)[group] > 1 if len(rows) else np.zeros(0, bool)
        a, b = forest(group[several], np.ascontiguousarray(rows[several, 2]).view(U)) if several.any() else (np.zeros(0, U), np.zeros(0, U))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held = np.zeros((0, 3), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)])
        if len(held) >= BATCH:
            cut = np.nonzero((held[1:, :2] != held[:-1, :2]).any(axis=1))[0]
            if len(cut):  # the last group may go on
                yield told(held[: cut[-1] + 1])
                held = held[cut[-1] + 1 :]
    yield told(held)


def group_masks(n: int) -> list[int]:
    """Bits that name groups: any two codes that differ in at most 3 bits agree on all of one mask."""
    parts = 4 if n <= FOUR_PARTS else 5 if n <= FIVE_PARTS else 6
    cuts = [64 * i // parts for i in range(parts + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(some) for some in combinations(each, parts - NEAR)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, scratch: Scratch, leaf: int = LEAF) -> DataFrame:
    """(a, b) from distinct fingerprints (fp): they join all that links reach."""
    masks = group_masks(prints.count())
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    postings = prints.select(F.explode(keys).alias("g"), "fp").select("g.part", "g.key", "fp")
    # Only groups of several fingerprints matter, and those too large for one task are cut.
    large = scratch.put(postings.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > leaf).select("part", "key"), "large")
    n_large = large.count()
    few = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
    small = postings.join(few, ["part", "key"], "left_anti")
    out = small.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(forests, "a long, b long")
    if n_large:
        rows = postings.join(few, ["part", "key"], "left_semi")
        ranked = global_rank(rows.withColumn("gray", gray_rank_column(F.col("fp"))), scratch, [F.col("part"), F.col("key"), F.col("gray")], "place")
        ranked = scratch.put(ranked, "ranked")
        start = ranked.groupBy("part", "key").agg(F.min("place").alias("start"))
        chunked = ranked.join(F.broadcast(start) if n_large <= BROADCAST_GROUPS else start, ["part", "key"])
        chunked = scratch.put(chunked.select("part", "key", "fp", F.expr(f"(place - start) div {leaf}").alias("chunk")), "chunks")
        nodes = scratch.put(chunked.groupBy("part", "key", "chunk").agg(F.expr("bit_and(fp)").alias("low"), F.expr("bit_or(fp)").alias("high")), "nodes")
        left, right = (nodes.select("part", "key", F.col("chunk").alias(f"chunk{i}"), F.col("low").alias(f"low{i}"), F.col("high").alias(f"high{i}")) for i in (1, 2))
        both = F.expr("~(low1 ^ high1) & ~(low2 ^ high2)")  # bits that are common in either chunk
        meets = left.join(right, ["part", "key"]).filter("chunk1 <= chunk2").filter(F.bit_count(F.expr("low1 ^ low2").bitwiseAND(both)) <= NEAR)
        meets = scratch.put(meets.select("part", "key", "chunk1", "chunk2", F.monotonically_increasing_id().alias("pair")), "pairs")
        # Each chunk goes to the pairs that it is in.
        sides = meets.select("part", "key", F.col("chunk1").alias("chunk"), "pair").unionByName(meets.filter("chunk1 < chunk2").select("part", "key", F.col("chunk2").alias("chunk"), "pair"))
        pairs = chunked.join(sides, ["part", "key", "chunk"]).select(F.lit(-1).cast("long").alias("part"), F.col("pair").alias("key"), "fp")
        out = out.unionByName(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(forests, "a long, b long"))
    return scratch.put(out.distinct(), "links")


def link(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    printed = scratch.put(fingerprints(docs), "fingerprints")
    classes = scratch.put(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(links(classes.select("fp"), scratch, leaf), scratch)
    mapped = scratch.put(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label")), "mapped")
    least = mapped.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = scratch.put(mapped.join(least, "label").select("fp", "component_id"), "components")
    return printed.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
