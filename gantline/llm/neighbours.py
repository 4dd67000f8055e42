"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beam.

Equal vectors are one node. Nodes are dealt by hash into shards of a bounded size. In a shard, greedy searches
on the graph so far propose neighbours for each node, and relaxed distance pruning keeps a diverse few of them,
with edges back. A query walks every shard's graph with a beam, the shards' findings meet, and the best by cosine,
computed in double precision on the original vectors, are its result. Where rounding can't tell the nearest of a shard apart, all of the shard
are scored for the query.

Defined results: rows with a null id, a null, empty or zero vector, or a null or non-finite component take no
part; vectors are only compared with those of their own length; a query's own row is no candidate, its equals
under other ids are; rows that repeat an id and vector count once; ties go to smaller ids; fewer candidates than
asked for are all given; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Nodes in a shard, at most about: the memory of a task follows it, whatever the corpus. Larger ones took longer and found less.
SHARD_ROWS = 4096
#: Queries that one task takes to a shard.
QUERY_ROWS = 20_000
#: Edges from a node, beam while building, beam of a query, and the factor by which a nearer edge may be longer and still prune.
DEGREE, BUILD_BEAM, BEAM, RELAXED = 24, 48, 96, 1.2
#: Distances up to this are noise in double precision.
ALIKE = 1e-13
BLOCK = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (1 - cosine) of each query's ``beam`` best, nearest first; -1 where there are fewer. All queries step together."""
    n, q = len(points), len(queries)
    rows = np.arange(q)
    seen = np.zeros((q, n), bool)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf)
    done = np.ones((q, beam), bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, 1 - queries @ points[start], False
    seen[:, start] = True
    active = rows
    while len(active):
        at = np.where(done[active], np.inf, far[active]).argmin(axis=1)
        node = ids[active, at]
        done[active, at] = True
        near = np.sort(edges[node], axis=1)
        fresh = (near >= 0) & ~seen[active[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # edges drawn at random may be named twice
        seen[active[:, None], np.where(fresh, near, node[:, None])] = True
        d = np.where(fresh, 1 - np.einsum("qrd,qd->qr", points[near], queries[active]), np.inf)
        all_far, all_ids = np.concatenate([far[active], d], axis=1), np.concatenate([ids[active], near], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[active], ids[active], done[active] = (np.take_along_axis(x, order, axis=1) for x in (all_far, all_ids, all_done))
        active = active[~done[active].all(axis=1)]
    order = far.argsort(axis=1, kind="stable")
    far, ids = np.take_along_axis(far, order, axis=1), np.take_along_axis(ids, order, axis=1)
    return np.where(np.isfinite(far), ids, -1), far


def candidates_of(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, k: int, beam: int) -> list[np.ndarray]:
    """The nodes that each query's beam holds. Where two of the k nearest and the next, or the k-th and the furthest of a full beam, are as near as rounding can tell,
    others as near may not have been reached or held: such queries get all nodes instead, so that exact scores decide."""
    beam = min(beam, max(k + 1, len(points)))
    found, far = beam_search(points, edges, start, queries, beam)
    near = np.where(np.isfinite(far), far, 2.0 + np.arange(beam))  # where fewer were found, all are clear
    unclear = (np.diff(near[:, : k + 1], axis=1) <= ALIKE).any(axis=1) | ((found[:, -1] >= 0) & (near[:, -1] - near[:, min(k, beam) - 1] <= ALIKE))
    everyone = np.arange(len(points))
    return [everyone if u else f[f >= 0] for f, u in zip(found, unclear, strict=True)]


def prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, relaxed: float, degree: int) -> np.ndarray:
    """The edges of each node out of its candidates (-1: none): the nearest goes in and strikes out what it is nearer to than the node, by the factor.

    Candidates that double precision can't tell from the node would strike each other out by chance. The next of them in a ring of
    numbers get a third of the edges, so that a group of near copies stays connected.
    """
    candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1  # named twice
    d = np.where(candidates >= 0, np.maximum(0, 1 - np.einsum("ncd,nd->nc", points[candidates], points[nodes])), np.inf)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    alike = d <= ALIKE
    ring = np.where(alike, (candidates - nodes[:, None]) % len(points), len(points))
    count = np.minimum(alike.sum(axis=1), degree // 3)
    if count.any():
        nearest = np.take_along_axis(candidates, ring.argsort(axis=1, kind="stable")[:, : degree // 3], axis=1)
        out[:, degree - nearest.shape[1] :] = np.where(np.arange(nearest.shape[1]) < count[:, None], nearest, -1)
        d[alike] = np.inf
    order = d.argsort(axis=1, kind="stable")
    d, candidates = np.take_along_axis(d, order, axis=1), np.take_along_axis(candidates, order, axis=1)
    between = 1 - np.einsum("ncd,nkd->nck", points[candidates], points[candidates])
    for k in range(degree):
        at = d.argmin(axis=1)
        left = np.isfinite(d[rows, at]) & ((count == 0) | (k < degree - degree // 3))
        if not left.any():
            break
        out[left, k] = candidates[rows, at][left]
        struck = relaxed * between[rows, at] <= d
        struck[rows, at] = True
        d[struck] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED, seed: int = 11) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1: none) and the node nearest to the centre, where searches start."""
    n = len(points)
    rng = np.random.default_rng(seed)
    start = int((points @ points.mean(axis=0)).argmax())
    edges = rng.integers(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = start
    if n <= degree + 1:  # all know all
        everyone = np.tile(np.arange(n), (n, 1))
        edges = np.full((n, degree), -1, np.int64)
        edges[:, : n - 1] = everyone[everyone != np.arange(n)[:, None]].reshape(n, n - 1)
        return edges, start
    for factor in (1.0, relaxed):
        order = rng.permutation(n)
        for i in range(0, n, BLOCK):
            nodes = order[i : i + BLOCK]
            found, _ = beam_search(points, edges, start, points[nodes], beam)
            edges[nodes] = prune(points, nodes, np.concatenate([found, edges[nodes]], axis=1), factor, degree)
            # Edges back: each neighbour gets the nodes that chose it, and prunes if that is too many.
            back, to = edges[nodes].ravel(), np.repeat(nodes, degree)
            back, to = back[back >= 0], to[edges[nodes].ravel() >= 0]
            by = np.argsort(back, kind="stable")
            back, to = back[by], to[by]
            heads, first = np.unique(back, return_index=True)
            most = int(np.diff(np.append(first, len(back))).max(initial=0))
            extra = np.full((len(heads), most), -1, np.int64)
            row = np.searchsorted(heads, back)
            extra[row, np.arange(len(back)) - first[row]] = to
            for j in range(0, len(heads), BLOCK):
                some = heads[j : j + BLOCK]
                edges[some] = prune(points, some, np.concatenate([edges[some], extra[j : j + BLOCK]], axis=1), factor, degree)
    return edges, start


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), v.alias("embedding")).dropDuplicates()


INDEX = "shard long, node long, start long, ids array<long>, embedding array<double>, edges array<long>"


def index(rows: DataFrame, scratch: Scratch, most_ids: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graph of each shard, a row for each node. A node of equal vectors keeps its ``most_ids`` smallest ids: no query can want more of them."""
    listed = rows.withColumn("h", F.xxhash64("embedding"))
    place = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
    nodes = listed.withColumn("place", place).filter(F.col("place") <= most_ids).groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = scratch.put(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    width = F.size("embedding").cast("long")
    dealt = nodes.withColumn("shard", width * (1 << 32) + F.pmod("h", F.lit(shards)))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]), kind="stable", ignore_index=True)
        edges, start = build(unit(np.array(pdf["embedding"].tolist())))
        return pd.DataFrame({"shard": pdf["shard"], "node": np.arange(len(pdf)), "start": start, "ids": pdf["ids"], "embedding": pdf["embedding"], "edges": edges.tolist()})

    return scratch.put(dealt.groupBy("shard").applyInPandas(make, INDEX), "graph")


def search(graph: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best over all shards of its length."""
    blocks = max(1, -(-queries.count() // query_rows))
    shards = graph.select(F.col("shard").alias("at"), F.shiftright("shard", 32).cast("int").alias("width")).distinct()
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("width"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("part"))
    shards = F.broadcast(shards) if shards.count() <= 1_000_000 else shards  # 12 bytes for each shard
    to_shards = asked.join(shards, "width").drop("width")  # every query goes to every shard, in blocks
    copies = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(nodes: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(nodes) and len(qs):
            nodes = nodes.sort_values("node", ignore_index=True)
            original = np.array(nodes["embedding"].tolist())
            points, edges, start = unit(original), np.array(nodes["edges"].tolist()), int(nodes["start"].iloc[0])
            ids = nodes["ids"].tolist()
            for i in range(0, len(qs), BLOCK):
                part = qs.iloc[i : i + BLOCK]
                vectors = np.array(part["embedding"].tolist())
                found = candidates_of(points, edges, start, unit(vectors), k + 1, beam)
                for q, v, near in zip(part["query_id"], vectors, found, strict=True):  # all that were found are scored: vectors almost alike are told apart by the measure itself
                    scores = cosine(np.broadcast_to(v, (len(near), len(v))), original[near])
                    mine = sorted((-s, int(x)) for node, s in zip(near, scores, strict=True) for x in ids[node] if x != q)
                    out += [(q, x, -s) for s, x in mine[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = copies.groupBy("shard", "block").cogroup(to_shards.groupBy("at", "part")).applyInPandas(find, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries are rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own."""
    scratch = Scratch(rows.sparkSession, "neighbours")
    listed = scratch.put(valid(rows), "vectors")
    graph = index(listed, scratch, k + 1)
    return search(graph, listed.filter(F.col("vec_id") % every == 0), k)
