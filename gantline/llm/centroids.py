"""Centroid clustering on integer vectors, with the nearest centroid found by the threshold algorithm.

For each dimension the centroids stand in a list sorted by their component. From a vector's own value each list is
walked outward, to the nearer side first. A centroid that any list reaches is measured exactly, once. The squares of
the distances at which the lists stand add up to a bound for all centroids that no list has reached; once it strictly
exceeds the best exact distance the walk ends, so ties are still told apart.

A round is one pass over the written integer vectors. A task sends on one row of sums for each centroid, and what
comes to the driver is the new centroids: a number of rows that is a parameter.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; a null
vec_id is kept but starts no centroid; rows that repeat are vectors of their own; fewer vectors than centroids make
fewer centroids; scaled components are held within 2 ** 27 on both sides, so that squared distances are longs; an empty
centroid stays where it is; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components stay within this, so that 64 squared differences fit a long.
MOST = 1 << 27
#: Vectors that walk their lists together.
BLOCK = 2048
#: More than any distance between two components.
FAR = np.int64(1 << 30)


class SortedLists:
    """The centroids' components by dimension, sorted, with the centroid of each."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.owner = centroids.argsort(axis=0, kind="stable")
        self.value = np.take_along_axis(centroids, self.owner, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Centroid and squared distance of each vector, ties to the smaller number; and how many distances were measured."""
        n, dims = x.shape
        k = len(self.centroids)
        column = np.arange(dims)
        right = np.stack([np.searchsorted(self.value[:, d], x[:, d]) for d in range(dims)], axis=1)
        left = right - 1
        best = np.full(n, np.iinfo(np.int64).max)
        winner = np.full(n, k)
        met = np.zeros((n, k), bool)
        measured = 0
        active = np.arange(n)
        while len(active):
            here, low, high = x[active], left[active], right[active]
            below = np.where(low >= 0, here - self.value[np.maximum(low, 0), column], FAR)
            above = np.where(high < k, self.value[np.minimum(high, k - 1), column] - here, FAR)
            down = below <= above
            reached = self.owner[np.where(down, low, np.minimum(high, k - 1)), column]
            left[active] -= down
            right[active] += ~down
            now = met[active]
            before = now.copy()
            now[np.arange(len(active))[:, None], reached] = True
            met[active] = now
            row, centroid = np.nonzero(now & ~before)
            gap = here[row] - self.centroids[centroid]
            exact = np.full((len(active), k), np.iinfo(np.int64).max)
            exact[row, centroid] = (gap * gap).sum(axis=1)
            measured += len(row)
            first = exact.argmin(axis=1)
            distance = exact[np.arange(len(active)), first]
            better = (distance < best[active]) | ((distance == best[active]) & (first < winner[active]))
            best[active] = np.where(better, distance, best[active])
            winner[active] = np.where(better, first, winner[active])
            frontier = np.minimum(below, above)
            going = ((frontier * frontier).sum(axis=1) <= best[active]) & ~now.all(axis=1)
            active = active[going]
        return winner, best, measured


def integer_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors that take part: q holds floor(scale * x)."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x * float(scale)))
    return rows.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(held(x)).cast("int")).alias("q"))


def blocks(batch: pa.RecordBatch, dimensions: int) -> Iterator[np.ndarray]:
    q = batch.column(batch.schema.get_field_index("q")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
    for i in range(0, len(q), BLOCK):
        yield q[i : i + BLOCK]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each with vectors goes to the exact floor of their mean."""
    k, dims = centroids.shape
    lists = SortedLists(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for x in blocks(batch, dims):
                winner, _, _ = lists.nearest(x)
                count += np.bincount(winner, minlength=k)
                for c in np.unique(winner):
                    total[c] += x[winner == c].sum(axis=0)
        some = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.select("q").mapInArrow(sums, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d")
    out = centroids.copy()
    for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # a row for each component of the centroids
        out[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    return out


CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "centroids")
    vectors = scratch.put(integer_vectors(rows, dimensions, scale), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.filter("vec_id IS NOT NULL").select(drawn.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()  # as many rows as clusters
    if not start:
        return spark.createDataFrame([], CLUSTERED)
    centroids = np.array([r["q"] for r in start], np.int64)
    for _ in range(rounds):
        new = moved(vectors, centroids)
        if (new == centroids).all():
            break  # all further rounds give the same
        centroids = new
    lists = SortedLists(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lists.nearest(x)[:2] for x in blocks(batch, dimensions)] or [(np.zeros(0, np.int64),) * 2]
            winner, distance = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(winner.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = scratch.put(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each cluster
    most = (1 << 63) - 1  # only vectors held at the bounds can reach it
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, min(most, s), min(most, sum(inertia.values())), names[c]) for c, s in inertia.items()]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in DuckDB's SQL, by measuring every centroid, a few subqueries for each round."""
    gaps = "CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.q, c.q)]) AS BIGINT)"
    near = f"SELECT r, q, c, distance FROM (SELECT v.r, v.q, c.c, {gaps} AS distance, row_number() OVER (PARTITION BY v.r ORDER BY {gaps}, c.c) AS place FROM kept v, c%d c) WHERE place = 1"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(greatest(-{MOST}.0, least({MOST}.0, {scale} * CAST(x AS DOUBLE)))) AS BIGINT) for x in embedding] AS q "
        f"FROM embeddings WHERE len(embedding) = {dimensions} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM kept WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {clusters}))",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near % i})",
            f"s{i} AS (SELECT c, d, CAST(sum(q[d]) AS HUGEINT) AS s, count(*) AS n FROM a{i}, range(1, {dimensions + 1}) t(d) GROUP BY c, d)",
            f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS q FROM s{i} GROUP BY c)",
            f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m{i}.q, o.q) AS q FROM c{i} o LEFT JOIN m{i} ON m{i}.c = o.c)",
        ]
    steps.append(f"z AS MATERIALIZED ({near % rounds})")
    out = (
        "SELECT k.vec_id, CAST(z.c AS INTEGER) AS cluster, z.distance, CAST(sum(z.distance) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(z.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM z JOIN kept k ON k.r = z.r JOIN c{rounds} c ON c.c = z.c"
    )
    return "WITH " + ",\n".join(steps) + "\n" + out
