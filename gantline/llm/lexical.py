"""Ranked lexical search: all documents for each item, as products of dense blocks.

One pass over the texts writes, for each document, its length and how often it holds each term of the items. Document
frequencies and the corpus' length are sums over that table. Then tiles of items times their own compact vocabulary
(weights) are multiplied with tiles of that vocabulary times documents (impacts) in float64. A weight is below 2 ** 16 and an
impact below 2 ** 20, so the sum over a slab of 2 ** 12 terms stays below 2 ** 53 and is exact in any order; slabs are added as
64-bit integers. A task keeps each item's best documents, with ties by id, and these meet by item.

The items' terms go to the tasks in blocks of a bounded number; more items make more blocks, each a pass of its own.

Defined results: null text has no terms, and such documents are in no count; rows that repeat are documents of their own,
each with a rank; null ids come last among equal scores; items that repeat an id and a text count once, items that share an id
with other texts are items of their own; an item without terms, or whose terms no document holds, gets no rows; texts are read
whole; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TOP = 10
#: Terms of items that go to the tasks at once, counted for each item.
BLOCK_TERMS = 400_000
#: Items, terms and documents of a tile.
ITEMS, SLAB, DOCUMENTS = 256, 1 << 12, 1024
#: Tasks' findings of an item meet in so many groups before they meet in one.
SALTS = 64
#: Bytes: A-Z as a-z; digits, letters and all of non-ASCII characters stay; the others part terms.
PARTS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(PARTS).split() if text else []


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def as_bytes(column: str) -> Column:
    return F.col(column).cast("string").cast("binary")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, h, terms): the distinct terms of each item; h tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t.as_py()))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "h", "terms"])

    told = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), as_bytes("text").alias("text"))
    return told.dropDuplicates(["item_id", "h"]).mapInArrow(run, "item_id long, h long, terms array<binary>").filter(F.size("terms") > 0)


def term_counts(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) of each document with terms: its length, and the numbered terms that it holds, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.get
        for batch in batches:
            keep, lengths, ids, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                found = np.fromiter((x for x in map(number, words) if x is not None), np.int32)
                found, counts = np.unique(found, return_counts=True)
                keep.append(i)
                lengths.append(len(words))
                ids.append(found)
                tfs.append(counts)
                ends.append(ends[-1] + len(found))
            offsets = pa.array(np.array(ends, np.int32))
            flat = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), flat(ids, np.int32), flat(tfs, np.int64)], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text")).mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


class Tile:
    """Some items: their compact vocabulary and dense weights."""

    def __init__(self, rows: list[list[int]], weights: np.ndarray):
        self.vocabulary = np.unique(np.concatenate([np.array(r, np.int64) for r in rows]))
        self.weights = np.zeros((len(rows), len(self.vocabulary)))
        for i, r in enumerate(rows):
            self.weights[i, np.searchsorted(self.vocabulary, r)] = weights[r]

    def scores(self, document: np.ndarray, ids: np.ndarray, impacts: np.ndarray, n_documents: int) -> np.ndarray:
        """Items by documents, from the entries (document, term, impact)."""
        at = np.searchsorted(self.vocabulary, ids)
        at[at == len(self.vocabulary)] = 0
        own = self.vocabulary[at] == ids
        at, document, impacts = at[own], document[own], impacts[own]
        out = np.zeros((len(self.weights), n_documents), np.int64)
        for s in range(0, len(self.vocabulary), SLAB):
            slab = self.weights[:, s : s + SLAB]
            here = (at >= s) & (at < s + SLAB)
            tile = np.zeros((slab.shape[1], n_documents))
            tile[at[here] - s, document[here]] = impacts[here]
            out += (slab @ tile).astype(np.int64)
        return out


class Best:
    """The best documents so far of each item of a tile: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)  # lower scores can't come in any more
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(items)]

    def take(self, scores: np.ndarray, doc_ids: np.ndarray, none: np.ndarray) -> None:
        for i in np.nonzero((scores >= self.least[:, None]).any(axis=1))[0]:
            new = np.nonzero(scores[i] >= self.least[i])[0]
            s, m, d = (np.concatenate(x) for x in zip(self.rows[i], (scores[i][new], none[new], doc_ids[new]), strict=True))
            order = np.lexsort((d, m, -s))[: self.top]
            self.rows[i] = s[order], m[order], d[order]
            if len(order) == self.top:
                self.least[i] = s[order[-1]]


def impact(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def best_of_tasks(counted: DataFrame, tiles: list[tuple[Tile, list[int | None], int]], n_documents: int, n_terms: int, top: int) -> DataFrame:
    """(no, item_id, doc_id, score): what each task finds best for each item. Tiles come with their items' ids and first number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(ids), top) for _, ids, _ in tiles]
        for whole in batches:
            for i in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(i, DOCUMENTS)
                doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                lengths = batch.column(1).to_numpy()
                # 90 * n * N may outgrow a long.
                m = (10 + lengths.astype(object) * (90 * n_documents) // n_terms).astype(np.int64)
                sizes = batch.column(2).value_lengths().to_numpy()
                document = np.repeat(np.arange(batch.num_rows), sizes)
                ids, tfs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                impacts = impact(tfs, m[document])
                for (tile, _, _), mine in zip(tiles, best, strict=True):
                    mine.take(tile.scores(document, ids, impacts, batch.num_rows), doc_ids, none)
        for (_, ids, first), mine in zip(tiles, best, strict=True):
            for j, (s, none, d) in enumerate(mine.rows):
                columns = [pa.array([first + j] * len(s), pa.int64()), pa.array([ids[j]] * len(s), pa.int64()), pa.array(d, mask=none), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, names=["no", "item_id", "doc_id", "score"])

    return counted.mapInArrow(run, "no long, item_id long, doc_id long, score long")


def in_blocks(listed: DataFrame, block_terms: int) -> tuple[DataFrame, int]:
    """The items with a block each, so that no block of several items has more than about so many terms; the sizes are checked."""
    n_items, total = listed.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-total // block_terms))
    while True:
        dealt = listed.withColumn("block", F.pmod(F.xxhash64("item_id", "h"), F.lit(blocks)))
        size = dealt.groupBy("block").agg(F.count("*").alias("items"), F.sum(F.size("terms")).alias("terms"))
        if blocks >= 4 * n_items or not size.filter((F.col("items") > 1) & (F.col("terms") > 2 * block_terms)).limit(1).count():
            return dealt, blocks
        blocks *= 2


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    listed, blocks = in_blocks(scratch.put(item_terms(items), "items"), block_terms)
    found = None
    for block in range(blocks):
        rows = listed.filter(F.col("block") == block).orderBy("item_id", "h").collect()  # bounded by the block's terms
        if not rows:
            continue
        numbers = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        counted = scratch.put(term_counts(docs, numbers), "counts")
        n_documents, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_documents:
            continue
        weights = np.zeros(len(numbers), np.int64)
        for r in counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():  # a row for each term of the block at most
            weights[r["id"]] = weight(n_documents, r["df"])
        tiles = []
        for i in range(0, len(rows), ITEMS):
            some = rows[i : i + ITEMS]
            tiles.append((Tile([[numbers[bytes(t)] for t in r["terms"]] for r in some], weights), [r["item_id"] for r in some], (block << 32) + i))
        part = scratch.put(best_of_tasks(counted, tiles, n_documents, n_terms, top), "best")
        scratch.drop(counted)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    nearly = salted.withColumn("place", F.row_number().over(Window.partitionBy("no", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = nearly.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: The same counted by joins, in DuckDB's SQL.
SQL = r"""
WITH words AS (
    SELECT k, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)
),
sizes AS (SELECT k, doc_id, count(*) AS n FROM words GROUP BY k, doc_id),
corpus AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
tf AS (SELECT k, term, count(*) AS tf FROM words GROUP BY k, term),
wanted AS (
    SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))
),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT nd FROM corpus) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf WHERE term IN (SELECT term FROM wanted) GROUP BY term),
scored AS (
    SELECT w.i, w.item_id, s.k, s.doc_id, CAST(sum(g.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + ((90 * s.n * c.nd) // c.nt))))) AS BIGINT) AS score
    FROM wanted w JOIN tf t ON t.term = w.term JOIN weights g ON g.term = w.term JOIN sizes s ON s.k = t.k, corpus c
    GROUP BY w.i, w.item_id, s.k, s.doc_id
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
WHERE place <= 10
"""
