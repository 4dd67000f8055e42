"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles. Two documents link when their sets' Jaccard similarity
is at least 75 %. All tokens stand in one order, rare ones first (by a count of documents in a table of fixed
width that every document adds to; any order is right, a better one is faster). Of sets that similar, prefixes of
n - ceil(0.75 n) + l tokens share at least l tokens. Each document takes its own l: longer prefixes cost more
postings, but ask for more shared tokens before a pair is verified, and l is where the estimate of postings read
plus pairs verified is least. A pair needs as many shared prefix tokens as the smaller l of the two. Once two
sizes are known, so is the overlap o that they need, and prefixes of n - o + l do for that pair: a posting tells
its place in the order, and what lies beyond for the pair doesn't meet. Documents that share much, but too little,
have their own rare tokens there, and so seldom meet at all. Where a token has many classes, these also have sketches: the
parity of a set's tokens in each of 512 cells. Two sketches differ in at most as many cells as the sets differ in tokens, so
a pair whose sketches differ in more than similar sets of its sizes may is out before it is counted.

Equal sets are one class. Classes, not documents, are joined, and groups of near copies aren't paired off: first
each class is verified against the few smallest classes of its tokens with which it shares most, and what links is
one component; then all candidate pairs across components are verified, so no component is missed.
Classes and shingles are known by 64-bit hashes.

Defined results: null text and text without words give an empty set, linked with nothing; fewer than five words
are one shingle; texts of any length are read whole; repeated rows and copies are of one class; a null doc_id gets
the smallest id of its component and is never one itself; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, packed, unpacked
from .hashing import BYTES, FACTOR, U, mix64, powers, run_hashes

SHINGLE = 5
#: Similarity is at least PERCENT / 100.
PERCENT = 75
#: The table of document counts has 2 ** COUNT_BITS cells of 4 bytes, whatever the corpus.
COUNT_BITS = 20
#: The table is added up in so many parts.
COUNT_PARTS = 64
#: The longest extension l of a prefix.
MOST_MATCHES = 4
#: What verifying a candidate costs, in postings.
VERIFY_COST = 8.0
#: Smallest classes of a token that its other classes meet first, and how many of those that a class meets are verified.
HUBS = 3
#: From so many classes on, those of a token have sketches and meet more of its smallest classes first.
CROWD, CROWD_HUBS = 16, 64
#: A token's classes are dealt to tasks in lots of about so many.
LOT = 4096
#: A sketch is so many numbers of 64 bits.
SKETCH = 8
#: Classes whose documents are told to the scan that makes their sets by broadcast, at most (16 bytes each).
BROADCAST_CLASSES = 2_000_000
#: Bytes of text that go through numpy at once.
CHUNK_BYTES = 1 << 21

#: A-Z as a-z.
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
FACTORS = powers(FACTOR, SHINGLE + 3)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in bytes that begin and end with white space."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    return run_hashes(data, begin, end, LOWER), begin


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") < CHUNK_BYTES - 2 * (j - i) - 2):
            size += len(texts[j] or b"")
            j += 1
        parts = [t or b"" for t in texts[i:j]]
        data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        starts = 1 + np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        words, begin = word_hashes(data)
        at = np.searchsorted(begin, starts)
        runs = np.zeros(max(0, len(words) - SHINGLE + 1), U)
        for k in range(SHINGLE):
            runs += words[k : len(words) - SHINGLE + 1 + k] * FACTORS[k + 3] if len(runs) else U(0)
        runs = mix64(runs)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:  # the whole sequence; its length keeps it apart from shingles
                h = np.full(1, b - a, U)
                for k in range(a, b):
                    h = mix64(h * FACTOR + words[k : k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, U))
        i = j
    return out


def class_of(tokens: np.ndarray) -> int | None:
    """A set's class: a signed 64-bit hash of the set, or None of the empty set."""
    if not len(tokens):
        return None
    h = mix64(mix64(tokens + FACTOR).sum(dtype=U, keepdims=True) + U(len(tokens)))
    return int(h.view(np.int64)[0])


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """The parity of tokens in each of 64 * SKETCH cells."""
    odd = np.bincount((tokens & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> U(64 - bits)).astype(np.int64)


def needed(n: int) -> int:
    """The tokens of a set of n that any set it links with shares, at least."""
    return -(-PERCENT * n // 100)


def prefix(tokens: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """A set's prefix and its l."""
    n = len(tokens)
    if n <= 2:  # only an equal set is similar enough
        return tokens[:0], 1
    cost = counts[cells(tokens, bits)]
    order = np.lexsort((tokens, cost))
    base = n - needed(n)
    read = np.cumsum(cost[order][: base + MOST_MATCHES].astype(np.float64))
    most = min(MOST_MATCHES, needed(n), len(read) - base)
    estimate = [read[base + m - 1] * (1 + VERIFY_COST / m) for m in range(1, most + 1)]
    best = int(np.argmin(estimate)) + 1
    return tokens[order[: base + best]], best


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def document_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, cls, s0, s1, ...) of each document; th is a hash of the text as it stands, s0 and so on are the sketch."""
    names = [f"s{k}" for k in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(b.column(1).to_pylist())
            sketches = np.array([sketch_of(x) for x in sets], np.int64).reshape(-1, SKETCH)
            columns = [b.column(0), b.column(2), pa.array(map(len, sets), pa.int64()), pa.array(map(class_of, sets), pa.int64()), *map(pa.array, sketches.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n_shingles", "cls", *names])

    return _texts(docs, F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n_shingles long, cls long" + "".join(f", {x} long" for x in names))


def token_counts(docs: DataFrame, bits: int = COUNT_BITS) -> np.ndarray:
    """Documents by the cell of their tokens, over all documents. Tasks add up parts; the driver gets the table, of fixed size."""
    width = (1 << bits) // COUNT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int32)
        for b in _slices(batches):
            sets = shingle_sets(b.column(1).to_pylist())
            if sets:
                table += np.bincount(cells(np.concatenate(sets), bits), minlength=1 << bits).astype(np.int32)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_PARTS), pa.int32()), pa.array([table[i * width : (i + 1) * width].tobytes() for i in range(COUNT_PARTS)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([np.minimum(v, (1 << 31) - 1).astype(np.int32).tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    added = _texts(docs).mapInArrow(count, schema).repartition(COUNT_PARTS, "part").mapInArrow(add, schema)
    table = np.zeros(1 << bits, np.int32)
    for row in added.collect():  # COUNT_PARTS rows
        table[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.int32)
    return table


def postings(docs: DataFrame, counts: np.ndarray, bits: int = COUNT_BITS, lot: int = LOT) -> DataFrame:
    """(token, cls, n, need, place, lots, lot): the prefix of each class once a task, need being its l, place from 0 in the order of tokens.

    A token's cell in the table of counts tells how many documents have it at most, and so in how many lots its classes are to be dealt.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for b in _slices(batches):
            tokens, classes, sizes, needs, places, lots = [], [], [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist()):
                cls = class_of(s)
                if cls in seen:
                    continue
                seen.add(cls)
                part, m = prefix(s, table, bits)
                if len(part):
                    tokens.append(part.view(np.int64))
                    classes.append(np.full(len(part), cls, np.int64))
                    sizes.append(np.full(len(part), len(s), np.int32))
                    needs.append(np.full(len(part), m, np.int8))
                    places.append(np.arange(len(part), dtype=np.int32))
                    lots.append(table[cells(part, bits)] // lot + 1)
            if tokens:
                columns = [np.concatenate(x) for x in (tokens, classes, sizes, needs, places, lots)]
                own = (columns[1].view(U) % columns[5].astype(U)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, own)], names=["token", "cls", "n", "need", "place", "lots", "lot"])

    return _texts(docs).mapInArrow(run, "token long, cls long, n int, need byte, place int, lots int, lot int")


def class_sets(docs: DataFrame) -> DataFrame:
    """(cls, tokens) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 200):
            sets = shingle_sets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(map(class_of, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "tokens"])

    return _texts(docs).mapInArrow(run, "cls long, tokens array<long>")


def meeting(first: DataFrame, second: DataFrame, lot: int = LOT) -> DataFrame:
    """Pairs of rows (token, classes, cls, ...) that share a token, the smaller class first; columns get _a and _b.

    What many classes share is met in lots: the second side's rows are dealt, and the first side's go to all lots.
    """
    half = lambda df, k: df.select("token", "lot", *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c not in ("token", "lot", "classes")])
    lots = F.floor(F.col("classes") / lot)
    everywhere = first.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), lots)))
    dealt = second.withColumn("lot", F.pmod("cls", lots + 1))
    return half(everywhere, "a").join(half(dealt, "b"), ["token", "lot"]).filter("cls_a < cls_b")


def promising(met: DataFrame) -> DataFrame:
    """(a, b, met) of the pairs in rows (token, cls_a, n_a, need_a, place_a, cls_b, ...) that may be similar enough.

    Sets of n_a and n_b tokens link with an overlap of o at least. Of n_a - o + l and n_b - o + l first tokens they
    then share l: all that is shared and not met there is among the o - l tokens beyond the prefix that ends first.
    Where rows have sketches, these differ in at most n_a + n_b - 2 o cells.
    """
    alike = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    overlap = F.expr(f"({PERCENT} * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT}")
    least = F.least("need_a", "need_b").cast("long")
    within = (F.col("place_a") < F.col("n_a") - overlap + least) & (F.col("place_b") < F.col("n_b") - overlap + least)
    if "s0_a" in met.columns:
        apart = [F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(SKETCH)]
        within &= F.coalesce(sum(apart[1:], apart[0]), F.lit(0)) <= F.col("n_a") + F.col("n_b") - 2 * overlap
    pairs = met.filter(alike & within).groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.count("*").alias("met"), F.first(least).alias("least"))
    return pairs.filter("met >= least").select("a", "b", "met")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The sets are made again from the text of one document of each class."""
    pairs = scratch.put(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    members = scratch.put(classes.join(wanted, "cls", "left_semi").select("m.id", "m.th"), "members")
    few = members.count() <= BROADCAST_CLASSES
    chosen = docs.select("doc_id", "text").withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text"))
    sets = scratch.put(class_sets(chosen.join(F.broadcast(members) if few else members, ["id", "th"], "left_semi")), "sets")
    left, right = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    found = both.filter(100 * F.col("both") >= PERCENT * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b")
    found = scratch.put(found.distinct(), "links")
    scratch.drop(sets)
    return found


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, label) of each class with an edge: the smallest class that edges reach.

    Each round takes the smallest label of a class and its neighbours, then that label's own label, so that
    labels travel twice as far each round.
    """
    both = scratch.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.put(both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("cls").alias("b"), "label"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("m"))
        least = labels.join(near, "cls", "left").select("cls", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        up = labels.select(F.col("cls").alias("next"), F.col("label").alias("up"))
        best = F.least("next", F.coalesce("up", "next"))
        new = scratch.put(least.join(up, "next", "left").select("cls", best.alias("label"), (best != F.col("label")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = new
        if not labels.filter("moved").limit(1).count():
            return labels.select("cls", "label")


def link(docs: DataFrame, lot: int = LOT) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, th) of each document; component is a key that documents without words lack."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    classed = scratch.put(document_classes(docs), "classes")
    counts = token_counts(docs)
    # A row for each class: its smallest id, one document of it, and its sketch. Copies come together before they are exchanged.
    member = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "th")).alias("m")
    sketch = [F.first(f"s{k}").alias(f"s{k}") for k in range(SKETCH)]
    classes = scratch.put(classed.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), member, *sketch), "members")
    # Copies are dropped within a task already, so one exchange by token and lot does for both the classes and their count.
    listed = postings(docs, counts, lot=lot).repartition("token", "lot").groupBy("token", "lot", "lots", "cls").agg(*[F.first(c).alias(c) for c in ("n", "need", "place")])
    # A token that one class has joins nothing. What is left is a few hundredths of the postings.
    here = Window.partitionBy("token", "lot")
    listed = scratch.put(listed.withColumn("classes", F.count("*").over(here)).filter("classes > 1 OR lots > 1"), "postings")
    whole = listed.filter("lots = 1").drop("lot", "lots")
    parted = listed.filter("lots > 1").drop("lot", "lots", "classes")
    totals = scratch.put(parted.groupBy("token").agg(F.count("*").alias("classes")).filter("classes > 1"), "tokens")
    shared = scratch.put(whole.unionByName(parted.join(totals, "token")), "shared")
    scratch.drop(listed)
    sketches = classes.select("cls", *[f"s{k}" for k in range(SKETCH)])
    crowded = scratch.put(shared.filter(F.col("classes") >= CROWD).join(sketches, "cls"), "crowded")
    shared = shared.filter(F.col("classes") < CROWD).unionByName(crowded, allowMissingColumns=True)
    # First each class and the smallest classes of its tokens, where what they share there is enough already. Tasks send on no more than these of a token.
    nth = F.row_number().over(Window.partitionBy("token").orderBy("cls"))
    hubs = shared.withColumn("nth", nth).filter((F.col("nth") <= CROWD_HUBS) & ((F.col("nth") <= HUBS) | (F.col("classes") >= CROWD))).drop("nth")
    first = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("met"), "a"))
    near = promising(meeting(hubs, shared, lot)).withColumn("first", first).filter(F.col("first") <= HUBS).select("a", "b")
    edges = verified(near, docs, classes, scratch)
    labels = components(edges, scratch)
    # Then all candidates across components: tokens whose classes are of two components or more.
    labelled = scratch.put(shared.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    several = scratch.put(labelled.groupBy("token").agg((F.min("label") < F.max("label")).alias("several")).filter("several").select("token"), "several")
    crossing = scratch.put(labelled.join(several, "token", "left_semi"), "crossing")
    scratch.drop(labelled)
    rest = promising(meeting(crossing, crossing, lot).filter("label_a <> label_b")).select("a", "b")
    more = verified(rest, docs, classes, scratch)
    if more.limit(1).count():
        labels = components(edges.unionByName(more), scratch)
    mapped = classes.select("cls", "least").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mapped = scratch.put(mapped, "mapped")
    least = mapped.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = scratch.put(mapped.join(least, "label").select("cls", "component_id", F.col("label").alias("component")), "components")
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return classed.join(whole, "cls", "left").select("doc_id", "n_shingles", own.alias("component_id"), "component", "th")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, unchanged, with one of each component: that with the smallest id. Documents without words stay."""
    linked = Scratch(docs.sparkSession, "kept").put(link(docs), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("d")
    kept = linked.filter("component IS NOT NULL").groupBy("component").agg(first).select("d.doc_id", "d.th")
    whole = packed(docs, "doc_id", "text").withColumn("_th", F.xxhash64("text"))
    if linked.filter("component IS NOT NULL").groupBy("doc_id", "th").count().filter("count > 1").limit(1).count():  # repeated rows
        alone = F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy("_th")) == 1
        wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        whole = whole.withColumn("_first", alone).filter(F.col("_first") | wordless)
    wordless = linked.filter("component IS NULL").select("doc_id", "th").distinct()
    keys = kept.unionByName(wordless).select(F.col("doc_id").alias("_id"), F.col("th").alias("_kept"))
    rows = whole.join(keys.hint("merge"), F.expr("doc_id <=> _id AND _th = _kept"), "left_semi")
    return unpacked(rows, docs.columns, {"doc_id": F.col("doc_id"), "text": F.col("text")})
