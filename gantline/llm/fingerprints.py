"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A text is cut into paragraphs at line ends, and each paragraph into pieces of some characters at places that the
bytes before them choose, so that an edit moves no cuts beyond its neighbourhood. Pieces are leaves;
a paragraph is the hash of its leaves, a section (a run of paragraphs, ended where a paragraph's hash says
so) of its paragraphs, the root of its sections. Equal roots are equal texts; ``differing`` walks down the
branches that differ and gives the edited places; ``likeness`` compares leaves by the characters they hold.

A fingerprint is written as ``root:leaf.leaf|leaf,leaf|...``: the root in hex, sections set apart by ``,``,
paragraphs by ``|``, leaves by ``.``, a leaf being 8 characters of hash and then its length in base 36.

Defined results: null is the empty text, with no leaves (two empty texts are alike, an empty and another
text are not); texts of any length are hashed whole; repeated rows get the same fingerprint; rows that share
a doc_id stand in the order of their texts' hashes; null ids come first; an empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import run_hashes

#: A piece ends where a hash of the last four bytes is 0 modulo this, so it has so many of them on average, wherever it stands.
PIECE = 12
#: Bytes of a piece, at most about.
MOST = 96
#: Paragraphs are hashed so many bytes at once; a longer one alone.
CHUNK_BYTES = 1 << 20
#: A section ends after a paragraph whose hash is 0 modulo this.
SECTION_PARAGRAPHS = 4
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _base36(n: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = DIGITS[d] + out
    return out or "0"


#: Most pieces are short.
SHORT = [_base36(n) for n in range(1000)]


LENGTHS = {name: n for n, name in enumerate(SHORT)}


def base36(n: int) -> str:
    return SHORT[n] if n < len(SHORT) else _base36(n)


def length(leaf: str) -> int:
    """The characters that a leaf holds."""
    name = leaf[8:]
    return LENGTHS[name] if name in LENGTHS else int(name, 36)


def leaves(block: bytes) -> list[str]:
    """The pieces of each paragraph of a block, each as hash and length, set apart by dots."""
    data = np.frombuffer(block, np.uint8)
    line = data == 10
    ends = line.copy()  # whether a piece ends with this byte
    ends[:-1] |= line[1:]
    ends[-1:] = True
    wide = data.astype(np.uint32)
    words = wide[3:] << np.uint32(24) | wide[2:-1] << np.uint32(16) | wide[1:-2] << np.uint32(8) | wide[:-3]  # the four bytes that end at each place
    chosen = (words * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(PIECE) == 0
    # Windows that reach into the paragraph before choose nothing, nor does a place inside a character.
    ends[3:] |= chosen & ~(line[3:] | line[2:-1] | line[1:-2] | line[:-3])
    if len(data) and int(data.max()) > 127:
        within = (data & 0xC0) == 0x80
        ends[:-1] &= ~within[1:]
        chars = np.concatenate([[0], np.cumsum(~within)])
    else:
        chars = None
    start = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(data) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(data)))
    if int(size.max(initial=0)) > MOST:  # words that repeat may choose no place for long
        parts = -(-size // MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * MOST
        if chars is not None:
            for _ in range(3):
                start += np.append(within, False)[np.minimum(start, len(data))]
            start = np.unique(start[start < len(data)])
    stop = np.append(start[1:], len(data))
    own = ~line[start]
    start, stop = start[own], stop[own]
    digits = (run_hashes(data, start, stop) >> np.uint64(32)).astype(">u4").tobytes().hex()
    sizes = (stop - start if chars is None else chars[stop] - chars[start]).tolist()
    names = [digits[8 * i : 8 * i + 8] + base36(n) for i, n in enumerate(sizes)]
    at = [0, *np.searchsorted(start, np.flatnonzero(line)).tolist(), len(names)]
    return [".".join(names[i:j]) for i, j in zip(at, at[1:])]


def paragraph_leaves(paragraphs: list[bytes]) -> Iterator[str]:
    i = 0
    while i < len(paragraphs):
        j, size = i + 1, len(paragraphs[i])
        while j < len(paragraphs) and size + len(paragraphs[j]) < CHUNK_BYTES:
            size += len(paragraphs[j]) + 1
            j += 1
        yield from leaves(b"\n".join(paragraphs[i:j]))
        i = j


def fingerprint(text: str | None) -> str:
    if not text:
        return hashlib.blake2b(b"", digest_size=16).hexdigest() + ":"
    sections: list[list[str]] = [[]]
    nodes: list[list[bytes]] = [[]]
    paragraphs = text.encode("utf-8", "surrogatepass").split(b"\n")
    for paragraph, line in zip(paragraphs, paragraph_leaves(paragraphs), strict=True):
        node = hashlib.blake2b(paragraph, digest_size=16).digest()
        sections[-1].append(line)
        nodes[-1].append(node)
        if node[0] % SECTION_PARAGRAPHS == 0:
            sections.append([])
            nodes.append([])
    if not sections[-1]:
        sections.pop()
        nodes.pop()
    root = hashlib.blake2b(b"".join(hashlib.blake2b(b"".join(s), digest_size=16).digest() for s in nodes), digest_size=16)
    return f"{root.hexdigest()}:{','.join(map('|'.join, sections))}"


def bag(print_: str) -> tuple[str, Counter, int]:
    """A fingerprint's root, its leaves and how often each, and the characters that they hold."""
    root, _, tree = print_.partition(":")
    leaves_ = Counter(tree.replace("|", ".").replace(",", ".").split("."))
    del leaves_[""]
    return root, leaves_, sum(length(v) * n for v, n in leaves_.items())


def shared(a: tuple[str, Counter, int], b: tuple[str, Counter, int]) -> float:
    (root, p, m), (other, q, n) = a, b
    if root == other:
        return 1.0
    if len(p) > len(q):
        p, q = q, p
    both = sum(length(v) * min(n_, q[v]) for v, n_ in p.items() if v in q)
    return both / (m + n - both) if m + n else 0.0


def likeness(a: str, b: str) -> float:
    """Characters in leaves that both hold, as a share of those in either (0 to 1)."""
    return shared(bag(a), bag(b))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Places (section, paragraph) in a whose branch b doesn't hold; none where the roots agree."""
    (root, _, x), (other, _, y) = a.partition(":"), b.partition(":")
    if root == other:
        return []
    sections = Counter(y.split(","))
    paragraphs = Counter(y.replace(",", "|").split("|"))
    out = []
    for i, section in enumerate(x.split(",")):
        if sections[section] > 0:
            sections[section] -= 1
            continue
        for j, p in enumerate(section.split("|")):
            if paragraphs[p] > 0:
                paragraphs[p] -= 1
            else:
                out.append((i, j))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(docs: DataFrame) -> DataFrame:
    """Each text against itself with its last quarter taken from the next document's beginning, in the order of doc_id.

    Documents are dealt by ranges of doc_id, whose bounds are quantiles, and sorted in a range; the next of a
    range's last document is the first of the next range that has any, which comes along as a row of the range.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(plain.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)))  # as many as partitions
    # Null ids come first. Rows that share an id are one range's.
    rng = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("doc_id")))) if bounds else F.lit(0)
    keyed = plain.withColumn("rng", rng.cast("int"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    light = keyed.select("rng", "doc_id", F.xxhash64("text").alias("h"))
    heads = light.groupBy("rng").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "h", "doc_id")).alias("head"))
    around = Window.orderBy("rng")  # a row for each range
    first = F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("rng", F.coalesce(F.lead("head").over(around), first).alias("n")).select("rng", F.col("n.doc_id").alias("id"), F.col("n.h").alias("h"))
    heads = scratch.put(heads, "heads")
    text_of = keyed.withColumn("h", F.xxhash64("text")).alias("d").join(F.broadcast(heads).alias("n"), F.expr("d.doc_id <=> n.id AND d.h = n.h"))  # at most one row for each range
    guests = text_of.select("n.rng", "d.doc_id", "d.text", "d.h").dropDuplicates(["rng"]).withColumn("guest", F.lit(1))
    rows = keyed.withColumn("h", F.xxhash64("text")).select("rng", "doc_id", "text", "h", F.lit(0).alias("guest")).unionByName(guests)
    dealt = rows.repartitionByRange(len(bounds) + 1, "rng").sortWithinPartitions("rng", "guest", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next one: range, id, text, fingerprint and its leaves
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [part.split(" ")[0] for part in EDITS.split(", ")]
        for batch in batches:
            out = []
            for r, doc_id, text, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                own = fingerprint(text)
                own_bag = bag(own)
                if held and held[0] == r:
                    _, before_id, before, of_before, before_bag = held
                    k = len(before) // 4
                    edited = before[: len(before) - k] + text[:k]
                    of_edited = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before_id, len(before), sha, of_before, of_edited, shared(before_bag, bag(of_edited)), shared(before_bag, own_bag)))
                held = None if guest else (r, doc_id, text, own, own_bag)
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.select("rng", "doc_id", "text", "guest").mapInArrow(run, EDITS)
