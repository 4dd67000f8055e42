"""Best-fit packing of documents into sequences, with certified bin counts.

Documents are tokenized once; one over ``room`` tokens is cut into pieces of ``room`` with the shorter
piece first, so all other pieces fill a sequence by themselves. The rest are dealt by hash into groups
of a bounded size and packed best-fit decreasing. A group's count of sequences is certified when it
equals a lower bound from dual feasible functions. A group with a gap gives up the pieces of all sequences
that aren't full, a certified one those of its emptiest alone; these are dealt anew, into fewer groups, and
packed again. Once an exchange doesn't lower the count, all groups give up only their emptiest, until one
group holds what is left. A packing that takes more sequences than the one before it is dropped.

Defined results: null text is empty and packs as the end-of-document id alone; repeated rows and
copies are documents of their own; a null doc_id stays null; an empty table gives an empty one. Texts
of any length are tokenized whole. Other columns are ignored.
"""

from __future__ import annotations

import array
import base64
import functools
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROOM = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
#: Pieces that one task packs; the memory of a task follows it, whatever the corpus.
GROUP_PIECES = 100_000
#: Sequences that a certified group gives up, the emptiest, and at most half of its own.
EMPTIEST = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What the vocabulary's pattern comes to where no two white space characters meet; without its look-ahead it is read twice as fast.
APART = r"'(?:[stmd]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
#: White space other than the space and the line end. Texts that hold it take the full pattern.
ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def _encoders(vocabulary: str):
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    with open(public.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast, general = (tiktoken.Encoding(vocabulary, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (APART, public.PATTERN))
    return fast.encode_ordinary, general.encode_ordinary, Tokenizer.from_file(public.path(f"{vocabulary}.json"))


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers, the same as those of the vocabulary's tokenizer file."""
    if not text:
        return b""
    fast, general, full = _encoders(vocabulary)
    if "<|" in text:  # it may hold a special token
        ids = full.encode(text, add_special_tokens=False).ids
    elif any(x in text for x in ("  ", "\n\n", "\n ", " \n")) or any(c in text for c in ODD_SPACES):
        ids = general(text)
    else:
        ids = fast(text)
    return array.array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def cut(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a shorter first."""
    first = (n - 1) % room + 1
    return [(0, first), *((s, room) for s in range(first, n, room))]


def pieces(docs: DataFrame, room: int = ROOM, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), vocabulary) + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, room)):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id, i, start, length, zlib.crc32(part), part)[: 5 + with_ids])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True)) or [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def bound(counts: np.ndarray, room: int) -> int:
    """A lower bound of the bins for counts[s] pieces of size s, from two families of dual feasible functions.

    The first rounds sizes over room - k up to a full bin and leaves out those under k; the second counts
    in units of room / m, rounding up what isn't a whole number of units (in integers: floor((m+1) s / room) / m).
    """
    sizes = np.arange(room + 1, dtype=np.int64)
    words = counts * sizes
    number, total = np.cumsum(counts), np.cumsum(words)
    best = -(-int(total[-1]) // room)
    for k in range(1, room // 2 + 1):  # sizes over room - k count as a bin, those from k on as they are
        big = int(number[-1] - number[room - k])
        best = max(best, big + -(-int(total[room - k] - total[k - 1]) // room))
    for m in range(1, 101):
        scaled = (m + 1) * sizes
        value = np.where(scaled % room == 0, m * sizes / room, scaled // room)
        best = max(best, int(np.ceil(float((counts * value).sum()) / m - 1e-9)))
    return best


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, best-fit decreasing, and the space left in each bin.

    Open bins stand in stacks by space left; one bit each tells which stacks hold any.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    open_bits, left = 0, []
    for i in order.tolist():
        size = int(lengths[i])
        fitting = open_bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = stacks[space].pop()
            if not stacks[space]:
                open_bits &= ~(1 << space)
        else:
            at, space = len(left), room
            left.append(room)
        bins[i], offsets[i] = at, room - space
        left[at] = space - size
        if left[at]:
            stacks[left[at]].append(at)
            open_bits |= 1 << left[at]
    return bins, offsets, left


PACKED = "rid long, grp int, length long, bin long, offset long, certified boolean, rest int"


def _packer(room: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One group. ``rest`` is 0 for pieces of full bins, 2 for those of the emptiest, else 1."""
        pdf = pdf.sort_values(["length", "rid"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, left = best_fit(lengths, room)
        space = np.array(left)
        rest = (space > 0).astype(np.int32)
        emptiest = np.argsort(-space, kind="stable")[: min(EMPTIEST, len(space) // 2)]
        rest[emptiest] *= 2
        certified = len(left) <= bound(np.bincount(lengths, minlength=room + 1), room)
        return pdf.assign(bin=bins, offset=offsets, certified=certified, rest=rest[bins])[["rid", "grp", "length", "bin", "offset", "certified", "rest"]]

    return run


def pack(cut_pieces: DataFrame, room: int = ROOM, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to rows that have a length of 1 to ``room``."""
    spark = cut_pieces.sparkSession
    scratch = Scratch(spark, "packing")
    numbered = scratch.put(cut_pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    placed = [numbered.filter(F.col("length") == room).select("rid", F.lit(0).cast("long").alias("offset"), F.col("rid").alias("sequence_id"))]
    todo, before, fewest, settled, turn = numbered.filter(F.col("length") < room).select("rid", "length"), None, 0, False, 0
    while True:
        turn += 1
        groups = max(1, -(-todo.count() // group_pieces))
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(groups)).cast("int"))
        out = scratch.put(dealt.groupBy("grp").applyInPandas(_packer(room), PACKED), "packed")
        out = out.withColumn("sequence_id", F.expr(f"{turn}L * {1 << 56}L + grp * {1 << 28}L + bin"))
        count = out.select("sequence_id").distinct().count()
        if before is not None and count >= fewest:
            settled, out = True, before if count > fewest else out
        given = F.lit(False) if groups == 1 else F.col("rest") > F.when(F.col("certified") | F.lit(settled), 1).otherwise(0)
        placed.append(out.filter(~given).select("rid", "offset", "sequence_id"))
        if groups == 1:
            break
        before = out.filter(given)
        fewest, todo = before.select("sequence_id").distinct().count(), before.select("rid", "length")
    whole = placed[0]
    for p in placed[1:]:
        whole = whole.unionByName(p)
    return numbered.join(whole, "rid").drop("rid")


def pack_documents(docs: DataFrame, room: int = ROOM, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece."""
    return pack(pieces(docs, room, vocabulary, with_ids), room)
