import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gantline.llm import packing

FULL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(list(" \n\t\r'sdtrelvm.,!?aé1日") + ["<|endoftext|>", "\xa0", "  ", "\n\n"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_ids_are_the_tokenizers(text):
    assert packing.token_ids(text) == np.array(FULL.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bound_never_exceeds_an_optimum_and_bins_hold():
    rng = random.Random(3)
    for _ in range(60):
        room = 20
        lengths = np.array([rng.randint(1, room) for _ in range(rng.randint(1, 9))])
        bins, offsets, left = packing.best_fit(lengths, room)
        for b in range(len(left)):
            spans = sorted((offsets[i], offsets[i] + lengths[i]) for i in range(len(lengths)) if bins[i] == b)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == room - left[b]
        best = optimum(sorted(lengths.tolist(), reverse=True), room)
        assert packing.bound(np.bincount(lengths, minlength=room + 1), room) <= best <= len(left)


def optimum(items, room):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= room:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_every_token_comes_back(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "été", "x", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (201, ""), (None, "none"), (202, "long word " * 700)]
    room = 64
    out = packing.pack_documents(documents(rows), room, with_ids=True).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault((r["doc_id"], r["piece"], r["start"]), []).append(r)
        assert r["length"] == len(r["ids"]) // 4 <= room and r["ids_crc32"] == zlib.crc32(r["ids"])
    for doc_id, text in rows:
        want = packing.token_ids(text) + bytes(4)
        n = len(want) // 4
        for i, (start, length) in enumerate(packing.cut(n, room)):
            assert bytes(by_doc[(doc_id, i, start)][0]["ids"]) == want[4 * start : 4 * (start + length)]
    assert len(by_doc[(201, 0, 0)]) == 2
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= room
    least = -(-sum(r["length"] for r in out) // room)
    assert least <= len(sequences) <= least + 2


def test_groups_exchange_what_does_not_fit(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randint(1, 40)) for i in range(900)], "doc_id long, length long")
    out = packing.pack(df, 64, group_pieces=100).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in out)
    assert max(r[1] for r in out) <= 64 and len(out) <= -(-total // 64) + 2


def test_groups_reach_what_one_group_reaches(spark):
    rng = random.Random(4)
    for lengths in ([rng.choice([3, 5, 8, 21, 34, 40]) for _ in range(1200)], [rng.randint(33, 63) for _ in range(500)], [rng.choice([22, 23, 11]) for _ in range(700)]):
        df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
        count = lambda n: packing.pack(df, 64, group_pieces=n).select("sequence_id").distinct().count()  # noqa: B023, E731
        assert packing.bound(np.bincount(lengths, minlength=65), 64) <= count(150) <= count(10_000) + 1
    df = spark.createDataFrame([(i, 40) for i in range(50)], "doc_id long, length long")
    assert packing.pack(df, 64, group_pieces=1).select("sequence_id").distinct().count() == 50


def test_empty_table(spark, documents):
    assert packing.pack_documents(documents([(1, "x")]).limit(0)).count() == 0
