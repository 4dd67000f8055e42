import random

import numpy as np
from pyspark.sql import functions as F

from gantline.llm import language

SYLLABLES = {"aa": ["ka", "ko", "mi", "ru", "to"], "bb": ["sch", "ein", "ung", "ver", "ß"], "cc": ["ção", "lh", "que", "dos", "é"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 80))), lang))
    return rows


def test_held_out_accuracy(spark, documents):
    rows = corpus(400)
    out = language.learn_and_identify(documents(rows)).collect()
    told = {i: lang for i, _, lang in rows}
    held = [r for r in out if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == told[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_defined_results(spark, documents):
    rows = corpus(200) + [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "aa"), (903, "kako miru", None), (None, "kako miru", None), (904, "kako miru " * 30_000, "aa"), (904, "kako miru " * 30_000, "aa")]
    out = language.learn_and_identify(documents(rows)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0
    assert got[903]["lang_pred"] == got[904]["lang_pred"] == "aa" and got[None]["held_out"] is False
    assert language.learn_and_identify(documents(rows).limit(0)).count() == 0
    none = language.learn_and_identify(documents(rows).withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_held_out_rows_are_never_learned_from(spark, documents):
    docs = documents(corpus(200))
    changed = docs.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    assert language.sample(docs) == language.sample(changed)


def test_convolution_is_a_sum_of_looked_up_rows():
    network = language.Network(["x", "y"], seed=2)
    rows = language.windows(bytes(range(60, 200)))
    pooled = network.pooled(rows)
    one_hot = np.eye(256, dtype=np.float32)[rows]
    at = 0
    for bank in network.banks:
        total = sum(one_hot[:, k : k + language.WINDOW] @ t for k, t in enumerate(bank))
        assert np.allclose(pooled[:, at : at + language.FILTERS], total.max(axis=1), atol=1e-4)
        at += language.FILTERS


def test_filter_keeps_columns(spark, documents):
    docs = documents(corpus(120) + [(900, "123", "aa"), (901, None, None)])
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 120


def test_rows_that_share_an_id_are_drawn_by_their_texts(spark, documents):
    rows = [(1, f"some words of text number {i}, in one language", "en") for i in range(60)] + [(2, f"und andere worte der nummer {i}, in einer sprache", "de") for i in range(60)]
    one, two = (language.sample(documents(r), per_language=10) for r in (rows, rows[::-1]))
    assert one == two and len(one) > 10
