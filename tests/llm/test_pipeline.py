import random

import corpus_pipeline
from gantline.llm import packing


def test_stages_keep_clean_documents_and_one_of_each(spark, tmp_path):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ta", "no", "se", "vi", "pa")]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)) for _ in range(60)]
    rows = [(i, t, "aa", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + " more", "aa", f"s{i % 4}", 9) for i in range(10)] + [(200, None, None, None, None), (201, "12 34", "aa", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append(sorted(r[0] for r in docs.select("doc_id").collect()))
    assert kept[0] == kept[1] == [*range(60), *range(100, 110)] and kept[2] == [*range(60)]
    assert set(kept[3]) <= set(kept[2])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in whole if r["piece"] == 0) == kept[3]
    want = sum(len(packing.token_ids(texts[i])) // 4 + 1 for i in kept[3])
    assert sum(r["length"] for r in whole) == want


def test_empty_table_and_a_very_long_text(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rng = random.Random(3)
    long = " ".join(rng.choice(["kato", "lose", "miva", "rupa"]) + str(i % 50_000) for i in range(200_000))
    spark.createDataFrame([(1, long, "aa", "s", 1), (2, long + " end", "aa", "s", 1), (3, "kato lose miva rupa of another kind", "aa", "s", 1)], schema).write.parquet(str(tmp_path / "long" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "long")).collect()
    assert {r["doc_id"] for r in out} <= {1, 3} and sum(r["length"] for r in out if r["doc_id"] == 1) % (len(packing.token_ids(long)) // 4 + 1) == 0
