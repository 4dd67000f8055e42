from collections import defaultdict

from gantline.llm import line_dedup


def brute(rows, sites):
    seen = defaultdict(set)
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            seen[line.strip(line_dedup.WHITE)].add(source)
    gone = {x for x, s in seen.items() if x and len(s) >= sites}
    out = []
    for i, text, _, _ in rows:
        parts = text.split("\n") if text is not None else []
        kept = [p for p in parts if p.strip(line_dedup.WHITE) not in gone]
        out.append((i, None if text is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def cleaned(docs, **more):
    return sorted(map(tuple, line_dedup.clean(docs, **more).select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)


def test_against_brute_force(spark, documents):
    rows = [(i, f"first {i}\nAll rights reserved.\nbody {i} text\n\n Subscribe! \nlast {i}" if i % 3 else f"own {i}\nrare line", "en", f"s{i % 15}") for i in range(60)]
    rows += [(100 + i, f"text {i}\nBy staying you agree to it.\nRead our policy for more.\n  It is short.\nThank you.", "en", f"t{i}") for i in range(40)]  # a notice of four lines
    rows += [(200 + i, f"many sites {i % 9}\nnine sites\nten sites" if i < 90 else "ten sites", "en", f"u{i % 9}" if i < 90 else "u9") for i in range(91)]
    rows += [(300, None, None, None), (301, "", "en", None), (302, "All rights reserved.", "en", "s1"), (302, "All rights reserved.", "en", "s1"), (None, "x\nSubscribe!", "en", "s2"), (303, "tail\n" * 50_000 + "All rights reserved.", "en", "s3")]
    rows += [(400 + i, "seen on nine and none", "en", f"s{i}" if i else None) for i in range(10)]  # a null site is a site
    got, want = cleaned(documents(rows)), brute(rows, line_dedup.SITES)
    assert got == want
    by_id = {r[0]: r for r in got}
    assert all(by_id[100 + i][1:] == (f"text {i}", 5, 4) for i in range(40)) and "nine sites" in by_id[200][1] and "ten sites" not in by_id[200][1]
    assert all(by_id[400 + i][3] == 1 for i in range(10))


def test_near_the_threshold_sites_are_counted_exactly(spark, documents):
    rows = [(1000 * n + i, f"{n} {i}\nline on {n}", "en", f"s{i}") for n in (8, 9, 10, 11, 12) for i in range(n)] + [(90_000 + i, "line on 9", "en", "s0") for i in range(200)]
    assert cleaned(documents(rows)) == brute(rows, 10)
    assert cleaned(documents(rows), sites=9) == brute(rows, 9)


def test_columns_and_empty_table(spark, documents):
    docs = documents([(1, "a")])
    assert line_dedup.clean(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert line_dedup.clean(docs.limit(0)).count() == 0


def test_copies_of_a_text_may_count_once(spark, documents):
    rows = [(i, f"body {i}\nfoot one\nfoot two\nfoot three", "en", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, f"own {i}\nShare this", "en", f"s{i % 12}") for i in range(24)]
    rows += [(200 + i, "copied one\nShare this\ncopied two", "en", f"s{i % 12}") for i in range(300)]  # one text on all sites
    rows += [(600 + i, f"near {i}\nnine sites", "en", f"s{i % 9}") for i in range(27)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.clean(documents(rows), once=True).collect()}
    assert all(got[i] == (f"body {i}", 3) for i in range(24)) and all(got[100 + i] == (f"own {i}", 1) for i in range(24))
    assert all(got[200 + i] == ("copied one\ncopied two", 1) for i in range(300)) and all(got[600 + i][1] == 0 for i in range(27))


def test_pipeline_takes_whole_blocks_of_boilerplate(spark, documents):
    import corpus_pipeline

    docs = documents([(i, f"body {i}\nfoot one\nfoot two", "en", f"s{i % 12}") for i in range(60)])
    assert {r["text"] for r in corpus_pipeline.without_boilerplate(spark, docs, "").collect()} == {f"body {i}" for i in range(60)}


def test_white_space_around_lines(spark, documents):
    ends = ["", "\r", "\t", " \u00a0", "\u3000\r", "\x0b"]
    rows = [(i, f"body {i}{ends[i % 6]}\n{ends[(i + 1) % 6]}All rights reserved, as ever.{ends[i % 6]}\ntail {i}", "en", f"s{i}") for i in range(18)]
    got = cleaned(documents(rows))
    assert got == brute(rows, 10)
    assert got[0][1] == "body 0\ntail 0" and all(r[3] == 1 for r in got)


def test_the_sql_trims_alike(spark, documents):
    import duckdb

    from gantline.llm.queries import ORACLE_SQL

    space = line_dedup.WHITE
    rows = [(i, f"{space[i % len(space)]}one line{space[(i + 5) % len(space)]}\nown {i}\u200b\n\u200bzero", "en", f"s{i % 12}") for i in range(36)]
    docs = documents(rows)
    table = docs.select("doc_id", "text", "source").toArrow()
    duck = duckdb.connect()
    duck.register("documents", table)
    assert sorted(duck.execute(ORACLE_SQL["op3_line_dedup"]).fetchall(), key=str) == cleaned(docs) == brute(rows, 10)
