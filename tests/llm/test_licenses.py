import random
import re

from gantline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(text):
    tokens = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(tokens) - len(p) + 1) if tokens[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_agree_with_brute_force():
    automaton = licenses.Automaton(licenses.TEMPLATES, licenses.BASE)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["GNU General Public License", "cc", "BY", "mit license", "zz", "Éa", "x1", "cc by cc by"]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(vocabulary) + rng.choice(" -\n_%/") for _ in range(rng.randint(0, 30)))
        r = licenses.scan_words(automaton, licenses.words(text))
        n, places, first, last, base = brute(text)
        assert (r["n_words"], len(r["places"]), min(r["places"], default=None), max(r["places"], default=None), ",".join(sorted(r["base"]))) == (n, places, first, last, base)


def test_matching_statistics_agree_with_brute_force():
    templates = [("a", "x y z x y w"), ("b", "y z q x y")]
    automaton = licenses.Automaton(templates, {"x y": "xy"})
    runs = {tuple(t.split()[i:j]) for _, t in templates for i in range(7) for j in range(i + 1, 8)}
    rng = random.Random(1)
    for _ in range(500):
        tokens = [rng.choice("xyzwqu") for _ in range(rng.randint(0, 20))]
        got = {i: n for i, n, _ in automaton.statistics([automaton.vocabulary.get(t.encode()) for t in tokens])}
        for i in range(len(tokens)):
            assert got.get(i, 0) == max((k for k in range(1, i + 2) if tuple(tokens[i + 1 - k : i + 1]) in runs), default=0)


def test_interrupted_template_is_chained():
    automaton = licenses.Automaton(licenses.TEMPLATES, licenses.BASE)
    r = licenses.scan_words(automaton, licenses.words("Redistribution and use in source and binary forms, with or without EDIT modification are permitted provided that the following conditions are met"))
    assert "bsd-grant" in r["labels"] and 0.8 <= r["score"] <= 1


def test_edge_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "under the CC-BY and the MIT License."), (3, "under the CC-BY and the MIT License."), (None, "Apache License"), (4, "word " * 200_000 + "gnu general public license")]
    out = sorted(map(tuple, licenses.scan(documents(rows)).drop("spans").collect()), key=str)
    assert len(out) == 6 and out.count((3, 8, 2, 2, 6, "cc-by,mit", "cc-by,mit", 1.0)) == 2
    assert (1, 0, 0, None, None, "", "", 0.0) in out and (2, 0, 0, None, None, "", "", 0.0) in out
    assert (4, 200_004, 1, 200_000, 200_000, "gpl", "gpl", 1.0) in out
    assert licenses.scan(documents(rows).limit(0)).count() == 0


def test_each_copy_has_a_span_of_its_own(spark, documents):
    bsd = "redistribution and use in source and binary forms with or without EDIT modification are permitted provided that the following conditions are met"
    stray = "under the terms of the contract " + "filler " * 500
    text = stray + bsd + " " + bsd + " more " * 300 + bsd + " all rights reserved all rights reserved"
    got = [tuple(s) for s in licenses.scan(documents([(1, text)])).first()["spans"]]
    one = len(bsd.split())
    starts = [506, 506 + one, 506 + 2 * one + 300]
    assert [x[:3] for x in got if x[0] == "bsd-grant"] == [("bsd-grant", s, s + one) for s in starts] and all(x[3] == 1 for x in got)
    end = starts[2] + one
    assert [x[1:3] for x in got if x[0] == "reserved"] == [(end, end + 3), (end + 3, end + 6)]
    gpl = dict(licenses.TEMPLATES)["gpl-notice"]
    found = licenses.scan(documents([(2, stray + gpl)])).first()["spans"]
    assert [s["start"] for s in found if s["label"] == "gpl-notice"] == [506]


def test_words_that_recur_in_a_template():
    automaton = licenses.Automaton([("twice", "one two three four five one two three six seven")], {})
    r = licenses.scan_words(automaton, licenses.words("one two three four five X one two three X six seven"))
    assert r["score"] == 0.8 and r["spans"] == [("twice", 0, 9, 0.8)]


def test_many_copies_are_found_in_one_go():
    automaton = licenses.Automaton(licenses.TEMPLATES, licenses.BASE)
    r = licenses.scan_words(automaton, licenses.words(dict(licenses.TEMPLATES)["as-is"] + " ") * 3000)
    assert len(r["spans"]) == 3000


def test_wording_of_other_templates_before_a_licence_does_not_hide_it():
    automaton = licenses.Automaton(licenses.TEMPLATES, licenses.BASE)
    for before in ("", "this work is ", "permission is hereby ", "this work is licensed under "):
        r = licenses.scan_words(automaton, licenses.words(before + "licensed under the foo Apache License, version 2.0"))
        n = len(before.split())
        assert ("apache-notice", n, n + 9, 1.0) in r["spans"]
    body = dict(licenses.TEMPLATES)["mit"]
    assert {"mit", "mit-grant"} <= licenses.scan_words(automaton, licenses.words("This work is. " + body.replace(" subject ", ", subject ").upper()))["labels"]


def test_every_template_is_told_all_its_runs(monkeypatch):
    told = {}
    monkeypatch.setattr(licenses, "copies", lambda runs, long: (told.update({len(told): sorted(runs)}), (0.0, []))[1])
    rng = random.Random(7)
    for _ in range(400):
        told.clear()
        templates = [(str(t), " ".join(rng.choice("abcd") for _ in range(rng.randint(2, 9)))) for t in range(4)]
        tokens = [rng.choice("abcde") for _ in range(rng.randint(0, 25))]
        licenses.scan_words(licenses.Automaton(templates, {}), licenses.words(" ".join(tokens)))
        want = []
        for _, template in templates:
            t = template.split()
            same = lambda i, j, t=t: 0 <= i < len(tokens) and 0 <= j < len(t) and tokens[i] == t[j]
            runs = []
            for i in range(len(tokens)):
                for j in range(len(t)):
                    if same(i, j) and not same(i - 1, j - 1):
                        n = next(n for n in range(1, 30) if not same(i + n, j + n))
                        if n >= min(licenses.LONG, len(t)):
                            runs.append((i, j, n))
            if runs:
                want.append(sorted(runs))
        assert sorted(told.values()) == sorted(want)
