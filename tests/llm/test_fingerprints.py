import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gantline.llm import fingerprints as P


def prose(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "one", "two", "three", "été"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "-"]) + str(rng.randint(0, 999)) + " " for _ in range(n))


def test_equality_and_likeness():
    rng = random.Random(3)
    for _ in range(60):
        a, b = prose(rng, rng.randint(40, 300)), prose(rng, rng.randint(40, 300))
        k = len(a) // 4
        edited = a[: len(a) - k] + b[:k]
        p, q, r = map(P.fingerprint, (a, edited, b))
        assert P.fingerprint(a) == p and p != q and P.likeness(p, p) == 1
        assert 0.4 < P.likeness(p, q) < 0.8 and P.likeness(p, r) < 0.2 and P.likeness(p, q) == P.likeness(q, p)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab \nwords."), st.characters(exclude_categories=["Cs"])), max_size=400), st.integers(1, 60))
def test_pieces_hold_all_characters_of_their_paragraph(text, times):
    text *= times
    paragraphs = text.split("\n")
    told = list(P.paragraph_leaves([x.encode() for x in paragraphs]))
    assert [sum(int(v[8:], 36) for v in x.split(".") if v) for x in told] == [len(x) for x in paragraphs]
    assert told == [P.leaves(x.encode())[0] for x in paragraphs]  # a paragraph's leaves are its own


def test_likeness_does_not_depend_on_the_place_of_an_edit():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900))
    print_ = P.fingerprint(text)
    at = [P.likeness(print_, P.fingerprint(text[:i] + "ZZZ" + text[i:])) for i in (0, 1, 40, 500, 2500, len(text))]
    assert min(at) > 0.97
    short = [P.likeness(P.fingerprint(text[i : i + 200]), P.fingerprint(text[i : i + 150] + text[3000 + i : 3050 + i])) for i in range(0, 2000, 100)]
    assert sum(short) / len(short) > 0.5 and P.likeness(P.fingerprint("word " * 5000), P.fingerprint("word " * 3750 + text[:6250])) > 0.5


def test_differing_branches():
    lines = [f"line {i} has a few words of its own" for i in range(40)]
    other = list(lines)
    other[17] = "this one was edited"
    places = P.differing(P.fingerprint("\n".join(lines)), P.fingerprint("\n".join(other)))
    flat = [(i, j) for i, s in enumerate(P.fingerprint("\n".join(lines)).partition(":")[2].split(",")) for j in range(len(s.split("|")))]
    assert (len(places), flat.index(places[0])) == (1, 17)
    assert P.differing(P.fingerprint("a"), P.fingerprint("a")) == []


def test_edits_against_brute_force(spark, documents):
    rng = random.Random(5)
    rows = [(i * 3, prose(rng, rng.randint(0, 40))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "x"), (1003, "words " * 60_000)]
    rng.shuffle(rows)
    out = {r["doc_id"]: r for r in P.edits(documents(rows)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(out) == len(rows)
    for n, (i, text) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        r = out[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == P.fingerprint(text) and r["edited_fingerprint"] == P.fingerprint(edited)
        assert r["near_edited"] == P.likeness(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == P.likeness(r["fingerprint"], P.fingerprint(after))


def test_repeated_rows_null_ids_and_few_rows(spark, documents):
    rows = [(None, "no id"), (1, "one text"), (1, "one text"), (2, "two text")]
    assert sorted(str(r["doc_id"]) for r in P.edits(documents(rows)).collect()) == ["1", "1", "2", "None"]
    (alone,) = P.edits(documents([(5, "abcdefgh")])).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert P.edits(documents(rows).limit(0)).count() == 0


def test_many_rows_of_one_id(spark, documents):
    """Rows of one id, and rows without any, stand in the order of their texts' hashes: each but the last is edited with the next one's beginning, and equal texts stand together."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 12)) for _ in range(60)] + ["the same words again " * 9] * 40
    rows = [(7, t) for t in texts] + [(None, t) for t in texts[:30]] + [(3, "before them"), (9, "after them")]
    rng.shuffle(rows)
    first, again = (sorted(P.edits(documents(r)).collect(), key=str) for r in (rows, rows[::-1]))
    assert first == again and len(first) == len(rows)
    counts = [sum(r["doc_id"] == i for r in first) for i in (7, None, 3, 9)]
    assert counts == [100, 30, 1, 1]
    prints = {P.fingerprint(t): t for _, t in rows}
    edits = {(hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest()) for a in prints.values() for b in prints.values()}
    assert all(prints[r["fingerprint"]] and r["edited_sha256"] in edits for r in first)
    same = [r for r in first if prints[r["fingerprint"]] == texts[-1]]
    assert sum(r["near_next"] == 1 for r in same) == 39  # all of the 40 but the last have an equal text next
