import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gantline.llm import html_text as H

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a>Menu two</a></li></ul></nav>"
    "<!-- ad --><div class=\"ad\">Buy now, today. Yes, you.</div><article><h1>Head &amp; more</h1><p><b>First   bold\nword, and some text.<br><p>Second &eacute;t&#233;, longer text. With marks; many.</p>"
    "<p>See <a href='#'>this link</a> too.</p></article><section class='comments'><p>I like it, really. Me too, and so on!</p></section><footer>&copy; Foot. Text, here.</footer></body></html>"
)


def test_article_without_furniture():
    assert H.main_text(PAGE) == "Head & more\nFirst bold word, and some text.\nSecond été, longer text. With marks; many.\nSee this link too."


def test_page_without_article():
    page = (
        "<body><header>Site, name. Here.</header><div id='menu'><a>One</a><a>Two</a></div><div class='post'><h2>Title</h2><p>A first paragraph, with text. And more, of it.</p><p>Short.</p><ul><li>item one<li>item two</ul>"
        "<form><label>Name</label><input></form></div><aside>Aside, text. More.</aside><div class='comment-list'><p>Comment, one. Two.</p></div>"
    )
    assert H.main_text(page) == "Title\nA first paragraph, with text. And more, of it.\nShort.\nitem one\nitem two"


def test_broken_markup():
    assert H.main_text("<article><p>cut off, in a <b>tag <a hre") == "cut off, in a tag"
    assert H.main_text("plain text, no tags. Yes") == "plain text, no tags. Yes"
    assert H.main_text("<p>a &am b &lt; c</p>") == "a &am b < c"
    for empty in (None, "", "<html></html>", "<nav>menu</nav>", "   "):
        assert H.main_text(empty) == ""


def test_rows(spark):
    long = "<article>" + "<p>some words, here.</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", long, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(map(tuple, H.extract(df).collect()), key=str)
    assert len(out) == 5 and (None, None, "", 0) in out and (2, "v", "", 0) in out
    assert next(r for r in out if r[0] == 3)[2] == "\n".join(["some words, here."] * 20_000)
    assert all(r[3] == len(r[2]) for r in out) and H.extract(df.limit(0)).count() == 0


def test_words_of_wrappers_do_not_lose_the_article():
    text = "A first paragraph, with text. And more, of it.\nA second one, longer. With marks; many, many of them."
    body = "".join(f"<p>{x}</p>" for x in text.split("\n"))
    aside = "<div class='note'><p>Short, other.</p></div>"
    for words in ("site has-sidebar", "layout no-sidebar", "wrapper header-fixed", "post comments-open", "search-results", "search", "share widget"):
        assert H.main_text(f"<body><nav><a>Home</a></nav><div class='{words}'><div class='post'>{body}</div></div><footer>Foot, here.</footer>") == text
        assert text in H.main_text(f"<body><div class='{words}'><div class='post'>{body}</div></div>{aside}")
    halves = "".join(f"<div class='post comments-open'><p>{x}</p></div>" for x in text.split("\n"))
    assert H.main_text(f"<body>{halves}") == text
    assert H.main_text("<body><div class='widget'><p>All there is, here.</p></div><div class='promo'><p>And this, too. Yes.</p></div>") == "All there is, here.\nAnd this, too. Yes."


def test_words_of_furniture_still_count():
    body = "<p>A first paragraph, with text. And more, of it.</p><p>A second one, longer. With marks; many, many of them.</p>"
    for words in ("site-footer", "left-sidebar", "comment-list", "nav_menu", "cookie-notice", "related-posts", "footer-1"):
        assert "Other" not in H.main_text(f"<body><div class='post'>{body}</div><div class='{words}'><p>Other, text. Here.</p></div>")


def test_a_long_advertisement_beside_a_short_article():
    assert H.main_text("<body><div class='ad'>Long, long advertisement. With marks; many of them.</div><article><h1>Head.</h1><p>Short.</article>") == "Head.\nShort."


BODY = "<p>A first paragraph, with text. And more, of it.</p><p>A second one, longer. With marks; many, many of them.</p>"
TEXT = "A first paragraph, with text. And more, of it.\nA second one, longer. With marks; many, many of them."


def test_a_form_or_hinted_wrapper_of_the_article_stays():
    for wrapper in ("<form id=aspnetForm>", "<div class='content-header'>", "<form class='search'><div id=content-header>", "<div class='widget'><form><section class=comments>"):
        assert H.main_text(f"<body><nav><a>Home</a></nav>{wrapper}<div>{BODY}</div>") == TEXT
        assert H.main_text(f"<body>{wrapper}<article>{BODY}</article><form><label>Your name, here.</label></form><div class=sidebar><p>Other, text. Much of it; long, too.</p></div>") == TEXT
    assert H.main_text(f"<body><form><div>{BODY}</div><div class='comments'><p>I, too. Like it!</p></div><footer>Foot, here.</footer></form>") == TEXT


def test_comments_and_sidebars_beside_the_article_go_however_long_they_are():
    short = "<div class='post'><h2>Title</h2><p>One short paragraph, here.</p><p>Another one.</p><p>And a third.</p></div>"
    one = "<div class='post'><p>" + "A single paragraph, of some length. " * 6 + "</p></div>"
    other = "<p>I like it, really; very much so. Me too, and so on, and on!</p>"
    for words in ("comments", "sidebar", "comment-list", "related-posts"):
        for many in (1, 12, 200):
            assert H.main_text(f"<body>{short}<div class='{words}'>{other * many}</div>") == "Title\nOne short paragraph, here.\nAnother one.\nAnd a third."
            assert "I like" not in H.main_text(f"<body><div class='{words}'>{other * many}</div>{one}")
            assert "I like" not in H.main_text(f"<body><form>{short}<div class='{words}'>{other * many}</div></form>")
    wrapped = f"<div class='content sidebar'><h1>Title</h1>{BODY * 4}</div>"  # a wrapper with a furniture word, and some text of the site beside it
    for around in ("<p>Site, slogan.</p>", "<p>Site, slogan.</p><p>Call us, now. Or write.</p>"):
        assert H.main_text(f"<body>{around}{wrapped}").count("A first paragraph") == 4


def test_a_page_without_a_body_keeps_its_heading():
    prose = "Very long, very long prose; it goes on, and on: with marks, of all kinds! " * 8
    assert H.main_text(f"<h1>T</h1><p>{prose}</p><p>{prose}</p><p>x</p>").startswith("T\nVery")


def test_what_an_article_keeps():
    article = lambda x: H.main_text(f"<body><nav>x</nav><article>{BODY}{x}</article>").removeprefix(TEXT + "\n")
    assert article("<div class='search results'><p>The results, in short. They are good; very, very good.</p></div>") == "The results, in short. They are good; very, very good."
    assert article("<ul><li><a href=#>one link</a><li>item two</ul>") == "one link\nitem two"
    assert article("<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, it is.</p>") == "Where x=2 holds, it is."
    assert article("<h2 id='related'>Related</h2><p>Work, of others.</p>") == "Related\nWork, of others."
    assert article("<pre>a = 1 <span class='comment'># one</span></pre>") == "a = 1 # one"
    assert article("<form><label>Name, please.</label></form><div class='share'>Share, now.</div><section class='comments'><p>I, too. Like it!</p></section>") == TEXT


def test_quotes_outside_of_values_end_no_text():
    assert H.main_text("<article><p title=it's>One, text.</p><p alt=\"a>b\" x='c>d'>Two, more.</p><p =\">Three, yes.</p></article>") == "One, text.\nTwo, more.\nThree, yes."


@pytest.mark.parametrize("tag", ["<div>x, y. ", "<b>x, y. ", "<p><i>", "<title>", "</b><b>", "<ul><li>x", "<form>some, text. ", "<br> ", "<table><tr><td>", "<a href=\"x>"])
def test_time_follows_length_not_depth(tag):
    began = time.process_time()
    H.main_text(tag * 100_000)
    assert time.process_time() - began < 30


def plain(source):
    """(block, elements from the root, text) of each text node, by looking through all open elements at each tag; an element is [name, attributes, order]."""
    out, stack, block, order, at = [], [["", "", 0]], 0, 0, 0

    def pop(place):
        nonlocal block
        while len(stack) > place:
            block += stack.pop()[0] in H.BLOCK

    def space():
        if out and out[-1][0] == block and not out[-1][2][-1:].isspace():
            out[-1][2] += " "

    def scope():
        return max(i for i, e in enumerate(stack) if e[0] in H.SCOPES or not i)

    def last(name):
        return max((i for i, e in enumerate(stack) if e[0] == name), default=0)

    while at < len(source):
        m = H.TOKEN.search(source, at)
        part = source[at : m.start() if m else len(source)]
        if part.strip():
            out.append([block, [tuple(e) for e in stack], H.html.unescape(part)])
        elif part:
            space()
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if name and m[1]:
            k = last(name)
            if k and (name not in H.INLINE or not any(e[0] in H.BLOCK for e in stack[k:])):
                pop(k)
            elif name == "p":
                block += 1
        elif name:
            if name in H.BLOCK:
                block += 1
                for other in ("p", *H.CLOSES.get(name, ())):
                    while last(other) > scope():
                        pop(last(other))
            elif name == "br":
                space()
            if name not in H.VOID and (name in H.BLOCK or not m[3].rstrip().endswith("/")):
                order += 1
                stack.append([name, m[3], order])
            if name in H.RAW:
                close = H.re.search(rf"</{name}[\s/>]", source[at:], H.re.I)
                at = at + close.start() if close else len(source) if name in ("script", "style") else at
    return out


def slow_main_text(source):
    """The method, told by whole lists of the elements around each text."""
    words = lambda e: " ".join((h[0].strip("\"'") if h[0] else h[1]) for h in H.HINTED.findall(e[1]))

    def running(around):
        return bool(around) and (around[-1][0] in H.RUNNING or around[-1][0] in H.INLINE and running(around[:-1]))

    def hint(around):
        e = around[-1]
        exempt = e[0] in ("html", "body", "article", "main") or e[0] in H.HEADINGS or e[0] in H.INLINE and running(around[:-1])
        return "" if exempt else H.hinted(words(e))

    chain = lambda around: [around[: i + 1] for i in range(1, len(around))]
    main = lambda around: any(e[0] in H.MAIN for e in around)
    linked = lambda around: any(e[0] == "a" for e in around)
    suspects = lambda around: [c[-1][2] for c in chain(around) if c[-1][0] == "form" or hint(c) in H.STRONG]
    weak = lambda around: any(hint(c) in H.WEAK for c in chain(around))

    def off(around):
        for c in chain(around):
            e = c[-1]
            if e[0] in H.UNSHOWN or e[0] in H.FURNITURE and not (e[0] == "header" and main(c[:-1])) or e[0] not in ("html", "body", "article", "main") and "hidden" in words(e).split():
                return True
        return False

    nodes = [n for n in plain(source) if not off(n[1])]
    key = lambda a: ("/".join(e[0] for e in a if e[0] not in H.INLINE), bool(suspects(a)), weak(a))
    keys = [key(a) for _, a, _ in nodes]
    of = {k: [n for n, x in zip(nodes, keys, strict=True) if x == k] for k in set(keys)}
    size = lambda k: sum(len(t) for _, _, t in of[k])
    share = lambda k: sum(len(t) for _, a, t in of[k] if linked(a)) / size(k)
    chars = H.smooth([size(k) / len(of[k]) for k in keys])
    marks = H.smooth([(sum(c in H.PUNCTUATION for _, _, t in of[k] for c in t) + 1) / len(of[k]) for k in keys])
    scores = [c * p * ((1 - share(k)) * (H.WEAKENED if k[2] else 1)) for k, c, p in zip(keys, chars, marks, strict=True)]

    def content_of(which):
        by = {k: [scores[i] for i in which if keys[i] == k] for k in {keys[i] for i in which}}
        mean = {k: sum(v) / len(v) for k, v in by.items()}
        return {k for k, v in mean.items() if v > 0 and v >= min(sum(mean.values()) / len(mean), H.THRESHOLD * max(mean.values()))}

    high = content_of(range(len(nodes)))
    mass = [len(t) * (k in high and not linked(a)) for (_, a, t), k in zip(nodes, keys, strict=True)]
    prose = [not (linked(a) or weak(a) or a[-1][0] in H.HEADINGS) and any(p in t for p in H.PUNCTUATION) for _, a, t in nodes]
    if any(m and main(a) for (_, a, _), m in zip(nodes, mass, strict=True)):
        mass = [m * main(a) for (_, a, _), m in zip(nodes, mass, strict=True)]
        prose = [p and main(a) for (_, a, _), p in zip(nodes, prose, strict=True)]
    gone = set()
    title = next((a[-1][2] for _, a, _ in nodes if a[-1][0] == "h1"), None)

    def keeps(place, depth):
        """The mass that suspect ``place``, the depth-th around its text, keeps; marks those in it that go."""
        mine = [(s, m) for (_, a, _), m in zip(nodes, mass, strict=True) for s in [[0, *suspects(a)]] if len(s) > depth and s[depth] == place]
        own = sum(m for s, m in mine if len(s) == depth + 1)
        inner = {x: keeps(x, depth + 1) for x in {s[depth + 1] for s, m in mine if len(s) > depth + 1}}
        whole = own + sum(inner.values())
        here = [(b, len(t)) for (b, a, t), p in zip(nodes, prose, strict=True) if p and len([0, *suspects(a)]) == depth + 1 and [0, *suspects(a)][depth] == place]
        told = len({b for b, _ in here}) >= H.PROSE_BLOCKS or sum(n for _, n in here) >= H.PROSE_CHARS
        titled = {x for _, a, _ in nodes if title is not None and title in [e[2] for e in a] for x in suspects(a)}
        stay = {x for x, m in inner.items() if m > H.WRAPS * whole and (not told or x in titled)} or (set(inner) if not own and whole and not told else set())
        gone.update(x for x, m in inner.items() if x not in stay or not m)
        return own + sum(inner[x] for x in stay)

    keeps(0, 0)
    left = [i for i, (_, a, _) in enumerate(nodes) if gone.isdisjoint(suspects(a))]
    content = content_of(left)
    held = lambda k: sum(len(nodes[i][2]) for i in left if keys[i] == k)
    links = lambda k: sum(len(nodes[i][2]) for i in left if keys[i] == k and linked(nodes[i][1]))
    order = list(dict.fromkeys(keys[i] for i in left))
    # Of equal paths any may be the best: each is tried.
    top = max((held(k) for k in content), default=0)
    answers = set()
    for best in [k for k in order if k in content and held(k) == top] or [None]:
        home = None
        if best is not None:
            around = [[e for e in nodes[i][1]] for i in left if keys[i] == best]
            common = [e for e in around[0] if all(e in a for a in around)]
            home = [e for e in common if e[0] not in H.INLINE][-1]
        kept = []
        for i in left:
            _, a, _ = nodes[i]
            beside = home in a and not weak(a) and (main(a[: a.index(home) + 1]) or 2 * links(keys[i]) < held(keys[i]))
            if keys[i] in content or beside or not content and main(a):
                kept.append(i)
        blocks = {}
        for i in kept:
            blocks.setdefault(nodes[i][0], []).append(nodes[i][2])
        lines = [" ".join("".join(x).split()) for x in blocks.values()]
        answers.add("\n".join(x for x in lines if x))
    return answers


TAGS = ["<div>", "</div>", "<div class='comments'>", "<div class=search>", "<form>", "</form>", "<p>", "</p>", "<article>", "</article>", "<nav>", "</nav>", "<ul>", "<li>", "</ul>", "<a href=x>", "</a>", "<b>", "</b>", "<br>"]
TAGS += ["<h1>", "</h1>", "<h2 id=related>", "</h2>", "<header>", "</header>", "<table>", "<tr>", "<td>", "</table>", "<script>", "</script>", "<span class='ad'>", "</span>", "<title>", "</title>", "<section class='share results'>", "</section>", "<p hidden>", "<body>", "<img/>"]
TEXTS = [" ", "a", "Very long, very long prose; it goes on, and on: with marks, of all kinds! " * 8, "Some words, here. And more; of them, yes!", "Short.", "menu entry", "Other text, long. With marks, too, of all kinds; see: it goes on, and on.", "\n", "&amp;x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TAGS), st.sampled_from(TEXTS)), max_size=40).map("".join))
def test_against_a_plain_tree(source):
    assert H.main_text(source) in slow_main_text(source)
