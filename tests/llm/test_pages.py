import itertools
import pickle
import random
import time

import pytest

from wardlight.llm import dom, wrapper


def page(i, body, notice="Fixed words on all pages", around="div class=c9"):
    return (f"<html><head><title>t</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header>"
            f"<div id='cookie-bar'>We use cookies</div><div class=wrap><{around}>{body}</{around.split()[0]}>"
            f"<div class=x1><b>{notice}</b></div><aside>side {i}</aside><ul class=z><li><a href=1>A{i}</a><li><a href=2>B{i}</a></ul>"
            f"</div><form>Name <input></form><section id=comments><p>user says {i}</section><footer>f</footer></body></html>")


def test_slots_of_a_host_and_declared_articles(spark):
    rows = [(i, f"https://a.example/{i}", page(i, f"<h1>Title {i}</h1><p>First &amp; para {i}<br>more<p>Second&nbsp;{i} <i>it</i>alic")) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", page(i, f"<h2>Head {i}</h2><ul class=q><li>one<li>two {i}</ul><p>x<script>no()</script>", around="article"))
             for i in range(12)]
    rows += [(200, None, "<p>alone"), (201, "no url", None), (202, "http://c.example", ""), (None, "http://c.example", "<div>c</div>"),
             (100, "http://b.example/0", rows[12][2]), (203, "http://c.example", "<div>" * 600 + "deep" + "</div>" * 600),
             (204, "http://c.example", "<p>" + "long &lt; " * 50_000)]
    frame = spark.createDataFrame([(*r, "k", "h", "t") for r in rows], "page_id long, url string, html string, key string, host string, template string")
    got = wrapper.extracted_text(frame).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[3] == "Title 3\nFirst & para 3 more\nSecond 3 italic"
    assert text[103] == "Head 3\none\ntwo 3\nx"
    assert text[200] == "alone" and text[201] == text[202] == "" and text[None] == "c" and text[203] == "deep"
    assert text[204] == ("long < " * 50_000).strip()
    assert wrapper.extracted_text(frame.limit(0)).collect() == []


@pytest.mark.parametrize("source,want", [
    ("<", "<"), ("<p", ""), ("<a title=\"x>y", "y"), ("<!-- open", ""), ("a &am b &amp c", "a &am b & c"), ("<script>x", ""),
    ("a < b > c", "a < b > c"), ("<article><header><h1>H</h1><i>by</i></header><p>q</article>z", "H\nq"),
    ("<p>a<p>b</p>c</b></div>", "a\nb\nc"), ("<div role=navigation>m</div><main>k<nav>n</nav></main>", "k"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<p hidden>h</p><p style='display: none'>g</p>v", "v")])
def test_odd_markup(source, want):
    assert wrapper.main_text(dom.parse(source)) == want


def brute_matching(a, b):
    """Most nodes paired, trying every increasing choice of children."""
    best = 0
    m, n = len(a[1]), len(b[1])
    for k in range(min(m, n) + 1):
        for left in itertools.combinations(range(m), k):
            for right in itertools.combinations(range(n), k):
                if all(a[1][i][0] == b[1][j][0] for i, j in zip(left, right)):
                    best = max(best, sum(brute_matching(a[1][i], b[1][j]) for i, j in zip(left, right)))
    return best + 1


def test_tree_matching_like_brute_force_and_merging_keeps_both():
    def grown(rng, depth):
        return rng.choice("abc"), tuple(grown(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0))

    def size(t):
        return 1 + sum(map(size, t[1]))
    for seed in range(80):
        rng = random.Random(seed)
        a, b = ("r", grown(rng, 2)[1]), ("r", grown(rng, 2)[1])
        assert dom.matched(a, b)[0] == brute_matching(a, b)
        both = dom.merged(a, b)
        assert dom.matched(a, both)[0] == size(a) and dom.matched(b, both)[0] == size(b)
        assert size(both) == size(a) + size(b) - dom.matched(a, b)[0]
        numbers = dom.numbered(both)
        assert len(dom.assign(both, numbers, a)) == size(a) and len(set(numbers.values())) == size(both)


def test_constant_words_beside_blocks_take_no_block_with_them(spark):
    rows = [(i, f"http://a.example/{i}", f"<html><body><a href=#c>Skip</a><div><p>Varying article {i} of many words</p></div></body></html>")
            for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", f"<article><div>By <i>staff</i><p>Text {i} of the day</p><br></div></article>") for i in range(6)]
    rows += [(20 + i, f"http://c.example/{i}", f"<body><div class=w>Our label<div><p>Body {i}</p></div><span><b>fixed</b><p>More {i}</p></span></div></body>")
             for i in range(6)]
    rows += [(30, "http://d.example/0", "<body><a href=#c>Skip</a><div><p>Only page of its host</p></div></body>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in wrapper.extracted_text(frame).collect()}
    assert text == {**{i: f"Varying article {i} of many words" for i in range(6)}, **{10 + i: f"Text {i} of the day" for i in range(6)},
                    **{20 + i: f"Body {i}\nMore {i}" for i in range(6)}, 30: "Only page of its host"}


def test_all_layouts_of_a_host_and_copies_counted_once(spark):
    def one(i, layout="w", words="Words"):
        return f"<body><div class={layout}><div class=k>Our fixed notice</div><div class=t><p>{words} {i} vary</p></div></div></body>"
    rows = [(i, f"http://a.example/{i}", one(i, "lay" + chr(97 + i % 25))) for i in range(125)]
    rows += [(1000 + i, f"http://b.example/{i}", one(i % 5)) for i in range(50)]
    rows += [(2000 + i, f"http://c.example/{i}", one(max(0, i - 45))) for i in range(51)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in wrapper.extracted_text(frame).collect()}
    assert text == {**{i: f"Words {i} vary" for i in range(125)}, **{1000 + i: f"Words {i % 5} vary" for i in range(50)},
                    **{2000 + i: f"Words {max(0, i - 45)} vary" for i in range(51)}}


def test_partial_merges_hold_every_shape(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "FAN", 2)
    pages = [f"<body><div class=k{chr(97 + i)}><p>x</p></div></body>" for i in range(20)]
    frame = spark.createDataFrame([("h", p) for p in pages] + [("g", pages[0])], "host string, html string")
    got = {r["template_host"]: pickle.loads(r["template"]) for r in wrapper._templates(spark, frame).collect()}
    assert set(got) == {"h", "g"}
    for p in pages:
        form = dom.shape(dom.parse(p))
        assert len(dom.assign(got["h"], dom.numbered(got["h"]), form)) == 4


@pytest.mark.parametrize("n,tag", [(100, "div"), (200, "div"), (2000, "div"), (400, "b"), (300, "ul><li")])
def test_text_after_the_deep_part_stays_inside(n, tag):
    name = tag.split(">")[0]
    source = f"<div class=wrap><article><p>first</p>{f'<{tag}>' * n}deep{f'</{name}>' * n}<p>after</p></article></div><div>outside</div>"
    assert wrapper.main_text(dom.parse(source)) == "first\ndeep\nafter"
    inside = "<div>" * 200 + "<p>a<p>b</p><ul><li>c<li>d</ul><br>" + "</div>" * 200
    assert wrapper.main_text(dom.parse(f"<article>{inside}<p>after</p></article>outside")).endswith("after")


def test_slots_choose_inside_declared_articles_too(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><article><h2>Our daily page</h2><p>Text {i} varies</p><blockquote>Ask us at the desk</blockquote>"
             f"<dl><dd><a href=1>Next {i}</a></dl></article><div>Outside {i}</div></body>") for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", f"<body><main><div>Loading the reader</div></main><div class=t><p>True text {i}</p></div></body>")
             for i in range(6)]
    rows += [(20, "http://c.example/0", "<article><p><a href=1>Only a link</a></p></article>"), (21, "http://d.example/0", "<a href=#c>Skip</a><div><p>Bare</p></div>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in wrapper.extracted_text(frame).collect()}
    assert text == {**{i: f"Text {i} varies" for i in range(6)}, **{10 + i: f"True text {i}" for i in range(6)}, 20: "Only a link", 21: "Bare"}


ARTICLE = "<p>" + "The text of the article goes on for a while. " * 5 + "</p>"


@pytest.mark.parametrize("source", [
    '<div class="no-sidebar"><article>{}</article></div>', '<div class="layout with-sidebar">{}</div>', '<div class="content menu-open">{}</div>',
    '<section class="related-to-work">{}</section>', '<form id="aspnetForm"><div><article>{}</article></div></form>', '<div class=sidebar>{}</div>',
    '<article><div class="comment-on-law">{}</div></article>', '<nav><a href=1>Home</a></nav><div class=x>{}</div><div class="site-footer">By us</div>',
    '<article>{}</article><article class=teaser><h2><a href=1>Another story</a></h2><p>Read more</p></article>',
    '<div><div class=ad>Buy this now.</div><article>{}<div class=share-bar>Tell a friend</div></article></div><section id=comments><p>I agree'])
def test_a_name_is_one_vote_and_never_cuts_the_main_part(source):
    assert wrapper.main_text(dom.parse(source.format(ARTICLE))) == ARTICLE[3:-4].strip()


def test_leads_in_an_articles_header_stay():
    source = f"<article><header><h1>Head</h1><p>The lead</p></header>{ARTICLE}</article>"
    assert wrapper.main_text(dom.parse(source)).startswith("Head\nThe lead\nThe text")


def test_adverts_that_vary_are_known_by_their_place(spark):
    """No tag, role or name tells the advert and the foot from the text; on some pages the advert is longer."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(500)]

    def some(n):
        return " ".join(rng.choices(words, k=n)) + "."
    rows, want = [], {}
    for i in range(30):
        paragraphs = [some(rng.randrange(40, 90)) for _ in range(1 if i == 7 else 6)]
        advert = some(200 if i == 7 else 12)
        rows.append((i, f"http://a.example/{i}", f"<body><div class=q>{advert}</div><div class=r><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}"
                     f"</div></div><div class=s>{some(6)}</div></body>"))
        want[i] = "\n".join(paragraphs)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrapper.extracted_text(frame).collect()} == want


def test_pages_of_ten_thousand_blocks_are_aligned_fast():
    def named(i):
        return "k" + "".join("abcdefghij"[int(c)] for c in str(i))
    alternating = ["".join(f"<h2>{i}</h2><p>{j}</p>" for i in range(5000)) for j in range(2)]
    distinct = ["".join(f"<div class={named(i)}>x</div>" for i in range(10_000) if i % 7 != j) for j in range(2)]
    for a, b in (alternating, distinct):
        a, b = (dom.parse(f"<article>{x}</article>") for x in (a, b))
        began = time.process_time()
        forms = dom.shape(a), dom.shape(b)
        both = dom.merged(*forms)
        dom.assign(both, dom.numbered(both), forms[1])
        assert time.process_time() - began < 3
    root = dom.parse(f"<article>{alternating[0]}</article>")
    assert len(wrapper.main_text(root).split("\n")) == 10_000


def test_many_runs_of_a_label_are_one_place():
    root = dom.parse("<div>" + "<h2>a</h2><p>b</p><p>c</p>" * 20 + "<ul><li>d</ul></div>")
    form = dom.shape(root)
    assert [c[0] for c in form[1][0][1]] == ["h2", "p", "ul"]
    dom.mark(root, form, dom.assign(form, dom.numbered(form), form))
    assert [c.id for c in root.elements()[0].elements()][-4:] == [2, 3, 3, 4]
