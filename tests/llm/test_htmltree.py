import itertools
import math
import random
import re
from html import unescape
from pathlib import Path

import pytest

from tidestream.llm import htmltree

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def test_messages_equal_enumeration():
    rnd = random.Random(8)
    for _ in range(40):
        n = rnd.randint(1, 9)
        nodes = [htmltree.Node("#", -1, 0)]
        for i in range(1, n):
            nodes.append(htmltree.Node(rnd.choice(["p", "div", "nav", "body", "article"]), rnd.randrange(i), rnd.choice([0, 1, 2, 3])))
        model = ([rnd.gauss(0, 1) for _ in range(htmltree.FEATURES)], [tuple(rnd.gauss(0, 1) for _ in range(4)) for _ in range(htmltree.EDGES)])
        on = [0.0] * n
        total = 0.0
        for ys in itertools.product((0, 1), repeat=n):
            s = sum(sum(model[0][f] for f in htmltree.features(x)) * y for x, y in zip(nodes, ys, strict=True))
            s += sum(model[1][htmltree.edge(nodes[x.parent], x)][2 * ys[x.parent] + y] for x, y in zip(nodes[1:], ys[1:], strict=True))
            total += math.exp(s)
            for i, y in enumerate(ys):
                on[i] += y * math.exp(s)
        odds, _ = htmltree.beliefs(nodes, model)
        for i in range(n):
            assert 1 / (1 + math.exp(-odds[i])) == pytest.approx(on[i] / total)


def test_held_out_accuracy():
    model = htmltree.trained()
    right = total = whole = 0
    pages = htmltree.labelled_pages(200, 4242)
    for html, labels, text in pages:
        nodes, _ = htmltree.parse(html)
        assert len(nodes) == len(labels)
        odds, _ = htmltree.beliefs(nodes, model)
        marks = [(x > 0) == bool(y) for x, y, n in zip(odds, labels, nodes, strict=True) if n.size]
        right, total, whole = right + sum(marks), total + len(marks), whole + (htmltree.main_text(html, model) == text)
    assert right / total > 0.97
    assert whole / len(pages) > 0.8


PAGE = """<!doctype html><html><head><title>No</title><script>if (a<b) x="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="ad">Buy things now.</div>
<article><h1>A &amp; B&nbsp;</h1><p>First <b>bold</b>  line &lt;kept&gt;,
<a href="x?a>b">linked</a> on. <p>Second one<br>goes on for quite a while here.</p><!-- <p>gone</p> --><ul><li>item one of the list<li>item two of the list</ul>
<form>Your name <input><p>Subscribe here.</p></form></article>
<section class="comments"><h3>Comments</h3><p>I disagree with every word of this long article, it is all wrong.</p></section>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_page(spark):
    want = "A & B\nFirst bold line <kept>, linked on.\nSecond one goes on for quite a while here.\nitem one of the list\nitem two of the list"
    long = "<article>" + "<p>A sentence of the long page.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "<article><p>Deep down there is some text to read, and it is kept.</p>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "  <p> "), (5, "u", long), (6, "u", deep), (None, "u", "<article><p>x < y & z &bogus; &#x41;<p>Some more text stands here, so that it is long enough.</article"), (7, "u", "<script>never closed <p>x"), (8, "u", "<a href='open>text")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    got = {r.page_id: r for r in htmltree.extracted(df).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[k].text for k in (2, 3, 4, 7)] == [""] * 4 and got[2].n_chars == 0 and got[2].url is None
    assert got[5].text == "\n".join(["A sentence of the long page."] * 20_000)
    assert got[6].text == "Deep down there is some text to read, and it is kept."
    assert got[None].text.startswith("x < y & z &bogus; A\n")
    assert htmltree.extracted(df.limit(0)).count() == 0


AROUND = "<html><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><article><h1>A title stands here</h1><p>First paragraph of the article, long enough.</p>%s<p>The second one goes on for some words too.</p></article><footer>&copy; Site</footer></body></html>"
BOTH = ["A title stands here", "First paragraph of the article, long enough.", "The second one goes on for some words too."]


@pytest.mark.parametrize("name", sorted(htmltree.SILENT - {"head"}))
def test_silent_elements_hide_what_they_hold_and_no_more(name):
    model = htmltree.trained()
    text = lambda part: htmltree.main_text(AROUND % part, model).split("\n")
    assert text(f"<{name} a=1>no <b>words</b> of it</{name}>") == BOTH
    assert text(f'<{name} a="1"/>') == BOTH
    assert text(f"<{name}></{name}>") == BOTH
    if name not in ("script", "style"):  # these two go on to the end of the page
        assert text(f"<{name} a=1>") == BOTH
        assert text(f"<div><{name} a=1></div>") == BOTH
        assert text(f"<{name}><{name}>") == BOTH
    if name not in htmltree.RAW:
        assert text(f"<{name}><p>a<{name} b>in</{name}><p>b</{name}>") == BOTH


def test_many_unclosed_elements_take_linear_time():
    nodes, blocks = htmltree.parse("<div>" * 2000 + "<button>x<svg>" * 20_000 + "<textarea>" * 5000 + "</div></object>" * 2000)
    assert len(nodes) == 2001 and blocks


@pytest.mark.parametrize(
    ("part", "line"),
    [
        ('<p class="comment-worthy">These words are worth a comment.</p>', "These words are worth a comment."),
        ('<h2 id="more-tags">More on tags</h2>', "More on tags"),
        ('<p class="no-sidebar has-ads">These words stand in the text.</p>', "These words stand in the text."),
        ('<div class="comments"><p>I think that all of this is wrong.</p></div>', None),
        ('<div class="ad-box x">Buy this now, it is cheap.</div>', None),
        ("<p hidden>Nobody sees these words on the page.</p>", None),
        ('<div style="color:red; display : none"><p>Nobody sees these words.</p></div>', None),
        ('<div aria-hidden="true"><p>Nobody hears these words.</p></div>', None),
        ('<div aria-hidden="false"><p>Everybody hears these words.</p></div>', "Everybody hears these words."),
    ],
)
def test_names_and_hidden_parts(part, line):
    assert htmltree.main_text(AROUND % part, htmltree.trained()).split("\n") == [*BOTH[:2], *([line] if line else []), BOTH[2]]


def other_pages(count, seed):
    """(html, lines of main text, other lines): layouts that the training pages don't have, lines all different."""
    rnd = random.Random(seed)
    serial = itertools.count()
    vocab = "harbor stone river quiet morning letter garden window copper signal market winter bridge paper forest engine candle shadow island valley".split()

    def line(least=6, most=40):
        return f"{' '.join(rnd.choices(vocab, k=rnd.randint(least, most)))} n{next(serial)}".capitalize() + "."

    for _ in range(count):
        kept, junk = [], []

        def say(where, text):
            where.append(text)
            return text.replace("stone", "<em>stone</em>").replace("river", '<A HREF="/r">river</A>') if rnd.random() < 0.3 else text

        good = lambda **k: say(kept, line(**k))
        bad = lambda **k: say(junk, line(**k))
        links = lambda n: "".join(f'<LI><a href="/{x}">{x} {next(serial)}</a>' for x in rnd.choices(vocab, k=n))
        title = "<h1 itemprop=headline>" + say(kept, line(3, 9)[:-1]) + "</h1>"
        body = [title]
        for _ in range(rnd.randint(2, 8)):
            body.append(
                rnd.choice(
                    [
                        lambda: "<P>" + good(),
                        lambda: "<p>" + good() + "</p>",
                        lambda: f"<p style='margin:0'>{good()}</p><h3>{good(least=2, most=6)}</h3>",
                        lambda: "<ul>" + "".join(f"<li>{good(least=4)}" for _ in range(3)) + "</ul>",
                        lambda: "<blockquote><p>" + good() + "</blockquote>",
                        lambda: f"<figure><img src=x><figcaption>{good(least=3, most=12)}</figcaption></figure>",
                        lambda: f'<div class="advert-slot">{bad()}</div>',
                        lambda: f"<aside><p>{bad()}</aside>",
                    ]
                )()
            )
        if rnd.random() < 0.3:
            body.append(f'<section id="comments"><h4>{bad(least=2, most=5)}</h4><ol><li class=comment><p>{bad()}</p><li class=comment><p>{bad()}</p></ol></section>')
        inner = "\n".join(body)
        shell = rnd.choice(["<ARTICLE itemscope>%s</ARTICLE>", '<div id="main-content"><article>%s</article></div>', '<main role="main"><div>%s</div></main>', "<section><article class='post'>%s</article></section>"]) % inner
        top = f'<header class="masthead"><p>{bad(least=2, most=6)}</p><nav><UL>{links(5)}</UL></nav></header>'
        side = rnd.choice(["", f'<div class="sidebar-left"><h4>{bad(least=2, most=4)}</h4><ul>{links(6)}</ul><p>{bad()}</p></div>', f'<div role="complementary"><p>{bad()}</p></div>'])
        pop = rnd.choice(["", f'<div role="dialog" class="cookie-banner"><p>{bad()}</p><button>Accept all</button></div>', f"<div hidden><p>{bad()}</p></div>"])
        form = rnd.choice(["", f"<form action=/s><label>{bad(least=2, most=5)}</label><input name=q></form>"])
        foot = f"<footer><p>&copy; {bad(least=3, most=9)}</p><ul>{links(3)}</ul></footer>"
        yield f"<!doctype html><HTML><HEAD><title>{line()}</title></HEAD><BODY class='no-sidebar'>{top}{side if rnd.random() < 0.5 else ''}{pop}{shell}{form}{foot}</BODY></HTML>", kept, junk


def test_accuracy_on_layouts_of_another_kind():
    model = htmltree.trained()
    found = lost = let_in = left_out = 0
    for html, kept, junk in other_pages(150, 5):
        lines = set(htmltree.main_text(html, model).split("\n"))
        found, lost = found + len(lines & set(kept)), lost + len(set(kept) - lines)
        let_in, left_out = let_in + len(lines & set(junk)), left_out + len(set(junk) - lines)
    assert found / (found + lost) > 0.98 and left_out / (let_in + left_out) > 0.98, (found, lost, let_in, left_out)


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_driver_pages(spark):
    """The text of these pages is that of their one article, read here by patterns."""
    rows = htmltree.extracted(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", html[r.page_id], re.S)[1]
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|ul|li)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text), html[r.page_id]


def _as_div(html, *tags):
    return re.sub(rf"<(/?)({'|'.join(tags)})(?=[\s>])", r"<\1div", html)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("tags", [("p",), ("article", "nav", "footer"), ("p", "article"), ("p", "article", "nav"), ("p", "article", "nav", "footer")])
def test_pages_without_elements_of_their_own_keep_their_text(spark, tags):
    model = htmltree.trained()
    found = total = 0
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|ul|li)>", article)]
        got = htmltree.main_text(_as_div(r.html, *tags), model).split("\n")
        assert got != [""]
        found, total = found + len({x for x in lines if x} & set(got)), total + len({x for x in lines if x})
        ads = re.search(r'<div class="ad">(.*?)</div>', r.html, re.S)[1]
        assert " ".join(unescape(ads).split()) not in got and not any(x in got for x in re.findall(r'<a href="[^"]*">(.*?)</a>', r.html))
    assert found >= 0.9 * total


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_pages_of_bare_text_keep_it(spark):
    model = htmltree.trained()
    found = total = 0
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        text = htmltree.main_text(re.sub(r"</?(?:p|article)>", "<br>", r.html), model)
        want = unescape(re.sub("<[^>]*>", " ", article)).split()
        found, total = found + sum(x in set(text.split()) for x in want), total + len(want)
        assert text
    assert found >= 0.9 * total


def test_pages_without_names():
    model = htmltree.trained()
    lines = ["Some text that stands here by itself. It goes on for a while, as text does.", "Another line of it comes here. It has a few words more."]
    assert htmltree.main_text("<body>" + "<br><br>".join(lines) + "</body>", model) == " ".join(lines)
    assert htmltree.main_text("<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>", model).split("\n") == lines
    cells = "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in lines) + "</table>"
    assert htmltree.main_text(f"<html><body><div>{cells}</div></body></html>", model).split("\n") == lines
