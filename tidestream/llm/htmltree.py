"""Main text of web pages by a tree-structured graphical model over their DOM.

Each block element is a binary variable (content or not). Its features give a log-odds, parent-child potentials
tie it to its parent, and sum-product messages passed up and then down the tree give exact marginals. The blocks of
elements with a marginal above one half make the text. Weights are learned by maximum likelihood, with gradients from the same
messages, from labelled pages made by `labelled_pages` (TRAINING_PAGES of them: a fixed bound, whatever the input).
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Labelled pages, passes over them, and their seed.
TRAINING_PAGES, PASSES, SEED = 240, 40, 11

# --- DOM -----------------------------------------------------------------------------------------------------

# Element names by what HTML makes of them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template iframe object svg canvas audio video select datalist textarea button title head map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open element a new one ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
WALLS = frozenset("td th table body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Ends of sentences.
_STOPS = re.compile(r"[.!?…。](?=\s|$)")
_UNSEEN = re.compile(r"display:none|visibility:hidden")
# Parts of class, id and role names that speak against and for content, and parts that say nothing by themselves.
AGAINST = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail widget footer foot header masthead topbar cookie cookies consent gdpr notice popup modal overlay dialog alert newsletter subscribe subscription signup register login share sharing social related recommended recommendation recommendations trending popular more comment comments commentlist reply replies respond disqus discussion feedback search searchbox form pager pagination pages copyright legal disclaimer toolbar tags tagcloud complementary contentinfo".split())
FOR = frozenset("article content post entry story body main text maincontent prose".split())
PLAIN = frozenset("area bar big block bottom box button buttons center col column columns container desktop div footer global group image inner item items js left level line link links list mobile module news on outer page panel primary reader readers response responses right row secondary section site small slot stories sub thread title top unit user users view wide wrap wrapper".split())
#: Elements that hold one piece of text: their id is a place to link to, so it says nothing.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split()) | INLINE


class Node:
    __slots__ = ("tag", "parent", "hint", "size", "linked", "first", "last", "stops", "under")

    def __init__(self, tag: str, parent: int, hint: int):
        self.tag, self.parent, self.hint, self.size, self.linked, self.first, self.last, self.stops = tag, parent, hint, 0, 0, "", "", 0
        self.under = False  # whether something around it speaks against content


def _hint(tag: str, attributes: str) -> int:
    """3: not shown, 2: a name speaks against content, 1: for it, 0: neither. A name counts if all its parts are known ones."""
    out = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(re.sub(r"\s", "", value.lower())):
            return 3
        if name in ("class", "role") or name == "id" and tag not in LEAVES:
            for word in value.split():
                parts = {x.lower() for x in _PART.findall(word) if len(x) > 1}
                if parts <= AGAINST | FOR | PLAIN:
                    out = max(out, 2 if parts & AGAINST else int(bool(parts & FOR)))
    return out


def _tags(page: str) -> tuple[list[tuple[int, int, bool, str, str]], dict[int, int]]:
    """(begin, end, whether it closes, name, attributes) of each tag, comments and raw elements having no name; and where each silent
    element ends, by the place of its start tag in the list: one that closes itself, or isn't closed before the element around it is,
    holds nothing."""
    out: list[tuple[int, int, bool, str, str]] = []
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    lost: set[str] = set()  # raw elements that no end tag follows
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        at = m.end()
        closing, name, attributes = bool(m[1] or m[4]), (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if name in RAW and not closing and not attributes.endswith("/"):
            end = None if name in lost else re.compile(f"</{name}(?![a-zA-Z0-9])[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                lost.add(name)
                at = len(page) if name in ("script", "style") else at
        if name in RAW or name == "head":
            name = ""
        if closing and count.get(name):
            while True:
                last, k = open_.pop()
                count[last] -= 1
                if last == name:
                    break
            if name in SILENT:
                ends[k] = len(out)
        elif name and not closing and name not in INLINE and name not in VOID and not (name in SILENT and attributes.endswith("/")):
            open_.append((name, len(out)))
            count[name] = count.get(name, 0) + 1
        out.append((m.start(), at, closing, name, attributes))
    return out, ends


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements, parents first, and (element, text) of each stretch of text between block boundaries."""
    nodes = [Node("#", -1, 0)]
    stack = [0]
    inline: list[str] = []  # inline elements that are nodes of their own, by name
    blocks: list[tuple[int, list[str]]] = []
    at, linked = 0, False

    def add(text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        n = stack[-1]
        if blocks and blocks[-1][0] == n and open_block[0]:
            blocks[-1][1].append(text)
        elif text.strip():
            blocks.append((n, [text]))
            open_block[0] = True
        else:
            return
        size = len(text)
        nodes[n].size += size
        if linked:
            nodes[n].linked += size

    open_block = [False]
    tags, ends = _tags(page)
    for k, (begin, end, closing, name, attributes) in enumerate(tags):
        if begin < at:
            continue
        if begin > at:
            add(page[at:begin])
        at = end
        if not name:
            continue
        if name in SILENT:
            at = tags[ends[k]][1] if k in ends else end
            continue
        if name in INLINE:
            if name == "br":
                add(" ")
            elif name == "a":
                linked = not closing
            if not closing and name not in VOID and attributes and _hint(name, attributes) >= 2:
                nodes.append(Node(name, stack[-1], _hint(name, attributes)))
                stack.append(len(nodes) - 1)
                inline.append(name)
                open_block[0] = False
            elif closing and inline and inline[-1] == name and nodes[stack[-1]].tag == name:
                inline.pop()
                stack.pop()
                open_block[0] = False
            continue
        open_block[0] = False
        linked = False
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == name:
                    del stack[k:]
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if (tag := nodes[stack[k]].tag) == "p":
                del stack[k:]
                break
            if tag in WALLS:
                break
        if name in ENDS:
            ended, wall = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if (tag := nodes[stack[k]].tag) in ended:
                    del stack[k:]
                    break
                if tag in wall:
                    break
        if name not in VOID:
            above = nodes[stack[-1]]
            nodes.append(Node(name, stack[-1], _hint(name, attributes) if attributes else 0))
            nodes[-1].under = above.under or above.hint >= 2 or above.tag in _APART
            stack.append(len(nodes) - 1)
    if at < len(page):
        add(page[at:])
    out = []
    for n, parts in blocks:
        text = " ".join("".join(parts).split())
        if text:
            out.append((n, text))
            nodes[n].first, nodes[n].last = nodes[n].first or text[0], text[-1]
            nodes[n].stops += len(_STOPS.findall(text))
    return nodes, out


# --- model ---------------------------------------------------------------------------------------------------

_KINDS = ["p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "td th", "blockquote pre figcaption", "article", "main", "nav menu", "header", "footer", "aside", "form fieldset", "section", "div", "ul ol dl table tbody thead tr figure", "html #", "body"]
KIND = {tag: i for i, tags in enumerate(_KINDS) for tag in tags.split()}
_OTHER = len(_KINDS)
_FOR, _AGAINST, _UNSHOWN, _LINKS, _EMPTY, _SHORT, _MIDDLE, _LONG, _STOP, _PROSE, _RIGHTS, _OWN = range(_OTHER + 1, _OTHER + 13)
FEATURES = _OTHER + 13
#: Kinds of edges: from what holds a whole page; to a part that name or hint set apart; from what holds one thing; others.
EDGES = 4
_APART = frozenset("nav menu footer aside form fieldset".split())
_WHOLE = frozenset("# html body".split())
_HOLDERS = frozenset(("article", "main"))
_ONE = frozenset("article main nav menu header footer aside form fieldset p ul ol dl table tr tbody thead blockquote figure li td".split())


def features(node: Node) -> list[int]:
    size = node.size
    out = [KIND.get(node.tag, _OTHER), _EMPTY if not size else _SHORT if size < 25 else _MIDDLE if size < 100 else _LONG]
    if node.hint:
        out.append((_FOR, _AGAINST, _UNSHOWN)[node.hint - 1])
    if size and 2 * node.linked > size:
        out.append(_LINKS)
    if node.last and node.last in ".!?…。:;\"”»)":
        out.append(_STOP)
    if node.stops > 1 and 4 * node.linked < size:
        out.append(_PROSE)
    if node.first in ("©", "Ⓒ"):
        out.append(_RIGHTS)
    if node.tag in _HOLDERS and not node.under and node.hint < 2:
        out.append(_OWN)
    return out


def edge(parent: Node, child: Node) -> int:
    if parent.tag in _WHOLE:
        return 0
    if child.hint >= 2 or child.tag in _APART:
        return 1
    return 2 if parent.tag in _ONE or parent.hint else 3


Model = tuple[list[float], list[tuple[float, float, float, float]]]  # weights; log potentials 00, 01, 10, 11 (parent, child)


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def beliefs(nodes: list[Node], model: Model) -> tuple[list[float], list[float]]:
    """The log-odds of each node given the whole page, and of its message to its parent."""
    weights, pairs = model
    up = [sum([weights[f] for f in features(n)]) for n in nodes]
    message = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent
        a, b, c, d = pairs[edge(nodes[p], nodes[i])]
        x = up[i]
        message[i] = m = _log_add(c, x + d) - _log_add(a, x + b)
        up[p] += m
    for i in range(1, len(nodes)):
        p = nodes[i].parent
        a, b, c, d = pairs[edge(nodes[p], nodes[i])]
        z = up[p] - message[i]
        up[i] += _log_add(b, z + d) - _log_add(a, z + c)
    return up, message


def main_text(page: str, model: Model) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    odds, _ = beliefs(nodes, model)
    return "\n".join([text for n, text in blocks if odds[n] > 0])


# --- labelled pages and training -----------------------------------------------------------------------------


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[int], str]]:
    """(html, label of each block element in page order, main text) of made-up pages of many layouts."""
    rnd = random.Random(seed)
    syllables = "ba lo mi ren tu sha vel on qui er das po ni kel urt".split()
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))

    def sentence(least=4, most=24):
        return " ".join(word() for _ in range(rnd.randint(least, most))).capitalize() + rnd.choice(".....!?")

    prose = lambda: " ".join(sentence() for _ in range(rnd.randint(1, 6)))
    title = lambda: " ".join(word() for _ in range(rnd.randint(2, 9))).capitalize() + rnd.choice(["", "", "."])
    link = lambda: f'<a href="/{word()}">{word()}</a>'

    def page():
        labels, kept, html = [0], [], []
        open_ = [0]  # places of the open elements' labels
        style = rnd.choices(["p", "div", "bare", "cells"], [54, 20, 20, 6])[0]  # what holds a paragraph
        plain = rnd.random() < 0.3  # parts without names and elements of their own
        brief = rnd.random() < 0.1  # one sentence is all
        alone = rnd.random() < 0.1  # nothing around it

        def tag(name, inner, label=0, attributes=""):
            open_.append(len(labels))
            labels.append(label)
            html.append(f"<{name}{attributes}>")
            if callable(inner):
                inner()
            else:
                html.append(inner)
                if label and inner.strip():
                    kept.append(" ".join(re.sub("<[^>]*>", "", inner).split()))
            html.append(f"</{name}>")
            open_.pop()

        named = lambda *names: "" if rnd.random() < 0.15 else f' {rnd.choice(["class", "id"])}="{rnd.choice(names)}"'
        items = lambda name="li", n=8: [tag(name, link()) for _ in range(rnd.randint(3, n))]

        def menu():
            if plain:
                tag("div", lambda: tag("ul", items) if rnd.random() < 0.5 else html.append(" ".join(link() for _ in range(rnd.randint(3, 8)))))
            elif rnd.random() < 0.7:
                tag("nav", lambda: tag("ul", items) if rnd.random() < 0.7 else html.append(" | ".join(link() for _ in range(5))), 0, rnd.choice(["", named("menu", "main-nav")]))
            else:
                tag("div", lambda: tag("ul", items), 0, f' class="{rnd.choice(["navbar", "menu", "topNav", "breadcrumbs"])}"')

        def junk():
            kind = rnd.randrange(10)
            text = rnd.choice([prose, sentence, title])
            if kind == 0:
                tag("div", text(), 0, f' class="{rnd.choice(["ad", "ads", "advert box", "sponsored", "promo-banner"])}"')
            elif kind == 1:
                tag("aside", lambda: [tag("h3", title()), tag("p", text()), tag("ul", items)], 0, named("sidebar", "rail", "x"))
            elif kind == 2:
                tag("div", lambda: [tag("p", text()), html.append("<button>OK</button>")], 0, f' id="{rnd.choice(["cookie-notice", "consent", "gdpr_popup", "newsletter"])}"')
            elif kind == 3:
                tag("form", lambda: [html.append('<input name="q">'), tag(rnd.choice(["p", "div"]), sentence())] if rnd.random() < 0.7 else html.append(sentence()))
            elif kind == 4:
                tag("div", lambda: [tag("h4", title()), tag("ul", items)], 0, f' class="{rnd.choice(["related", "more-stories", "popular", "widget"])}"')
            elif kind == 5:
                tag("div", " ".join(link() for _ in range(4)), 0, f' class="{rnd.choice(["share", "social-bar", "tags"])}"')
            elif kind == 6:
                menu()
            elif kind == 7:
                tag("div", lambda: [tag("p", text()) for _ in range(2)], 0, f' class="{rnd.choice(["sidebar", "side column", "notice"])}"')
            elif kind == 8:
                tag("aside", text())
            else:
                tag(rnd.choice(["div", "p", "section"]), text(), 0, rnd.choice([" hidden", ' style="display: none"', ' aria-hidden="true"', ' class="x" hidden=""']))

        def comments():
            name = rnd.choice(["section", "div", "ol"])

            def one():
                inner = lambda: [tag("p", prose()) for _ in range(rnd.randint(1, 3))]
                tag("li" if name == "ol" else rnd.choice(["div", "article"]), inner if rnd.random() < 0.7 else prose(), 0, rnd.choice(["", ' class="comment"', ' class="reply"']))

            tag(name, lambda: [tag("h3", title()), *(one() for _ in range(rnd.randint(1, 4)))], 0, f' {rnd.choice(["class", "id"])}="{rnd.choice(["comments", "comment-list", "disqus_thread", "responses replies", "reader-comments"])}"')

        def paragraph():
            text = prose() if rnd.random() < 0.85 else word() + "."
            if rnd.random() < 0.25:
                first, _, rest = text.partition(" ")
                text = f"<b>{first}</b> {link()} {rest}"
            tag("div" if style == "div" else "p", text, 1, f' class="{rnd.choice([word(), "lead", "more-about-" + word(), "comment-worthy", "ad-hoc", "p-1", "has-notice", "text"])}"' if rnd.random() < 0.2 else "")

        slug = lambda: f' id="{rnd.choice([word(), "more-tags", "comments", "related", word() + "-" + word()])}"' if rnd.random() < 0.3 else ""

        def bare():
            """Text that stands in its parent itself, in lines."""
            lines = [prose() for _ in range(rnd.randint(1, 5))]
            labels[open_[-1]] = 1
            html.append(rnd.choice(["<br>", "<br><br>", "<br/>\n"]).join(lines))
            kept.append(" ".join(" ".join(lines).split()))

        def content(own):
            if brief:
                return tag("div" if style == "div" else "p", sentence(), 1)
            if rnd.random() < 0.85:
                tag("h1", title(), 1) if rnd.random() < 0.8 else tag("header", lambda: tag("h1", title(), 1), 1)
            if style == "cells":
                tag("table", lambda: [tag("tr", lambda: tag("td", (lambda: [paragraph() for _ in range(rnd.randint(1, 3))]) if rnd.random() < 0.5 else prose(), 1), 1) for _ in range(rnd.randint(1, 4))], 1)
                return
            if style == "bare":
                for _ in range(rnd.randint(1, 3)):
                    bare()
                    tag(rnd.choice(["h2", "h3"]), title(), 1, slug())
                bare()
                return
            for _ in range(rnd.randint(1, 9)):
                x = rnd.random()
                if x < 0.62:
                    paragraph()
                elif x < 0.72:
                    tag(rnd.choice(["h2", "h3"]), title(), 1, slug())
                elif x < 0.80:
                    tag(rnd.choice(["ul", "ol"]), lambda: [tag("li", rnd.choice([sentence, title])(), 1) for _ in range(rnd.randint(2, 5))], 1)
                elif x < 0.84:
                    tag("blockquote", prose() if rnd.random() < 0.5 else lambda: paragraph(), 1)
                elif x < 0.87:
                    tag("pre", prose(), 1)
                elif x < 0.90:
                    tag("table", lambda: [tag("tr", lambda: [tag("td", word(), 1) for _ in range(3)], 1) for _ in range(2)], 1)
                elif x < 0.92:
                    tag("figure", lambda: tag("figcaption", sentence(), 1), 1)
                elif x < 0.95:
                    tag("div" if rnd.random() < 0.5 else "section", lambda: [paragraph() for _ in range(2)], 1)
                else:
                    junk()
            if own and rnd.random() < 0.15:
                comments()

        def article():
            kind = rnd.random()
            if style == "bare" and rnd.random() < 0.8:
                content(False)
            elif plain and kind < 0.7:
                tag(rnd.choice(["div", "div", "section"]), lambda: content(False), 1)
            elif kind < 0.55:
                tag("article", lambda: content(True), 1, rnd.choice(["", "", named("post", "story")]))
            elif kind < 0.7:
                tag("main", lambda: content(False), 1)
            elif kind < 0.9:
                tag("div", lambda: content(False), 1, f' {rnd.choice(["class", "id"])}="{rnd.choice(["content", "post-body", "entry-content", "articleText", "main"])}"')
            else:
                content(False)

        def site_header():
            tag("header" if rnd.random() < 0.6 else "div", lambda: [tag(rnd.choice(["h1", "p", "div"]), title()), menu()], 0, f' class="{rnd.choice(["site-header", "masthead", "header", "top banner"])}"' if rnd.random() < 0.8 else " id=header")

        def site_footer():
            text = f"&copy; {word()}.{word()} &middot; {rnd.choice([title, sentence, prose])()}"
            name = "div" if plain else rnd.choice(["footer", "footer", "div"])
            attributes = "" if plain else ' class="footer"' if name == "div" or rnd.random() < 0.5 else ""
            tag(name, text if rnd.random() < 0.7 else lambda: [tag("p", text), tag("ul", items)], 0, attributes)

        def body():
            def parts():
                if alone:
                    return article()
                for part, chance in ((site_header, 0.5), (menu, 0.6), (junk, 0.6), (junk, 0.3)):
                    if rnd.random() < chance:
                        part()
                article()
                for part, chance in ((comments, 0.4), (junk, 0.5), (junk, 0.3)):
                    if rnd.random() < chance:
                        part()
                if rnd.random() < 0.85:
                    site_footer()

            def wrapped(depth):
                tag("div", lambda: wrapped(depth - 1), 0, rnd.choice(["", "", ' id="page"', ' class="wrapper"'])) if depth else parts()

            wrapped(rnd.choice([0, 0, 0, 1, 1, 2, 5, 12]))

        tag("html", lambda: [html.append(f"<head><title>{title()}</title><script>var x='<p>';</script></head>"), tag("body", body)])
        return "<!DOCTYPE html>" + "".join(html), labels, "\n".join(kept)

    return [page() for _ in range(count)]


@functools.lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED, passes: int = PASSES) -> Model:
    """Weights and potentials of greatest likelihood (with a small quadratic penalty), by stochastic gradient steps."""
    data = []
    for html, labels, _ in labelled_pages(pages, seed):
        nodes = parse(html)[0]
        data.append((nodes, [features(n) for n in nodes], labels))
    weights, pairs = [0.0] * FEATURES, [[0.0] * 4 for _ in range(EDGES)]
    grown = [1e-6] * (FEATURES + 4 * EDGES)  # squared gradients so far: each weight has a step length of its own
    order = random.Random(seed)
    for _ in range(passes):
        order.shuffle(data)
        for nodes, found, labels in data:
            odds, message = beliefs(nodes, (weights, [tuple(p) for p in pairs]))
            step = [-0.002 * w for w in weights] + [-0.002 * x for p in pairs for x in p]
            for i, (fs, y) in enumerate(zip(found, labels, strict=True)):
                off = y - 1 / (1 + math.exp(-max(-40.0, min(40.0, odds[i]))))
                for f in fs:
                    step[f] += off
                if i:
                    p = nodes[i].parent
                    e = edge(nodes[p], nodes[i])
                    table, z = pairs[e], odds[p] - message[i]
                    a, b = table, (z, odds[i] - (_log_add(table[1], z + table[3]) - _log_add(table[0], z + table[2])))
                    joint = [math.exp(max(-60.0, min(60.0, a[2 * u + v] + u * b[0] + v * b[1]))) for u in (0, 1) for v in (0, 1)]
                    total = sum(joint)
                    for k in range(4):
                        step[FEATURES + 4 * e + k] += (k == 2 * labels[p] + y) - joint[k] / total
            for k, g in enumerate(step):
                grown[k] += g * g
                move = 0.3 * g / math.sqrt(grown[k])
                if k < FEATURES:
                    weights[k] += move
                else:
                    pairs[(k - FEATURES) // 4][(k - FEATURES) % 4] += move
    return weights, [tuple(p) for p in pairs]


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (blocks joined by a newline; empty if none) and n_chars (its code points) of each page.

    Null or blank html: empty. Rows of one page_id are extracted each. Columns other than page_id, url and html are not looked at."""
    model = model or trained()

    def run(batches):
        for batch in batches:
            texts = [main_text(x or "", model) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
