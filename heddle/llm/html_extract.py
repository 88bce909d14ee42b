"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text is a node with a hidden label, content or boilerplate. A node's own potential
is a log-linear function of its tag, its class and id words, its text length, link share and sentence marks; each parent
and child share a potential by the pair of their labels and whether the child is a run of text. Sum-product message
passing, once upward and once downward, gives every node's exact marginal, and the text runs whose content marginal
exceeds one half are the main text, in page order. Inline elements are part of their block's run, but for those whose class or
id hints at an advert or the like: these are nodes of their own, and their text is left out of the run if it is boilerplate.

Both kinds of potential are trained here from labelled pages: `labelled_pages` deals a bounded number of pages from
layouts written below, in which what belongs to the article is marked; the model is fitted once on the driver and sent
to the tasks (a few hundred numbers).

Defined cases: null and empty pages give an empty text; text without any markup is one run and is content; unclosed and
misnested tags are closed as browsers do for the common cases; repeated rows come out alike; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TRAINING_PAGES = 600  # the bound of the labelled sample
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre "
    "nav header footer aside form fieldset figure figcaption address details summary dialog menu hr center".split()
)
DROPPED = set("script style noscript template iframe svg object select textarea button canvas audio video datalist title".split())
RAW = set("script style textarea title iframe noscript".split())  # only their own end tag ends them
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
# What opening a tag closes, as far up as the nearest of the second set.
CLOSES = {
    **dict.fromkeys(BLOCKS - {"html", "body", "td", "th", "tr", "li", "dt", "dd"}, ({"p"}, {"div", "article", "section", "body", "td", "th", "li", "main"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
}
TAGS = "body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre nav header footer aside form figure figcaption address details summary dialog menu".split()
HINTS = (
    "nav menu header footer head foot sidebar side aside ad ads advert sponsor promo banner cookie consent notice alert popup modal comment comments reply "
    "discussion share social related recommend breadcrumb crumbs form login search newsletter subscribe signup copyright legal widget toolbar pager pagination "
    "tags meta byline article content main post entry body story text page wrapper container title caption"
).split()
# Hints by which an inline element is a node of its own.
SET_APART = set("ad ads advert sponsor promo banner cookie consent notice alert popup modal share social related recommend newsletter subscribe signup login".split())
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "hints", "parent", "pieces", "text", "linked", "mark", "within")

    def __init__(self, tag, hints, parent, mark=False):
        self.tag, self.hints, self.parent, self.mark = tag, hints, parent, mark
        self.pieces: list[str | Node] | None = None
        self.text, self.linked = "", 0
        self.within = False  # a run inside another run

    def read(self, content: set) -> str:
        """The run's text with that of the content runs inside it."""
        if all(type(p) is str for p in self.pieces):
            return self.text
        return SPACE.sub(" ", "".join(p if type(p) is str else f" {p.read(content)} " if p in content else " " for p in self.pieces)).strip()


class Dom(HTMLParser):
    """Nodes in page order, parents before children. Runs of text are nodes with the tag `#text`."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", (), -1)]
        self.open = [0]
        self.count: dict[str, int] = {}  # open elements by tag
        self.run: Node | None = None
        self.apart: list[list] = []  # open inline nodes: tag, elements open outside, the run around, the same tag inside
        self.skip: list[str] = []
        self.links = 0

    def end_run(self):
        run, self.run = self.run, None
        if run is not None:
            run.text = SPACE.sub(" ", "".join(p if type(p) is str else " " for p in run.pieces)).strip()
            if run.text:
                self.nodes.append(run)
        return run

    def end_runs(self):
        """A block starts or ends: the open run ends, and those around the inline nodes that it is in."""
        inner = self.run
        for x in self.apart:
            self.run, x[2] = x[2], None
            self.end_run()
        self.run = inner
        self.end_run()

    def end_apart(self):
        """Closes the innermost inline node; its run is part of the run around it."""
        _, depth, around, _ = self.apart.pop()
        run = self.end_run()
        self.shut(depth)
        self.run = around
        if run is not None and run.text:
            run.within = True
            self.append(run)

    def append(self, piece):
        if self.run is None:
            self.run = Node("#text", (), self.open[-1])
            self.run.pieces = []
        self.run.pieces.append(piece)

    def shut(self, depth):
        for k in self.open[depth:]:
            self.count[self.nodes[k].tag] -= 1
        del self.open[depth:]
        while self.apart and self.apart[-1][1] >= depth:
            self.apart.pop()

    def element(self, tag, attrs):
        words = [w for name, value in attrs if value and name in ("class", "id", "role") for w in WORD.findall(value.lower())]
        hints = tuple({HINT_AT[w] for w in words if w in HINT_AT})
        self.nodes.append(Node(tag, hints, self.open[-1], any(n == "data-main" for n, _ in attrs)))
        self.open.append(len(self.nodes) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag not in EMPTY and self.skip[0] not in RAW:
                self.skip.append(tag)
            return
        if tag in DROPPED:
            self.skip.append(tag)
            return
        if tag not in BLOCKS:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "a":
                self.links += 1
            if tag not in EMPTY and any(w in SET_APART for name, value in attrs if value and name in ("class", "id") for w in WORD.findall(value.lower())):
                around, self.run = self.run, None
                self.apart.append([tag, len(self.open), around, 0])
                self.element(tag, attrs)
            elif self.apart and self.apart[-1][0] == tag:
                self.apart[-1][3] += 1
            return
        self.end_runs()
        closes, until = CLOSES.get(tag, ((), ()))
        if any(self.count.get(c) for c in closes):
            for k in range(len(self.open) - 1, 0, -1):
                at = self.nodes[self.open[k]].tag
                if at in closes:
                    self.shut(k)
                elif at in until:
                    break
        if tag in EMPTY:
            return
        self.links = 0
        self.element(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and self.skip and self.skip[-1] == tag:
            self.skip.pop()  # as in <svg/>

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
                return
            if self.skip[0] in RAW or tag not in BLOCKS or not self.count.get(tag):
                return
            self.skip.clear()  # a block around it ends, so what was dropped was never closed
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in BLOCKS:
            if self.apart and self.apart[-1][0] == tag:
                self.apart[-1][3] -= 1
                if self.apart[-1][3] < 0:
                    self.end_apart()
            return
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[k]].tag == tag:
                while self.apart and self.apart[-1][1] > k:
                    self.end_apart()
                self.end_runs()
                self.shut(k)
                self.links = 0
                return

    def handle_data(self, data):
        if self.skip:
            return
        self.append(data)
        if self.links:
            self.run.linked += len(data)

    def finish(self):
        self.close()
        while self.apart:
            self.end_apart()
        self.end_run()
        return self.nodes


HINT_AT = {w: k for k, w in enumerate(HINTS)}
TAG_AT = {t: k for k, t in enumerate(TAGS)}
WIDTH = 1 + len(TAGS) + 1 + len(HINTS) + 6


def parse(html: str) -> list[Node]:
    dom = Dom()
    dom.feed(html)
    return dom.finish()


def node_features(nodes: list[Node]) -> list[list[int]]:
    """The indices of each node's features that are on."""
    out = []
    after_text = 1 + len(TAGS) + 1 + len(HINTS)
    for n in nodes:
        on = [0, 1 + TAG_AT.get(n.tag, len(TAGS))]
        on += [2 + len(TAGS) + h for h in n.hints]
        if n.tag == "#text":
            size = len(n.text)
            on.append(after_text + (0 if size < 25 else 1 if size < 100 else 2))
            if n.linked * 2 > size:
                on.append(after_text + 3)
            if n.text[-1:] in ".!?…":
                on.append(after_text + 4)
            if "©" in n.text:
                on.append(after_text + 5)
        out.append(on)
    return out


class Model:
    """unary: weight of each feature. pair[k][a][b]: log potential of a parent's label a and a child's label b; k is 1 for text."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary.tolist(), pair.tolist()

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Content probability of every node, by one upward and one downward pass of messages (log odds and log sums)."""
        from math import exp, log1p

        def add(a, b):
            return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))

        n = len(nodes)
        own1 = [sum(self.unary[k] for k in on) for on in node_features(nodes)]
        belief0, belief1 = [0.0] * n, own1[:]
        up0, up1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):  # children stand after their parents
            p = self.pair[nodes[i].tag == "#text"]
            up0[i] = add(p[0][0] + belief0[i], p[0][1] + belief1[i])
            up1[i] = add(p[1][0] + belief0[i], p[1][1] + belief1[i])
            belief0[nodes[i].parent] += up0[i]
            belief1[nodes[i].parent] += up1[i]
        for i in range(1, n):
            p, a = self.pair[nodes[i].tag == "#text"], nodes[i].parent
            rest0, rest1 = belief0[a] - up0[i], belief1[a] - up1[i]
            down0, down1 = add(p[0][0] + rest0, p[1][0] + rest1), add(p[0][1] + rest0, p[1][1] + rest1)
            belief0[i] += down0
            belief1[i] += down1
        return [1 / (1 + exp(min(700, max(-700, belief0[i] - belief1[i])))) for i in range(n)]

    def extract(self, html: str) -> str:
        nodes = parse(html)
        if len(nodes) == 1:
            return ""
        if all(n.tag in ("#root", "#text") for n in nodes):  # no markup to tell anything apart
            return "\n\n".join(n.text for n in nodes[1:])
        content = {n for n, m in zip(nodes, self.marginals(nodes)) if n.text and m > 0.5}
        return "\n\n".join(n.read(content) for n in nodes if n in content and not n.within)


def labelled_pages(seed: int = 7, count: int = TRAINING_PAGES) -> list[str]:
    """Pages whose main elements carry the attribute data-main. Layouts are dealt from parts of a handful of site styles."""
    r = random.Random(seed)
    syllables = "ta re mi lo ken sa dor vi nu pel ga shi on ter".split()

    def words(n):
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    def sentence(n):
        return words(n).capitalize() + r.choice(".....!?")

    def links(n):
        return "".join(f'<li><a href="/{words(1)}">{words(r.randint(1, 3))}</a></li>' for _ in range(n))

    def paragraph():
        text = " ".join(sentence(r.randint(2, 18)) for _ in range(r.randint(1, 6)))
        if r.random() < 0.25:
            text = f'<b>{words(2)}</b> {text} <a href="/x">{words(2)}</a> {sentence(4)}'
        if r.random() < 0.2:
            text = r.choice([words(r.randint(1, 4)), sentence(r.randint(1, 4))])
        if r.random() < 0.05:
            text += f' <span class="{r.choice(["ad", "advert", "promo", "sponsor", "ad-inline", "share"])}">{words(r.randint(2, 6))}</span> {sentence(5)}'
        return r.choice(["<p data-main>{}</p>", "<p data-main>{}</p>", "<p data-main>{}", "<p data-main><b>{}<br>"]).format(text)

    def article():
        parts = [f"<h{r.choice('1112')} data-main>{words(r.randint(2, 9))}</h1>".replace("</h1>", "")] if r.random() < 0.75 else []
        parts = [p + "</h1></h2>" for p in parts]
        if parts and r.random() < 0.25:
            parts = [f"<header data-main>{parts[0]}</header>"]
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9])):
            x = r.random()
            if x < 0.7:
                parts.append(paragraph())
            elif x < 0.8:
                parts.append(other())
            elif x < 0.86:
                parts.append(f"<h{(k := r.choice('234'))} data-main>{words(r.randint(1, 5))}</h{k}>")
            elif x < 0.92:
                parts.append("<ul data-main>" + "".join(f"<li data-main>{sentence(r.randint(2, 9))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.95:
                parts.append(f"<blockquote data-main><p data-main>{sentence(9)}</p></blockquote>")
            elif x < 0.97:
                parts.append("<table data-main>" + "".join(f"<tr data-main><td data-main>{words(2)}<td data-main>{words(1)}" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<figure data-main><figcaption data-main>{sentence(6)}</figcaption></figure>")
            if r.random() < 0.06:
                parts.append(boilerplate(r.choice(["ad", "share", "related", "form"])))
        return "".join(parts)

    def other():
        """Blocks of the less common kinds."""
        text = r.choice([sentence(r.randint(2, 14)), words(r.randint(1, 6)), " ".join(sentence(9) for _ in range(3))])
        return r.choice([
            "<pre data-main>{}</pre>", "<pre data-main><code>{}</code></pre>", "<address data-main>{}</address>", "<center data-main>{}</center>", "<div data-main>{}</div>",
            "<dl data-main><dt data-main>{}<dd data-main>{}</dl>", "<dl data-main><dt data-main>{}</dt><dd data-main>{}</dd></dl>", "<ol data-main><li data-main>{}<li data-main>{}</ol>",
            "<details data-main><summary data-main>{}</summary><p data-main>{}</p></details>", "<section data-main><h2 data-main>{}</h2><p data-main>{}</p></section>",
            "<div data-main><p data-main>{}</p></div>", "<dialog data-main>{}</dialog>", "<p data-main>{}<hr><p data-main>{}", "<blockquote data-main>{}</blockquote>",
            "<figure data-main><p data-main>{}</p><figcaption data-main>{}</figcaption></figure>", "<table data-main><tr data-main><th data-main>{}<td data-main>{}</table>",
        ]).replace("{}", "\x00").replace("\x00", text, 1).replace("\x00", sentence(r.randint(3, 12)))

    def boilerplate(kind):
        body = r.choice([sentence(r.randint(3, 25)), f"<p>{sentence(r.randint(3, 20))}</p>", f"<p>{sentence(12)}</p><p>{sentence(7)}</p>"])
        names = {
            "ad": ["ad", "ads", "advert", "banner", "sponsor", "promo", "ad-banner"],
            "notice": ["cookie", "cookie-notice", "notice", "consent", "alert", "popup", "banner"],
            "share": ["share", "social", "share-links", "toolbar"],
            "related": ["related", "recommend", "related-posts"],
            "comments": ["comments", "comment-list", "discussion", "comment", "reply"],
            "sidebar": ["sidebar", "side", "widget", "side-bar"],
            "form": ["newsletter", "subscribe", "login", "search", "signup"],
        }.get(kind, [])
        attr = f'{r.choice(["class", "class", "id"])}="{r.choice(names)}"' if names and r.random() < 0.95 else ""
        if kind == "nav":
            return r.choice(['<nav>{}</nav>', '<nav><ul>{}</ul></nav>', '<div class="menu"><ul>{}</ul></div>', '<div id="nav">{}</div>', '<ul class="nav">{}</ul>', '<div class="breadcrumb">{}</div>']).format(links(r.randint(2, 9)))
        if kind == "header":
            return r.choice(['<header>{}</header>', '<div class="header">{}</div>', '<div id="header"><p>{}</p></div>', '<header><h1>{}</h1></header>']).format(words(r.randint(1, 5)))
        if kind == "footer":
            text = r.choice(["&copy; {}", "&copy; 2020 {}. {}", "{} &middot; {}", "{}. {}"]).format(words(3), sentence(r.randint(2, 16)))
            return r.choice(['<footer>{}</footer>', '<footer><p>{}</p></footer>', '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>']).format(text)
        if kind == "comments":
            body = "".join(r.choice([f'<div class="comment"><p>{sentence(r.randint(3, 25))}</p></div>', f"<li>{sentence(8)}</li>", f"<p>{sentence(11)}</p>"]) for _ in range(r.randint(1, 4)))
            return f'<{(t := r.choice(["div", "section", "ol"]))} {attr or "class=comments"}><h{(k := r.choice("234"))}>{words(r.randint(1, 3))}</h{k}>{body}</{t}>'
        if kind == "sidebar":
            tag = r.choice(["aside", "div", "section"])
            return f'<{tag} {attr or "class=sidebar" if tag != "aside" else attr}><h{(k := r.choice("234"))}>{words(2)}</h{k}>{r.choice([body, "<ul>" + links(4) + "</ul>"])}</{tag}>'
        if kind == "related":
            return f'<div {attr or "class=related"}><h4>{words(2)}</h4><ul>{links(4)}</ul></div>'
        if kind == "form":
            return f'<form {attr}><p>{words(r.randint(2, 8))}</p><label>{words(1)}</label><input name="q"></form>'
        return f'<{(t := r.choice(["div", "div", "div", "aside", "section"]))} {attr or "class=" + names[0]}>{body}</{t}>'

    out = []
    for _ in range(count):
        inner = article()
        shape = r.choice(["<article data-main>{}</article>"] * 4 + ["<main data-main><article data-main>{}</article></main>", "<main data-main>{}</main>", '<div class="content" data-main>{}</div>', '<div id="main" data-main><div class="post-body" data-main>{}</div></div>', '<section class="entry" data-main>{}</section>', '<div class="story" data-main>{}</div>', *["<div data-main>{}</div>"] * 2, *["<div data-main><div data-main>{}</div></div>"] * 2, "<div data-main>" * (k := r.randint(3, 30)) + "{}" + "</div>" * k, "{}"])
        if shape == "{}":  # blocks right in the body
            inner = "".join(f"<div data-main>{sentence(r.randint(6, 20))}</div>" for _ in range(r.randint(1, 4))) if r.random() < 0.6 else inner
        before = [boilerplate(k) for k in ("nav", "header", "notice", "ad") if r.random() < 0.6]
        after = [boilerplate(k) for k in ("sidebar", "comments", "related", "share", "form", "footer", "ad", "notice") if r.random() < 0.5]
        r.shuffle(before)
        page = "".join(before) + shape.format(inner) + "".join(after)
        if r.random() < 0.2:
            page = f'<div class="{r.choice(["wrapper", "container", "page"])}" data-main>{page}</div>'
        out.append(f"<html><head><title>{words(3)}</title></head><body data-main>{page}" + r.choice(["</body></html>", "", "</body>"]))
    return out


def fit(pages: list[str], rounds: int = 300) -> Model:
    """Unary and pair potentials together, by maximum likelihood: the gradient is what the labels show less what the
    model expects, and the expectations are the exact marginals of sum-product over all pages' trees as one forest."""
    parent, depth, kind, label, feature_rows, feature_ids = [], [], [], [], [], []
    for page in pages:
        nodes = parse(page)
        nodes[0].mark = True
        first = len(parent)
        for i, (n, on) in enumerate(zip(nodes, node_features(nodes))):
            if n.tag == "#text":
                n.mark = nodes[n.parent].mark and nodes[n.parent].tag not in ("#root", "body")
            parent.append(first + n.parent if i else -1)
            depth.append(depth[parent[-1]] + 1 if i else 0)
            kind.append(int(n.tag == "#text"))
            label.append(int(n.mark))
            feature_rows += [first + i] * len(on)
            feature_ids += on
    parent, depth, kind, label = map(np.array, (parent, depth, kind, label))
    feature_rows, feature_ids = np.array(feature_rows), np.array(feature_ids)
    n = len(parent)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    inner = np.flatnonzero(parent >= 0)

    def expect(unary, pair):
        """Node marginals and, for every node with a parent, the joint marginal of the two labels."""
        belief = np.zeros((n, 2))
        np.add.at(belief[:, 1], feature_rows, unary[feature_ids])
        up = np.zeros((n, 2))
        table = pair[kind]  # node, parent's label, own label
        for at in reversed(levels):
            up[at] = np.logaddexp.reduce(table[at] + belief[at][:, None, :], axis=2)
            np.add.at(belief, parent[at], up[at])
        joint = np.zeros((n, 2, 2))
        for at in levels:
            both = table[at] + (belief[parent[at]] - up[at])[:, :, None] + belief[at][:, None, :]
            joint[at] = np.exp(both - np.logaddexp.reduce(both.reshape(len(at), 4), axis=1)[:, None, None])
            belief[at] += np.logaddexp.reduce(table[at] + (belief[parent[at]] - up[at])[:, :, None], axis=1)
        return 1 / (1 + np.exp(belief[:, 0] - belief[:, 1])), joint

    seen = np.bincount(feature_ids, label[feature_rows], WIDTH)
    shown = np.zeros((2, 2, 2))
    np.add.at(shown, (kind[inner], label[parent[inner]], label[inner]), 1)
    unary, pair = np.zeros(WIDTH), np.zeros((2, 2, 2))
    square_u, square_p = np.full(WIDTH, 1e-8), np.full((2, 2, 2), 1e-8)
    for _ in range(rounds):  # steps by Adagrad
        node, joint = expect(unary, pair)
        grad_u = (seen - np.bincount(feature_ids, node[feature_rows], WIDTH)) / n - 2e-5 * unary
        held = np.zeros((2, 2, 2))
        np.add.at(held, kind[inner], joint[inner])
        grad_p = (shown - held) / n - 2e-5 * pair
        square_u += grad_u**2
        square_p += grad_p**2
        unary += 0.4 * grad_u / np.sqrt(square_u)
        pair += 0.4 * grad_p / np.sqrt(square_p)
    return Model(unary, pair)


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or trained()

    def over(batches):
        for batch in batches:
            texts = [model.extract(h.as_py() or "") for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.selectExpr("cast(page_id as long) AS page_id", "cast(url as string) AS url", "cast(html as string) AS html")
    return slim.mapInArrow(over, "page_id long, url string, text string, n_chars long")
