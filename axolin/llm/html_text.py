"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree of block elements and runs of inline text. Each node has figures on its subtree (text and
link density, sizes, counts of paragraphs and controls), its tag, the tokens of its class, id and role, its depth, its
place among its siblings, the same for the element that holds it, and tags and tokens over its ancestors. Boosted trees give the log odds that a node belongs
to the main text (a container does if anything in it does). A dynamic program then picks the best consistent choice
over the tree: below a dropped node everything is dropped, and a kept node has all its ancestors kept.

The trees are trained here on pages that page_maker() invents, of many layouts, with known main text; training takes
a few seconds on the driver and does not depend on the data. Scripts, styles and other invisible elements are never
text; formulas and drawings are read as inline text. Extraction is a map over rows without a shuffle.

Defined results: null html is an empty page; a page without main text gives an empty text; broken markup is read as
far as it goes (open elements end with the page); equal pages and repeated rows give equal texts, a row for each; long
pages are read whole, in time and memory in proportion to their length however deep elements nest; between choices of
equal likelihood the one that keeps less is taken; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.llm.boosting import Trees, fit
from axolin.llm.common import table

INVISIBLE = frozenset("head title script style noscript template annotation annotation-xml desc metadata defs iframe object canvas audio video select datalist button textarea".split())
#: Elements whose inner elements are inline, until one that can't stand in them.
FOREIGN = frozenset("math svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements that stand in a head, without and with content. Any other start tag, or text, ends a head that is open.
HEAD_VOID = frozenset("html head meta link base basefont bgsound".split())
HEAD_CONTENT = frozenset("title style script noscript noframes template".split())
#: An opening tag of the key's group ends open elements of the named kinds.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section body html".split())

TAGS = {t: k for k, group in enumerate(("p pre blockquote", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol menu dl", "li dt dd", "table tbody thead tfoot tr", "td th", "article main", "section div center", "nav", "header", "footer", "aside", "form fieldset label", "figure figcaption", "body html", "#run", "details summary dialog address")) for t in group.split()}
N_TAGS = max(TAGS.values()) + 2
#: Tokens of class, id and role attributes, by what they tell.
TOKENS = {t: k for k, group in enumerate((
    "content article post entry main body story text page prose markdown maincontent articlebody",
    "nav menu navigation navbar breadcrumb breadcrumbs toc pagination pager tabs topnav skip links sitemap",
    "header masthead banner topbar logo brand head",
    "footer foot copyright legal colophon bottom disclaimer",
    "sidebar aside side widget rail related recommended popular trending more promo secondary complementary",
    "ad ads advert adverts advertisement advertising sponsor sponsored adsense dfp",
    "cookie cookies consent gdpr notice notices alert popup modal overlay privacy warning announcement paywall",
    "comment comments reply replies respond discussion disqus feedback thread commentlist reviews",
    "share social follow twitter facebook sharing like likes print",
    "form login signup subscribe newsletter search searchbox contact register subscription email",
    "meta byline author date tags tag category info",
)) for t in group.split()}
N_TOKENS = max(TOKENS.values()) + 1
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parts", "kids", "up", "tokens", "text", "links", "controls", "index", "mark")

    def __init__(self, tag: str, up: Node | None, tokens: int = 0):
        self.tag, self.up, self.tokens = tag, up, tokens
        self.kids: list[Node] = []
        self.parts: list[str] | None = None  # an open run of inline text
        self.text, self.links, self.controls, self.index, self.mark = "", 0, 0, 0, None


def token_bits(attributes: list[tuple[str, str | None]]) -> int:
    bits = 0
    for name, value in attributes:
        if name in ("class", "id", "role", "itemprop", "aria-label") and value:
            for w in _WORD.findall(value):
                k = TOKENS.get(w.lower())
                if k is not None:
                    bits |= 1 << k
    return bits


class Builder(HTMLParser):
    """A tree of block elements; inline text gathers in runs, which are leaves. For each tag the depths of its open
    elements are kept, so that no tag walks up further than the elements it ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.path, self.open = [self.root], {}
        self.hidden, self.run, self.linked, self.foreign = [], None, False, None

    @property
    def at(self) -> Node:
        return self.path[-1]

    def _end_run(self) -> None:
        if self.run is not None:
            text = " ".join("".join(self.run.parts).split())
            self.run.parts = None
            if text:
                self.run.text = text
                self.at.kids.append(self.run)
            self.run = None

    def _depth(self, tags: frozenset | set) -> int:
        """The depth of the innermost open element of these tags, 0 without one."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _leave(self, depth: int) -> None:
        """End the elements from that depth on."""
        self._end_run()
        while len(self.path) > depth:
            self.open[self.path.pop().tag].pop()

    def _close(self, tags: frozenset | set, stop: frozenset | set) -> None:
        depth = self._depth(tags)
        if depth and depth > self._depth(stop - tags):
            self._leave(depth)

    def _hidden_start(self, tag: str) -> bool:
        """Whether the tag stands in an invisible element. A head ends where something that can't stand in it begins."""
        if not self.hidden:
            return False
        if (tag == "body" and self.hidden[0] == "head") or (self.hidden[-1] == "head" and tag not in HEAD_VOID | HEAD_CONTENT):
            self.hidden.clear()
            return False
        if tag == self.hidden[-1] or (self.hidden[-1] == "head" and tag in HEAD_CONTENT):
            self.hidden.append(tag)
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._hidden_start(tag):
            return
        if tag in INVISIBLE:
            self.at.controls += tag in ("select", "button", "textarea")
            self.hidden.append(tag)
            return
        if tag in FOREIGN:
            self.foreign = self.foreign or tag
            return
        if self.foreign:
            if tag not in ENDS_P and tag not in CLOSES and tag not in ("html", "body"):
                return
            self.foreign = None
        if tag in INLINE:
            if tag == "a":
                self.linked = True
            elif tag == "input":
                self.at.controls += 1
            if tag in ("br", "img", "input"):
                self._add(" ")
            return
        self._end_run()
        self.linked = False
        if tag in ("html", "body"):
            self.root.tokens |= token_bits(attrs)
            return
        if tag in ENDS_P:
            self._close({"p"}, SCOPES | {"td", "th", "li"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES - {"table"} if tag == "tr" else SCOPES)
            if tag == "tr":
                self._close({"tr"}, {"table"})
        if tag in VOID:
            return
        node = Node(tag, self.at, token_bits(attrs))
        self.at.kids.append(node)
        self.open.setdefault(tag, []).append(len(self.path))
        self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in INVISIBLE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            # the innermost one, or the head around it: inner elements are all of one tag
            if tag == self.hidden[-1]:
                self.hidden.pop()
            elif tag == self.hidden[0]:
                self.hidden.clear()
            return
        if tag == self.foreign:
            self.foreign = None
            return
        if tag == "a":
            self.linked = False
        if tag in INLINE or tag in ("html", "body"):
            return
        depth = self._depth({tag})
        if depth:
            self._leave(depth)
            self.linked = False

    def _add(self, data: str) -> None:
        if self.run is None:
            self.run = Node("#run", self.at)
            self.run.parts = []
        self.run.parts.append(data)
        if self.linked:
            self.run.links += len(data)

    def handle_data(self, data: str) -> None:
        if self.hidden and self.hidden[-1] == "head" and data.strip():
            self.hidden.clear()
        if not self.hidden:
            self._add(data)


def parse(html: str | None) -> Node:
    """The tree of a page. Each run of text is a leaf below the element that holds it."""
    b = Builder()
    b.feed(html or "")
    b.close()
    b._end_run()
    return b.root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order; sets their index."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        n.index = len(out)
        out.append(n)
        stack += reversed(n.kids)
    return out


#: Elements that give the nodes below them their context.
HOLDERS = frozenset("article main section div center nav header footer aside form table ul ol dl blockquote figure body html details dialog fieldset".split())
_HOLDER_FIGURES = 7
N_FEATURES = 3 * N_TAGS + 3 * N_TOKENS + 15 + _HOLDER_FIGURES


def alone(d: Node) -> bool:
    """A run that is all an element holds is kept or dropped with the element."""
    return d.tag == "#run" and len(d.up.kids) == 1


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    chars, links, controls, runs, paras, size, stops = (np.zeros(n) for _ in range(7))
    up = np.array([-1 if d.up is None else d.up.index for d in nodes])
    for k in range(n - 1, -1, -1):
        d = nodes[k]
        size[k] += 1
        controls[k] += d.controls
        if d.tag == "#run":
            chars[k], links[k], runs[k], stops[k] = len(d.text), min(d.links, len(d.text)), 1, d.text.count(". ") + d.text.endswith((".", "!", "?"))
        paras[k] += d.tag == "p"
        if k:
            for a in (chars, links, controls, runs, paras, size, stops):
                a[up[k]] += a[k]
    total = max(1.0, chars[0])
    tags = np.array([TAGS.get(d.tag, N_TAGS - 1) for d in nodes])
    own = np.array([d.tokens for d in nodes])
    holder, depth, above, above_tags = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    first, last, p_share, before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    seen = 0.0
    for k, d in enumerate(nodes):
        if k:
            u = up[k]
            depth[k], above[k], above_tags[k] = depth[u] + 1, above[u] | own[u], above_tags[u] | 1 << tags[u]
            holder[k] = u if d.up.tag in HOLDERS else holder[u]
        before[k] = seen / total
        seen += len(d.text)
        if d.kids:
            share = sum(c.tag == "p" for c in d.kids) / len(d.kids)
            for i, c in enumerate(d.kids):
                first[c.index], last[c.index], p_share[c.index] = i, len(d.kids) - 1 - i, share
    bits = lambda x, m: (x[:, None] >> np.arange(m)) & 1
    figures = np.stack([np.log1p(chars), links / np.maximum(1, chars), np.log1p(chars / np.maximum(1, size)), np.log1p(paras), np.log1p(controls), np.log1p(size), chars / total, np.log1p(chars / np.maximum(1, runs)), stops / np.maximum(1, chars) * 100, first, last, p_share, depth, before, np.full(n, np.log1p(total))], axis=1)
    return np.concatenate([bits(1 << tags, N_TAGS), bits(1 << tags[holder], N_TAGS), bits(above_tags, N_TAGS), bits(own, N_TOKENS), bits(own[holder], N_TOKENS), bits(above, N_TOKENS), figures, figures[holder, :_HOLDER_FIGURES]], axis=1).astype(np.float32)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the consistent choice of greatest log likelihood, with at least the root kept."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    with_parent = np.array([k > 0 and alone(d) for k, d in enumerate(nodes)])
    yes[with_parent], no[with_parent] = 0, -1e-9
    n = len(nodes)
    keep, drop = yes.copy(), no.copy()
    for k in range(n - 1, 0, -1):
        u = nodes[k].up.index
        drop[u] += drop[k]
        keep[u] += max(keep[k], drop[k])
    kept = np.zeros(n, bool)
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[nodes[k].up.index] and keep[k] > drop[k]
    return kept


def joined(nodes: list[Node], kept: np.ndarray) -> str:
    return "\n".join(d.text for d, ok in zip(nodes, kept, strict=True) if ok and d.tag == "#run")


_SYLLABLES = "an the ing er on re ti es ou nd ha le ion ment que ich ung der ció ar os ña tz".split()


def page_maker(seed: int) -> tuple[str, str]:
    """An invented page and its main text: varied containers, boilerplate around and inside, semantic tags or divs."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=1, b=18: words(a, b).capitalize() + "."
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    pick = r.choice
    kept: list[str] = []

    def main(tag: str, text: str) -> str:
        kept.append(text)
        inner = text
        if r.random() < 0.15:
            a, _, b = text.partition(" ")
            inner = f"<{(t := pick(('b', 'em', 'i', 'strong', 'span')))}>{a}</{t}> {b}" if b else text
        if r.random() < 0.1 and " " in text:
            a, _, b = text.rpartition(" ")
            inner = f'{a} <a href="/x">{b}</a>'
        end = "" if tag == "p" and r.random() < 0.1 else f"</{tag}>"
        return f"<{tag}>{inner}{end}"

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(n)]
        return pick((lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<span>{i}</span> " for i in items)))()

    def named(tags: str, names: str, inner: str) -> str:
        t = pick(tags.split())
        t = "div" if t == "p" and any(x in inner for x in ("<p", "<ul", "<h")) else t
        name = pick(names.split())
        mark = "" if t in ("nav", "header", "footer", "aside") and r.random() < 0.6 else f' {pick(("class", "id", "class"))}="{pick((name, name, f"{word()} {name}", f"site-{name}", f"{name}_{word()}"))}"'
        return f"<{t}{mark}>{inner}</{t}>"

    def comments() -> str:
        one = lambda: named("div li article", "comment reply comment-body", f"<p>{prose(1, 3)}</p>" if r.random() < 0.7 else f"<b>{word()}</b> {prose(1, 3)}")
        return named("div section ol aside", "comments commentlist discussion responses-comments", (f"<h{pick('234')}>{words(1, 3)}</h3>" if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 6))))

    small = {
        "nav": lambda: named("nav nav div ul", "nav menu navigation breadcrumb navbar", links(r.randint(2, 9))),
        "header": lambda: named("header header div", "header masthead topbar banner site-header", f"<{(t := pick(('h1', 'h2', 'p', 'div', 'span')))}>{words(1, 5)}</{t}>" + (links(r.randint(1, 5)) if r.random() < 0.5 else f"<p>{sentence()}</p>" * (r.random() < 0.4))),
        "footer": lambda: named("footer footer div", "footer foot site-footer copyright legal", pick((lambda: f"&copy; {word()} &middot; {sentence()}", lambda: f"<p>&copy; {words(2, 6)}</p>" + links(r.randint(1, 5)), lambda: f"<p>{prose(1, 3)}</p>"))()),
        "aside": lambda: named("aside aside div section", "sidebar related widget popular recommended side promo", f"<h{(h := pick('234'))}>{words(1, 3)}</h{h}>" * (r.random() < 0.6) + pick((lambda: links(r.randint(2, 7)), lambda: f"<p>{prose(1, 3)}</p>", lambda: f"<ul><li>{sentence()}</li><li>{sentence()}</li></ul>"))()),
        "ad": lambda: named("div div section aside p", "ad ads advert advertisement sponsored ad-banner", pick((lambda: prose(1, 3), lambda: f"<p>{prose(1, 2)}</p>", lambda: f'<a href="/buy">{words(2, 6)}</a> {sentence()}'))()),
        "notice": lambda: named("div div section aside p", "cookie cookie-banner consent notice alert gdpr popup", pick((lambda: prose(1, 3), lambda: f"<p>{prose(1, 2)}</p><button>{word()}</button>", lambda: f"<p>{prose(1, 3)}</p>"))()),
        "form": lambda: f"<form{pick(('', ' class=search', ' id=subscribe'))}><label>{words(1, 4)}</label><input name=q>" + (f"<p>{sentence()}</p>" if r.random() < 0.5 else "") + f"<button>{word()}</button></form>" if r.random() < 0.6 else named("div section", "newsletter subscribe signup login", f"<h3>{words(1, 4)}</h3><p>{sentence()}</p><form><input><button>{word()}</button></form>"),
        "share": lambda: named("div ul p", "share social follow", links(r.randint(2, 5))),
        "comments": comments,
    }
    body_parts = []
    for _ in range(r.choice((1, 2, 4, 8, 14))):
        kind = r.random()
        if kind < 0.72:
            body_parts.append(lambda: main("p", prose()))
        elif kind < 0.82:
            body_parts.append(lambda: main(f"h{pick('23')}", words(2, 8)))
        elif kind < 0.88:
            body_parts.append(lambda: f"<{(t := pick(('ul', 'ol')))}>" + "".join(main("li", sentence()) for _ in range(r.randint(2, 5))) + f"</{t}>")
        elif kind < 0.92:
            body_parts.append(lambda: "<blockquote>" + main("p", prose(1, 3)) + "</blockquote>" if r.random() < 0.6 else main("blockquote", prose(1, 2)))
        elif kind < 0.95:
            body_parts.append(lambda: main("pre", words(3, 12)))
        elif kind < 0.97:
            body_parts.append(lambda: "<table>" + "".join("<tr>" + main("td", words(1, 4)) + main("td", words(1, 4)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
        else:
            body_parts.append(lambda: "<figure><img src=x>" + main("figcaption", sentence()) + "</figure>")
    inside = [pick(("ad", "share", "form", "aside", "notice", "nav")) for _ in range(r.choice((0, 0, 0, 1, 2)))]
    inside = [(r.randint(0, len(body_parts)), small[k]) for k in inside]
    out = []
    title = (lambda: main(pick(("h1", "h1", "h2")), words(2, 9)),) if r.random() < 0.8 else ()
    for part in title:
        t = part()
        out.append(f"<header>{t}</header>" if r.random() < 0.15 else t)
    for i, part in enumerate(body_parts):
        out += [make() for at, make in inside if at == i]
        out.append(part())
    out += [make() for at, make in inside if at == len(body_parts)]
    if r.random() < 0.15:
        out.append(comments())
    inner = "".join(out)
    holder = r.random()
    if holder < 0.5:
        core = f"<article{pick(('', '', ' class=post', ' id=story'))}>{inner}</article>"
    elif holder < 0.62:
        core = inner
    elif holder < 0.72:
        core = f"<main{pick(('', ' id=content'))}>{inner}</main>"
    else:
        core = f'<{(t := pick(("div", "div", "section")))} {pick(("class", "id"))}="{pick(("content", "post-body", "entry-content", "article-body", "main", "story text", word()))}">{inner}</{t}>'
    for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
        core = f"<{(t := pick(('div', 'main', 'section', 'div')))}{pick(('', f' class={word()}', ' id=wrap', ' class=page'))}>{core}</{t}>"
    plain = r.random() < 0.08  # a page of nothing but the text
    before = [small[k]() for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.4 and not plain]
    after = [small[k]() for k in ("comments", "aside", "share", "ad", "form", "nav", "notice") if r.random() < 0.25 and not plain] + ([small["footer"]()] if r.random() < 0.8 and not plain else [])
    r.shuffle(before)
    if r.random() < 0.03:
        core, kept = "", []
    head = f"<head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.8 else ""
    page = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{core}{''.join(after)}" + ("</body></html>" if r.random() < 0.9 else "")
    return page, "\n".join(kept)


def labelled(page: str, text: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of an invented page; 1 for the runs whose texts, in order, are the main text, and for what holds them."""
    nodes = nodes_of(parse(page))
    wanted, k, y = text.split("\n") if text else [], 0, np.zeros(len(nodes))
    for d in nodes:
        if k < len(wanted) and d.tag == "#run" and d.text == wanted[k]:
            k += 1
            while d is not None and not y[d.index]:
                y[d.index] = 1
                d = d.up
    return nodes, y


TRAIN_PAGES = 1000


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES) -> Trees:
    rows = [labelled(*page_maker(seed)) for seed in range(pages)]
    own = np.concatenate([[k == 0 or not alone(d) for k, d in enumerate(n)] for n, _ in rows])
    return fit(np.concatenate([features(n) for n, _ in rows])[own], np.concatenate([y for _, y in rows])[own])


def main_texts(htmls: list[str | None], model: Trees) -> list[str]:
    trees = [nodes_of(parse(h)) for h in htmls]
    odds = model.margin(np.concatenate([features(n) for n in trees])) if trees else np.zeros(0)
    out, at = [], 0
    for n in trees:
        out.append(joined(n, decode(n, odds[at : at + len(n)])))
        at += len(n)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 50):
                part = b.slice(k, 50)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
