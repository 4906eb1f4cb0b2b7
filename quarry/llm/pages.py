"""HTML extraction with a tree-structured graphical model.

A page is a tree of variables: its block elements, inline elements with names of their own, and its
runs of text. Each is *frame* (holds both kinds), *content* or *boilerplate*. A parent-child
potential gives a child's state by its parent's, its tag and whether it has names; names (class,
id, role) and the size and links of a run of text give each node's own potential. All are counts, smoothed, over labelled
pages. Sum-product messages pass upward, then downward, undamped; runs of text whose marginal of
content is at least one half are kept. No page of the corpus has labels, so the labelled pages are
written by ``labelled_pages``: layouts with and without article and main, menus, notices, adverts,
comments and forms in varied places and under varied names, and articles whose sections carry names
that sound like boilerplate. A name of several words that weren't all seen counts by itself, so
"share-price" doesn't weigh like "share"; names never seen say nothing.

An article's own header (its headline) is content, the page's header isn't.

Defined cases: null and empty html give empty text, plain text without tags is content; unclosed
tags close where HTML closes them, at the end of the page at last; self-closed svg and math are
empty; repeated rows give repeated rows; an empty table gives an empty one; extra columns are
ignored. A page is parsed whole, in time and memory in proportion to its length.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NEVER = frozenset("script style noscript template head title iframe object svg math select textarea button audio video canvas".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}
RAW = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
KEEPS_P_OPEN = INLINE | NEVER | {"input"}
#: Tags that don't part blocks.
FLOWS = INLINE | (NEVER - {"head", "title"}) | {"input"}
TAG = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]++|=)(\s*+=\s*+)?+")
UNQUOTED = re.compile(r"[^\s>]*+")
GAP = re.compile(r"[\s/]*+")
FRAME, CONTENT, BOILERPLATE = 0, 1, 2


class Tree:
    """Nodes in page order, parents before children: parent, tag, names, label; of runs of text also block, pieces, linked characters."""

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.label = [-1], ["#"], [()], [FRAME]
        self.text: dict[int, list] = {}
        self.stack = [("#", 0)]  # (tag, node its text belongs to)
        self.blocks = [0]  # places in the stack of all but inline elements
        self.places: dict[str, list[int]] = defaultdict(list)  # of open tags, by tag
        self.block, self.never, self.run, self.foreign, self.latest = 0, 0, None, 0, 0

    def _new(self, tag: str, names: tuple[str, ...], label: int | None) -> int:
        parent = self.stack[-1][1]
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(self.label[parent] if label is None else label)
        self.run = None
        return len(self.tag) - 1

    def _pop(self, place: int) -> None:
        any_node = self.stack[place - 1][1] != self.stack[-1][1]
        for tag, _ in reversed(self.stack[place:]):
            self.places[tag].pop()
            self.never -= tag in NEVER
            self.foreign -= tag in ("svg", "math")
            if tag not in FLOWS and not self.never:
                self.block += 1
        del self.stack[place:]
        while self.blocks[-1] >= place:
            self.blocks.pop()
        if any_node:
            self.run = None

    def read(self, html: str) -> None:
        """Tags and texts in order, each character looked at a bounded number of times. What an unclosed tag, quote or comment holds goes, as in HTML."""
        at, done, n = 0, 0, len(html)
        while (at := html.find("<", at)) >= 0:
            m = TAG.match(html, at + 1)
            if m is None and html[at + 1 : at + 2] not in ("/", "!", "?"):
                at += 1  # a sign, not a tag
                continue
            if done < at:
                self.on_text(unescape(html[done:at]))
            if m:
                at = self._start(html, m)
            elif html.startswith("<!--", at):
                end = at + 4 if html.startswith((">", "->"), at + 4) else html.find("-->", at + 4)
                at = n if end < 0 else html.find(">", end) + 1
            else:
                name, end = TAG.match(html, at + 2) if html[at + 1] == "/" else None, html.find(">", at)
                if name and end >= 0:
                    self.on_end(name[0].lower())
                at = n if end < 0 else end + 1
            done = at
        if done < n:
            self.on_text(unescape(html[done:]))

    def _start(self, html: str, m: re.Match) -> int:
        """Reads one start tag; where it ends."""
        tag, at, given, n = m[0].lower(), m.end(), [], len(html)
        while True:
            gap = GAP.match(html, at)
            at = gap.end()
            if at >= n:
                return n
            if html[at] == ">":
                break
            name = ATTRIBUTE.match(html, at)
            at, value = name.end(), ""
            if name[2]:
                if html[at : at + 1] in ("'", '"') and at < n:
                    end = html.find(html[at], at + 1)
                    if end < 0:
                        return n
                    value, at = html[at + 1 : end], end + 1
                else:
                    value = UNQUOTED.match(html, at)
                    value, at = value[0], value.end()
            given.append((name[1].lower(), value))
        closed = html[at - 1] == "/"
        at += 1
        inside = self.foreign or tag in ("svg", "math")
        self.on_start(tag, given)
        if closed and inside and tag not in VOID:
            self.on_end(tag)
        elif tag in RAW and not inside:
            end = RAW[tag].search(html, at)
            if end is None:
                return n
            return end.start()
        return at

    def on_start(self, tag: str, given: list[tuple[str, str]]) -> None:
        if tag == "br":
            self.on_text(" ")
            return
        if not self.never and (tag not in KEEPS_P_OPEN and tag not in VOID or tag == "hr"):
            while len(self.blocks) > 1:
                top = self.stack[self.blocks[-1]][0]
                if top != "p" and top not in CLOSES.get(tag, ()):
                    break
                self._pop(self.blocks[-1])
        if tag not in FLOWS and not self.never:
            self.block += 1
            self.run = None
        if tag in VOID:
            return
        node = self.stack[-1][1]
        if tag not in NEVER and not self.never:
            names = tuple(w for k, v in given if k in ("class", "id", "role") for w in unescape(v).lower().split())
            label = next((int(v) for k, v in given if k == "data-label"), None)
            if tag not in INLINE or names or label is not None:
                node = self._new("inline" if tag in INLINE else tag, names, label)
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, node))
        self.never += tag in NEVER
        self.foreign += tag in ("svg", "math")

    def on_end(self, tag: str) -> None:
        open_at = self.places.get(tag)
        if open_at and not (tag in INLINE and open_at[-1] < self.blocks[-1]):
            self._pop(open_at[-1])
        elif tag == "p":
            self.block += 1
            self.run = None

    def on_text(self, data: str) -> None:
        if self.never:
            return
        if self.run is None:
            if not data.strip():
                # blanks only join the words beside them
                if self.text and self.text[self.latest][0] == self.block:
                    self.text[self.latest][1].append(" ")
                return
            self.run = self.latest = self._new_run()
        entry = self.text[self.run]
        entry[1].append(data)
        entry[2] += len(data) if self.places.get("a") else 0

    def _new_run(self) -> int:
        node = self._new("#text", (), None)
        self.text[node] = [self.block, [], 0]
        return node


def parse(html: str) -> Tree:
    tree = Tree()
    tree.read(html)
    return tree


def labelled_pages(n: int = 400, seed: int = 3) -> Iterator[str]:
    """Pages with ``data-label``: 0 frame, 1 content, 2 boilerplate; elements without one are as their parents."""
    rng = random.Random(seed)
    syllables = "ka lo mi ter son vel da ru pen ost ing al".split()
    filler = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 4)))
    prose = lambda lo, hi: " ".join(filler() for _ in range(rng.randint(lo, hi))) + rng.choice([".", ".", "", "?"])
    links = lambda k, tag="li": "".join(f"<{tag}><a href='/{filler()}'>{prose(1, 3)}</a></{tag}>" for _ in range(k))
    # How pages name their parts.
    away = {
        "nav": "nav navbar menu main-menu site-nav nav-bar topbar navigation dropdown", "header": "header site-header masthead page-header banner branding top logo",
        "footer": "footer site-footer copyright legal page-footer contentinfo colophon bottom", "aside": "sidebar aside widget rail side-bar complementary right-column",
        "ad": "ad ads advert advertisement sponsored sponsor promo banner ad-slot ad-box promotion adsense", "notice": "cookie cookie-notice cookie-banner consent notice gdpr popup modal alert privacy overlay",
        "comments": "comments comment-list comment comment-section discussion responses disqus replies reader-comments", "share": "share social share-buttons social-links follow sharing",
        "related": "related related-posts recommended more-stories trending read-more see-also popular", "form": "newsletter subscribe search search-form login signup newsletter-signup subscription",
        "crumbs": "breadcrumb breadcrumbs pagination pager crumbs tags skip-link",
    }
    away = {k: v.split() for k, v in away.items()}
    here = "content article article-body post post-content entry entry-content main story story-body text page-content body-text prose main-content article-content".split()
    plain = "row col container wrapper inner section block box lead intro title headline row-1 grid item left".split()

    def names(known: list[str], share: float) -> str:
        if rng.random() > share:
            return ""
        name = rng.choice(known)
        if rng.random() < 0.12:
            name += f"-{rng.choice(known)}"
        if rng.random() < 0.12:
            name = rng.choice([f"{filler()}-{name}", f"{name}-{filler()}"])
        name += f" {rng.choice([filler(), rng.choice(plain)])}" if rng.random() < 0.2 else ""
        return f" {rng.choice(['class', 'class', 'class', 'id'])}='{name}'"

    def boiler(kind: str) -> str:
        share = 0.8
        body = {"nav": f"<ul>{links(rng.randint(2, 7))}</ul>", "crumbs": links(rng.randint(1, 4), "span"), "share": f"<ul>{links(rng.randint(2, 4))}</ul>", "related": f"<h3>{prose(1, 3)}</h3><ul>{links(rng.randint(2, 5))}</ul>"}.get(kind)
        if kind in ("header", "footer", "aside"):
            body = rng.choice([f"<p>{prose(2, 12)}</p>", prose(2, 10), f"<h2>{prose(1, 4)}</h2><p>{prose(3, 20)}</p>", f"<a href='/'>{prose(1, 2)}</a><ul>{links(4)}</ul>"])
        if kind in ("ad", "notice"):
            body = rng.choice([prose(2, 15), f"<p>{prose(3, 15)}</p>", f"<p>{prose(3, 10)} <a href='/x'>{prose(1, 2)}</a></p>"])
        if kind == "comments":
            body = f"<h3>{prose(1, 2)}</h3>" + "".join(rng.choice([f"<div class='comment'><p>{prose(2, 30)}</p></div>", f"<p>{prose(2, 40)}</p>", f"<li><b>{filler()}</b> {prose(2, 20)}</li>"]) for _ in range(rng.randint(1, 4)))
        if kind == "form":
            body = f"<label>{prose(1, 3)}</label><input><p>{prose(2, 8)}</p>"
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if tag is None or rng.random() < 0.4 and kind != "form":
            tag, share = rng.choice(["div", "div", "div", "section", "ul", "aside", "p"] if kind in ("ad", "notice") else ["div", "div", "section", "ul" if kind in ("nav", "share", "crumbs") else "div"]), 0.97
        if kind in ("nav", "header", "footer", "aside") and tag == kind and rng.random() < 0.1:
            share = 1.0
            role = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary"}[kind]
            return f"<{tag} data-label=2 role={role}>{body}</{tag}>"
        return f"<{tag} data-label=2{names(away[kind], share)}>{body}</{tag}>"

    def trap() -> str:
        """Names of parts of an article: none, plain, or such that sound like boilerplate."""
        x = rng.random()
        if x < 0.4:
            return ""
        if x < 0.75:
            return names([filler(), filler(), *plain], 1)
        word = rng.choice([w for v in away.values() for w in v] + here)
        return f" class='{rng.choice([f'{word}-{filler()}', f'{filler()}-{word}'])}'"

    def piece(depth: int = 0) -> str:
        x = rng.random()
        if x < 0.5 or depth > 2:
            size = rng.choice([(1, 2), (2, 8), (10, 40), (20, 80)])
            if rng.random() < 0.06:
                return rng.choice([f"<p><a href='/z'>{prose(1, 5)}</a></p>", f"<ul>{links(rng.randint(1, 3))}</ul>"])
            middle = rng.choice(["", "", f" <a href='/y'>{prose(1, 3)}</a> {prose(0, 5)}", f" <b>{prose(1, 3)}</b>", f" <span class='{filler()}'>{prose(1, 2)}</span>"])
            return f"<p{trap()}>{prose(*size)}{middle}{rng.choice(['</p>', '</p>', ''])}"
        if x < 0.58:
            return f"<h2{trap()}>{prose(1, 6)}</h2>"
        if x < 0.64:
            return "<ul>" + "".join(f"<li>{prose(1, 12)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if x < 0.68:
            return rng.choice([f"<blockquote>{prose(4, 30)}</blockquote>", f"<pre>{prose(2, 20)}</pre>", f"<figure><img><figcaption>{prose(2, 9)}</figcaption></figure>", f"<table><tr><td>{prose(1, 4)}</td><td>{prose(1, 4)}</td></tr></table>", f"<dl><dt>{prose(1, 2)}<dd>{prose(2, 9)}</dl>"])
        tag = rng.choice(["div", "section", "div"])
        return f"<{tag}{trap()}>" + "".join(piece(depth + 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    def article(bare: bool = False) -> str:
        out = [rng.choice([f"<h1{trap()}>{prose(2, 9)}</h1>", f"<header{trap()}><h1>{prose(2, 9)}</h1></header>", f"<h1>{prose(2, 9)}</h1>", ""])]
        out += [piece() for _ in range(rng.randint(1, 9))]
        if bare:  # the parts stand in the page's frame
            out = [re.sub(r"^<(\w+)", r"<\1 data-label=1", x) for x in out]
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            out.insert(rng.randint(0, len(out)), boiler(rng.choice(["ad", "share", "related", "comments", "form", "aside", "notice", "nav", "footer", "crumbs"])))
        return "".join(out)

    for _ in range(n):
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section", ""])
        core = article(bare=not tag)
        inner = f"<{tag} data-label=1{names(here, 0.5 if tag in ('div', 'section') else 0.25)}>{core}</{tag}>" if tag else core
        for _ in range(rng.choice([0, 1, 1, 2, 3]) if tag else 0):
            wrap = rng.choice(["div", "div", "main", "section"])
            beside = [boiler(rng.choice(["aside", "ad", "related", "comments", "crumbs"])) for _ in range(rng.choice([0, 0, 0, 1, 1, 2]))]
            beside.insert(rng.randint(0, len(beside)), inner)
            inner = f"<{wrap} data-label={0 if len(beside) > 1 else 1}{names(plain + here, 0.5)}>{''.join(beside)}</{wrap}>"
        above = [boiler(k) for k in ("notice", "header", "nav", "ad", "crumbs") if rng.random() < 0.4]
        below = [boiler(k) for k in ("comments", "related", "form", "aside", "footer") if rng.random() < 0.4]
        yield f"<html><body data-label=0>{''.join(above)}{inner}{''.join(below)}</body></html>"


def evidence(names: tuple[str, ...], known: frozenset[str]) -> set[str]:
    """Names that are known; of others their known words, marked by whether all are."""
    out = set()
    for name in names:
        if name in known:
            out.add(name)
        else:
            parts = re.findall(r"[a-z]+", name)
            mark = "+" if all(p in known for p in parts) else "~"
            out.update(mark + p for p in parts if p in known)
    return out


def run_shape(text: str, linked: int) -> str:
    n = len(text.split())
    size = sum(n >= k for k in (2, 5, 10, 25))
    share = linked / max(1, len(text))
    return f"{size} {sum(share > k for k in (0, 0.6))}"


def _kind(tree: Tree, i: int) -> tuple[str, bool]:
    """What chooses a node's parent-child potential: its tag and whether it has names."""
    return tree.tag[i], bool(tree.names[i])


class Model:
    """Log potentials, from counts over labelled pages."""

    def __init__(self, pages: Iterator[str]):
        trees = [parse(p) for p in pages]
        words = Counter(w for t in trees for ns in t.names for w in {x for n in ns for x in (n, *re.findall(r"[a-z]+", n))})
        self.known = frozenset(p for p, n in words.items() if n >= 5)
        pair, any_tag = defaultdict(lambda: [[0.0] * 3 for _ in range(3)]), [[0.1] * 3 for _ in range(3)]
        seen, shapes = (defaultdict(lambda: [0.0] * 3) for _ in range(2))
        elements, runs = [0.0] * 3, [0.0] * 3
        for t in trees:
            for i in range(1, len(t.tag)):
                y = t.label[i]
                if i in t.text:
                    y = BOILERPLATE if y == BOILERPLATE else CONTENT
                    shapes[run_shape("".join(t.text[i][1]), t.text[i][2])][y] += 1
                    runs[y] += 1
                pair[_kind(t, i)][t.label[t.parent[i]]][y] += 1
                if t.tag[i] != "#text":
                    any_tag[t.label[t.parent[i]]][y] += 1
                    if y != t.label[t.parent[i]] or y != BOILERPLATE:  # within boilerplate nothing need be named
                        elements[y] += 1
                        for w in evidence(t.names[i], self.known):
                            seen[w][y] += 1
        rate = lambda row: [math.log(x / sum(row)) for x in row]
        self.other = [rate(r) for r in any_tag]
        back = [[2.0 * x / sum(r) for x in r] for r in any_tag]
        self.pair = {tag: [rate([x + b for x, b in zip(row, prior)]) for row, prior in zip(rows, back)] for tag, rows in pair.items()}
        # a run of text is one of two kinds; a frame's own text may be either
        of_text = pair["#text", False]
        self.pair["#text", False] = [[-30.0, math.log(0.5), math.log(0.5)], rate([1e-9, sum(of_text[CONTENT]), 0.5]), rate([1e-9, 0.5, sum(of_text[BOILERPLATE])])]
        self.word = {w: [math.log((c[y] + 0.3) / (elements[y] + 1)) for y in range(3)] for w, c in seen.items()}
        self.shape = {s: [0.0, math.log((c[1] + 1) / (runs[1] + 15)), math.log((c[2] + 1) / (runs[2] + 15))] for s, c in shapes.items()}


@lru_cache(1)
def model() -> Model:
    return Model(labelled_pages())


def _sum(a: float, b: float, c: float) -> float:
    m = a if a > b else b
    m = c if c > m else m
    return m + math.log(math.exp(a - m) + math.exp(b - m) + math.exp(c - m))


def marginals(tree: Tree, m: Model) -> dict[int, float]:
    """P(content) of each run of text, by sum-product in log space."""
    n = len(tree.tag)
    own = [[0.0, 0.0, 0.0] for _ in range(n)]
    own[0] = [0.0, -3.0, -6.0]
    for i in range(1, n):
        if i in tree.text:
            own[i] = list(m.shape.get(run_shape("".join(tree.text[i][1]), tree.text[i][2]), (0.0, 0.0, 0.0)))
        else:
            for w in evidence(tree.names[i], m.known):
                if w in m.word:
                    own[i] = [a + b for a, b in zip(own[i], m.word[w])]
    pairs = [m.pair.get(_kind(tree, i), m.other) for i in range(n)]
    up, message = [x[:] for x in own], [None] * n
    for i in range(n - 1, 0, -1):
        a, b, c = up[i]
        got = [_sum(r[0] + a, r[1] + b, r[2] + c) for r in pairs[i]]
        top = max(got)
        message[i] = got = [x - top for x in got]
        to = up[tree.parent[i]]
        to[0] += got[0]
        to[1] += got[1]
        to[2] += got[2]
    belief, out = up, {}
    for i in range(1, n):
        at, got, p = belief[tree.parent[i]], message[i], pairs[i]
        x, y, z = at[0] - got[0], at[1] - got[1], at[2] - got[2]
        down = [_sum(p[0][s] + x, p[1][s] + y, p[2][s] + z) for s in range(3)]
        mine = [u + d for u, d in zip(up[i], down)]
        top = max(mine)
        belief[i] = [v - top for v in mine]
        if i in tree.text:
            e = [math.exp(v) for v in belief[i]]
            out[i] = e[CONTENT] / sum(e)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = parse(html)
    p = marginals(tree, model())
    blocks: dict[int, list[str]] = {}
    for node, (block, pieces, _) in tree.text.items():
        if p[node] >= 0.5:
            blocks.setdefault(block, []).extend(pieces)
    joined = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in joined if x)


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        text = [main_text(h) for h in f.html]
        yield pd.DataFrame({"page_id": f.page_id, "url": f.url, "text": text, "n_chars": [len(t) for t in text]})


def report(pages: DataFrame) -> DataFrame:
    # ids travel as strings: beside a null one, pandas would round large ones
    out = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(_rows, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
