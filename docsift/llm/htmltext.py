"""Operator 10: main text of HTML pages, by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks of text between block-level tags. Features of a block are the tags and class words of its
ancestors and properties of its text; neighbouring blocks are tied by transition weights. The field is trained by
stochastic gradient descent on labelled pages (the tables carry no such labels, so ``labelled_pages`` makes a bounded
set of varied page layouts whose parts are known) and decoded by Viterbi. What it labels main is joined in page order.

Defined cases: null and empty html, and pages without text, give an empty text; unclosed and stray tags are repaired as
browsers do; a script, style or title ends at its own end tag only; scripts, styles, comments, titles and unfinished
tags hold no text; a null page_id or url stays null; ties of labels go to "other"; repeated pages give equal results;
empty input gives an empty result. Only page_id, url and html are read: extra columns, whatever their names, do not
reach the result. Nothing is capped: a page is read once, in time that grows with its length, and memory follows the
longest page.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import small_batches, table

#: A comment, CDATA section, declaration or tag. Its parts exclude one another and give nothing back, so that a search
#: reads a character once; a quotation counts after ``=`` only.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+)>""", re.S)
#: The same for pages with a quotation that runs beyond all tags: there a tag ends at the next ``>``.
_PLAIN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_OPENS = re.compile("<(?=[!?]|/?[a-zA-Z])")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Fixed values of HTML: elements without an end tag, elements whose content is not text, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("template svg object canvas audio video annotation annotation-xml".split())
#: Elements in which nothing but their own end tag is markup; the text of none of them is read.
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in "script style noscript iframe title textarea xmp noembed noframes".split()}
#: Those of them that hold the rest of a page if they do not end; of the others the start tag is then ignored.
ENDLESS = frozenset("script style".split())
MATH = frozenset("math semantics mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded mphantom merror".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
#: A start tag of the key closes an open element of the values, unless one of the stops lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
STOPS = frozenset("ul ol dl table tbody thead tfoot select div section article main aside nav form body".split())

#: Words of class and id names, by what they say of a block.
CLASS_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs sitemap skip",
    "header": "header masthead banner topbar logo branding toolbar hero",
    "footer": "footer foot copyright legal colophon bottom imprint",
    "side": "sidebar side aside rail widget related recommended recommend trending popular more teaser",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted affiliate banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall message warning",
    "comment": "comment comments commentlist reply replies respond disqus discussion reviews feedback",
    "social": "share sharing social follow like tweet print tools meta byline tags",
    "form": "form search login register input contact",
    "main": "article content main post entry story body text prose page hentry blog",
}
_CLASS_OF: dict[str, list[str]] = {}
for _kind, _words in CLASS_WORDS.items():
    for _w in _words.split():
        _CLASS_OF.setdefault(_w, []).append(_kind)


class Block:
    __slots__ = ("path", "text", "linked", "at")

    def __init__(self, path: tuple, text: str, linked: int, at: int):
        self.path, self.text, self.linked, self.at = path, text, linked, at


@lru_cache(20_000)
def _names(attributes: str) -> tuple[str, ...]:
    """What the class, id and role of an element say."""
    kinds = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value:
            kinds.add("hidden")
        for word in _WORD.findall(value.lower()) if name in ("class", "id", "role") else ():
            kinds.update(_CLASS_OF.get(word, ()))
            if word in ("main", "article", "navigation", "contentinfo", "complementary", "banner", "search", "dialog") and name == "role":
                kinds.add("role-" + word)
    return tuple(sorted(kinds))


def _tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is an end tag, name, attributes) of all markup; the name is empty for what is no tag. The content of
    a raw element belongs to its start tag. One pass: what does not end is looked for once."""
    at, pattern, endless = 0, _TOKEN, set()
    while opens := _OPENS.search(page, at):
        found = pattern.match(page, opens.start())
        if not found and pattern is _TOKEN:  # a quotation that never ends, or a tag that never does
            pattern = _PLAIN
            found = pattern.match(page, opens.start())
        if not found:  # no further tag ends
            yield opens.start(), len(page), False, "", ""
            return
        at, name = found.end(), (found.group(2) or "").lower()
        if name in END and not found.group(1):
            close = None if name in endless or found.group(3).endswith("/") else END[name].search(page, at)
            if close:
                at = close.end()
            elif not found.group(3).endswith("/"):
                endless.add(name)
                at = len(page) if name in ENDLESS else at
        yield found.start(), at, bool(found.group(1)), name, found.group(3) or ""


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Each has the (tag, names) of its ancestors and its share of linked text."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    pieces: list[str] = []
    linked, links, hidden, last, begun, filled = 0, 0, 0, 0, 0, False

    def flush() -> None:
        nonlocal linked, filled
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(tuple(x for x in stack if x[0] not in INLINE), text, linked, begun))
            pieces.clear()
        linked, filled = 0, False

    def read(raw: str, at: int) -> None:
        nonlocal linked, filled, begun
        piece = html.unescape(raw) if "&" in raw else raw
        if not filled and not piece.isspace():
            begun, filled = at, True
        pieces.append(piece)
        if links:
            linked += len(piece)

    def close(tag: str, stops=frozenset()) -> None:
        nonlocal links, hidden
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                links -= sum(x[0] == "a" for x in stack[k:])
                hidden -= sum(x[0] in HIDDEN for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in stops:
                return

    for start, end, ending, tag, attributes in _tokens(page):
        if start > last and not hidden:
            read(page[last:start], last)
        last = end
        if not tag or tag == "head":
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in END or tag in VOID:
            continue
        if ending:
            close(tag)
            continue
        if tag in CLOSES:
            for other in CLOSES[tag]:
                close(other, STOPS - {tag})
        elif tag not in INLINE and tag not in HIDDEN:
            close("p", STOPS)
        if attributes.endswith("/") and (tag in HIDDEN or hidden or tag in MATH):
            continue
        stack.append((tag, _names(attributes) if attributes else ()))
        links += tag == "a"
        hidden += tag in HIDDEN
    if last < len(page) and not hidden:
        read(page[last:], last)
    flush()
    return out


def _marks_main(path: tuple) -> bool:
    return any(tag in ("article", "main") or "main" in names for tag, names in path)


@lru_cache(20_000)
def path_features(path: tuple, marked: bool) -> tuple[str, ...]:
    """marked: whether the page names its main part; if so, what lies outside of it is told by that, else by the text."""
    tags, found = [t for t, _ in path], set()
    for depth, (tag, names) in enumerate(path):
        found.add("in:" + tag)
        found.update("name:" + n for n in names)
        if depth >= len(path) - 2:
            found.update("near:" + n for n in names)
    found.add("tag:" + (tags[-1] if tags else ""))
    found.add(("inside" if _marks_main(path) else "outside") if marked else "unmarked")
    return tuple(sorted(found))


def text_features(block: Block, marked: bool) -> list[str]:
    n, density, side = len(block.text), block.linked / max(1, len(block.text)), "" if marked else "bare-"
    words = block.text.count(" ") + 1
    out = [f"{side}long:{min(6, n.bit_length() // 2)}", f"{side}links:{int(density * 3.99)}", f"{side}words:{min(5, words.bit_length() - 1)}"]
    if block.text[-1] in ".!?…。":
        out.append(side + "sentence")
    if "©" in block.text or "(c)" in block.text:
        out.append("copyright")
    return out


def features(found: list[Block]) -> list[list[str]]:
    marked = any(_marks_main(b.path) for b in found)
    return [[*path_features(b.path, marked), *text_features(b, marked)] for b in found]


class Chain:
    """Binary linear-chain field: log-odds per feature, weights per pair of labels (0 other, 1 main)."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.pairs = np.zeros((2, 2))
        self.first = np.zeros(2)
        self._paths: dict[tuple[tuple, bool], float] = {}

    def odds(self, found: list[Block]) -> list[float]:
        get, out, marked = self.weight.get, [], any(_marks_main(b.path) for b in found)
        for b in found:
            known = self._paths.get((b.path, marked))
            if known is None:
                known = sum(get(f, 0.0) for f in path_features(b.path, marked))
                if len(self._paths) < 50_000:
                    self._paths[b.path, marked] = known
            out.append(known + sum(get(f, 0.0) for f in text_features(b, marked)))
        return out

    def decode(self, odds: list[float]) -> list[int]:
        """Viterbi; ties go to other."""
        if not odds:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        zero, one, back = float(self.first[0]), float(self.first[1]) + odds[0], []
        for o in odds[1:]:
            from0, from1 = zero + p00 < one + p10, zero + p01 < one + p11
            back.append((from0, from1))
            zero, one = max(zero + p00, one + p10), max(zero + p01, one + p11) + o
        label, out = int(one > zero), []
        for steps in reversed(back):
            out.append(label)
            label = int(steps[label])
        out.append(label)
        return out[::-1]

    def learn(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> None:
        """Maximise the conditional likelihood; expectations by forward and backward sums."""
        names = sorted({f for feats, _ in pages for x in feats for f in x})
        number = {f: k for k, f in enumerate(names)}
        weight, rng = np.zeros(len(names)), random.Random(seed)
        rows = [([np.array([number[f] for f in x]) for x in feats], labels) for feats, labels in pages]
        for epoch in range(epochs):
            rng.shuffle(rows)
            pace = rate / (1 + epoch)
            for feats, labels in rows:
                n = len(labels)
                odds = np.zeros((n, 2))
                odds[:, 1] = [weight[x].sum() for x in feats]
                ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
                ahead[0] = self.first + odds[0]
                for t in range(1, n):
                    ahead[t] = np.logaddexp(ahead[t - 1, 0] + self.pairs[0], ahead[t - 1, 1] + self.pairs[1]) + odds[t]
                for t in range(n - 2, -1, -1):
                    nxt = odds[t + 1] + behind[t + 1]
                    behind[t] = np.logaddexp(self.pairs[:, 0] + nxt[0], self.pairs[:, 1] + nxt[1])
                total = np.logaddexp(*ahead[-1])
                chance = np.exp(ahead + behind - total)
                both = np.exp(ahead[:-1, :, None] + self.pairs + (odds + behind)[1:, None, :] - total)
                for x, label, p in zip(feats, labels, chance[:, 1], strict=True):
                    weight[x] += pace * (label - p) - pace * decay * weight[x]
                self.first[labels[0]] += pace
                self.first -= pace * chance[0]
                np.add.at(self.pairs, (labels[:-1], labels[1:]), pace)
                self.pairs -= pace * both.sum(axis=0)
        self.weight = dict(zip(names, weight.tolist(), strict=True))
        self._paths.clear()


def labelled_pages(count: int = 600, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of varied layout with the label of every block, 1 for the article."""
    rng = random.Random(seed)
    syllables = "ba ke li mo nu ra se ti vo xa der ing ion lan mur pel qui ros tan wen".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{words(a, b)}</a>'

    def pick(*options: str) -> str:
        return rng.choice(options)

    def listing(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}" + pick("</li>", "</li>", "") for _ in range(n)) + "</ul>"

    def paragraph() -> str:
        text = words(3, 90)
        if rng.random() < 0.3:
            text = f"<b>{text}</b> {link(1, 4)} {words(1, 20)}"
        if rng.random() < 0.2:
            text = text.replace(" ", "<br>", 1)
        return f"<p>{text}{pick('.', '.', '.', '!', '')}" + pick("</p>", "</p>", "")

    def junk(kind: str) -> str:
        inner = {
            "menu": lambda: listing(rng.randint(2, 8)),
            "header": lambda: f"<h1>{words(1, 4)}</h1>" + pick("", f"<p>{words(2, 8)}</p>", listing(3)),
            "footer": lambda: f"<p>&copy; {words(1, 4)} &middot; {words(2, 14)}.</p>" + pick("", listing(3)) if rng.random() < 0.6 else f"&copy; {words(1, 3)} &middot; {words(3, 14)}.",
            "side": lambda: f"<h3>{words(1, 3)}</h3>" + pick(listing(rng.randint(2, 6)), f"<p>{words(4, 40)}.</p>"),
            "advert": lambda: pick(f"{words(3, 25)}.", f"<p>{words(3, 40)}.</p>", link(2, 6)),
            "notice": lambda: pick(f"<p>{words(5, 40)}. {link()}</p>", f"{words(5, 30)}.", f"<p>{words(3, 25)}.</p><button>{words(1, 2)}</button>"),
            "comment": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(pick(f"<p>{words(3, 60)}.</p>", f"<div><b>{words(1, 2)}</b><p>{words(3, 50)}.</p></div>", f"<li>{words(3, 50)}.</li>") for _ in range(rng.randint(1, 4))),
            "social": lambda: "".join(link(1, 2) + " " for _ in range(3)),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button>" + pick("", f"<p>{words(3, 15)}.</p>"),
        }[kind]()
        tag = {"menu": pick("nav", "div", "nav"), "header": pick("header", "div"), "footer": pick("footer", "footer", "div"), "side": pick("aside", "aside", "div"), "form": "form", "comment": pick("section", "div", "ol")}.get(kind, pick("div", "div", "section", "p" if "<" not in inner else "div"))
        plain = tag in ("nav", "header", "footer", "aside", "form")
        name = "" if plain and rng.random() < 0.5 else f" {pick('class', 'class', 'id')}=\"{pick(*CLASS_WORDS[kind].split())}{pick('', '', '-box', ' wide')}\""
        return f"<{tag}{name}>{inner}</{tag}>"

    def mark(part: str, label: int) -> str:
        return f"\x02{label}{part}"

    pages = []
    for _ in range(count):
        body = [mark(f"<h1>{words(1, 10)}</h1>", 1)] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            draw = rng.random()
            if draw < 0.72:
                body.append(mark(paragraph(), 1))
            elif draw < 0.80:
                body.append(mark(f"<h2>{words(1, 6)}</h2>", 1))
            elif draw < 0.84:
                body.append(mark("<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(3)) + "</ul>", 1))
            elif draw < 0.87:
                body.append(mark(f"<blockquote>{words(5, 40)}.</blockquote>", 1))
            elif draw < 0.90:
                body.append(mark(f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}<tr><td>{words(1, 3)}<td>{words(1, 3)}</table>", 1))
            elif draw < 0.92:
                body.append(mark(f"<figure><figcaption>{words(3, 15)}.</figcaption></figure>", 1))
            else:
                body.append(mark(junk(pick("advert", "social", "side", "notice", "form")), 0))
        if rng.random() < 0.25:
            body.append(mark(junk("comment"), 0))
        tag, name = pick("article", "article", "article", "main", "div"), ""
        if rng.random() < 0.2:  # an article without any name, in plain elements
            tag = pick("div", "div", "section", "td")
            if rng.random() < 0.5:
                body = [part.replace("<p>", "<div>").replace("</p>", "</div>") if part[1] == "1" else part for part in body]
        elif tag == "div" or rng.random() < 0.4:
            name = f" {pick('class', 'id')}=\"{pick(*CLASS_WORDS['main'].split())}{pick('', '-body', ' wide')}\""
        article = [f"<{tag}{name}>", *body, f"</{tag}>"]
        much = pick(0.45, 0.45, 0.45, 0.1)
        before = [mark(junk(k), 0) for k in ("notice", "header", "menu", "advert", "form", "social") if rng.random() < much]
        after = [mark(junk(k), 0) for k in ("comment", "side", "advert", "notice", "form", "menu", "footer") if rng.random() < much]
        rng.shuffle(before)
        pages.append(_split_labels([f"<html><head><title>{words(1, 5)}</title></head><body>", *before, *article, *after, pick("</body></html>", "")]))
    return pages


def _split_labels(parts: list[str]) -> tuple[str, list[int]]:
    """The page, and the label of each of its blocks: that of the part in which its text begins."""
    page, starts, labels = "", [], []
    for part in parts:
        label, part = (int(part[1]), part[2:]) if part[:1] == "\x02" else (0, part)
        starts.append(len(page))
        labels.append(label)
        page += part
    return page, [labels[bisect_right(starts, b.at) - 1] for b in blocks(page)]


@lru_cache(1)
def trained() -> Chain:
    chain, pages = Chain(), []
    for page, labels in labelled_pages():
        found = blocks(page)
        if found and len(found) == len(labels):
            pages.append((features(found), labels))
    chain.learn(pages)
    return chain


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page) if page else []
    return " ".join(b.text for b, label in zip(found, chain.decode(chain.odds(found)), strict=True) if label)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. One pass, no shuffle; the field is a few hundred weights."""
    given = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, given.value) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
