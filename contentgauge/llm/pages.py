"""Main text of web pages: boosted trees judge DOM nodes, a tree decoding keeps them consistent.

The trees are fitted on layouts that ``training_page`` draws, where the label of every node is
known. Features are the subtree's text and link density, tokens of its class, id and role and of
its ancestors', tag, depth and how it compares with its siblings. Decoding picks the most likely
labels under the rule that nothing below a dropped node is kept.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentgauge.llm.boost import Trees, fit

# how many drawn pages the trees are fitted on
TRAINING_PAGES = 600
SEED = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# never text of an article
SKIPPED = frozenset("script style noscript template svg math iframe object select textarea button head title canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# a start tag that ends an open element of the second set, up to one of the third
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TAGS = (
    ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("p",),
    tuple(sorted(HEADINGS)), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("div",), ("section",),
    ("table", "tbody", "thead", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("dialog",),
)
# words that class, id and role are made of
GROUPS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs topbar links skip",
    "head": "header masthead banner branding logo site top hero toolbar",
    "foot": "footer foot copyright colophon legal contentinfo bottom",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more teaser complementary tags author bio",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay privacy paywall dialog toast message",
    "ad": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion promotions dfp commercial affiliate",
    "form": "form newsletter subscribe subscription signup search login register contact feedback poll",
    "comment": "comment comments commentlist disqus reply replies respond responses discussion thread reader readers",
    "share": "share sharing social follow tweet facebook print buttons",
    "body": "article content post entry story main body text prose copy page single detail richtext",
    "hidden": "hidden invisible none sr visually offscreen",
}
WORD_GROUP = {w: k for k, words in enumerate(GROUPS.values()) for w in words.split()}

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|$)|"
    r"<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style|aria-label)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=20_000)
def attribute_mask(attrs: str) -> int:
    """Which groups the words of class, id and role belong to, as bits."""
    mask = 0
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value == "true" or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            mask |= 1 << WORD_GROUP["hidden"]
        elif name in ("class", "id", "role"):
            for word in PARTS.findall(value):
                k = WORD_GROUP.get(word.lower())
                if k is not None:
                    mask |= 1 << k
    return mask


class Page:
    """The block elements of a page in order, and its text as (element, text) in order.

    Inline elements belong to the block around them. An element without a node is skipped with
    all below it. Text of None is where a block or line ends.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.mask, self.depth = ["body"], [-1], [0], [0]
        self.items: list[tuple[int, str | None]] = []
        self.own = [[0, 0, 0]]  # characters, of them in links, full stops and commas
        self._read(source)

    def _text(self, node: int, text: str, links: int) -> None:
        text = html.unescape(text) if "&" in text else text
        self.items.append((node, text))
        size = len(text.strip())
        if size:
            own = self.own[node]
            own[0] += size
            own[1] += size if links else 0
            own[2] += text.count(".") + text.count(",")

    def _read(self, source: str) -> None:
        open_tags: list[tuple[str, int]] = [("body", 0)]  # (tag, node before it opened)
        node, links, at, n = 0, 0, 0, len(source)
        find, items = TOKEN.search, self.items

        def close(k: int) -> int:
            """End all elements from place ``k`` of the stack on."""
            nonlocal links
            back = node
            while len(open_tags) > k:
                tag, back = open_tags.pop()
                links -= tag == "a"
                if tag not in INLINE:
                    items.append((back, None))
            return back

        while at < n:
            match = find(source, at)
            if match is None:
                self._text(node, source[at:], links)
                return
            if match.start() > at:
                self._text(node, source[at:match.start()], links)
            at = match.end()
            tag, end = match["tag"], match["end"]
            if match["cdata"]:
                self._text(node, match["cdata"], links)
            elif end:
                end = end.lower()
                for k in range(len(open_tags) - 1, 0, -1):
                    if open_tags[k][0] == end or end in HEADINGS and open_tags[k][0] in HEADINGS:
                        node = close(k)
                        break
                    if end in INLINE and open_tags[k][0] not in INLINE:
                        break  # an inline end tag does not end blocks
            elif tag:
                tag = tag.lower()
                if tag in SKIPPED:
                    at = self._skip(source, tag, at, match["attrs"])
                    continue
                if tag in ("html", "body"):
                    continue
                if tag in VOID:
                    if tag in ("br", "hr"):
                        items.append((node, None))
                    continue
                if tag in INLINE:
                    links += tag == "a"
                    open_tags.append((tag, node))
                    continue
                if tag in CLOSES:
                    ended, limits = CLOSES[tag]
                    k = next((k for k in range(len(open_tags) - 1, 0, -1) if open_tags[k][0] in ended | limits), 0)
                    while k and open_tags[k][0] in ended:
                        node = close(k)
                        k = next((j for j in range(len(open_tags) - 1, 0, -1) if open_tags[j][0] in ended | limits), 0)
                else:  # a block ends an open paragraph
                    k = next((k for k in range(len(open_tags) - 1, 0, -1)
                              if open_tags[k][0] == "p" or open_tags[k][0] not in INLINE), 0)
                    if k and open_tags[k][0] == "p":
                        node = close(k)
                items.append((node, None))
                open_tags.append((tag, node))
                self.tag.append(tag)
                self.parent.append(node)
                self.mask.append(attribute_mask(match["attrs"]) if match["attrs"] else 0)
                self.depth.append(self.depth[node] + 1)
                self.own.append([0, 0, 0])
                node = len(self.tag) - 1

    @staticmethod
    def _skip(source: str, tag: str, at: int, attrs: str) -> int:
        """Where the skipped element ends."""
        if attrs.endswith("/") and tag not in RAW:
            return at
        depth = 1
        for match in re.compile(rf"<(/?){tag}\b[^>]*(?:>|$)", re.I).finditer(source, at):
            if tag in RAW or tag == "head":
                if match[1]:
                    return match.end()
                continue
            depth += -1 if match[1] else (0 if match[0].endswith("/>") else 1)
            if not depth:
                return match.end()
        if tag == "head":  # never closed: the body ends it
            body = re.compile(r"<body\b", re.I).search(source, at)
            return body.start() if body else at
        return len(source)

    def text(self, kept: list[bool]) -> str:
        parts = [" " if text is None else text for node, text in self.items if text is None or kept[node]]
        return " ".join("".join(parts).split())


N_GROUPS = len(GROUPS)
TAG_CLASS = {tag: g for g, names in enumerate(TAGS) for tag in names}
N_TAGS = len(TAGS)


def features(page: Page) -> np.ndarray:
    """One row per node: bits of its tag and attribute words and of its ancestors', then numbers."""
    n, parents = len(page.tag), page.parent
    own = [1 << TAG_CLASS[t] if t in TAG_CLASS else 0 for t in page.tag]
    own = [t | m << N_TAGS for t, m in zip(own, page.mask, strict=True)]
    above = [0] * n
    chars, links, stops = map(list, zip(*page.own, strict=True))
    own_chars, tags, first = chars.copy(), [1] * n, [0] * n
    for k in range(1, n):
        above[k] = above[parents[k]] | own[parents[k]]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        p = parents[k]
        chars[p] += chars[k]
        links[p] += links[k]
        stops[p] += stops[k]
        tags[p] += tags[k]
        children[p].append(k)
    place, same, brothers, mean = [0.0] * n, first, [0] * n, [0.0] * n
    for found in children:
        size = len(found)
        if size:
            counts: dict[str, int] = {}
            for k in found:
                counts[page.tag[k]] = counts.get(page.tag[k], 0) + 1
            average = sum([chars[k] for k in found]) / size
            for i, k in enumerate(found):
                place[k], same[k] = 1 - (i + 0.5) / size, counts[page.tag[k]] / size
                brothers[k], mean[k] = size, average
    bits = np.arange(N_TAGS + N_GROUPS)
    total, linked = np.array(chars, float), np.array(links, float)
    share, count = linked / np.maximum(total, 1), np.array(tags, float)
    numbers = np.stack([
        np.log1p(total), total / max(1, chars[0]), share, np.log1p(total / count),
        100 * np.array(stops) / np.maximum(total, 1), np.array(page.depth), np.array(place), np.array(same),
        np.log1p(brothers), np.log1p(mean), share[np.maximum(parents, 0)], np.log1p(own_chars), np.log(count),
    ], axis=1)
    flags = np.concatenate([np.array(own)[:, None] >> bits & 1, np.array(above)[:, None] >> bits & 1], axis=1)
    return np.concatenate([flags, numbers], axis=1, dtype=np.float32)


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """The most likely labels among those where a dropped node's descendants are dropped too."""
    keep = -np.logaddexp(0, -margin)  # log p
    drop = -np.logaddexp(0, margin)
    n = len(page.tag)
    kept, dropped = keep.tolist(), drop.tolist()
    kept[0] = 0.0  # the body itself is no choice
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        kept[p] += max(kept[k], dropped[k])
        dropped[p] += dropped[k]
    label = [True] * n
    for k in range(1, n):
        label[k] = label[page.parent[k]] and kept[k] >= dropped[k]
    return label


# --- training pages ---------------------------------------------------------------------------

SYLLABLES = "an be con der el fi ga ho in ka lo mi no or pa qui re sa ti un ver wo za".split()


def _word(draw: random.Random) -> str:
    return "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3)))


def _prose(draw: random.Random, low: int, high: int) -> str:
    words, out = draw.randint(low, high), []
    while words > 0:
        n = min(words, draw.randint(3, 14))
        sentence = [_word(draw) for _ in range(n)]
        if n > 5:
            sentence[n // 2] += ","
        out.append(" ".join(sentence).capitalize() + draw.choice([".", ".", ".", "?", "!"]))
        words -= n
    return " ".join(out)


def _attrs(draw: random.Random, group: str, odds: float = 0.9) -> str:
    if draw.random() > odds:
        return ""
    word = draw.choice(GROUPS[group].split())
    word = draw.choice([word, f"{word}-{_word(draw)}", f"{_word(draw)}-{word}", f"{word}{draw.randint(1, 9)}", f"js_{word}"])
    return f' {draw.choice(["class", "class", "id"])}="{word}"'


def _links(draw: random.Random, low: int, high: int) -> str:
    def name() -> str:
        return " ".join(_word(draw) + draw.choice(["", "", "", ",", "."]) for _ in range(draw.choice([1, 1, 2, 3, 6])))

    odd = draw.random() < 0.1  # now and then an entry without a link
    return "".join(f"<li>{name()}</li>" if odd and draw.random() < 0.3 else f'<li><a href="/{_word(draw)}">{name()}</a></li>'
                   for _ in range(draw.randint(low, high)))


def _boilerplate(draw: random.Random, kind: str) -> str:
    tag = draw.choice(["div", "div", "section"])
    if kind == "nav":
        if draw.random() < 0.6:
            return f"<nav{_attrs(draw, 'nav', 0.4)}><ul>{_links(draw, 2, 12)}</ul></nav>"
        return f"<{tag}{_attrs(draw, 'nav')}><ul>{_links(draw, 2, 12)}</ul></{tag}>"
    if kind == "head":
        inner = f"<{draw.choice(['h1', 'h2', 'p', 'div'])}>{_word(draw)} {_word(draw)}</h1><p>{_prose(draw, 2, 12)}</p>"
        return f"<header{_attrs(draw, 'head', 0.4)}>{inner}</header>" if draw.random() < 0.6 else f"<div{_attrs(draw, 'head', 1)}>{inner}</div>"
    if kind == "foot":
        inner = draw.choice([f"&copy; {_word(draw)}.example.com &middot; {_prose(draw, 3, 25)}",
                             f"<p>{_prose(draw, 3, 30)}</p><ul>{_links(draw, 2, 6)}</ul>", f"<p>{_prose(draw, 10, 60)}</p>"])
        return f"<footer{_attrs(draw, 'foot', 0.3)}>{inner}</footer>" if draw.random() < 0.7 else f"<div{_attrs(draw, 'foot', 1)}>{inner}</div>"
    if kind == "side":
        inner = f"<h3>{_word(draw)}</h3>" + draw.choice([f"<ul>{_links(draw, 2, 8)}</ul>", f"<p>{_prose(draw, 5, 60)}</p>"])
        return f"<aside{_attrs(draw, 'side', 0.4)}>{inner}</aside>" if draw.random() < 0.6 else f"<div{_attrs(draw, 'side', 1)}>{inner}</div>"
    if kind == "form":
        return (f"<form{_attrs(draw, 'form', 0.5)}><p>{_prose(draw, 2, 25)}</p><label>{_word(draw)}</label>"
                f"<input name=x><button>{_word(draw)}</button></form>")
    if kind == "comment":
        many = "".join(f"<{t}><p>{_prose(draw, 4, 70)}</p></{t}>" for t in [draw.choice(["div", "li", "article"])] * draw.randint(1, 6))
        return f"<{tag}{_attrs(draw, 'comment', 1)}><h3>{_word(draw)}</h3>{many}</{tag}>"
    return f"<{tag}{_attrs(draw, kind, 1)}>" + draw.choice([
        _prose(draw, 3, 60), f"<p>{_prose(draw, 3, 40)}</p>", f"<p>{_prose(draw, 3, 15)} <a href=x>{_word(draw)}</a></p>"]) + f"</{tag}>"


def _block(draw: random.Random) -> str:
    kind = draw.random()
    text = _prose(draw, *draw.choice([(1, 2), (1, 6), (4, 20), (15, 60), (30, 150)]))
    if draw.random() < 0.2:
        text = f"<b>{text}</b>" if draw.random() < 0.5 else text + f' <a href="/x">{_prose(draw, 1, 6)}</a> {_word(draw)}.'
    if kind < 0.7:
        return f"<p{_attrs(draw, 'body', 0.1)}>{text}</p>"
    if kind < 0.8:
        return f"<h{draw.randint(2, 4)}>{_prose(draw, 2, 9)}</h2>"
    if kind < 0.87:
        return "<ul>" + "".join(f"<li>{_prose(draw, 2, 25)}</li>" for _ in range(draw.randint(1, 6))) + "</ul>"
    if kind < 0.92:
        return f"<blockquote><p>{text}</p></blockquote>"
    if kind < 0.96:
        return f"<figure><figcaption>{_prose(draw, 3, 15)}</figcaption></figure>"
    return f"<div>{text}</div>"


MARK_KEPT = "data-kept"


def training_page(draw: random.Random) -> str:
    """A page whose top nodes of article text carry ``data-kept``; what lies below a mark is kept
    too, unless a ``data-dropped`` comes in between."""
    blocks = [f"<h1>{_prose(draw, *draw.choice([(1, 2), (2, 12)]))}</h1>"] if draw.random() < 0.8 else []
    for _ in range(draw.choice([0, 1, 2, 4, 8, 16])):
        blocks.append(_block(draw))
        if draw.random() < 0.08:
            inner = _boilerplate(draw, draw.choice(["ad", "share", "side", "form", "notice", "nav"]))
            blocks.append(re.sub(r"^<(\w+)", r"<\1 data-dropped", inner))
    body = "".join(blocks)
    container = draw.random()
    if container < 0.45:
        body = f"<article{_attrs(draw, 'body', 0.3)} {MARK_KEPT}>{body}</article>"
    elif container < 0.6:
        body = f"<main{_attrs(draw, 'body', 0.3)} {MARK_KEPT}>{body}</main>"
    elif container < 0.85:
        body = f"<div{_attrs(draw, 'body', 0.8)} {MARK_KEPT}>{body}</div>"
    else:
        body = f"<section {MARK_KEPT}>{body}</section>"
    if draw.random() < 0.3:
        body = f"<div {MARK_KEPT}>{body}</div>" if draw.random() < 0.5 else f"<div {MARK_KEPT} id=\"page\"><div {MARK_KEPT}>{body}</div></div>"
    before = [k for k in ("notice", "nav", "head", "ad", "nav", "form") if draw.random() < 0.45]
    after = [k for k in ("share", "side", "ad", "comment", "form", "notice", "side", "nav", "foot", "foot") if draw.random() < 0.4]
    draw.shuffle(before)
    return "<body>" + "".join(_boilerplate(draw, k) for k in before) + body + "".join(_boilerplate(draw, k) for k in after) + "</body>"


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A drawn page without its marks, and the label of every node."""
    plain = Page(re.sub(rf" (?:{MARK_KEPT}|data-dropped)", "", source))
    marks = [m[0] for m in re.finditer(r"<(\w+)[^>]*>", source) if m[1] not in INLINE | VOID | SKIPPED | {"body"}]
    label = np.zeros(len(plain.tag), bool)
    label[0] = True
    if len(marks) != len(plain.tag) - 1:
        raise ValueError("a drawn page must name every block it opens")
    for k, mark in enumerate(marks, 1):
        up = plain.parent[k]
        label[k] = "data-dropped" not in mark and (MARK_KEPT in mark or (up > 0 and label[up]))
    return plain, label


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Trees:
    """Trees fitted on ``pages`` drawn pages."""
    draw = random.Random(seed)
    found = [labelled(training_page(draw)) for _ in range(pages)]
    x = np.concatenate([features(p)[1:] for p, _ in found])
    y = np.concatenate([label[1:] for _, label in found]).astype(float)
    return fit(x, y)


def main_text(source: str | None, trees: Trees) -> str:
    page = Page(source or "")
    if len(page.tag) == 1:
        return page.text([True])
    return page.text(decode(page, trees.margin(features(page))))


def extract(df: DataFrame, source: str = "html", name: str = "text", trees: Trees | None = None) -> DataFrame:
    """Add ``name``: the main text of the page, empty if it has none. A null page is empty.

    Character references are decoded and white space inside the text becomes one space; blocks are
    joined by one space in page order.
    """
    model = trees or trained()

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        pages = [Page(s or "") for s in column.to_pylist()]
        rows = [features(p) for p in pages]
        margin = model.margin(np.concatenate(rows)) if rows else np.empty(0)
        ends = np.cumsum([len(r) for r in rows])[:-1]
        return pa.array([p.text(decode(p, m)) for p, m in zip(pages, np.split(margin, ends), strict=True)] if rows else [], pa.string())

    return df.withColumn(name, texts(F.col(source)))
