"""Main text of web pages by equivalence classes of template tokens.

A page is read as *tokens*: its elements, each known by the path of tags, classes and ids that leads to it, and its blocks of text, each known by
its element and its text.  Over the pages of a host:

1.  A token's *occurrence vector* has its count on every page.  It is never built: a sum and an XOR of hashes of (page, count) stand for it, with
    the number of pages, so partial aggregation computes it and a host with a third of all pages is no group in any task.  Pages with the
    same tokens (copies) count once.
2.  Tokens of a host with equal vectors are an *equivalence class*.  A class is valid if it holds elements and each of them follows the
    same other one on all pages (checked by the neighbours' smallest and largest name, again by partial aggregation).
3.  Classes nest as their elements' paths do.  Of the valid classes' elements that stand once on a page, those that hold most of the host's text
    are its *main slots*; blocks of text in a valid class, or on most of the host's pages, are part of the *template*.
4.  A page's text is what stands in its deepest main slot, without the slots whose elements say that they are something else (menus, headers, footers,
    sidebars, notices, adverts, forms, comments) and without the template's blocks.

A host's template is a short row (its entries stand on at least 1/64 of its pages), so pages meet it by broadcast, or by a shuffle in which only hot
hosts are broadcast.  A page of a host with fewer than three different pages, or without a url, has nothing to be compared with: there the marked
main element, or else the deepest element that holds four fifths of the text, is the slot.  Text inside an element marked as the
article is never taken for template, as near copies of a page would make it look like one.
"""

from __future__ import annotations

import html as H
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import cut, fresh, meet

#: How many different pages of a host a token must be on to belong to a template, at least; and how small a part of them.
LEAST_PAGES, LEAST_PART = 3, 64
#: Part of a page's text that a main slot holds, and part of a host's pages that a block of the template is on.
MOST, COMMON = 0.8, 0.6
#: Hosts whose template rows go to every task at once.
HOSTS = 4096

# Elements and attribute words.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELL = {"td", "th"}
DROP = set("nav footer aside form script style noscript template iframe object svg button select textarea dialog menu search noembed noframes title".split())
DROP_ROLE = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROP_WORD = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social "
    "related recommended recommendations comment comments commentlist respond reply replies disqus widget widgets toolbar pagination pager skip skiplink".split()
)
OUTSIDE = {"header", "masthead", "banner"}  # of a page, but the head of an article belongs to it
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE, MAIN = 2, 1
# End of fixed values.

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>?|</?[A-Za-z][^>]*+\Z", re.S)
ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
DIGITS = re.compile(r"\d{3,}")
SCOPE = {"table", "td", "th", "caption", "button", "object", "template", "html"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": (CELL, {"tr", "table"}), "th": (CELL, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES |= {"thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})}


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@lru_cache(1 << 14)
def _signature(tag: str, attrs: str) -> tuple[str, str, str, frozenset[str]]:
    """An element's name in a path, its role, its itemprop, and the words of its classes and id."""
    words: set[str] = set()
    name, role, prop = tag, "", ""
    for key, *values in ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            name += "|" + DIGITS.sub("", value)
            words.update(w.lower() for w in WORD.findall(value))
        elif key == "role":
            role = value.lower()
        else:
            prop = value
    return name, role, prop, frozenset(words)


class Page:
    """The elements and blocks of a page.

    ``elements``: (token, parent, dropped, mark, tag); ``blocks``: (element, text, characters inside links); ``held``, once :meth:`chars` was
    called: kept blocks inside every element.
    """

    def __init__(self, text: str, forms: bool = True) -> None:
        self.elements: list[tuple[int, int, bool, int, str]] = [(0, -1, False, 0, "")]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._open: dict[str, int] = {}
        self._buf: list[str] = []
        self._links = 0
        self._forms = forms
        self._read(text)
        self._chars: list[int] | None = None

    def _flush(self) -> None:
        if self._buf:
            text = " ".join("".join(self._buf).split())
            if text:
                self.blocks.append((self._at, text, self._links))
            self._buf, self._links = [], 0

    def _pop_to(self, names: set[str], stops: set[str]) -> None:
        """Close the nearest open element of ``names``, and what is inside it, unless one of ``stops`` is nearer."""
        if not any(self._open.get(n) for n in names):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in names:
                for name, _ in self._stack[i:]:
                    self._open[name] -= 1
                del self._stack[i:]
                return
            if self._stack[i][0] in stops:
                return

    def _push(self, tag: str, attrs: str) -> None:
        parent = self._stack[-1][1]
        token, _, dropped, mark, _ = self.elements[parent]
        name, role, prop, words = _signature(tag, attrs)
        is_main = ARTICLE if tag == "article" or prop == "articleBody" else MAIN if tag == "main" or role == "main" else 0
        if tag in ("html", "body"):
            pass
        elif tag in DROP:
            dropped = dropped or tag != "form" or self._forms
        elif role in DROP_ROLE and not (mark and role == "banner"):
            dropped = True
        elif words & DROP_WORD and tag != "main":
            dropped = True
        elif not mark and not is_main and (tag == "header" or words & OUTSIDE):
            dropped = True
        token = _long(xxhash.xxh64_intdigest(f"{token}/{name}"))
        self.elements.append((token, parent, dropped, max(mark, is_main), tag))
        self._stack.append((tag, len(self.elements) - 1))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _text(self, piece: str) -> None:
        if not piece:
            return
        at = self._stack[-1][1]
        if self._buf and at != self._at and self.elements[at][2] != self.elements[self._at][2]:
            self._flush()  # an inline element that is dropped, inside a block that is not
        if not self._buf:
            self._at = at
        piece = H.unescape(piece) if "&" in piece else piece
        self._buf.append(piece)
        if self._open.get("a"):
            self._links += len(piece)

    def _read(self, text: str) -> None:
        at, end = 0, len(text)
        while at < end:
            m = TAG.search(text, at)
            if m is None:
                self._text(text[at:])
                break
            self._text(text[at : m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            tag = name.lower()
            if m.group(1):
                self._end(tag)
                continue
            if tag in VOID:
                if tag in ("br", "wbr"):
                    if self._buf and tag == "br":
                        self._buf.append(" ")
                elif tag == "hr":
                    self._flush()
                continue
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])[^>]*+>?", re.I).search(text, at)
                at = close.end() if close else end
                continue
            self._start(tag, m.group(3))
        self._flush()

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
            if self._open.get("p"):
                self._pop_to({"p"}, SCOPE)
        elif tag in CELL and self._buf:
            self._buf.append(" ")
        if tag in CLOSES:
            self._pop_to(*CLOSES[tag])
        if tag == "a":
            self._pop_to({"a"}, SCOPE)
        if tag in BLOCK or tag in CELL or tag == "a" or tag in DROP:
            self._push(tag, attrs)
        elif attrs:
            _, role, _, words = _signature(tag, attrs)
            if words & DROP_WORD or role in DROP_ROLE:
                self._push(tag, attrs)

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        elif tag in CELL and self._buf:
            self._buf.append(" ")
        self._pop_to({tag}, set())

    def chars(self) -> list[int]:
        """Kept characters inside every element, without lists of links."""
        if self._chars is None:
            self._chars, self.held = [0] * len(self.elements), [0] * len(self.elements)
            for el, text, links in self.blocks:
                if not self.elements[el][2] and not self.is_link(el, text, links):
                    self._chars[el] += len(text)
                    self.held[el] += 1
            for i in range(len(self.elements) - 1, 0, -1):  # an element comes after its parent
                self._chars[self.elements[i][1]] += self._chars[i]
                self.held[self.elements[i][1]] += self.held[i]
        return self._chars

    def is_link(self, el: int, text: str, links: int) -> bool:
        """A block that is nearly all link, and no paragraph or heading."""
        return links >= 0.9 * len(text) and self.elements[el][4] not in PROSE

    def block_token(self, el: int, text: str) -> int:
        return _long(xxhash.xxh64_intdigest(f"{self.elements[el][0]}:{text}"))


def read(text: str | None) -> Page:
    page = Page(text or "")
    if page.blocks and all(page.elements[el][2] for el, _, _ in page.blocks) and "<form" in text.lower():
        page = Page(text, forms=False)  # a page that is one form
    return page


def tokens(text: str | None) -> list[tuple[int, bool, int, int, float, bool]]:
    """(token, is it a block of text, count, first position, part of the page's text, marked as main) of every token of a page.

    Blocks inside marked elements are left out: they are never template.
    """
    page = read(text)
    chars = page.chars()
    total = max(1, chars[0])
    held: dict[int, list] = {}
    for pos, (token, _, dropped, mark, tag) in enumerate(page.elements):
        if tag != "a":
            x = held.setdefault(token, [False, 0, pos, 0.0, False])
            x[1] += 1
            x[3] += 0.0 if dropped or page.held[pos] < 2 else chars[pos] / total
            x[4] = x[4] or bool(mark and not dropped and not page.elements[page.elements[pos][1]][3])
    for pos, (el, text, _) in enumerate(page.blocks):
        _, _, dropped, mark, _ = page.elements[el]
        if not dropped and not mark:
            x = held.setdefault(page.block_token(el, text), [True, 0, pos, len(text) / total, False])
            x[1] += 1
    return [(k, *v) for k, v in held.items()]


def extract(text: str | None, mains: set[int], template: set[int]) -> str:
    """The main text of one page, given its host's main slots and template blocks (both may be empty)."""
    page = read(text)
    els, chars = page.elements, page.chars()
    top: set[int] = set()
    for level in (ARTICLE, MAIN):  # the marked slot
        top = {i for i, e in enumerate(els) if e[3] == level and not e[2] and chars[i] and (e[1] < 0 or els[e[1]][3] < level)}
        if top:
            break
    if not top:
        slots = [i for i, e in enumerate(els) if e[0] in mains and not e[2] and chars[i]]  # the host's slot: the deepest comes last
        if not slots:
            slots = [i for i, e in enumerate(els) if not e[2] and (i == 0 or page.held[i] >= 2) and chars[i] >= MOST * chars[0]]
        if slots:
            depth = [0] * len(els)
            for i, e in enumerate(els[1:], 1):
                depth[i] = depth[e[1]] + 1
            top = {max(slots, key=lambda i: (depth[i], chars[i], -i))}
    inside = [False] * len(els)
    for i, e in enumerate(els):
        inside[i] = i in top or (e[1] >= 0 and inside[e[1]])
    held = [(el, t, links) for el, t, links in page.blocks if inside[el] and not els[el][2]]
    if any(els[i][3] for i in top):
        return "\n\n".join(t for _, t, _ in held)
    own = [t for el, t, links in held if page.block_token(el, t) not in template and not page.is_link(el, t, links)]
    return "\n\n".join(own or [t for _, t, _ in held])


def host_of(url):
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.xxhash64(host))


def _page_tokens(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for host, text in zip(part["host"], part["html"]):
            found = tokens(text)
            fp = _long(xxhash.xxh64_intdigest(repr(sorted(found))))
            out.extend((host, fp, *row) for row in found)
        yield pd.DataFrame(out, columns=["host", "page", "token", "block", "n", "pos", "part", "marked"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, mains, blocks): the main slots and the template's blocks of every host with at least ``LEAST_PAGES`` different pages.

    ``pages`` has host (a number) and html.
    """
    raw = pages.where("host is not null").select("host", "html").mapInPandas(_page_tokens, "host long, page long, token long, block boolean, n int, pos int, part double, marked boolean")
    once = cut(raw.groupBy("host", "page", "token").agg(*(F.first(c).alias(c) for c in ("block", "n", "pos", "part", "marked"))))  # copies count once
    vector = F.xxhash64("page", "n")
    per = once.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(vector).alias("v1"), F.sum(F.xxhash64(F.lit("sum"), "page", "n").bitwiseAND((1 << 32) - 1)).alias("v2"),
        F.sum("n").alias("n"), F.sum("part").alias("part"), F.max("block").alias("block"), F.max("marked").alias("marked"),
    )
    sizes = per.where("token = 0").select("host", F.col("pages").alias("of"))  # the root is on every page
    per = cut(per.join(sizes, "host").where(F.col("of") >= LEAST_PAGES).where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") * LEAST_PART >= F.col("of"))))
    count = per.count()
    # the element before it in its class, on each page
    classed = meet(once, per.select("host", "token", "v1", "v2"), ["host", "token"], count)
    before = F.lag("token").over(Window.partitionBy("host", "page", "v1", "v2").orderBy("pos", "token"))
    steps = classed.where("not block").withColumn("before", before)
    order = steps.groupBy("host", "token").agg((F.min("before").eqNullSafe(F.max("before")) & (F.count("before").isin(0, F.count(F.lit(1))))).alias("ordered"))
    elements = per.where("not block").join(order, ["host", "token"])
    valid = elements.groupBy("host", "v1", "v2").agg(F.min("ordered").alias("valid"), F.count(F.lit(1)).alias("size")).where("valid and size >= 2").select("host", "v1", "v2", F.lit(True).alias("valid"))
    named = per.join(valid, ["host", "v1", "v2"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    slot = ~F.col("block") & F.col("valid") & (F.col("n") == F.col("pages")) & (F.col("token") != 0) & (F.col("marked") | (F.col("part") >= MOST * F.col("pages")))
    boiler = F.col("block") & (F.col("valid") | (F.col("pages") >= COMMON * F.col("of")))
    return named.where(slot | boiler).groupBy("host").agg(F.collect_list(F.when(slot, F.col("token"))).alias("mains"), F.collect_list(F.when(boiler, F.col("token"))).alias("blocks"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``, the main text of every page; a column of that name is replaced, all others stay, whatever their names.

    Blocks are joined by an empty line; character references are decoded once and white space inside a block is one space.  A null or empty
    page gives an empty text.  A null url, or one without a host, is a page of no host.  Repeated pages count once in a host's template and give
    a row each.  An empty table gives an empty result.
    """
    pages = pages.drop(*[c for c in pages.columns if c.lower() == out_col.lower() and c.lower() not in (url_col.lower(), html_col.lower())])
    host, mains, blocks = fresh(pages, "host", "mains", "blocks")
    at = pages.withColumn(host, host_of(F.col(url_col)))
    known = cut(templates(at.select(F.col(host).alias("host"), F.col(html_col).alias("html"))))
    met = meet(at, known.select(F.col("host").alias(host), F.col("mains").alias(mains), F.col("blocks").alias(blocks)), [host], known.count(), "left", small=HOSTS)
    names = [c for c in pages.columns]

    @F.pandas_udf("string")
    def text_of(html: pd.Series, mains: pd.Series, blocks: pd.Series) -> pd.Series:
        held: dict[bytes, set[int]] = {}

        def as_set(x) -> set[int]:
            if x is None:
                return set()
            key = x.tobytes()
            return held[key] if key in held else held.setdefault(key, set(x.tolist()))

        return pd.Series([extract(h, as_set(m), as_set(b)) for h, m, b in zip(html, mains, blocks)])

    return met.select(*[F.col(f"`{c}`") for c in names], text_of(F.col(html_col), F.col(mains), F.col(blocks)).alias(out_col))
