"""Main text of web pages by composite text density.

A page becomes a small tree, one pass over its tags. Each node has its characters, tags, link characters and link
tags; its composite density is characters per tag, scaled down the more of them belong to links, relative to the
whole body. The sum of the children's densities is highest at the node whose children carry the article. The least
density on the way from there up to the body is the threshold: subtrees of the body that reach it hold content, each
from its own maximum-sum node on; an `article` or `main` around such a node is taken as a whole, with its heading.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments (by element, role,
class or id, or hidden) are out before densities are computed, and never come back. A form is out too, unless it holds an `article` or `main` or over half of
the text of the page: then it is a plain container. A head ends where something stands that may not stand in it.

Every page is parsed in one task row by row; nothing is shuffled. Pages and texts are neither cut nor capped.

Defined cases: a null or empty page and one without text give an empty text; markup may be broken (unclosed, crossed
or stray tags, unfinished comments); deep nesting needs no recursion; repeated rows are extracted each; an empty
table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOISE = frozenset(
    "script style noscript template iframe object svg canvas math head title nav header footer aside button"
    " select option input textarea fieldset dialog menu xmp noembed noframes audio video map".split()
)
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th"
    " blockquote pre figure figcaption address details summary hr header footer nav aside form fieldset center hgroup"
    " search dialog menu".split()
)
#: An opening tag of the first kind ends an open element of the second.
ENDS = {t: ("p",) for t in BLOCK} | {
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"),
    "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",),
    "tbody": ("p", "td", "th", "tr", "thead", "tbody"), "tfoot": ("p", "td", "th", "tr", "thead", "tbody"),
}
#: An implied end does not reach beyond these.
FENCE = frozenset("ul ol dl table article section div main body html blockquote td th figure aside nav form".split())
#: What may stand in a head; everything else ends an open head.
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar status"
    " directory tablist".split()
)
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner"
    " cookie cookies consent gdpr notice notices notification newsletter subscribe subscription paywall popup modal"
    " overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comments comment commentlist disqus"
    " replies reply respond share sharing social related recommended recommendations widget widgets toolbar pagination"
    " pager login signup masthead copyright skip".split()
)
#: Of these, what holds the readers' comments.
THREADS = frozenset("comments comment commentlist disqus replies reply respond".split())
#: Class names that begin so say what the page has or lacks, not what the element is.
STATES = ("has-", "has_", "no-", "no_", "with-", "without-", "is-")
OUT, ASIDE, THREAD = 1, 2, 3

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _unwanted(tag: str, attributes: str, inside_article: bool) -> int:
    """`OUT`: this element is out with all it holds. `ASIDE`: it is, unless it wraps the page's content. `THREAD`: as
    `ASIDE`, but readers' comments are no content however long they are. The frame of the page never is for its class."""
    if tag in NOISE:
        return 0 if tag == "header" and inside_article else OUT
    if tag == "form":
        return ASIDE
    if not attributes or tag in ("html", "body", "main", "article"):
        return 0
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "aria-hidden" and value == "true" or name == "hidden" or name == "style" and _HIDDEN.search(value):
            return OUT
        if name == "role" and value in ROLES:
            found = found or ASIDE
        if name in ("class", "id"):
            parts = [p for c in value.split() if not c.startswith(STATES) for p in _SPLIT.split(c)]
            if not THREADS.isdisjoint(parts):
                found = THREAD
            elif not WORDS.isdisjoint(parts):
                found = found or ASIDE
    return found


class Page:
    """Nodes in document order (parents first) and the runs of text between tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.link, self.article, self.header = ["#"], [-1], [False], [False], [False], [False]
        self.kind = [0]  # what `_unwanted` says of each node
        self.runs: list[tuple[int, int, str]] = []  # (node, block, text)
        self.stack, self.open = [0], {"#": [0]}  # open nodes, and their places in the stack by tag
        self.blocks_open, self.fences = [], []  # places of open blocks and fences
        block, done = 0, 0
        find, last = _TAG.search, source.rfind(">") + 1
        while found := find(source, done, last):
            if found.start() > done:
                self._between(block, source[done : found.start()])
            done = found.end()
            if done == last and source.startswith("<!--", found.start()) and not source.endswith("-->", 0, done):
                done = len(source)  # a comment without an end
            closing, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if name in BLOCK:
                block += 1
            if closing:
                self._close(name)
                continue
            self._imply(name)
            if name == "br":
                self._text(self.stack[-1], block, " ")
            node = self._open(self.stack[-1], name, attributes or "")
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, done)
                done = end.end() if end else len(source)
            elif name not in VOID and not (attributes or "").endswith("/"):
                self._push(node, name)
        comment = source.find("<!--", done)
        self._between(block, source[done : comment if comment >= 0 else len(source)])
        self._leave_asides()

    def _between(self, block: int, text: str) -> None:
        if self.tag[self.stack[-1]] == "head" and text.strip():
            self._pop_to(len(self.stack) - 1)
        self._text(self.stack[-1], block, text)

    def _push(self, node: int, tag: str) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.open.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks_open.append(at)
        if tag in FENCE:
            self.fences.append(at)

    def _pop_to(self, size: int) -> None:
        for node in self.stack[size:]:
            self.open[self.tag[node]].pop()
        del self.stack[size:]
        for places in (self.blocks_open, self.fences):
            while places and places[-1] >= size:
                places.pop()

    def _leave_asides(self) -> None:
        """Elements said to be aside are out unless they hold most of the page's content: of the text in its articles and
        main elements, or of all text where it has none. Comments are no content unless everything stands in them."""
        n = len(self.tag)
        named = any(tag in ("article", "main") and not out for tag, out in zip(self.tag, self.out))
        size = [0] * n
        for node, _, text in self.runs:
            if self.article[node] or not named:
                size[node] += len(text) - text.count(" ")
        thread = [False] * n
        for i in range(1, n):
            thread[i] = thread[self.parent[i]] or self.kind[i] == THREAD
        sums = [0 if t else c for c, t in zip(size, thread)]
        if not any(sums):
            sums = size
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                sums[self.parent[i]] += sums[i]
        whole = sums[0]
        for i in range(1, n):
            self.out[i] = self.out[i] or self.out[self.parent[i]] or bool(self.kind[i]) and 2 * sums[i] <= whole
        self.runs = [run for run in self.runs if not self.out[run[0]]]

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        inside = self.article[parent] or tag in ("article", "main")
        self.article.append(inside)
        said = _unwanted(tag, attributes, inside)
        self.header.append(self.header[parent] and tag not in ("h1", "h2", "h3") or tag == "header")
        self.out.append(self.out[parent] or said == OUT)
        self.kind.append(said)
        self.link.append(self.link[parent] or tag == "a")
        return len(self.tag) - 1

    def _text(self, node: int, block: int, text: str) -> None:
        if text and not self.out[node] and not self.header[node]:
            self.runs.append((node, block, text))

    def _imply(self, tag: str) -> None:
        if tag not in HEAD and (tag == "body" or self.tag[self.stack[-1]] == "head") and self.open.get("head"):
            self._pop_to(self.open["head"][0])
        fence = self.fences[-1] if self.fences else 0
        places = [p[bisect_right(p, fence)] for e in ENDS.get(tag, ()) if (p := self.open.get(e)) and p[-1] > fence]
        # an element that is a fence itself can be ended if it is the innermost one
        if fence and self.tag[self.stack[fence]] in ENDS.get(tag, ()):
            places.append(fence)
            below = self.fences[-2] if len(self.fences) > 1 else 0
            places += [p[bisect_right(p, below)] for e in ENDS[tag] if (p := self.open.get(e)) and p[bisect_right(p, below) :]]
        if places:
            self._pop_to(min(places))

    def _close(self, tag: str) -> None:
        places = self.open.get(tag)
        if not places or not places[-1]:
            return
        at = places[-1]
        if tag not in BLOCK and self.blocks_open and self.blocks_open[-1] > at:
            return  # an inline end tag does not end a block
        if tag == "p" and self.fences and self.fences[-1] > at:
            return
        self._pop_to(at)

    def content(self) -> list[bool]:
        """By node: does it belong to the main text?"""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, _, text in self.runs:
            size = len(text) - text.count(" ")
            chars[node] += size
            if self.link[node]:
                link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if self.out[i]:
                continue
            up = self.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + self.link[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        if not chars[body]:
            body = 0
        share = link_chars[body] / max(1, chars[body])

        def density(i: int) -> float:
            c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
            if not c:
                return 0.0
            if not link_chars[body]:
                return c / t
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            scaled = math.log(max(1.0, c / max(1, lc) * t / max(1, lt)))
            return c / t * scaled / math.log(max(base, 1.0001))

        dense = [density(i) for i in range(n)]
        sums = [0.0] * n
        for i in range(1, n):
            if not self.out[i]:
                sums[self.parent[i]] += dense[i]
        inside = [False] * n
        for i in range(n):
            inside[i] = i == body or (i > 0 and inside[self.parent[i]])
        best = max((i for i in range(n) if inside[i] and not self.out[i]), key=lambda i: (sums[i], dense[i], -i))
        least, at = dense[best], best
        while at > body:
            at = self.parent[at]
            least = min(least, dense[at])
        return self._marked(best, least, body, dense, sums, inside)

    def _marked(self, best: int, least: float, body: int, dense: list, sums: list, inside: list) -> list[bool]:
        n = len(self.tag)
        top = list(range(n))  # of each node: the node of highest sum in its subtree
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if not self.out[i] and (sums[top[i]], dense[top[i]]) > (sums[top[up]], dense[top[up]]):
                top[up] = top[i]
        chosen = {best}
        if not self.article[best]:
            for i in range(n):
                if inside[i] and i != body and self.parent[i] == self._frame(best) and dense[i] >= least and not self.out[i]:
                    chosen.add(top[i] if sums[top[i]] else i)
        for i in list(chosen):
            while self.article[i] and self.parent[i] >= 0 and self.article[self.parent[i]]:
                i = self.parent[i]
            chosen.add(i)
        marked = [False] * n
        for i in range(n):
            marked[i] = i in chosen or (i > 0 and marked[self.parent[i]])
        return marked

    def _frame(self, node: int) -> int:
        """The element whose children are weighed against the threshold: the one around the maximum-sum node."""
        return self.parent[node]

    def blocks(self) -> list[str]:
        marked = self.content()
        out: list[tuple[int, list[str]]] = []
        for node, block, text in self.runs:
            if marked[node]:
                if not out or out[-1][0] != block:
                    out.append((block, []))
                out[-1][1].append(text)
        texts = (" ".join(html.unescape("".join(parts)).split()) for _, parts in out)
        return [t for t in texts if t]


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    return "\n\n".join(page.blocks()) if page.runs else ""


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """`pages` without `source`, with `text` and `n_chars` (code points)."""

    @F.pandas_udf("string")
    def texts(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(s) for s in sources], dtype=object)

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in (source.lower(), "text", "n_chars")]
    found = pages.select(*kept, texts(F.col(f"`{source}`")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
