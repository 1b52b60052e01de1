"""Main text of web pages by tag-path ratios.

A page is read once into a tree of block elements and text blocks, each with its root-to-leaf path of block
tags. What an element's kind says is no text goes at once: nav, header, footer, aside and the like, and raw ones
(script, style, ...), if they are closed; so do forms, but those that hold an article, a main element or half of the
page's text. For each path the text length and the punctuation marks of its blocks are added up
and divided by the number of its blocks; both ratios are smoothed over the blocks in page order (a Gaussian of
three blocks), multiplied, weighted by the share of text outside links and by article or main ancestors, and
held against half the standard deviation over the page. A class, id or role that names menus, adverts, notices,
comments or the like is a hint: the paths below such an element, which are told apart from others, weigh HINTED
times as much. It is none around the page's first article or main element or nine tenths of its text (unless a
name begins with the word, as in comment-list, and there is no article in it), and none at all if less than a
tenth of the text is free of hints.

The paths that reach the threshold choose the content. All blocks of the deepest element that holds nine tenths
of their text, or of the article or main element around it, are part of the text, but for hinted ones; so is every
chosen block elsewhere, and what stands in the deepest element around all of these and the first h1 before them,
unless more than half of it is links (so titles, leads and short sections stay).

Broken pages keep their text. A tag ends at the first '>' outside quotes, and quotes count only where a value begins;
after a tag that never ends so, quotes count no more on the page, and a '<' without a '>' after it is text. An element
that would go with all its contents (head, nav, video, svg, ...), or a link, that has no end tag of its own is as if it were not there;
a script or style without one ends where an element of the page's body begins, a title or textarea at the next tag.

Character references are decoded, white space in a block becomes one space, blocks are joined by two
newlines; nothing is cut off. Work and memory grow in proportion to the page, however deep its tags are. Null,
empty or text-free html gives the empty string; repeated rows give repeated results; no rows give no rows; other
columns of the input are ignored.
"""
from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ripplescope.llm import _common as C

HINTED = 0.02
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_BODY = re.compile(r"</?(?:head|body|article|main|section|div|p|h[1-6]|ul|ol|table)\b", re.I)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[.,;:!?…。，；：！？、]")
# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noembed noframes xmp".split())
_SKIPPED = frozenset("noscript template iframe svg object canvas select audio video".split())
_OUT = frozenset("head nav header footer aside button menu dialog fieldset label datalist output".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math mrow mi mn mo ms mtext mfrac msup msub msqrt mroot semantics annotation".split()
)
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol dl table tbody thead tfoot div section article main body blockquote".split())
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments respond disqus reply replies sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies notice notices notification alert consent gdpr popup modal overlay subscribe subscription newsletter signup share "
    "sharing social related recommended recommendations widget widgets login search pagination pager toolbar skip hidden complementary contentinfo tags copyright".split()
)


class Block(NamedTuple):
    node: int  # the element that it stands in
    text: str
    linked: int  # characters in links


class _Ends:
    """Where the elements of some kinds end that a page opens and closes, each start matched with the next free end after it."""

    def __init__(self, html: str, kinds: frozenset[str]):
        self.html, self.kinds, self.known = html, kinds, None

    def of(self, start: int) -> tuple[int, int] | None:
        """From where to where the end tag goes of the element whose tag starts here."""
        if self.known is None:
            self.known, opened = {}, {}
            for m in re.finditer(rf"<(/?)({'|'.join(sorted(self.kinds))})(?=[\s/>])", self.html, re.I):
                kind = m[2].lower()
                if not m[1]:
                    opened.setdefault(kind, []).append(m.start())
                elif opened.get(kind):
                    stop = self.html.find(">", m.end())
                    self.known[opened[kind].pop()] = m.start(), stop + 1 if stop >= 0 else len(self.html)
        return self.known.get(start)


class Page:
    """The tree of a page's block elements, numbered as they begin, and its text blocks."""

    def __init__(self) -> None:
        self.tag, self.parent, self.last, self.depth = ["#"], [-1], [0], [0]
        self.hint = [0]  # 0 without a mark, 2 if a name begins with one (comments, ad-top), 1 if it is elsewhere in one (has-sidebar)
        self.blocks: list[Block] = []

    def within(self, node: int, root: int) -> bool:
        return root <= node <= self.last[root]


def _marked(tag: str, attributes: str) -> int:
    if tag in ("html", "body", "main"):
        return 0
    most = 0
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [name.lower()] if tag == "article" else [w.lower() for w in _WORD.findall(name)]
            if not _MARKS.isdisjoint(words):
                most = max(most, 2 if words[0] in _MARKS else 1)
    return most


def read(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = []  # tag, node; inline elements have their block's node
    count: Counter[str] = Counter()  # of open tags
    text: list[str] = []
    forms: list[int] = []
    gone = linked = links = 0  # gone: depth of the stack where the outermost element left out began
    ends = _Ends(html, _SKIPPED | _OUT | {"a"})
    endless: set[str] = set()  # raw kinds without an end tag from here on

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            if joined:
                page.blocks.append(Block(stack[-1][1] if stack else 0, joined, linked))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal links, gone
        tag, node = stack[-1]
        if tag not in _INLINE:
            flush()
            page.last[node] = len(page.tag) - 1
        stack.pop()
        count[tag] -= 1
        if tag == "a":
            links -= 1
        if len(stack) < gone:
            gone = 0

    def pop_to(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        if not any(count[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in stop:
                return

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not gone:
            text.append(piece)
            if links:
                linked += len(piece)

    def raw_end(kind: str, start: int) -> int:
        """Where a raw element's contents and its end tag are over."""
        if kind not in endless:
            end = re.compile(rf"</{kind}(?=[\s/>])", re.I).search(html, start)
            if end:
                return html.find(">", end.end()) + 1 or len(html)
            endless.add(kind)
        if kind in ("script", "style"):
            end = _BODY.search(html, start)
            return end.start() if end else len(html)
        end = html.find("<", start)
        return end if end >= 0 else len(html)

    at, begin, last, tags = 0, 0, html.rfind(">"), _TAG
    while True:
        at = html.find("<", at)
        if at >= 0 and html.startswith("<!--", at):
            stop = html.find("-->", at + 2)
            m, stop = None, stop + 3 if stop >= 0 else len(html)
        elif at < 0 or at > last:
            break
        elif html[at + 1] in "!?":
            m, stop = None, html.find(">", at) + 1
        elif html[at + 1].isascii() and (html[at + 1].isalpha() or html[at + 1] == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha()):
            m = tags.match(html, at)
            if not m:  # its quotes reach beyond the page
                tags = _BARE_TAG
                m = tags.match(html, at)
            stop = m.end()
        else:
            at += 1
            continue
        add(html[begin:at])
        start, at = at, stop
        begin = at
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if count[tag]:
                pop_to((tag,), frozenset())
            continue
        if tag in _VOID or m[3].endswith("/") and (tag == "svg" or count["svg"] or count["math"]):
            if tag in ("br", "hr", "img", "input") and not gone:
                text.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in _RAW:  # a closing slash means nothing here, as in browsers
            at = begin = raw_end(tag, at)
            continue
        if tag in _SKIPPED:
            if end := ends.of(start):
                at = begin = end[1]
            continue
        if tag == "a" and not ends.of(start):
            continue
        if tag not in _INLINE:
            pop_to(("p",), _HOLDS)
            if tag in _ENDS:
                pop_to(_ENDS[tag], _HOLDS)
            flush()
            over = stack[-1][1] if stack else 0
            page.tag.append(tag)
            page.parent.append(over)
            page.depth.append(page.depth[over] + 1)
            page.hint.append(_marked(tag, m[3]))
            page.last.append(len(page.tag) - 1)
            node = len(page.tag) - 1
        else:
            node = stack[-1][1] if stack else 0
        if tag == "a":
            links += 1
        stack.append((tag, node))
        count[tag] += 1
        if tag == "form":
            forms.append(node)
        if tag in _OUT and not gone and ends.of(start):
            gone = len(stack)
    add(html[begin:])
    flush()
    while stack:
        pop()
    if forms:
        _drop_forms(page, forms)
    return page


def _drop_forms(page: Page, forms: list[int]) -> None:
    """Takes out the text of forms, unless they hold an article, a main element or half of the page's text."""
    n = len(page.tag)
    size, articles = [0] * n, [0] * (n + 1)
    for b in page.blocks:
        size[b.node] += len(b.text)
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
    for i in range(n):
        articles[i + 1] = articles[i] + (page.tag[i] in ("article", "main"))
    small = {f for f in forms if 2 * size[f] < size[0] and articles[f] == articles[page.last[f] + 1]}
    within = [False] * n
    for i in range(1, n):
        within[i] = i in small or within[page.parent[i]]
    page.blocks = [b for b in page.blocks if not within[b.node]]


def _hints(page: Page) -> list[bool]:
    """Whether each element is, or lies in, one that a name marks and that isn't around the article or nearly everything."""
    n = len(page.tag)
    size = [0] * n
    for b in page.blocks:
        size[b.node] += len(b.text)
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
    first = next((i for i in range(n) if page.tag[i] in ("article", "main")), -1)

    def counts(i: int) -> bool:
        if page.hint[i] == 1 and first > i and page.within(first, i):
            return False
        return page.hint[i] > 0 and size[i] < 0.9 * size[0]

    hinted = [False] * n
    for i in range(1, n):
        hinted[i] = hinted[page.parent[i]] or counts(i)
    free = sum(len(b.text) for b in page.blocks if not hinted[b.node])
    return [False] * n if 10 * free < size[0] else hinted


def scores(page: Page, hinted: list[bool]) -> list[float]:
    """The fused, smoothed path ratio of each block."""
    known: dict[tuple[int, str, bool], int] = {}
    path, inside = [0] * len(page.tag), [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        over = page.parent[i]
        path[i] = known.setdefault((path[over], page.tag[i], hinted[i]), len(known) + 1)
        inside[i] = inside[over] or page.tag[i] in ("article", "main")
    sums: dict[int, list[float]] = {}
    for b in page.blocks:
        s = sums.setdefault(path[b.node], [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_PUNCT.findall(b.text))
        s[3] += min(b.linked, len(b.text))
    own = [sums[path[b.node]] for b in page.blocks]
    kernel = (math.exp(-0.5), 1.0, math.exp(-0.5))

    def smooth(v: list[float]) -> list[float]:
        out = []
        for i in range(len(v)):
            near = [(kernel[d + 1], v[i + d]) for d in (-1, 0, 1) if 0 <= i + d < len(v)]
            out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        return out

    ratios = zip(smooth([s[1] / s[0] for s in own]), smooth([(s[2] + 0.5) / s[0] for s in own]), own, page.blocks)
    return [a * b * (1 - s[3] / s[1]) * (8 if inside[x.node] else 1) * (HINTED if hinted[x.node] else 1) for a, b, s, x in ratios]


def main_text(html: str | None) -> str:
    page = read(html or "")
    blocks = page.blocks
    if not blocks:
        return ""
    hinted = _hints(page)
    score = scores(page, hinted)
    mean = sum(score) / len(score)
    spread = math.sqrt(sum((s - mean) ** 2 for s in score) / len(score))
    kept = [i for i, s in enumerate(score) if s >= 0.5 * spread and not (spread and s < mean and hinted[blocks[i].node])]
    kept = kept or [i for i, b in enumerate(blocks) if not hinted[b.node]] or list(range(len(blocks)))
    held = [0] * len(page.tag)
    for i in kept:
        held[blocks[i].node] += len(blocks[i].text)
    total = sum(held)
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] += held[i]
    root = max((i for i in range(len(held)) if held[i] >= 0.9 * total and (not i or page.tag[i] in _HOLDS)), key=lambda i: page.depth[i])
    at, around = root, 0
    while at > 0:  # the outermost article or main element around it
        around = at if page.tag[at] in ("article", "main") else around
        at = page.parent[at]
    root = around or root
    title = next((i for i in range(kept[0]) if _in_h1(page, blocks[i].node) and not hinted[blocks[i].node]), kept[0])
    whole = root
    ends = [blocks[i].node for i in (*kept, title)]
    low, high = min(ends), max(ends)
    while whole > 0 and not (whole <= low and high <= page.last[whole] and page.tag[whole] in _HOLDS):
        whole = page.parent[whole]
    chosen = set(kept)

    def wanted(i: int, b: Block) -> bool:
        if i in chosen:
            return True
        if hinted[b.node] and not hinted[root]:
            return False
        return page.within(b.node, root) or page.within(b.node, whole) and 2 * b.linked <= len(b.text)

    return "\n\n".join(b.text for i, b in enumerate(blocks) if wanted(i, b))


def _in_h1(page: Page, node: int) -> bool:
    """Whether the element is, or is in, an h1 (of the few elements next around it)."""
    for _ in range(4):
        if page.tag[node] == "h1":
            return True
        node = max(page.parent[node], 0)
    return False


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of `pages`, in its partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in C.text_groups(batch.column(2)):
                texts = [main_text(html) for html in group]
                columns = [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, url_col, "text", "n_chars"])

    source = pages.select(id_col, url_col, pages[html_col].cast("string").alias("__html"))
    return source.mapInArrow(run, T.StructType([source.schema[0], source.schema[1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
