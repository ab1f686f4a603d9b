"""Main text of web pages by minimum cut.

A page is cut into blocks of text at its block-level tags. A classifier over tags, class names, link density and
length gives every block a cost for being called content and one for being called boilerplate; these are the
capacities of its edges to the two terminals. Names say what an element may be, its share of the page's prose decides:
one named like furniture that holds nearly all prose of the page is its layout, not furniture. Blocks that follow each other, and blocks of one parent, are joined
by smoothness edges, the stronger the closer they are in the document tree. The minimum cut, found by maximum
flow, labels the blocks: those on the source side are content.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Element names and the words that class names and ids are made of.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template iframe canvas textarea title xmp".split())
SILENT_TAGS = frozenset("head select option button datalist annotation annotation-xml".split())
#: shown in an article, mere fallbacks and icons elsewhere
INNER_TAGS = frozenset("noscript object svg".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments respond reply "
    "replies disqus discussion feedback cookie cookies consent gdpr notice notices alert announcement popup modal "
    "overlay subscribe subscription newsletter signup login register share sharing social related recommended "
    "recommendations widget pagination pager copyright legal disclaimer search form tags tagcloud toc skip".split())
MAIN_WORDS = frozenset("article content entry post story main body text maintext articlebody".split())
#: furniture whatever is inside; words that make a name one of the layout; items that may be marked up as articles
FIRM_TAGS = frozenset("nav footer aside menu dialog".split())
LAYOUT_WORDS = frozenset("with without has no left right".split())
ITEM_WORDS = frozenset("comment comments reply replies related recommended sponsored promo advertisement widget".split())

_TAG = re.compile(
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>", re.S)
_TAG_NAME = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
_MARK = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: an attribute with its value, or a string that belongs to none
_ATTRIBUTE = re.compile(
    r"\"[^\"]*\"|'[^']*'|(?P<name>[^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_WORD = re.compile(r"[a-z]+")
_CLOSERS: dict[str, re.Pattern] = {t: re.compile(rf"</{t}\b", re.I) for t in RAW_TAGS}
#: headings above what readers wrote
_READERS = re.compile(
    r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)"
    r"(?: ?\(?\d+\)?)?:?", re.I)
_HEADING = re.compile(r"h[1-6]")
#: Open elements; one further below takes the place of the last. Browsers have such a limit, too.
DEEPEST = 100
#: Characters of prose that an element must hold to count as layout, and of such prose elsewhere that forbid it.
LEAST_PROSE, LEAST_CLEAN = 80, 200
#: elements that end when one of the same group begins beside them
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Element:
    name: str
    number: int  # of the element in the page
    chrome: int  # elements up to here that look like page furniture
    main: int  # elements up to here that look like the article
    link: bool
    silent: bool
    firm: int  # elements up to here that are furniture even around an article
    items: frozenset[str]  # ITEM_WORDS up to here, in the singular
    article: bool  # inside an article
    soft: tuple[tuple[int, bool], ...] = ()  # elements up to here whose name alone makes them furniture, and whether it is also one of the article


@dataclass
class Block:
    text: str
    parent: int
    path: tuple[int, ...]
    tag: str
    chrome: int
    main: int
    linked: int  # characters inside links
    soft: tuple[tuple[int, bool], ...] = ()


def _hides(attrs: str) -> bool:
    """Whether attributes hide their element: ``hidden``, ``aria-hidden=true`` or a style of ``display: none``."""
    if not _MAY_HIDE.search(attrs):
        return False
    known: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        if m["name"]:  # the first of equal names counts
            known.setdefault(m["name"].lower(), htmllib.unescape(m[2] or m[3] or m[4] or "").strip().lower())
    shown = _DISPLAY.findall(_COMMENT.sub("", known.get("style", "")))
    return (known.get("hidden", "false") != "false" or known.get("aria-hidden") == "true"
            or bool(shown) and shown[-1] == "none")


def _element(name: str, attrs: str, number: int, above: Element | None) -> Element:
    chrome, main = int(name in CHROME_TAGS), int(name in MAIN_TAGS)
    if name == "header" and not (above and above.main):
        chrome = 1
    hidden, items, firm, also = False, frozenset(), name in FIRM_TAGS, False
    if attrs.strip():
        names = [set(_WORD.findall(w)) for m in _NAMES.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").lower().split()]
        # the page's own frame may carry any name
        if name not in ("html", "body"):
            # beside a name of the article, one like "with-sidebar" tells of the layout
            titled = any(n and n <= MAIN_WORDS for n in names)
            furniture = any(n & CHROME_WORDS and not (titled and n & LAYOUT_WORDS) for n in names)
            chrome += furniture and not main
            also = titled or any(n & MAIN_WORDS for n in names)
            main += also and not chrome
            items = frozenset(w.rstrip("s") for n in names for w in n & ITEM_WORDS)
            firm |= not main and any(n and n <= ITEM_WORDS for n in names)
        hidden = _hides(attrs)
    around, soft = (above.chrome, above.soft) if above else (0, ())
    if above and name in MAIN_TAGS and not above.article and not items & above.items:
        around, soft = above.firm, ()  # named wrappers around an article are layout
    if chrome and not firm and name != "header":
        soft += ((number, also),)
    silent = name in SILENT_TAGS or hidden or name in INNER_TAGS and not (above and (above.article or above.main))
    return Element(name, number, chrome + around, main + (above.main if above else 0),
                   name == "a" or bool(above and above.link), silent or bool(above and above.silent),
                   firm + (above.firm if above else 0), items | (above.items if above else frozenset()),
                   name == "article" or bool(above and above.article), soft)


class Tokens:
    """Marks of a page one after the other, in time proportional to its length however broken it is."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.lost = page, page.rfind(">"), 0

    def next(self, at: int) -> tuple[int, int, re.Match | None] | None:
        """(start, end, tag) of the next mark; comments and declarations have no tag. None when only text follows."""
        page = self.page
        while (m := _MARK.search(page, at)) is not None:
            low = m.start()
            if page.startswith("<!--", low):
                end = page.find("-->", low + 4)
                return low, len(page) if end < 0 else end + 3, None
            if low > self.last:  # nothing closes any more, but comments may be open
                at = page.find("<!--", low)
                if at < 0:
                    return None
                continue
            if page[low + 1] in "!?":
                return low, page.find(">", low) + 1, None
            # quotes that are never closed are read to the end in vain; a page may do so for a few times its length
            patient = self.lost <= 4 * len(page) + 1_000_000
            tag = (_TAG if patient else _TAG_NAME).match(page, low)
            if tag is not None:
                return low, tag.end(), tag
            self.lost += len(page) - low
            at = low + 1
        return None


def blocks_of(page: str | None) -> list[Block]:
    """Blocks of visible text in page order; references decoded, white space made single."""
    page = page or ""
    stack: list[Element] = []
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    number = at = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join([p for p, _ in parts]).split())
            if text:
                frame = [e for e in stack if e.name in BLOCK_TAGS]
                inside = frame[-1] if frame else None
                out.append(Block(text, inside.number if inside else 0, tuple(e.number for e in frame),
                                 inside.name if inside else "", inside.chrome if inside else 0,
                                 inside.main if inside else 0, sum(len(p.strip()) for p, link in parts if link),
                                 inside.soft if inside else ()))
            parts.clear()

    def say(low: int, high: int) -> None:
        if high > low and not (stack and stack[-1].silent):
            parts.append((htmllib.unescape(page[low:high]), bool(stack) and stack[-1].link))

    def close(to: int) -> None:
        if any(e.name in BLOCK_TAGS for e in stack[to:]):
            flush()
        del stack[to:]

    tokens = Tokens(page)
    while at < len(page):
        mark = tokens.next(at)
        if mark is None:
            say(at, len(page))
            break
        low, end, m = mark
        say(at, low)
        at = end
        if m is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    close(k)
                    break
            continue
        if name in RAW_TAGS:
            if not m["attrs"].rstrip().endswith("/"):
                closer = _CLOSERS[name].search(page, at)
                end = page.find(">", closer.end()) if closer else -1
                at = end + 1 if end >= 0 else len(page)
            continue
        if name in VOID_TAGS:
            if name == "hr":
                flush()
            else:
                parts.append((" ", False))
            continue
        if name in BLOCK_TAGS:
            flush()
            if name == "body":
                stack[:] = [e for e in stack if e.name == "html"]
            ends = _IMPLIED.get(name, {"p"} if name not in ("html", "body") else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in ends or (stack[k].name == "p" and name in BLOCK_TAGS):
                    close(k)
                    break
                if stack[k].name in BLOCK_TAGS:
                    break
        if m["attrs"].rstrip().endswith("/"):
            continue
        number += 1
        if len(stack) >= DEEPEST:
            close(DEEPEST - 1)
        stack.append(_element(name, m["attrs"], number, stack[-1] if stack else None))
    flush()
    _readers(out)
    _layout(out)
    return out


def _readers(blocks: list[Block]) -> None:
    """Marks what readers wrote as furniture: what stands below a heading that says so, in its section; where the
    section is the article itself, up to its next heading of that rank."""
    for i, b in enumerate(blocks):
        if not _HEADING.fullmatch(b.tag) or not _READERS.fullmatch(b.text) or len(b.path) < 2:
            continue
        section = b.path[-2]
        # a section of its own begins with its heading
        own = len(b.path) > 2 and not (i and section in blocks[i - 1].path)
        for later in blocks[i:]:
            if section not in later.path or not own and later is not b and _HEADING.fullmatch(later.tag) and later.tag <= b.tag:
                break
            later.chrome += 1


def _layout(blocks: list[Block]) -> None:
    """Takes furniture off elements that hold nearly all prose of the page and owe it to their name only. A page with
    prose marked as the article, or with more than a little prose that nothing calls furniture, needs no such help."""
    prose: dict[int, int] = {}
    clean = soft = 0
    for b in blocks:
        if b.chrome != len(b.soft) or len(b.text) < 40 or b.linked * 10 >= len(b.text) * 3:
            continue
        if not b.soft:
            clean += len(b.text) * (LEAST_CLEAN if b.main else 1)
            continue
        soft += len(b.text)
        for element, _ in b.soft:
            prose[element] = prose.get(element, 0) + len(b.text)
    if clean >= LEAST_CLEAN:
        return
    free = {e for e, n in prose.items() if n >= max(LEAST_PROSE, 4 * clean, 2 * (soft - n))}
    for b in blocks:
        mine = [also for element, also in b.soft if element in free]
        b.chrome -= len(mine)
        b.main += sum(mine)


def costs(block: Block) -> tuple[int, int]:
    """(evidence for content, evidence for boilerplate) in whole units, never negative."""
    content = boiler = 0
    if block.chrome:
        boiler += 120 * min(block.chrome, 3)
    if block.main:
        content += 60 * min(block.main, 3)
    density = min(block.linked / max(len(block.text), 1), 1.0)
    boiler += int(40 * density)
    if density < 0.3:
        content += 8 + min(len(block.text) // 20, 20)
    if block.tag in ("h1", "h2", "h3", "p", "blockquote", "pre"):
        content += 6
    if not block.main and len(block.text) < 25:
        boiler += 6
    return content, boiler


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of the smallest minimum cut. ``edges`` (a, b, capacity) hold in
    both directions. Augments along shortest paths, level by level, without recursion."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # flows straight through
        if source[i] > both:
            join(s, i, source[i] - both, 0)
        elif sink[i] > both:
            join(i, t, sink[i] - both, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                back = next(k for k, e in enumerate(path) if room[e] == 0)
                u = to[path[back] ^ 1]
                del path[back:]
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if room[e] > 0 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def neighbours(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: between successive blocks by the share of their paths they have in common, and
    between a block and the next one of the same parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            common = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                common += 1
            edges.append((i - 1, i, 1 + 8 * common // max(len(a.path), len(b.path), 1)))
        above = b.path[-2] if len(b.path) > 1 else 0
        if above in last and last[above] != i - 1:
            edges.append((last[above], i, 4))
        last[above] = i
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by an empty line; empty where there is none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    known = [costs(b) for b in blocks]
    chosen = min_cut([c for c, _ in known], [b for _, b in known], neighbours(blocks))
    return "\n\n".join(b.text for b, content in zip(blocks, chosen) if content)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    Null and empty pages give an empty text. Null ids and urls and repeated rows are kept as given; other
    columns are not read. Pages are worked off one by one, so memory is bounded by the longest.
    """
    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")
                        ).mapInPandas(per_task, "page_id bigint, url string, text string, n_chars bigint")
