"""Main text of web pages by composite text density.

A page becomes a tree. The density of a node is its characters per tag, lowered by the share of linked characters and tags
(composite text density). The subtree whose children's densities sum to the most is the article; the least density on the
path from the body to it is the threshold beside that path. Parts that say what they are (navigation, footers, forms,
adverts, comments and so on, by tag or by a class, id or role that says nothing else) are taken off first, and where the
name may also be the topic of a section (discussion, search, related), only if the part is less dense than the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are not article text wherever they are.
NOT_TEXT = frozenset(
    "head script style title noscript template iframe object embed applet svg math canvas audio video map select option optgroup datalist button input textarea form nav footer aside dialog menu noembed noframes xmp frameset".split()
)
#: Words of a class, id or role that say the same of any element.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup signin login paywall menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar sidenav side "
    "aside rail widget widgets related recommended recommendations share sharing social comment comments commentlist disqus respond reply replies discussion footer foot header masthead topbar toolbar search "
    "contentinfo complementary copyright skip".split()
)
#: Those of them that also name what a text is about.
TOPICS = frozenset("notice notices alert consent promotion promoted subscription side rail widget widgets related recommended recommendations share sharing social respond reply replies discussion search skip banner foot".split())
#: Words beside them in a name that change nothing: ad-slot, sidebar-right, comment-list.
BESIDE = frozenset(
    "box block section area container wrapper wrap inner outer list item items bar left right top bottom site page post posts entry article primary secondary main global link links button buttons "
    "icon icons form field slot unit panel group row column col holder module region zone text title content body author meta count".split()
)
#: Elements that are article text whatever their names.
TEXT_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Raw elements that, where they are never closed, hold nothing.
_OPEN_ENDED = frozenset("noscript template".split())
#: A form with so many paragraphs is wrapped around a page.
FORM_PARAGRAPHS = 3
OF_COMMENTS = frozenset("comment comments commentlist disqus reply replies".split())
#: Block elements that are parts of a text, so none of them alone is an article.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl pre blockquote figure figcaption table tbody thead tfoot tr caption br hr address hgroup header details summary".split())
#: Elements that an open p ends at, besides block elements.
_P_STAYS_IN = frozenset("table td th caption button object".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_CLOSES_WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}

_TOKEN = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*+>|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""", re.DOTALL)
_LOOSE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>")
#: One attribute, with its value, so that what stands in a value is never taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _named(value: str) -> set[str]:
    """The words of NOT_ARTICLE in those names of a class, id or role that hold no other word."""
    found: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)} if name.lower() not in NOT_ARTICLE else {name.lower()}
        if words & NOT_ARTICLE and words <= NOT_ARTICLE | BESIDE:
            found |= words & NOT_ARTICLE
    return found


class Page:
    """The tree of a page in document order: tag, parent and what a node's attributes say, and the texts between tags."""

    def __init__(self, html: str):
        self.tags, self.parents, self.said, self.unseen = ["#page"], [0], [frozenset()], [False]
        #: (node, text), with None for a border between blocks.
        self.texts: list[tuple[int, str | None]] = []
        stack = [0]
        at = start = 0
        final = html.rfind(">")
        while True:
            begin = html.find("<", at)
            if begin < 0 or begin > final:
                break
            m = _TOKEN.match(html, begin) or _LOOSE.match(html, begin)
            if m is None:
                at = begin + 1
                continue
            if begin > start:
                self._text(stack[-1], html[start:begin])
            at = start = m.end()
            found = m.groupdict()
            if found.get("cdata"):
                self.texts.append((stack[-1], found["cdata"]))
            if not found["tag"]:
                continue
            tag = found["tag"].lower()
            if found["end"]:
                self._close(stack, tag)
            else:
                at = start = self._open(stack, tag, found["rest"], html, at)
        if start < len(html):
            self._text(stack[-1], html[start:])

    def _text(self, node: int, text: str) -> None:
        self.texts.append((node, unescape(text) if "&" in text else text))

    def _open(self, stack: list[int], tag: str, rest: str, html: str, at: int) -> int:
        block = tag not in INLINE
        if block and tag != "br":
            self._end_implied(stack, tag)
        node = len(self.tags)
        said, unseen = frozenset(), False
        if rest and not rest.isspace():
            words: set[str] = set()
            for name, *values in _ATTRIBUTE.findall(rest):
                name, value = name.lower(), next((v for v in values if v), "")
                if name in ("class", "id", "role"):
                    words |= _named(unescape(value))
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
                    unseen = True
            said = frozenset(words)
        self.tags.append(tag)
        self.parents.append(stack[-1])
        self.said.append(said)
        self.unseen.append(unseen)
        if block:
            self.texts.append((node, None))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(html, at)
            if end is None:
                return at if tag in _OPEN_ENDED else len(html)
            close = html.find(">", end.end())
            return len(html) if close < 0 else close + 1
        if tag not in VOID:  # a slash ends void elements alone
            stack.append(node)
        return at

    def _end_implied(self, stack: list[int], tag: str) -> None:
        closes, within = _CLOSES.get(tag, ()), _CLOSES_WITHIN.get(tag, ("table",))
        for i in range(len(stack) - 1, 0, -1):
            own = self.tags[stack[i]]
            if own == "p" or own in closes:
                del stack[i:]
            elif own in within or own in _P_STAYS_IN or own not in INLINE:
                if not closes or own in within:
                    break
                if own not in ("div", "section", "article", "td", "th", "tr", "tbody", "thead"):
                    break

    def _close(self, stack: list[int], tag: str) -> None:
        inline = tag in INLINE
        for i in range(len(stack) - 1, 0, -1):
            own = self.tags[stack[i]]
            if own == tag:
                del stack[i:]
                break
            if inline and own not in INLINE:
                break
        if not inline:
            self.texts.append((stack[-1], None))


def _off(page: Page) -> tuple[list[bool], list[bool]]:
    """Whether each node is, or is inside, a part that says it is no article text; whether it only may say so."""
    n = len(page.tags)
    doubtful = [False] * n
    holds, paragraphs = [False] * n, [0] * n  # the page's main or article element, and how many paragraphs
    for i in range(n - 1, 0, -1):
        own = page.tags[i] in ("main", "article") and not page.said[i] & OF_COMMENTS
        if own or holds[i]:
            holds[page.parents[i]] = True
        paragraphs[page.parents[i]] += paragraphs[i] + (page.tags[i] == "p")
    off, inside = [False] * n, [False] * n
    for i in range(1, n):
        tag, up = page.tags[i], page.parents[i]
        inside[i] = inside[up] or tag in ("main", "article")
        if off[up] or page.unseen[i] or (tag in NOT_TEXT and not (tag == "form" and (holds[i] or paragraphs[i] >= FORM_PARAGRAPHS))):
            off[i] = True
        elif tag == "header" and not inside[i] and not holds[i]:
            off[i] = True
        elif tag in ("html", "body", "main") or tag in TEXT_PARTS or holds[i]:
            off[i] = False
        elif tag == "article":
            off[i] = bool(page.said[i] & OF_COMMENTS)
        else:
            words = page.said[i] - ({"header"} if inside[i] else set())
            off[i] = bool(words - TOPICS)
            doubtful[i] = bool(words) and not off[i]
    return off, doubtful


def _densities(page: Page, off: list[bool]) -> tuple[int, list[int], list[float]]:
    """The body, how many tags are in each node, and each node's composite density; nodes that are off count nowhere."""
    n = len(page.tags)
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.texts:
        if text and not off[node]:
            chars[node] += len("".join(text.split()))
    of_link = [False] * n
    for i in range(1, n):
        of_link[i] = of_link[page.parents[i]] or page.tags[i] == "a"
        if of_link[i]:
            linked[i] = chars[i]
    for i in range(n - 1, 0, -1):
        if not off[i]:
            up = page.parents[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (page.tags[i] == "a")
            chars[up] += chars[i]
            linked[up] += linked[i]
    body = next((i for i in range(n) if page.tags[i] == "body"), 0)
    if not chars[body]:
        body = 0
    share = linked[body] / chars[body] if chars[body] else 0.0

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], max(tags[i], 1), linked[i], links[i]
        if not c:
            return 0.0
        base = log(c / max(c - lc, 1) * lc + share * c + e)
        return c / t * max(log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / max(log(max(base, 1.0001)) + 1, 1)

    return body, tags, [0.0 if off[i] else density(i) for i in range(n)]


def main_text(html: str | None) -> str:
    """The article of a page, its blocks in page order joined by one space; empty for a page without text."""
    if not html:
        return ""
    page = Page(html)
    off, doubtful = _off(page)
    body, tags, densities = _densities(page, off)
    if any(doubtful):
        for i in range(1, len(off)):
            off[i] = off[i] or off[page.parents[i]] or (doubtful[i] and densities[i] < densities[body])
        body, tags, densities = _densities(page, off)
    n = len(page.tags)
    sums = [0.0] * n
    for i in range(1, n):
        sums[page.parents[i]] += densities[i]
    under = [i == body for i in range(n)]
    for i in range(1, n):
        under[i] = under[i] or under[page.parents[i]]
    whole = (i for i in range(n) if under[i] and not off[i] and page.tags[i] not in INLINE and page.tags[i] not in PARTS)
    best = i = max(whole, key=lambda i: (sums[i], -i), default=body)
    while i != body:  # an article element that holds the subtree is the article
        if page.tags[i] in ("article", "main"):
            best = i
            break
        i = page.parents[i]
    path = {best}
    i = best
    while i != body:
        i = page.parents[i]
        path.add(i)
    threshold = min(densities[i] for i in path)
    taken = [False] * n
    for i in range(n):
        if off[i]:
            continue
        up = page.parents[i]
        taken[i] = i in path or (i > 0 and taken[up] and (up not in path or up == best or densities[i] >= threshold or tags[i] == 0))
    blocks, words = [], []
    for node, text in page.texts:
        if text is None:
            if words:
                blocks.append(" ".join("".join(words).split()))
                words = []
        elif taken[node]:
            words.append(text)
    blocks.append(" ".join("".join(words).split()))
    return " ".join(b for b in blocks if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, len(batch), 500):
            part = batch.slice(row, 500)
            texts = [main_text(html) for html in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html); a null html has an empty text.

    Each page is read whole in the task that scans it; nothing is shuffled. Other columns are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
