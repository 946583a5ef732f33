"""Main text of HTML pages by composite text density.

A page becomes a tree of nodes. Each node's density is its characters per tag, adjusted by how
much of it is link text; the node whose children's densities have the largest sum holds the
article. The smallest density on the path from it to the body is the page's threshold: the subtree
grows to the enclosing article or main element if that is denser, and nothing in it is left out.
Else all blocks beside the path that reach the threshold are text too, and sparser containers and
blocks of links among them are left out. What tags and attributes say is never content (navigation,
footers, forms, hidden parts) is left out beforehand. Names (adverts, notices, sidebars, reader
comments) count on containers only: headings and paragraphs are called what they are about. A name
that may as well describe a layout ("layout sidebar-right", "page nav-open") leaves out no element
that holds the page's article: its article or main element, or else the node whose children's
densities have the largest sum.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.session import python_path, read_table

# fixed values: classes of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object audio video canvas select xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
NEVER = frozenset("head nav footer aside form script style noscript template button menu dialog search fieldset input label annotation annotation-xml".split())
#: an open element of these is closed by a start tag of the given set
SIBLINGS = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"),
}
#: headings, whose names are slugs of their texts
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: ids of these are names; of others, and of sections within an article, they are slugs
NAMED = frozenset("div section ul ol dl table aside span center".split())
#: below the threshold these are left out beside text
CONTAINER = frozenset("div section center table tbody tr td".split())
SCOPE = frozenset("table ul ol dl menu div section article main body html".split())
#: a name in a class or id
NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-bar|comments?|comment-?list|disqus|respond|replies|cookies?|consent|gdpr|notices?|alert|popup|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|login|menu|nav\w*|navbar|breadcrumbs?|pagination|pager|footer|masthead|site-?header|page-?header|share|sharing|social|related|recommended|widget|toolbar|skip|search|hidden|sr-only|visually-hidden)(?=$|[\s_-])",
    re.I,
)
#: words that go with a name without changing what it names
AFFIX = frozenset("site page main global top bottom primary secondary left right area bar block box body container content form group heading inner item items link links list module outer panel posts section text title widget wrap wrapper message entry post user reader thread".split())
#: these say how a page looks, not what an element is
STATE = frozenset("left right open opened closed collapsed expanded visible shown fixed sticky top bottom active enabled on off".split())
#: classes of elements that hold a page's parts
LAYOUT = re.compile(r"(?:^|\s)(?:layout|page|wrapper|container|row|content|main|site|grid|columns?|col(?:-\w+)*|[\w-]+-wrapper|[\w-]+-container)(?=$|\s)", re.I)
#: remarks of readers: what holds these is no article, even if each is one
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|disqus|respond|replies)(?=$|[\s_-])", re.I)
#: "has-sidebar" says what a page has, not what the element is
HAS = re.compile(r"\b(?:has|have|no|with|without|show|hide|is)[-_]+[\w-]+", re.I)
ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
TAG_START = re.compile(r"[a-zA-Z/!?]")
TAG_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
QUOTE_OR_END = re.compile("[\"'>]")


#: what an element's tag and attributes say of it
CONTENT, MAYBE, NAMED_SO, REMARK, OUT = range(5)


def _names(value: str) -> int:
    """What a class or id says: a name alone or with usual affixes, or one that may describe a layout."""
    value = HAS.sub(" ", value)
    if not NAME.search(value):
        return CONTENT
    layout = bool(LAYOUT.search(value))
    for token in value.split():
        m = NAME.search(token)
        if m:
            rest = [w for w in re.split("[_-]+", (token[: m.start()] + "-" + token[m.end() :]).lower()) if w]
            if not layout and not any(w in STATE for w in rest) and all(w in AFFIX or w.isdigit() or NAME.fullmatch(w) for w in rest):
                return REMARK if REMARKS.search(token) else NAMED_SO
    return MAYBE


def _boilerplate(tag: str, attrs: str, in_article: bool) -> int:
    if tag in NEVER or (tag == "header" and not in_article):  # of a header in main, ``_headers`` judges
        return OUT
    if not attrs or tag in ("body", "html", "article", "main") and "hidden" not in attrs and tag != "article":
        return CONTENT
    found = CONTENT
    for name, *value in ATTR.findall(attrs):
        name, value = name.lower(), value[0] or value[1] or value[2]
        if name == "class" and tag not in HEADING or name == "id" and tag in NAMED and not (tag == "section" and in_article):
            found = max(found, _names(value))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLE) or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return OUT
    return found


def text_density(chars: int, link_chars: int, tags: int, link_tags: int, page_links: float) -> float:
    """Characters per tag, less where links hold many of them; ``page_links``: the share of characters in links on the whole page."""
    if not chars:
        return 0.0
    t, lt = max(1, tags), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + page_links * chars + math.e)
    return chars / t * math.log(max(1.0, chars / max(1, link_chars) * t / lt)) / max(1.0, math.log(max(math.e, base)) if base > math.e else 1.0)


class Page:
    """Nodes in page order (a subtree is a range of them) and the pieces of text between block boundaries."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.out, self.inside = ["#root"], [-1], [False], [False]
        self.link = [False]
        #: elements whose names speak against them, with how much
        self.named: list[tuple[int, int]] = []
        self._closing: tuple[list[int], list[int]] | None = None
        #: (node, text); text None: a block begins or ends
        self.items: list[tuple[int, str | None]] = []
        self._parse(source)
        self._headers()
        if self.named:
            self._judge_names()

    def _ends(self) -> list[int]:
        """Where each node's range ends."""
        end = list(range(1, len(self.tag) + 1))
        for k in range(len(end) - 1, 0, -1):
            end[self.parent[k]] = max(end[self.parent[k]], end[k])
        return end

    def _headers(self) -> None:
        """A header in main, but in no article, that has no heading is the site's."""
        if "header" not in self.tag:
            return
        n, end = len(self.tag), self._ends()
        article, headings = [t == "article" for t in self.tag], [0] * (n + 1)
        for k in range(n):
            article[k] = article[k] or (k > 0 and article[self.parent[k]])
            headings[k + 1] = headings[k] + (self.tag[k] in HEADING)
        for k in range(1, n):
            if self.tag[k] == "header" and not article[k] and not self.out[k] and headings[end[k]] == headings[k]:
                self.out[k : end[k]] = [True] * (end[k] - k)

    def _judge_names(self) -> None:
        """Leave out the elements with names, but for those that hold the article.

        An article or main element outside them all is the article, or else the longest within any
        that are no remarks of readers. Without one it is the best node by density, and only names
        that may describe a layout give way to it.
        """
        chars, _, _, _, end, density, _, body = self.measure()
        level = [CONTENT] * len(self.tag)
        for k, how in self.named:
            level[k] = how
        for k in range(1, len(self.tag)):
            level[k] = max(level[k], level[self.parent[k]])
        articles = [k for k in range(1, len(self.tag)) if self.tag[k] in ("article", "main") and not self.out[k] and chars[k]]
        free = any(level[k] == CONTENT for k in articles)
        inside = [k for k in articles if level[k] < REMARK]
        keep: set[int] = set()
        if not free and inside:
            k = max(inside, key=lambda k: (chars[k], -k))
            while k > 0:
                keep.add(k)
                k = self.parent[k]
        elif not free:
            sure = [0.0] * len(self.tag)  # sums of densities without children of a sure name
            for k in range(1, len(self.tag)):
                if level[k] <= MAYBE:
                    sure[self.parent[k]] += density[k]
            k = max(range(body, len(self.tag)), key=lambda k: (not self.out[k] and level[k] <= MAYBE, sure[k], density[k], -k))
            while k > 0:
                keep.add(k)
                k = self.parent[k]
        for k, _ in self.named:
            if k not in keep and not self.out[k]:
                self.out[k : end[k]] = [True] * (end[k] - k)
        self.items = [x for x in self.items if x[1] is None or not self.out[x[0]]]

    def _parse(self, s: str) -> None:
        stack, is_open, at, n = [0], {}, 0, len(s)
        low = None

        def close(depth: int) -> None:
            while len(stack) > depth:
                t = self.tag[stack.pop()]
                is_open[t] -= 1
                if t in BLOCK:
                    self.items.append((stack[-1], None))

        def close_tags(tags: tuple[str, ...], stop: frozenset[str]) -> None:
            if any(is_open.get(t) for t in tags):
                for d in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[d]]
                    if t in tags:
                        close(d)
                        return
                    if t in stop:
                        return

        while at < n:
            i = s.find("<", at)
            if i < 0 or i + 1 >= n:
                self._text(stack[-1], s[at:] if i < 0 else s[at:i])
                return
            if not TAG_START.match(s, i + 1):
                self._text(stack[-1], s[at : i + 1])
                at = i + 1
                continue
            if i > at:
                self._text(stack[-1], s[at:i])
            if s.startswith("<!--", i):
                j = s.find("-->", i + 4)
                at = n if j < 0 else j + 3
                continue
            m = self._tag(s, i)
            if not m:
                j = s.find(">", i)
                if j < 0:
                    return  # a tag that the page's end cuts off
                m, at = (TAG.match(re.sub("[\"']", " ", s[i : j + 1])) if s[i + 1] not in "!?" else None), j + 1
                if not m:
                    continue
            else:
                at = m.end()
            end, tag, attrs = m[1], m[2].lower(), m[3]
            if end:
                if is_open.get(tag):
                    stop = SCOPE - {tag} if tag not in BLOCK else frozenset(("td", "th", "table") if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else ())
                    if tag in BLOCK or tag in ("a", "span"):
                        close_tags((tag,), stop)
                    else:
                        close_tags((tag,), BLOCK)
                elif tag in BLOCK:
                    self.items.append((stack[-1], None))
                continue
            if tag in RAW:
                if low is None:
                    low = s.lower()
                    if len(low) != n:  # a few characters change their length; keep offsets
                        low = re.sub("[A-Z]+", lambda x: x[0].lower(), s)
                if not attrs.endswith("/"):
                    j = low.find("</" + tag, at)
                    if j < 0:
                        at = n
                    else:
                        k = s.find(">", j)
                        at = n if k < 0 else k + 1
                continue
            if tag in CLOSES_P:
                close_tags(("p",), frozenset(("table", "td", "th", "button")))
            if tag in SIBLINGS:
                close_tags(SIBLINGS[tag], frozenset(("table",) if tag[0] == "t" else ("ul", "ol", "dl", "menu", "table")))
            if tag in ("html", "body") and is_open.get(tag):
                continue
            if tag in VOID:
                self.items.append((stack[-1], None if tag == "hr" else " "))
                continue
            p = stack[-1]
            k = len(self.tag)
            self.tag.append(tag)
            self.parent.append(p)
            inside = self.inside[p] or tag in ("article", "main")
            self.inside.append(inside)
            how = _boilerplate(tag, attrs, self.inside[p])
            self.out.append(self.out[p] or how == OUT)
            if CONTENT < how < OUT and not self.out[k]:
                self.named.append((k, how))
            self.link.append(self.link[p] or tag == "a")
            if tag in BLOCK:
                self.items.append((k, None))
            if not attrs.endswith("/") or tag in BLOCK:
                stack.append(k)
                is_open[tag] = is_open.get(tag, 0) + 1

    def _tag(self, s: str, i: int) -> re.Match | None:
        """The tag that begins at ``i``. Once one has no end outside quotes, which of all others have one is found in one backward pass."""
        if self._closing is None:
            m = TAG.match(s, i)
            if m or not TAG_NAME.match(s, i):
                return m
            at, ends = [], []
            out = double = single = False  # whether a tag that is outside quotes, or in quotes, at this place comes to an end
            for q in reversed(list(QUOTE_OR_END.finditer(s))):
                at.append(q.start())
                out, double, single = (True, double, single) if q[0] == ">" else (double, out, single) if q[0] == '"' else (single, double, out)
                ends.append(out)
            self._closing = at[::-1], ends[::-1]
        at, ends = self._closing
        name = TAG_NAME.match(s, i)
        k = bisect_left(at, name.end()) if name else len(at)
        return TAG.match(s, i) if k < len(at) and ends[k] else None

    def _text(self, node: int, text: str) -> None:
        if text and not self.out[node]:
            self.items.append((node, html.unescape(text) if "&" in text else text))

    def _grow(self, best: int, body: int, end: list[int], density: list[float], threshold: float) -> tuple[int, list[bool]]:
        """The topmost node from ``best`` to the body with a further block as dense as the threshold, and what is left out below it."""
        n = len(self.tag)
        left, dense = [False] * n, [False] * n  # dense: the node or one below it is such a block
        for k in range(n - 1, 0, -1):
            dense[k] = dense[k] or (not self.out[k] and self.tag[k] in BLOCK and density[k] >= threshold > 0)
            dense[self.parent[k]] = dense[self.parent[k]] or (dense[k] and not self.out[k])
        top, path, k = best, {best}, best
        beside: dict[int, list[int]] = {}
        for c in range(1, n):
            beside.setdefault(self.parent[c], []).append(c)
        while k not in (body, 0):
            k = self.parent[k]
            path.add(k)
            if any(c not in path and dense[c] and not self.out[c] for c in beside[k]):
                top = k
        part = [False] * n  # of these nodes only some children are kept
        part[top] = top != best
        for k in range(top + 1, end[top]):
            if part[self.parent[k]] and k != best:
                if k in path:
                    part[k] = True
                elif self.tag[k] in CONTAINER and density[k] < threshold:
                    left[k], part[k] = not dense[k], dense[k]
        return top, left

    def measure(self) -> tuple[list[int], list[int], list[int], list[int], list[int], list[float], list[float], int]:
        """Per node: characters, those in links, tags, links below it, its range's end, density, sum of its children's densities; and the body."""
        n = len(self.tag)
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.items:
            if text and not self.out[node]:
                size = len(text) - text.count(" ")
                chars[node] += size
                if self.link[node]:
                    link_chars[node] += size
        end = self._ends()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            if not self.out[k]:
                chars[p] += chars[k]
                link_chars[p] += link_chars[k]
                tags[p] += tags[k] + 1
                link_tags[p] += link_tags[k] + (self.tag[k] == "a")
        body = next((k for k in range(1, n) if self.tag[k] == "body"), 0)
        density = [0.0 if self.out[k] else text_density(chars[k], link_chars[k], tags[k], link_tags[k], link_chars[body] / max(1, chars[body])) for k in range(n)]
        sums = [0.0] * n
        for k in range(1, n):
            sums[self.parent[k]] += density[k]
        return chars, link_chars, tags, link_tags, end, density, sums, body

    def main_text(self) -> str:
        """Blocks of the chosen subtree, joined by newlines; white space within a block is one space."""
        n = len(self.tag)
        chars, link_chars, tags, link_tags, end, density, sums, body = self.measure()
        best = max(range(body, n), key=lambda k: (not self.out[k], sums[k], density[k], -k))
        if sums[best] <= 0:
            best = body
        menu = [False] * n
        threshold, path, k = density[best], [best], best
        while k not in (body, 0) and k > 0:
            k = self.parent[k]
            path.append(k)
            threshold = min(threshold, density[k])
        article = next((k for k in path if self.tag[k] in ("article", "main") and density[k] > threshold), None)
        if article is not None:
            best = article
        else:
            if best not in (body, 0) and self.tag[best] in ("p", "li", "td", "blockquote", "h1", "h2", "pre", "ul", "ol", "tr"):
                best = self.parent[best]  # a single block isn't an article: take its siblings in
            best, menu = self._grow(best, body, end, density, threshold)
            for k in range(best + 1, end[best]):
                menu[k] = menu[k] or menu[self.parent[k]] or (self.tag[k] in ("ul", "ol", "div", "section", "table", "dl") and link_tags[k] >= 3 and link_chars[k] > 0.6 * chars[k] and density[k] < threshold)
        blocks, now = [], []
        for node, text in self.items:
            if text is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif best <= node < end[best] and not self.out[node] and not menu[node]:
                now.append(text)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)


def extract(source: str | None) -> str:
    """Main text of one page; empty for null, empty or textless pages."""
    return Page(source).main_text() if source else ""


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text. Pages are read whole; null, empty and textless pages have an empty text; repeated rows each give a row, null ids and urls stay null, and other columns don't matter. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([extract(x) for x in b.column(2).to_pylist()], pa.string())], ["id", "url", "text"])

    python_path(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "id long, url string, text string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's texts of all ``pages``; null, empty, long and repeated pages as in ``page_texts``."""
    found = page_texts(read_table(spark, f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
