"""Main text of web pages by composite text density.

A page is read once into a tree of elements. Menus, footers, forms and the like go by element,
role and class name. Every other element gets a density: characters per tag, raised where the
characters and tags outweigh those of links. The densities of an element's children are summed;
the element with the largest sum is the article. The smallest density on the path from the body
to that element is the threshold: any other element that reaches it gives its own best subtree.

Defined results: a null, empty or tag-only page has the empty text. Pages of any length and depth
are read whole, with iteration in place of recursion, in time proportional to their length. A
page that ends inside a tag, comment or script ends there; a quote that no later one closes is an
ordinary sign. Repeated rows are extracted each on
its own; null ids and addresses stay null; other columns are not looked at. An empty table gives
an empty result. Cells, list items and headings are blocks, ``br`` is white space in its block.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dugout.llm.common import map_slices, quoted

# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HEAD = frozenset("base link meta noscript script style template title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = _HEADINGS | frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("caption legend optgroup option tbody td tfoot th thead tr".split())
#: start tag -> elements it ends, and the elements beyond which none is ended
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
_SCOPE = frozenset("table td th caption object template".split())
_ANY_BLOCK = "#block"

#: elements that never hold article text
_DROPPED = frozenset(
    "head nav aside footer dialog script style noscript template iframe object svg canvas audio video map "
    "button select textarea datalist fieldset label legend menu search title xmp noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: an element goes if a class or its id consists of these words, and of general ones beside them
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle banner sponsor sponsors "
    "sponsored promo promos promoted promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "toolbar header masthead footer colophon sidebar aside widget widgets related recommended recommendations "
    "trending cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription paywall alert comment comments disqus replies reply respond share sharing social login signin "
    "signup search form forms copyright skip".split())
_GENERAL = frozenset(
    "area article articles bar block body bottom box button buttons container content entry global google group "
    "icons inner item items layer left links list main outer page panel post posts reader right row section site "
    "slot stories thread to top unit user wrap wrapper".split())
_NAMED = frozenset("div section ul ol dl table p center details figure article header main form".split())
_COMMENT = frozenset("comment comments disqus replies reply respond ad ads advert advertisement".split())

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|(/?)([a-zA-Z][^\t\n\f\r />]*+)"
    r"((?:[^>\"'=]++|=[\t\n\f\r ]*+\"[^\"]*+\"|=[\t\n\f\r ]*+'[^']*+'|[\"'=])*+)(>|\Z)"
    r"|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class _Tree:
    """Elements in page order (a parent before its children) and pieces of text with the block they lie in."""

    def __init__(self, page: str):
        self.tags, self.parents, self.attributes = ["body"], [-1], [""]
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        self.block = 0
        self.open = [0]
        self.depths: dict[str, list[int]] = defaultdict(list)  # where on the stack each element is open
        at, find = 0, _TAG.search
        while (m := find(page, at)) is not None:
            self._text(page[at:m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                else:
                    self._start(tag, m[3])
                    if tag in _RAW:
                        close = re.compile(rf"</{tag}(?=[\t\n\f\r />]|\Z)", re.I).search(page, at)
                        at = close.start() if close else len(page)
                        if not close:
                            break
        self._text(page[at:])

    def _text(self, text: str) -> None:
        if text:
            if "&" in text:
                text = entities.unescape(text)
            if self.tags[self.open[-1]] == "head" and not text.isspace():
                self._pop(len(self.open) - 1)
            self.pieces.append((self.open[-1], self.block, text))

    def _pop(self, depth: int) -> None:
        """Close open elements down to ``depth`` of the stack."""
        for node in reversed(self.open[depth:]):
            tag = self.tags[node]
            self.depths[tag].pop()
            if tag in _BLOCK:
                self.block += 1
                self.depths[_ANY_BLOCK].pop()
        del self.open[depth:]

    def _find(self, tags, stop) -> int:
        """Depth of the innermost open element among ``tags`` that lies inside ``stop``; 0 if none."""
        inner = lambda names: max((self.depths[t][-1] for t in names if self.depths.get(t)), default=0)
        depth = inner(tags)
        return depth if depth and depth > inner(stop) else 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if tag == "body" and (depth := self._find({"head"}, ())):
                self._pop(depth)
            return
        if tag not in _HEAD and self.tags[self.open[-1]] == "head":
            self._pop(len(self.open) - 1)
        if tag in _CLOSES_P and (depth := self._find({"p"}, _SCOPE)):
            self._pop(depth)
        if tag in _HEADINGS and self.tags[self.open[-1]] in _HEADINGS:
            self._pop(len(self.open) - 1)
        if tag in _ENDS and (depth := self._find(*_ENDS[tag])):
            self._pop(depth)
        if tag == "a" and (depth := self._find({"a"}, (_ANY_BLOCK,))):
            self._pop(depth)
        self.block += tag in _BLOCK
        if tag == "br":
            self.pieces.append((self.open[-1], self.block, " "))
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.attributes.append(attributes)
        if tag not in _VOID:
            self.depths[tag].append(len(self.open))
            if tag in _BLOCK:
                self.depths[_ANY_BLOCK].append(len(self.open))
            self.open.append(len(self.tags) - 1)

    def _end(self, tag: str) -> None:
        if tag in _HEADINGS:
            depth = self._find(_HEADINGS, _SCOPE)
        elif tag in _SCOPE:
            depth = self._find({tag}, {"table"} - {tag})
        elif tag in _BLOCK or tag == "head":
            depth = self._find({tag}, _SCOPE)
        else:  # an inline element does not end the blocks inside it
            depth = self._find({tag}, (_ANY_BLOCK,))
        if depth:
            self._pop(depth)


def _hinted(name: str, hints=_HINTS) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    return any(w in hints for w in words) and all(w in _HINTS or w in _GENERAL or w.isdigit() for w in words)


def _dropped(tree: _Tree) -> list[bool]:
    """Elements outside the article by what they are or are called, with all below them."""
    n = len(tree.tags)
    holds = [False] * n  # an article, a main element or a first heading lies below
    for i in range(n - 1, 0, -1):
        if holds[i] or tree.tags[i] in ("article", "main", "h1"):
            holds[tree.parents[i]] = True
    out, inside = [False] * n, [False] * n
    for i in range(1, n):
        tag, parent = tree.tags[i], tree.parents[i]
        inside[i] = inside[parent] or tag in ("article", "main")
        if out[parent] or tag in _DROPPED or tag == "header" and not inside[i] or tag == "form" and not holds[i]:
            out[i] = True
        elif tree.attributes[i] and not tree.attributes[i].isspace():
            given = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(tree.attributes[i])}
            names = [*entities.unescape(given.get("class", "")).split(), entities.unescape(given.get("id", ""))]
            style = given.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style
            if hidden or given.get("role", "").lower() in _ROLES and not holds[i]:
                out[i] = True
            elif tag in _NAMED:
                spared = tag in ("article", "main") or holds[i]
                out[i] = any(_hinted(x, _COMMENT if spared else _HINTS) for x in names)
    return out


def _densities(tree: _Tree, out: list[bool]) -> tuple[list[float], list[float]]:
    """Link-adjusted characters per tag of every element, and the sum over its children.

    Text that an element holds itself counts as one more child.
    """
    n = len(tree.tags)
    own, chars, link_chars, tags, link_tags = ([0] * n for _ in range(5))
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parents[i]] or tree.tags[i] == "a"
    for node, _, text in tree.pieces:
        if not out[node]:
            own[node] += len(" ".join(text.split()))
    for i in range(n - 1, -1, -1):
        chars[i] += own[i]
        if linked[i]:
            link_chars[i] += own[i]
        if i and not out[i]:
            p = tree.parents[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.tags[i] == "a")
    share = link_chars[0] / max(1, chars[0])

    def density(c, lc, t, lt):
        if not c:
            return 0.0
        t = max(1, t)
        base = math.log(c / max(1, c - lc) * max(1, lc) + share * c + math.e)
        return c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base))

    found = [density(chars[i], link_chars[i], tags[i], link_tags[i]) for i in range(n)]
    sums = [density(own[i], own[i] if linked[i] else 0, 1, 1) for i in range(n)]
    for i in range(1, n):
        if not out[i]:
            sums[tree.parents[i]] += found[i]
    return found, sums


def _article(tree: _Tree, out: list[bool]) -> list[bool]:
    """Which elements belong to the article."""
    n = len(tree.tags)
    density, sums = _densities(tree, out)
    best = list(range(n))  # of each subtree: the element with the largest sum, the outermost among equals
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        if not out[i] and (sums[best[i]], -best[i]) > (sums[best[p]], -best[p]):
            best[p] = best[i]
    chosen, top = [False] * n, best[0]
    path, node = [], top
    while node >= 0:
        path.append(node)
        node = tree.parents[node]
    threshold = min(density[i] for i in path)
    around = next((i for i in path if tree.tags[i] == "article"), None)
    if around is None:
        around = next((i for i in path if tree.tags[i] == "main"), top)
    chosen[around] = True
    above, before, headings = set(path), {}, _headings_only(tree, out)
    for i in range(1, n):  # a heading right before the article or before an element around it
        p = tree.parents[i]
        if not out[i]:
            if i in above and i <= around and headings[before.get(p, 0)]:
                chosen[before[p]] = True
            before[p] = i
    for i in range(n):
        if out[i]:
            continue
        if i and chosen[tree.parents[i]]:
            chosen[i] = True
        elif not chosen[i] and i not in above and density[i] >= threshold > 0:
            chosen[best[i]] = True
    return chosen


def _headings_only(tree: _Tree, out: list[bool]) -> list[bool]:
    """Elements that hold text, all of it in headings."""
    n = len(tree.tags)
    inside, other, held = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parents[i]] or tree.tags[i] in _HEADINGS
    for node, _, text in tree.pieces:
        if not out[node] and not text.isspace():
            held[node], other[node] = True, other[node] or not inside[node]
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        held[p], other[p] = held[p] or held[i], other[p] or other[i]
    return [a and not b for a, b in zip(held, other)]


def main_text(page: str | None) -> str:
    """The article of one page: blocks in page order, white space made single, joined by an empty line."""
    if not page:
        return ""
    tree = _Tree(page)
    out = _dropped(tree)
    chosen = _article(tree, out)
    blocks: dict[int, list[str]] = {}
    for node, block, text in tree.pieces:
        if chosen[node] and not out[node]:
            blocks.setdefault(block, []).append(text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def extract_main_text(
    df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: the id, the address, ``text`` and its length ``n_chars`` in code points.

    Pages are read where they lie; nothing is shuffled and a task holds a few MB of pages.
    """

    def factory():
        def work(batch: pa.RecordBatch) -> dict:
            texts = pa.array([main_text(page) for page in batch.column("text").to_pylist()], pa.string())
            return {
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                "n_chars": pc.cast(pc.utf8_length(texts), pa.int64()),
            }

        return work

    source = df.select(
        quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"),
        quoted(html_col).cast("string").alias("text"))
    return map_slices(source, factory, "page_id long, url string, text string, n_chars long")
