"""Main text of web pages by composite text density.

A page becomes a tree; elements that never hold the article (scripts, menus, forms and the like), and those whose class
or id names nothing but an advert, a comment or a part of the page's frame, are cut off. Of every remaining node the
composite density is computed, its characters for each tag, lowered by the share of link characters and link tags
against the rest of the page. The node whose children's densities have the largest sum is the article's subtree; the
smallest density on its path to body is the threshold for further subtrees beside it. An article or main element around
it is taken whole if its density is of the same order; otherwise the article is all that stands beside it, less what is
mostly links, up to the common ancestor with the subtrees over the threshold.

Names that may as well be a section's subject (`privacy`, `discussion`, `related`) decide nothing within the chosen
subtree unless the density there is low too.

Each page is read on its own, in one pass over its characters, with work in proportion to its length however deep or
broken its markup is; no state is shared between rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Densities within this factor are of the same order.
FRAME = 4
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Elements of HTML by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPES = frozenset("ul ol dl table select menu".split())
_CUT = frozenset("script style textarea title noscript iframe nav footer aside form button select option svg math template object canvas audio video head menu dialog search fieldset legend input noembed noframes".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class and id of what is not the article, and those that say so only of sparse text.
_CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "footer footnav gdpr login masthead menu modal nav navbar navigation newsletter outbrain pager pagination popup promo promoted promotion promotions "
    "sidebar signup skip skyscraper sponsor sponsored subscribe subscription taboola toolbar topbar".split())
_DOUBTFUL = frozenset(
    "disclaimer discussion donate legal notice notices notification overlay privacy recommend recommended related replies reply respond responses rss search "
    "share sharing social teaser thread threads widget widgets".split())
_OF_ARTICLE = frozenset("header banner byline".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
_ARTICLE_WORDS = frozenset("article entry post story content".split())
# Words that leave the meaning of a name as it is; a name with any other word (share-price) is a subject of its own.
_NEUTRAL = _ARTICLE_WORDS | frozenset(
    "all also and area articles bar block body bottom box btn button buttons c card cards col column component container count cta desktop div element entries "
    "fixed floating for global google gpt grid group head heading hidden icon icons id image img in inline inner is item items js label large latest layer left "
    "link links list lists logo m main mini mobile module more most new o of on outer page pages panel policy popular posts primary reader readers region right "
    "root row secondary section set site slot small sticky stories tab tabs text the this title toggle top trending u unit us user users view with wp wrap "
    "wrapper x zone".split())


_KNOWN = _CUT_WORDS | _DOUBTFUL | _OF_ARTICLE | _NEUTRAL


class _Open:
    """Open elements. What an end tag or an implied end looks for is counted apart, so that it is found, or known to be
    absent, without a walk; an element is popped once."""

    def __init__(self):
        self.stack, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}  # of open blocks by name
        self.blocks: list[tuple[int, dict[str, list[int]]]] = [(0, {})]  # each with the inline elements open in it
        self.scopes: list[tuple[int, dict[str, list[int]]]] = [(0, {})]  # each with the items open in it

    def push(self, node: int, tag: str) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.tags.append(tag)
        if tag in _INLINE:
            self.blocks[-1][1].setdefault(tag, []).append(at)
            return
        self.places.setdefault(tag, []).append(at)
        self.blocks.append((at, {}))
        if tag in _SIBLINGS:
            self.scopes[-1][1].setdefault(tag, []).append(at)
        elif tag in _SCOPES:
            self.scopes.append((at, {}))

    def _cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.stack.pop()
            tag = self.tags.pop()
            if tag in _INLINE:
                self.blocks[-1][1][tag].pop()
                continue
            self.places[tag].pop()
            self.blocks.pop()
            if tag in _SIBLINGS:
                self.scopes[-1][1][tag].pop()
            elif tag in _SCOPES:
                self.scopes.pop()

    def close(self, name: str) -> None:
        """An end tag; that of an inline element ends nothing beyond its block."""
        if found := self.blocks[-1][1].get(name) if name in _INLINE else self.places.get(name):
            self._cut(found[-1])

    def imply(self, name: str) -> None:
        """Ends that HTML leaves out: of a paragraph before a block, of an item before its next one."""
        if name in _ENDS_P:
            if self.tags[self.blocks[-1][0]] == "p":
                self._cut(self.blocks[-1][0])
        elif name in _SIBLINGS:
            items = self.scopes[-1][1]
            if found := [items[x][0] for x in _SIBLINGS[name] if items.get(x)]:
                self._cut(min(found))


class _Page:
    """Nodes in document order by parallel lists; pieces are texts with their node, or None where a block ends."""

    def __init__(self, html: str):
        self.tag, self.parent, self.words, self.role, self.hidden = ["#root"], [0], [frozenset()], [""], [False]
        self.pieces: list[tuple[int, str] | None] = []
        self._read(html)

    def _read(self, html: str) -> None:
        open_, pos, n, last = _Open(), 0, len(html), html.rfind(">")
        pieces = self.pieces
        while pos < n:
            at = html.find("<", pos)
            if at < 0 or at > last and not html.startswith("<!--", at):
                at = n  # no tag ends behind this point
            if at > pos:
                pieces.append((open_.stack[-1], html[pos:at]))
            if at == n:
                break
            m = _TAG.match(html, at)
            if m is None:
                m = _SKIP.match(html, at)
                if m:
                    pos = m.end()
                else:
                    pieces.append((open_.stack[-1], "<"))
                    pos = at + 1
                continue
            pos = m.end()
            close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = name.lower()
            if name not in _INLINE:
                pieces.append(None)
            if close:
                open_.close(name)
                continue
            open_.imply(name)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(open_.stack[-1])
            self._attributes(attrs)
            if name in _RAW:
                end = re.compile(rf"</{name}", re.I).search(html, pos)
                stop = end.start() if end else n
                if name == "textarea":
                    pieces.append((node, html[pos:stop]))
                gt = html.find(">", stop)
                pos = n if gt < 0 or not end else gt + 1
            elif name not in _VOID and not (attrs.endswith("/") and name in ("svg", "path")):
                open_.push(node, name)

    def _attributes(self, attrs: str) -> None:
        words, role, hidden = frozenset(), "", False
        if "=" in attrs or "hidden" in attrs:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
            named = " ".join(found[k] for k in ("class", "id") if found.get(k))
            if named:
                names = (frozenset(_PARTS.findall(_CAMEL.sub(" ", x).lower())) for x in named.split())
                words = frozenset().union(*(x for x in names if x <= _KNOWN))
            role = (found.get("role") or "").lower()
            style = (found.get("style") or "").replace(" ", "").lower()
            hidden = "hidden" in found or "display:none" in style or (found.get("aria-hidden") or "").lower() == "true"
        self.words.append(words)
        self.role.append(role)
        self.hidden.append(hidden)

    def cut(self) -> tuple[list[bool], list[bool]]:
        """Nodes that are not part of the article by what they are, with all below them; and nodes of doubtful name."""
        n = len(self.tag)
        holds = [t in ("h1", "main", "body") for t in self.tag]
        chars = [0] * n
        for piece in self.pieces:
            if piece is not None and self.tag[piece[0]] not in _CUT:
                chars[piece[0]] += len(piece[1])
        frames = [t in ("article", "main", "body") for t in self.tag]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
            chars[self.parent[i]] += chars[i] if self.tag[i] not in _CUT else 0
            frames[self.parent[i]] |= frames[i]
        inside = [False] * n  # an article or main
        out, doubt = [False] * n, [False] * n
        for i in range(1, n):
            p, tag, words = self.parent[i], self.tag[i], self.words[i]
            inside[i] = inside[p] or tag in ("article", "main")
            if out[p]:
                out[i] = True
            elif tag in ("html", "body", "main"):
                continue
            elif tag == "form" or tag == "fieldset":
                out[i] = not holds[i]
            elif tag in _CUT or self.hidden[i]:
                out[i] = True
            elif tag == "header":
                out[i] = not inside[p] and not frames[i]
            elif self.role[i] in _CUT_ROLES:
                out[i] = not holds[i] or self.role[i] == "banner" and not frames[i]
            elif words and (bad := words & (_CUT_WORDS | _OF_ARTICLE)):
                if bad <= _OF_ARTICLE and (inside[p] or words & _ARTICLE_WORDS):
                    continue
                # A frame named for what it also holds: most of the page's text is not a sidebar.
                frame = not bad & _COMMENT_WORDS and 5 * chars[i] >= 4 * chars[0] and not words & {"header", "footer"}
                out[i] = not (holds[i] or frame) or "header" in bad and not inside[i] and not frames[i]
            elif words & _DOUBTFUL:
                doubt[i] = not holds[i] and 2 * chars[i] < chars[0]
        return out, doubt


def _densities(page: _Page, out: list[bool], size: list[int]) -> tuple[list[float], list[int], list[int]]:
    """Composite density of every node, its characters, and those of links."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags, link = size[:], [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        link[i] = link[page.parent[i]] or page.tag[i] == "a"
        if link[i]:
            link_chars[i] = chars[i]
    for i in range(n - 1, 0, -1):
        if not out[i]:
            p = page.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density = [0.0] * n
    for i in range(n):
        if out[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], link_tags[i]
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        density[i] = c / t * math.log(max(c / max(lc, 1) * (t / max(lt, 1)), 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0)
    return density, chars, link_chars


def _article(page: _Page, out: list[bool], doubt: list[bool], size: list[int]) -> list[bool]:
    """Nodes of the article. What has a doubtful name has no part in the choice of the subtree; within it, it stays if
    its density is of the order of the subtree's."""
    n = len(page.tag)
    if not any(doubt):
        return _select(page, out, size)
    less = out[:]
    for i in range(1, n):
        less[i] = out[i] or doubt[i] or less[page.parent[i]]
    chosen = _select(page, less, size)
    alone, _, _ = _densities(page, less, size)
    least = min((alone[i] for i in range(n) if chosen[i] and not chosen[page.parent[i]]), default=0.0) / FRAME
    density, chars, link_chars = _densities(page, out, size)
    for i in range(1, n):
        if not chosen[i] and less[i] and not out[i] and chosen[page.parent[i]]:
            chosen[i] = not doubt[i] or density[i] >= least and 2 * link_chars[i] < chars[i]
    return chosen


def _select(page: _Page, out: list[bool], size: list[int]) -> list[bool]:
    """Nodes of the article."""
    n = len(page.tag)
    density, chars, link_chars = _densities(page, out, size)
    total = [0.0] * n
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    # Text of a node itself counts as a child without tags.
    for i in range(n):
        if size[i] and not out[i]:
            total[i] += density[i] if chars[i] == size[i] else size[i] * math.log(size[i] + 1) / math.log(math.e + 1) * 0.5
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    below = [i == body for i in range(n)]
    for i in range(body + 1, n):
        below[i] = below[page.parent[i]] and not out[i]
    inner = [i for i in range(n) if below[i] and chars[i]]
    chosen = [False] * n
    if not inner:
        return chosen
    best = max(inner, key=lambda i: (total[i], -i))
    threshold, i = density[best], best
    while i != body:
        i = page.parent[i]
        threshold = min(threshold, density[i])
    path = {best}
    i = best
    while i != body:
        i = page.parent[i]
        path.add(i)
    # The best subtree below each node, for the nodes beside the path.
    top = [i if below[i] else -1 for i in range(n)]
    for i in range(n - 1, body, -1):
        p = page.parent[i]
        if below[i] and (total[top[i]], -top[i]) > (total[top[p]], -top[p]):
            top[p] = top[i]
    h1 = [t == "h1" for t in page.tag]
    for i in range(n - 1, 0, -1):
        h1[page.parent[i]] |= h1[i] and not out[i]

    # The element that stands for the whole article around the best one, as far as it is about as dense.
    main, j = best, best
    while j != body:
        if page.tag[j] in ("article", "main") and FRAME * density[j] >= density[best]:
            main = j
        elif main == best and h1[j] and not h1[best] and 2 * chars[best] >= chars[j]:
            main = j
        j = page.parent[j]
    if page.tag[main] not in ("article", "main"):
        return _around(page, below, chars, link_chars, size, body, main, [i for i in inner if density[i] >= threshold and i not in path])
    chosen[main] = True
    for i in inner:
        p = page.parent[i]
        if i == body or chosen[i] or chosen[p] or i in path:
            chosen[i] = chosen[i] or chosen[p] and i != body
        elif density[i] >= threshold and page.tag[p] == page.tag[page.parent[best]] and page.tag[i] == page.tag[best]:
            chosen[top[i]] = True
    for i in range(body + 1, n):
        chosen[i] = below[i] and (chosen[i] or chosen[page.parent[i]])
    return chosen


def _around(page: _Page, below: list[bool], chars: list[int], link_chars: list[int], size: list[int], body: int, main: int, dense: list[int]) -> list[bool]:
    """The main node and what stands beside it, up to the common ancestor with all dense nodes, but for lists of links."""
    path = [main]
    while path[-1] != body:
        path.append(page.parent[path[-1]])
    level = {j: k for k, j in enumerate(path)}
    top = min(1, len(path) - 1)
    meets = [0] * len(page.tag)  # where a node's way up meets the path
    for i in range(body, len(page.tag)):
        meets[i] = level[i] if i in level else meets[page.parent[i]]
    for i in dense:
        if 2 * link_chars[i] < chars[i]:
            top = max(top, meets[i])
    chosen = [False] * len(page.tag)
    chosen[main] = True
    for i in range(body + 1, len(page.tag)):
        p = page.parent[i]
        if chosen[p]:
            chosen[i] = below[i]
        elif below[i] and chars[i] and i not in level and 0 < level.get(p, -1) <= top:
            # A link within a text that stands in the ancestor itself is part of that text.
            chosen[i] = 2 * link_chars[i] < chars[i] or page.tag[i] == "h1" or page.tag[i] in _INLINE and size[p] > 0
    for j in path[1 : top + 1]:
        chosen[j] = True  # its own text; its children are settled
    return chosen


def extract(html: str | None) -> str:
    """The main text of a page; empty where it has none. Null counts as empty; broken markup is read as far as it goes."""
    if not html:
        return ""
    page = _Page(html)
    out, doubt = page.cut()
    size, blocks, block = [0] * len(page.tag), [], []
    for piece in page.pieces:
        if piece is None:
            if block:
                blocks.append(block)
                block = []
        elif not out[piece[0]]:
            text = unescape(piece[1])
            block.append((piece[0], text))
            size[piece[0]] += len(text) - text.count(" ") if text.strip() else 0
    blocks.append(block)
    chosen = _article(page, out, doubt, size)
    body_text = ("".join([t for node, t in b if chosen[node]]) for b in blocks)
    return " ".join(s for s in (" ".join(t.split()) for t in body_text) if s)


def extract_pages(pages: DataFrame, *, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Adds text and n_chars (its code points) to every row, in place of html.

    Null and empty html, and pages without an article, give an empty text. Rows that repeat give the same text;
    columns of pages named like one that is added are replaced, all others pass through.
    """
    keep = [f for f in pages.schema.fields if f.name not in (html, text, n_chars)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h.as_py()) for h in batch.column(len(names))]
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*names, text, n_chars])

    schema = T.StructType([*keep, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])
    return pages.select(*[F.col(f"`{n}`") for n in names], html).mapInArrow(run, schema)
