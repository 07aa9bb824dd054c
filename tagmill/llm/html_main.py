"""Main text of web pages by tag-path ratios.

A page becomes text blocks with their root-to-leaf paths of block tags. For every path
the mean text length and the mean punctuation of its blocks are taken, smoothed along the
page, fused to one score, and weighted by what tags, roles and names on the path say of
it: more for an article, less for a menu, a footer, an advert, reader comments. Paths that
reach the threshold, the spread of the scores, select the content nodes. The articles
that hold the most of the page's text, or else the deepest element that holds nearly all
of what the paths chose, are the content; in it what the ratios can't tell stays too, such
as titles, short items and cells of tables. What goes are paths that are weighed down,
paths of links below the threshold, and bare containers far below it.

Names never decide alone: a class or id is read as its words, "with" and "no" before a
word take its meaning, an element with most of the page's text, or around its article, is
a frame whatever its name or role, and a form with most of the text is one too; a notice
within an article that reads as prose stays. One pass per page, no shuffle; memory follows
one Arrow batch and work the page's length.

Edge cases: a null or empty page, or one without text, gives the empty text, as does one of
boilerplate alone; empty tables give no rows; markup that is cut off or never closed is
closed at the next block or the end; pages may be nested to any depth and of any length;
repeated rows and null ids give one row each; extra columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagmill.llm.common import narrow

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
#: Elements by what they do to blocks; fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea iframe svg xmp noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form menu head button select dialog search fieldset".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div section article main body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Words of a class or id that mean boilerplate, those of readers' comments, and those that may mean it.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
NAMES = COMMENTS | frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter pager pagination popup promo promoted promotion sidebar sidenav signup skip sponsor sponsored sponsors subscribe subscription toolbar".split())
DOUBTFUL = frozenset("disclaimer header notice recommended recommendations related share sharing shares social teaser widget widgets".split())
NOTICES = frozenset(("disclaimer", "notice"))
#: Words before another that say that it is no part of the element, or that it only stands beside.
BUT = frozenset("no not with without has hide hidden show is on".split())
CONTENT = frozenset(("article", "main"))
#: Elements that are frames if they hold most of the page's text.
FRAMES = frozenset(("form", "fieldset", "search", "dialog", "aside"))
#: Weights of paths: content elements, boilerplate by tag or role, by name, doubtful names.
ARTICLE, BARRED, NAMED, MAYBE = 20.0, 0.01, 0.02, 0.2
#: Paths of less weight can't be content; within the content, less than this share of its weight is none.
LEAST, DEMOTED = 0.05, 0.1
#: Bare containers in the content whose ratios are below this share of the threshold go.
FAR_BELOW = 0.01
BARE = frozenset(("div", "section", "center", "figure", "details"))
#: Shares of the page's text: of a frame; of the largest article that another one must have; of what the paths chose that a box must hold.
MOST, ALSO, NEARLY = 0.5, 0.25, 0.8
#: Code points of a notice that reads as prose.
PROSE = 120


def words_of(names: str) -> set[str]:
    """The words of classes and ids that say something of the element itself."""
    out: set[str] = set()
    for name in names.split():
        last = ""
        for w in WORD.findall(name):
            w = w.lower()
            if last not in BUT:
                out.add(w)
            last = w
    return out


class Node:
    __slots__ = ("barred", "content", "mass", "names", "open", "parent", "path", "size", "tag", "weight")

    def __init__(self, tag: str, parent: Node | None, attributes: str) -> None:
        self.tag, self.parent, self.mass, self.weight, self.path = tag, parent, 0.0, 1.0, 0
        self.size = 0  # code points outside links of its blocks and those below
        self.open = False  # a frame around the content
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        role = found.get("role", "").lower()
        self.names = words_of(f"{found.get('class', '')} {found.get('id', '')}") if found else frozenset()
        self.content = tag in CONTENT or role == "main" or found.get("itemprop") == "articleBody"
        self.barred = tag in BOILERPLATE or role in ROLES


def blocks_of(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements, parents first, and (element, text, code points inside links) of the blocks in page order."""
    top = Node("", None, "")
    nodes, open_ = [top], [top]
    held: dict[str, int] = {}  # open elements by tag
    out: list[tuple[Node, str, int]] = []
    texts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = _SPACE.sub(" ", "".join(texts)).strip(" ")
            if text:
                out.append((open_[-1], text, linked))
        texts.clear()
        linked = 0

    def close(k: int) -> None:
        for x in open_[k:]:
            held[x.tag] -= 1
        del open_[k:]

    def close_last(tags: tuple[str, ...], stops: frozenset[str]) -> None:
        if any(held.get(t) for t in tags):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in tags:
                    close(k)
                    break
                if open_[k].tag in stops:
                    break

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m[2] is None:
            if page[m.start()] != "<" or m[0] == "<":
                text = html.unescape(m[0])
                texts.append(text)
                linked += len(text.strip()) if links else 0
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            texts.append(" ")
        elif tag in RAW and not closing:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag in BLOCK:
            flush()
            if closing:
                inner = frozenset(("article", "main", "body", "table")) if tag in ("p", "li", "td", "tr") else frozenset()
                close_last((tag,), inner)
            else:
                if open_[-1].tag == "p":
                    close(len(open_) - 1)
                if tag in CLOSED_BY:
                    close_last(CLOSED_BY[tag], SCOPES)
                links = 0
                if tag not in VOID:
                    open_.append(Node(tag, open_[-1], m[3]))
                    nodes.append(open_[-1])
                    held[tag] = held.get(tag, 0) + 1
    flush()
    return nodes, out


def measure(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Sizes from the blocks up, and the frames: what holds most of the page's text outside links."""
    for node, text, linked in blocks:
        node.size += max(0, len(text) - linked)
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.size += x.size
    for x in nodes:
        x.open = x.size > MOST * nodes[0].size and (x.tag in FRAMES or not x.barred)


def roots_of(nodes: list[Node]) -> list[Node]:
    """The outermost articles and mains that aren't comments or within boilerplate; of several those that are large."""
    inside: set[int] = set()
    lost: set[int] = set()
    out: list[Node] = []
    for x in nodes:
        up = x.parent
        if up is not None and id(up) in inside:
            inside.add(id(x))
        elif up is not None and id(up) in lost or not x.open and (x.barred or x.names & COMMENTS):
            lost.add(id(x))
        elif x.content and x.size:
            inside.add(id(x))
            out.append(x)
    largest = max((x.size for x in out), default=0)
    return [x for x in out if x.size >= ALSO * largest]


def weigh(nodes: list[Node], roots: list[Node], prose: set[int]) -> None:
    """Weights and path numbers from the root down: a path is its tags and what each does to the weight."""
    around: set[int] = set()
    for r in roots:
        x = r.parent
        while x is not None and id(x) not in around:
            around.add(id(x))
            x = x.parent
    own_roots = {id(r) for r in roots}
    holding: set[int] = set()  # elements that are or hold articles
    for x in nodes:
        if x.content:
            while x is not None and id(x) not in holding:
                holding.add(id(x))
                x = x.parent
    within: set[int] = set()
    known: dict[tuple[int, str, float], int] = {}
    for x in nodes:
        if x.parent is None:
            continue
        inside = id(x.parent) in within
        if id(x) in own_roots:
            within.add(id(x))
            own = ARTICLE
        else:
            if inside:
                within.add(id(x))
            own = _factor(x, inside, id(x) in around, id(x) in prose, id(x) in holding)
        x.weight = x.parent.weight * own
        x.path = known.setdefault((x.parent.path, x.tag, own), len(known) + 1)


def _factor(x: Node, inside: bool, around: bool, prose: bool, holds: bool) -> float:
    """What an element that is no article of the page does to the weight of paths through it."""
    if around or x.open and x.tag not in ("nav", "footer"):
        return 1.0
    if x.barred or x.tag == "header" and not inside:
        return BARRED
    if x.names & NAMES:
        return NAMED
    if x.names & DOUBTFUL and not (inside and prose and not holds):
        return NAMED if x.names & NOTICES or inside and holds else MAYBE
    return 1.0


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    kernel = np.exp(-(np.arange(-3, 4) ** 2) / (2 * sigma**2))
    middle = slice(3, 3 + len(values))
    return np.convolve(values, kernel)[middle] / np.convolve(np.ones(len(values)), kernel)[middle]


def _title(nodes: list[Node], blocks: list[tuple[Node, str, int]], roots: list[Node]) -> list[int]:
    """The blocks of the last header with a first heading before an article that has none of its own, but not of a page's own header."""
    first = {id(x): k for k, x in enumerate(nodes)}

    def under(x: Node | None, test) -> Node | None:
        while x is not None and not test(x):
            x = x.parent
        return x

    ids = {id(r) for r in roots}
    if not roots or any(under(n, lambda x: x.tag == "h1") and under(n, lambda x: id(x) in ids) for n, _, _ in blocks):
        return []
    start = min(first[id(r)] for r in roots)
    heads = [(k, n) for k, (n, _, _) in enumerate(blocks) if first[id(n)] < start and under(n, lambda x: x.tag == "h1") and not under(n, lambda x: x.tag != "header" and (x.barred or x.names & NAMES and not x.open))]
    heads = [(k, n) for k, n in heads if not (h := under(n, lambda x: x.tag == "header")) or h.names & {"article", "entry", "page", "post", "story", "title", "content"}]
    return [heads[-1][0]] if heads else []


def main_text(page: str) -> str:
    nodes, blocks = blocks_of(page)
    measure(nodes, blocks)
    roots = roots_of(nodes)
    own: dict[int, list[str]] = {}
    marked = [x for x in nodes if x.names & DOUBTFUL]
    if marked:
        held = {id(x): x for x in marked}
        for node, text, linked in blocks:
            x: Node | None = node
            while x is not None:
                if id(x) in held and linked < 0.5 * len(text):
                    own.setdefault(id(x), []).append(text)
                x = x.parent
    prose = {k for k, texts in own.items() if sum(map(len, texts)) >= PROSE and len(_PUNCTUATION.findall(" ".join(texts))) >= 2}
    weigh(nodes, roots, prose)
    titles = set(_title(nodes, blocks, roots))
    found = [(n, t, k, i in titles) for i, (n, t, k) in enumerate(blocks) if n.weight >= LEAST or i in titles]
    if not any(n.weight >= LEAST for n, _, _, _ in found):
        return ""
    paths, place = np.unique([n.path for n, _, _, _ in found], return_inverse=True)
    total = lambda values: np.bincount(place, values, len(paths))
    sizes = np.array([len(t) for _, t, _, _ in found], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t, _, _ in found], float)
    count, length = np.bincount(place), total(sizes)
    points, linked = total(marks), np.minimum(1.0, total(np.array([k for _, _, k, _ in found], float)) / length)
    weight = np.array([n.weight for n, _, _, _ in found])
    ratio = (length / count) * (points / count + 0.1)  # of each path, as it is
    fused = smooth((length / count)[place]) * (smooth((points / count)[place]) + 0.1)
    score = total(fused * weight) / count * (1 - linked)
    threshold = float((fused * weight).std())
    chosen = score >= threshold
    if not chosen.any():
        chosen = score >= score.max()
    for (node, _, _, _), p, gain in zip(found, place.tolist(), (fused * weight * (1 - linked[place])).tolist(), strict=True):
        if chosen[p]:
            node.mass += gain
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.mass += x.mass
    boxes = roots
    if not boxes:  # the deepest element that holds nearly all of the chosen mass
        whole, box = nodes[0].mass, nodes[0]
        for x in nodes:  # parents first, and only one child can hold more than half
            if x.parent is box and x.mass >= NEARLY * whole and x.tag not in ("p", "h1", "h2", "h3", "li", "td", "th", "tr", "tbody", "thead", "pre", "blockquote"):
                box = x
        boxes = [box]
    ground = {id(x): x.weight for x in boxes}
    for x in nodes:
        if x.parent is not None and id(x.parent) in ground:
            ground.setdefault(id(x), ground[id(x.parent)])
    edges = {id(x) for x in boxes}
    keep = []
    for (node, text, _, title), p in zip(found, place.tolist(), strict=True):
        base = ground.get(id(node))
        if title:
            keep.append(text)
        elif base is not None and node.weight >= DEMOTED * base:
            links_only = linked[p] > 0.5 and not chosen[p]
            bare = id(node) not in edges and node.tag in BARE and not chosen[p] and ratio[p] * base < FAR_BELOW * threshold
            if not links_only and not bare:
                keep.append(text)
        elif base is None and not roots and chosen[p] and node.weight >= 1:
            keep.append(text)  # a chosen path beside the box
    return "\n".join(keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py() or "") for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def op5_html_main(pages: DataFrame) -> DataFrame:
    source = narrow(pages, "page_id", "url", "html")
    return source.mapInArrow(_extract, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


ORACLE = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body from pages),
b as (select page_id, url, regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>') as parts from a),
c as (select page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))), lambda x: x <> '') as parts from b)
select page_id, url, coalesce(array_to_string(parts, chr(10)), '') as text, cast(length(coalesce(array_to_string(parts, chr(10)), '')) as bigint) as n_chars from c
"""
