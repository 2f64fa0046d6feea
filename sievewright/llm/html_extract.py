"""Main-text extraction by wrapper induction.

Every page is aligned with one reference page of its host by simple tree
matching.  Votes over all pages of the host tell for each node of the reference
whether its text is constant (template) or varies (a slot).  The wrapper's
content root is the deepest node that holds all the varying text; a page's main
text is the page without template nodes, without nodes beside that root that
read as in the reference, and without elements whose kind is not the article's
(menus, headers, footers, forms, code).  Where the page marks its article
(``article``, ``main``), that mark sets the bounds, and template nodes within go
as elsewhere; ``main`` wins over ``article`` where it holds more than twice the
text that is left.

A class or id that reads like a sidebar, notice or advert is a weak sign.  It
does not hold where the element has the page's heading or article in it, or most
of the text that is left; where the host's votes find most of the varying text
below it; or where nothing would be left without it.  Of reader comments, which
may be longer than the article, only the first of these clears an element.

Near copies of the reference have no vote, and pages with the same varying text
have one together; a run that holds most of the reference's text is no template.
Votes are summed by host and node, so a host with very many pages costs no task
more than its share; a reference tree bounds the rows of a host.

Broken and hostile pages: a quote that no quote closes before much markup ends
with its tag; what follows an unclosed comment, script or tag belongs to it;
elements deeper than ``MAX_DEPTH`` lie beside each other, with all their text.
All walks are loops, and the work is linear in the page but for the matching of
trees, which is the best match whatever their size (see ``match_trees``).

Defined results: a null page counts as empty and has the empty text; a null url
is the host ''; a host with one page has no votes, and its marks and kinds alone
decide; repeated rows are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._common import stored

#: A node whose text is the same on this share of the aligned pages, at least ``MIN_PAGES``, is template.
CONSTANT, MIN_PAGES = 0.6, 3
#: A page of whose text less than this share differs from the reference is a near copy; as near are two runs of words.
NEAR = 0.2
#: Reference pages of at most so many bytes in all are broadcast.
MAX_BROADCAST_BYTES = 16 << 20
#: Depth of a page's tree.
MAX_DEPTH = 256
#: Characters of a quoted value behind the first "<" in it.
MAX_QUOTED = 4096

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul option select".split())
CLOSES_P = BLOCK - {"html", "head", "body", "option", "select", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl td th button object select div section article aside nav header footer main form".split())
FORMATTING = frozenset("a abbr b big code em font i mark nobr s small span strike strong sub sup tt u".split())
OUTSIDE = frozenset("head script style noscript template nav header footer aside form button select input textarea svg math iframe object embed canvas audio video menu dialog noembed noframes xmp datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav footer masthead related recommended share sharing social newsletter subscribe subscription signup login popup modal overlay widget pagination pager skip".split())
READERS = frozenset("comment comments disqus reply replies respond".split())

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_STOP = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: Class names that tell of a page's state, not of an element's part.
_STATE = re.compile(r"^(?:has|with|no|without|is)[-_]|[-_](?:open|closed|enabled|disabled)$", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """An element: ``parts`` holds its child elements and texts in order.

    ``out`` tells that it is no part of an article: ``KIND`` by what it is,
    ``COMMENTS`` and ``NAMED`` by what its class or id reads like.
    """

    __slots__ = ("out", "parent", "parts", "tag")

    def __init__(self, tag: str, parent: Node | None, out: int = 0):
        self.tag, self.parent, self.out = tag, parent, out
        self.parts: list[Node | str] = []


KIND, COMMENTS, NAMED = 3, 2, 1


def _outside(tag: str, attributes: str) -> int:
    if tag in OUTSIDE:
        return KIND
    if not attributes or tag in ("html", "body", "article", "main") and "hidden" not in attributes:
        return 0
    out = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            said = {w.lower() for one in value.split() if not _STATE.search(one) for w in _WORD.findall(one)}
            out = max(out, COMMENTS if not READERS.isdisjoint(said) else NAMED if not NAMES.isdisjoint(said) else 0)
        elif name == "role":
            if value.lower() in ROLES:
                return KIND
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return KIND
        elif name == "aria-hidden":
            if value.lower() == "true":
                return KIND
        elif m.start() == 0 or attributes[m.start() - 1].isspace():  # the attribute hidden
            return KIND
    return out


def tag_end(html: str, at: int) -> int:
    """Where the tag that ``at`` lies in ends: behind its ">", or -1 if it has none."""
    while True:
        m = _STOP.search(html, at)
        if m is None or m[1] is None:
            return m.end() if m else -1
        inside = html.find("<", m.end())
        close = html.find(m[1], m.end(), len(html) if inside < 0 else inside + MAX_QUOTED)
        if close < 0:  # the quote is not closed: the tag ends at the next ">"
            return html.find(">", m.end()) + 1 or -1
        at = close + 1


def parse(html: str) -> Node:
    """The page as a tree, with end tags supplied where the page leaves them out."""
    top = here = Node("#page", None)
    at, end, depth = 0, len(html), 0
    opened: Counter[str] = Counter()
    no_cdata = False

    def up(node: Node) -> Node:
        """Leaves ``here`` and all above it up to ``node``; the element that is then open."""
        nonlocal depth
        step = here
        while step is not node.parent:
            opened[step.tag] -= 1
            depth -= 1
            step = step.parent
        return step

    while at < end:
        start = html.find("<", at)
        if start < 0:
            here.parts.append(html[at:])
            break
        if start > at:
            here.parts.append(html[at:start])
        if html.startswith("<!--", start):
            at = html.find("-->", start + 4) + 3
            if at < 3:
                break
            continue
        if html.startswith("<![CDATA[", start) and not no_cdata:
            close = html.find("]]>", start)
            if close >= 0:
                here.parts.append(html[start + 9 : close].replace("&", "&amp;"))
                at = close + 3
                continue
            no_cdata = True
        if html[start + 1 : start + 2] in ("!", "?"):
            at = html.find(">", start) + 1
            if not at:
                break
            continue
        name = _NAME.match(html, start + 1)
        if name is None:
            here.parts.append("<")
            at = start + 1
            continue
        at = tag_end(html, name.end())
        if at < 0:
            break
        tag = name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if opened[tag] > 0:
                node, bound = here, tag in FORMATTING
                while node is not top and node.tag != tag:
                    node = top if bound and node.tag in BLOCK else node.parent
                if node is not top:
                    here = up(node)
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            node = here
            while node is not top and node.tag != "p" and node.tag not in SCOPES:
                node = node.parent
            if node.tag == "p":
                here = up(node)
        if tag in SELF_CLOSING:
            node, kinds = here, SELF_CLOSING[tag]
            while node is not top and node.tag not in kinds and (node.tag not in SCOPES or node.tag in ("div", "section")):
                node = node.parent
            if node.tag in kinds:
                here = up(node)
        child = Node(tag, here, _outside(tag, html[name.end() : at - 1]))
        here.parts.append(child)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            child.parts.append(html[at : close.start() if close else end])
            if not close:
                break
            at = html.find(">", close.end()) + 1 or end
        elif tag not in VOID and depth < MAX_DEPTH:
            here = child
            opened[tag] += 1
            depth += 1
    return top


def blocks(root: Node, dropped: set[int] = frozenset(), without: int = NAMED) -> list[str]:
    """Texts of the blocks below ``root`` in page order, without what is ``dropped`` (by identity) or outside an article.

    ``without`` is the least sign that counts.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[tuple[Node | str | None, bool]] = [(p, False) for p in reversed(root.parts)]
    while todo:  # None ends a block
        part, only_headings = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if not only_headings:
                run.append(part)
        else:
            headings = only_headings
            if part.out >= without or id(part) in dropped:
                if part.tag != "header" or not _inside_article(part):
                    if part.tag in BLOCK:
                        flush()
                    continue
                headings = True
            if headings and part.tag in HEADINGS:
                headings = False
            inner = [(p, headings) for p in reversed(part.parts)]
            if part.tag in BLOCK:
                flush()
                todo.append((None, False))
                todo += inner
            elif part.tag in ("br", "td", "th"):
                run.append(" ")
                todo.append((" ", False))
                todo += inner
            elif part.tag not in RAW:
                todo += inner
    flush()
    return out


def weigh_names(top: Node, rescued: set[int] = frozenset()) -> None:
    """Takes back the sign of a name where more speaks against it (see above); ``rescued`` are elements by identity."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        if node.out != KIND and node.tag not in RAW:
            todo += [p for p in node.parts if not isinstance(p, str)]
    chars: dict[int, int] = {}
    bears: dict[int, bool] = {}
    for node in reversed(order):  # children before their parents
        inside = [p for p in node.parts if not isinstance(p, str)]
        own = sum(len(p.split()) for p in node.parts if isinstance(p, str)) if node.out != KIND and node.tag not in RAW else 0
        chars[id(node)] = own + sum(chars.get(id(p), 0) for p in inside if p.out < COMMENTS)
        bears[id(node)] = node.tag in ("article", "main", "h1") or node.out != KIND and any(bears.get(id(p), False) for p in inside)
    for node in order:  # parents before their children
        if node.out in (NAMED, COMMENTS):
            scope = node.parent
            while scope.parent is not None and scope.tag not in ("article", "main", "body"):
                scope = scope.parent
            if bears[id(node)] or node.out == NAMED and (id(node) in rescued or 2 * chars[id(node)] > chars[id(scope)]):
                node.out = 0


def _inside_article(node: Node) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


class Frame:
    """A page's tree reduced to block elements; runs of like leaves are one frame.  ``text`` is the frame's own text."""

    __slots__ = ("children", "key", "nodes", "number", "out", "text", "weight")

    def __init__(self, key: str, node: Node):
        self.key, self.out, self.children, self.nodes, self.text, self.number, self.weight = key, node.out, [], [node], "", 0, 1


def frame_of(root: Node) -> tuple[Frame, list[Frame]]:
    """The frame of a page and all frames in preorder."""
    top = Frame("#page", root)
    found = [top]
    texts: dict[int, list[str]] = {id(top): []}
    parent: dict[int, Frame] = {}
    todo = [(top, p) for p in reversed(root.parts)]
    while todo:
        frame, part = todo.pop()
        if isinstance(part, str):
            texts[id(frame)].append(part)
        elif part.tag in BLOCK:
            child = Frame(part.tag, part)
            found.append(child)
            texts[id(child)], parent[id(child)] = [], frame
            frame.children.append(child)
            todo += [(child, p) for p in reversed(part.parts)]
        elif part.tag not in RAW:
            todo += [(frame, p) for p in reversed(part.parts)]
    for frame in reversed(found):  # children before their parents
        frame.text = " ".join("".join(texts[id(frame)]).split())
        merged: list[Frame] = []
        for child in frame.children:
            last = merged[-1] if merged else None
            if last is not None and (last.key, last.out) == (child.key, child.out) and not last.children and not child.children:
                last.nodes += child.nodes
                last.text += " " + child.text
            else:
                merged.append(child)
        frame.children = merged
        frame.weight = 1 + sum(c.weight for c in merged)
    order: list[Frame] = []
    rest = [top]
    while rest:
        frame = rest.pop()
        frame.number = len(order)
        order.append(frame)
        rest += reversed(frame.children)
    return top, order


class _Shapes:
    """Subtrees of two trees by shape: kinds of the path to the root, and shapes of the children."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}
        self.known: dict[tuple[int, tuple[int, ...]], int] = {}

    def of(self, top: Frame) -> tuple[dict[int, int], dict[int, dict[int, int]]]:
        """The shape of every frame by identity; the shapes of every path, each with its place among them."""
        order, todo = [], [(top, -1)]
        while todo:
            frame, above = todo.pop()
            path = self.paths.setdefault((above, frame.key), len(self.paths))
            order.append((frame, path))
            todo += [(c, path) for c in frame.children]
        shape: dict[int, int] = {}
        by_path: dict[int, dict[int, int]] = {}
        for frame, path in reversed(order):  # children before their parents
            one = self.known.setdefault((path, tuple([shape[id(c)] for c in frame.children])), len(self.known))
            shape[id(frame)] = one
            places = by_path.setdefault(path, {})
            places.setdefault(one, len(places))
        return shape, by_path


def _below(above: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The next row of the best matches of two lists of children, for matches worth ``w``; rows of many pairs of lists at once."""
    out = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[..., 1:], above[..., :-1] + w), axis=-1, out=out[..., 1:])
    return out


def match_trees(a: Frame, b: Frame, pairs: list[tuple[Frame, Frame]]) -> int:
    """Simple tree matching: the size of the largest order-preserving match, its pairs appended to ``pairs``.

    Equal subtrees are measured once, and each with all of the other tree at a
    time.  The work is at most the product of the numbers of different
    subtrees' children on the same path, for trees of any size.
    """
    if a.key != b.key:
        return 0
    shapes = _Shapes()
    (shape_a, ours), (shape_b, theirs) = shapes.of(a), shapes.of(b)
    path_of, kids_of = zip(*shapes.known, strict=True)
    #: By path: sizes of the best matches of our shapes with theirs, and a last column of zeros.
    worth: dict[int, np.ndarray] = {}

    def places(kids: np.ndarray, path: int) -> np.ndarray:
        """Columns of ``worth[path]`` for shapes ``kids``; the last for those of other paths."""
        own = theirs[path]
        return np.array([own.get(k, len(own)) for k in kids.ravel().tolist()], np.int64).reshape(kids.shape)

    if shape_a[id(a)] != shape_b[id(b)]:
        for path in sorted(ours.keys() & theirs.keys(), reverse=True):  # children before their parents
            worth[path] = table = np.ones((len(ours[path]), len(theirs[path]) + 1), np.int32)
            table[:, -1] = 0
            groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
            for y, at in theirs[path].items():
                if kids_of[y]:
                    groups.setdefault(len(kids_of[y]).bit_length(), []).append((at, kids_of[y]))
            parents = [(at, kids_of[x]) for x, at in ours[path].items() if kids_of[x]]
            for group in groups.values() if parents else ():
                wide = max(len(kids) for _, kids in group)
                kids = np.array([[*k, *[-1] * (wide - len(k))] for _, k in group], np.int64)
                columns = {p: places(kids, p) for p in {path_of[k] for _, own in group for k in own} if p in worth}
                at_y = [at for at, _ in group]
                for at, own in parents:
                    row = np.zeros((len(group), wide + 1), np.int32)
                    for k in own:
                        if (p := path_of[k]) in columns:
                            row = _below(row, worth[p][ours[p][k]][columns[p]])
                    table[at, at_y] += row[:, -1]
    size, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        size += 1
        if shape_a[id(x)] == shape_b[id(y)]:
            todo += zip(x.children, y.children, strict=True)
            continue
        # Equal first children are a best match, and the one that the steps back come to.
        k = 0
        while k < min(len(x.children), len(y.children)) and shape_a[id(x.children[k])] == shape_b[id(y.children[k])]:
            k += 1
        todo += zip(x.children[:k], y.children[:k], strict=True)
        left, right = x.children[k:], y.children[k:]
        if not left or not right:
            continue
        of_left, kids = [shape_a[id(c)] for c in left], np.array([shape_b[id(c)] for c in right], np.int64)
        columns = {p: places(kids, p) for p in {path_of[i] for i in of_left} if p in worth}
        zeros = np.zeros(len(right), np.int32)
        step = lambda row, i: _below(row, worth[p][ours[p][of_left[i]]][columns[p]] if (p := path_of[of_left[i]]) in columns else zeros)
        # Every so many rows are kept, and those between are made again on the way back.
        every = isqrt(len(left)) + 1
        row, kept = np.zeros(len(right) + 1, np.int32), []
        for i in range(len(left)):
            if i % every == 0:
                kept.append(row)
            row = step(row, i)
        i, j = len(left), len(right)
        while i and j:
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            for n in range(first, i):
                rows.append(step(rows[-1], n))
            best = [r.tolist() for r in rows]
            while i > first and j:
                here, up = best[i - first], best[i - first - 1]
                if here[j] > up[j] and here[j] > here[j - 1]:
                    i, j = i - 1, j - 1
                    todo.append((left[i], right[j]))
                elif up[j] >= here[j - 1]:
                    i -= 1
                else:
                    j -= 1
    return size


class Wrapper:
    """A host's reference tree with the votes on its frames."""

    def __init__(self, html: str, votes: list[tuple[int, int, int, int]]):
        page = parse(html)
        self.top, self.order = frame_of(page)
        seen = {number: (n, same, chars) for number, n, same, chars in votes}
        kind = excluded(self.order, COMMENTS)
        mass = [0 if i in kind else seen.get(i, (0, 0, 0))[2] for i in range(len(self.order))]
        #: Frames that a name puts outside though most of the varying text lies below them.
        self.rescued = {f.number for f in self.order if f.out == NAMED and 2 * sum(mass[f.number : f.number + f.weight]) > sum(mass) > 0}
        weigh_names(page, {id(node) for i in self.rescued for node in self.order[i].nodes})
        for f in self.order:
            f.out = f.nodes[0].out
        outside = excluded(self.order, NAMED)
        most = sum(len(f.text) for f in self.order if f.number not in outside) / 2
        self.constant = {number for number, (n, same, _) in seen.items() if n >= MIN_PAGES and same >= CONSTANT * n and 0 < len(self.order[number].text) <= most}
        mass = [0 if i in outside else m for i, m in enumerate(mass)]
        total = sum(mass)
        frame = self.top
        while heavy := [c for c in frame.children if total and sum(mass[c.number : c.number + c.weight]) == total]:
            frame = heavy[0]
        #: Frames of the content root, the lowest common ancestor of all varying frames.
        self.inside = range(frame.number, frame.number + frame.weight)


def excluded(order: list[Frame], least: int) -> set[int]:
    """Numbers of the frames that are outside an article by signs of at least ``least``."""
    out: set[int] = set()
    for f in order:
        if f.out >= least:
            out.update(range(f.number, f.number + f.weight))
    return out


def difference(a: str, b: str) -> float:
    """Characters of ``b`` that differ from ``a``; all of them unless most words are the same."""
    if a == b:
        return 0.0
    x, y = Counter(a.split()), Counter(b.split())
    share = 1 - (x & y).total() / max(x.total(), y.total(), 1)
    return len(b) * share if share < NEAR else len(b)


def different_text(pairs: list[tuple[Frame, Frame]], order: list[Frame]) -> str | None:
    """The longest text of a page that differs from its reference; null for a near copy of it."""
    outside = excluded(order, NAMED)
    ref = {own.number: a.text for a, own in pairs}
    own = [f for f in order if f.number not in outside and f.text]
    changed = [(difference(ref.get(f.number, ""), f.text), f.text) for f in own]
    if sum(n for n, _ in changed) < NEAR * sum(len(f.text) for f in own):
        return None
    return max(changed, default=(0.0, ""))[1]


def marked_roots(top: Node, tag: str) -> list[Node]:
    """The outermost elements ``tag``, without those below what is outside an article."""
    found: list[Node] = []
    todo = [top]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            found.append(node)
        elif node.out < KIND:
            todo += [p for p in reversed(node.parts) if not isinstance(p, str)]
    return found


def main_text(html: str, wrapper: Wrapper | None) -> str:
    """The page's main text by its host's wrapper."""
    top = parse(html)
    dropped: set[int] = set()
    rescued: set[int] = set()
    if wrapper is not None:
        frame, _ = frame_of(top)
        pairs: list[tuple[Frame, Frame]] = []
        match_trees(wrapper.top, frame, pairs)
        for ref, own in pairs:
            if (ref.number in wrapper.constant or ref.number not in wrapper.inside) and ref.text == own.text and not own.children:
                dropped.update(map(id, own.nodes))
            if ref.number in wrapper.rescued:
                rescued.update(map(id, own.nodes))
    weigh_names(top, rescued)
    for without in (NAMED, COMMENTS):  # by all names, unless nothing is left
        roots = {tag: marked_roots(top, tag) for tag in ("article", "main")}
        article, main = ([b for node in roots[tag] for b in blocks(node, dropped, without)] for tag in roots)
        if sum(map(len, main)) > 2 * sum(map(len, article)):
            return "\n\n".join(main)
        found = article or ([] if roots["article"] or roots["main"] else blocks(top, dropped, without))
        if found:
            return "\n\n".join(found)
    return ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each host and differing text: the page's frames aligned with the reference's."""
    frames: dict[str, Frame] = {}
    kind = pa.list_(pa.struct([("node", pa.int32()), ("same", pa.bool_()), ("chars", pa.int64())]))
    for batch in batches:
        votes: dict[tuple[str, bytes], list[tuple[int, bool, int]]] = {}
        for host, html, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if html == ref:
                continue
            if ref not in frames:
                if len(frames) > 64:
                    frames.clear()
                frames[ref] = frame_of(parse(ref))[0]
            pairs: list[tuple[Frame, Frame]] = []
            own, order = frame_of(parse(html))
            match_trees(frames[ref], own, pairs)
            text = different_text(pairs, order)
            if text is not None:
                key = host, hashlib.blake2b(text.encode(errors="replace"), digest_size=16).digest()
                vote = sorted((a.number, a.text == b.text, len(b.text) * (a.text != b.text)) for a, b in pairs)
                votes[key] = min(vote, votes.get(key, vote))
        rows = [[dict(zip(("node", "same", "chars"), v, strict=True)) for v in vote] for vote in votes.values()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.binary()), pa.array(rows, kind)], ["host", "differs", "frames"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[str, Wrapper] = {}
    for batch in batches:
        texts = []
        ids, urls, htmls, hosts, refs, votes = batch.columns
        for html, host, ref, vote in zip(htmls, hosts, refs, votes, strict=True):
            name = host.as_py()
            if name not in wrappers:
                if len(wrappers) > 256:
                    wrappers.clear()
                wrappers[name] = Wrapper(ref.as_py(), [(v["node"], v["n"], v["same"], v["chars"]) for v in vote.as_py()]) if ref.as_py() and vote.as_py() else None
            texts.append(main_text(html.as_py() or "", wrappers[name]))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _small(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` with a broadcast hint if its texts are measured to be small."""
    size = sum((F.coalesce(F.sum(F.octet_length(t)), F.lit(0)) for t in texts), F.count(F.lit(1)) * 64)
    return F.broadcast(df) if df.agg(size.alias("b")).first()["b"] <= MAX_BROADCAST_BYTES else df


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    kind = dict(pages.dtypes)[id_col]
    url, html = F.col(f"`{url_col}`").cast("string"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), html.alias("html"), host.alias("host"))
    # The reference page of a host: the one with the least hash of its text.
    least = rows.where("html <> ''").groupBy("host").agg(F.min(F.xxhash64("html")).alias("h"))
    least = stored(least, "page-hosts")
    chosen = rows.join(_small(least, "host").withColumnRenamed("host", "r"), (F.col("host") == F.col("r")) & (F.xxhash64("html") == F.col("h")))
    refs = stored(chosen.groupBy("host").agg(F.min("html").alias("ref")), "page-refs")
    aligned = rows.join(_small(refs, "ref"), "host").select("host", "html", "ref")
    voters = aligned.mapInArrow(_vote, "host string, differs binary, frames array<struct<node: int, same: boolean, chars: long>>").groupBy("host", "differs").agg(F.min("frames").alias("frames"))
    votes = voters.select("host", F.inline("frames")).groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"), F.sum("chars").alias("chars"))
    votes = votes.groupBy("host").agg(F.collect_list(F.struct("node", "n", "same", "chars")).alias("votes"))  # as many as the reference has frames
    wrappers = stored(refs.join(votes, "host", "left"), "page-wrappers")
    out = rows.join(_small(wrappers, "ref"), "host", "left").select("page_id", "url", "html", "host", "ref", "votes")
    return out.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
