"""A light DOM: elements, text, and simple tree matching."""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul""".split())
#: What an opening tag closes when it is open in the same scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("table ul ol dl select body html article section div main aside nav td th form".split())
ENDS_P = BLOCKS - {"body", "html"}

#: Siblings of one label that come in more runs than this are pooled as one.
MANY_RUNS = 8

#: Elements nested deeper are siblings; their text stays.
DEEPEST = 150

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)      # the last: with a quote that is not closed
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "id", "own", "mass", "led")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children, self.id = tag, dict(attrs), [], None

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]


def parse(source: str) -> Node:
    """The tree of a page; text children are strings with their references decoded."""
    root = Node("#root")
    stack, at, end = [root], 0, len(source)
    deep = _Deep()

    def text(a, b):
        if b > a:
            stack[-1].children.append(html.unescape(source[a:b]))
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        close, name = m.group(1), m.group(2) or m.group(4)
        if close:
            close = close.lower()
            if deep.names and deep.closed(close):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == close:
                    del stack[i:]
                    deep.clear()
                    break
                if close == "p" and stack[i].tag in SCOPES:
                    break
        elif name:
            tag = name.lower()
            for ended in (("p",) if tag in ENDS_P else (), CLOSES.get(tag, ())):
                if ended and not (deep.names and deep.ended(ended)) and _close(stack, ended):
                    deep.clear()
            attrs = m.group(3) or m.group(5)
            node = Node(tag, [(k.lower(), html.unescape(a or b or c)) for k, a, b, c in _ATTR.findall(attrs)] if attrs else ())
            stack[-1].children.append(node)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                raw = source[at:stop.start()] if stop else source[at:]
                if tag in ("title", "textarea"):
                    node.children.append(html.unescape(raw))
                at = stop.end() if stop else end
            elif tag not in VOID and not (attrs or "").endswith("/"):
                if len(stack) < DEEPEST:
                    stack.append(node)
                else:
                    deep.opened(tag)
    return root


def _close(stack, tags):
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return True
        if stack[i].tag in SCOPES:
            return False
    return False


class _Deep:
    """Names of open elements that are too deep for the stack: their closing tags close
    them, not an ancestor of the same name."""

    def __init__(self):
        self.names, self.count = [], Counter()

    def opened(self, tag):
        self.names.append(tag)
        self.count[tag] += 1

    def clear(self):
        if self.names:
            self.names.clear()
            self.count.clear()

    def _cut(self, at):
        self.count.subtract(self.names[at:])
        del self.names[at:]

    def closed(self, tag):
        """Whether a closing tag is used up here."""
        if tag == "p":
            return self.ended(("p",))
        if not self.count[tag]:
            return False
        at = len(self.names) - 1
        while self.names[at] != tag:
            at -= 1
        self._cut(at)
        return True

    def ended(self, tags):
        """Whether an element that ends tags of its scope finds its end here; seen are the last ``DEEPEST`` names."""
        for i in range(len(self.names) - 1, max(-1, len(self.names) - 1 - DEEPEST), -1):
            if self.names[i] in tags:
                self._cut(i)
                return True
            if self.names[i] in SCOPES:
                return True
        return len(self.names) > DEEPEST


def label(node: Node) -> str:
    """Tag with its first class or id: what nodes must share to match."""
    if not node.attrs:
        return node.tag
    mark = node.attrs.get("id") or node.attrs.get("class") or node.attrs.get("role") or ""
    mark = re.sub(r"[0-9]+", "#", mark.split()[0]) if mark.split() else ""
    return f"{node.tag}.{mark}" if mark else node.tag


def _places(labels):
    """Each child's place among a shape's children: neighbours of one label share one, and so do all of a label that
    comes in many runs."""
    runs = Counter(name for i, name in enumerate(labels) if not i or labels[i - 1] != name)
    first, out, n = {}, [], 0
    for i, name in enumerate(labels):
        if runs[name] > MANY_RUNS and name in first:
            out.append(first[name])
        elif i and labels[i - 1] == name:
            out.append(out[-1])
        else:
            first[name] = n
            out.append(n)
            n += 1
    return out


def _formed(node):
    """Children that count for a shape."""
    return [c for c in node.elements() if c.tag in BLOCKS or c.elements()]


def shape(node: Node):
    """(label, children's shapes); repeated children become one, their own children pooled."""
    parts, out = [shape(c) for c in _formed(node)], []
    if not parts:
        return label(node), ()
    for got, place in zip(parts, _places([p[0] for p in parts])):
        if place == len(out):
            out.append(got)
        else:
            out[place] = (got[0], _pooled(out[place][1], got[1]))
    return label(node), tuple(out)


def _pooled(a, b):
    """Children of repeated nodes: those of the first, and what only later ones have."""
    if not b or a == b:
        return a
    have = {c[0]: i for i, c in enumerate(a)}
    out = list(a)
    for c in b:
        if c[0] in have:
            i = have[c[0]]
            out[i] = (c[0], _pooled(out[i][1], c[1]))
        else:
            have[c[0]] = len(out)
            out.append(c)
    return tuple(out)


def matched(a, b, known=None):
    """Simple tree matching of two shapes with one label: (size, pairs of child places).

    The most nodes that can be paired so that order and parenthood hold.  Only pairs of one label are looked at; the best chain
    that ends before a pair comes from a tree of running maxima, so the work is near-linear in those pairs.  known: results
    of pairs of shapes that live as long as it does."""
    known = {} if known is None else known
    if (id(a), id(b)) in known:
        return known[id(a), id(b)]
    size, pairs, top = 0, [], min(len(a[1]), len(b[1]))
    lead = 0
    while lead < top and a[1][lead] == b[1][lead]:
        lead += 1
    tail = 0
    while tail < top - lead and a[1][-1 - tail] == b[1][-1 - tail]:
        tail += 1
    m, n = len(a[1]) - tail, len(b[1]) - tail
    ends = [(i, i) for i in range(lead)], [(m + i, n + i) for i in range(tail)]
    size = sum(_size(a[1][i]) for i, _ in itertools.chain(*ends))
    places = {}
    for j in range(n - 1, lead - 1, -1):                     # from the right, so a row's pairs don't chain with each other
        places.setdefault(b[1][j][0], []).append(j)
    best = [(0, None)] * (n - lead + 1)                      # of places before, by powers of two
    for i in range(lead, m):
        for j in places.get(a[1][i][0], ()):
            at, before = j - lead, (0, None)
            while at:
                if best[at][0] > before[0]:
                    before = best[at]
                at -= at & -at
            chain = before[0] + matched(a[1][i], b[1][j], known)[0], (i, j, before[1])
            at = j - lead + 1
            while at <= n - lead:
                if chain[0] > best[at][0]:
                    best[at] = chain
                at += at & -at
    got, at = (0, None), n - lead
    while at > 0:
        if best[at][0] > got[0]:
            got = best[at]
        at -= at & -at
    size, link = size + got[0], got[1]
    while link:
        pairs.append(link[:2])
        link = link[2]
    known[id(a), id(b)] = size + 1, [*ends[0], *pairs[::-1], *ends[1]]
    return known[id(a), id(b)]


def _size(a):
    return 1 + sum(map(_size, a[1]))


def merged(a, b, known=None):
    """The smallest shape that holds both, aligned by tree matching."""
    if a == b:
        return a
    known = {} if known is None else known
    _, pairs = matched(a, b, known)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[1]), len(b[1]))]:
        out += a[1][i:x]
        out += b[1][j:y]
        if x < len(a[1]) and y < len(b[1]):
            out.append(merged(a[1][x], b[1][y], known))
        i, j = x + 1, y + 1
    return a[0], tuple(out)


def numbered(template, at=0):
    """Places of a template's nodes in preorder: {path of child places: number}."""
    out, todo = {}, [((), template)]
    while todo:
        path, node = todo.pop()
        out[path] = len(out)
        todo += [(path + (i,), c) for i, c in reversed(list(enumerate(node[1])))]
    return out


def assign(template, numbers, page_shape):
    """{path in a page's shape: template node's number}, by tree matching from the root."""
    out, todo, known = {}, [((), (), template, page_shape)], {}
    while todo:
        tpath, path, t, p = todo.pop()
        out[path] = numbers[tpath]
        todo += [(tpath + (i,), path + (j,), t[1][i], p[1][j]) for i, j in matched(t, p, known)[1]]
    return out


def mark(node: Node, form, found, path=()):
    """Writes the template's number (None where nothing matches) on a page's elements.
    form: the shape of the node, or of all the nodes that were pooled with it."""
    node.id = found.get(path)
    children = _formed(node)
    if not children:
        return
    labels = [label(c) for c in children]
    places, names = _places(labels), [c[0] for c in form[1]]
    runs = [None] * (max(places, default=-1) + 1)
    for name, place in zip(labels, places):
        runs[place] = name
    index = None if names == runs else {name: i for i, name in reversed(list(enumerate(names)))}
    for child, name, place in zip(children, labels, places):
        place = place if index is None else index[name]
        mark(child, form[1][place], found, path + (place,))
