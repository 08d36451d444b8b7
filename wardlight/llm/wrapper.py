"""Main text of web pages by wrapper induction.

Per host a template is induced from all distinct shapes of its pages: their trees,
repeated siblings pooled, are aligned by simple tree matching and merged, ``FAN`` at a
time in a tree of partial merges.  Every page is then aligned with its host's template,
and for every template node the distinct page contents that have it, the most frequent
text in it, its characters and its share of link text are counted; copies count once.
A node is judged by its own text, outside of its block children: if it is the same on
most contents it is template, and so is one of links; the others are slots.

A slot weighs what it holds on average over the host's contents, so an advert that
changes from page to page is known by its place.  From the root the page's main part is
found by going down to the child that holds ``MOST`` of the weight (``DECLARED`` for one
that leads to a declared article), never into lists, tables or running text.  Names,
tags and roles of menus, footers, adverts and the like are a vote: it lowers the weight
of what is inside (``VOTE``, ``COMMENT``), and an element with a vote goes only if little
of the main part's weight (``MINOR``) is in it.  Beside the main part, siblings with less
than ``BESIDE`` of its weight go; outside a declared article all but further articles do.
A constant paragraph in a declared article stays.  If no slot on the page has text, the
declared article, or else the page, is taken as it is.  Only what is never shown
(scripts, styles, hidden elements) is cut by its markup alone.

Shapes are counted by (host, shape) and texts by (host, node, text, content) first, so a
host with a third of all pages is no single task.  Templates are joined by host, broadcast only if their size is small
(``BROADCAST_BYTES``).

Blocks are joined by a line feed; white space in a block, line breaks among it, is one
space; character references are decoded.

Defined results: null and empty html, and pages without text, give an empty text and 0;
a null or odd url is the host of the empty name; rows of one page_id are separate pages;
markup that is cut off or wrongly nested is read as far as it goes; elements nested more
than 150 deep count as siblings; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardlight.llm import dom
from wardlight.llm.tables import query, table
from wardlight.session import checkpointed

#: Shapes merged by one task at a time.
FAN = 64
SAME_PAGES, SAME_SHARE, LINK_SHARE = 4, 0.9, 0.6
BROADCAST_BYTES = 16_000_000

#: Shares of a page's weight: see above.
MOST, DECLARED, MINOR, BESIDE = 0.7, 0.5, 0.3, 0.1
VOTE, COMMENT = 0.25, 0.05

_UNSEEN = frozenset("""script style noscript template head title select option textarea iframe svg canvas object embed
    audio video map datalist""".split())
_VOTES = frozenset("nav footer aside form button menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_MARKS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup
    login sidebar rail widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs
    menu navbar navigation nav topbar footer masthead comment comments disqus reply replies respond search pagination
    pager skip""".split())
_TALK = frozenset("comment comments disqus reply replies respond".split())
#: Parts of a name that say nothing: "site-footer" is a footer, "no-sidebar" isn't a sidebar.
_PLAIN = frozenset("""bar box area block list item wrap wrapper container inner outer top bottom left right site page
    global main section panel slot unit group row col links text content form js el""".split())
_OWN = frozenset("article entry post story content main".split())
#: What the way to the main part never enters.
_RUN = frozenset("""p pre ul ol dl li dt dd table thead tbody tfoot tr td th blockquote figure figcaption h1 h2 h3 h4 h5 h6
    hgroup address details summary""".split())
#: What stays in a declared article even if it is the same on all pages.
_RUNNING = frozenset(("p", "pre"))
_SPLIT = re.compile(r"[^a-z]+")


def _unseen(node: dom.Node) -> bool:
    """Whether an element is never shown."""
    attrs = node.attrs
    return node.tag in _UNSEEN or bool(attrs) and (
        "hidden" in attrs or attrs.get("aria-hidden") == "true"
        or "display:none" in attrs.get("style", "").replace(" ", "").lower())


def _vote(node: dom.Node, in_article: bool) -> float:
    """What an element's tag, role and names leave of its weight; 1 without a vote against it."""
    tag, names = node.tag, _names(node)
    if names and any(not _TALK.isdisjoint(n) for n in names):
        return COMMENT
    if tag in ("html", "body", "article", "main", "#root"):
        return 1.0
    if tag in _VOTES or node.attrs and node.attrs.get("role", "").lower() in _ROLES:
        return VOTE
    if tag == "header" or any("header" in n for n in names):
        return 1.0 if in_article or any(not _OWN.isdisjoint(n) for n in names) else VOTE
    return VOTE if names else 1.0


def _names(node):
    """Names of an element, by their words, that hold a mark (or "header") and else only plain words."""
    attrs = node.attrs
    return _marked(attrs.get("class", ""), attrs.get("id", "")) if "class" in attrs or "id" in attrs else ()


@functools.lru_cache(4096)
def _marked(classes, name):
    named = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{classes} {name}").lower()
    marks = _MARKS | {"header"}
    found = ({w for w in _SPLIT.split(name) if w} for name in named.split())
    return [n for n in found if not marks.isdisjoint(n) and n <= marks | _PLAIN | _OWN]


def _is_article(node):
    return node.tag == "article" or node.attrs.get("itemprop") == "articleBody"


def _is_main(node):
    return node.tag == "main" or node.attrs.get("role") == "main"


def _parts(node, wanted, found):
    for child in node.elements():
        if not _unseen(child) and _vote(child, False) == 1.0:
            if wanted(child):
                found.append(child)
            else:
                _parts(child, wanted, found)
    return found


def weigh(root: dom.Node, gone=frozenset(), means=None) -> None:
    """Writes ``own``, the weight of an element's own text, ``mass``, that of all within, and ``led``, whether an
    article is declared there.  means: characters of a template's slots, on average over a host's contents."""
    chars, of = {}, Counter()
    for node in itertools.chain([root], _judged(root)):
        if node.tag in dom.BLOCKS or node is root:
            text, links = _own_text(node)
            n = len(" ".join(text.split()))
            n = 0 if node.id in gone or links > LINK_SHARE * n else n - links
            if n:
                chars[id(node)] = n
                of[node.id] += n
    means = means or {}

    def down(node, left, inside):
        own = chars.get(id(node), 0)
        if own and node.id in means:
            own = means[node.id] * own / of[node.id]
        left = min(left, _vote(node, inside))
        inside = inside or _is_article(node) or _is_main(node)
        node.own, node.led = own * left, inside and left == 1.0 and (_is_article(node) or _is_main(node))
        node.mass = node.own
        for child in node.elements():
            if _unseen(child):
                child.own, child.mass, child.led = 0, 0, False
            else:
                down(child, left, inside)
                node.mass += child.mass
                node.led = node.led or child.led and child.mass > 0
    down(root, 1.0, False)


def main_part(root: dom.Node) -> list:
    """The elements from the root down to a weighed page's main part."""
    path = [root]
    while not _is_article(path[-1]):
        node = path[-1]
        best = max((c for c in node.elements() if c.tag not in _RUN), key=lambda c: c.mass, default=None)
        if best is None or best.mass <= 0 or best.mass < (DECLARED if best.led else MOST) * node.mass:
            break
        if best.mass - best.own < (DECLARED if best.led else MOST) * node.mass and not _is_article(best):
            break
        path.append(best)
    return path


class _Reader:
    """Writes out the pieces of a page's text, and None at every block's edge."""

    def __init__(self, gone, part):
        self.gone, self.part, self.out = gone, part, []

    def along(self, path, declared):
        """path: down to the main part.  declared: whether an article further down is declared."""
        node, rest = path[0], path[1:]
        if not rest:
            return self.blocks(node, self.inside(path), self.kept(node, False))
        for child in node.children:
            if child is rest[0]:
                self.out.append(None)
                self.along(rest, declared and not (_is_article(child) or _is_main(child)))
                self.out.append(None)
            elif isinstance(child, str):
                if not declared and self.kept(node, False):
                    self.out.append(child)
            elif self.beside(child, declared):
                self.one(child, not declared, self.kept(node, False))

    def inside(self, path):
        return _is_article(path[0]) or _is_main(path[0]) or path[0].tag not in ("#root", "html", "body")

    def beside(self, child, declared):
        large = child.mass >= BESIDE * self.part.mass
        if declared:
            return _is_article(child) and large and not (child.mass < MINOR * self.part.mass and _leads_away(child))
        return large or child.tag not in dom.BLOCKS or child.tag in ("h1", "h2") and child.mass > 0

    def kept(self, node, in_article):
        return node.id not in self.gone or in_article and node.tag in _RUNNING

    def blocks(self, node, in_article, own):
        """own: whether the node's own text, that outside of its block children, is no template."""
        for child in node.children:
            if isinstance(child, str):
                if own:
                    self.out.append(child)
            else:
                self.one(child, in_article, own)

    def one(self, child, in_article, own):
        if child.tag in ("br", "wbr"):
            if own:
                self.out.append(" " if child.tag == "br" else "")
            return
        edge = child.tag in dom.BLOCKS
        if edge:
            self.out.append(None)
        if not (_unseen(child) or _vote(child, in_article) < 1.0 and child.mass <= MINOR * self.part.mass):
            if child.tag == "header" and in_article:
                for block in _headings(child):
                    self.out.append(None)
                    self.blocks(block, True, self.kept(block, True))
                    self.out.append(None)
            else:
                self.blocks(child, in_article or _is_article(child), self.kept(child, in_article) if edge else own)
        if edge:
            self.out.append(None)


def _leads_away(article):
    """Whether a heading of it is a link, as in a teaser of another story."""
    return any(c.tag == "a" or any(d.tag == "a" for d in c.elements()) for h in _headings(article) if h.tag[0] == "h"
               for c in h.elements())


def _headings(node):
    """Headings and running text in a header."""
    for child in node.elements():
        if re.fullmatch(r"h[1-6]|p|blockquote", child.tag):
            yield child
        else:
            yield from _headings(child)


def _lines(pieces):
    out, now = [], []
    for piece in [*pieces, None]:
        if piece is not None:
            now.append(piece)
        elif now:
            line = " ".join("".join(now).split())
            if line:
                out.append(line)
            now = []
    return out


def main_text(root: dom.Node, template=frozenset(), links=frozenset(), means=None) -> str:
    """template, links: numbers of nodes that are no slots; means: average characters of the slots."""
    gone = template | links
    weigh(root, gone, means)
    if root.mass > 0:
        path = main_part(root)
        reader = _Reader(gone, path[-1])
        reader.along(path, any(map(_is_article, path)) or any(map(_is_main, path)))
        lines = _lines(reader.out)
        if lines:
            return "\n".join(lines)
    pieces = []
    for part in _parts(root, _is_article, []) or _parts(root, _is_main, []) or [root]:
        reader = _Reader(frozenset(), part)
        reader.blocks(part, part is not root, True)
        pieces += [*reader.out, None]
    return "\n".join(_lines(pieces))


def induce(shapes: list):
    """The template of some shapes of a host, or of templates of parts of them."""
    template = shapes[0]
    for s in shapes[1:]:
        template = dom.merged(template, s)
    return template


class Aligner:
    """Aligns pages with their host's template; keeps what equal shapes got."""

    def __init__(self):
        self.templates, self.found = {}, {}

    def page(self, host, batch, i, source):
        """The page's tree, and its host's fixed and linked nodes and means; batch: columns template, fixed, linked, means, of which
        the last three may be missing, read once a host."""
        root = dom.parse(source)
        if host not in self.templates:
            if len(self.templates) > 1000:
                self.templates.clear()
                self.found.clear()
            packed, *known = (c[i].as_py() for c in batch)
            template = packed and pickle.loads(packed)
            known = [frozenset(known[0] or ()), frozenset(known[1] or ()), dict(known[2] or ())] if known else []
            self.templates[host] = template, template and dom.numbered(template), known
        template, numbers, known = self.templates[host]
        if template is None:
            return root, known
        form = dom.shape(root)
        if (host, form) not in self.found:
            if len(self.found) > 5000:
                self.found.clear()
            self.found[host, form] = dom.assign(template, numbers, form)
        dom.mark(root, form, self.found[host, form])
        return root, known


def _own_text(node, linked=False):
    """Text and link text of an element outside of its block children."""
    text, links = [], 0
    for child in node.children:
        if isinstance(child, str):
            text.append(child)
            links += len(child.strip()) if linked else 0
        elif child.tag not in dom.BLOCKS and child.tag not in dom.RAW:
            t, n = _own_text(child, linked or child.tag == "a")
            text.append(t)
            links += n
    return "".join(text), links


def _judged(node):
    """Elements of a page that may be shown."""
    todo = [node]
    while todo:
        for child in todo.pop().children:
            if not isinstance(child, str) and not _unseen(child):
                yield child
                todo.append(child)


def _counted(batches):
    from xxhash import xxh64_intdigest
    aligner = Aligner()
    for batch in batches:
        rows = set()
        hosts, packed, sources = (batch.column(i) for i in range(3))
        for i, host in enumerate(hosts.to_pylist()):
            (root, _), of = aligner.page(host, [packed], i, sources[i].as_py()), {}
            for node in itertools.chain([root], _judged(root)):
                if node.id is None or node.tag not in dom.BLOCKS and node is not root:
                    continue
                text, links = _own_text(node)
                text = " ".join(text.split())
                if text:
                    had = of.setdefault(node.id, [[], 0])
                    had[0].append(text)
                    had[1] += min(links, len(text))
            joined = {n: "\n".join(texts) for n, (texts, _) in of.items()}
            content = xxh64_intdigest("\0".join(joined[n] for n in sorted(joined))) >> 1
            rows.update((host, n, xxh64_intdigest(t) >> 1, content, sum(map(len, of[n][0])), of[n][1]) for n, t in joined.items())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTS)] if rows else
                                         [pa.array([], f.type) for f in _COUNTS], schema=_COUNTS)


_COUNTS = pa.schema([("host", pa.string()), ("node", pa.int32()), ("text", pa.int64()), ("content", pa.int64()),
                     ("chars", pa.int64()), ("links", pa.int64())])


def _shaped(batches):
    """The distinct shapes of a batch's pages."""
    from xxhash import xxh64_intdigest
    for batch in batches:
        forms = {(host, dom.shape(dom.parse(source.as_py()))) for host, source in zip(batch.column(0).to_pylist(), batch.column(1))}
        rows = [(host, xxh64_intdigest(repr(form)) >> 1, pickle.dumps(form, 5)) for host, form in forms]
        yield pa.RecordBatch.from_pylist([dict(zip(_SHAPES.names, r)) for r in rows], schema=_SHAPES)


_SHAPES = pa.schema([("host", pa.string()), ("key", pa.int64()), ("shape", pa.binary())])


def _extracted(batches):
    aligner = Aligner()
    for batch in batches:
        out = []
        for i, host in enumerate(batch.column(0).to_pylist()):
            root, known = aligner.page(host, batch.columns[1:5], i, batch.column(5)[i].as_py())
            out.append(main_text(root, *known))
        yield pa.RecordBatch.from_arrays([batch.column(6), batch.column(7), pa.array(out, pa.string()),
                                          pa.array([len(t) for t in out], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key")
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "key": [pdf["part"].iloc[0]],
                         "shape": [pickle.dumps(induce([pickle.loads(s) for s in pdf["shape"]]), 5)]})


def _templates(spark, rows: DataFrame) -> DataFrame:
    """template_host, template: merged from every distinct shape of a host's pages."""
    shapes = rows.filter("html <> ''").select("host", "html").mapInArrow(_shaped, "host string, key long, shape binary")
    shapes = checkpointed(spark, shapes.dropDuplicates(["host", "key"]))
    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        most = -(-most // FAN)
        part = shapes.withColumn("part", F.pmod("key", F.lit(most)))
        shapes = checkpointed(spark, part.groupBy("host", "part").applyInPandas(_merged, "host string, key long, shape binary"))
    return shapes.select(F.col("host").alias("template_host"), F.col("shape").alias("template"))


def _small(df: DataFrame, *columns: str) -> DataFrame:
    size = df.select(F.sum(sum((F.length(c) for c in columns), F.lit(64)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def extracted_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    templates = _templates(spark, rows)
    given = _small(templates, "template")
    with_template = rows.join(given, F.col("host") == F.col("template_host"), "left")
    counts = with_template.select("host", "template", "html").mapInArrow(
        _counted, "host string, node int, text long, content long, chars long, links long")
    nodes = (counts.groupBy("host", "node", "text", "content").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
             .groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
             .groupBy("host", "node").agg(F.sum("n").alias("n"), F.max("n").alias("same"),
                                          F.sum("chars").alias("chars"), F.sum("links").alias("links")))
    same = (F.col("n") >= SAME_PAGES) & (F.col("same") >= SAME_SHARE * F.col("n"))
    found = nodes.groupBy("host").agg(                                  # of the nodes of one template
        F.array_sort(F.collect_set(F.when(same, F.col("node")))).alias("fixed"),
        F.array_sort(F.collect_set(F.when(F.col("links") > LINK_SHARE * F.col("chars"), F.col("node")))).alias("linked"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", (F.col("chars") - F.col("links")) / F.col("n"))))).alias("means"))
    wrappers = checkpointed(spark, templates.join(found, F.col("template_host") == F.col("host"), "left").select(
        "template_host", "template", "fixed", "linked", "means"))
    rows = rows.join(_small(wrappers, "template"), F.col("host") == F.col("template_host"), "left")
    return rows.select("host", "template", "fixed", "linked", "means", "html", "page_id", "url").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")


@query("op7_wrapper_induction")
def op7(spark, folder):
    return extracted_text(table(spark, folder, "pages"))
