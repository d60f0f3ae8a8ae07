"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements, where runs of like siblings are
one repeated node.  Pages of a host with the same skeleton (the label paths
near the root) are one layout; layouts of a single page are taken together.
Some pages of every layout are folded into its template by simple tree
matching: the largest order-preserving match of two trees aligns their nodes.
Every page is then aligned with its template, which gives each text block a
slot.  A text that stands in one slot on two different pages at least, and on
most of the layout's pages that have the slot, belongs to the template; other
blocks hold content, unless their element says that they are furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments).
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailforge.llm.common import small_enough
from retailforge.session import stage

#: pages that a template is folded from, by the smallest hashes of their html
SAMPLE = 16
#: a constant: the same text in the same slot on this many different pages, and on this share of those that have the slot
CONSTANT_PAGES, CONSTANT_SHARE = 2, 0.6
#: inside an <article> or <main> element: on so many different pages, and on all that have the slot
ARTICLE_PAGES = 3
#: elements deeper than this hang from their ancestor at that depth; more siblings than this are merged by label
DEPTH, SIBLINGS = 48, 64
#: depth of the skeleton that tells layouts apart
SKELETON = 4
#: a marked element with more than this share of the page's text is no furniture, unless it holds comments
MOST = 2 / 3
#: templates or constants up to these numbers and bytes are broadcast
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20

# Element names of HTML and words that mark furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
 form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
 tr ul button caption optgroup option""".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: an open paragraph ends where one of these begins
ENDS_P = BLOCK - {"button", "option", "optgroup", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd", "li"}
SCOPE = frozenset("article aside body div footer header main nav section table td th ul ol dl form blockquote".split())
FURNITURE = frozenset("nav footer aside form button dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar
 navigation breadcrumb breadcrumbs footer header masthead banner comment comments disqus replies respond cookie cookies consent
 notice notices alert popup modal newsletter subscribe subscription share sharing social related widget login signup search
 toolbar pagination pager skip copyright""".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: words that may stand beside a mark in one class token
BESIDE = frozenset("""site page main top bottom global left right primary secondary inner outer wrap wrapper container box bar area block section
 list item items link links menu widget content text unit slot zone group post posts form button buttons icon icons bottom sticky fixed""".split())

_ATTRS = r"""((?:[^>"']|"[^"]*"|'[^']*')*+)"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|iframe|select|object|canvas|audio|video|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<title\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>[^<]*(?:</title\s*>)?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)" + _ATTRS + ">"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("label", "kids", "parent", "depth", "chrome", "article", "slot", "seen", "tag", "mark", "size", "holds")

    def __init__(self, tag, label, parent, chrome=False, article=False, mark=""):
        self.tag, self.label, self.parent, self.kids = tag, label, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.chrome, self.article, self.slot, self.seen, self.mark = chrome, article, -1, 0, mark
        #: characters of text outside links in it, and whether an article is
        self.size, self.holds = 0, False


class Text:
    """A block of text: the node it stands in, its pieces, and how many characters are inside links."""

    __slots__ = ("node", "parts", "linked")

    def __init__(self, node):
        self.node, self.parts, self.linked = node, [], 0


def mark_of(token: str) -> str:
    """The furniture word of a class or id token; its other parts must be neutral (``site-footer``, not ``entry-header``)."""
    parts = [p for p in _PARTS.split(token) if p]
    words = [p for p in parts if p.isalpha()]
    marks = [p for p in words if p in MARKS]
    return marks[-1] if marks and all(p in MARKS or p in BESIDE for p in words) else ""


def _labels(tag: str, attrs: str) -> tuple[str, bool, str]:
    """Label for the alignment, whether the element is furniture by its name or role, and its mark by class or id."""
    chrome, names, mark = tag in FURNITURE, "", ""
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                chrome = chrome or not ROLES.isdisjoint(value.split())
                continue
            if tag not in ("body", "html", "article", "main"):
                mark = mark or next(filter(None, map(mark_of, value.split())), "")
            if key == "class":
                names = ".".join(_WORDS.findall(value))
    return f"{tag}.{names}" if names else tag, chrome, mark


def settle(root: Node, texts: list[Text]) -> None:
    """Hands furniture down the tree; marked elements that hold an article or most of the page's text are none."""
    whole = 0
    for t in texts:
        n = max(sum(map(len, t.parts)) - t.linked, 0)
        whole += n
        node = t.node
        while node is not None:
            node.size += n
            node.holds = node.holds or (t.node.article and not node.article)
            node = node.parent
    todo = [root]
    while todo:
        n = todo.pop()
        if n.mark and not n.chrome:
            big = n.holds or (n.size > MOST * whole and n.mark not in COMMENTS)
            n.chrome = not big and not (n.article and n.mark in ("header", "masthead", "banner"))
        for k in n.kids:
            k.chrome = k.chrome or n.chrome
            todo.append(k)


def parse(html: str) -> tuple[Node, list[Text]]:
    """Tree of block elements and the text blocks in page order."""
    root = Node("", "", None)
    texts: list[Text] = []
    stack = [root]  # open block elements
    links = 0
    now: Text | None = None

    def pop_to(names, barrier):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return True
            if stack[k].tag in barrier:
                return False
        return False

    for m in _TOKEN.finditer(html):
        raw = m[0]
        tag = m[3]
        if tag is None:
            if raw[0] != "<" or raw == "<":
                if now is None:
                    if raw.isspace():
                        continue
                    now = Text(stack[-1])
                    texts.append(now)
                now.parts.append(raw)
                if links:
                    now.linked += len(raw)
            continue
        tag, closing = tag.lower(), m[2]
        if tag not in BLOCK:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br" and now is not None:
                now.parts.append(" ")
            continue
        now = None
        if closing:
            if any(n.tag == tag for n in stack[1:]):
                pop_to((tag,), ())
                if tag != "p":
                    links = 0
            continue
        if tag in ENDS_P:
            pop_to(("p",), SCOPE)
        if tag in CLOSES:
            pop_to(CLOSES[tag], SCOPE - CLOSES[tag])
        links = 0
        label, chrome, mark = _labels(tag, m[4])
        parent = stack[-1] if len(stack) <= DEPTH else stack[DEPTH]
        # a header of the page, not the heading of an article
        if tag == "header" and not parent.article:
            chrome = True
        node = Node(tag, label, parent, chrome, parent.article or tag in ("article", "main"), mark)
        parent.kids.append(node)
        if tag not in VOID:
            stack.append(node)
    settle(root, texts)
    return root, texts


class Merged:
    """A node of the alignment tree: one label, all like siblings of a run."""

    __slots__ = ("label", "kids", "nodes", "slot", "seen")

    def __init__(self, label, nodes):
        self.label, self.nodes, self.slot, self.seen = label, nodes, -1, 1
        self.kids: list[Merged] = []


def collapse(root: Node) -> Merged:
    top = Merged(root.label, [root])
    todo = [top]
    while todo:
        m = todo.pop()
        runs: list[Merged] = []
        kids = [k for n in m.nodes for k in n.kids]
        for k in kids:
            if runs and runs[-1].label == k.label:
                runs[-1].nodes.append(k)
            else:
                runs.append(Merged(k.label, [k]))
        if len(runs) > SIBLINGS:
            by: dict[str, Merged] = {}
            for r in runs:
                if r.label in by:
                    by[r.label].nodes += r.nodes
                else:
                    by[r.label] = r
            runs = list(by.values())
        m.kids = runs
        todo += runs
    return top


def layout_of(tree: Merged) -> int:
    """Hash of the label paths near the root, outside articles: what pages of one layout share."""
    paths, todo = set(), [(tree, "", 0)]
    while todo:
        m, path, depth = todo.pop()
        path = f"{path}/{m.label}"
        paths.add(path)
        if depth < SKELETON and not any(n.article for n in m.nodes):
            todo += [(k, path, depth + 1) for k in m.kids]
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).digest(), "little", signed=True)


def matching(a: Merged, b: Merged, memo: dict) -> int:
    """Size of the largest order-preserving match of two trees with equal root labels."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    key = (id(a), id(b))
    if key in memo:
        return memo[key][0]
    w = [[matching(x, y, memo) for y in b.kids] for x in a.kids]
    best = [[0] * (len(b.kids) + 1)]
    for row in w:
        up, line = best[-1], [0]
        for j, s in enumerate(row):
            line.append(max(up[j + 1], line[j], up[j] + s if s else 0))
        best.append(line)
    memo[key] = (1 + best[-1][-1], best, w)
    return memo[key][0]


def aligned(a: Merged, b: Merged) -> dict[int, Merged]:
    """Node of ``a`` (by id) -> node of ``b`` in the largest match."""
    memo: dict = {}
    out: dict[int, Merged] = {}
    if not matching(a, b, memo):
        return out
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        out[id(x)] = y
        if (id(x), id(y)) not in memo:
            continue
        _, best, w = memo[(id(x), id(y))]
        i, j = len(x.kids), len(y.kids)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x.kids[i], y.kids[j]))
    return out


def fold(template: Merged | None, page: Merged) -> Merged:
    """The template with the page's further nodes in their places."""
    if template is None:
        return page
    match = aligned(page, template)
    todo = [page]
    while todo:
        x = todo.pop()
        y = match.get(id(x))
        if y is None:
            continue
        y.seen += 1
        place = 0
        for k in x.kids:
            t = match.get(id(k))
            if t is None:
                y.kids.insert(place, k)
                place += 1
            else:
                place = next(i for i, q in enumerate(y.kids) if q is t) + 1
                todo.append(k)
    return template


def to_json(t: Merged) -> str:
    """Template nodes as nested lists."""
    def plain(n):
        return [n.label, [plain(k) for k in n.kids]]
    return json.dumps(plain(t))


def from_json(text: str) -> Merged:
    count = 0

    def build(x):
        nonlocal count
        n = Merged(x[0], [])
        n.slot, count = count, count + 1
        n.kids = [build(k) for k in x[1]]
        return n
    return build(json.loads(text))


def induce(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sample pages of one layout -> its template."""
    template = None
    pages = pdf.sort_values("rank")["html"].tolist()
    for h in pages:
        template = fold(template, collapse(parse(h)[0]))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "layout": [pdf["layout"].iloc[0]], "template": [to_json(template)]})


def _layouts(batches):
    """``host, h, html`` -> ``host, h, layout``."""
    for batch in batches:
        layout = [layout_of(collapse(parse(x)[0])) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(layout, pa.int64())], names=["host", "h", "layout"])


def _blocks_of(html: str, templates: dict[int, Merged] | None):
    """Layout of a page (0: taken together with others) and its text blocks: slot (or -1), furniture or not, text."""
    root, texts = parse(html)
    layout = None
    if templates is not None:
        tree = collapse(root)
        layout = layout_of(tree)
        layout = layout if layout in templates else 0
        match = aligned(tree, templates[layout]) if layout in templates else {}
        todo = [tree]
        while todo:
            x = todo.pop()
            t = match.get(id(x))
            if t is not None:
                for n in x.nodes:
                    n.slot = t.slot
            todo += x.kids
    out = []
    inside = any(t.node.article and not t.node.chrome for t in texts)
    for t in texts:
        raw = "".join(t.parts)
        text = " ".join(entities.unescape(raw).split() if "&" in raw else raw.split())
        if not text:
            continue
        n = t.node
        chrome = n.chrome or (inside and not n.article) or (not n.article and t.linked * 5 >= len(raw) * 4)
        out.append({"slot": n.slot, "chrome": chrome, "article": n.article, "text": text})
    return layout, out


_BLOCKS = "array<struct<slot:int,chrome:boolean,article:boolean,text:string>>"


def _align(batches):
    """``row, host, html, templates`` -> ``row, key, blocks``; key: hash of host and layout."""
    known: dict[str, dict] = {}
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("chrome", pa.bool_()), ("article", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        keys, out = [], []
        for i, (host, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if host not in known and batch.column(3)[i].is_valid:
                if len(known) > 256:
                    known.clear()
                known[host] = {t["layout"]: from_json(t["template"]) for t in batch.column(3)[i].as_py()}
            layout, blocks = _blocks_of(page, known.get(host) if batch.column(3)[i].is_valid else None) if page else (None, [])
            keys.append(None if layout is None else
                        int.from_bytes(hashlib.blake2b(f"{layout} {host}".encode(), digest_size=8).digest(), "little", signed=True))
            out.append(blocks)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(out, kind)], names=["row", "key", "blocks"])


def _checked(df: DataFrame, text: str) -> DataFrame:
    """Broadcast where rows and bytes are checked to be few; other tables are joined by shuffle."""
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS, F.octet_length(text), BROADCAST_BYTES) else df


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``row, text``: every page's other columns and its main text.

    Blocks are in page order, one per line, with character references
    decoded and white space turned into single blanks.  NULL or empty html
    gives the empty string; pages without a host in their URL, and hosts with
    one page, have no template and keep what is not furniture.  Copies of a
    page, and pages whose content is equal, count once towards what is
    constant.  An empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("row"),
                        F.coalesce(host, F.lit("")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumn("h", F.when((F.col("host") != "") & (F.col("html") != ""), F.xxhash64("html")))
    told = rows.where("h IS NOT NULL").select("host", "h", "html").mapInArrow(_layouts, "host string, h long, layout long").distinct()
    told = stage(told, "page-layouts")
    # layouts with one page only are taken together, as layout 0
    several = told.groupBy("host", "layout").agg(F.count("*").alias("n")).where("n > 1").select("host", "layout", F.lit(True).alias("several"))
    told = told.join(_checked(several, "host"), ["host", "layout"], "left").select("host", "h", F.when(F.col("several"), F.col("layout")).otherwise(0).alias("layout"))
    rank = F.row_number().over(Window.partitionBy("host", "layout").orderBy("h"))
    picked = stage(told.withColumn("rank", rank).where(F.col("rank") <= sample), "sample-pages")  # top rows per layout, taken before the shuffle
    samples = rows.where("h IS NOT NULL").select("host", "html", "h").join(_checked(picked, "host"), ["host", "h"])
    # a page that is repeated stands for itself once
    samples = samples.groupBy("host", "layout", "rank").agg(F.first("html").alias("html"))
    templates = stage(samples.groupBy("host", "layout").applyInPandas(induce, "host string, layout long, template string"), "templates")
    templates = stage(templates.groupBy("host").agg(F.collect_list(F.struct("layout", "template")).alias("templates")), "host-templates")
    size = F.aggregate("templates", F.lit(0), lambda a, t: a + F.length(t["template"]))
    right = F.broadcast(templates) if small_enough(templates, BROADCAST_ROWS, size, BROADCAST_BYTES) else templates
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("key", T.LongType()),
                           T.StructField("blocks", T._parse_datatype_string(_BLOCKS))])
    found = stage(rows.join(right, "host", "left").select("row", "host", "html", "templates").mapInArrow(_align, schema), "page-blocks")

    body = F.filter("blocks", lambda b: ~b["chrome"])
    own = found.where("key IS NOT NULL").select("key", F.xxhash64(F.transform(body, lambda b: b["text"])).alias("page"), body.alias("b"))
    placed = F.filter("b", lambda b: b["slot"] >= 0)
    texts = F.array_distinct(F.transform(placed, lambda b: F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("t"), b["article"].alias("article"))))
    slots = F.array_distinct(F.transform(placed, lambda b: b["slot"]))
    having = (own.select("key", "page", F.explode(slots).alias("slot")).distinct().groupBy("key", "slot").agg(F.count("*").alias("pages")))
    same = (own.select("key", "page", F.explode(texts).alias("s")).distinct().groupBy("key", "s").agg(F.count("*").alias("n"))
            .where(F.col("n") >= CONSTANT_PAGES).select("key", "s.slot", "s.t", "s.article", "n"))
    often = F.when(F.col("article"), (F.col("n") >= ARTICLE_PAGES) & (F.col("n") == F.col("pages"))).otherwise(F.col("n") >= F.col("pages") * CONSTANT_SHARE)
    constant = same.join(having, ["key", "slot"]).where(often).groupBy("key").agg(F.collect_list(F.struct("slot", "t")).alias("constant"))
    constant = stage(constant, "constant-slots")
    right = F.broadcast(constant) if small_enough(constant, BROADCAST_ROWS, F.size("constant") * 12, BROADCAST_BYTES) else constant
    out = found.join(right, "key", "left")
    kept = F.filter("blocks", lambda b: ~b["chrome"] & ~F.coalesce(F.array_contains(
        F.col("constant"), F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("t"))), F.lit(False)))
    return out.select("row", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
