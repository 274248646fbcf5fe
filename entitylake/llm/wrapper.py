"""HTML extraction by wrapper induction over the pages of a host.

Each page becomes a tree of its block elements, in which neighbouring siblings with the same label fold into one repeating node; its shape
is that tree without text. The commonest shape of a host is its reference, and every other shape is aligned with it by simple tree
matching, so matching runs once per host and shape, not once per page. For every aligned node the texts of all pages of the host
are counted, pages with the same text once: nodes whose text hardly varies are template, the others are slots that hold content. Elements that are
menus, forms or the like are template too unless they hold an article; so are those whose class, id or role names them so, unless they
hold an article or the slot that varies with the most text.

Pages are never shuffled by host as long as Spark finds the table of wrappers (a row per host and shape) small enough to
broadcast; beyond that it joins them, and adaptive execution splits a host with very many pages.
"""

from __future__ import annotations

import html as html_module
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    # A quote goes with its pair where there is one and never is tried alone then: one way to read every tag.
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that stand apart on a page; all others run within a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html head legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes if it is the innermost block.
CLOSES = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}}
#: Elements that mark what isn't the article, and whole names in class, id or role that do so.
PLAIN_TEMPLATE = frozenset("head nav footer aside form menu dialog button".split())
TEMPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead"
    " menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply respond search share sharing"
    " sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
MARK = "!"
CONTENT = frozenset(("article", "main"))
#: Deeper elements count as part of the one at this depth; their text stays.
DEPTH = 200
#: A node is template if its texts on this many different pages or more are at most this share of different ones.
PAGES, VARIETY = 3, 0.2
#: Inside an article only a text that is the same on every one of this many pages is template.
ARTICLE_PAGES = 10


@dataclass
class Node:
    label: str
    children: list["Node"] = field(default_factory=list)
    number: int = 0


def label_of(tag: str, attributes: str) -> str:
    """Tag, words of class, id and role, and MARK if one of the names as a whole is a template word."""
    names = {x for found in NAMED.findall(attributes) for x in "".join(found).lower().split()} if attributes else set()
    words = sorted({w for x in names for w in re.findall(r"[a-z]+", x)})
    return ".".join([tag, *words, *([MARK] if names & TEMPLATE_WORDS else [])])


def read(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """Tree of block elements and the text blocks in page order, white space as one blank, character references decoded."""
    root = Node("")
    path, tags, deep = [root], [""], 0
    blocks: list[tuple[Node, str]] = []
    held: list[str] = []

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append((path[-1], text))

    for token in TOKEN.finditer(page):
        tag = token[3]
        if tag is None:
            piece = token[0]
            if piece[0] != "<" or piece == "<":
                held.append(html_module.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "br":
                held.append(" ")
            continue
        flush()
        if token[2]:
            if tag in tags:
                at = len(tags) - 1 - tags[::-1].index(tag)
                del tags[at:]
                del path[at:]
            continue
        closing = CLOSES.get(tag, {"p"})
        while tags[-1] in closing:
            tags.pop()
            path.pop()
        if tag == "hr":
            continue
        if len(path) <= DEPTH:
            node = Node(label_of(tag, token[4]))
            path[-1].children.append(node)
        else:
            node = path[-1]
        path.append(node)
        tags.append(tag)
    flush()
    return root, blocks


def folded(nodes: list[Node], alias: dict[int, Node]) -> list[Node]:
    """Neighbouring nodes of one label as one node with all their children; `alias` leads from a node to the one that stands for it."""
    out: list[Node] = []
    for node in nodes:
        if out and out[-1].label == node.label:
            out[-1].children += node.children
            alias[id(node)] = out[-1]
        else:
            out.append(node)
    for node in out:
        node.children = folded(node.children, alias)
    return out


def numbered(root: Node) -> int:
    count, todo = 0, [root]
    while todo:
        node = todo.pop()
        node.number = count
        count += 1
        todo += reversed(node.children)
    return count


def shape_of(node: Node) -> str:
    inside = " ".join(map(shape_of, node.children))
    return f"{node.label}({inside})" if inside else node.label


def tree_of(shape: str) -> Node:
    root = Node("")
    path, last = [root], root
    for part in re.findall(r"[^() ]+|[()]", shape if shape.startswith("(") else f"({shape})"):
        if part == "(":
            path.append(last)
        elif part == ")":
            last = path.pop()
        else:
            last = Node(part)
            path[-1].children.append(last)
    numbered(root)
    return root


def structure(page: str) -> tuple[str, list[tuple[int, str]]]:
    """Shape of a page and its blocks as (node, text)."""
    root, blocks = read(page)
    alias: dict[int, Node] = {}
    root.children = folded(root.children, alias)
    numbered(root)

    def stands(node: Node) -> Node:
        while id(node) in alias:
            node = alias[id(node)]
        return node

    return shape_of(root), [(stands(node).number, text) for node, text in blocks]


def matched(a: Node, b: Node) -> list[tuple[int, int]]:
    """Node pairs of the largest simple tree matching of two trees: labels, order and parents agree."""
    known: dict[tuple[int, int], tuple[int, list]] = {}

    def size(x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        key = (x.number, y.number)
        if key not in known:
            m, n = len(x.children), len(y.children)
            best = [[0] * (n + 1) for _ in range(m + 1)]
            for i in range(1, m + 1):
                for j in range(1, n + 1):
                    best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size(x.children[i - 1], y.children[j - 1]))
            known[key] = best[m][n] + 1, best
        return known[key][0]

    pairs, todo = [], [(a, b)] if size(a, b) else []
    while todo:
        x, y = todo.pop()
        pairs.append((x.number, y.number))
        best, i, j = known[(x.number, y.number)][1], len(x.children), len(y.children)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x.children[i], y.children[j]))
    return pairs


def slots_of(shape: str, reference: str) -> list[str]:
    """For each node of `shape` the node of the reference it matches, or one of its own."""
    tree = tree_of(shape)
    out = [f"{shape}#{i}" for i in range(numbered(tree))]
    for mine, other in matched(tree, tree_of(reference)):
        out[mine] = str(other)
    return out


def around_content(root: Node) -> set[int]:
    """Numbers of the nodes that have an article or main below them."""
    out, todo = set(), [(root, ())]
    while todo:
        node, above = todo.pop()
        if node.label.split(".")[0] in CONTENT:
            out.update(above)
        todo += [(child, (*above, node.number)) for child in node.children]
    return out


def kept_nodes(shape: str, pages: list[int], variants: list[int], sizes: list[int]) -> list[bool]:
    """Which nodes of a shape hold content, from the different pages, different texts and their characters of each slot.

    Template is what the elements PLAIN_TEMPLATE hold, what hardly varies, and what calls itself so by a whole name in class, id or
    role. A name does not count above an article or main, nor above the slot that varies with the most text: the one
    outside all such names if there is any, else of all.
    """
    tree = tree_of(shape)
    out = [False] * numbered(tree)
    around = around_content(tree)
    has_article = any(name.split(".")[0] in CONTENT for name in re.findall(r"[^() ]+", shape))
    seen, todo = [], [(tree, False, False, ())]
    while todo:
        node, template, article, path = todo.pop()
        tag, *words = node.label.split(".")
        plain = not article if tag == "header" else tag in PLAIN_TEMPLATE
        template = template or (plain and node.number not in around)
        article = article or tag in CONTENT
        path = (*path, (node.number, MARK in words and tag not in CONTENT and tag != "body" and node.number not in around))
        n, different = pages[node.number], variants[node.number]
        if article:
            constant = n >= ARTICLE_PAGES and different == 1
        else:
            constant = n >= PAGES and different <= max(1, VARIETY * n)
        if not template and not constant and (article or not has_article):
            seen.append((node.number, path))
        todo += [(child, template, article, path) for child in node.children]
    densest = max((x for x in seen if sizes[x[0]]), key=lambda x: (not any(marked for _, marked in x[1]), sizes[x[0]], -x[0]), default=(0, ()))
    above = {number for number, _ in densest[1]}
    for number, path in seen:
        out[number] = not any(marked and other not in above for other, marked in path)
    return out


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parsed(pages: DataFrame, schema: str, columns) -> DataFrame:
    """mapInArrow over (…, html), the last column; `columns` makes what comes after the other columns from shapes and blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [structure(x or "") for x in some.column(some.num_columns - 1).to_pylist()]
                names, arrays = columns(found)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *arrays], names=[*some.schema.names[:-1], *names])

    return pages.mapInArrow(run, schema)


def page_shapes(found):
    import xxhash

    nodes, texts, sizes, pages = [], [], [], []
    for _, blocks in found:
        pages.append(xxhash.xxh3_128_digest("\n".join(text for _, text in blocks).encode("utf-8", "replace")))
        own: dict[int, list[str]] = {}
        for node, text in blocks:
            own.setdefault(node, []).append(text)
        nodes.append(list(own))
        texts.append([xxhash.xxh3_64_intdigest("\n".join(x).encode()) - (1 << 63) for x in own.values()])
        sizes.append([sum(map(len, x)) for x in own.values()])
    return ["shape", "page", "nodes", "texts", "sizes"], [
        pa.array([s for s, _ in found]), pa.array(pages, pa.binary()), pa.array(nodes, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
    ]


def page_blocks(found):
    return ["shape", "nodes", "blocks"], [
        pa.array([s for s, _ in found]), pa.array([[n for n, _ in b] for _, b in found], pa.list_(pa.int32())), pa.array([[t for _, t in b] for _, b in found], pa.list_(pa.string())),
    ]


def wrappers(pages: DataFrame) -> DataFrame:
    """host, shape, kept (a boolean per node): the wrappers of all hosts of `pages` (url, html)."""
    seen = stored(parsed(pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")), "host string, shape string, page binary, nodes array<int>, texts array<bigint>, sizes array<int>", page_shapes))
    shapes = seen.groupBy("host", "shape", "page").agg(F.count(F.lit(1))).groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    different = seen.groupBy("host", "page").agg(F.min(F.struct("shape", "nodes", "texts", "sizes")).alias("one")).select("host", "one.*")
    reference = shapes.groupBy(F.col("host").alias("of")).agg(F.max_by("shape", F.struct("n", "shape")).alias("reference"))

    def align(batches):
        for batch in batches:
            rows = batch.to_pydict()
            slots = [slots_of(s, r) for s, r in zip(rows["shape"], rows["reference"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.string()))], names=["host", "shape", "slots"])

    aligned = shapes.join(reference, F.col("host") == F.col("of")).select("host", "shape", "reference").mapInArrow(align, "host string, shape string, slots array<string>")
    slots = stored(aligned.select("host", "shape", F.posexplode("slots").alias("node", "slot")))
    counted = different.select("host", "shape", F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("texts").alias("text"), F.col("sizes").alias("size")))).groupBy("host", "shape", "node", "text").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    facts = (
        counted.join(slots, ["host", "shape", "node"]).groupBy("host", "slot", "text").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
        .groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("variants"), F.sum("size").alias("size"))
    )
    rows = slots.join(facts, ["host", "slot"], "left").groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("node", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("variants", F.lit(0)).alias("variants"), F.coalesce("size", F.lit(0)).alias("size")))).alias("x"))

    def decide(batches):
        for batch in batches:
            rows = batch.to_pydict()
            kept = [kept_nodes(*x) for x in zip(rows["shape"], rows["pages"], rows["variants"], rows["sizes"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.bool_()))], names=["host", "shape", "kept"])

    return rows.select("host", "shape", F.col("x.pages").alias("pages"), F.col("x.variants").alias("variants"), F.col("x.size").alias("sizes")).mapInArrow(decide, "host string, shape string, kept array<boolean>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    Null and empty pages have an empty text. Null urls and urls without a host are one host. Broken markup is read as far as it goes: tags that
    never end are text, blocks that never close end with their parent. Repeated rows stay; ids need not be unique.
    """
    ready = stored(wrappers(pages)).withColumnsRenamed({"host": "of_host", "shape": "of_shape"})
    kinds = pages.select("page_id", "url").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", host string, shape string, nodes array<int>, blocks array<string>"
    blocks = parsed(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")), schema, page_blocks)
    own = F.filter(F.arrays_zip("nodes", "blocks", F.transform("nodes", lambda n: F.get("kept", n)).alias("hold")), lambda x: x["hold"])
    text = F.array_join(F.transform(own, lambda x: x["blocks"]), " ")
    return (
        blocks.join(ready, (F.col("host") == F.col("of_host")) & (F.col("shape") == F.col("of_shape")))
        .select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    )
