"""Main-text extraction by consensus host paths.

1. Every page is parsed once, into text blocks on a tree of containers, which
   is staged. Containers are scored by the text of their own paragraphs, less
   links; the best is widened to the ancestors that hold the rest of the
   article. 2. Each page votes for the generalised path (tags and classes,
   digits removed) of that container; votes are summed by host and path in
   Spark. 3. Every page is extracted from its blocks under its host's winning
   path; a page where that path holds clearly less text than its own best
   container (another template of the host) is extracted under its own.

Time and memory of a page grow in proportion to its length, however broken its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, staged

#: Fixed tag lists, by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas object textarea title".split())
DROP = frozenset("nav header footer aside form button select menu dialog label fieldset head".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body".split())
#: A paragraph ends at these; list items and cells end their own kind.
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
#: Tags that close an open one of these kinds before them.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}}
#: Blocks of text that never are boilerplate for their names.
PROSE = frozenset("p pre blockquote li dd dt td th tr figure figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose text counts whole in a container's score; others count half.
FULL = frozenset("p pre blockquote h1 h2 h3".split())
#: A block with a boilerplate name is dropped if it has fewer characters than this, or mostly links.
SHORT = 200
#: Words of class or id that mark boilerplate; matched as whole words.
NOISE = re.compile(
    r"(?<![a-z])(ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|header|footer|sidebar|aside|widget|related|recommend\w*|share|social|"
    r"cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|comments?|comment-\w+|replies|respond|disqus|pagination|pager|toolbar|copyright|legal|search)(?![a-z])",
    re.I,
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: The winning path must hold this share of the weight of the page's own best container.
NEAR = 0.8
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
#: What follows a tag's name up to its end; never tried twice from one place.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: An attribute's name, and its value if it has one.
_EACH = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_NOT_SHOWN = re.compile(r"display\s*+:\s*+none", re.I)


class Scanner:
    """Cuts a page into text and tags, forward only.

    What was once found missing to the end of the page is not looked for
    again, and quotes that keep a tag from ending are given up after the text
    tried in vain exceeds the page.
    """

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.missing: set[str] = set()
        self.wasted = 0

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def raw_end(self, tag: str, at: int) -> int:
        """Past the end tag of a raw element, or the page's end."""
        found = re.compile(rf"</{tag}\s*+>", re.I).search(self.page, at)
        return found.end() if found else self.size

    def pieces(self) -> Iterator[tuple[str, str, str]]:
        """('', text, ''), ('open', tag, attributes) and ('close', tag, '')."""
        page, at, size = self.page, 0, self.size
        while at < size:
            start = self.find("<", at)
            if start < 0:
                yield "", page[at:], ""
                return
            if start > at:
                yield "", page[at:start], ""
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", start) and (end := self.find("]]>", start)) >= 0:
                yield "", page[start + 9 : end], ""
                at = end + 3
                continue
            if page.startswith(("<!", "<?"), start):
                end = self.find(">", start)
                at = size if end < 0 else end + 1
                continue
            name = _NAME.match(page, start + 1)
            if not name:
                yield "", "<", ""
                at = start + 1
                continue
            rest = _REST.match(page, name.end()) if self.wasted <= size else None
            if rest:
                attrs, at = rest.group(1), rest.end()
            else:
                end = self.find(">", name.end())
                if end < 0:  # a tag that never ends takes the rest with it
                    return
                if self.wasted <= size:
                    self.wasted += size - start
                attrs, at = page[name.end() : end], end + 1
            tag = name.group(2).lower()
            if name.group(1):
                yield "close", tag, ""
            elif tag in RAW:
                if not attrs.endswith("/"):
                    at = self.raw_end(tag, at)
            else:
                yield "open", tag, attrs


@dataclass
class Page:
    """Text blocks of a page in order, on a tree of containers (node 0: no container; a parent precedes its children)."""

    parents: list[int] = field(default_factory=lambda: [-1])
    labels: list[str] = field(default_factory=lambda: [""])
    nodes: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    full: list[bool] = field(default_factory=list)

    def weight(self, k: int) -> float:
        return max(0, len(self.texts[k]) - 2 * self.links[k]) * (1.0 if self.full[k] else 0.5)

    def chain(self, node: int) -> list[int]:
        """The nodes from the outermost container to ``node``."""
        out = []
        while node > 0:
            out.append(node)
            node = self.parents[node]
        return out[::-1]

    def path(self, node: int) -> str:
        return "/".join(self.labels[n] for n in self.chain(node))

    def node_of(self, path: str) -> int:
        """The node of a path, or -1."""
        at = 0
        children = {(p, label): n for n, (p, label) in enumerate(zip(self.parents, self.labels, strict=True))}
        for label in path.split("/"):
            at = children.get((at, label), -1)
            if at < 0:
                return -1
        return at

    def below(self, node: int) -> list[int]:
        """Blocks under a node."""
        inside = [False] * len(self.parents)
        for n, parent in enumerate(self.parents):
            inside[n] = n == node or (n > 0 and inside[parent])
        return [k for k, n in enumerate(self.nodes) if inside[n]]


def _hidden(attrs: str) -> bool:
    """Whether the attribute ``hidden`` is there, or a style that shows nothing; other attributes' values say nothing."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low:
        return False
    return any(name.lower() == "hidden" or name.lower() == "style" and bool(_NOT_SHOWN.search(a or b or c)) for name, a, b, c in _EACH.findall(attrs))


def _noisy(tag: str, attrs: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether a tag is boilerplate, whether its names say so, and its generalised classes.

    ``inside`` an article or main, ids (anchors) and the names of PROSE say nothing.
    """
    if not attrs.strip():
        return tag in DROP, False, ""
    found = {k.lower(): (a or b or c).strip() for k, a, b, c in _ATTR.findall(attrs)}
    bad = tag in DROP or _hidden(attrs) or found.get("role", "").lower() in NOISE_ROLES
    named = found.get("class", "") if inside else f"{found.get('class', '')} {found.get('id', '')}"
    could = tag in BLOCK - HEADINGS and tag not in ("html", "body", "article", "main") and not (inside and tag in PROSE)
    classes = re.sub(r"[\d/]+", "", ".".join(found.get("class", "").split()))
    return bad, could and bool(NOISE.search(named.replace("_", "-"))), classes


class _Parser:
    """Open tags with, for each: its node, whether it is dropped, and for a boilerplate name the blocks before it."""

    def __init__(self):
        self.page = Page()
        self.children: dict[tuple[int, str], int] = {}
        self.stack: list[tuple[str, int, bool, int]] = []
        self.block_at: list[int] = []  # places of block tags in the stack
        self.open: dict[str, int] = {}
        self.named = 0
        #: characters and links of the blocks so far, as running sums
        self.chars, self.linked = [0], [0]
        self.parts: list[str] = []
        self.links, self.kind = 0, ""

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            page = self.page
            page.nodes.append(self.stack[-1][1] if self.stack else 0)
            page.texts.append(text)
            page.links.append(self.links)
            page.full.append(self.kind in FULL)
            self.chars.append(self.chars[-1] + len(text))
            self.linked.append(self.linked[-1] + self.links)
        self.parts.clear()
        self.links, self.kind = 0, ""

    def add(self, raw: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            text = entities.unescape(raw)
            self.parts.append(text)
            if self.open.get("a"):
                self.links += len(text)

    def close(self, k: int) -> None:
        """Close the tags from the k-th on; those named like boilerplate lose what is short or mostly links."""
        if self.named and any(start >= 0 for *_, start in self.stack[k:]):
            self.flush()
        page = self.page
        while len(self.stack) > k:
            tag, _, _, start = self.stack.pop()
            self.open[tag] -= 1
            if self.block_at and self.block_at[-1] == len(self.stack):
                self.block_at.pop()
            if start >= 0:
                self.named -= 1
                chars = self.chars[-1] - self.chars[start]
                if chars < SHORT or 2 * (self.linked[-1] - self.linked[start]) >= chars:
                    for held in (page.nodes, page.texts, page.links, page.full):
                        del held[start:]
                    del self.chars[start + 1 :], self.linked[start + 1 :]

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            if tag in BLOCK:
                self.flush()
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.close(k)
        elif tag in BLOCK and not (self.stack and self.stack[-1][2]):
            self.flush()

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.add(" ")
            return
        if tag in BLOCK:
            self.flush()
            if self.block_at and tag in CLOSES_P:
                # an open paragraph ends here, and the inline tags left open in it
                if self.stack[self.block_at[-1]][0] == "p":
                    self.close(self.block_at[-1])
            elif tag in ENDS:
                n = len(self.block_at) - 1
                while n >= 0 and self.stack[self.block_at[n]][0] == "p":
                    n -= 1
                if n >= 0 and self.stack[self.block_at[n]][0] in ENDS[tag]:
                    self.close(self.block_at[n])
        if tag in VOID:
            return
        bad, named, classes = _noisy(tag, attrs, bool(self.open.get("article") or self.open.get("main")))
        if attrs.endswith("/") and tag not in BLOCK:
            return
        node, dropped = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, False)
        if tag in CONTAINER:
            label = f"{tag}.{classes}" if classes else tag
            if (node, label) not in self.children:
                self.children[node, label] = len(self.page.parents)
                self.page.parents.append(node)
                self.page.labels.append(label)
            node = self.children[node, label]
        if tag in BLOCK:
            self.block_at.append(len(self.stack))
            self.kind = tag
        self.stack.append((tag, node, bad or dropped, len(self.page.texts) if named else -1))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.named += named


def blocks(page: str | None) -> Page:
    """The blocks of a page; boilerplate left out. Unclosed tags stay open until an ancestor closes; a stray end tag is skipped."""
    parser = _Parser()
    for what, name, attrs in Scanner(page or "").pieces():
        if not what:
            parser.add(name)
        elif what == "open":
            parser.start(name, attrs)
        else:
            parser.end(name)
    parser.flush()
    parser.close(0)
    return parser.page


def _best(page: Page) -> tuple[int, float]:
    """The container with the most paragraph text of its own, widened, and its score; (-1, 0) for none.

    A block counts whole for its nearest container and half for the one above.
    """
    scores: dict[int, float] = {}
    for k, node in enumerate(page.nodes):
        if node > 0:
            weight = page.weight(k)
            scores[node] = scores.get(node, 0.0) + weight
            if page.parents[node] > 0:
                scores[page.parents[node]] = scores.get(page.parents[node], 0.0) + weight / 2
    if not scores:
        return -1, 0.0
    node = max(scores, key=scores.__getitem__)  # the first of equals
    return (_widened(page, node) if scores[node] > 0 else node), scores[node]


def best_container(page: Page) -> tuple[str, float]:
    """Its path and score; ('', 0) for none."""
    node, score = _best(page)
    return (page.path(node) if node > 0 else ""), score


def _widened(page: Page, node: int) -> int:
    """The outermost article or main around ``node``, else its farthest ancestor below the body, as long as each step adds a block that is not mostly links."""
    chain = page.chain(node)
    depth = {n: k for k, n in enumerate(chain, 1)}
    # the depth at which each node leaves the chain, and what hangs there
    leaves = [0] * len(page.parents)
    for n in range(1, len(page.parents)):
        leaves[n] = depth.get(n, leaves[page.parents[n]])
    some, text = [False] * (len(chain) + 1), [False] * (len(chain) + 1)
    for k, n in enumerate(page.nodes):
        some[leaves[n]] = True
        text[leaves[n]] |= len(page.texts[k]) > 2 * page.links[k]
    plain = [page.labels[n].split(".")[0] for n in chain]
    tops = [k for k, t in enumerate(plain, 1) if t in ("article", "main")]
    steps = [k for k in tops[::-1] if k < len(chain)] if tops else [k for k in range(len(chain) - 1, 0, -1) if plain[k - 1] != "body"]
    held = seen = len(chain)
    any_text = any_block = False
    for k in steps:
        any_text, any_block = any_text or any(text[k:seen]), any_block or any(some[k:seen])
        seen = k
        if any_text:
            held, any_text, any_block = k, False, False
        elif any_block:
            break
    return chain[held - 1]


def chosen(page: Page, winner: str | None) -> list[int]:
    """The blocks to keep: those under the winner where it holds the page's own best container or near as much; else under
    the page's own, the wider of both if one holds the other."""
    own, score = _best(page)
    at = page.node_of(winner) if winner else -1
    mine = page.below(at) if at > 0 else []
    if not mine or score <= 0:
        return mine if mine else page.below(own) if own > 0 else []
    if own == at or own in page.chain(at):
        return page.below(own)
    under = page.below(own)
    if at in page.chain(own) or sum(map(page.weight, mine)) >= NEAR * sum(map(page.weight, under)):
        return mine
    return under


def text_of(page: Page, winner: str | None) -> str:
    kept = [page.texts[k] for k in chosen(page, winner)] or page.texts
    return "\n".join(kept)


def extract(page: str | None, winner: str | None) -> str:
    return text_of(blocks(page), winner)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


#: Winning paths go to every task up to this many hosts; beyond, pages are joined to them by host.
BROADCAST_HOSTS = 50_000
_PARSED = [("_path", T.StringType()), ("_score", T.DoubleType()), ("_parents", T.ArrayType(T.IntegerType())), ("_labels", T.ArrayType(T.StringType())), ("_nodes", T.ArrayType(T.IntegerType())), ("_texts", T.ArrayType(T.StringType())), ("_links", T.ArrayType(T.IntegerType())), ("_full", T.ArrayType(T.BooleanType()))]
_PARTS = ("parents", "labels", "nodes", "texts", "links", "full")


def parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, _host, and of the one parse of each page its vote (_path, _score) and its blocks; staged."""
    source = pages.select(*keep, host_of(F.col("url")).alias("_host"), F.col("html").alias("_html"))
    n = len(keep) + 1
    schema = T.StructType(source.schema.fields[:n] + [T.StructField(name, kind) for name, kind in _PARSED])
    kinds = [pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 128) for k in range(0, whole.num_rows, 128)):
                out: list[list] = [[] for _ in _PARSED]
                for page in map(blocks, batch.column(n).to_pylist()):
                    for col, v in zip(out, (*best_container(page), *(getattr(page, p) for p in _PARTS)), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(batch.columns[:n] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=schema.names)

    return staged(source.mapInArrow(run, schema), "parsed-pages")


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes (pages), score: summed in Spark over the parsed pages."""
    return pages.where("_score > 0").groupBy(F.col("_host").alias("host"), F.col("_path").alias("path")).agg(F.count("*").alias("votes"), F.sum("_score").alias("score"))


def winners(pages: DataFrame) -> DataFrame:
    """host, path of parsed pages: most votes, then score, then path."""
    best = F.max(F.struct("votes", F.round("score").alias("score"), "path")).path
    return votes(pages).groupBy("host").agg(best.alias("path"))


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, text and n_chars of every row; ``keep`` must not name an added column.

    Null pages and pages of no text give ''. A null url is of the host ''.
    Repeated rows are pages of their own. Ties of votes go by score, then path;
    of equal containers the one whose text comes first is taken. A page of any length is
    one row, parsed in time and memory in proportion to it.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("keep names a column that is added")
    each = parsed(pages, keep)
    paths = staged(winners(each).select(F.col("host").alias("_host"), F.col("path").alias("_winner")), "host-paths")
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    own = [f"_{p}" for p in _PARTS]
    source = each.join(paths, "_host", "left").select(*keep, "_winner", *own)
    schema = T.StructType(source.schema.fields[: len(keep)] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                rows = zip(*(batch.column(n + k).to_pylist() for k in range(1 + len(own))), strict=True)
                texts = [text_of(Page(*parts), winner) for winner, *parts in rows]
                yield pa.RecordBatch.from_arrays(batch.columns[:n] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"), ["page_id", "url"])
