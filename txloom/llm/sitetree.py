"""Main text of web pages by site style trees.

The element trees of all pages of a host are merged into one: elements with the same
chain of labels (tag, classes, id) from the root are one node.  A node has the number of
pages that show it, their presentations (sequences of child labels) and the content below
it (texts of blocks, link targets).  Its importance is

    (1 - GAMMA**s) * presentation + GAMMA**s * content,    s its number of presentations,

where presentation is the entropy of its presentations over the pages, to base pages, and
content is one less the mean entropy of its contents over the pages; what all pages repeat
has importance 0, what each page says anew 1.  This is multiplied by what an element says
of itself: 0 for navigation, adverts, forms, comments and the like, and for what stands
outside the article where a page marks one; the blocks of a marked article, or of the
container with over half of a page's text, are never below 1 unless they are mostly links.
Branches below THRESHOLD are cut out of each page; nodes on fewer than SUPPORT different
pages are judged by what they say of themselves alone.

Pages are parsed once and stored as arrays of node numbers; counting, entropies and the
extraction are DataFrame expressions.  Equal pages of a host count once.  Joins of pages
to cut nodes are split by the number of pages that a node has, so a host of any size works.

Defined results: a null or empty html, and a page of noise only, have the empty text; a null
or unreadable url belongs to the host of no name; rows are told apart by number, so null and
repeated ids and equal pages all keep a row each.  Elements nested deeper than DEPTH count
as their ancestor there.  Extra columns do not count; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, drop_scratch, join_hot, materialize

GAMMA, THRESHOLD, SUPPORT, DEPTH = 0.9, 0.3, 3, 32
#: Cut nodes of all sites that are broadcast (16 bytes each).
LOW_NODES = 200_000

# Element names of the HTML standard and usual words of class names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes noscript xmp template svg".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NOISE_TAGS = set("head nav footer aside form button select option datalist dialog menu audio video canvas object fieldset legend label rp search".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus "
    "breadcrumb breadcrumbs toolbar pagination pager masthead footer sidebar aside widget widgets related recommended recommendations recommend cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login signin share sharing social comment comments commentlist reply replies disqus respond discussion form search skip copyright legal disclaimer paywall topbar".split()
)
HEAD_WORDS, MAIN_WORDS = {"header", "head", "top"}, set("article content entry main post story text".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog note".split())
NOT_WORDS = {"has", "with", "no", "without"}
#: What a start tag closes, and what it does not look behind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})} | {
    t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")
}
SCOPE = {"td", "th", "table", "caption", "button", "object", "html"}

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]{0,65536}+"|'[^']{0,65536}+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOST = re.compile(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def number(text: str, *before: int) -> int:
    """A 64-bit number of a text and of numbers before it."""
    return int.from_bytes(hashlib.blake2b("\x00".join([*map(str, before), text]).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def words(name: str) -> list[str]:
    """The words of a class or id; those behind ``has`` or ``with`` do not count."""
    found = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1-\2", name).lower())
    return [w for k, w in enumerate(found) if not NOT_WORDS.intersection(found[:k])]


class Page:
    """Elements and text blocks of a page.

    Node ``i`` has ``parent[i] < i``, a label and what it says of itself; inline elements
    belong to the node around them unless they call themselves noise.
    """

    def __init__(self, html: str):
        self.parent, self.tags, self.labels, self.noise, self.article, self.main = [-1], [""], [""], [0], [False], [False]
        self.children: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.links: list[tuple[int, str]] = []
        self._open: list[tuple[str, int, bool]] = [("", 0, True)]
        self._text: dict[int, list[tuple[str, bool]]] = {}
        self._anchors = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at = 0
        while m := _MARKUP.search(html, at):
            self._say(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
            else:
                attributes = {k.lower(): references.unescape(a or b or c or "") for k, a, b, c in reversed(_ATTRIBUTE.findall(m[3] or m[6] or ""))}
                self._start(tag, attributes)
                if tag in RAW:
                    behind = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                    at = behind.start() if behind else len(html)
                    self._end(tag)
        self._say(html[at:])
        self._flush()

    def _say(self, text: str) -> None:
        if text:
            node = self._open[-1][1]
            self._text.setdefault(node, []).append((references.unescape(text), self._anchors > 0))

    def _flush(self) -> None:
        for node, pieces in self._text.items():
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                self.blocks.append((node, text, min(len(text), sum(len("".join(t.split())) for t, linked in pieces if linked))))
                self.children[node].append("#")
        self._text = {}

    def _pop(self, k: int) -> None:
        for tag, _, block in reversed(self._open[k:]):
            if tag == "a":
                self._anchors -= 1
        del self._open[k:]

    def _find(self, tags: set[str], until: set[str]) -> int:
        """Place of the innermost open element of ``tags`` before any of ``until``; 0 if none."""
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] in tags:
                return k
            if self._open[k][0] in until:
                return 0
        return 0

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("br", "wbr"):
            return self._say(" " if tag == "br" else "")
        if tag == "img" or tag in INLINE:
            noise = self._noise(tag, attributes)
            node = self._open[-1][1]
            if tag == "a":
                self.links.append((node, attributes.get("href", "")))
                self._anchors += 1
            if tag not in VOID:
                self._open.append((tag, self._node(tag, attributes, noise) if noise else node, False))
            return None
        self._flush()
        if k := self._find({"p"}, SCOPE):
            self._pop(k)
        if tag in CLOSES and (k := self._find(*CLOSES[tag])):
            self._pop(k)
        node = self._node(tag, attributes, self._noise(tag, attributes))
        if tag not in VOID:
            self._open.append((tag, node, True))
        return None

    def _end(self, tag: str) -> None:
        if tag in ("body", "html", ""):
            return
        if tag not in INLINE:
            self._flush()
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                return self._pop(k)
            if tag in INLINE and self._open[k][2]:
                return None

    def _node(self, tag: str, attributes: dict[str, str], noise: int) -> int:
        up = self._open[-1][1]
        names = sorted({re.sub("[0-9]+", "", c) for c in attributes.get("class", "").split()[:8]})
        label = f"{tag}.{'.'.join(names)}#{re.sub('[0-9]+', '', attributes.get('id', ''))}"
        if not self.children[up] or self.children[up][-1] != label:
            self.children[up].append(label)
        self.parent.append(up)
        self.tags.append(tag)
        self.labels.append(label)
        self.noise.append(noise)
        self.article.append(tag == "article" or attributes.get("itemprop", "") == "articleBody")
        self.main.append(tag == "main" or attributes.get("role", "") == "main")
        self.children.append([])
        return len(self.parent) - 1

    @staticmethod
    def _noise(tag: str, attributes: dict[str, str]) -> int:
        """2 for what is noise by its element, 1 by its words, 0 otherwise."""
        if tag in NOISE_TAGS or tag in RAW or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
            return 2
        if attributes.get("role", "").lower() in NOISE_ROLES:
            return 2
        if tag in ("html", "body", "main"):
            return 0
        for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
            found = set(words(name))
            if found & NOISE_WORDS or (found & HEAD_WORDS and not found & MAIN_WORDS):
                return 1
        return 0


def judged(page: Page) -> tuple[list[tuple], list[dict]]:
    """A page for its site's tree: nodes (path, line, style) with contents, and its blocks that may stay.

    A block that nothing but noise speaks against has the paths of its line; one that
    is protected has none.
    """
    n = len(page.parent)
    own, linked = [0] * n, [0] * n
    for node, text, in_links in page.blocks:
        own[node] += len(text)
        linked[node] += in_links
    below, below_linked = own[:], linked[:]
    holds = [a or m for a, m in zip(page.article, page.main)]
    for i in range(n - 1, 0, -1):
        below[page.parent[i]] += below[i]
        below_linked[page.parent[i]] += below_linked[i]
        holds[page.parent[i]] = holds[page.parent[i]] or holds[i]
    noise, paths, lines, depth = [False] * n, [0] * n, [[]] * n, [0] * n
    for i in range(1, n):
        up = page.parent[i]
        wraps = page.noise[i] == 1 and holds[i] and not page.article[i] and 2 * below[i] > below[0]
        noise[i] = noise[up] or (page.noise[i] > 0 and not wraps)
        depth[i] = depth[up] + 1
        paths[i], lines[i] = (number(page.labels[i], paths[up]), None) if depth[i] <= DEPTH else (paths[up], lines[up])
        if lines[i] is None:
            lines[i] = [*lines[up], paths[i]]
    roots = [i for i in range(1, n) if page.article[i] and not noise[i] and below[i]] or [i for i in range(1, n) if page.main[i] and not noise[i] and below[i]]
    safe = set(roots)
    if not roots:  # the container whose own blocks and paragraphs have over half of the text that is no noise
        held = [0] * n
        for node, text, in_links in page.blocks:
            if not noise[node]:
                held[page.parent[node] if page.tags[node] in ("p", "pre", "blockquote") else node] += len(text) - in_links
        safe = {i for i in range(1, n) if 2 * held[i] > sum(held)}
    inside, mostly_links = [False] * n, [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or i in safe
        header = page.tags[i] == "header" and not inside[i]
        noise[i] = noise[i] or noise[page.parent[i]] or header
        mostly_links[i] = inside[i] and i not in safe and (mostly_links[page.parent[i]] or 2 * below_linked[i] > below[i])
    kept = []
    for node, text, _ in page.blocks:
        if not noise[node] and (inside[node] or not roots):
            kept.append({"line": [] if inside[node] and not mostly_links[node] else lines[node], "text": text})
    tree: dict[int, tuple[list[int], list[str], set[int]]] = {}
    for i in range(1, n):
        tree.setdefault(paths[i], (lines[i], [], set()))[1].append(",".join(page.children[i]))
    for node, text, _ in page.blocks:
        if node:
            tree[paths[node]][2].add(number(text.lower()))
    for node, target in page.links:
        if node:
            tree[paths[node]][2].add(number(target, 1))
    return [(path, line, number(";".join(dict.fromkeys(styles))), sorted(contents)) for path, (line, styles, contents) in tree.items()], kept


def host(url: str | None) -> str:
    """The host of a url in lower case; empty if it has none."""
    return m[1].lower() if (m := _HOST.match(url or "")) else ""


def parsed(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Stored: ``row, page_id, url, host, same`` (a number of the page's whole tree), ``nodes`` and ``blocks``."""
    rows = document_rows(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url"), F.col("html").cast("string").alias("html"))
    longs = T.ArrayType(T.LongType())
    node = T.StructType([T.StructField("path", T.LongType()), T.StructField("line", longs), T.StructField("style", T.LongType()), T.StructField("contents", longs)])
    block = T.StructType([T.StructField("line", longs), T.StructField("text", T.StringType())])
    out = T.StructType(
        [T.StructField("row", T.LongType()), *[T.StructField(c, rows.schema[c].dataType) for c in ("page_id", "url")], T.StructField("host", T.StringType()), T.StructField("same", T.LongType())]
        + [T.StructField("nodes", T.ArrayType(node)), T.StructField("blocks", T.ArrayType(block))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for url, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                nodes, blocks = judged(Page(html or ""))
                found = [dict(zip(("path", "line", "style", "contents"), x)) for x in nodes]
                for c, v in zip(columns, (host(None if url is None else str(url)), number(repr(nodes)), found, blocks)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, schema.field(i + 3).type) for i, c in enumerate(columns)]], schema=schema)

    return materialize(rows.mapInArrow(run, out), "parsed-pages")


def site_nodes(stored: DataFrame) -> DataFrame:
    """Stored: pages, presentations and contents of every node of every site's tree."""
    pages = stored.groupBy("host", "same").agg(F.first("nodes").alias("nodes"))
    nodes = pages.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    shown = F.array(F.struct(F.lit(True).alias("style"), F.col("style").alias("value")))
    said = F.transform("contents", lambda c: F.struct(F.lit(False).alias("style"), c.alias("value")))
    values = nodes.select("host", "path", "line", F.explode(F.concat(shown, said)).alias("v")).groupBy("host", "path", "v.style", "v.value").agg(F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    own = values.groupBy("host", "path").agg(
        F.first("line").alias("line"),
        F.sum(F.when(F.col("style"), F.col("n")).otherwise(0)).alias("pages"),
        F.sum(F.when(F.col("style"), 1).otherwise(0)).alias("styles"),
        F.sum(F.when(F.col("style"), F.col("n") * F.log("n")).otherwise(0.0)).alias("n_log_n"),
        F.sum(F.when(~F.col("style"), 1).otherwise(0)).alias("contents"),
        F.sum(F.when(~F.col("style"), F.log("n")).otherwise(0.0)).alias("logs"),
    )
    return materialize(own, "site-nodes")


def importance(own: DataFrame) -> DataFrame:
    """``host, path, pages, importance`` of every node of every site's tree."""
    below = own.select("host", F.explode("line").alias("path"), "contents", "logs").groupBy("host", "path").agg(F.sum("contents").alias("all_contents"), F.sum("logs").alias("all_logs"))
    base = F.log(F.greatest("pages", F.lit(2)))
    presentation = (F.log("pages") - F.col("n_log_n") / F.col("pages")) / base
    content = F.when(F.col("all_contents") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("all_logs") / F.col("all_contents") / base))
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    found = own.drop("line", "contents", "logs").join(below, ["host", "path"])
    return found.select("host", "path", "pages", F.when(F.col("pages") < 2, 1.0).otherwise((1 - weight) * presentation + weight * content).alias("importance"))


def cut_lines(stored: DataFrame, low: DataFrame, most: int = LOW_NODES) -> DataFrame:
    """The stored pages with ``cut``, the paths of their site that go; null or empty if none.

    Up to ``most`` nodes of all sites are broadcast, a row a host, and no page is shuffled;
    more are joined to each page's own paths, hot nodes split by their pages.
    """
    if low.limit(most + 1).count() <= most:
        return stored.join(F.broadcast(low.groupBy("host").agg(F.collect_set("path").alias("cut"))), "host", "left")
    lines = stored.select("row", "host", F.explode(F.array_distinct(F.flatten("blocks.line"))).alias("path"))
    cut = join_hot(lines, low, ["host", "path"], "pages", stored.count(), F.col("row"), how="inner").groupBy("row").agg(F.collect_set("path").alias("cut"))  # of one page
    return stored.join(cut, "row", "left")


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    stored = parsed(pages, html_col, url_col, id_col)
    sites = site_nodes(stored)
    low = materialize(importance(sites).filter((F.col("pages") >= SUPPORT) & (F.col("importance") < THRESHOLD)), "low-nodes")
    drop_scratch(sites)
    left = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["line"], F.col("cut")), F.lit(False)))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n")
    whole = cut_lines(stored.select("row", "page_id", "url", "host", "blocks"), low)
    return whole.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
