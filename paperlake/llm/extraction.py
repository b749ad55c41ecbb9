"""HTML extraction by site style trees.

The DOMs of a host's pages are merged: nodes with the same path of tags and classes are one style
node. Its presentation (the sequences of its children) and its content are spread over the host's
distinct pages with some entropy; a node of low entropy in both looks alike everywhere and is of
low importance. Each page's text is that of its outermost articles (or of its body if it has none)
without branches of low importance (in an article not its headings, and no words inside a block
but spans), and without menus, headers, footers, asides, forms, adverts and comments. These are
known by tag, or by a class or id: within an article by words that no part of an article bears
(`FOREIGN`). The other words name articles' own sections, too; they only tell that a generic branch
without paragraphs, headings or tables is foreign, and of the rest the importance decides. Where
an article as a whole is of low importance (its host's pages repeat it) importance tells nothing
about its parts, and they stay.

Character references are decoded, white space inside a block becomes one blank, blocks are joined
by line feeds. Defined cases: a null or empty page has an empty text; a null URL or one without
host belongs to the host ''; pages with the same content count once in their host's tree, and
hosts of fewer than `PAGES` distinct pages have no branch of low importance; markup that is cut
off or not closed is closed at the end; repeated rows give repeated rows; further columns are
ignored; an empty table gives no rows.
"""

import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

from . import urls

PAGES = 8
MOST_PATHS = 500_000
"""Style nodes of low importance that are sent to all tasks (some 20 MB)."""
LOW = 0.2
"""Style nodes below this importance are removed."""
PRESENTATION = 0.3
"""The share of presentation in a node's importance; the rest is content."""

# HTML's tags by kind, and words in classes and ids of what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = set(
    "nav header footer aside form script style noscript template iframe svg button select dialog "
    "head title textarea object menu".split()
)
FOREIGN = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent "
    "gdpr sidebar navbar nav navigation breadcrumb breadcrumbs comments replies disqus newsletter "
    "subscribe popup modal pagination pager toolbar".split()
)
DROPPED_WORDS = FOREIGN | set(
    "promotion banner notice alert menu footer header masthead comment reply discussion share "
    "sharing social related recommended subscription widget search login signup".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GENERIC = {"div", "span", "ul", "ol", "dl"}
"""Tags that say nothing of what they hold."""
CONTENT = HEADINGS | set("p table pre blockquote figure section article".split())
"""Tags of an article's own parts."""
# A start tag of the key closes an open one of these tags, not beyond the boundary.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_KEEPS_P = {"button", "td", "th", "table", "object", "article", "section", "div", "body", "main"}
_ROOTS = {"article", "main"}
_UNNAMED = {"html", "body", "article", "main"}
_WORDS = re.compile("[A-Za-z]+")


class Page(HTMLParser):
    """A page as parallel lists of nodes in order (parents first) and a list of events: texts with
    their node, and None where a block begins or ends."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.words, self.paths = ["#"], [0], [frozenset()], [0]
        self.children = [[]]
        self.events: list[tuple[int, str] | None] = []
        self.stack = [0]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        elif tag in BLOCKS:
            self._close({"p"}, _KEEPS_P)
        words = frozenset(
            word.lower()
            for name, value in attrs
            if name in ("class", "id") and value
            for word in _WORDS.findall(value)
        )
        label = f"{tag}.{'.'.join(sorted(words))}"
        parent = self.stack[-1]
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.words.append(words)
        self.paths.append(xxhash.xxh64_intdigest(f"{self.paths[parent]}>{label}"))
        self.children.append([])
        self.children[parent].append(label)
        if tag in BLOCKS:
            self.events.append(None)
        elif tag == "br":
            self.events.append((parent, " "))
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag}, {"article", "main"} - {tag} if tag not in BLOCKS else set())

    def _close(self, tags, boundary):
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[at]]
            if tag in tags:
                if any(self.tags[node] in BLOCKS for node in self.stack[at:]):
                    self.events.append(None)
                del self.stack[at:]
                return
            if tag in boundary:
                return

    def handle_data(self, data):
        self.events.append((self.stack[-1], data))

    def named(self, node: int, bare: bool, content: list[bool]) -> bool:
        """Whether the node's tag, class or id tells that it is not part of an article; `bare`
        if the page has none, `content` tells which nodes hold an article's own parts."""
        tag = self.tags[node]
        if tag in DROPPED:
            return True
        if tag in _UNNAMED:
            return False
        decisive = bare or (tag in GENERIC and not content[node])
        return not self.words[node].isdisjoint(DROPPED_WORDS if decisive else FOREIGN)

    def kept(self, low=frozenset()) -> list[bool]:
        """Which nodes' own texts belong to the article; `low` has paths of low importance."""
        count = len(self.tags)
        comment = [False] * count
        root = [False] * count
        for node in range(1, count):
            parent = self.parents[node]
            comment[node] = comment[parent] or not self.words[node].isdisjoint(
                {"comment", "comments", "replies", "discussion", "related", "recommended"}
            )
            root[node] = self.tags[node] in _ROOTS and not comment[node]
        if any(root[n] and self.tags[n] == "article" for n in range(count)):
            root = [r and self.tags[n] == "article" for n, r in enumerate(root)]
        bare = not any(root)
        content = [tag in CONTENT for tag in self.tags]
        for node in range(count - 1, 0, -1):
            content[self.parents[node]] |= content[node]
        inside = [bare] + [False] * (count - 1)
        telling = [True] * count
        dropped = [False] * count
        for node in range(1, count):
            parent, tag = self.parents[node], self.tags[node]
            if root[node] and not inside[parent]:
                inside[node] = True
                telling[node] = self.paths[node] not in low
                continue
            inside[node], telling[node] = inside[parent], telling[parent]
            if not inside[node]:
                continue
            again = not bare and tag in _ROOTS
            branch = bare or tag == "span" or (tag in BLOCKS and tag not in HEADINGS)
            alike = branch and tag not in _UNNAMED and telling[node] and self.paths[node] in low
            dropped[node] = dropped[parent] or again or alike or self.named(node, bare, content)
            if tag in HEADINGS and self.tags[parent] == "header" and not bare:
                # The headings of an article's own header are part of it.
                dropped[node] = dropped[self.parents[parent]]
        return [i and not d for i, d in zip(inside, dropped, strict=True)]

    def text(self, low=frozenset()) -> str:
        kept = self.kept(low)
        blocks, block = [], []
        for event in [*self.events, None]:
            if event is None:
                words = "".join(block).split()
                if words:
                    blocks.append(" ".join(words))
                block = []
            elif kept[event[0]]:
                block.append(event[1])
        return "\n".join(blocks)

    def styles(self) -> dict[int, tuple[int, int]]:
        """By path: the hash of its nodes' child sequences and the hash of their texts."""
        parts: dict[int, list] = {}
        for node in range(1, len(self.tags)):
            if self.tags[node] not in ("html", "head", "script", "style", "meta", "title"):
                parts.setdefault(self.paths[node], [[], []])[0].append(
                    " ".join(self.children[node])
                )
        for event in self.events:
            if event is not None and event[1].strip():
                node = event[0]
                while node:
                    if self.paths[node] in parts:
                        parts[self.paths[node]][1].append(event[1])
                    node = self.parents[node]
        return {
            path: tuple(xxhash.xxh64_intdigest("\n".join(x)) for x in both)
            for path, both in parts.items()
        }


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _styled(batches):
    for batch in batches:
        rows = [], [], [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            styles = Page(html or "").styles()
            whole = xxhash.xxh64_intdigest(str(sorted(styles.items())))
            for path, (style, content) in styles.items():
                values = host, *map(_signed, (path, whole, style, content))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.string()), *(pa.array(c, pa.int64()) for c in rows[1:])],
            names=["host", "path", "page", "style", "content"],
        )


_STYLED = "host string, path long, page long, style long, content long"


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the merged trees' nodes, from rows (host, html).

    The importance is a mean of the entropies of presentation and content over a host's distinct
    pages, each as a share of the most possible. Counts are pre-aggregated, so a host with a third
    of all pages is spread by its paths, styles and contents.
    """
    node = ["host", "path"]
    rows = pages.select("host", "html").mapInArrow(_styled, _STYLED).distinct()

    def spread(column):
        counted = rows.groupBy(*node, column).agg(F.count(F.lit(1)).alias("n"))
        total = F.sum("n")
        entropy = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
        return counted.groupBy(*node).agg(
            total.alias(f"{column}_pages"), F.coalesce(F.try_divide(entropy, F.log(total)), F.lit(1.0)).alias(column)
        )

    both = spread("style").join(spread("content"), node)
    mixed = PRESENTATION * F.col("style") + (1 - PRESENTATION) * F.col("content")
    return both.select(
        *node,
        F.col("style_pages").alias("pages"),
        mixed.alias("importance"),
    )


def _extracted(batches):
    for batch in batches:
        htmls, lows = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts = [
            Page(html or "").text({x & (2**64 - 1) for x in low or ()})
            for html, low in zip(htmls, lows, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url and text.

    The pages are read twice: for their hosts' trees, and for their texts. The branches of low
    importance go to all tasks if they are few, else they are joined by host.
    """
    host, _ = urls.host_and_path()
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    marked = cut(
        importance(rows)
        .where((F.col("pages") >= PAGES) & (F.col("importance") < LOW))
        .select("host", "path"),
        "unimportant",
    )
    low = marked.groupBy("host").agg(F.collect_set("path").alias("low"))
    if marked.count() <= MOST_PATHS:
        low = F.broadcast(low)
    shape = pages.select("page_id", "url").schema.add("text", "string")
    return rows.join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(
        _extracted, shape
    )
