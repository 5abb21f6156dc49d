"""Operator 7: main text of web pages by nearest-URL page differencing.

A page is cut into lines, one per block, with the container each stands in. Containers whose
tag, class, id or role names a menu, header, footer, sidebar, notice, advert,
form or reader comments are left out, as are head, scripts, styles and markup comments.
A class, id or role counts as a whole name ("cookie-notice", not "related-work"), and an article inside such a container is read.

All pages are differenced: within a host, pages are ordered by URL path, each is paired with whichever neighbour shares the longer path prefix, the lines of
both (as 64-bit hashes) are aligned by longest common subsequence, and shared lines are deleted. A neighbour whose lines and text are mostly
the same is a copy and says nothing about furniture: the other neighbour decides, and between two copies a page
loses the lines that were deleted from other pages of its host, so copies alone on a host stay whole.

Where a page marks its article (``article`` or ``main``), a check follows: lines outside of it go, and of the deleted lines those come back that the markup shows to be
the article's, as articles do share lines (see README). Deleted for good are whole boxes: a div, section or list of the article with a class, id or role, all of
whose lines the neighbour has in a box of the same name; but no h1, and never all of an article. If the article is empty, so is the text.

Pages are paired through a global order, not by gathering a host in a task: a host with a third
of all pages is spread like the rest. What is ordered and paired are hashes and lengths of lines; pages are parsed once for these and once for the text. Null or empty html gives the empty text. Equal rows are one page for
differencing and stay separate rows; a null URL has the empty host; pages with one URL are ordered by id. Very long pages are read in one pass. A tag that is
never closed ends with the page, an unclosed svg or button is ignored, quotes count only after an equals sign. Other columns are ignored,
an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored
from .url_filter import host_of, path_of

# Names of HTML elements by role, and words that mark page furniture in class, id and role.
RAW = "script|style|textarea|title"  # text up to the closing tag or the end of the page
DROPPED = "noscript|template|iframe|svg|select|button|object|canvas"  # left out with their content, if they are closed
FURNITURE = {"nav", "footer", "aside", "form", "dialog", "menu", "head"}
MAIN = {"article", "main"}
BOXES = {"div", "section", "ul", "ol", "fieldset", "center"}
CONTAINERS = FURNITURE | MAIN | {"header", "div", "section", "ul", "ol", "dl", "table", "figure", "details", "fieldset", "center", "span"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "picture", "source", "link", "meta"}
INLINE |= {"math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mstyle", "mpadded", "mfenced", "mtable", "mtr", "mtd", "semantics", "annotation"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "teaser", "teasers", "comment", "comments", "disqus", "replies", "footer", "masthead", "toolbar", "pagination", "pager", "skip", "search", "complementary", "contentinfo", "hidden"}

# Words that such a name may have before and after those: "site-footer", "ad-box".
BEFORE = {"site", "page", "main", "post", "entry", "article", "global", "top", "bottom", "left", "right", "primary", "secondary", "mobile", "desktop", "user", "reader", "js", "wp", "block"}
AFTER = {"box", "bar", "list", "wrapper", "wrap", "container", "area", "section", "block", "widget", "panel", "form", "inner", "outer", "unit", "slot", "group", "row", "item", "items", "link", "links", "button", "buttons", "icons", "posts", "articles", "stories", "primary", "secondary", "top", "bottom", "left", "right", "main"}

# Attributes up to the end of a tag: quotes count after an equals sign only. Nothing is tried twice, so time is linear.
_ATTRS = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<svg\b(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>/]|/(?!>))*+/>|<({RAW})\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<({DROPPED})\b{_ATTRS}>(?:(?!</?\2\b).)*+</\2\s*>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRS})>", re.S | re.I)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SALTS = 16
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _named(attrs: str) -> bool:
    """Whether one of the names in class, id and role is, as a whole, that of page furniture."""
    for name in " ".join(a or b or c for a, b, c in _MARK.findall(attrs)).split():
        w = [x for x in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x and not x.isdigit()]
        while w and w[0] in BEFORE:
            w = w[1:]
        while w and w[-1] in AFTER:
            w = w[:-1]
        if w and WORDS.issuperset(w):
            return True
    return False


def _furniture(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in FURNITURE:
        return True
    if tag == "header":
        return not in_main  # an article's own header has its title
    if tag in MAIN or not attrs:
        return False
    if _HIDDEN.search(attrs):
        return True
    return _named(attrs)


def page_lines(page: str) -> tuple[list[str], list[str]]:
    """(lines of marked articles, other lines), page furniture left out."""
    return parse(page)[:2]


def parse(page: str) -> tuple[list[str], list[str], bool]:
    """(lines of marked articles, other lines, whether the page marks an article, be it empty), page furniture left out."""
    lines, marked = placed_lines(page)
    return [x.text for x in lines if x.inside], [x.text for x in lines if not x.inside], marked


class Line(NamedTuple):
    text: str
    inside: bool  # of a marked article
    boxes: tuple[int, ...]  # the article's named boxes around it, outermost first
    name: str  # of the last of these

    def mark(self) -> int:
        """64 bits, signed: of the line, and of its box if it has one."""
        line = f"{self.name}\n{self.text}" if self.boxes else self.text
        return (xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) ^ 1 << 63) - (1 << 63)


def placed_lines(page: str) -> tuple[list[Line], bool]:
    """(lines in page order, whether the page marks an article), page furniture left out."""
    lines, piece, marked = [], [], False
    stack: list[tuple[str, int, bool, tuple, str]] = []  # tag, skip outside of it, whether it marks an article, named boxes outside of it
    skip = main = named = boxes_seen = 0
    boxes, name, title = (), "", False

    def close_block():
        if piece:
            line = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if line:
                lines.append(Line(line, main > 0, () if title else boxes, "" if title else name))

    at = 0
    for m in _TOKEN.finditer(page):
        if not skip and m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        if not m[4]:
            continue
        tag, closing, attrs = m[4].lower(), m[3], m[5]
        if tag not in INLINE:
            close_block()
            title = tag == "h1" and not closing
            skip -= named  # a paragraph or list item named as furniture ends at the next block
            named = 0
        elif tag == "br":
            piece.append(" ")
        if tag not in CONTAINERS and tag not in INLINE and not closing and attrs and _furniture(tag, attrs, main > 0):
            skip, named = skip + 1, 1
        if tag not in CONTAINERS or attrs.endswith("/") and tag not in MAIN:
            continue
        if not closing:
            bad = _furniture(tag, attrs, main > 0) or (tag == "article" and _named(attrs))  # a teaser, a reader's comment
            if bad:
                close_block()
            stack.append((tag, skip, tag in MAIN, boxes, name))
            mark = " ".join(a or b or c for a, b, c in _MARK.findall(attrs)) if main and tag in BOXES else ""
            if mark:
                boxes_seen += 1
                boxes, name = (*boxes, boxes_seen), _DIGITS.sub("", f"{tag} {mark}")
            # an outermost article is read wherever it stands, unless named as furniture itself (a reader's comment)
            skip = 0 if tag in MAIN and not main and not _named(attrs) else skip + bad
            marked = marked or tag in MAIN and not skip
            main += tag in MAIN
        elif any(x[0] == tag for x in stack):
            while True:
                opened, outer, is_main, *around = stack.pop()
                if skip != outer or is_main:
                    close_block()
                skip, main, (boxes, name) = outer, main - is_main, around
                if opened == tag:
                    break
    if not skip and at < len(page):
        piece.append(page[at:])
    close_block()
    return lines, marked


def kept_lines(lines: list[Line], marked: bool, shared: set[int]) -> list[str]:
    """The text of a page whose lines at ``shared`` were deleted by differencing: on a page that marks its article, its lines less the boxes that are shared whole."""
    if not marked:
        return [x.text for i, x in enumerate(lines) if i not in shared]
    own = {b for i, x in enumerate(lines) if i not in shared for b in x.boxes}
    article = [x for x in lines if x.inside]
    return [x.text for x in article if not x.boxes or x.boxes[-1] in own] or [x.text for x in article]


def common_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (increasing chains of matches)."""
    where: dict[object, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []  # smallest end in b of a chain of each length
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            elif j < tails[k]:
                tails[k], nodes[k] = j, node
    out, node = set(), nodes[-1] if nodes else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def is_copy(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> bool:
    """Lines as (mark, length). Whether the smaller of two pages shares more than half of its lines and of its text, in any order."""
    both = (Counter(a) & Counter(b)).items()
    n, size = sum(k for _, k in both), sum(x[1] * k for x, k in both)
    return 2 * n > min(len(a), len(b)) and 2 * size > min(sum(x[1] for x in a), sum(x[1] for x in b))


def shared_lines(lines: list[tuple[int, int]], path: str, before: tuple | None, after: tuple | None) -> set[int] | None:
    """Positions of the lines shared with the nearer of two neighbours (path, lines) that is no copy; None if both are copies."""
    pages = [x for x in (before, after) if x]
    near = max((x for x in pages if not is_copy(lines, x[1])), key=lambda x: _shared_prefix(path, x[0]), default=None)
    if near is None:
        return None if pages else set()
    return common_lines(lines, near[1])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row."""

    def make():
        def f(batch):
            marks, sizes = [], []
            for h in batch.column(5).to_pylist():
                lines = placed_lines(h or "")[0]
                marks.append([x.mark() for x in lines])
                sizes.append([len(x.text) for x in lines])
            return pa.table([*(batch.column(i) for i in range(5)), pa.array(marks, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["id", "url", "h", "host", "path", "marks", "sizes"])

        return f

    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    id_type = d.schema["id"].dataType.simpleString()
    parsed = map_rows(d.select("id", "url", "h", host_of("url").alias("host"), path_of("url").alias("path"), "html"), make, f"id {id_type}, url string, h long, host string, path string, marks array<long>, sizes array<int>", max_bytes=8 << 20)
    parsed = parsed.filter("size(marks) > 0").dropDuplicates(["id", "url", "h"])

    # a global order by host and path: position in the partition plus what earlier partitions hold
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "id", "url", "h"]
    local = F.monotonically_increasing_id()
    # stored first, as the bounds of the ranges take a pass of their own
    placed = stored(stored(parsed, "parsed").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("m", local), "ordered")
    placed = placed.withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND((1 << 33) - 1))
    # one row per partition, so the window runs over a small table
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    placed = placed.join(F.broadcast(offset), "part").withColumn("g", F.col("at") + F.col("o")).select("id", "url", "h", "host", "path", "marks", "sizes", "g")
    other = placed.select((F.col("g")).alias("g2"), F.col("host").alias("h2"), F.struct("path", "marks", "sizes").alias("page"))
    prev, after = other.toDF("g2", "h2", "prev"), other.toDF("g3", "h3", "after")
    paired = placed.join(prev, (F.col("g2") == F.col("g") - 1) & (F.col("h2") == F.col("host")), "left").join(after, (F.col("g3") == F.col("g") + 1) & (F.col("h3") == F.col("host")), "left")

    def make_difference():
        def f(batch):
            drops, alone, left = [], [], []
            for path, marks, sizes, x, y in zip(*(batch.column(i).to_pylist() for i in range(5, 10)), strict=True):
                x, y = (v and (v["path"], list(zip(v["marks"], v["sizes"], strict=True))) for v in (x, y))
                drop = shared_lines(list(zip(marks, sizes, strict=True)), path, x, y)
                alone.append(drop is None)
                drops.append(sorted(drop or ()))
                left.append(sorted({m for i, m in enumerate(marks) if drop is None or i in drop}))
            return pa.table([*(batch.column(i) for i in range(5)), pa.array(alone), pa.array(drops, pa.list_(pa.int32())), pa.array(left, pa.list_(pa.int64()))], names=["g", "id", "url", "h", "host", "alone", "drop", "marks"])

        return f

    decided = stored(map_rows(paired.select("g", "id", "url", "h", "host", "path", "marks", "sizes", "prev", "after"), make_difference, f"g long, id {id_type}, url string, h long, host string, alone boolean, drop array<int>, marks array<long>").filter("alone or size(drop) > 0"), "differenced")
    # pages between copies: which of their lines were deleted elsewhere on the host; a common line is dealt to SALTS tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = decided.filter("not alone").select("host", F.explode("marks").alias("mark")).distinct().select("host", "mark", salts)
    own = decided.filter("alone").select("g", "id", "url", "h", "host", F.explode("marks").alias("mark"), F.pmod("g", F.lit(SALTS)).cast("int").alias("salt"))
    gone = own.join(known, ["host", "mark", "salt"]).groupBy("g", "id", "url", "h").agg(F.collect_set("mark").alias("gone"))
    none = lambda t: F.lit(None).cast(f"array<{t}>")
    shared = decided.filter("not alone").select("id", "url", "h", "drop", none("long").alias("gone")).unionByName(gone.select("id", "url", "h", none("int").alias("drop"), "gone"))
    shared = stored(shared, "shared").toDF("id2", "url2", "hash2", "drop", "gone")  # stored, so that a small one is broadcast and pages aren't shuffled
    same = F.col("id").eqNullSafe(F.col("id2")) & F.col("url").eqNullSafe(F.col("url2")) & (F.col("h") == F.col("hash2"))

    def make_text():
        def f(batch):
            texts = []
            for html, drop, gone in zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True):
                lines, has_article = placed_lines(html or "")
                gone = set(gone or ())
                deleted = set(drop or ()) | {i for i, x in enumerate(lines) if gone and x.mark() in gone}
                texts.append("\n\n".join(kept_lines(lines, has_article, deleted)))
            return pa.table([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

        return f

    out = map_rows(d.join(shared, same, "left").select("id", "url", "html", "drop", "gone"), make_text, f"id {id_type}, url string, text string", max_bytes=8 << 20)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
