"""Main text of web pages: page structure first, then subtrees that recur across the pages of a host are deleted."""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keystrata.llm.common import cut, evened, map_arrow, named

#: A subtree goes if it stands on this many pages of its host whose main texts differ.
MANY_PAGES = 10
#: Where a page has no article or main element, an element with this share of its text is no aside, whatever its names say.
MOST = 0.6
#: Digests of recurring subtrees that are sent to the executors, at most; eight bytes each.
MARKS_SENT = 1 << 20
#: Inside an article or main element, pages differ if the longest blocks beside the subtree, at most this many, differ.
BESIDE = 2

# Names of HTML elements, and words in class, id and role that tell what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption html option optgroup tbody td tfoot th thead tr".split())
INLINE_ENDS = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var p".split())
NEVER = frozenset("nav aside footer form script style textarea title noscript template iframe svg head button select menu dialog object canvas audio video map xmp noembed noframes search".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt", "dd", ("dl",)), "dd": ("dt", "dd", ("dl",)), "tr": ("tr", "td", "th", ("table", "tbody", "thead", "tfoot")), "td": ("td", "th", ("tr", "table")), "th": ("td", "th", ("tr", "table")), "option": ("option", ("select", "optgroup"))}
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidenav widget menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager share sharing social related recommended recommendations trending comment comments commentlist disqus respond replies footer masthead toolbar "
    "login search searchbox skip tags contentinfo complementary".split()
)
HEADER_WORDS = frozenset("header topbar banner masthead".split())
# Words that also say what a text is about: they don't count on the elements of running text.
VAGUE_WORDS = frozenset("share sharing notice notification alert related social tags search login signup promotion banner subscription menu".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption address".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
# With one of these a name tells of what is beside an element, or of a page as a whole, not of the element.
HOLDER_WORDS = frozenset("with without has have no layout".split())
MAIN_WORDS = frozenset("main".split())
# Parts of a list, table or section, that say nothing alone: in an article they go with the whole or stay.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup li dt dd tr td th thead tbody tfoot caption figcaption summary legend option optgroup".split())
# End of fixed values.

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("children", "hidden", "holds_main", "most", "tag", "words")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children = tag, []
        self.words: frozenset[str] = frozenset()
        self.hidden = self.holds_main = self.most = False
        if attributes and not attributes.isspace():
            words: set[str] = set()
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    for token in value.split():
                        pieces = {w.lower() for w in WORD.findall(token)}
                        if not pieces & HOLDER_WORDS:
                            words |= pieces
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                    self.hidden = True
            self.words = frozenset(words)


def tree(page: str) -> Node:
    """Elements and texts. End tags that HTML lets out are put in; those that match nothing are dropped."""
    root = Node("html", "")
    stack = [root]
    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            return root
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE_ENDS and stack[i].tag in BLOCKS and not (stack[i].tag == "p" and tag != "p"):
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in SIBLINGS:
            *closed, within = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closed:
                    del stack[i:]
                    break
                if stack[i].tag in within:
                    break
        if tag in ("html", "body") and any(n.tag == tag for n in stack[1:]):
            continue
        node = Node(tag, m[3] if m[2] else m[6] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|/)", re.IGNORECASE).search(page, at)
            at = len(page) if not end else page.index(">", end.start()) + 1 if ">" in page[end.start() :] else len(page)
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            stack.append(node)


def is_main(n: Node) -> bool:
    return n.tag in ("article", "main") and not n.words & {"comment", "comments", "reply"} or bool(n.words & MAIN_WORDS) and n.tag in ("div", "section", "td")


def unwanted(n: Node, in_main: bool) -> bool:
    if n.tag == "form" and (n.holds_main or n.most):
        return False
    if n.tag in NEVER or n.hidden and n.tag not in ("html", "body"):
        return True
    if n.holds_main or n.tag in ("html", "body"):
        return False
    if not in_main and (n.tag == "header" or n.words & HEADER_WORDS):
        return True
    telling = n.words & ASIDE_WORDS
    if n.tag in TEXT_TAGS:
        telling -= VAGUE_WORDS
    if not telling or is_main(n) and not in_main:
        return False
    return not n.most or bool(telling & COMMENT_WORDS)


def mark_most(root: Node) -> None:
    """Sets most on the elements that hold at least MOST of the page's text outside scripts and the like."""
    total: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in n.children if not isinstance(c, str) and c.tag not in RAW)
    for n in reversed(order):
        total[id(n)] = sum(len(c) - c.count(" ") if isinstance(c, str) else total.get(id(c), 0) for c in n.children)
    least = MOST * total[id(root)]
    for n in order:
        n.most = total[id(n)] >= least > 0


def mark_main(root: Node) -> bool:
    """Sets holds_main on the elements around an article or main element; whether there is one."""
    path: list[tuple[Node, int]] = [(root, 0)]
    while path:
        n, i = path.pop()
        while i < len(n.children) and isinstance(n.children[i], str):
            i += 1
        if i == len(n.children):
            continue
        path.append((n, i + 1))
        c = n.children[i]
        if is_main(c) and c.tag not in NEVER:
            for a, _ in path:
                a.holds_main = True
        elif c.tag not in NEVER or c.tag == "form":
            path.append((c, 0))
    return root.holds_main


def digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def examine(page: str | None, host: str, inside: bool = False) -> tuple[list[tuple[str, list[int]]], set[int]]:
    """Blocks of the main text, each with the digests of the subtrees that it goes with; and the digests of all subtrees
    outside article and main elements.

    With `inside`, blocks have digests of the subtrees inside an article or main element too, PARTS aside."""
    if not page:
        return [], set()
    root = tree(page)
    has_main = mark_main(root)
    if not has_main:
        mark_most(root)
    blocks: list[tuple[str, list[int]]] = []
    every: set[int] = set()
    parts: list[str] = []
    chain: list[int] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, chain.copy()))
            parts.clear()

    def full_text(n: Node) -> str:
        out, todo = [], [n]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in RAW:
                out.append(f"<{x.tag}>")
                todo.extend(reversed(x.children))
        return "".join(out)

    # Steps: (node, in main, wanted) on the way down; (None, node, digest) on the way up.
    todo: list[tuple] = [(root, False, True)]
    while todo:
        step = todo.pop()
        if step[0] is None:
            if step[1].tag in BLOCKS:
                flush()
            if step[2]:
                chain.pop()
            continue
        n, in_main, wanted = step
        if isinstance(n, str):
            if wanted and (in_main or not has_main):
                parts.append(n)
            continue
        if n.tag == "br":
            parts.append(" ")
            continue
        if n.tag in BLOCKS:
            flush()
        if wanted and unwanted(n, in_main):
            wanted = False
        within = in_main
        if not in_main and is_main(n) and wanted:
            in_main = True
        mark = 0
        counted = inside and wanted and n.tag not in PARTS if within else not in_main
        if n.tag in BLOCKS and counted and not n.holds_main and n.tag not in ("html", "body") and n.children:
            text = full_text(n)
            if not re.sub(r"<[^>]*>", "", text).isspace() and re.sub(r"<[^>]*>", "", text):
                # What recurs outside tells nothing of the same text inside.
                mark = digest(host, text, "main") if within else digest(host, text)
                if not within:
                    every.add(mark)
                if wanted:
                    chain.append(mark)
        todo.append((None, n, mark and wanted))
        if wanted or not n.holds_main:
            todo.extend((c, in_main, wanted) for c in reversed(n.children))
    flush()
    return blocks, every


def contents(blocks: list[tuple[str, list[int]]], every: set[int]) -> list[tuple[int, int]]:
    """Every mark of a page with a digest of what else the page says, so that copies count once.

    Outside article and main that is all blocks. Inside it is the longest blocks that don't go with the mark, so that
    copies of an article that differ in a line (a date, a count) are copies still; a subtree beside which nothing stands
    has none."""
    whole = digest(*(t for t, _ in blocks))
    out = [(mark, whole) for mark in every]
    longest = [(t, set(marks)) for t, marks in sorted(blocks, key=lambda b: (-len(b[0]), b[0]))]
    for mark in {m for _, marks in blocks for m in marks} - every:
        beside: list[str] = []
        for text, marks in longest:
            if mark not in marks:
                beside.append(text)
                if len(beside) == BESIDE:
                    break
        if beside:
            out.append((mark, digest(*beside)))
    return out


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", many_pages: int = MANY_PAGES, marks_sent: int = MARKS_SENT) -> DataFrame:
    """One row per page: id, url, text, n_chars, n_deleted (blocks deleted as site template).

    The text is that of the article or main element, else of the body, without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and reader comments, told by their element or by words in class, id and role. Character
    references are decoded; white space inside a block is one space; blocks follow each other in page order, one a line.
    Then element subtrees that stand on at least `many_pages` pages of their host with different main texts are deleted
    (copies of a page count once). Inside article and main, headings, list items and table cells go only with what holds
    them, and pages differ by their longest blocks beside the subtree; of blocks of one length the one that sorts first counts as the longer. A null or empty page has the empty text; a null
    url is a host of its own name. Repeated rows stay repeated. An empty table gives no rows; other columns aren't read. A page of any length is read whole, in time in
    proportion to its elements times their depth.

    Names tell less than structure: one that speaks of what an element has beside it (with-sidebar) counts for nothing, vague
    ones nothing on a paragraph or the like; a form that holds the article is no form, and where a page has neither article nor main, an
    element with most of the text is no aside, but for comments.

    Pages are parsed twice: once for the digests of subtrees, then for the blocks. The digests that recur go to the executors where
    they are at most `marks_sent`, which nothing else is shuffled for then; beyond that they are joined to the pages'."""
    where = [named(url_col).alias("_url"), named(html_col).alias("_html")]

    def digests(batches):
        for b in batches:
            found: list[tuple[int, int]] = []
            for url, page in zip(b.column("_url").to_pylist(), b.column("_html").to_pylist(), strict=True):
                found += contents(*examine(page, host_of(url), inside=True))
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], names=["mark", "content"])

    counted = map_arrow(evened(pages.select(*where)), digests, "mark long, content long").distinct().groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    recurring = cut(counted.filter(F.col("n") >= many_pages).select("mark"))
    n_recurring = recurring.count()
    rows = evened(pages.select(*where, named(id_col).alias("_id"), named(url_col).alias("_u")))
    own = [StructField(f.name, f.dataType) for f in rows.schema.fields[2:]]
    out_of = [F.col("_id").alias(id_col), F.col("_u").alias(url_col), "text", "n_chars", "n_deleted"]

    if n_recurring <= marks_sent:
        gone = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r["mark"] for r in recurring.collect()], dtype=np.int64)))

        def extract(batches):
            marks = gone.value
            for b in batches:
                texts, dropped = [], []
                for url, page in zip(b.column("_url").to_pylist(), b.column("_html").to_pylist(), strict=True):
                    blocks = examine(page, host_of(url), inside=True)[0]
                    sizes = [len(m) for _, m in blocks]
                    flat = np.array([m for _, own_marks in blocks for m in own_marks], dtype=np.int64)
                    hit = np.zeros(len(flat), dtype=bool)
                    if len(marks) and len(flat):
                        hit = marks[np.minimum(np.searchsorted(marks, flat), len(marks) - 1)] == flat
                    ends = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)]
                    bad = np.diff(ends) > 0
                    texts.append("\n".join(t for (t, _), x in zip(blocks, bad.tolist(), strict=True) if not x))
                    dropped.append(int(bad.sum()))
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(dropped, pa.int32())]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns)), *made], names=[*b.schema.names[2:], "text", "n_chars", "n_deleted"])

        return map_arrow(rows, extract, StructType([*own, *StructType.fromDDL("text string, n_chars long, n_deleted int").fields])).select(*out_of)

    def blocks_of(batches):
        for b in batches:
            found = [examine(page, host_of(url), inside=True)[0] for url, page in zip(b.column("_url").to_pylist(), b.column("_html").to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("text", pa.string()), ("marks", pa.list_(pa.int64()))]))
            blocks = pa.array([[{"text": t, "marks": m} for t, m in r] for r in found], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns)), blocks], names=[*b.schema.names[2:], "blocks"])

    keyed = rows.withColumn("_key", F.xxhash64("_id", "_url", "_html"))
    parsed = map_arrow(keyed, blocks_of, StructType([*own, StructField("_key", LongType()), *StructType.fromDDL("blocks array<struct<text: string, marks: array<long>>>").fields]))
    marked = parsed.select("_key", F.explode(F.array_distinct(F.flatten(F.col("blocks.marks")))).alias("mark"))
    gone = marked.join(recurring, "mark", "left_semi").groupBy("_key").agg(F.collect_set("mark").alias("gone"))
    left = F.filter("blocks", lambda x: F.coalesce(~F.arrays_overlap(x["marks"], F.col("gone")), F.lit(True)))
    out = parsed.join(gone, "_key", "left").withColumn("left", F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(left))
    out = out.withColumns({"text": F.array_join(F.transform("left", lambda x: x["text"]), "\n"), "n_deleted": F.size("blocks") - F.size("left")})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*out_of)
