"""Main text of raw pages by site template removal.

Each page is parsed once into a tree. Element subtrees are hashed (tag and
text), counted per host in Spark, and subtrees that recur on many pages of a
host are deleted: its template. What a page says about itself (landmark
elements, class, id and role names) settles parts that differ from page to
page, such as adverts and reader comments. Inside an article the text blocks
themselves are never template: a sentence that many articles share is content.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A subtree is template if this share of the host's pages has it, and at least MIN_PAGES do.
RATIO = 0.3
MIN_PAGES = 5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot
th thead tr ul""".split())
DROPPED = frozenset("""head nav header footer aside form script style noscript template iframe svg canvas button select option
textarea input menu dialog object embed noembed noframes title""".split())
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt li td th".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol menu dl table div section article main body html td th".split())
# Words in class, id and role names that mark parts other than the article.
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner
banners cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb
breadcrumbs sidebar sidebars aside footer header masthead comment comments disqus respond reply replies discussion related
recommended share sharing social newsletter subscribe subscription signup login search widget widgets complementary
contentinfo toolbar pagination pager skip outbrain taboola""".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
CUT_TAG = re.compile(r"</?[a-zA-Z][^>]*\Z")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""\s(hidden|aria-hidden\s*=\s*["']?true)(?=[\s=/>]|["']|\Z)""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "children", "aside", "digest")

    def __init__(self, tag: str, aside: bool) -> None:
        self.tag, self.aside = tag, aside
        self.children: list = []  # nodes and strings
        self.digest = 0


def _is_aside(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    for m in ATTRIBUTE.finditer(attributes):
        value = m.group(2).strip("\"'")
        if any(w.lower() in ASIDE_WORDS for w in NAME_WORD.findall(value)):
            return True
    return False


def parse(page: str) -> Node:
    """A tree of ``page``: unclosed and misplaced tags are taken as browsers do in the common cases."""
    root = Node("#root", False)
    stack = [root]
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(s)

    def close(tags: set[str], stop: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            text(CUT_TAG.sub("", rest))
            break
        text(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            if tag == "br":
                text(" ")
                continue
            close({tag}, frozenset(("article", "body", "html")) - {tag} if tag not in ("body", "html") else frozenset())
            continue
        if tag in BLOCK and tag not in ("html", "body", "head"):
            close({"p"}, SCOPE)  # a block ends an open paragraph, and the inline elements in it
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE - {"td", "th"} if tag in ("td", "th", "tr") else SCOPE)
        node = Node(tag, _is_aside(tag, m.group(3)))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m.group(3).endswith("/"):
            stack.append(node)
    return root


def _words(s: str) -> str:
    return " ".join(html_lib.unescape(s).split())


def digest(node: Node) -> int:
    """Hash of an element: its tag and what it holds, texts with their blanks joined. Set on all below."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        parts = [x.tag.encode()]
        parts += [c.digest.to_bytes(8, "little") if isinstance(c, Node) else _words(c).encode("utf-8", "replace") for c in x.children]
        x.digest = xxhash.xxh3_64_intdigest(b"\0".join(parts))
    return node.digest


def article_root(root: Node) -> Node | None:
    """The first article element with text, else the first main element; None if the page names neither."""
    found = {"article": [], "main": []}
    todo = [root]
    while todo:
        x = todo.pop()
        if x.aside:
            continue
        if x.tag in found:
            found[x.tag].append(x)
            if x.tag == "article":
                continue
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    both = found["main"] or found["article"]
    if found["article"]:
        holder = Node("#articles", False)
        holder.children = found["article"]
        return holder
    return both[0] if both else None


def candidates(root: Node) -> list[int]:
    """Digests of the subtrees that may be template: in an article, elements that hold blocks, not text blocks."""
    main = article_root(root)
    top, in_article = (main, True) if main else (root, False)
    out, todo = set(), [c for c in top.children if isinstance(c, Node)]
    while todo:
        x = todo.pop()
        if x.aside:
            continue
        if x.tag not in ("html", "body", "article", "main") and x.tag in BLOCK and not (in_article and x.tag in TEXT_BLOCK) \
                and not (in_article and x.tag in ("ul", "ol", "dl", "table", "tbody", "tr")):
            out.add(x.digest)
        todo += [c for c in x.children if isinstance(c, Node)]
    return list(out)


def blocks(root: Node, template: set[int]) -> list[str]:
    """Texts of the blocks that stay, in page order."""
    main = article_root(root)
    top, in_article = (main, True) if main else (root, False)
    out, current = [], []

    def flush() -> None:
        s = _words("".join(current))
        current.clear()
        if s:
            out.append(s)

    may_go = set(candidates(root)) & template
    todo: list = [("open", top)]
    while todo:
        what, x = todo.pop()
        if what == "text":
            current.append(x)
        elif what == "close":
            flush()
        else:
            if x.aside or (x.digest in may_go and x is not top and x.tag in BLOCK and not (in_article and x.tag in TEXT_BLOCK)):
                if x.tag in BLOCK:
                    flush()
                continue
            if x.tag == "br" or x.tag == "hr":
                current.append(" ")
                continue
            if x.tag in BLOCK:
                flush()
                todo.append(("close", x))
            todo += [("open", c) if isinstance(c, Node) else ("text", c) for c in reversed(x.children)]
    flush()
    return out


def host_of(url):
    """Host of a url column, lower-cased; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(h != "", h)


def template_subtrees(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, template): digests of the subtrees on more than ``ratio`` of the host's pages.

    A page counts a subtree once. The digests of a host number at most (mean
    subtrees per page) / ratio. Pages without a host are a host of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                root = parse(t or "")
                digest(root)
                found.append([x - (1 << 64) if x >> 63 else x for x in candidates(root)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["host", "digests"])

    src = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    counts = (src.mapInArrow(run, "host string, digests array<bigint>").select("host", F.explode("digests").alias("digest"))
              .groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    totals = src.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("total"))
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") / F.col("total") > F.lit(float(ratio)))
            .groupBy("host").agg(F.collect_list("digest").alias("template")))


def main_text(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars): main text of each row's whole page.

    Blocks are joined by one space, blanks in a block are one space, character
    references are decoded. Null or empty html, and pages without main text:
    an empty text. Repeated rows each get a row.
    """
    pages = pages.select("page_id", "url", "html")
    known = template_subtrees(pages, ratio, min_pages).toDF("site", "template")
    rows = pages.withColumn("host", host_of(F.col("url")))
    rows = rows.join(known, F.col("host").eqNullSafe(F.col("site")), "left").select("page_id", "url", F.col("html").cast("string"), "template")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, template in zip(b.column(2).to_pylist(), b.column(3)):
                root = parse(t or "")
                gone = set()
                if template.is_valid:
                    digest(root)
                    gone = {x % (1 << 64) for x in template.as_py()}
                texts.append(" ".join(blocks(root, gone)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    url_kind = pages.schema["url"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url {url_kind}, text string, n_chars bigint")
