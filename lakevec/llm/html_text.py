"""HTML extraction with removal of site templates.

Every page is cut into elements. A subtree gets a hash of its tags and text
and, if it is a named box of the page (a block with a class or id, a landmark),
one of its tags and names alone, since menus, adverts and notices change their
words from page to page but not their shape. Spark counts, for each host, the
pages that hold a hash, and subtrees that recur across many pages of their host
are deleted; boxes only where they hold little of the host's text, so that the
box of the article stays. Of what lies inside the article (an article or main
element or, where there is none, the page's densest block) only whole boxes that
half of the host's pages hold word for word are deleted, never a link, a span or a
line. What the standard itself sets apart from an article (nav, footer, forms,
scripts) and reader comments, which don't recur, go too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.common import stored, work_folder

#: Elements without content, elements whose content isn't text, elements that are never the article, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
NEVER = frozenset("nav header footer aside form menu dialog button select option svg canvas object audio video script style textarea title noscript iframe template xmp noembed noframes head".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class, id or role that mark what isn't the article, for hosts of too few pages to show what recurs.
MARKS = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|sidebar|side-bar|menus?|navbar|nav|navigation|breadcrumbs?|header|footer|comments?|comment-?list|disqus|share|sharing|social|related|pagination|pager|search|skip-link|complementary|contentinfo|toolbar|widget)(?![a-z])",
    re.I,
)
#: Elements that end an open one of the same kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
#: Elements that an unclosed p ends at.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}

#: Boxes of a page, which are counted by shape if they have a name or are landmarks.
BOXES = frozenset("address aside center details dialog div dl fieldset footer form header hgroup menu nav ol section ul".split())
LANDMARKS = frozenset("aside footer form header menu nav".split())
COMMENTS = re.compile(r"(?<![a-z])(?:comments?|comment-?list|disqus)(?![a-z])", re.I)

#: So many different pages of a host make a template, whatever the host's size.
MIN_PAGES = 5
#: Headings, which are no template where text lies in the page's body itself.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A box is template if it is on this share of its host's pages and holds at most this share of their text.
BOX_PAGES, BOX_TEXT = 0.5, 0.2

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACES = re.compile(r"[ \t\n\r\f\v   -     　\x1c-\x1f\x85]+")


class Element:
    __slots__ = ("tag", "parts", "never", "marked", "names", "hash", "shape", "digest", "form", "inside")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.parts, self.hash, self.shape, self.digest, self.form, self.inside = tag, [], 0, 0, b"", b"", False
        self.never, self.marked, self.names = _reading(tag, attributes)


def _reading(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Of a start tag: never part of the article, marked by a word as such, words of its class, id and role without digits."""
    never, marked, names = tag in NEVER, tag in NEVER, []
    if not attributes or never and tag not in BOXES or tag in ("html", "body", "main"):
        return never, marked, ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            never = True
        elif name in ("class", "id", "role"):
            names.append(value.lower())
            never = never or bool(COMMENTS.search(value))  # reader comments come as articles too
            marked = marked or tag != "article" and bool(MARKS.search(value))
    return never, marked or never, re.sub(r"\d+", "", " ".join(sorted(names)))


def parse(html: str) -> Element:
    """The tree of a page: elements with their parts (texts and elements) in order. Faulty markup is read as browsers do, about."""
    root = Element("", "")
    stack = [root]
    at = 0
    end = len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "br":
                stack[-1].parts.append(Element("br", ""))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in ("p", "b", "i", "em", "strong", "span", "a") and stack[i].tag in ("article", "div", "section", "td", "li", "nav", "footer", "aside", "main", "body"):
                    break
            continue
        attributes = m.group(3)
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in CLOSES and stack[-1].tag in CLOSES[tag]:
            while stack[-1].tag in CLOSES[tag]:
                stack.pop()
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag == "head":
                stack.pop()
        e = Element(tag, attributes)
        stack[-1].parts.append(e)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(html, at)
            e.parts.append(html[at : close.start()])
            at = close.end()
            continue
        stack.append(e)
    return root


def densest(root: Element) -> tuple[Element | None, Element]:
    """(the block that takes an article's place on a page without one, or None; the element in which the page's blocks lie side by side).

    From the body down past wrappers to where blocks lie side by side; the one
    with at least two thirds of their text is it, and further down as long as all
    text beside such a block is in landmarks or marked elements.
    """
    size: dict[int, int] = {}
    todo: list[tuple[Element, bool]] = [(root, False)]
    while todo:
        e, done = todo.pop()
        if not done:
            todo.append((e, True))
            todo.extend((x, False) for x in e.parts if isinstance(x, Element))
        else:
            own = 0 if e.tag in RAW or e.tag == "head" else sum(len(x.strip()) if isinstance(x, str) else size[id(x)] for x in e.parts)
            size[id(e)] = 0 if e.never else own
    at, found = root, None
    while True:
        bare = any(isinstance(x, str) and x.strip() for x in at.parts)
        inner = [x for x in at.parts if isinstance(x, Element) and size[id(x)]]
        most = max(inner, key=lambda x: size[id(x)], default=None)
        if most is None or bare or most.tag not in BLOCKS or most.tag in ("p", "li") or 3 * size[id(most)] < 2 * size[id(at)]:
            return found, at if found is None else found
        if len(inner) == 1 and found is None:
            at = most
        elif found is None or all(x is most or x.marked for x in inner):
            at = found = most
        else:
            return found, found


def hashed(root: Element) -> list[Element]:
    """The elements that a template may hold, in order of their ends, with the hash of their subtree and, for boxes, of its shape.

    Only blocks are compared with the site's template, and inside an article only
    boxes, as a whole, by a hash of their own; nor do boxes inside or around it have a shape.
    """
    out: list[Element] = []
    names, todo = set(), [root]
    while todo:
        e = todo.pop()
        names.add(e.tag)
        todo.extend(x for x in e.parts if isinstance(x, Element))
    body, flat = (None, None) if names & {"article", "main"} else densest(root)
    work: list[tuple[Element, bool, bool, bool, bool]] = [(root, False, False, False, False)]
    while work:
        e, done, inside, wanted, line = work.pop()
        own = e.tag in ("article", "main")
        if not done:
            if own:
                wanted = False
            elif e is body:
                wanted = inside = True  # it may be a notice on a page of little text
            elif e.tag in (BOXES if inside else BLOCKS) and not (line and e.tag in HEADINGS):
                wanted = True
            work.append((e, True, inside, wanted, line))
            work.extend((x, False, inside or own, wanted and e.tag not in ("", "html", "body"), e is flat) for x in reversed(e.parts) if isinstance(x, Element))
            continue
        if own or not wanted:
            e.digest, e.form = e.tag.encode(), b"article" if own else e.tag.encode()
            continue
        h, forms = xxhash.xxh3_64(e.tag.encode()), set()
        for x in e.parts:
            h.update(SPACES.sub(" ", x).strip().encode("utf-8", "replace") if isinstance(x, str) else x.digest)
            h.update(b"\0")
            if not isinstance(x, str):
                forms.add(x.form)
        e.digest = h.digest()
        around = b"article" in forms or e is body
        e.form = b"article" if around else xxhash.xxh3_64(b"\0".join([e.tag.encode(), e.names.encode("utf-8", "replace"), *sorted(forms)])).digest()
        if e.tag in (BOXES if inside else BLOCKS) and not (line and e.tag in HEADINGS) and e.tag not in ("html", "body", "br"):
            if inside:
                h.update(b"inside")
            e.hash, e.inside = h.intdigest(), inside
            if e.tag in BOXES and (e.names or e.tag in LANDMARKS) and not (inside or around):
                e.shape = int.from_bytes(e.form, "little")
            out.append(e)
    return out


def text_size(e: Element) -> int:
    """Characters of text below e, without what is never text."""
    n, todo = 0, [e]
    while todo:
        x = todo.pop()
        for y in x.parts:
            if isinstance(y, str):
                n += len(y)
            elif y.tag not in RAW and y.tag != "head":
                todo.append(y)
    return n


def main_text(root: Element, template: set[int] | None) -> str:
    """The blocks of what is left without the template, in order.

    Where nothing is known of the host (None), elements with telling names go
    and an article or main element, if there is one, is all that counts.
    """
    known = template is not None
    gone_hashes = template or set()

    def is_gone(x: Element) -> bool:
        return x.never or not known and x.marked or known and (x.hash in gone_hashes or x.shape in gone_hashes)

    found: list[Element] = []
    todo = [] if known else [root]
    while todo:
        e = todo.pop()
        if is_gone(e):
            continue
        if e.tag in ("article", "main"):
            found.append(e)
            continue
        todo.extend(x for x in reversed(e.parts) if isinstance(x, Element))
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", unescape("".join(line))).strip(" ")
        line.clear()
        if text:
            blocks.append(text)

    for top in found or [root]:
        work: list = [top]
        while work:
            x = work.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            else:
                gone = x is not top and is_gone(x)
                if x.tag in BLOCKS:
                    flush()
                    if not gone:
                        work.append(None)
                if not gone:
                    work.extend(reversed(x.parts))
        flush()
    return " ".join(blocks)


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, hash, box, text): each subtree of a page, with text -1 inside its article, each shape of a box with its characters of text, and the page itself with all of them and a null hash."""
    for b in batches:
        rows: list[tuple[str, int, int | None, bool, float]] = []
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = xxhash.xxh3_64_intdigest((html or "").encode("utf-8", "replace")) - (1 << 63)
            root = parse(html or "")
            found, boxes = hashed(root), defaultdict(int)
            for e in found:
                if e.shape:
                    boxes[e.shape] += text_size(e)
            rows.append((host, page, None, False, float(text_size(root))))
            rows += [(host, page, h - (1 << 63), False, -1.0 if inside else 0.0) for h, inside in {(e.hash, e.inside) for e in found if e.parts}]
            rows += [(host, page, h - (1 << 63), True, float(n)) for h, n in boxes.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "page", "hash", "box", "text"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, box_pages: float = BOX_PAGES, box_text: float = BOX_TEXT) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of pages.

    A subtree outside the article is of its host's template if at least min_pages
    different pages hold it, whatever the size of the host. A box inside the
    article is, if box_pages of the host's different pages hold it word for word, and
    a box outside it of some shape, if box_pages of them hold it and it
    has on average at most box_text of the characters of an average page. Copies of a page count once
    on both sides. On hosts of fewer than min_pages different pages fixed words
    of classes decide. Null or empty html gives an empty text; rows without a
    usable url share the empty host; very long and deeply nested pages are read
    whole. Repeated rows each get their row. Other columns are left out.

    The hashes combine before the shuffle, so a host with a third of all pages
    is no hot group. Template hashes reach the pages as an array for each host;
    where that table is too large to broadcast, the join is one that Spark
    splits by skew (the pages' side of a left join).
    """
    spark = pages.sparkSession
    folder = work_folder(spark, "html")
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    kind = "host string, page long, hash long, box boolean, text double"
    seen = pages.select("host", "html").mapInArrow(subtrees, kind).distinct().groupBy("host", "hash", "box").agg(F.count("*").alias("n"), F.avg("text").alias("text")).where(F.col("n") >= min_pages)
    seen = stored(seen, f"{folder}/seen")
    sizes = seen.where("hash IS NULL").select("host", F.col("n").alias("n_pages"), F.col("text").alias("page_text"))
    half = F.col("n") >= F.col("n_pages") * box_pages
    recurs = F.when(F.col("box"), half & (F.col("part") <= F.col("page_text") * box_text)).otherwise((F.col("part") >= 0) | half)
    template = sizes.join(seen.where("hash IS NOT NULL").withColumnRenamed("text", "part"), "host", "left").select("host", F.when(recurs, F.col("hash")).alias("hash"))
    template = stored(template.groupBy("host").agg(F.collect_set("hash").alias("template")), f"{folder}/template")
    both = pages.join(template, "host", "left").select("page_id", "url", "html", "template")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html, template in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True):
                root = parse(html or "")
                if template:
                    hashed(root)
                out.append(main_text(root, None if template is None else {h + (1 << 63) for h in template}))
            n = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
