"""Operator 6, HTML extraction with removal of site templates.

First pass: the subtree of every block element is hashed (tag, class, id, text
and children), and Spark counts on how many pages of a host each hash occurs.
Second pass: subtrees that recur are cut, with what is page furniture by its tag
or name, and the text of the content element is joined from its blocks.

Prose in the content element (paragraphs, headings, list items, tables and the
like) is never cut for recurring: a passage that many articles quote is content.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import Scratch

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>|\Z)", re.DOTALL)
_RAW_END = {t: re.compile(rf"</{t}[\s/>]|\Z", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")}
#: One attribute, name[=value]; read one after another, so that a value is never taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption caption hr article main body html".split())
_CHROME = frozenset(
    "head title script style noscript template iframe object embed svg canvas nav footer aside form button select option input textarea label dialog menu search video audio map".split()
)
#: Names of furniture: words that say so alone, and pairs of a kind of furniture and a kind of part or place.
#: Longer names, such as comment-on-law or market-share, are none.
_KIND = "ads?|adverts?|cookies?|comments?|nav|navigation|menu|footer|sidebar|share|sharing|social|newsletter|promo|sponsored|related|breadcrumbs?"
_CHROME_NAME = re.compile(
    rf"""(?:ads?|adverts?|advertisements?|adsbygoogle|banners?|sponsor(?:ed|s)?|promos?|nav(?:bar|igation)?|menus?|breadcrumbs?|header|footer|sidebars?|side-bar|aside|widgets?|related|
    recommend(?:ed|ations)?|shar(?:e|ing)|subscribe|subscription|newsletter|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|comments?|replies|respond|
    disqus(?:_thread)?|pagination|pager|login|signup|search|skip-?link|(?:site|page)-?(?:header|footer)
    |(?:{_KIND})[-_](?:box|bar|wrap|wrapper|container|list|section|banner|block|area|form|links?|buttons?|icons?|items?|menu|nav|widget|panel|content|inner|outer|notice|consent|popup|
    overlay|thread|slot|unit|top|bottom|left|right|posts?|articles?|stories|signup|media|[0-9]+)
    |(?:top|left|right|bottom|side|main|site|page|header|footer|sticky|inline|post|article|user|reader|mobile|global|primary|secondary)[-_](?:{_KIND}|banner|advertisement))""",
    re.IGNORECASE | re.VERBOSE,
)
#: Elements of prose: an id, as it is made of their own text, never makes them furniture.
_ID_IS_OWN = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th blockquote pre figure figcaption caption".split())
#: Ids that make a section furniture although it begins with a heading: what readers say, and offers.
_STRICT_ID = re.compile(r"comments?|replies|respond|disqus(?:_thread)?|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|login|signup|cookies?|consent|gdpr|[a-z]+[-_][a-z0-9]+(?:[-_][a-z0-9]+)*", re.IGNORECASE)
#: A style that hides an element.
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CHROME_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_CONTENT_NAME = re.compile(r"^(?:(?:article|post|entry|story|page|main)[-_]?(?:body|content|text)|articlebody|main-?content|content)$", re.IGNORECASE)
#: Elements that an opening tag closes, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CLOSES["body"] = ({"head"}, {"html"})


@dataclass
class Element:
    tag: str
    names: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()  # of the names, those of its id
    role: str = ""
    hidden: bool = False
    content: bool = False
    children: list = field(default_factory=list)  # texts and elements
    #: Whether there is a heading below; an h1 or a content element.
    has_heading: bool = False
    has_content: bool = False

    def furniture(self, within: bool = False) -> bool:
        """By its tag, role or name no part of an article.  A header is, unless it is ``within`` a
        content element and has a heading; a form is, unless it is around a page's content or title."""
        if self.tag in ("html", "body"):
            return False
        if self.tag == "header" and not (within and self.has_heading):
            return True
        if self.tag == "form" and self.has_content:
            return False
        return self.tag in _CHROME or self.hidden or self.role in _CHROME_ROLE or any(_CHROME_NAME.fullmatch(n) for n in self.telling(within))

    def telling(self, within: bool) -> tuple[str, ...]:
        """The names that may make it furniture.  Ids are often made of headings: ``within`` a content element that
        of a piece of prose says nothing, and that of a section that begins with its own heading little."""
        if not (within and self.ids):
            return self.names
        ids = () if self.tag in _ID_IS_OWN else tuple(i for i in self.ids if _STRICT_ID.fullmatch(i)) if self.headed() else self.ids
        return self.names[: len(self.names) - len(self.ids)] + ids

    def headed(self) -> bool:
        """Whether a section's first element is its heading, before any text."""
        first = next((c for c in self.children if not isinstance(c, str) or c.strip()), None)
        return self.tag in ("section", "div") and isinstance(first, Element) and (first.tag in _HEADINGS or first.tag in ("header", "hgroup") and first.has_heading)


def _open(tag: str, attributes: str) -> Element:
    element = Element(tag, content=tag in ("article", "main"))
    if attributes:
        names: list[str] = []
        ids: list[str] = []
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(value.strip("\"'")) if value else ""
            if name in ("class", "id"):
                (ids if name == "id" else names).extend(value.split())
            elif name == "role":
                element.role = value.lower()
                element.content |= element.role in ("main", "article")
            elif name == "itemprop":
                element.content |= value.lower() == "articlebody"
            elif name in ("hidden", "aria-hidden"):
                element.hidden |= name == "hidden" or value.lower() == "true"
            elif name == "style":
                element.hidden |= bool(_HIDING.search(value))
        element.names, element.ids = (*names, *ids), tuple(ids)
        element.content |= any(_CONTENT_NAME.match(n) for n in element.names)
    return element


def parse(page: str) -> Element:
    """The tree of a page; unclosed elements end with their parents, an unfinished tag is left out.

    The places of open elements are kept by tag, so a page takes time in proportion to its length."""
    root = Element("html")
    stack = [root]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag, in the stack
    at, n = 0, len(page)

    def close(to: int) -> None:
        """Ends the element at this place and those in it."""
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if places[tag]:
                close(places[tag][-1])
            elif tag == "p":
                stack[-1].children.append(Element("p"))
            continue
        if not m[4] or tag == "html":
            continue
        if tag in _CLOSES_P and places["p"]:
            # An open paragraph ends here; inline elements that are open in it end with it.
            close(places["p"][-1])
        if tag in _CLOSES:
            closed, within = _CLOSES[tag]
            bound = innermost(within)
            while (place := innermost(closed)) > bound:
                close(place)
                if tag in ("li", "dt", "dd", "option", "body"):
                    break
        element = _open(tag, m[3])
        stack[-1].children.append(element)
        for flag, marks in (("has_heading", tag in _HEADINGS), ("has_content", tag == "h1" or element.content)):
            for e in reversed(stack) if marks else ():
                if getattr(e, flag):
                    break
                setattr(e, flag, True)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = page.find(">", end.start()) + 1 or n
            if end.start() == n:
                at = n
            if tag == "title":
                element.children.append(page[m.end() : end.start()])
        elif tag not in _VOID and not (m[3].endswith("/") and tag in ("svg", "path", "use")):
            places[tag].append(len(stack))
            stack.append(element)
    return root


def _hashes(element: Element, out: dict[int, int]) -> bytes:
    """The digest of a subtree, bottom up without recursion; those of elements by identity go to ``out``."""
    done: dict[int, bytes] = {}
    todo: list[tuple[Element, bool]] = [(element, False)]
    while todo:
        e, ready = todo.pop()
        if not ready:
            todo.append((e, True))
            todo += [(c, False) for c in e.children if isinstance(c, Element)]
            continue
        h = hashlib.blake2b(digest_size=8)
        h.update(f"{e.tag} {' '.join(e.names)}\0".encode("utf-8", "replace"))
        for c in e.children:
            h.update(done[id(c)] if isinstance(c, Element) else b"\1" + " ".join(c.split()).encode("utf-8", "replace") + b"\2")
        done[id(e)] = h.digest()
        out[id(e)] = int.from_bytes(h.digest(), "big", signed=True)
    return done[id(element)]


def _removable(root: Element) -> Iterator[Element]:
    """The elements that may be cut for recurring: blocks, but no prose in content elements."""
    todo = [(root, False)]
    while todo:
        e, within = todo.pop()
        if e.tag in _BLOCK and e.tag not in ("html", "body", "title") and not e.content and not (within and e.tag in _PROSE and not e.furniture(True)):
            yield e
        todo += [(c, within or e.content) for c in e.children if isinstance(c, Element)]


def template_hashes(page: str) -> list[int]:
    """The distinct hashes of the page's subtrees that may be part of a template."""
    root = parse(page)
    hashes: dict[int, int] = {}
    _hashes(root, hashes)
    return sorted({hashes[id(e)] for e in _removable(root)})


def main_text(page: str, recurring: set[int]) -> str:
    """The article's text: blocks in page order, white space in a block as one space."""
    root = parse(page)
    cut: set[int] = set()
    if recurring:
        hashes: dict[int, int] = {}
        _hashes(root, hashes)
        cut = {id(e) for e in _removable(root) if hashes[id(e)] in recurring}
    found = _content(root, cut)
    text = _text(found or [root], cut, bool(found))
    return text if text or not cut or found else _text([root], set())


def _content(root: Element, cut: set[int]) -> list[Element]:
    """The outermost content elements outside furniture, in page order: articles before other kinds."""
    out: list[Element] = []
    todo = [root]
    while todo:
        e = todo.pop()
        if e.furniture() or id(e) in cut:
            continue
        if e.content:
            out.append(e)
            continue
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    inner = []
    for e in out:
        articles = _articles(e, cut)
        inner += articles or [e]
    return inner


def _articles(e: Element, cut: set[int]) -> list[Element]:
    """The articles in a content element that is not one itself, if there are any."""
    if e.tag == "article":
        return [e]
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if x is not e and (x.furniture(True) or id(x) in cut):
            continue
        if x.tag == "article":
            out.append(x)
            continue
        todo += [c for c in reversed(x.children) if isinstance(c, Element)]
    return out


def _text(roots: list[Element], cut: set[int], within: bool = False) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        block = " ".join("".join(run).split())
        if block:
            blocks.append(block)
        run.clear()

    todo: list = []
    for root in reversed(roots):
        todo += [None, root]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(html.unescape(x))
        elif x.tag == "br":
            run.append(" ")
        elif id(x) not in cut and not (x.furniture(within) and not x.content):
            if x.tag in _BLOCK:
                close()
                todo.append(None)
            todo += reversed(x.children)
    close()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, least_pages: int = 20, least_share: float = 0.005, salts: int = 8, sent_templates: int = 100_000) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A subtree is part of a template if ``least_pages`` rows of its host have it, and of a
    host with many pages at least the share ``least_share`` of them.  Up to
    ``sent_templates`` of them are counted and sent to the tasks, more are joined to
    their pages; the rows are the same.  A page
    without content element gives what its body has left; if the templates leave
    nothing of such a page, they are not cut from it.  Null and empty html give an empty
    text; pages without a readable host share the host ''.  Null ids stay null, repeated
    rows give repeated results, an empty table an empty result; other columns are not read."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host"),
        F.xxhash64("page_id", "url", "html").alias("page"),
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [template_hashes(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64()))], names=["page", "host", "hashes"])

    def extracted(batch: pa.RecordBatch, recurring: Iterable[Iterable[int] | None]) -> pa.RecordBatch:
        texts = [main_text(x, r if isinstance(r, set) else set(r or ())) for x, r in zip(batch.column(2).to_pylist(), recurring)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )

    out = "page_id long, url string, text string, n_chars long"
    trees = (
        rows.select("page", "host", "html")
        .mapInArrow(first, "page long, host string, hashes array<bigint>")
        .select("page", "host", F.explode("hashes").alias("hash"), F.pmod("page", F.lit(salts)).cast("int").alias("salt"))
    )
    spark = pages.sparkSession
    scratch = Scratch(spark, "templates")
    # Only on hosts with more pages than these is the share more than least_pages.
    large = scratch.cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") * least_share > least_pages))
    side = F.broadcast(large) if large.count() <= sent_templates else large
    counted = trees.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    templates = scratch.cut(counted.join(side, "host", "left").filter(F.col("n") >= F.coalesce(F.col("pages") * least_share, F.lit(0.0))).select("host", "hash"))
    if templates.count() <= sent_templates:
        known: dict[str, set[int]] = {}
        for r in templates.collect():
            known.setdefault(r["host"], set()).add(r["hash"])
        sent = spark.sparkContext.broadcast(known)

        def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield extracted(batch, (sent.value.get(h) for h in batch.column(3).to_pylist()))

        return rows.select("page_id", "url", "html", "host").mapInArrow(by_host, out)

    def by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield extracted(batch, batch.column(3).to_pylist())

    wide = templates.select("host", "hash", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    # A page has a bounded set: its own subtrees.
    per_page = trees.join(wide, ["host", "hash", "salt"]).groupBy("page").agg(F.collect_set("hash").alias("recurring"))
    return rows.join(per_page, "page", "left").select("page_id", "url", "html", "recurring").mapInArrow(by_page, out)
