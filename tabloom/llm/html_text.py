"""Main text of HTML pages, without the templates of their site.

Each page is read once into element subtrees. Every block subtree of the whole page is hashed (its element, texts and inner
hashes); Spark counts on how many pages of a host each hash is, pages of equal text counting once, and subtrees that
recur across many pages of the host are deleted: inside an article's own text those on at least half of them,
elsewhere those on a tenth, and on `least` pages in any case. Of what is left, that goes which says of itself that it is no content
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments; by element, role, class or id),
and if the page has an article (or a main element) only that is read. How many blocks each step took is returned.

The pages are read twice (count, then extract) rather than stored parsed. Counts are pre-aggregated before their
shuffle, so a host with a third of all pages is spread. A host has at most (blocks of a page / share)
recurring subtrees; they are broadcast if the table is small (`SMALL` rows, counted), and joined by host, salted
over `SALTS`, if not.

Defined results: a null html has an empty text, a null url is a host of its own; equal rows get equal results;
broken mark-up is read as far as it goes (open elements end with the page); an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_schema, rows_of, written

#: Elements that are never main text.
DROPPED = frozenset("head script style noscript template nav footer aside form iframe svg canvas object embed select button textarea input dialog menu audio video map".split())
#: Elements that stand in a line of text; they end no block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no mark-up.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that end an open element of the kinds named.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",)}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that CLOSES does not reach out of.
HOLDS = frozenset("ul ol dl table select article section div main body".split())
#: Words in a class or id, and roles, that say a subtree is no content.
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription signup popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommended recommendations share sharing social comment comments disqus reply replies respond pagination pager login toolbar banner footer masthead skip notices banners sidebars menus widgets footers commentlist adbox adslot adsbygoogle cookiebar cookiebanner sidenav topnav subnav sharebar relatedposts alert alerts disclaimer".split())
HEADERS = frozenset("header site-header page-header top-header main-header global-header topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())

#: Rows of recurring subtrees up to which they are broadcast, and salts beyond it.
SMALL, SALTS = 100_000, 32
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _no_content(tag: str, attributes: str, inside: bool) -> bool:
    """The element says that it is no content; inside: of an article."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            for one in value.split():
                words = {x.lower() for x in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", one) if x}
                if one.lower() in HEADERS and not inside or words & WORDS:
                    return True
        elif name == "role" and value.strip().lower() in ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


#: What an open element's text is: content, a block that says it is none, or none of a line (which is passed over).
CONTENT, LISTED, PASSED = 0, 1, 2


class Page:
    """One page as blocks of text, each with the subtrees it lies in.

    blocks: texts in page order; listed: whether a block says of itself that it is no content; subtrees: (hash, first block,
    block behind, in an article's own text) of each block element with text, inner before outer.
    """

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.listed: list[bool] = []
        self.in_article: list[bool] = []
        self.in_main: list[bool] = []
        self.subtrees: list[tuple[int, int, int, bool]] = []
        self._held: list[str] = []
        #: Open elements: [tag, first block, parts of the hash, kind of text, article depth, main depth]
        self._open: list[list] = [["", 0, [], CONTENT, 0, 0]]
        self._read(source)

    def _text(self, text: str) -> None:
        if self._open[-1][3] != PASSED:
            self._held.append(html.unescape(text) if "&" in text else text)

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            self._held = []
            if text:
                top = self._open[-1]
                self.blocks.append(text)
                self.listed.append(top[3] == LISTED)
                self.in_article.append(top[4] > 0)
                self.in_main.append(top[5] > 0)
                top[2].append(text)

    def _enter(self, tag: str, attributes: str) -> None:
        top = self._open[-1]
        kind, article, main = top[3], top[4], top[5]
        if tag in INLINE:
            if kind == CONTENT and _no_content(tag, attributes, article > 0 or main > 0):
                self._open.append([tag, len(self.blocks), [], PASSED, article, main])
            return
        self._flush()
        if kind == CONTENT:
            if _no_content(tag, attributes, article > 0 or main > 0):
                kind = LISTED
            main_role = "main" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes) is not None
            article, main = article + (tag == "article"), main + (tag == "main" or main_role)
        self._open.append([tag, len(self.blocks), [], kind, article, main])

    def _leave(self) -> None:
        tag, first, parts, kind, article, _ = self._open[-1]
        if not (tag in INLINE):
            self._flush()
        self._open.pop()
        if kind != PASSED and len(self.blocks) > first:
            value = xxhash.xxh64_intdigest("\x00".join((tag, *parts)).encode("utf-8", "surrogatepass")) - (1 << 63)
            self.subtrees.append((value, first, len(self.blocks), article > 0 and kind == CONTENT))
            self._open[-1][2].append(f"\x01{value}")

    def _close(self, tag: str) -> None:
        """Ends the innermost open element of the name and all inside it; without one, nothing."""
        for at in range(len(self._open) - 1, 0, -1):
            if self._open[at][0] == tag:
                while len(self._open) > at:
                    self._leave()
                return

    def _imply(self, tag: str) -> None:
        if tag in ENDS_P and any(x[0] == "p" for x in self._open[-3:]):
            self._close("p")
        for _ in range(3):
            found = None
            for x in reversed(self._open[1:]):
                if x[0] in CLOSES.get(tag, ()):
                    found = x[0]
                    break
                if x[0] in HOLDS:
                    break
            if not found:
                return
            self._close(found)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        for m in iter(lambda: _TAG.search(source, at), None):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            cdata, slash, name, attributes = m.groups()
            if name is None:
                if cdata:
                    self._text(cdata)
                continue
            tag = name.lower()
            if slash:
                if tag == "br":
                    self._held.append(" ")
                elif tag not in VOID:
                    if tag not in INLINE:
                        self._close(tag)
                    elif self._open[-1][0] == tag:
                        self._leave()
                continue
            if tag in VOID:
                if tag == "br":
                    self._held.append(" ")
                elif tag == "hr":
                    self._flush()
                continue
            self._imply(tag)
            if tag in RAW:  # its text is no mark-up; of all of them only a title has words, and that stands in the head
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>|\\Z", re.I).search(source, at)
                at = stop.end()
                continue
            if attributes.endswith("/") and tag not in INLINE and "svg" in (x[0] for x in self._open):
                continue
            self._enter(tag, attributes)
        if at < end:
            self._text(source[at:])
        while len(self._open) > 1:
            self._leave()
        self._flush()

    def _scope(self) -> list[bool]:
        """Which blocks the lists leave: of those that don't say they are no content, those in articles, else those in main, else all."""
        own = [not x for x in self.listed]
        for inside in (self.in_article, self.in_main):
            if any(a and b for a, b in zip(own, inside, strict=True)):
                return [a and b for a, b in zip(own, inside, strict=True)]
        return own

    def cleared(self, recurring: frozenset[int] | set[int] = frozenset()) -> tuple[str, int, int]:
        """The main text; how many blocks lie in recurring subtrees, and how many more the lists took."""
        kept = [True] * len(self.blocks)
        for value, first, behind, _ in self.subtrees if recurring else ():
            if value in recurring:
                kept[first:behind] = [False] * (behind - first)
        text = [x for x, a, b in zip(self.blocks, kept, self._scope(), strict=True) if a and b]
        return " ".join(text), len(kept) - sum(kept), sum(kept) - len(text)

    def text(self, recurring: frozenset[int] | set[int] = frozenset()) -> str:
        return self.cleared(recurring)[0]

    def hashes(self) -> dict[int, bool]:
        """Hashes of all subtrees, and whether they lie in an article's own text."""
        out: dict[int, bool] = {}
        for value, _, _, inside in self.subtrees:
            out[value] = out.get(value, False) or inside
        return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 5, share: float = 0.1, article_share: float = 0.5) -> DataFrame:
    """Recurring subtrees: host, hashes (array)."""
    ddl = "host string, hash bigint, inside boolean, page bigint"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            hosts, values, inside, pages_ = [], [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                own = xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass")) - (1 << 63)
                found = {0: False} | page.hashes()  # 0: the page itself
                hosts += [host] * len(found)
                values += found.keys()
                inside += found.values()
                pages_ += [own] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((hosts, values, inside, pages_), schema.types, strict=True)], schema=schema)

    rows = pages.select(host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html")).mapInArrow(run, ddl)
    counts = rows.groupBy("host", "hash", "page").agg(F.max("inside").alias("inside")).groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("inside").alias("inside")).where("n >= %d" % least)
    counts = written(counts, "subtrees")
    # the rows of a host's pages themselves tell how many there are; a host with fewer than `least` has no templates
    total = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    kept = counts.where("hash <> 0").join(total, "host").where(F.col("n") >= F.when(F.col("inside"), F.lit(article_share)).otherwise(F.lit(share)) * F.col("pages"))
    return kept.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **limits) -> DataFrame:
    """id, url, text, n_chars, n_blocks, n_template and n_listed (blocks of the page, and those that went as templates and by the lists) of every page."""
    found = written(templates(pages, id_col, url_col, html_col, **limits), "templates")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"), host_of(F.col(f"`{url_col}`").cast("string")).alias("host"))
    size = found.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    if size <= SMALL:
        joined = rows.join(F.broadcast(found), "host", "left")  # at most SMALL hashes
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    ddl = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint, n_blocks int, n_template int, n_listed int"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            pages_ = [(p, p.cleared(frozenset(hashes or ()))) for source, hashes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) for p in (Page(source),)]
            texts = [x for _, (x, _, _) in pages_]
            counts = [[len(p.blocks) for p, _ in pages_], [x[1] for _, x in pages_], [x[2] for _, x in pages_]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), *(pa.array(x, pa.int32()) for x in counts)], schema=schema)

    return joined.select("id", "url", "html", "hashes").mapInArrow(run, ddl)
