"""Main text of web pages, without the templates of their sites.

Every page becomes a tree of elements. What markup itself names as menu, header, footer,
sidebar, notice, advert, form or comment goes by rules. Of what remains, the subtrees that
may belong to a template are hashed, each hash is counted in Spark over the pages of its
host, and those that recur on many pages are deleted.

Paragraphs, headings, lists and tables of an article are never taken for a template, as
copies of an article and quoted passages recur too. Pages of one host with the same text
count as one.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_dir
from .common import BATCH_BYTES, released, slices, utf8

#: A subtree belongs to a template if so many pages of its host hold it,
LEAST_PAGES = 5
#: and this share of them.
SHARE = 0.01

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th "
    "details summary address hr".split()
)
#: Elements whose end a following sibling implies, up to the elements that hold them.
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
HOLDERS = frozenset("ul ol dl table html body article section div td th template select".split())
#: End tags do not close elements beyond these.
BARRIERS = frozenset("table td th caption template object".split())

#: Elements that are never part of an article.
FURNITURE = frozenset(
    "head script style noscript template svg math iframe object embed video audio canvas map title textarea nav aside "
    "footer form button select input datalist dialog menu noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id that name furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsors sponsored promo promotion promoted banner "
    "menu submenu dropdown nav navbar topnav sidenav subnav navigation breadcrumb breadcrumbs sidebar aside rail footer cookie "
    "cookies consent gdpr notice notices alert announcement paywall popup modal overlay newsletter subscribe signup login share "
    "sharing social comment comments disqus discussion respond replies reply related recommended widget toolbar topbar "
    "pagination pager masthead".split()
)
#: Those that count on an article element too.
ASIDE_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())
#: These are no mere wrapper of an article.
NEVER_WRAP = frozenset("head nav aside footer template noscript dialog".split())
#: A name with one of these says what the element has, not what it is.
HAVING = frozenset("has with no without hide show".split())
#: Names of the element that holds an article, where no element says so.
CONTENT = frozenset(
    "article article-body article-content article-text articlebody post post-content post-body entry entry-content story "
    "story-body main main-content maincontent content page-content".split()
)

_OPENING = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
#: The rest of a tag; quotes matter after an equals sign only.
_TAIL = re.compile(r"""((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _attributes(tail: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tail):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


class Page:
    """The elements of one page in page order; number 0 holds all others."""

    def __init__(self, markup: str):
        self.tag, self.parent, self.attributes = [""], [-1], [{}]
        #: Texts and numbers of child elements, in order.
        self.parts: list[list] = [[]]
        self._parse(markup)
        self._mark()

    def _parse(self, markup: str) -> None:
        tag, parent, attributes, parts = self.tag, self.parent, self.attributes, self.parts
        stack, is_open, at = [0], {}, 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                is_open[tag[stack.pop()]] -= 1

        def depth_of(names: tuple[str, ...], barriers: frozenset) -> int:
            """Depth of the nearest open element of ``names``, 0 if there is none before a barrier."""
            if not any(is_open.get(n) for n in names):
                return 0
            for depth in range(len(stack) - 1, 0, -1):
                if tag[stack[depth]] in names:
                    return depth
                if tag[stack[depth]] in barriers:
                    return 0
            return 0

        while at < len(markup):
            found = _OPENING.search(markup, at)
            if found is None:
                parts[stack[-1]].append(markup[at:])
                return
            if found.start() > at:
                parts[stack[-1]].append(markup[at : found.start()])
            if found[3]:
                if markup.startswith((">", "->"), found.end()):
                    at = markup.index(">", found.end()) + 1
                    continue
                end = _COMMENT_END.search(markup, found.end())
                if end is None:
                    return
                at = end.end()
                continue
            if not found[2]:
                at = markup.find(">", found.end()) + 1
                if not at:
                    return
                continue
            tail = _TAIL.match(markup, found.end())
            if tail is None:
                return  # the page ends within a tag
            at = tail.end()
            name = found[2].lower()
            if found[1]:
                if name in INLINE:
                    depth = len(stack) - 1 if is_open.get(name) else 0
                    while tag[stack[depth]] in INLINE and tag[stack[depth]] != name:
                        depth -= 1
                    if tag[stack[depth]] == name:
                        close(depth)
                elif depth := depth_of((name,), BARRIERS if name not in BARRIERS else frozenset({"table"} - {name})):
                    close(depth)
                elif name == "br":
                    parts[stack[-1]].append(" ")
                continue
            if name == "br":
                parts[stack[-1]].append(" ")
                continue
            if name not in INLINE and (depth := depth_of(("p",), BARRIERS)):
                close(depth)
            if name in SIBLINGS and (depth := depth_of(SIBLINGS[name], HOLDERS - set(SIBLINGS[name]))):
                while depth > 1 and tag[stack[depth - 1]] in SIBLINGS[name]:
                    depth -= 1
                close(depth)
            new = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            attributes.append(_attributes(tail[1]) if "=" in tail[1] or "hidden" in tail[1] else {})
            parts.append([])
            parts[stack[-1]].append(new)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(markup, at)
                if end is None:
                    return
                tail = _TAIL.match(markup, end.end())
                if tail is None:
                    return
                at = tail.end()
            elif name not in VOID:
                stack.append(new)
                is_open[name] = is_open.get(name, 0) + 1

    def _names(self, i: int) -> Iterator[set[str]]:
        """Words of each class and of the id, without names of what the element has."""
        for key in ("class", "id"):
            for token in self.attributes[i].get(key, "").split():
                pieces = {p.lower() for p in _PIECE.findall(token)}
                if not pieces & HAVING:
                    yield pieces

    def _is_furniture(self, i: int, in_article: bool) -> bool:
        tag, attributes = self.tag[i], self.attributes[i]
        if tag in FURNITURE or (tag == "header" and not in_article):
            return True
        if not attributes:
            return False
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return True
        if "style" in attributes and re.search(r"display\s*:\s*none", attributes["style"], re.I):
            return True
        if tag in ("html", "body", "main"):
            return False
        if attributes.get("role", "").lower() in ROLES:
            return True
        names = ASIDE_ARTICLES if tag == "article" else NAMES if in_article else NAMES | {"header"}
        return any(pieces & names for pieces in self._names(i))

    def _wrappers(self, of: set[int]) -> set[int]:
        """Elements that hold all elements ``of``."""
        holding: dict[int, int] = {}
        for i in of:
            while (i := self.parent[i]) > 0:
                holding[i] = holding.get(i, 0) + 1
        return {i for i, n in holding.items() if n == len(of) and self.tag[i] not in NEVER_WRAP}

    def _mark(self) -> None:
        """``gone``: in furniture; ``roots``: the elements of the main text; ``inside``: in one of them."""
        n = len(self.tag)
        articles = {i for i in range(n) if self.tag[i] == "article"}
        mains = {
            i for i in range(n)
            if self.tag[i] == "main" or (a := self.attributes[i])
            and (a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody")
        }
        named = set()
        for i in range(n):
            if (a := self.attributes[i]) and self.tag[i] not in INLINE | {"html", "body"}:
                if CONTENT.intersection(f"{a.get('class', '')} {a.get('id', '')}".lower().split()):
                    named.add(i)
        wrappers = self._wrappers({i for i in articles if not self._is_furniture(i, True)} or mains)
        self.gone, within = [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            within[i] = within[up] or i in articles or i in mains
            self.gone[i] = self.gone[up] or (i not in wrappers and self._is_furniture(i, within[up]))
        self._measure()
        self.roots = [0]
        for tier in (articles, mains, named):
            left = {i for i in tier if not self.gone[i]}
            roots = sorted(left - {i for i in left if self._below(i, left)})
            if any(self.length[i] for i in roots):
                self.roots = roots
                break
        within_text = set(self.roots)
        self.inside = [False] * n
        for i in range(n):
            self.inside[i] = i in within_text or (i > 0 and self.inside[self.parent[i]])
        self.explicit = self.roots != [0]

    def _below(self, i: int, others: set[int]) -> bool:
        while (i := self.parent[i]) > 0:
            if i in others:
                return True
        return False

    def _measure(self) -> None:
        """``length``: characters below each element that are not blank and not gone."""
        self.length = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):  # children have larger numbers
            if not self.gone[i]:
                self.length[i] = sum(
                    len("".join(p.split())) if isinstance(p, str) else self.length[p] for p in self.parts[i]
                )

    def candidates(self) -> list[int]:
        """Elements with text that may belong to a template."""
        whole, roots = sum(self.length[r] for r in self.roots), set(self.roots)
        out = []
        for i in range(1, len(self.tag)):
            tag = self.tag[i]
            if self.gone[i] or not self.inside[i] or i in roots or tag in INLINE or tag in ("html", "body"):
                continue
            if self.explicit and tag in PROSE:
                continue
            n = self.length[i]
            if n and not (self.explicit and 2 * n > whole):
                out.append(i)
        return out

    def hashes(self, elements: list[int]) -> dict[int, int]:
        """A 64-bit hash of each element's subtree: tags, names and texts, blanks set aside."""
        needed, todo = set(), list(elements)
        while todo:
            i = todo.pop()
            if i not in needed:
                needed.add(i)
                todo += [p for p in self.parts[i] if not isinstance(p, str)]
        done: dict[int, bytes] = {}
        for i in sorted(needed, reverse=True):
            names = " ".join(sorted(self.attributes[i].get("class", "").split()))
            made = hashlib.blake2b(f"{self.tag[i]}\0{names}\0{self.attributes[i].get('id', '')}\0".encode(), digest_size=8)
            for part in self.parts[i]:
                if not isinstance(part, str):
                    made.update(b"\1" + done[part])
                elif words := part.split():
                    made.update(b"\2" + " ".join(words).encode())
            done[i] = made.digest()
        return {i: int.from_bytes(done[i], "little", signed=True) for i in elements}

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """Blocks of the main text, without elements of a hash in ``template``."""
        deleted = set()
        if template:
            deleted = {i for i, h in self.hashes(self.candidates()).items() if h in template}
        blocks, line = [], []

        def flush() -> None:
            if words := html.unescape("".join(line)).split():
                blocks.append(" ".join(words))
            line.clear()

        for root in self.roots:
            todo: list = [root]
            while todo:
                part = todo.pop()
                if part is None:
                    flush()
                elif isinstance(part, str):
                    line.append(part)
                elif self.tag[part] in INLINE:
                    if not self.gone[part]:
                        todo += reversed(self.parts[part])
                else:
                    flush()
                    if not self.gone[part] and part not in deleted:
                        todo.append(None)
                        todo += reversed(self.parts[part])
            flush()
        return "\n\n".join(blocks)


def _text_print(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _parts(batch: pa.RecordBatch, of: int) -> Iterator[pa.RecordBatch]:
    for first, stop in slices(utf8(batch.column(of))[1], BATCH_BYTES):
        yield batch.slice(first, stop - first)


def host(url: Column) -> Column:
    """Host of a URL in small letters, without user and port; '' where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, print, subtree) of each candidate subtree of ``pages`` (host, page, html).

    ``print`` is the hash of the text that the rules alone leave, ``subtree`` that of the
    subtree; one that a page holds several times counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                out: list[list] = [[], [], [], []]
                for site, page, markup in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    of = Page(markup)
                    found = set(of.hashes(of.candidates()).values())
                    if found:
                        known = _text_print(of.text())
                        for column, value in zip(out, ([site], [page], [known], None), strict=True):
                            column += value * len(found) if value else found
                types = (pa.string(), pa.binary(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "print", "subtree"])

    return pages.select("host", "page", "html").mapInArrow(
        released(run), "host string, page binary, print bigint, subtree bigint"
    )


def templates(found: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, subtree) of the subtrees that recur on many pages of their host."""
    pages = found.groupBy("host", "print").count().groupBy("host").agg(F.count("*").alias("pages"))
    on = found.groupBy("host", "subtree", "print").count().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    # Few subtrees recur, so the hosts of those that do are the small side.
    many = on.filter(F.col("n") >= least)
    return many.join(pages, "host").filter(F.col("n") >= F.col("pages") * share).select("host", "subtree")


def main_text(
    pages: DataFrame, url: str = "url", markup: str = "html", into: str = "text", least: int = LEAST_PAGES, share: float = SHARE
) -> DataFrame:
    """``pages`` with the main text of column ``markup`` in column ``into``, which is replaced.

    The text of an element between block boundaries is a block: its character references
    are decoded, its white space becomes single blanks, blank ends go, and blocks without
    any characters are left out. Blocks are joined by two line feeds. The main text is that
    of the article elements; of the main element where there is none; of an element named
    as content; or of all the page. NULL and empty pages have the text ''.

    A subtree is deleted if at least ``least`` pages of its host hold it, and ``share`` of
    those with any candidate; pages of equal text count once, pages without a host in their
    URL are not compared. Repeated rows and NULL ids need nothing special, an empty table
    gives none, broken markup ends where the page does.
    """
    digest = F.unhex(F.md5(F.coalesce(markup, F.lit("")).cast("binary")))
    found = (
        pages.select(host(F.col(url)).alias("host"), digest.alias("page"), F.coalesce(markup, F.lit("")).alias("html"))
        .filter("host <> ''")
    )
    spark = pages.sparkSession
    # Stored as files, so that their size is known and a hot host's rows can be split in the joins.
    subtrees(found).write.parquet(path := work_dir(spark, "subtrees"))
    held = spark.read.parquet(path)
    templates(held, least, share).write.parquet(path := work_dir(spark, "templates"))
    recurring = spark.read.parquet(path)
    of_page = (
        held.join(recurring, ["host", "subtree"]).groupBy(F.col("host").alias("__host"), F.col("page").alias("__page"))
        .agg(F.sort_array(F.collect_set("subtree")).alias("__template"))
    )
    of_page.write.parquet(path := work_dir(spark, "page-templates"))
    of_page = spark.read.parquet(path)
    kept = [c for c in pages.columns if c != into]
    same = (host(F.col(url)) == F.col("__host")) & (digest == F.col("__page"))
    source = pages.join(of_page, same, "left").select(
        *(F.col(f"`{c}`") for c in kept), "__template", F.coalesce(markup, F.lit("")).alias("__html")
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(kept) + 1):
                rows = zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist(), strict=True)
                texts = [Page(m).text(frozenset(t or ())) for t, m in rows]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, into])

    return source.mapInArrow(released(run), ", ".join([*fields, f"`{into}` string"]))


def op12_main_text(pages: DataFrame) -> DataFrame:
    """Main text of each whole page of ``pages``, and its code points."""
    found = main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
