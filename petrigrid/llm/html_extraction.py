"""Main text of web pages by consensus of each host's pages.

A pass over the pages reads every page into blocks of text under a tree of containers and finds the container
that holds its main text. That container votes for its generalised path (tags and classes, numbers removed).
Spark counts the votes per host; paths with enough of them win. The second pass reads each page again and
takes the blocks under the host's best winning path that the page has; a page without one keeps its own
container. Votes are added up before they are shuffled, and the winners of a host are few by definition.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Share of a host's voting pages that a path needs; at most 1 / SHARE paths can have it.
SHARE = 0.05
#: Share of a container's text that a child must hold to stand for it.
HOLDS = 0.9

_SET = lambda s: frozenset(s.split())
CONTAINERS = _SET("html body div section article main table tbody thead tfoot tr td th ul ol dl blockquote figure header footer nav aside form fieldset details center")
LEAVES = _SET("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption summary legend option hr")
VOID = _SET("area base br col embed hr img input link meta param source track wbr")
RAW = _SET("script style title textarea xmp iframe noembed noframes")
#: Elements and roles that never hold main text.
ASIDE = _SET("nav aside footer form script style noscript template iframe svg button select textarea input dialog head title object canvas audio video math map noframes noembed menu")
ROLES = _SET("navigation banner contentinfo complementary search form menu menubar dialog alert")
#: Words in classes and ids that mark menus, adverts, notices, comments and the like. A mark counts only where the
#: element holds less than a share of the page's text: a larger one if the word stands alone, a smaller one if it is part
#: of a longer name; never around an article or the like, and not where the name says what is absent or in use.
MARKS = _SET(
    "ad ads advert adverts advertisement advertising adbox adsense banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond replies "
    "share sharing social related recommended recommendations promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login widget "
    "pagination pager toolbar copyright legal disclaimer skip"
)
ALONE, WITHIN = 0.8, 0.5
STATES = re.compile(r"(?:no|not|non|with|without|has|is|hide|show)[-_]")
#: Marks that mean a page part outside of the article only.
OUTSIDE = _SET("header masthead banner")
HEADINGS = _SET("h1 h2 h3 h4 h5 h6")
#: A start tag that ends an open paragraph or list item of its kind.
_ENDS = {"li": _SET("li"), "dt": _SET("dt dd"), "dd": _SET("dt dd"), "tr": _SET("tr td th"), "td": _SET("td th"), "th": _SET("td th"), "option": _SET("option")}
_STOPS = {"li": _SET("ul ol"), "dt": _SET("dl"), "dd": _SET("dl"), "tr": _SET("table"), "td": _SET("tr table"), "th": _SET("tr table"), "option": _SET("select")}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORDS = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]+")
_NEEDED = re.compile(r"class|id|role|hidden|itemprop", re.I)


class Page:
    """A page's containers (parent, generalised path, own tag) and text blocks in order.

    Paths are numbered in a tree of their own, so a container holds one number however deep it lies.
    """

    def __init__(self, source: str):
        self.parent, self.path, self.tag, self.article = [-1], [0], [""], [False]
        self.steps: dict[tuple[int, str], int] = {}  # (path, step) -> path
        self.names: list[tuple[int, str]] = [(-1, "")]
        self.marks: list[tuple[int, float]] = []  # mark around it (-1: none), share from which it does not count
        self.blocks: list[tuple[int, str, int, bool]] = []  # container, text, linked characters, heading
        self._around: list[int] = []  # each block's innermost mark
        self._held: set[int] = set()  # marks around an article
        self._read(source)
        self._settle()

    def _settle(self) -> None:
        """Drop the blocks under marks that count."""
        size = [0] * len(self.marks)
        for m, (_, text, linked, _) in zip(self._around, self.blocks, strict=True):
            if m >= 0:
                size[m] += len(text) - linked
        total = sum(len(t) - k for _, t, k, _ in self.blocks)
        off = [False] * len(self.marks)
        for m in range(len(self.marks) - 1, -1, -1):  # a mark comes after the one around it
            up = self.marks[m][0]
            if up >= 0:
                size[up] += size[m]
                if m in self._held:
                    self._held.add(up)
        for m, (up, share) in enumerate(self.marks):
            off[m] = (up >= 0 and off[up]) or (m not in self._held and size[m] < share * total) or not size[m]
        self.blocks = [b for m, b in zip(self._around, self.blocks, strict=True) if m < 0 or not off[m]]

    def _step(self, path: int, name: str) -> int:
        at = self.steps.get((path, name))
        if at is None:
            at = self.steps[path, name] = len(self.names)
            self.names.append((path, name))
        return at

    def named(self, container: int) -> str:
        """The path of a container, written out."""
        out, at = [], self.path[container]
        while at > 0:
            at, name = self.names[at]
            out.append(name)
        return "".join("/" + n for n in reversed(out))

    def _read(self, s: str) -> None:
        # an open element: tag, container, dropped, is a block, mark
        stack = [("", 0, False, True, -1)]
        opened: dict[str, int] = {}
        parts: list[str] = []
        linked = [0, 0]  # open links, linked characters
        heading = [False]

        def flush() -> None:
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text and not stack[-1][2]:
                    self.blocks.append((stack[-1][1], text, min(linked[1], len(text)), heading[0]))
                    self._around.append(stack[-1][4])
                parts.clear()
            linked[1] = 0
            heading[0] = False

        def close(depth: int) -> None:
            while len(stack) > depth:
                if stack[-1][3]:
                    flush()
                if stack[-1][0] == "a":
                    linked[0] = max(0, linked[0] - 1)
                opened[stack[-1][0]] -= 1
                stack.pop()

        def add(text: str) -> None:
            if not stack[-1][2]:
                parts.append(text)
                if linked[0]:
                    linked[1] += len(text)
                if not heading[0]:
                    heading[0] = any(e[0] in HEADINGS for e in stack[-3:])

        pos, n = 0, len(s)
        while pos < n:
            at = s.find("<", pos)
            if at < 0:
                add(s[pos:])
                break
            if at > pos:
                add(s[pos:at])
            if s.startswith("<!--", at):
                end = s.find("-->", at + 4)
                pos = n if end < 0 else end + 3
                continue
            if s.startswith(("<!", "<?"), at):
                end = s.find(">", at)
                pos = n if end < 0 else end + 1
                continue
            m = _TAG.match(s, at) or _LOOSE.match(s, at)
            if not m:
                if s.find(">", at) < 0:  # no tag can follow
                    add(s[at:])
                    break
                add("<")
                pos = at + 1
                continue
            pos = m.end()
            name = m[2].lower()
            if m[1]:
                if not opened.get(name):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if stack[k][3] and stack[k][0] in CONTAINERS and name not in CONTAINERS and name not in LEAVES:
                        break
                continue
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(s, pos)
                if not end:
                    break
                close_at = s.find(">", end.start())
                pos = n if close_at < 0 else close_at + 1
                continue
            block = name in CONTAINERS or name in LEAVES
            if name == "br":
                add(" ")
                continue
            if block:
                for k in range(len(stack) - 1, 0, -1) if opened.get("p") else ():  # a block ends an open paragraph
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in CONTAINERS:
                        break
                if name in _ENDS and any(map(opened.get, _ENDS[name])):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in _ENDS[name]:
                            close(k)
                            break
                        if stack[k][0] in _STOPS[name]:
                            break
                flush()
            if name in VOID or m[3].endswith("/") and not block:
                continue
            drop, where, mark = stack[-1][2], stack[-1][1], stack[-1][4]
            attrs = {}
            if _NEEDED.search(m[3]):
                attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "").lower() for a in _ATTRIBUTE.finditer(m[3])}
            inside = self.article[where]
            drop = drop or name in ASIDE or (name == "header" and not inside) or "hidden" in attrs or attrs.get("role") in ROLES
            body = attrs.get("itemprop") == "articlebody"
            main = name in ("article", "main") or body
            if not drop and ("class" in attrs or "id" in attrs) and name not in ("html", "body", "main"):
                share = _marked(f"{attrs.get('class', '')} {attrs.get('id', '')}", inside, name == "article")
                if share:
                    self.marks.append((mark, share))
                    mark = len(self.marks) - 1
            if main and mark >= 0 and not drop:
                outer = self.marks[mark][0] if name == "article" and stack[-1][4] != mark else mark
                if outer >= 0:
                    self._held.add(outer)
            if name == "a":
                linked[0] += 1
            if name in CONTAINERS and name != "html":
                cls = ".".join(sorted(_NUMBER.sub("#", c) for c in attrs.get("class", "").split()))
                self.parent.append(where)
                self.path.append(self._step(self.path[where], f"{name}{'.' if cls else ''}{cls}".replace("/", "|")))
                self.tag.append(name + ("*" if body else ""))
                self.article.append(inside or main)
                where = len(self.path) - 1
            stack.append((name, where, drop, block, mark))
            opened[name] = opened.get(name, 0) + 1
        close(1)
        flush()

    def main(self) -> int | None:
        """The container of the main text: from the root down while one child holds nearly all of it and its headings; an article is not entered."""
        n = len(self.path)
        score, heads = [0.0] * n, [0] * n
        for c, text, linked, heading in self.blocks:
            score[c] += len(text) - linked
            heads[c] += heading
        for c in range(n - 1, 0, -1):
            score[self.parent[c]] += score[c]
            heads[self.parent[c]] += heads[c]
        if score[0] <= 0:
            return None
        children: list[list[int]] = [[] for _ in range(n)]
        for c in range(1, n):
            children[self.parent[c]].append(c)
        at = 0
        while True:
            if self.tag[at] == "article" or self.tag[at].endswith("*"):
                return at
            best = max(children[at], key=lambda c: (score[c], -c), default=None)
            if best is None:
                return at
            named = self.tag[best] in ("article", "main") or self.tag[best].endswith("*")
            if score[best] < (0.4 if named else HOLDS) * score[at] or not named and heads[best] < heads[at]:
                return at
            at = best

    def under(self, path: str) -> str | None:
        """Text of the containers of that path, in page order; None if the page has none."""
        at: int | None = 0
        for name in path.split("/")[1:]:
            at = self.steps.get((at, name))
            if at is None:
                return None
        inside = [p == at for p in self.path]
        for c in range(1, len(inside)):
            inside[c] = inside[c] or inside[self.parent[c]]
        return "\n".join(t for c, t, _, _ in self.blocks if inside[c])


def _marked(names: str, inside: bool, article: bool) -> float:
    """Share of the page's text from which the marks of these class and id names do not count; 0 without a mark."""
    share = 0.0
    for token in names.split():
        if STATES.match(token):
            continue
        words = _WORDS.findall(token)
        hit = [w for w in words if w in MARKS and not (inside and w in OUTSIDE) and not (article and not w.startswith("comment"))]
        if hit:
            share = max(share, ALONE if len(words) == 1 or any(w.startswith("comment") for w in hit) else WITHIN)
    return share


def host(url: F.Column) -> F.Column:
    """Lower-case host of a url, without a leading www; empty if there is none."""
    return F.lower(F.regexp_replace(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), r"^(?i:www\.)", ""))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path`` of the main container of each page that has text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for source in b.column(1).to_pylist():
                page = Page(source or "")
                at = page.main()
                paths.append(None if at is None else page.named(at))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["host", "path"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string").where("path is not null")


def winners(voted: DataFrame, share: float = SHARE) -> DataFrame:
    """``host, paths``: winning paths of each host, most votes first, then by name."""
    counts = voted.groupBy("host", "path").agg(F.count("*").alias("n"))
    total = counts.groupBy("host").agg(F.sum("n").alias("all"))
    won = counts.join(total, "host").where(F.col("n") >= share * F.col("all"))
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "path"))), lambda s: s["path"]).alias("paths"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", share: float = SHARE) -> DataFrame:
    """``page_id, url, text`` per row of ``pages``.

    Null and empty pages, and those without main text, have an empty text. Pages without a host vote together.
    Repeated rows vote and are answered one by one; equal votes are settled by the paths' names. Other columns of
    ``pages`` are ignored, so clashing names do no harm. White space inside a block (that of Unicode) becomes one
    space, line breaks included; blocks are joined by a line feed.
    """
    C.prepare(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), host(F.col(url)).alias("host"), F.col(source).cast("string").alias("html"))
    chosen = C.stored(winners(votes(rows), share), "host-paths")
    schema = T.StructType([*rows.select("page_id", "url").schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                page = Page(source or "")
                found = next((t for t in map(page.under, paths or []) if t), None)
                if found is None:
                    at = page.main()
                    found = "" if at is None else page.under(page.named(at))
                texts.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.join(chosen, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, schema)
