"""Main text of web pages by the template of their host.

After Arasu and Garcia-Molina, "Extracting Structured Data from Web Pages" (2003). Tokens of
a page are its elements (told by their path with classes and ids, counted by opening tags)
and its blocks of text (told by their element and words). Tokens of a host that
occur equally often on each of its pages share an occurrence vector and are one class. A
class of enough pages is valid; it nests in the class of the element around its own. Text
in the class of an element around it comes wherever that element does: it is template. All
other text fills the slots between.

The main slot is the innermost element that no page has twice and that holds most of the
text in slots, grown to the innermost element around all slots of its pages, or to the
``article`` or ``main`` around it. Vectors do not tell an article from what else changes from
page to page (menus, adverts, comments), so elements whose tag, role or class says that they
are such are set aside first. Copies of one page have all text in common: if most of the
main slot is template, its text is kept. What the slot was found by is in the result: a
host with too few different pages, and a page without its host's slot, fall back on
``article``, ``main`` and the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.scratch import Scratch

#: A template needs so many pages of a host, and its tags so large a share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: The main slot holds at least this share of the text that is not set aside by name.
MAIN_SHARE = 0.5
#: Elements that hold other blocks. Paragraphs, headings, lists and tables are parts of a slot.
_HOLDERS = frozenset("article main section div body td center details figure blockquote".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A main slot is looked for so many elements deep; text further in belongs to the last of them.
DEPTH = 64
#: Bytes of the table of containers up to which it is broadcast.
BROADCAST_BYTES = 8 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object select datalist canvas".split())
#: Elements that a slash in their tag closes.
_FOREIGN = frozenset("svg math".split())
_ASIDE = frozenset("nav footer aside form button menu dialog fieldset label legend head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements that an opening tag of the key closes if they are open.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
#: What classes and ids call parts around an article, and parts that others wrote; as a whole, as the last word, or as the first before a plain word.
_AROUND = frozenset(
    "nav navbar navigation menu menus topbar header masthead footer sidebar aside rail banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social breadcrumb breadcrumbs pagination pager paging toolbar widget widgets search searchbox skip copyright tagcloud".split()
)
_OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion comment comments commentlist respond discussion disqus reply replies related recommended recommendations outbrain taboola".split()
)
#: Words that a name is plain before: sidebar-left, comment-list, share-buttons.
_PLAIN = frozenset(
    "area bar block body bottom box button buttons cell col column container content count cta form group head heading holder icon icons inner item items label left line link links list main message meta mobile module "
    "number outer panel post posts article articles stories story primary right row secondary section slot space strip tab tabs text thread title toggle top unit widget wrap wrapper".split()
)
#: Words that say what an element is with or without, not what it is.
_WITH = frozenset("with has no without is not non hide show js".split())
_TITLE = frozenset("article post entry content story title".split())
#: A tag as most are, without another bracket inside: what does not match is read step by step.
_PLAINLY = re.compile(r"""<(/?)([A-Za-z][^\s/><]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>""")
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


@lru_cache(1 << 16)
def _named(name: str) -> int:
    """Of one class or id: 2 for comments, adverts and the like, 1 for other parts around an article, else 0."""
    words = [w for w in re.split(r"[-_]+", name.lower()) if w]
    if not words or words[0] in _WITH:
        return 0
    if words[-1] == "header" and words[0] in _TITLE:
        return 0  # it holds the title
    ends = [words[-1].rstrip("0123456789")] if len(words) == 1 else [words[-1]]
    if len(words) > 1 and all(w in _PLAIN or w[:1].isdigit() for w in words[1:]):
        ends.append(words[0])
    return max(2 if w in _OTHERS else 1 if w in _AROUND else 0 for w in ends)


def _aside(tag: str, attrs: dict[str, str], inside_main: bool) -> int:
    """Does its tag, role or name set an element aside? As ``_named``."""
    if tag in _ASIDE or tag == "header" and not inside_main or attrs.get("role", "").lower() in _ROLES:
        return 1
    if not attrs:
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return 1
    if tag in ("html", "body", "main"):
        return 0
    kind = max(map(_named, f"{attrs.get('class', '')} {attrs.get('id', '')}".split()), default=0)
    # classes of an article say what is around it, unless it is itself a comment or an advert
    return kind if tag != "article" or kind == 2 else 0


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag, the name empty for comments and the like, in time linear in the page."""
    at, n = 0, len(page)
    last: dict[str, int] = {}  # quotes that do not come again
    while (at := page.find("<", at)) >= 0:
        plain = _PLAINLY.match(page, at)
        if plain:
            yield at, plain.end(), *plain.groups()
            at = plain.end()
            continue
        found = _OPEN.match(page, at)
        if found:
            to = found.end()
            while True:
                stop = _STOP.search(page, to)
                if not stop or stop.group() == ">":
                    break
                q = stop.group()
                to = page.find(q, stop.end()) + 1 if q not in last else 0
                if not to:  # a quote that nothing closes is a letter like any other
                    last[q] = to = stop.end()
            end = stop.end() if stop else n
            yield at, end, found.group(1), found.group(2), page[found.end() : stop.start() if stop else n]
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9) + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
        elif page[at + 1 : at + 2] == "/" and page.find("<", at + 1) < 0:
            end = n
        else:
            at += 1
            continue
        end = end if end > at else n
        yield at, end, "", "", ""
        at = end


class Page:
    """Elements of a page in order (the page itself is the first) and its blocks of text, in time linear in its length.

    Of each element: parent, tag, depth, path (a hash of all labels from the outside in), is
    it set aside, and the path of the outermost article or main around it, or 0. Blocks are
    (element, text): references decoded, white space single.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.depth, self.path, self.aside, self.whole = [0], [""], [0], [0], [False], [0]
        self.blocks: list[tuple[int, str]] = []
        self._kind = [0]  # what an element's own name says
        self._stack: list[tuple[str, int, bool]] = []  # tag, innermost element, set aside since that
        self._open: dict[str, list[int]] = {}  # places in the stack by tag
        self._text: list[str] = []
        self._read(page)
        self._settle()

    def _flush(self) -> None:
        t = _SPACE.sub(" ", _html.unescape("".join(self._text))).strip()
        self._text.clear()
        if t:
            at, off = (self._stack[-1][1], self._stack[-1][2]) if self._stack else (0, False)
            if not off:
                self.blocks.append((at, t))

    def _close(self, upto: int) -> None:
        if any(t not in _INLINE for t, _, _ in self._stack[upto:]):
            self._flush()
        for t, _, _ in self._stack[upto:]:
            self._open[t].pop()
        del self._stack[upto:]

    def _find(self, names, stop=()) -> int:
        last = max((self._open[n][-1] for n in names if self._open.get(n)), default=-1)
        return -1 if any(self._open.get(n) and self._open[n][-1] > last for n in stop) else last

    def _enter(self, tag: str, written: str) -> None:
        attrs = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR.findall(written)} if "=" in written or "hidden" in written.lower() else {}
        up, off = (self._stack[-1][1], self._stack[-1][2]) if self._stack else (0, False)
        kind = _aside(tag, attrs, bool(self._open.get("article") or self._open.get("main"))) or int(off)
        at, off = up, kind > 0
        if tag not in _INLINE:
            label = tag + "".join("." + c for c in attrs.get("class", "").lower().split()) + ("#" + attrs["id"].lower() if attrs.get("id") else "")
            at = len(self.path)
            self.parent.append(up), self.tag.append(tag), self.depth.append(self.depth[up] + 1), self._kind.append(kind)
            off = False
            self.path.append(xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), self.path[up]) >> 1 or 1)
            self.whole.append(self.whole[up] or (self.path[-1] if tag in ("article", "main") else 0))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, at, off))

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        for start, end, closing, name, written in _tags(page):
            if start < at:
                continue
            self._text.append(page[at:start])
            at = end
            if not name:
                continue
            tag = name.lower()
            if tag == "br":
                self._text.append(" ")
                continue
            if closing:
                i = self._find((tag,))
                if i >= 0:
                    self._close(i)
                elif tag not in _INLINE:
                    self._flush()
                continue
            if tag in _RAW:
                if tag not in _FOREIGN or written[-1:] != "/":
                    shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = shut.end() if shut else n
                continue
            if tag not in _INLINE:
                # a block inside unclosed inline elements ends them with the paragraph that holds them
                i = self._find(("p",), ("table", "td", "th", "button", "div", "section", "article", "body")) if tag in _ENDS_P else -1
                if i < 0 and tag in _CLOSES:
                    i = self._find(_CLOSES[tag], ("ul", "ol", "dl", "table"))
                self._close(i) if i >= 0 else self._flush()
            if tag not in _VOID:
                self._enter(tag, written)
        self._text.append(page[at:])
        self._flush()

    def _settle(self) -> None:
        """Which elements are set aside, and the blocks outside these.

        Names are no proof: what holds the page's article, a form with most of the text, and what
        holds most of it where nothing else is left, stay.
        """
        kind, size = self._kind, [0] * len(self.path)
        for at, t in self.blocks:
            size[at] += len(t)
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        worst: list[int] = []
        for i, up in enumerate(self.parent):
            worst.append(max(kind[i], worst[up] if i else 0))
        whole = [i for i, tag in enumerate(self.tag) if tag in ("article", "main") and size[i] and worst[i] < 2]
        if whole and all(worst[i] for i in whole):
            at = max(whole, key=lambda i: (size[i], -i))
            while at:
                kind[at], at = 0, self.parent[at]
        most = [i for i in range(1, len(size)) if kind[i] and 2 * size[i] > size[0]]
        for i in most:
            if self.tag[i] == "form":
                kind[i] = 0
        self.aside = self.within(lambda i: kind[i] > 0)
        if self.blocks and all(self.aside[at] for at, _ in self.blocks):
            for i in most:
                if kind[i] == 1 and self.tag[i] not in ("nav", "menu"):
                    kind[i] = 0
            self.aside = self.within(lambda i: kind[i] > 0)
        self.blocks = [(at, t) for at, t in self.blocks if not self.aside[at]]

    def within(self, true: Callable[[int], bool]) -> list[bool]:
        """For each element, is it or one around it such?"""
        out: list[bool] = []
        for i, up in enumerate(self.parent):
            out.append(true(i) or i > 0 and out[up])
        return out

    def token(self, at: int, text: str) -> int:
        """A block as a token: its element and words."""
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.path[self.top[at]]) >> 1

    def like(self, at: int, text: str) -> int:
        """The same with all numbers alike: they differ in what a template says, but a heading is a title."""
        return self.token(at, text if self.tag[at] in _HEADINGS else re.sub(r"\d+", "0", text))

    @property
    def top(self) -> list[int]:
        """For each element, itself or the innermost around it that is no deeper than DEPTH."""
        if not hasattr(self, "_top"):
            self._top: list[int] = []
            for i, up in enumerate(self.parent):
                self._top.append(i if self.depth[i] <= DEPTH else self._top[up])
        return self._top


def blocks(page: str) -> list[str]:
    """The blocks of a page that are not set aside, in order."""
    return [t for _, t in Page(page).blocks]


def extract(page: str | None, container: int | None = None, template: frozenset[int] = frozenset()) -> tuple[str, str]:
    """The main text (blocks of the main slot that are not of the template, one a line), and what the slot was found by."""
    p = Page(page or "")
    found = [(at, t) for at, t in p.blocks if not template or p.token(at, t) not in template]
    tests = [("article", lambda i: p.tag[i] == "article"), ("main", lambda i: p.tag[i] == "main")]
    if container is not None:
        tests.insert(0, ("template", lambda i: p.path[i] == container))
    for by, test in tests:
        inside = p.within(test)
        if got := [t for at, t in found if inside[at]]:
            return "\n".join(got), by
    return "\n".join(t for _, t in found), "page"


_EACH = "host long, key long, path long, said long, like long, times long, chars long, chain array<long>, tag string, whole long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each page with their occurrences and characters: elements (said is null) with the paths from the outside in, and blocks of text."""
    for b in batches:
        rows: list[tuple] = []
        for host, key, html in zip(b.column("host").to_pylist(), b.column("key").to_pylist(), b.column("html")):
            p = Page(html.as_py() or "")
            chars = [0] * len(p.path)
            said: dict[tuple[int, int], list[int]] = {}
            for at, t in p.blocks:
                chars[at] += len(t)
                x = said.setdefault((p.path[p.top[at]], p.token(at, t), p.like(at, t)), [0, 0])
                x[0] += 1
                x[1] += len(t)
            for i in range(len(chars) - 1, 0, -1):
                chars[p.parent[i]] += chars[i]
            chains: list[list[int]] = []
            met: dict[int, list] = {}
            for i, path in enumerate(p.path):
                chains.append([*chains[p.parent[i]], path] if 0 < p.depth[i] <= DEPTH else [])
                if p.depth[i] <= DEPTH and not p.aside[i]:
                    x = met.setdefault(path, [0, 0, chains[i], p.tag[i], p.whole[i]])
                    x[0] += 1
                    x[1] += chars[i]
            rows += [(host, key, path, None, None, *x) for path, x in met.items()]
            rows += [(host, key, *of, *x, None, None, None) for of, x in said.items()]
            if len(rows) > 1 << 16:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["host", "key", "path", "said", "like", "times", "chars", "chain", "tag", "whole"]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64()), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _small(df: DataFrame, scratch: Scratch) -> DataFrame:
    return F.broadcast(df) if scratch.size(df) <= BROADCAST_BYTES else df


def _vector() -> list[Column]:
    """Pages, most occurrences on one, characters, and what tells an occurrence vector: two sums of hashes of (page, occurrences) and the number of pages."""
    h = F.xxhash64("key", "times")
    sig = F.struct(F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("s"), F.count("*").alias("n"))
    return [sig.alias("vector"), F.max("times").alias("most"), F.sum("chars").alias("chars")]


def classes(elements: DataFrame) -> DataFrame:
    """The template of each host: (host, vector, around, size, pages) of its classes of elements, each with the class that it nests in.

    Only a class of one element around another's is looked at; the outermost have none.
    """
    inner = elements.select("host", "vector", F.when(F.size("chain") > 1, F.element_at("chain", -2)).alias("up"))
    outer = elements.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("vector").alias("around"))
    nested = inner.join(outer, (F.col("host") == F.col("h")) & (F.col("up") == F.col("p")), "left").select("host", "vector", F.when(F.col("around") != F.col("vector"), F.col("around")).alias("around"))
    return nested.groupBy("host", "vector").agg(F.max("around").alias("around"), F.count("*").alias("size")).withColumn("pages", F.col("vector.n"))


def slots(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, container, template): the path of a host's main slot, null if that is the page, and the blocks in it that are template."""
    host = F.xxhash64(_host(F.col("url")))
    each = pages.select(host.alias("host"), F.xxhash64("html").alias("key"), "html").mapInArrow(_occurrences, _EACH)
    each = scratch.save(each, "occurrences")
    elements = each.where("said IS NULL").groupBy("host", "path").agg(*_vector(), F.any_value("chain").alias("chain"), F.any_value("tag").alias("tag"), F.any_value("whole").alias("whole"))
    unlike = each.where("path = 0 AND said IS NULL").select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("unlike"))
    all_ = elements.where("path = 0").select("host", F.col("vector.n").alias("all"), F.col("chars").alias("text")).join(unlike, "host")
    all_ = _small(scratch.save(all_.where(F.col("unlike") >= LEAST_PAGES), "hosts"), scratch)
    often = (F.col("vector.n") >= LEAST_PAGES) & (F.col("vector.n") >= LEAST_SHARE * F.col("all"))
    elements = scratch.save(elements.join(all_, "host").where(F.col("path") != 0).withColumn("often", often), "elements")
    known = _small(elements, scratch)
    template = _small(scratch.save(classes(elements.where("often")), "classes"), scratch)

    # text in the class of an element around it
    texts = each.where("said IS NOT NULL").groupBy("host", "path", "said").agg(*_vector())
    texts = texts.join(known.select("host", "path", "chain"), ["host", "path"])
    texts = scratch.save(texts.select("host", "path", "said", "vector", "chars", "chain"), "texts")
    shared = texts.where(F.col("vector.n") >= LEAST_PAGES).select("host", "said", "vector", "chars", F.explode("chain").alias("path"))
    fixed = shared.join(known.select("host", "path", "vector"), ["host", "path", "vector"], "left_semi").join(template.select("host", "vector"), ["host", "vector"], "left_semi")
    fixed = scratch.save(fixed.groupBy("host", "said").agg(F.max("chars").alias("chars")), "fixed")
    small = _small(fixed, scratch).select("host", "said")

    filled = texts.join(small, ["host", "said"], "left_anti").select("host", "chars", F.explode("chain").alias("path"))
    filled = filled.groupBy("host", "path").agg(F.sum("chars").alias("filled"))
    filled = scratch.save(filled, "filled")
    total = filled.groupBy("host").agg(F.max("filled").alias("total"))
    main = known.where((F.col("most") == 1) & F.col("tag").isin(*sorted(_HOLDERS))).join(template.select("host", "vector"), ["host", "vector"], "left_semi")
    main = main.join(filled, ["host", "path"]).join(total, "host").where(F.col("filled") >= MAIN_SHARE * F.col("total"))
    best = main.groupBy("host").agg(F.max_by(F.struct("path", "chain", "whole", F.col("vector.n").alias("of")), F.struct(F.size("chain"), "filled", "path")).alias("b")).select("host", "b.*")
    best = scratch.save(best.withColumnRenamed("path", "inner").withColumnRenamed("chain", "steps"), "innermost")

    # slots of its pages outside it, other than what most of them say
    open_ = _small(best, scratch).where("whole = 0")
    has = each.where("said IS NULL").join(open_, "host").where("path = inner").select("host", "key")
    said = each.where("said IS NOT NULL").select("host", "key", "path", "said", "like").join(small, ["host", "said"], "left_anti").join(known.select("host", "path", "chain"), ["host", "path"])
    outside = said.join(open_, "host").where(~F.array_contains("chain", F.col("inner"))).join(has, ["host", "key"], "left_semi")
    outside = outside.select("host", "key", "like", "of", F.size(F.array_intersect("chain", "steps")).alias("common")).distinct()
    outside = outside.groupBy("host", "like", "of", "common").agg(F.count("*").alias("n"))
    grown = outside.where((F.col("n") < LEAST_PAGES) | (F.col("n") < LEAST_SHARE * F.col("of"))).groupBy("host").agg(F.min("common").alias("common"))
    around = F.when(F.col("whole") != 0, F.col("whole")).when(F.col("common").isNull(), F.col("inner")).otherwise(F.get("steps", F.col("common") - 1))
    best = best.join(grown, "host", "left").select("host", F.coalesce(around, F.lit(0).cast("long")).alias("path"))
    best = best.join(known.select("host", "path", "tag", "chars"), ["host", "path"], "left")
    # no more than the page itself tells nothing
    page = F.col("tag").isNull() | F.col("tag").isin("html", "body")
    best = scratch.save(best.select("host", F.when(~page, F.col("path")).alias("container"), "chars"), "grown")

    # pages whose main slot is mostly template are copies
    held = texts.select("host", "said", "chain", F.col("chars").alias("size")).join(small, ["host", "said"], "left_semi").join(_small(best, scratch), "host", "left")
    held = held.where(F.col("container").isNull() | F.array_contains("chain", F.col("container"))).groupBy("host").agg(F.collect_list("said").alias("template"), F.sum("size").alias("fixed"))
    out = all_.select("host", "text").join(best, "host", "left").join(held, "host", "left")
    return out.select("host", "container", F.when(F.col("fixed") < MAIN_SHARE * F.coalesce("chars", "text"), F.col("template")).alias("template"))


def _host(url: Column) -> Column:
    """The host of an address without user and port, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and found_by of every row of ``pages``.

    A null or empty html has empty text; a null url has no host, and pages without a host
    have a template like any host's. Repeated rows each get their row. Other columns are
    not looked at. ``found_by`` is template, article, main or page. No rows: no rows.
    """
    scratch = Scratch(pages.sparkSession, "html")
    known = _small(scratch.save(slots(pages, scratch), "slots"), scratch)
    rows = pages.select("page_id", "url", "html", F.xxhash64(_host(F.col("url"))).alias("host")).join(known, "host", "left").select("page_id", "url", "html", "container", "template")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = zip(b.column("container").to_pylist(), b.column("template").to_pylist())
            got = [extract(h.as_py(), c, frozenset(t or ())) for h, (c, t) in zip(b.column("html"), hosts)]
            texts, by = [x for x, _ in got], [x for _, x in got]
            cols = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(by, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *cols], names=["page_id", "url", "text", "n_chars", "found_by"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, found_by string")
