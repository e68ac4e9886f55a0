"""Main text of web pages by consensus of a host's pages.

1. Each page is parsed (a tolerant parser: unclosed and stray tags are fine) and its
   containers are scored by the running text they hold.
2. A container is named by its generalised path: tags and classes from the root, digits
   taken out. Pages vote for the path of their best container; Spark adds the votes up
   per host and path. A host's paths are those with ``LEAST_SHARE`` of its votes or more,
   best first, so a host may have several templates.
3. Each page is extracted again: from the elements on the first of its host's paths that
   it has text on, or from its own best container where it has none of them.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles
are left out wherever they stand, by their tag or role, or by a class or id that names
one and nothing else; an article's own header stays, and so does a form that holds the page. A
class or id that names one beside something else ("newsletter-history"), or that only hints at
readers' words ("user-feedback"), makes an element a suspect: whether it goes is for the host to
say. Pages name their suspects' paths as they vote, and a path that is a suspect on
``RECURS`` of a host's pages, and two at least, belongs to its template; what stands on one
page belongs to that page. An id that is an anchor's name ("search") tells nothing inside an article.

Parsing takes time in proportion to a page's length: the scan never goes back, open
elements are found by tag, paths and containers are known from the parent, and an
element's blocks are a range. The host paths go to the pages, not the pages to the
hosts: they are broadcast while they are few, and beyond that joined with the pages
dealt over ``SALTS`` parts of a host.

Defined results: a null page is empty and gives an empty text; a null or odd address
makes the host the empty one; containers of equal score rank by their place in the page,
paths of equal votes by depth (deeper first) and then name; repeated rows vote and are
extracted each; an empty table gives no rows; other columns are kept, whatever their
names (a new column whose name is taken gets underscores before it).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.shared import free_name, materialize, table

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas title select xmp noframes audio video".split())
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article main section div td body".split())
#: Open elements that end where one of the first kind begins, unless a bound stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("html body table ul ol dl td th div article section main aside".split())
LEFT_OUT = frozenset("head nav footer aside form menu dialog button label fieldset".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id that mark what is not the article, whatever stands beside them ...
NOISE = frozenset(
    "ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup modal navbar breadcrumb breadcrumbs"
    " sidebar sidebars masthead topbar comments commentlist disqus newsletter subscribe subscription signup login toolbar pagination pager".split()
)
#: ... and those that do so alone or beside words of a page's frame.
WEAK = frozenset(
    "ad aside banner notice notices notification alert overlay nav navigation menu menus rail widget widgets footer foot header comment discussion respond reply replies"
    " share sharing social related recommended recommendations search tags".split()
)
FRAME = frozenset(
    "site page main global top bottom left right primary secondary inner outer wrapper wrap container box block slot area section list item items bar unit link links posts row col column"
    " holder module panel region view group post entry user reader author body text title form content message signup button buttons icon icons small large sticky fixed mobile desktop web privacy legal law policy info js google dfp native inline leaderboard placeholder label".split()
)
#: Words that hint at what readers wrote, or at what goes with every page of a host.
HINTS = frozenset("feedback reviews testimonials reactions opinions discussion discussions conversation replies responses readers visitors teaser teasers trending popular recirc outbrain taboola syndication".split())
#: Share of a host's pages from which on a suspect's path is of its template.
RECURS = 0.3
#: How many paragraphs make a form one around a whole page, if it has no article or main heading.
PARAGRAPHS = 3
GOOD = frozenset("article content post entry story main body text page".split())
#: Share of a host's votes from which on a path is one of its own.
LEAST_SHARE = 0.05
#: Most bytes of host paths that are broadcast, and parts of a host beyond that.
BROADCAST_BYTES, SALTS = 32 << 20, 64


@lru_cache(4096)
def _step(tag: str, names: tuple[str, ...]) -> str:
    return ".".join([tag, *sorted({re.sub(r"\d+", "", n) for n in names} - {""})]).replace("/", "_")


class Node:
    """An element: its number in page order, the last number inside it, whether it is left out,
    the key of its path, the nearest block and container around it, and whether it is a suspect."""

    __slots__ = ("tag", "names", "parent", "out", "score", "at", "last", "key", "block", "holder", "suspect")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None, out: bool, at: int):
        self.tag, self.names, self.parent, self.out, self.score, self.at, self.last, self.suspect = tag, names, parent, out, 0.0, at, at, False
        self.key = xxh64_intdigest(f"{parent.key} {self.step()}") if parent is not None else 0
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.holder = self if parent is None or tag in HOLDERS else parent.holder

    def step(self) -> str:
        return (_step if len(self.names) <= 8 else _step.__wrapped__)(self.tag, self.names) if self.names else self.tag.replace("/", "_")

    def path(self) -> str:
        """Generalised path: tags and classes, without digits."""
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step())
            node = node.parent
        return "/".join(reversed(steps))


def path_key(path: str) -> int:
    key = 0
    for step in path.split("/"):
        key = xxh64_intdigest(f"{key} {step}")
    return key


CLEAR, SUSPECT, ANCHOR, SURE = range(4)


def names_noise(value: str) -> int:
    """What a class or id says: SURE, it names what is not the article; ANCHOR, it does so by words that
    a heading may have too; SUSPECT, it has such a word beside others; or CLEAR."""
    found = CLEAR
    for name in value.lower().split():
        words = set(re.split(r"[^a-z]+", name)) - {""}
        if words & NOISE:
            # One letter is no word of its own.
            found = max(found, SURE if all(len(w) == 1 or w in NOISE | WEAK | FRAME | GOOD for w in words) else SUSPECT)
        elif words & WEAK and words <= WEAK | FRAME | GOOD and not (words & GOOD and words & WEAK <= {"header"}):
            found = max(found, ANCHOR)
        elif words & HINTS:
            found = max(found, SUSPECT)
    return found


@lru_cache(4096)
def _classes(tag: str, rest: str) -> tuple[tuple[str, ...], bool, bool, bool]:
    """(class names, whether the element is left out, whether it is so outside of articles only,
    whether it is a suspect)."""
    out, names, anchor, suspect = tag in LEFT_OUT, (), False, False
    if rest.strip():
        for m in ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "class":
                names = tuple(value.lower().split())
            if key in ("class", "id"):
                # A page's frame may be called after what it holds; only its parts are judged by name.
                found = CLEAR if tag in ("html", "body", "main", "article") else names_noise(value)
                out = out or found == SURE or (found == ANCHOR and key == "class")
                anchor, suspect = anchor or (found == ANCHOR and key == "id"), suspect or found == SUSPECT
            elif key == "role":
                out = out or value.lower() in LEFT_OUT_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                out = True
    return names, out, anchor, suspect


def markup(html: str) -> Iterator[tuple[str, int, int, bool, str, str]]:
    """(kind, text begin, text end, end tag, name, attributes) in page order: kind "text", "tag"
    or "raw" (an element whose content is passed over). What is no tag is text; comments and
    declarations are neither."""
    at, size, last_gt = 0, len(html), html.rfind(">")
    quotes = True  # until a quote is left open: then quotes mean nothing
    while at < size:
        lt = html.find("<", at)
        while lt >= 0 and not (html.startswith(("!--", "![CDATA["), lt + 1) or (lt < last_gt and (html.startswith(("!", "?"), lt + 1) or NAME.match(html, lt + 1 + html.startswith("/", lt + 1))))):
            lt = html.find("<", lt + 1)
        if lt < 0:
            yield "text", at, size, False, "", ""
            return
        if lt > at:
            yield "text", at, lt, False, "", ""
        for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if html.startswith(opens, lt):
                stop = html.find(closes, lt + len(opens))
                at = size if stop < 0 else stop + len(closes)
                break
        else:
            if html[lt + 1] in "!?":
                at = html.find(">", lt) + 1
                continue
            ends = html.startswith("/", lt + 1)
            name = NAME.match(html, lt + 1 + ends)
            at = name.end()
            while quotes:
                at = PLAIN.match(html, at).end()
                if at < size and html[at] == ">":
                    break
                at = html.find(html[at], at + 1) + 1 if at < size else 0
                quotes = at > 0
            if not quotes:
                at = html.find(">", name.end())
            tag, rest = name[0].lower(), html[name.end() : at]
            at += 1
            if tag in RAW and not ends:
                if not rest.endswith("/"):
                    stop = RAW_END[tag].search(html, at)
                    at = stop.end() if stop else size
                yield "raw", at, at, False, tag, rest
            else:
                yield "tag", at, at, ends, tag, rest


STORY = frozenset("article post entry story".split())


def _whole_forms(html: str) -> list[bool]:
    """For each form of a page whether it holds an article, a main heading or several paragraphs."""
    out, ends, paragraphs = [], False, 0
    for m in re.finditer(r"<(form|/form|article|main|h1|p)\b", html, re.I):
        tag = m[1].lower()
        if tag == "form":
            out.append(False)
            ends, paragraphs = False, 0
        elif tag == "/form":
            ends = True
        elif out and not ends:
            paragraphs += tag == "p"
            out[-1] |= tag != "p" or paragraphs >= PARAGRAPHS
    return out


class Page:
    """The elements of a page in order, and its blocks: (element, text, length of link text)."""

    def __init__(self, html: str):
        self.root = Node("", (), None, False, 0)
        self.nodes, self.blocks = [self.root], []
        self.stack = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements, by tag
        self.suspects: list[Node] = []
        self.stories = 0  # open elements whose class says that they are an article
        self.whole_forms = _whole_forms(html) if "<form" in html or "<FORM" in html or "<Form" in html else []
        self.forms = 0
        self.block_places, self.bound_places = [0], [0]
        self.text: list[str] = []
        self.linked = 0
        for kind, begin, end, ends, tag, rest in markup(html):
            if kind == "text":
                if not self.stack[-1].out:
                    self.text.append(html[begin:end])
                    self.linked += (end - begin) * bool(self.places["a"])
            elif kind == "raw":
                self.text.append(" ")
            elif ends:
                self._end(tag)
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self.text.append(" ")
            else:
                self._begin(tag, rest)
        self._close(1)
        self._flush()
        self.root.last = len(self.nodes) - 1

    def _flush(self) -> None:
        if self.text:
            if t := " ".join(unescape("".join(self.text)).split()):
                self.blocks.append((self.stack[-1].block, t, min(self.linked, len(t))))
            self.text, self.linked = [], 0

    def _close(self, i: int) -> None:
        """End the open elements from place ``i`` on."""
        while len(self.stack) > i:
            node = self.stack[-1]
            if node.tag in BLOCK:
                self._flush()
                self.block_places.pop()
            if node.tag in BOUNDS:
                self.bound_places.pop()
            self.places[node.tag].pop()
            self.stories -= bool(STORY.intersection(node.names))
            node.last = len(self.nodes) - 1
            self.stack.pop()

    def _end(self, tag: str) -> None:
        # An inline end tag does not end a block.
        if self.places[tag] and (tag in BLOCK or tag == "a" or self.places[tag][-1] > self.block_places[-1]):
            self._close(self.places[tag][-1])

    def _begin(self, tag: str, rest: str) -> None:
        ends = ENDS.get(tag, frozenset()) | ({"p"} if tag in BLOCK else frozenset())
        if ends:
            k = len(self.bound_places) - 1
            while k > 0 and self.stack[self.bound_places[k]].tag in ends:
                k -= 1
            bound = self.bound_places[k]
            after = [own[bisect_right(own, bound)] for kind in ends if (own := self.places[kind]) and own[-1] > bound]
            if after:
                self._close(min(after))
        # Only short attribute lists are worth remembering.
        names, out, anchor, suspect = (_classes if len(rest) <= 200 else _classes.__wrapped__)(tag, rest) if rest else ((), tag in LEFT_OUT, False, False)
        parent, inside = self.stack[-1], self.places["article"] or self.places["main"]
        if tag == "form":
            self.forms += 1
            if self.forms <= len(self.whole_forms) and self.whole_forms[self.forms - 1]:
                out = (_classes if len(rest) <= 200 else _classes.__wrapped__)("div", rest)[1]
        out = out or (anchor and not inside)
        if tag == "header":  # a page's header; an article's own stays
            out = out or not (inside or self.stories)
        if tag in BLOCK:
            self._flush()
        node = Node(tag, names, parent, out or parent.out, len(self.nodes))
        self.nodes.append(node)
        if suspect and not node.out:
            node.suspect = True
            self.suspects.append(node)
        if rest.endswith("/") and tag not in BLOCK:
            return
        place = len(self.stack)
        self.stack.append(node)
        self.stories += bool(STORY.intersection(names))
        self.places[tag].append(place)
        if tag in BLOCK:
            self.block_places.append(place)
        if tag in BOUNDS:
            self.bound_places.append(place)

    def containers(self) -> list[Node]:
        """Containers that hold running text, best first."""
        seen: dict[int, Node] = {}
        for node, t, links in self.blocks:
            own = len(t) - links
            if own < 20 or links * 2 > len(t):
                continue
            share, n = float(own), node.holder
            while n is not None and share >= own / 4:
                n.score += share * (1.5 if n.tag in ("article", "main") or GOOD.intersection(n.names) else 1.0)
                seen[n.at] = n
                share /= 2
                n = n.parent.holder if n.parent is not None else None
        return sorted(seen.values(), key=lambda n: (-n.score, n.at))

    def under(self, roots: list[Node], without: list[Node] = ()) -> list[str]:
        """Texts of the blocks inside any of ``roots``, which are in page order, less those inside of
        ``without``."""
        inside, last = bytearray(len(self.nodes)), -1
        for r in roots:
            if r.at > last:
                last = r.last
                inside[r.at : last + 1] = b"\1" * (last + 1 - r.at)
        last = -1
        for w in without:
            if w.at > last:
                last = w.last
                inside[w.at : last + 1] = b"\0" * (last + 1 - w.at)
        return [t for node, t, _ in self.blocks if inside[node.at]]


def main_text(html: str | None, paths: list[str] = (), template: list[str] = ()) -> str:
    """The text under the elements on the first of ``paths`` that has some, or else under the
    page's best container; without the suspects on a path of ``template``, unless nothing is left."""
    page = Page(html or "")
    on: dict[int, list[Node]] = {path_key(p): [] for p in paths}
    for n in page.nodes[1:]:
        if n.key in on and not n.out:
            on[n.key].append(n)
    known = {path_key(p) for p in template}
    without = [n for n in page.suspects if n.key in known]
    for roots in on.values():
        if roots and (found := page.under(roots, without) or page.under(roots)):
            return "\n".join(found)
    roots = page.containers()[:1] or [page.root]
    return "\n".join(page.under(roots, without) or page.under(roots))


def best_path(html: str | None) -> str | None:
    """Path of a page's best container."""
    return said(html)[0]


def said(html: str | None) -> tuple[str | None, list[str]]:
    """What a page tells its host: the path of its best container and those of its suspects."""
    page = Page(html or "")
    best = page.containers()
    return best[0].path() if best and best[0].parent is not None else None, sorted({n.path() for n in page.suspects})


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, paths, template): the paths for which a host's pages vote, best first, and those on
    which suspects recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [said(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.list_(pa.string()))], names=["host", "path", "suspects"])

    cast = pages.select(host_of(F.col(url).cast("string")).alias("host"), F.col(html).cast("string").alias("html"))
    told = cast.mapInArrow(run, "host string, path string, suspects array<string>")
    vote = F.struct(F.lit("vote").alias("kind"), F.col("path").alias("path"))
    every = F.concat(F.array(vote), F.transform("suspects", lambda p: F.struct(F.lit("suspect").alias("kind"), p.alias("path"))))
    each = told.select("host", F.explode(every).alias("x")).groupBy("host", "x.kind", "x.path").agg(F.count("*").alias("votes"))
    each = materialize(each, "votes")
    votes = F.when(F.col("kind") == "vote", F.col("votes"))
    total = each.groupBy("host").agg(F.sum(votes).alias("pages"), F.sum(F.when(F.col("path").isNotNull(), votes)).alias("total"))
    own = each.join(total, "host").where("path IS NOT NULL")
    # At most 1 / LEAST_SHARE paths a host. Ties go to the deeper, then to the greater path.
    ranked = F.when((F.col("kind") == "vote") & (F.col("votes") >= LEAST_SHARE * F.col("total")), F.struct("votes", F.size(F.split("path", "/")).alias("depth"), "path"))
    recurs = F.when((F.col("kind") == "suspect") & (F.col("votes") >= 2) & (F.col("votes") >= RECURS * F.col("pages")), F.col("path"))
    out = own.groupBy("host").agg(F.sort_array(F.collect_list(ranked), asc=False)["path"].alias("paths"), F.sort_array(F.collect_list(recurs)).alias("template"))
    return out.where((F.size("paths") > 0) | (F.size("template") > 0))


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", into: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` without the html and with the main text, never null."""
    host, paths, other, salt, template, into = (free_name(pages, n) for n in ("_host", "_paths", "_h", "_salt", "_template", into))
    best = materialize(host_paths(pages, html, url).withColumnsRenamed({"host": other, "paths": paths, "template": template}), "host-paths")
    size = best.agg(F.sum(F.octet_length(other) + F.octet_length(F.array_join(paths, "/")) + F.octet_length(F.array_join(template, "/")))).first()[0] or 0
    keyed = pages.withColumn(host, host_of(F.col(url).cast("string")))
    if size <= broadcast_bytes:
        joined = keyed.join(F.broadcast(best), keyed[host] == best[other], "left")
    else:  # a host's pages are dealt by their content, and its one row goes to each part
        keyed = keyed.withColumn(salt, F.pmod(F.xxhash64(html), F.lit(SALTS)))
        best = best.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = keyed.join(best, (keyed[host] == best[other]) & (keyed[salt] == best["salt"]), "left").drop(best["salt"])
    others = [c for c in pages.columns if c != html]
    schema = pages.select(*others, F.lit("").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(h, p or (), t or ()) for h, p, t in zip(*(c.to_pylist() for c in b.columns[-3:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(out, pa.string())], names=[*others, into])

    return joined.select(*(keyed[c] for c in others), keyed[html].cast("string"), joined[paths], joined[template]).mapInArrow(run, schema)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
