"""HTML main text by a site style tree.

Pages of a host are merged into one tree whose nodes are elements, named by tag and class and placed under their parents: all that
is shown takes part, menus and footers too. A node's presentation importance is the entropy of the child sequences its pages give it, a
leaf's content importance the entropy of the texts found there, both with the number of observations as the base: 0 if all pages
agree, 1 if all differ. A text or child sequence counts once for each distinct page of the host that has it, so that copies of a
page are one page; pages that agree in their longest own blocks, up to `SAME` of their characters, are copies. A branch's importance
is the mean of the content importances below it, weighted by observations, mixed with its own presentation importance. Branches
that are low, with every leaf of theirs, on at least `LEAST_PAGES` observations leave every page of the host. What is low depends on where it
stands: beside the host's articles, under `LOW_BESIDE` of their importance; inside an article or main element, under `LOW_INSIDE`; headings and
hosts without such elements, under `LOW`. What a frame shows comes from few texts however many pages a host has, and the articles of the host
tell how much its pages repeat anyway, so hosts of any size are measured by themselves.

What statistics don't know (hosts of a few pages, adverts and reader comments that differ from page to page) is left to the meaning of
elements: menus, headers, footers, sidebars, notices, adverts, forms and comments by tag, role and class are listed and go from each
page; where a page has an article or main element, only that counts. Inside one, a class is listed only as a whole (`ad-banner`, not
`share-price`). Scripts, styles and what isn't shown (`hidden`, `display: none`) never take part.

Statistics travel as (host, node, hash, page) rows that are made distinct before they are shuffled by all four, so a host with a
third of all pages is no task's own; what joins back to the pages is a list of low nodes for each host, broadcast if its counted
size is small.

Defined cases: null or empty html gives an empty text; a null url is the host ''; unclosed tags close with their parents, an unclosed
tag bracket or script runs to the end of the page; an unmatched quote ends at its bracket; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import texts_of
from tidemill.session import cut

LOW = 0.5
LOW_INSIDE = 0.2
#: Share of the importance of its host's articles under which a branch outside them is low.
LOW_BESIDE = 0.95
LEAST_PAGES = 10
#: Share of a page's characters, longest blocks first, that tells it from other pages; what is shorter (a date, a counter) doesn't.
SAME = 0.9
#: Share of a branch's own presentation importance in its importance.
PRESENTATION = 0.1
#: Nodes to remove up to which their table is broadcast; beyond, it is joined like any other.
BROADCAST_NODES = 100_000
#: Levels of nesting that the tree tells apart.
DEPTH = 48

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=\s|$|/)", re.S | re.I)

# Element names of HTML, and words that name the parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SCOPE = set("address article aside blockquote body center details dialog dd div dl dt fieldset figure footer form header html li main nav ol section table tbody td tfoot th thead tr ul".split())
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
UNSEEN = set("script style textarea title iframe noscript template svg math object canvas audio video select".split())
LISTED = set("form button input nav footer aside menu dialog".split())
MAIN = {"article", "main"}
LISTED_WORDS = set("nav navbar navigation menu footer sidebar aside widget notice notices cookie cookies consent banner popup modal ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies respond share sharing social related breadcrumb breadcrumbs newsletter subscribe subscription login signup search pagination pager toolbar".split())
#: Words that may stand beside a listed one in a class name inside an article; any other makes it the article's own (share-price).
PLAIN_WORDS = set("area bar block box btn button container content group inner item items link links list outer panel section slot strip wrap wrapper".split())
HEADER_WORDS = {"header", "masthead", "topbar"}
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADING = r"^h[1-6](\.|$)"
LISTED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


class Page:
    """The blocks of a page, (node, inside main, listed, text), and (node, inside main, child sequence) of every node; unseen elements are left out."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool, str]] = []
        self.children: list[tuple[str, bool, str]] = []
        # name, node, unseen, listed, inside main, names of block children
        self.stack: list[tuple[str, str, bool, bool, bool, list[str]]] = [("", "", False, False, False, [])]
        self.parts: list[str] = []
        self.opened: Counter[str] = Counter()
        self.read(source)
        self.flush()
        while self.stack:
            self.leave()

    def own(self) -> list[tuple[str, str]]:
        """node, text of the blocks that aren't listed; where a page has an article or main element, of those inside."""
        plain = [x for x in self.blocks if not x[2]]
        inside = [x for x in plain if x[1]]
        return [(node, text) for node, _, _, text in inside or plain]

    def cut(self, low: set[str]) -> None:
        """Takes the branches `low` out."""
        under = tuple(f"{x}>" for x in low)
        self.blocks = [b for b in self.blocks if b[0] not in low and not b[0].startswith(under)]

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = TOKEN.search(source, at)
            self.text(source[at : found.start() if found else end])
            if not found:
                return
            at = found.end()
            if found[2]:
                name = found[2].lower()
                if found[1]:
                    self.close(name)
                else:
                    self.open(name, found[3] or "")
                    if name in RAW:  # its content is no markup
                        stop = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                        self.text(source[at : stop.start() if stop else end])
                        at = stop.end() if stop else end
                        self.close(name)

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1][2]:
            self.parts.append(entities.unescape(raw) if "&" in raw else raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                _, node, _, listed, inside, _ = self.stack[-1]
                self.blocks.append((node, inside, listed, text))

    def open(self, name: str, attributes: str) -> None:
        if name == "br" or name == "hr":
            self.parts.append(" ")
        if name in VOID:
            return
        words, names, role, hidden = [], [], "", False
        for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
            value = value.strip("\"'").lower()
            if key.lower() in ("class", "id"):
                own = [re.split(r"[^a-z0-9]+", x) for x in value.split()]
                names += own
                words += [w for x in own for w in x]
            elif key.lower() == "role":
                role = value
            elif key.lower() == "style":
                hidden |= bool(UNSHOWN.search(value))
            else:
                hidden |= key.lower() == "hidden" or value == "true"
        if name not in INLINE:
            self.flush()
            if name in SCOPE or name == "p" or re.fullmatch("h[1-6]|pre|hr", name):
                self.imply("p", SCOPE)
            if name in LISTS:
                self.imply(name, LISTS[name])
        above = self.stack[-1]
        inside = above[4] or name in MAIN or role == "main"
        unseen = above[2] or hidden or name in UNSEEN
        # inside an article a class says what it is as a whole: ad-banner, comment-list, not share-price
        whole = [x for x in names if LISTED_WORDS.intersection(x) and not set(x) - LISTED_WORDS - PLAIN_WORDS - {""} - {w for w in x if w.isdigit()}]
        named = bool(whole if above[4] else LISTED_WORDS.intersection(words)) and name not in MAIN and name not in ("body", "html")
        top = not above[4] and (name == "header" or (bool(HEADER_WORDS.intersection(words)) and name not in ("body", "html", *MAIN)))
        listed = above[3] or name in LISTED or role in LISTED_ROLES or named or top
        apart = (unseen, listed) != above[2:4]
        if apart:
            self.flush()
        node = above[1]
        if name not in INLINE or apart:
            label = ".".join([name, *sorted({w for w in words if w and not w.isdigit()})])
            above[5].append(label)
            if len(self.stack) <= DEPTH:
                node = f"{node}>{label}"
        self.stack.append((name, node, unseen, listed, inside, []))
        self.opened[name] += 1

    def imply(self, name: str, until: set[str]) -> None:
        """Closes an open `name` that the next element ends, unless `until` stands between."""
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.stack[k][0]
            if own == name:
                while len(self.stack) > k:
                    self.leave()
                return
            if own in until:
                return

    def close(self, name: str) -> None:
        if self.opened[name]:
            if name not in INLINE or self.stack[-1][2:4] != self.stack[-2][2:4]:
                self.flush()
            while self.stack[-1][0] != name:
                if self.stack[-1][0] not in INLINE:
                    self.flush()
                self.leave()
            self.leave()

    def leave(self) -> None:
        name, node, unseen, _, inside, children = self.stack.pop()
        self.opened[name] -= 1
        if children and not unseen and node:
            self.children.append((node, inside, " ".join(children)))


def page_key(page: Page) -> int:
    """A hash of the longest blocks of a page, the same for its copies."""
    texts = sorted((text for _, text in page.own()), key=lambda text: (-len(text), text))
    wanted, reached, kept = SAME * sum(map(len, texts)), 0, xxhash.xxh64()
    for text in texts:
        if reached >= wanted:
            break
        kept.update(text + "\n")
        reached += len(text)
    return kept.intdigest() - (1 << 63)


def site_nodes(pages: DataFrame) -> DataFrame:
    """host, node, inside, importance, most, seen of every branch of every site's style tree; `inside` an article or main element, `most` of any leaf."""
    names, kinds = ["host", "node", "inside", "content", "hash", "page"], (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                page = Page(source.decode("utf-8", "replace"))
                key = page_key(page)
                rows += [(host, node, inside, True, xxhash.xxh64_intdigest(text) - (1 << 63), key) for node, inside, _, text in page.blocks]
                rows += [(host, node, inside, False, xxhash.xxh64_intdigest(text) - (1 << 63), key) for node, inside, text in page.children]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    seen = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(observed, "host string, node string, inside boolean, content boolean, hash long, page long")
    counts = seen.groupBy("host", "node", "inside", "content", "hash").agg(F.count_distinct("page").alias("n"))
    n, total = F.col("n"), F.sum("n")
    entropy = F.when(total > 1, (F.log(total) - F.sum(n * F.log(n)) / total) / F.log(total)).otherwise(1.0)
    # read three times below: written, so that pages are parsed once for it
    own = cut(counts.groupBy("host", "node", "inside", "content").agg(total.alias("seen"), entropy.alias("entropy")), "nodes")
    # a node's branch: itself and all nodes above it
    labels = F.split("node", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(">", F.slice(labels, F.lit(1), k)))
    content = own.filter("content").select("host", F.explode(above).alias("node"), "inside", "seen", "entropy")
    content = content.groupBy("host", "node").agg((F.sum(F.col("seen") * F.col("entropy")) / F.sum("seen")).alias("content"), F.sum("seen").alias("seen"), F.max("inside").alias("inside"), F.max("entropy").alias("most"))
    shown = own.filter(~F.col("content")).groupBy("host", "node").agg((F.sum(F.col("seen") * F.col("entropy")) / F.sum("seen")).alias("shown"))
    importance = F.coalesce((1 - PRESENTATION) * F.col("content") + PRESENTATION * F.col("shown"), F.col("content"))
    return content.join(shown, ["host", "node"], "left").select("host", "node", "inside", importance.alias("importance"), "most", "seen")


def low_nodes(nodes: DataFrame, *, low: float = LOW, low_inside: float = LOW_INSIDE, low_beside: float = LOW_BESIDE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, low: the nodes to remove from each host's pages.

    A branch that holds any of an article or main element has the limit `low_inside`. Others are measured by the articles of their host: a host of few pages
    shows few repetitions in its frames, but fewer still in its articles. Headings, and hosts without such elements, have the limit `low`.
    """
    main = nodes.filter(F.col("inside") & (F.col("seen") >= least_pages)).groupBy("host").agg((F.sum(F.col("importance") * F.col("seen")) / F.sum("seen")).alias("main"))
    heading = F.element_at(F.split("node", ">"), -1).rlike(HEADING)
    beside = F.when(heading, low).otherwise(F.greatest(F.lit(low), F.coalesce(F.col("main") * low_beside, F.lit(low))))
    limit = F.when(F.col("inside"), low_inside).otherwise(beside)
    found = nodes.join(main, "host", "left").filter((F.col("node") != "") & (F.col("importance") < limit) & (F.col("most") < limit) & (F.col("seen") >= least_pages))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""
    low = cut(low_nodes(site_nodes(pages)), "low")
    # with few nodes to remove, pages stay where they are, and a host with a third of them is no task's own
    few = (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_NODES
    low = F.broadcast(low) if few else low
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("_host"), F.col("html").cast("string").alias("html"))
    placed = own.join(low.withColumnRenamed("host", "_host"), "_host", "left").select("page_id", "url", "html", "low")
    kind = {f.name: f.dataType.simpleString() for f in own.schema}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, gone in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                page = Page(source.decode("utf-8", "replace"))
                if gone:
                    page.cut(set(gone))
                out.append(" ".join([text for _, text in page.own()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    found = placed.mapInArrow(texts, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
