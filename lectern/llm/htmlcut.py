"""Main text of web pages by minimum-cut labelling (operator 9).

A page is read into text blocks. A logistic classifier gives each block the evidence that it is
content; its two costs become the capacities of the block's edges to source and sink. Neighbouring
blocks, and blocks that follow each other under one element, are joined by smoothness edges that
grow as the blocks are closer in the document tree. The minimum cut of this graph, found by
maximum flow, separates content from boilerplate; blocks whose own evidence outweighs all their
edges are settled first, which leaves the cut as it is.

The classifier is fitted on a bounded sample of whole pages, from the weights in PRIOR on: texts that pages repeat
and semantic elements label some of their blocks. Scripts, styles, forms and other elements without text to read are never
blocks. Every page is one row of a map; nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, table

#: Pages the classifier is fitted on at most, and pages of them on which a boilerplate text stands.
SAMPLE_PAGES = 2000
REPEATED = 3
ADJACENT, SIBLING = 0.5, 1.0

# HTML elements by their role, and words of class, id and role attributes.
SILENT = frozenset("script style noscript template head title svg math canvas object embed iframe audio video map form button select textarea input label fieldset datalist dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr picture source".split())
#: Silent elements that may stand inside a line of text: they end no block.
PHRASING = frozenset("script style noscript template svg math canvas object embed iframe audio video map button select textarea input label datalist".split())
BOILER_TAGS = frozenset("nav footer aside header menu".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright disclaimer disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe tags toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

FEATURES = ("bias", "boiler_tag", "boiler_word", "content_tag", "content_word", "heading", "link_share", "long", "ends", "words", "outside")
#: The weights the fit starts from.
PRIOR = np.array([0.6, -8.0, -7.0, 3.0, 1.0, 0.5, -3.5, 0.8, 0.5, 0.3, -3.0])
#: Precision of the prior: about this many labelled blocks weigh as much as it.
STIFF = 25.0

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What a tag holds up to its end; quotes count after an equals sign only.
_ATTRIBUTES = re.compile(r"""((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]|=)*+)>""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_ENDS = frozenset(".!?:;…。！？\"'”»)")


class Block:
    __slots__ = ("text", "path", "parent", "heading", "linked")

    def __init__(self, text, path, parent, heading, linked):
        self.text, self.path, self.parent, self.heading, self.linked = text, path, parent, heading, linked


class _Element:
    __slots__ = ("tag", "up", "depth", "boiler_tag", "boiler_word", "content_tag", "content_word", "silent", "form", "nearest", "block")

    def __init__(self, tag: str, attributes: str, up: _Element | None):
        words = {w.lower() for m in _NAMES.findall(attributes) for w in _PART.findall(" ".join(m))} if attributes else ()
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        inherit = (lambda name: getattr(up, name)) if up else (lambda name: False)
        fresh = tag in CONTENT_TAGS
        self.boiler_tag = tag in BOILER_TAGS or inherit("boiler_tag")
        self.boiler_word = bool(words and tag not in ("html", "body") and not BOILER_WORDS.isdisjoint(words)) or inherit("boiler_word")
        self.content_tag = fresh or inherit("content_tag")
        self.content_word = bool(words and not CONTENT_WORDS.isdisjoint(words)) or inherit("content_word")
        self.silent = tag in SILENT and tag != "form" or inherit("silent")
        self.form = tag == "form" or not fresh and inherit("form")
        self.nearest = tag if fresh or tag in BOILER_TAGS else up.nearest if up else ""
        self.block = self if tag not in INLINE and tag not in PHRASING else up.block if up else self


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, text or attributes) of a page in order, kind being "text", "open" or "close"; comments and declarations are left out.

    Linear in the page. What follows a script or another raw element is read up to its end tag. A tag that isn't closed up to
    the end of the page by rights ends at the next >, quoted or not, and so do those after it; without one, its < is text.
    """
    at, loose = 0, False
    while at < len(source):
        if source[at] != "<":
            end = source.find("<", at)
            end = end if end >= 0 else len(source)
            yield "text", "", source[at:end]
            at = end
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(source)
        elif m := _TAG.match(source, at):
            held = None if loose else _ATTRIBUTES.match(source, m.end())
            if held:
                attributes, at = held[1], held.end()
            else:
                loose, end = True, source.find(">", m.end())
                if end < 0:
                    yield "text", "", source[at:]
                    return
                attributes, at = source[m.end() : end], end + 1
            tag = m[2].lower()
            yield "close" if m[1] else "open", tag, attributes
            if tag in RAW and not m[1]:
                at = _RAW_END[tag].search(source, at).start()
        elif source[at + 1 : at + 2] in ("!", "?", "/"):
            end = source.find(">", at)
            at = end + 1 if end >= 0 else len(source)
        else:
            yield "text", "", "<"
            at += 1


#: Items that an opening element ends, beside paragraphs.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in its order; markup that isn't well formed is read as browsers do, more or less.

    Blocks of forms are left out, but for an article in one and for a form that holds all the page has beside boilerplate.
    """
    found: list[Block] = []
    root = here = _Element("html", "", None)
    open_, parts = Counter(), []
    linked = links = 0
    heading = False

    def close():
        nonlocal linked, heading
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, here, here.block, heading, min(1.0, linked / max(1, sum(map(len, parts))))))
            parts.clear()
        linked, heading = 0, False

    def leave(upto: _Element):
        nonlocal here, links
        while here is not upto:
            links -= here.tag == "a"
            open_[here.tag] -= 1
            here = here.up

    for kind, tag, rest in tokens(page or ""):
        if kind == "text":
            if not here.silent:
                parts.append(rest)
                linked += len(rest) if links else 0
                heading = heading or here.block.tag in HEADINGS
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE and tag not in PHRASING:
            close()
        if kind == "close":
            if open_[tag]:
                up = here
                while up.tag != tag:
                    up = up.up
                leave(up.up)
            continue
        if tag in VOID or rest.endswith("/") and tag in SILENT:
            continue
        if tag in CLOSES_PARAGRAPH or tag in SAME or tag == "option":
            same = SAME.get(tag, ("p",))
            if any(open_[t] for t in same):
                up = here
                while up is not root and (up.tag in INLINE or up.tag == "p") and up.tag not in same:
                    up = up.up
                if up is not root and up.tag in same:
                    leave(up.up)
        here = _Element(tag, rest, here)
        open_[tag] += 1
        links += tag == "a"
    close()
    free = [b for b in found if not b.path.form]
    return free if any(not (b.path.boiler_tag or b.path.boiler_word) for b in free) else found


def features(found: list[Block]) -> np.ndarray:
    rows, marked = [], any(b.path.content_tag for b in found)
    for b in found:
        e = b.path
        # a heading in an article's own header is the article's
        boiler = e.boiler_tag and not (b.heading and e.content_tag and e.nearest == "header")
        words = b.text.count(" ") + 1
        rows.append((1, boiler, e.boiler_word, e.content_tag, e.content_word, b.heading, round(b.linked, 2), min(1.0, len(b.text) / 200), b.text[-1] in _ENDS, min(1.0, words / 40), marked and not e.content_tag))
    return np.array(rows, float).reshape(-1, len(FEATURES))


def _distance(a: _Element, b: _Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, ADJACENT / (1 + _distance(found[i - 1].parent, b.parent))))
        up = b.parent.up if b.parent.up is not None else b.parent
        if id(up) in last:
            out.append((last[id(up)], i, SIBLING / (1 + _distance(found[last[id(up)]].parent, b.parent))))
        last[id(up)] = i
    return out


def minimum_cut(evidence: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it is on the source's side of a minimum cut: evidence > 0 ties it to the source, < 0 to the sink."""
    pull = list(evidence)
    near: list[dict[int, float]] = [{} for _ in pull]
    for a, b, w in links:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * len(pull)
    queue = deque(range(len(pull)))
    while queue:  # a node that outweighs its edges is settled, and pulls its neighbours
        i = queue.popleft()
        if side[i] is None and abs(pull[i]) >= sum(near[i].values()):
            side[i] = pull[i] > 0
            for j, w in near[i].items():
                pull[j] += w if side[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        for i, s in zip(rest, _max_flow(rest, pull, near), strict=True):
            side[i] = s
    return side


def _max_flow(nodes: list[int], pull: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by levels: all shortest paths are filled before longer ones; True for the nodes that the source still reaches."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if pull[i] > 0:
            room[source][i], room[i][source] = pull[i], 0.0
        else:
            room[i][sink], room[sink][i] = -pull[i], 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, r in room[i].items():
                if r > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return [i in level for i in nodes]
        onward = {i: [j for j in room[i] if level.get(j, -1) == level[i] + 1] for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:]))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] += flow
                path = path[: next(n for n, (a, b) in enumerate(steps) if room[a][b] <= 1e-9) + 1]
            elif not onward[i]:
                path.pop()
                if path:
                    onward[path[-1]].pop()
            elif room[i][onward[i][-1]] > 1e-9:
                path.append(onward[i][-1])
            else:
                onward[i].pop()


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    side = minimum_cut((features(found) @ weights).tolist(), edges(found))
    return " ".join(b.text for b, s in zip(found, side, strict=True) if s)


def _sampled_blocks(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(page, block, x): a hash of each block's text and its features."""
    for batch in pages:
        rows = []
        for n, page in zip(batch["page"], batch["html"], strict=True):
            found = blocks(page)
            rows += [(n, zlib.crc32(b.text.encode("utf-8", "replace")) << 31 | len(b.text), x.tolist()) for b, x in zip(found, features(found), strict=True)]
        yield pd.DataFrame(rows, columns=["page", "block", "x"])


def sample(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page long, html): SAMPLE_PAGES pages at most, those with the least hash of the key and the html; repeated rows are one."""
    draw = F.xxhash64(F.lit("html"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(html), F.lit("")))
    picks = pages.select(draw.alias("page")).distinct().orderBy("page").limit(SAMPLE_PAGES)
    return pages.select(draw.alias("page"), F.col(html).alias("html")).join(F.broadcast(picks), "page").groupBy("page").agg(F.first("html").alias("html"))


def fit(pages: DataFrame, key: str = "page_id", html: str = "html") -> np.ndarray:
    """Weights fitted on the whole blocks of sampled pages, from PRIOR on.

    A block is labelled content if it is in an element for content and nothing says boilerplate; it is labelled boilerplate if its
    elements say so, or if it is in no element for content and its text stands on REPEATED or more pages of the sample, which the
    classifier can't see. Text that whole copies of a page repeat is in elements for content and stays content.
    """
    found = cut(sample(pages, key, html).mapInPandas(_sampled_blocks, "page long, block long, x array<double>"))
    seen = found.groupBy("block").agg(F.count_distinct("page").alias("pages"))
    said = lambda name: F.col("x")[FEATURES.index(name)] > 0
    boiler = said("boiler_tag") | said("boiler_word") | ((F.col("pages") >= REPEATED) & ~said("content_tag"))
    content = said("content_tag")
    labelled = found.join(seen, "block").withColumn("y", F.when(boiler, 0.0).when(content, 1.0)).dropna(subset=["y"])
    # long and words are shares of whole numbers: a bounded number of distinct rows
    rows = labelled.groupBy("x", "y").count().collect()
    w = PRIOR.copy()
    if not rows:
        return w
    x, y, n = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["count"] for r in rows], float)
    n *= min(1.0, 1000 / n.sum())
    loss = lambda v: float((n * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + STIFF / 2 * ((v - PRIOR) ** 2).sum())
    for _ in range(25):  # Newton steps, halved until they lead down
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - STIFF * (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + STIFF * np.eye(len(w)), slope)
        for half in 0.5 ** np.arange(20):
            if loss(w + half * step) < loss(w):
                w = w + half * step
                break
        else:
            break
    return w


def extract(pages: DataFrame, html: str, weights: np.ndarray) -> DataFrame:
    """pages with ``main_text``, the content blocks joined by a space; empty for null or empty html and pages without content.

    A row for each row of pages; repeated rows have equal texts, an empty table gives none. A column main_text is replaced.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(page, weights) for page in series], dtype=object)

    return pages.drop("main_text").withColumn("main_text", text(F.col(html)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract(pages.select("page_id", "url", "html"), "html", fit(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
