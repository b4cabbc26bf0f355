"""How far the sources of a language differ in their words: a joint walk over a quadtree of counts (operator 12).

Of each language the terms in at least LEAST_DOCS of its documents are kept. A group (language and source) gives each term a price
p from its count there, in parts of SCALE, and what sets group g apart from h is the sum over all terms of f(p, q) = (p - q)^2 / q, rounded down
term by term. The matrix of groups by terms is nearly empty, so it is never laid out:

- Where both groups have no counts, all terms cost the same, f(z_g, z_h) with z the price of a count of 0. Where only one of them has
  counts, costs depend on these alone. Both are priced analytically, as if everywhere: V times f(z_g, z_h), and from how often g has each price
  p, the sums of f(p, z_h) - f(z_g, z_h); the same for h.
- What is left is a correction for cells in which both have counts. The nonzero cells of a block of terms are leaves of a
  2 x 2 quadtree in Z-order (bit masks of children, places by rank). Pairs of groups go down the tree together, and only into quadrants that
  are not all zero for either; a quadrant that is empty for one of them costs nothing, as its price is known.

All is exact: prices by decimal division, f and sums in 64-bit integers (f is 10^18 at most, as SCALE is 10^9).
Terms are spread over blocks by number, as many as the sum of squares of their columns asks for, so no task holds a language. A walk
goes on with at most CHUNK pairs of nodes at a time, whatever the block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, cut, table

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of UTF-8 that make up a term are A-Z (as a-z), a-z and all that isn't ASCII; others are spaces.
_PLAIN = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of text that a task counts at a time, and rows that it hands on at a time.
SLAB, ROWS = 24 << 20, 50_000
#: Pairs of cells in a block, about, and pairs of nodes that a walk expands at a time.
PAIRS, CHUNK = 1 << 18, 1 << 18
#: Rows of a table of groups or languages that is broadcast, by its exact count; a row is a few numbers and two names.
SMALL = 20_000
#: Parts of a group's prices, so that no row holds all of them.
PARTS = 16


def _rows(group: np.ndarray, names: list[tuple[str, str]], term: np.ndarray, terms: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed by group and term, from a row for each document and distinct term of it."""
    key = group * len(terms) + term
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    key = key[order][starts]
    total, docs = np.add.reduceat(n[order], starts), np.diff(starts, append=len(order))
    lang, source = (pa.array(x, pa.string()).take(pa.array(key // len(terms))) for x in zip(*names, strict=True))
    whole = pa.RecordBatch.from_arrays([lang, source, terms.cast(pa.string()).take(pa.array(key % len(terms))), pa.array(total), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])
    yield from (whole.slice(at, ROWS) for at in range(0, len(key), ROWS))


def _slab(docs: list[tuple[tuple[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    """The counts of some documents, as arrays throughout: bytes that are no term's are spaces."""
    raw = b" ".join(text for _, text in docs) + b" "
    letters = np.frombuffer(raw, np.uint8)
    inside = letters != 32
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside])]).dictionary_encode()
    doc = np.searchsorted(np.cumsum([len(text) + 1 for _, text in docs]), starts, side="right")
    key, n = np.unique(doc * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
    numbers: dict[tuple[str, str], int] = {}
    groups = np.array([numbers.setdefault(group, len(numbers)) for group, _ in docs])
    yield from _rows(groups[key // len(words.dictionary)], list(numbers), key % len(words.dictionary), words.dictionary, n)


def _long(group: tuple[str, str], raw: bytes) -> Iterator[pa.RecordBatch]:
    """The counts of one document by pieces, cut between terms."""
    counts, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + SLAB)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    if counts:
        yield from _rows(np.zeros(len(counts), np.int64), [group], np.arange(len(counts)), pa.array(counts, pa.binary()), np.fromiter(counts.values(), np.int64, len(counts)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), summed over SLAB bytes of text at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            lang, source, text = (x.as_py() for x in row)
            raw = text.encode().translate(_PLAIN)
            if len(raw) > SLAB:
                yield from _long((lang, source), raw)
                continue
            held.append(((lang, source), raw))
            size += len(raw)
            if size > SLAB:
                yield from _slab(held)
                held, size = [], 0
    if held:
        yield from _slab(held)


def columns(docs: DataFrame) -> DataFrame:
    """A written table (lang, term, id, total, cells array<struct<source, n>>): the kept terms of docs(lang, source, text), with their counts by source."""
    counts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return cut(found.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", F.monotonically_increasing_id().alias("id"), "total", "cells"))


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact for any counts; null without terms."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.when(terms > 0, _div(wide(n + 1, 19) * wide(F.lit(SCALE), 10), wide(total + terms, 19)) + 1)


def _div(a: Column, b: Column) -> Column:
    """Whole division; of numbers above 0, and of decimals too, rounded down."""
    return F.call_function("div", a, b)


def cost(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs."""
    return _div((p - q) * (p - q), q)


def few(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has SMALL rows at most."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


class Quadtree:
    """The nonzero cells of a matrix as leaves of a 2 x 2 quadtree in Z-order: for each node a mask of its children and the place of the first of them."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray):
        self.height = int(max(rows.max(), cols.max())).bit_length()
        code = np.zeros(len(rows), np.int64)
        for b in range(self.height):
            code |= ((rows >> b & 1) << (2 * b + 1)) | ((cols >> b & 1) << (2 * b))
        #: Where the cells' leaves are from: leaf i is cell order[i].
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        self.masks: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        for _ in range(self.height):
            child, code = code & 3, code >> 2
            first = np.flatnonzero(np.diff(code, prepend=-1))
            self.masks.append(np.add.reduceat(1 << child, first))
            self.firsts.append(first)
            code = code[first]

    def joint_leaves(self, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of different leaves of one column, the upper row first, by going down in pairs of rows."""
        rank = np.array([[bin(mask & ((1 << c) - 1)).count("1") for c in range(4)] for mask in range(16)])
        root = np.zeros(1, np.int64)
        todo = [(self.height, root, root)]
        while todo:
            level, a, b = todo.pop()
            if len(a) > chunk:
                todo += [(level, a[:chunk], b[:chunk]), (level, a[chunk:], b[chunk:])]
                continue
            if not level:
                apart = a != b
                if apart.any():
                    yield a[apart], b[apart]
                continue
            masks, firsts = self.masks[level - 1], self.firsts[level - 1]
            mask_a, mask_b, same, lefts, rights = masks[a], masks[b], a == b, [], []
            for upper in (0, 1):
                for lower in (0, 1):
                    for col in (0, 1):
                        x, y = 2 * upper + col, 2 * lower + col
                        # a quadrant that is all zero for either of the two is left out: its price is known
                        both = (mask_a >> x & 1 == 1) & (mask_b >> y & 1 == 1)
                        if upper > lower:
                            both &= ~same
                        if both.any():
                            lefts.append(firsts[a[both]] + rank[mask_a[both], x])
                            rights.append(firsts[b[both]] + rank[mask_b[both], y])
            if lefts:
                todo.append((level - 1, np.concatenate(lefts), np.concatenate(rights)))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def corrections(block: pd.DataFrame) -> pd.DataFrame:
    """(lang, g, h, value): what the cells that g and h share change in their sum, over a block(lang, id, g, p, z) of terms."""
    names, rows = np.unique(block["g"].to_numpy(np.int64), return_inverse=True)
    cols = np.unique(block["id"].to_numpy(np.int64), return_inverse=True)[1]
    tree = Quadtree(rows, cols)
    rows, p, z = rows[tree.order], block["p"].to_numpy(np.int64)[tree.order], block["z"].to_numpy(np.int64)[tree.order]
    keys, values = [], []
    for a, b in tree.joint_leaves():
        for x, y in ((a, b), (b, a)):
            more = _f(p[x], p[y]) - _f(p[x], z[y]) - _f(z[x], p[y]) + _f(z[x], z[y])
            key = rows[x] * len(names) + rows[y]
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            keys.append(key[order][starts])
            values.append(np.add.reduceat(more[order], starts))
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    return pd.DataFrame({"lang": pd.Series([block["lang"].iloc[0]] * len(key), dtype=object), "g": names[key // len(names)], "h": names[key % len(names)], "value": np.concatenate(values) if values else key})


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of docs: in part ``pair`` all other sources of its language, in ``term`` the ``top`` terms it has more of than its language.

    Null lang, source and text count as empty. A group without a kept term has prices all the same; a language without one gives pairs of
    value 0 and no terms. Equal values rank by item. Repeated rows count repeatedly; an empty table gives no rows. Other columns don't matter.
    """
    whole = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = columns(whole)
    k = F.size("cells").cast("long")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("size"), F.ceil(F.sum(k * k) / PAIRS).cast("long").alias("blocks"))
    cells = kept.select("lang", "id", "term", "total", F.explode("cells").alias("c")).select("lang", "id", "term", "total", "c.source", "c.n")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = whole.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left")
    groups = groups.withColumns({"n": F.coalesce("n", F.lit(0)), "terms": F.coalesce("terms", F.lit(0))})
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long")
    groups = cut(groups.select("lang", "source", "n", "terms", number.alias("g"), price(F.lit(0), F.col("n"), F.col("terms")).alias("z")))
    langs = cut(langs)
    by_group, by_lang = few(groups.select("lang", "source", F.col("n").alias("group_size"), "g", "z")), few(langs)
    priced = cells.join(by_lang, "lang").join(by_group, ["lang", "source"])
    priced = cut(priced.select(
        "lang", "source", "term", "id", "g", "z", "blocks", price(F.col("n"), F.col("group_size"), F.col("terms")).alias("p"), price(F.col("total"), F.col("size"), F.col("terms")).alias("q")))

    own = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(own))
    more = ranked(priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), cost(F.col("p"), F.col("q")).alias("value"))).filter(F.col("rank") <= top)

    here = groups.select("lang", "g", "z", "terms")
    others = few(here.select("lang", F.col("g").alias("h"), F.col("z").alias("y")))
    # every pair of groups is a row of the result
    base = here.join(others, "lang").filter("g <> h").select("lang", "g", "h", F.coalesce(F.col("terms") * cost(F.col("z"), F.col("y")), F.lit(0).cast("long")).alias("value"))
    often = priced.groupBy("lang", "g", "z", "p").agg(F.count("*").alias("m"))
    often = often.groupBy("lang", "g", "z", F.pmod("p", F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("p", "m")).alias("ps"))
    total = lambda of: F.aggregate("ps", F.lit(0).cast("long"), lambda s, x: s + x["m"] * of(x["p"]))
    z, y = F.col("z"), F.col("y")
    margins = often.join(others, "lang").filter("g <> h").select("lang", F.explode(F.array(
        F.struct(F.col("g").alias("g"), F.col("h").alias("h"), total(lambda p: cost(p, y) - cost(z, y)).alias("value")),
        F.struct(F.col("h").alias("g"), F.col("g").alias("h"), total(lambda p: cost(y, p) - cost(y, z)).alias("value")),
    )).alias("x")).select("lang", "x.*")
    shared = priced.select("lang", "id", "g", "p", "z", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    shared = shared.groupBy("lang", "block").applyInPandas(corrections, "lang string, g long, h long, value long")
    sums = base.union(margins).union(shared).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "g", "source")
    pairs = sums.join(few(names), ["lang", "g"]).join(few(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))), ["lang", "h"])
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.union(more.select(*pairs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), toks AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM toks GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST_DOCS}),
cells AS (SELECT lang, source, term, count(*) AS n FROM toks SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN cells USING (lang, source) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
priced AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS p, 1 + {SCALE}::HUGEINT * (k.total + 1) // (l.n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM priced WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
QUALIFY part = 'pair' OR rank <= {TOP}"""
