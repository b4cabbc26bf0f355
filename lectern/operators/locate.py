"""Quotes on pages: which text items a quote covers, and the rectangles around them.

Pages are arrays of text items. A quote is looked for in the page's letters and digits alone, so hyphens and odd
spaces don't matter; if it isn't there, its beginnings are tried, from 80 characters down to 24. Quotes meet the pages that hold their shortest beginning,
found for all quotes of a document in one reading (see matching.occurrences), and no others; what they cover there is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.matching import occurrences

# Sizes of quotes and rectangles.
QUOTE_MINIMUM, LONGEST_START, SHORTEST_START, STEP = 20, 80, 24, 4
SINGLE_ITEM_FROM, SINGLE_ITEM_SHARE = 40, 0.5
DESCENT, ASCENT, LEAST_SIDE, WIDEST, TALLEST = 0.25, 0.85, 0.5, 2000, 200
LINE_GAP, LINE_SHARE = 3.0, 0.6

RECT = "struct<x1:double,y1:double,x2:double,y2:double>"


def item_rect(item: Column) -> Column:
    """The rectangle of a text item(str, transform, width, height) in page units: its advance along its baseline, from a quarter of its size below to 0.85 above."""
    m = lambda i: F.coalesce(F.get(item["transform"], F.lit(i)), F.lit(1.0 if i in (0, 3) else 0.0))
    nonzero = lambda c: F.when(c != 0, c)
    scale_x = F.coalesce(nonzero(F.hypot(m(0), m(1))), F.lit(1.0))
    scale_y = F.coalesce(nonzero(F.hypot(m(2), m(3))), F.lit(1.0))
    width = F.coalesce(item["width"], F.lit(0.0))
    straight = F.abs(F.abs(m(0)) - scale_x) < 1e-3
    drawn = F.when((width > 0) & (width < WIDEST) & ~straight, width * scale_x).otherwise(width)
    w = F.when(drawn > 0, drawn).otherwise(scale_x * F.greatest(F.lit(1.0), F.length(T.whole(item["str"])) * 0.5))
    x, y = m(4), m(5)
    return F.struct(x.alias("x1"), (y - scale_y * DESCENT).alias("y1"), (x + F.abs(w)).alias("x2"), (y + scale_y * ASCENT).alias("y2"))


def is_valid(r: Column) -> Column:
    w, h = r["x2"] - r["x1"], r["y2"] - r["y1"]
    return (w > LEAST_SIDE) & (h > LEAST_SIDE) & (w < WIDEST) & (h < TALLEST)


def merge_rects(rects: Column) -> Column:
    """One box for each line of rectangles, from the top of the page down: a rectangle joins the first line whose first one's middle is near its own."""
    ordered = F.transform(F.array_sort(F.transform(F.filter(rects, is_valid), lambda r: F.struct((-r["y1"]).alias("down"), r["x1"].alias("x"), r.alias("r")))), lambda s: s["r"])
    none = F.expr(f"cast(array() as array<struct<mid:double,box:{RECT}>>)")
    mid = lambda r: (r["y1"] + r["y2"]) / 2

    def step(lines, r):
        near = lambda line: F.abs(line["mid"] - mid(r)) < F.greatest(F.lit(LINE_GAP), (r["y2"] - r["y1"]) * LINE_SHARE)
        at = F.coalesce(F.array_position(F.transform(lines, near), True), F.lit(0))
        grown = lambda b: F.struct(F.least(b["x1"], r["x1"]).alias("x1"), F.least(b["y1"], r["y1"]).alias("y1"), F.greatest(b["x2"], r["x2"]).alias("x2"), F.greatest(b["y2"], r["y2"]).alias("y2"))
        joined = F.transform(lines, lambda line, i: F.struct(line["mid"].alias("mid"), F.when(i + 1 == at, grown(line["box"])).otherwise(line["box"]).alias("box")))
        return F.when(at > 0, joined).otherwise(F.concat(lines, F.array(F.struct(mid(r).alias("mid"), r.alias("box")))))

    return F.aggregate(ordered, none, step, lambda lines: F.transform(lines, lambda line: line["box"]))


def pages(items: DataFrame) -> DataFrame:
    """(doc_id, page, items, letters): a row for each page of items(doc_id, page, item_idx, str, transform, width, height); items without text go. Each item has its letters' ``end`` on the page."""
    size = F.length(T.compact(F.col("str")))
    order = W.partitionBy("doc_id", "page").orderBy("item_idx", "str").rowsBetween(W.unboundedPreceding, 0)
    ended = items.filter(T.whole(F.col("str")) != "").withColumns({"size": size, "end": F.sum(size).over(order)})
    rows = ended.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("item_idx", "str", "end", "size", "transform", "width", "height"))).alias("items"))
    return rows.withColumn("letters", F.array_join(F.transform("items", lambda i: T.compact(i["str"])), ""))


def locate_on_page(items: Column, letters: Column, quote: Column) -> Column:
    """struct(first, last, rects) of a quote on a page: the items it covers and the boxes around them; null if it isn't there."""
    q = T.compact(quote)

    def found(n):
        start = F.instr(letters, F.left(q, n)) - 1
        first = F.size(F.filter(items, lambda i: i["end"] <= start)) + 1
        last = F.size(F.filter(items, lambda i: i["end"] < start + n)) + 1
        covered = F.slice(items, first, last - first + 1)
        thin = (first == last) & (n > SINGLE_ITEM_FROM) & (F.get(items, first - 1)["size"] < n * SINGLE_ITEM_SHARE)
        rects = merge_rects(F.transform(covered, item_rect))
        return F.when(~thin & (F.size(rects) > 0), F.struct(first.alias("first"), last.alias("last"), rects.alias("rects")))

    starts = F.when(F.length(q) >= SHORTEST_START, F.sequence(F.least(F.length(q), F.lit(LONGEST_START)), F.lit(SHORTEST_START), F.lit(-STEP))).otherwise(F.expr("cast(array() as array<int>)"))
    sizes = F.filter(F.concat(F.array(F.length(q)), starts), lambda n: F.contains(letters, F.left(q, n)))
    return F.when(F.length(q) >= QUOTE_MINIMUM, F.get(F.transform(F.slice(sizes, 1, 1), found), F.lit(0)))


def locate(quotes: DataFrame, page_rows: DataFrame) -> DataFrame:
    """(quote_id, doc_id, page, first, last, rects): each quote(quote_id, doc_id, quote, hint) on the first page that has it, its hint's page before all others.

    Quotes are told apart by document and id. Short, null and empty quotes are on no page; repeated quotes give one row.
    """
    q = T.compact(F.col("quote"))
    asked = quotes.select("quote_id", "doc_id", "quote", "hint", F.when(F.length(q) >= QUOTE_MINIMUM, F.left(q, F.lit(SHORTEST_START))).alias("needle"))
    pairs = occurrences(asked, page_rows.select("doc_id", "page", F.col("letters").alias("text")))
    met = asked.join(pairs, ["doc_id", "needle"]).join(page_rows, ["doc_id", "page"])
    met = met.withColumn("at", locate_on_page(F.col("items"), F.col("letters"), F.col("quote"))).filter("at is not null")
    order = W.partitionBy("doc_id", "quote_id").orderBy((F.col("page") == F.col("hint")).desc_nulls_last(), "page")
    first = met.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return first.select("quote_id", "doc_id", "page", "at.first", "at.last", "at.rects")
