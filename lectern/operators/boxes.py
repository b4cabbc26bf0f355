"""Boxes on a screen as rectangles on pages: the union of a mark's boxes, the page that a box is on, and its place there in page units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The least side of a box, the least area of one that is not known to be an image, and the size of a page that gives none.
LEAST_SIDE, LEAST_AREA, PAGE_WIDTH, PAGE_HEIGHT = 28.0, 80.0 * 80.0, 612.0, 792.0
#: Side of the grid's cells by which boxes and pages meet.
CELL = 1024.0


def union_boxes(boxes: DataFrame) -> DataFrame:
    """(doc_id, key, left, top, right, bottom): around all boxes(doc_id, key, left, top, right, bottom, known) of a mark that are large enough; smaller ones count if they are known as images. Rows without a key go."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    large = (w >= LEAST_SIDE) & (h >= LEAST_SIDE) & (F.coalesce("known", F.lit(False)) | (w * h >= LEAST_AREA))
    kept = boxes.filter((F.coalesce("key", F.lit("")) != "") & large)
    return kept.groupBy("doc_id", "key").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL).cast("long"), F.floor(high / CELL).cast("long"))


def place_boxes(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, key, page_index, x1, y1, x2, y2) of boxes(doc_id, key, left, top, right, bottom) on pages(doc_id, page_index, left, top, right, bottom, x0, y0, width, height).

    A box is on the page that holds its middle; of several on that which it overlaps most, then on the first; a box whose middle is on no page counts as on its
    document's first. Page units grow upward, the screen's downward; a page without x0, y0, width or height is 612 x 792 from 0. Boxes meet pages by the
    cells of a grid, not all pages. Boxes of documents without pages, and boxes with a null side, have no row; (doc_id, key) is unique among boxes.
    """
    c = F.col
    middle = lambda a, b: (c(a) + c(b)) / 2
    asked = boxes.select("doc_id", "key", *[c(x).cast("double").alias(x) for x in ("left", "top", "right", "bottom")]).filter("left + top + right + bottom is not null")
    asked = asked.withColumns({"mx": middle("left", "right"), "my": middle("top", "bottom")}).withColumns({"cx": F.floor(c("mx") / CELL).cast("long"), "cy": F.floor(c("my") / CELL).cast("long")})
    sides = [c(x).cast("double").alias(f"p_{x}") for x in ("left", "top", "right", "bottom")]
    units = [F.coalesce(c(x).cast("double"), F.lit(d)).alias(x) for x, d in (("x0", 0.0), ("y0", 0.0), ("width", PAGE_WIDTH), ("height", PAGE_HEIGHT))]
    sheets = pages.select("doc_id", "page_index", *sides, *units).filter("p_left <= p_right and p_top <= p_bottom")
    celled = sheets.withColumn("cx", F.explode(_cells(c("p_left"), c("p_right")))).withColumn("cy", F.explode(_cells(c("p_top"), c("p_bottom"))))
    holds = c("mx").between(c("p_left"), c("p_right")) & c("my").between(c("p_top"), c("p_bottom"))
    shared = lambda a, b: F.greatest(F.lit(0.0), F.least(c(b), c(f"p_{b}")) - F.greatest(c(a), c(f"p_{a}")))
    met = asked.join(celled, ["doc_id", "cx", "cy"]).filter(holds).withColumn("__shared", shared("left", "right") * shared("top", "bottom"))
    best = met.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", "key").orderBy(F.desc("__shared"), "page_index"))).filter("__n = 1")
    first = sheets.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("page_index"))).filter("__n = 1")
    lost = asked.join(best.select("doc_id", "key"), ["doc_id", "key"], "left_anti").join(first, "doc_id")
    columns = ["doc_id", "key", "left", "top", "right", "bottom", "page_index", "p_left", "p_top", "p_right", "p_bottom", "x0", "y0", "width", "height"]
    on = best.select(*columns).union(lost.select(*columns))
    x = lambda v: c("x0") + (c(v) - c("p_left")) / F.greatest(c("p_right") - c("p_left"), F.lit(1.0)) * c("width")
    y = lambda v: c("y0") + (1 - (c(v) - c("p_top")) / F.greatest(c("p_bottom") - c("p_top"), F.lit(1.0))) * c("height")
    return on.select("doc_id", "key", "page_index", F.least(x("left"), x("right")).alias("x1"), F.least(y("top"), y("bottom")).alias("y1"), F.greatest(x("left"), x("right")).alias("x2"), F.greatest(y("top"), y("bottom")).alias("y2"))


# Fixed value: the rectangles of a link at most.
LINK_RECTS = 6


def encode_rects(rects: Column) -> Column:
    """The first rectangles as JSON, four numbers each, rounded to hundredths, halves up; empty for null or none. Numbers that aren't finite are null."""
    number = lambda x: F.coalesce(F.regexp_replace(F.when(F.abs(x) < 1e15, (F.floor(x * 100 + 0.5) / 100).cast("decimal(20,2)").cast("string")), r"\.?0+$", ""), F.lit("null"))
    rows = F.transform(F.slice(rects, 1, LINK_RECTS), lambda r: F.concat(F.lit("["), F.array_join(F.transform(F.slice(r, 1, 4), number), ","), F.lit("]")))
    return F.when(F.size(rects) > 0, F.concat(F.lit("["), F.array_join(rows, ",", "[]"), F.lit("]"))).otherwise("")


def parse_rects(raw: Column) -> Column:
    """Rectangles from JSON: of an array the elements that are arrays of four numbers or more, their first four; null if there are none."""
    rows = F.from_json(F.when(F.trim(raw).startswith("["), raw), "array<string>")
    numbers = lambda r: F.from_json(F.when(r.startswith("["), r), "array<string>")
    whole = F.filter(F.transform(rows, numbers), lambda r: (F.size(r) >= 4) & F.forall(r, lambda x: F.coalesce(x.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.lit(False))))
    found = F.transform(whole, lambda r: F.transform(F.slice(r, 1, 4), lambda x: x.cast("double")))
    return F.when(F.size(found) > 0, found)
