"""Where texts come from, boxes on pages, mathematics in Markdown."""

import random
import time

from pyspark.sql import functions as F

from lectern.functions.math import dollars, normalize_math
from lectern.operators.boxes import place_boxes, union_boxes
from lectern.sources.resolve import candidate_items, resolve_texts

BOX = "doc_id long, key string, left double, top double, right double, bottom double"


def test_items_a_text_may_be_in(spark):
    items = spark.createDataFrame([(1, None, None), (2, 1, "application/pdf"), (3, 1, "text/html"), (4, 1, "x/PDF"), (5, 9, "application/pdf"), (6, None, None)], "item_id long, parent_id long, content_type string")
    asked = spark.createDataFrame([("a", 1), ("b", 5), ("c", 6), ("d", 77), ("e", None), ("f", 0), ("a", 1)], "doc_id string, item_id long")
    got = {}
    for r in candidate_items(asked, items).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append(r.item_id)
    assert got == {"a": [4, 2, 1, 3], "b": [5, 9], "c": [6], "d": [77]}


def test_the_first_text_that_is_long_enough(spark):
    long = "x" * 41
    rows = [
        (1, "fulltext", 1, 10, "getItemContent", long + "b"), (1, "fulltext", 1, 10, "ft-cache", " " * 50), (1, "fulltext", 2, 11, "ft-cache", long + "c"), (1, "reader", None, None, None, "short"), (1, "reindex", 1, 10, "read", long),
        (2, "reader", None, None, None, long), (2, "fulltext", 1, 12, "ft-cache", long + "d"), (2, "reader", None, None, None, long), (3, "fulltext", 1, 13, "ft-cache", None), (3, "unheard", 1, 13, "of", long), (9, "reader", None, None, None, long),
    ]
    found = spark.createDataFrame(rows, "doc_id long, source string, place int, item_id long, how string, text string")
    got = {r.doc_id: (r.text, r.source, r.attempts) for r in resolve_texts(spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long"), found).collect()}
    assert got == {
        1: (long + "b", "fulltext", ["reader:5", "fulltext:10:ft-cache:0", "fulltext:10:getItemContent:42"]), 2: (long, "reader", ["reader:41"]), 3: ("", "empty", ["fulltext:13:ft-cache:0"]), 4: ("", "empty", []),
    }


def test_boxes_against_all_pages(spark):
    rnd = random.Random(31)
    pages = [(d, i, 50.0 + 700 * (i % 2), 1300.0 * (i // 2), 700.0 + 700 * (i % 2), 1250.0 + 1300 * (i // 2), *rnd.choice([(None,) * 4, (10.0, 20.0, 500.0, 900.0)])) for d in (1, 2) for i in range(6)]
    # two pages that lie over each other
    pages += [(3, 0, 0.0, 0.0, 100.0, 100.0, None, None, 100.0, 100.0), (3, 1, 40.0, 0.0, 240.0, 100.0, None, None, 200.0, 100.0)]
    boxes = []
    for i in range(150):
        x, y = rnd.uniform(-200, 1500), rnd.uniform(-200, 4200)
        boxes.append((rnd.choice([1, 2]), f"b{i}", x, y, x + rnd.uniform(0, 300), y + rnd.uniform(0, 300)))
    boxes += [(3, "both", 30.0, 10.0, 90.0, 20.0), (3, "tie", 60.0, 10.0, 80.0, 20.0), (8, "no pages", 0.0, 0.0, 1.0, 1.0), (1, "half", None, 0.0, 1.0, 1.0)]

    def plain(d, left, top, right, bottom):
        mine = sorted(p for p in pages if p[0] == d)
        mx, my = (left + right) / 2, (top + bottom) / 2
        over = lambda p: max(0, min(right, p[4]) - max(left, p[2])) * max(0, min(bottom, p[5]) - max(top, p[3]))
        on = [p for p in mine if p[2] <= mx <= p[4] and p[3] <= my <= p[5]]
        p = min(on, key=lambda p: (-over(p), p[1])) if on else mine[0]
        x0, y0, w, h = (d if v is None else v for v, d in zip(p[6:], (0.0, 0.0, 612.0, 792.0), strict=True))
        xs = sorted(x0 + (v - p[2]) / (p[4] - p[2]) * w for v in (left, right))
        ys = sorted(y0 + (1 - (v - p[3]) / (p[5] - p[3])) * h for v in (top, bottom))
        return (p[1], *(round(v, 6) for v in (xs[0], ys[0], xs[1], ys[1])))

    got = place_boxes(spark.createDataFrame(boxes, BOX), spark.createDataFrame(pages, "doc_id long, page_index int, left double, top double, right double, bottom double, x0 double, y0 double, width double, height double"))
    found = {(r.doc_id, r.key): (r.page_index, *(round(r[x], 6) for x in ("x1", "y1", "x2", "y2"))) for r in got.collect()}
    assert found == {(b[0], b[1]): plain(b[0], *b[2:]) for b in boxes if b[0] != 8 and b[2] is not None} and found[3, "both"][0] == 0 and found[3, "tie"][0] == 0


def test_union_of_boxes(spark):
    rows = [(1, "a", 0.0, 0.0, 100.0, 100.0, False), (1, "a", 50.0, 90.0, 150.0, 190.0, None), (1, "a", 500.0, 0.0, 520.0, 100.0, True), (1, "b", 0.0, 0.0, 30.0, 30.0, True), (1, "c", 0.0, 0.0, 30.0, 30.0, False), (1, None, 0.0, 0.0, 300.0, 300.0, True), (2, "a", 1.0, 1.0, 99.0, 99.0, False)]
    got = union_boxes(spark.createDataFrame(rows, BOX + ", known boolean")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0.0, 0.0, 150.0, 190.0), (1, "b", 0.0, 0.0, 30.0, 30.0), (2, "a", 1.0, 1.0, 99.0, 99.0)]


MATH = {
    "a \\(x + y\\) b": "a $x + y$ b", "\\[ x \\]": "\n$$\nx\n$$\n", "```math\nx^2\n```": "\n$$\nx^2\n$$\n", "```LaTeX \r\nx\n``` z": "\n$$\nx\n$$\n z", "```python\n\\(x\\)\n```": "```python\n\\(x\\)\n```",
    "`\\(x\\)` and \\(y\\)": "`\\(x\\)` and $y$", "a ` b\n\\(x\\) `": "a ` b\n$x$ `", "$$ \\(x\\) $$ \\(y\\)": "$$ \\(x\\) $$ $y$", "\\begin{equation*} E \\end{equation*}": "\n$$\nE\n$$\n",
    "\\begin{align} a &= b \\\\[4pt] c \\end{align}": "\n$$\n\\begin{align} a &= b \\\\[4pt] c \\end{align}\n$$\n", "\\begin{align} x \\end{align*}": "\\begin{align} x \\end{align*}", "\\( open and \\[ y \\]": "\\( open and \n$$\ny\n$$\n", "": "", "plain $x$": "plain $x$",
}


def test_mathematics(spark):
    assert {t: dollars(t) for t in MATH} == MATH
    got = spark.createDataFrame([*[(t,) for t in MATH], (None,)], "t string").select("t", normalize_math(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in got} == MATH | {None: None}


def test_mathematics_in_long_texts_with_open_marks():
    start = time.process_time()
    for piece in ("\\( ", "\\[ ", "``` ` ", "$$", "\\begin{align} ", "` \n", "\\(x\\) `y` "):
        dollars(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 40
