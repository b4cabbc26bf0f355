"""Needles on pages against looking for each in turn."""

import random

from pyspark.sql import functions as F

from lectern.operators import locate, matching, search
from test_locate_links import ITEM, item

EVIDENCE = "doc_id long, query_id long, rank int, evidence_id long, anchor_text string, context_text string, text string, page_start int, page_end int"


def test_occurrences_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 3)))
    pages = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(900)]), " ".join(word() for _ in range(rnd.randint(0, 30)))) for _ in range(300)]
    needles = [(rnd.choice([1, 1, 2, 9, None]), rnd.choice([None, "", word(), word() + " " + word()])) for _ in range(200)]
    plain = {(d, n, p) for d, n in needles for e, p, t in pages if d is not None and d == e and n and n in t}
    for part, slice_ in ((256, 20_000), (7, 3)):
        monkeypatch.setattr(matching, "PART_PAGES", part)
        monkeypatch.setattr(matching, "SLICE_NEEDLES", slice_)
        found = matching.occurrences(spark.createDataFrame(needles, "doc_id long, needle string"), spark.createDataFrame(pages * 2, "doc_id long, page int, text string")).collect()
        assert len(found) == len(plain) and {tuple(r) for r in found} == plain and plain
    none = matching.occurrences(spark.createDataFrame([], "doc_id long, needle string"), spark.createDataFrame(pages, "doc_id long, page int, text string"))
    assert none.collect() == []


def plain_needle(text):
    import re

    words = [w for w in re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s.,;:%-]", " ", text)).strip().split(" ") if len(w) > 2]
    if len(words) < 4:
        return " ".join(words)[:48]
    start = min(4, max(0, len(words) - 10))
    return " ".join(words[start : start + 10])


def plain_page(needle, pages):
    if len(needle) < 8:
        return None
    low = needle.lower()
    vs = [v for v in (low[:36], low[:24], " ".join(low.split(" ")[:5])) if len(v) >= 8]
    return min((p for p, t in pages if any(v in " ".join(t.lower().split()) for v in vs)), default=None)


def test_pages_are_filled_by_search_alone(spark):
    rnd = random.Random(8)
    words = [f"{rnd.choice('abcdefgh')}{'nmr'[i % 3]}word{i}" for i in range(60)]
    pages = [(d, p, "  ".join(rnd.choice(words) for _ in range(60)).replace("word1", "WORD1\n")) for d in (1, 2) for p in range(1, 9)]
    texts = {d: " ".join(" ".join(t.split()) for e, _, t in pages if e == d) for d in (1, 2)}
    cut = lambda d: (s := rnd.randint(0, 3000), texts[d][s : s + rnd.randint(0, 200)])[1]
    rows = [(rnd.choice([1, 2]), 1, i, i, None, None, None, None, None) for i in range(80)]
    rows = [(d, q, r, e, *rnd.choice([(cut(d), "x", "y"), ("", cut(d), None), (None, None, cut(d)), (None, None, None), ("not to be found (anywhere) at all, in these pages", None, None)]), a, b) for d, q, r, e, _, _, _, a, b in rows]
    rows += [(1, 1, 100, 100, texts[1][:80], None, None, 7, None), (1, 1, 101, 101, texts[1][:80], None, None, 0, 0), (3, 1, 102, 102, texts[1][:80], None, None, None, None), (None, 1, 103, 103, texts[1][:80], None, None, None, None)]
    found = {r.evidence_id: r for r in search.fill_pages(spark.createDataFrame(rows, EVIDENCE), spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()}
    assert len(found) == len(rows)
    hits = 0
    for d, _, _, e, a, c, t, start, end in rows:
        r, mine = found[e], [(p, x) for b, p, x in pages if b == d]
        if start is not None:
            assert (r.page_start, r.page_end, r.via, r.page_index0) == (start, end, "known", start - 1 if start >= 1 else None)
            continue
        page = plain_page(plain_needle(a or c or t or ""), mine)
        hits += page is not None
        assert (r.page_start, r.page_end, r.page_index0) == ((page, page, page - 1) if page else (None, None, None))
        assert r.via == ("search" if page else "search-miss" if mine else "no-pages")
    assert hits > 30


def test_rects_for_the_first_that_are_found(spark):
    lines = [f"Line {n} of the page tells about controller number {n} and errors." for n in range(12)]
    pages = locate.pages(spark.createDataFrame([item(1, 1 + n // 6, n, line, 0.0, 700.0 - 20 * n) for n, line in enumerate(lines)], ITEM))
    rows = [(1, 5, n, n, line if n != 3 else "nothing that stands on any page of the document", None, None, None, None) for n, line in enumerate(lines)]
    rows += [(1, 6, 1, 20, lines[2], None, None, 2, 2), (1, 6, 2, 21, "short", None, None, None, None), (2, 6, 3, 22, lines[0], None, None, None, None)]
    asked = spark.createDataFrame(rows, EVIDENCE).withColumn("page_index0", F.lit(None).cast("int"))
    found = {r.evidence_id: r for r in search.fill_rects(asked, pages).collect()}
    assert [e for e in sorted(found) if e < 20 and found[e].rects] == [0, 1, 2, 4, 5, 6, 7, 8] and len(found) == 15
    assert found[7].page_start == 2 and found[7].page_index0 == 1 and found[3].page_start is None and found[11].page_start is None
    assert found[20].rects and found[20].page_start == 2 and found[20].page_index0 == 0 and not found[21].rects and not found[22].rects
    kept = search.fill_rects(spark.createDataFrame([tuple(found[20])], search.fill_rects(asked, pages).schema), pages).first()
    assert kept == found[20]


def test_quotes_of_one_number_in_two_documents(spark):
    text = "The controller reduces errors by a third"
    pages = locate.pages(spark.createDataFrame([item(1, 1, 0, text, 0.0, 700.0), item(2, 4, 0, text, 0.0, 700.0)], ITEM))
    quotes = spark.createDataFrame([(1, d, text, None) for d in (1, 2, 3, None)] + [(1, 1, None, None)], "quote_id long, doc_id long, quote string, hint int")
    assert sorted((r.doc_id, r.page) for r in locate.locate(quotes, pages).collect()) == [(1, 1), (2, 4)]


def test_soft_pages(spark):
    rows = spark.createDataFrame([("Abstract", 9), ("7 References", 9), ("Body (3)", 9), ("Abstract", 0), (None, 9), ("References", None)], "s string, n int")
    assert [r[0] for r in rows.select(search.soft_page(F.col("s"), F.col("n"))).collect()] == [1, 9, None, None, None, None]
