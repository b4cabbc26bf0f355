"""Questions with their context, answers with their links, annotations on pages, stickies with their places."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, grounding, highlight, locate, notes, retrieval
from test_locate_links import ITEM, item

ASKED = "query_id long, doc_id long, query string, selection string, bias string, task string"
LONG = " ".join(f"Sentence {i} of the paper speaks about controllers and errors." for i in range(1500))


def test_context_by_task(spark):
    chunks = chunking.chunk_documents(spark.createDataFrame([(1, "Abstract\nThe controller reduces errors by a third."), (2, LONG)], "doc_id long, text string")).cache()
    rows = [(1, 1, "what does it do", None, None, "chat"), (2, 1, "what does it do", None, None, "translate"), (3, 1, "  ", None, None, "chat"), (4, 9, "what", None, None, "chat"), (5, 2, "errors of sentence 7", None, None, "explain"), (6, 1, "q", None, None, None)]
    asked, titles = spark.createDataFrame(rows, ASKED), spark.createDataFrame([(1, "One")], "doc_id long, title string")
    config = retrieval.RetrievalConfig(stuff_token_limit=1000, top_k=2)
    found = {r["query_id"]: r for r in retrieval.attach_context(chunks, asked, titles, config).collect()}
    assert {q for q, r in found.items() if r["used_rag"]} == {1, 5} and all((r["context_block"] != "") == r["used_rag"] for r in found.values())
    whole = found[1]["context_block"].split("\n")
    assert whole[0] == "Paper: One" and whole[4:6] == ["", retrieval.CONTEXT_WHOLE] and whole[-2:] == ["", retrieval.CONTEXT_END] and "The controller reduces errors by a third." in whole
    parts = found[5]["context_block"]
    assert parts.startswith("Paper: \n") and retrieval.CONTEXT_PASSAGES in parts and parts.count("### Passage ") == 2 and "### Passage 1 (Body · ¶1" in parts
    bodies = [p.split("\n")[1] for p in parts.split("### Passage ")[1:]]
    assert all(b.endswith("…") and len(b) <= 1201 for b in bodies)
    off = retrieval.attach_context(chunks, asked, titles, retrieval.RetrievalConfig(enabled=False))
    assert off.filter("used_rag").count() == 0 and off.count() == 6
    with pytest.raises(ValueError):
        retrieval.attach_context(chunks, asked, titles, retrieval.RetrievalConfig(mode="hybrid"))


def test_answers_are_grounded(spark):
    chunks = chunking.chunk_documents(spark.createDataFrame([(1, "The adaptive controller reduces tracking errors by a third. Nothing else in this text is of any use."), (2, "Other words stand here.")], "doc_id long, text string"))
    answers = spark.createDataFrame([(10, 1, "The adaptive controller reduces tracking errors by a third."), (11, 2, "The adaptive controller reduces errors."), (12, 1, None)], "answer_id long, doc_id long, answer string")
    found = grounding.ground_answers(answers, chunks).collect()
    assert [(r["answer_id"], r["rank"]) for r in found] == [(10, 1)] and found[0]["phrase"] in "The adaptive controller reduces tracking errors by a third."


def test_annotations(spark):
    pages = locate.pages(spark.createDataFrame([item(1, 3, 0, "The controller reduces errors by a third", 0.0, 700.0)], ITEM))
    quote = "controller reduces errors by a third"
    rows = [(1, 1, "claim", quote, "r" * 5000, None), (2, 1, "method", "this quote is nowhere on any page", None, 3), (3, 1, "other", quote, None, 3), (4, 1, "caveat", quote, None, 3)]
    items = spark.createDataFrame(rows, "item_id long, doc_id long, category string, quote string, reason string, page_start int")
    applied, skipped = highlight.annotate(items, pages)
    a = {r["item_id"]: r for r in applied.collect()}
    assert set(a) == {1, 4} and {r["item_id"] for r in skipped.collect()} == {2, 3}
    assert a[1]["sort_index"] == "00002|000000|00000" and a[1]["page_index"] == 2 and a[1]["type"] == "highlight" and a[4]["color"] == "#ff6666" and a[4]["tags"] == ["auto", "auto/caveat"]
    assert len(a[1]["comment"]) == 4000 and a[4]["comment"].endswith("\n") and len(a[1]["rects"]) == 1
    assert highlight.without_automatic(applied.select("item_id", "tags").union(spark.createDataFrame([(9, ["mine"]), (8, None)], "item_id long, tags array<string>"))).count() == 2


def test_candidates(spark):
    units = chunking.units_of(chunking.chunk_documents(spark.createDataFrame([(1, LONG)], "doc_id long, text string")))
    found = highlight.candidates(highlight.select_passages(units), units).collect()
    assert found and all(r["text"] == r["text"].strip() and r["para_start"] == 1 and r["id"] for r in found)


def test_stickies_have_places(spark):
    shape = "id string, item_key string, answer string, x int, y int, w int, h int, collapsed boolean, pinned boolean, created_at string"
    old = spark.createDataFrame([("a", "k", "old", 1, 2, 3, 4, True, True, "1")], shape)
    new = spark.createDataFrame([("a", "k", "new", None, 9, None, None, None, False, "5"), ("b", "k", "x", None, None, None, None, None, None, "2"), ("c", "k", "y", None, None, 7, None, None, None, "3"), ("d", "m", "z", None, None, None, None, None, None, "3")], shape)
    found = {r["id"]: tuple(r)[2:9] for r in notes.upsert_stickies(old, new).collect()}
    assert found == {"a": ("new", 1, 9, 3, 4, True, True), "b": ("x", 24, 108, 320, 280, False, True), "c": ("y", 24, 136, 7, 280, False, True), "d": ("z", 24, 80, 320, 280, False, True)}


def test_previews_and_suffixes(spark):
    one = "A first sentence that is long enough to stand by itself, and then some more words so it is over eighty."
    cases = {None: "", "": "", one + " Next.": one, "Short.": "Short.", "A sentence of more than forty characters here. Second one! Third.": "A sentence of more than forty characters here. Second one!", "x" * 500: "x" * 320}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string").withColumn("got", T.cite_preview(F.col("t"))).collect()
    assert all(r["got"] == r["want"] for r in rows)
    places = spark.createDataFrame([(None, None, 1, 1), (2, 2, 3, 3), (2, None, 3, 5), (2, 4, 1, 1)], "a int, b int, c int, d int")
    assert [r[0] for r in places.select(T.locator_suffix((F.col("a"), F.col("b")), (F.col("c"), F.col("d")))).collect()] == ["", " ¶2 s3", " ¶2 s3–5", " ¶2–4"]
