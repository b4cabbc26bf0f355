from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import grounding, links, locate

ITEM = "doc_id long, page int, item_idx int, str string, transform array<double>, width double, height double"


def item(doc, page, i, text, x, y):
    return (doc, page, i, text, [10.0, 0.0, 0.0, 10.0, x, y], 5.0 * len(text), 10.0)


def test_quote_over_two_lines(spark):
    rows = [item(1, 1, 0, "Nothing of it here at all", 0.0, 700.0), item(1, 2, 0, "We found that the con-", 0.0, 700.0), item(1, 2, 1, "troller reduces errors", 0.0, 680.0), item(1, 2, 2, "by a third.", 120.0, 680.0), item(1, 2, 3, "The end", 0.0, 600.0)]
    pages = locate.pages(spark.createDataFrame(rows, ITEM))
    quotes = spark.createDataFrame([(1, 1, "the controller reduces errors by a third", 1), (2, 1, "a quote that no page of it has anywhere", None), (3, 1, "short", 2)], "quote_id long, doc_id long, quote string, hint int")
    found = locate.locate(quotes, pages).collect()
    assert [(r["quote_id"], r["page"], r["first"], r["last"]) for r in found] == [(1, 2, 1, 3)]
    assert [tuple(x) for x in found[0]["rects"]] == [(0.0, 697.5, 110.0, 708.5), (0.0, 677.5, 175.0, 688.5)]


def test_three_rects_make_two_lines(spark):
    rects = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(r, ("x1", "y1", "x2", "y2"), strict=True)]) for r in ((0, 100, 50, 110), (60, 101, 90, 111), (0, 80, 40, 90), (0, 0, 0.1, 5))])
    assert len(spark.range(1).select(locate.merge_rects(rects).alias("r")).first()["r"]) == 2


def test_phrases_and_links(spark):
    rows = spark.createDataFrame([("The Controller reduces tracking-error quickly", "controller reduces tracking error"), ("unrelated words only", "something else entirely")], "claim string, sentence string")
    assert [r[0] for r in rows.select(links.link_phrase(F.col("claim"), T.tokens(F.col("claim")), T.tokens(F.col("sentence")))).collect()] == ["Controller reduces tracking-error", None]
    answer = 'See <a href="x">the controller</a> and the controller reduces & more'
    assert links.insert_links(answer, [("the controller", "#1"), ("reduces &", "#2")]) == 'See <a href="x">the controller</a> and <a href="#1">the controller</a> <a href="#2">reduces &amp;</a> more'
    answers = spark.createDataFrame([(1, "the controller works"), (2, "nothing")], "id long, answer string")
    put = links.apply_links(answers, spark.createDataFrame([(1, 1, "controller", "#p")], "id long, rank int, phrase string, target string"), ["id"])
    assert {r["linked"] for r in put.collect()} == {'the <a href="#p">controller</a> works', "nothing"}


def test_grounded_links_need_a_phrase(spark):
    # the highest score shares short tokens only, so the second-best sentence is the claim's
    rows = [("a", 1, 1, 0, "we use it or do so by an ox"), ("b", 1, 1, 1, "ab cd")]
    claims = spark.createDataFrame([*rows, ("c", 1, 1, 2, "controller error is low")], "claim_id string, doc_id long, turn long, claim_no long, claim string")
    sentences = spark.createDataFrame([(1, 1, "ox an by so do or it use we"), (1, 2, "error of the controller is low"), (1, 3, "we go and use it or do so by an elk")], "doc_id long, pos long, text string")
    best = {r["claim_id"]: (r["pos"], r["phrase"]) for r in grounding.best_sentences(claims, sentences, ["doc_id"]).collect()}
    assert best == {"a": (3, "use it or do so by an"), "c": (2, "controller error")} or best == {"a": (3, "use it or do so by an"), "c": (2, "is low")}
    matched = spark.createDataFrame([(1, 1, n, f"sentence {n}", 0.5, "abc" if n < 6 else f"phrase {n}") for n in range(8)], "doc_id long, turn long, claim_no long, text string, score double, phrase string")
    assert sorted(r["claim_no"] for r in grounding.links(matched, ["doc_id", "turn"]).collect()) == [6, 7]
