from pyspark.sql import functions as F

from lectern.operators import highlight

QUOTES = {1: "мы показываем, что ошибка падает", 2: "我们的方法在所有实验中都显著减少了跟踪误差并且保持稳定性", 3: "electroencephalography magnetoencephalography", 4: "η μέθοδος μειώνει το σφάλμα", 5: "reduces the tracking error by a third", 6: "короткая", 7: "мы показываем, что ошибка растет"}
TEXTS = {10: "Итак,  Мы показываем, что\nошибка падает вдвое", 11: "因此,我们的方法在所有实验中都显著减少了跟踪误差并且保持稳定性。", 12: "bioelectroencephalography Magnetoencephalographys", 13: "Η μέθοδος μειώνει το σφάλμα και it reduces the tracking error by a third", 14: None, 15: "😀 мы показываем, что ошибка падает; мы показываем, что ошибка падает"}


def plain(text):
    return " ".join((text or "").lower().split())


def test_quotes_of_any_script_are_verified_by_substring(spark):
    quotes, texts = spark.createDataFrame(list(QUOTES.items()), "quote_id long, quote string"), spark.createDataFrame(list(TEXTS.items()), "text_id long, text string")
    found = sorted(tuple(r) for r in highlight.verify_quotes(quotes, texts).collect())
    assert found == sorted((q, t) for q, a in QUOTES.items() for t, b in TEXTS.items() if len(plain(a)) >= 24 and plain(a) in plain(b))
    assert {q for q, _ in found} == {1, 2, 3, 4, 5}
    assert highlight.verify_quotes(quotes.filter(F.col("quote_id") == 5), texts).count() == 1


def test_items_in_their_first_candidate(spark):
    from lectern.operators import highlight

    texts = {1: "Some passage that says the controller reduces errors by a third, and more.", 2: "Again the CONTROLLER  reduces errors by a third."}
    candidates = spark.createDataFrame([(1, r, t) for r, t in texts.items()] + [(2, 1, "Nothing like it stands in this one here.")], "doc_id long, rank int, text string")
    quote = "controller reduces errors by a third"
    rows = [(1, n, "claim", quote, None) for n in range(6)] + [(1, 10 + n, c, quote.upper(), "r") for n, c in enumerate(["method", "novelty", "caveat", "unknown", None] * 6)]
    rows += [(1, 50, "caveat", "too short a quote", None), (1, 51, "caveat", "again the controller reduces", None), (2, 1, "claim", quote, None), (1, 52, "claim", None, None), (None, 1, "claim", quote, None)]
    got = highlight.ground_items(spark.createDataFrame(rows, "doc_id long, n int, category string, quote string, reason string"), candidates).orderBy("place").collect()
    assert [(r.n, r.category, r.candidate) for r in got] == [*((n, "claim", 1) for n in range(4)), *((10 + 5 * i + k, c, 1) for k, c in enumerate(["method", "novelty", "caveat"]) for i in range(4))]
    assert highlight.ground_items(spark.createDataFrame([(1, 51, "caveat", "again the controller reduces", "")], "doc_id long, n int, category string, quote string, reason string"), candidates).first().candidate == 2


def test_queries_without_evidence_have_a_row(spark):
    from lectern.operators import chunking, retrieval
    from lectern.sources.tables import stored

    chunks = stored(chunking.chunk_documents(spark.createDataFrame([(1, "Some text of it here.")], "doc_id long, text string")))
    asked = spark.createDataFrame([(1, 1, "text", "", ""), (2, 9, "text", "", ""), (2, 9, "text", "", ""), (3, None, None, None, None)], "query_id long, doc_id long, query string, selection string, bias string")
    got = {r.query_id: r for r in retrieval.evidence_or_empty(asked, retrieval.retrieve(chunks, asked)).collect()}
    assert got[1].mode == "stuff" and (got[2].mode, got[2]["rank"], got[2].context_text, got[2].id) == ("empty", 0, "", None) and got[3].mode == "empty"
