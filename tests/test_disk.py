"""What keeps shuffles and stored tables in proportion to the input."""

import random
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import highlight, matching, scoring, search
from lectern.plans import catalogue


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _units(spark):
    rnd = random.Random(3)
    words = [f"word{c}" for c in "abcdefghij"]
    units = spark.createDataFrame([(n, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for n in range(200)] + [(200, None)], "unit long, text string")
    return units, spark.createDataFrame([(q, " ".join(rnd.choices(words, k=5))) for q in range(8)] + [(8, "unheard"), (9, None)], "query_id long, query string")


def test_products_of_postings_and_queries_are_not_shuffled(spark, monkeypatch):
    units, queries = _units(spark)
    found = scoring.bm25(units, ["unit"], queries)
    assert not re.search(r"hashpartitioning\(query_id#\w+, unit#|hashpartitioning\(unit#\w+, len#", _executed(found))
    rows = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(scoring, "FEW_TERMS", 0)
    joined = scoring.bm25(units, ["unit"], queries)
    assert "hashpartitioning(query_id" in _executed(joined) and rows == sorted(map(tuple, joined.collect())) and len(rows) > 1000


def test_bounds_of_groups_need_no_window(spark):
    rows = spark.createDataFrame([(g, n, float(n % 7)) for g in ("a", "b", None) for n in range(50)] + [("c", 1, 2.0), ("c", 2, 2.0), ("d", 1, None)], "g string, n long, score double")
    found = scoring.min_max_by(rows, ["g"])
    assert found.columns == rows.columns and "Window" not in _executed(found)
    plain = rows.withColumn("score", scoring.min_max(F.col("score"), W.partitionBy("g")))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, found.collect())) == sorted(map(key, plain.collect()))
    assert "Window" not in _executed(catalogue.queries()["minmax_scores"](spark, "/root/testdata/sf0.001"))


def test_texts_are_dealt_out_once_for_quotes(spark):
    plan = _executed(catalogue.queries()["grounded_quotes"](spark, "/root/testdata/sf0.001"))
    assert plan.count("REPARTITION_BY_COL") == 2 and "ENSURE_REQUIREMENTS" not in plan and "regexp_replace" in plan


def test_the_first_candidate_of_a_quote(spark):
    texts = [(1, 3, "Here the CONTROLLER reduces errors by a third."), (1, 2, "So the controller  reduces errors by a third, too."), (1, None, "The plant is only in this one, without rank."), (1, 1, None), (None, 1, "the controller reduces errors by a third")]
    quotes = ["controller reduces errors by a third", "Controller\nreduces errors by a third", "the plant is only in this one", "nowhere to be found in them", None]
    items = [(d, n, "claim", q, "r") for d in (1, 2, None) for n, q in enumerate(quotes)]
    found = highlight.ground_items(spark.createDataFrame(items, "doc_id long, n int, category string, quote string, reason string"), spark.createDataFrame(texts, "doc_id long, rank int, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, "claim", quotes[0], "r", 2, 1), (1, 1, "claim", quotes[1], "r", 2, 2), (1, 2, "claim", quotes[2], "r", None, 3)]


def test_pages_of_sentences_are_searched_without_their_texts(spark, monkeypatch):
    written, real = [], search.stored
    for module in (search, matching):
        monkeypatch.setattr(module, "stored", lambda df: written.append(df.columns) or real(df))
    plan = _executed(catalogue.queries()["sentence_pages"](spark, "/root/testdata/sf0.001"))
    assert written == [["doc_id", "n", "page_start", "page_end", "__needle", "__row"]]
    assert plan.count("REPARTITION_BY_COL") == 1 and "collect_list" not in plan


def test_pages_by_keys_and_first_ones(spark, monkeypatch):
    pages = spark.createDataFrame([(1, 300, "a b"), (1, 2, "b"), (1, 2, "b"), (1, None, "c b"), (1, 1, "a"), (2, 700, "b c"), (3, 1, None)], "doc_id long, page int, text string")
    needles = [(1, 10, "b"), (1, 11, "b"), (1, 12, "c"), (1, 13, "zz"), (2, 14, "b"), (2, 15, "c"), (3, 16, "a"), (None, 17, "a"), (1, 18, None)]
    asked = spark.createDataFrame(needles, "doc_id long, k int, needle string")
    every = {(1, 10, 300), (1, 10, 2), (1, 10, None), (1, 11, 300), (1, 11, 2), (1, 11, None), (1, 12, None), (2, 14, 700), (2, 15, 700)}
    firsts = every - {(1, 10, None), (1, 11, None)}
    for slice_, most in ((20_000, 200_000), (1, 200_000), (1, 0)):
        monkeypatch.setattr(matching, "SLICE_NEEDLES", slice_)
        monkeypatch.setattr(matching, "FEW_DOCUMENTS", most)
        for cheap in (True, False):
            for first, wanted in ((False, every), (True, firsts)):
                found = [tuple(r) for r in matching.occurrences(asked, pages, "k", first, cheap).collect()]
                assert len(found) == len(wanted) and set(found) == wanted


def test_the_shortest_variant_stands_for_all(spark):
    words = ["a bc def ghi jkl mno", "abcdefghijklmnopqrstuvwxyz and more of it than that", "one, two; three", "short", "", None, "abcdefgh", "İstanbul Straße and so on and on"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(search.variants(F.col("w")).alias("vs"), search.shortest(F.col("w")).alias("s")).collect()
    for r in rows:
        assert (r.s is None) == (not r.vs) and all(v.startswith(r.s) for v in r.vs or [])
