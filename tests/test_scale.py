"""What keeps work and memory in proportion to the input: nothing dear is found twice or shuffled with every pair, and no sum depends on order."""

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import chunking, retrieval, scoring, vectors


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "One is here. Two is there.\n\nThree."), (2, ""), (3, None)], "doc_id long, text string")
    chunks = chunking.chunk_documents(docs)
    # a filter that Spark makes of explode() would split the texts again
    assert not [line for line in _plan(chunks).splitlines() if "Filter" in line and "regexp_replace" in line]
    assert {r.doc_id for r in chunks.collect()} == {1}


def test_pairs_carry_numbers_alone(spark):
    chunks = spark.createDataFrame([(1, s, "child", "Body", f"word{s} is said", [1.0, float(s)]) for s in range(3)], "doc_id long, seq int, kind string, section string, text string, embedding array<double>")
    queries = spark.createDataFrame([("q", 1, "word1", [1.0, 1.0])], "query_id string, doc_id long, query string, query_embedding array<double>").withColumns({"selection": F.lit(""), "bias": F.lit("")})
    scored = retrieval.score_units(chunks, queries, True)
    above = [line for line in _plan(scored).splitlines() if "Window [" in line]
    assert above and not any("text#" in line or "embedding#" in line for line in above)
    # the pairs that are joined to the words' scores: before, with text and vectors
    project = next(line for line in _plan(scored).splitlines() if " cos#" in line and "Project [" in line)
    assert project.split("Project [")[1].startswith("query_id") and ", text#" not in project.split(" AS ")[0]


def test_sums_do_not_depend_on_order(spark):
    rows = [("a", x) for x in (0.1, 0.2, 0.3)] + [("b", x) for x in (0.3, 0.2, 0.1)]
    found = spark.createDataFrame(rows, "k string, x double").coalesce(1).groupBy("k").agg(scoring.exact_sum(F.col("x")).alias("s")).collect()
    assert found[0].s == found[1].s and abs(found[0].s - 0.6) < 1e-15


def test_norms_at_hand_change_no_cosine(spark):
    rows = [([1.0, 2.0], [2.0, 1.0]), ([1.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").select(scoring.cosine(a, b).alias("x"), scoring.cosine_with(a, b, scoring.vector_norm(a), scoring.vector_norm(b)).alias("y"))
    assert all(r.x == r.y for r in df.collect())


def test_scores_are_held_by_slices(monkeypatch):
    width, seen = 3, []
    real = np.argsort
    monkeypatch.setattr(vectors.np, "argsort", lambda a, **k: seen.append(np.shape(a)) or real(a, **k))
    import pandas as pd

    vecs = np.random.default_rng(1).normal(size=(250, width)).tolist()
    out = pd.concat(vectors._matcher(list(range(250)), vecs, 2, 6)(iter([pd.DataFrame({"id": range(250), "v": vecs})])))
    assert len(out) == 500 and max(s[0] for s in seen if len(s) == 2) <= 100
