from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from lectern.operators import embedding
from lectern.operators.chunking import chunk_documents
from lectern.operators.retrieval import RetrievalConfig, retrieve, score_units


def logged(folder):
    """A model that notes each request and each opening in files, answers in reverse order, and fails every third time. Made here, so that workers get it by value."""
    @dataclass(frozen=True)
    class Logged:
        folder: str
        name: str = "logged"
        fails: bool = True

        def open(self):
            import os
            import uuid

            open(f"{self.folder}/open-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
            calls = [0]

            def answer(texts):
                calls[0] += 1
                if self.fails and calls[0] % 3 == 1:
                    raise OSError("busy")
                with open(f"{self.folder}/request-{uuid.uuid4().hex}", "w") as f:
                    f.write(str(len(texts)))
                return [(i, [float(len(t)), float(i)]) for i, t in reversed(list(enumerate(texts)))]

            return answer

    return Logged(folder)


SCHEMA = "id long, text string, embedding int, note string"


def test_batches_order_and_retries(spark, tmp_path):
    texts = [f"text {'x' * (i % 40)} {i}" for i in range(205)] + [None, "", "é" * 9000, "😀" * 5000]
    rows = [(2**60 + i, t, 7, None) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = embedding.embed(spark.createDataFrame(rows, SCHEMA).coalesce(1), "text", logged(str(tmp_path)), batch=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0].asDict().keys() == {"id", "text", "note", "embedding", "embedding_cut"}
    by = {r.id - 2**60: r for r in got}
    assert len(by) == len(texts) and by[205].embedding is None and not by[205].embedding_cut
    for i, t in enumerate(texts):
        if t is not None and i < 207:
            assert by[i].embedding[0] == len(t) and by[i].text == t and not by[i].embedding_cut
    # 8000 units: so many letters, or half as many characters beyond the basic plane
    assert by[207].embedding_cut and by[207].embedding[0] == 8000 and by[208].embedding_cut and by[208].embedding[0] == 4000
    sizes = [int(f.read_text()) for f in tmp_path.glob("request-*")]
    assert sum(sizes) == 208 and sorted(sizes)[-10:] == [20] * 10
    assert len({f.name.split("-")[1] for f in tmp_path.glob("open-*")}) == len(list(tmp_path.glob("open-*")))


def test_a_request_that_keeps_failing(spark):
    @dataclass(frozen=True)
    class Short:
        name: str = "short"

        def open(self):
            return lambda texts: [(0, [1.0])]

    with pytest.raises(Exception, match="failed 3 times: 2 texts were asked for, 1 vectors came"):
        embedding.ask(Short().open(), ["a", "b"], wait=0)
    assert embedding.ask(Short().open(), ["a"]) == [[1.0]]


def test_empty_and_repeated(spark):
    model = embedding.HashedWords(8)
    none = embedding.embed(spark.createDataFrame([], "id long, text string"), "text", model)
    assert none.collect() == [] and none.columns == ["id", "text", "embedding", "embedding_cut"]
    twice = embedding.embed(spark.createDataFrame([(1, "a b a"), (1, "a b a")], "id long, text string"), "text", model).collect()
    assert twice[0] == twice[1] and sum(twice[0].embedding) == 3


def test_hybrid_retrieval_with_made_vectors(spark):
    """A unit that shares no word with the question, but its meaning by the model, is found by hybrid and not by words."""
    @dataclass(frozen=True)
    class Meaning:
        name: str = "meaning"

        def open(self):
            return lambda texts: [(i, [1.0, 0.0] if "feline" in t.lower() or "cats" in t.lower() else [0.0, 1.0]) for i, t in enumerate(texts)]

    text = "\n\n".join(f"Paragraph {i} speaks of {w} at some length and of nothing else at all." for i, w in enumerate(["stones", "cats", "rivers", "clouds"]))
    chunks = embedding.embed_units(chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")), Meaning())
    assert chunks.filter("kind = 'parent' and embedding is not null").count() == 0 and "embedding_cut" not in chunks.columns
    asked = embedding.embed_queries(spark.createDataFrame([(1, 1, "feline animals", "", "")], "query_id long, doc_id long, query string, selection string, bias string"), Meaning())
    first = lambda vectors: score_units(chunks, asked, vectors).orderBy(F.desc("score"), "seq").first()
    assert first(True).score == 0.6 and first(False).score == 0.0
    best = retrieve(chunks, asked, RetrievalConfig(stuff_token_limit=0), True).orderBy("rank").first()
    assert "cats" in best.context_text
