import random

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, figures, grounding, highlight, notes, retrieval, scoring, vectors
from lectern.sources import index_store, tables
from lectern.streaming import events


def plain_pack(sizes, limit):
    done, low, total = [], None, 0
    for i, s in enumerate(sizes):
        if low is not None and total + s > limit:
            done.append((low, i - 1))
            low, total = None, 0
        if low is None:
            low = i
        total += s
        if total >= limit and low == i:
            done.append((i, i))
            low, total = None, 0
    return done + ([(low, len(sizes) - 1)] if low is not None else [])


def test_packing_against_a_plain_model(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([1, 5, 30, 60, 100, 150]) for _ in range(rnd.randint(0, 12))]) for i in range(200)]
    found = spark.createDataFrame(rows, "i int, s array<long>").select("i", chunking.pack(F.col("s"), 100).alias("p")).collect()
    assert {r["i"]: [tuple(x) for x in r["p"]] for r in found} == {i: plain_pack(s, 100) for i, s in rows}


PAPER = "A title line\nAbstract\nWe study things. They matter.\n\nIn many ways.\n1 Introduction\n" + "This is a sentence of the introduction that goes on. " * 60 + "\n7 Conclusion\nWe are done here."


def test_chunks_of_a_paper(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunking.chunk_documents(docs).orderBy("doc_id", "seq").collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert [r["seq"] for r in rows] == list(range(1, len(rows) + 1))
    parents = [r for r in rows if r["parent_id"] is None]
    assert [r["section"] for r in parents] == ["Body", "Abstract", "1 Introduction", "7 Conclusion"]
    assert {r["kind"] for r in rows if r["section"] == "Abstract"} == {"abstract"}
    intro = [r for r in rows if r["section"] == "1 Introduction" and r["parent_id"]]
    assert [r["sent_start"] for r in intro][0] == 1 and intro[-1]["sent_end"] == 60
    assert all(b["sent_start"] == a["sent_end"] + 1 for a, b in zip(intro, intro[1:]))
    assert all(r["token_estimate"] <= chunking.CHILD_TOKENS + 10 for r in intro)


def test_paged_sections(spark):
    docs = spark.createDataFrame([(1, [(2, "more text\nMethod\nour way"), (1, "first page text")])], "doc_id long, pages array<struct<page:int,text:string>>")
    rows = [tuple(r) for r in chunking.sections(chunking.document_lines(docs)).orderBy("sec").select("name", "text", "page_start", "page_end").collect()]
    assert rows == [("Body", "first page text\nmore text", 1, 2), ("Method", "our way", 2, 2)]


def test_bm25_prefers_the_relevant_text(spark):
    units = spark.createDataFrame([(1, "cats and dogs"), (2, "residual force control of a robot"), (3, "weather report")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "robot force control"), (2, "nothing shared xyz")], "query_id long, query string")
    rows = scoring.bm25(units, ["doc_id"], asked).collect()
    assert [r["doc_id"] for r in rows] == [2]


def test_cosine_and_min_max(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(scoring.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


CHUNKS = "doc_id long, seq int, id string, parent_id string, kind string, section string, text string, page_start int, token_estimate long, embedding array<double>"


def chunk_rows():
    rows = [(1, 1, "p1", None, "parent", "Intro", "parent text of the intro", 1, 50, None)]
    rows += [(1, 2 + i, f"c{i}", "p1", "child", "Intro", f"robot control sentence number {i}", 1, 10, [float(i), 1.0]) for i in range(5)]
    rows += [(1, 10, "p2", None, "abstract", "Abstract", "the abstract parent", 1, 20, [0.0, 0.0]), (1, 11, "c9", "p2", "abstract", "Abstract", "what we do", 1, 10, None)]
    return rows


def test_evidence_caps_a_parent_and_pins_the_abstract(spark):
    chunks = spark.createDataFrame(chunk_rows(), CHUNKS)
    asked = spark.createDataFrame([("a", 1, "robot control", "", ""), ("b", 1, "summary of robot", "", "")], "query_id string, doc_id long, query string, selection string, bias string")
    found = retrieval.retrieve(chunks, asked, retrieval.RetrievalConfig(stuff_token_limit=0)).collect()
    a = sorted((r["rank"], r["id"], r["context_text"]) for r in found if r["query_id"] == "a")
    assert [x[1] for x in a] == ["c0", "c1", "c2"] and {x[2] for x in a} == {"parent text of the intro"}
    b = {r["rank"]: r["id"] for r in found if r["query_id"] == "b"}
    assert b[1] == "p2" or "p2" in b.values()


def test_short_documents_are_taken_whole(spark):
    chunks = spark.createDataFrame(chunk_rows(), CHUNKS)
    asked = spark.createDataFrame([("a", 1, "anything", "", "")], "query_id string, doc_id long, query string, selection string, bias string")
    found = retrieval.retrieve(chunks, asked).orderBy("rank").collect()
    assert [(r["id"], r["mode"]) for r in found] == [("p1", "stuff"), ("p2", "stuff")]
    assert retrieval.context_block(retrieval.retrieve(chunks, asked)).first()["context_block"].startswith("[1] Intro\nparent text")


def test_hybrid_uses_vectors(spark):
    chunks = spark.createDataFrame(chunk_rows(), CHUNKS)
    asked = spark.createDataFrame([("a", 1, "robot control", "", "", [1.0, 0.0])], "query_id string, doc_id long, query string, selection string, bias string, query_embedding array<double>")
    best = retrieval.score_units(chunks, asked, query_vectors=True).orderBy(F.desc("score")).first()
    assert best["seq"] == 6


def test_claims(spark):
    answer = "- The robot is controlled by force [1].\n2. The <b>second</b> claim stands here\nWhat is this about then?\n- The robot is controlled by force\nshort"
    found = spark.range(1).select(grounding.claims(F.lit(answer)).alias("c")).first()["c"]
    assert found == ["The robot is controlled by force .", "The second claim stands here", "The robot is controlled by force"]


def longest(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)


def test_longest_run_against_a_plain_model(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice("abc") for _ in range(rnd.randint(0, 9))], [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]) for i in range(150)]
    found = spark.createDataFrame(rows, "i int, a array<string>, b array<string>").select("i", grounding.longest_run(F.col("a"), F.col("b")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in found} == {i: longest(a, b) for i, a, b in rows}


def test_grounding_links_what_is_supported(spark):
    sentences = spark.createDataFrame([(1, 1, "The controller reduces tracking error by a third in all runs."), (1, 2, "Weather was fine during the experiments outside.")], "doc_id long, pos int, text string")
    claims = spark.createDataFrame([("a", 1, 1, 0, "the controller reduces tracking error"), ("b", 1, 1, 1, "bananas are yellow fruit")], "claim_id string, doc_id long, turn int, claim_no int, claim string")
    best = grounding.best_sentences(claims, sentences, ["doc_id"])
    assert [(r["claim_id"], r["pos"]) for r in grounding.links(best, ["doc_id", "turn"]).collect()] == [("a", 1)]


def test_highlights(spark):
    raw = 'Sure: ```json\n{"items": [{"category": "claim", "quote": "q1", "reason": "r"}, {"category": "odd", "quote": "q2", "reason": "r"}]}\n```'
    items = spark.range(1).select(F.posexplode(highlight.parse_items(F.lit(raw))).alias("n", "i")).select(F.lit(1).alias("doc"), "n", "i.*")
    assert [r["quote"] for r in highlight.cap_items(items, ["doc"], "n").collect()] == ["q1"]
    quotes = spark.createDataFrame([(1, "Reduces the tracking ERROR by a third"), (2, "a quote that is nowhere to be found")], "quote_id long, quote string")
    texts = spark.createDataFrame([(7, "It reduces the  tracking error by a third.")], "text_id long, text string")
    assert [tuple(r) for r in highlight.verify_quotes(quotes, texts).collect()] == [(1, 7)]


def test_passages_stay_in_budget(spark):
    units = spark.createDataFrame([(1, i, "Method", f"passage {i} " + "x" * 60, 2500) for i in range(5)], "doc_id long, seq int, section string, text string, token_estimate long")
    assert highlight.select_passages(units).count() == 2


def test_figures(spark):
    text = "Figure 1: A plot of it.\n\nAs shown in Figure 1, the result is better than what was there before.\n\nFigure 1: again\nTable 2. Numbers"
    row = spark.range(1).select(figures.mentions(F.lit(text)).alias("m"), figures.discussions(F.lit(text), F.array(F.lit("Figure 1"))).alias("d")).first()
    assert len(row["m"]) == 2 and row["d"] == ["As shown in Figure 1, the result is better than what was there before."]


def test_notes(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, at int, v string")
    new = spark.createDataFrame([("b", 5, None), ("c", 6, "z")], "k string, at int, v string")
    assert {(r["k"], r["v"]) for r in notes.latest(rows, ["k"], "at", "at").collect()} == {("a", "y"), ("b", None)}
    assert sorted((r["k"], r["at"]) for r in notes.upsert(rows.filter("k = 'b'"), new, ["k"]).collect()) == [("b", 5), ("c", 6)]


def test_nearest_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None)], "id long, v array<double>")
    found = vectors.nearest(rows, rows.filter("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [r["match"] for r in found] == [2, 3]


def test_streams(spark):
    lines = [(1, 1, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), (1, 2, 'data: {"choices":[{"delta":{"content":"lo "}}]}'), (1, 3, "data: [DONE]"), (1, 4, "data: {bad"), (1, 5, "")]
    assert events.fold_chat(spark.createDataFrame(lines, "s int, n int, line string"), "s", "n", "line").first()["text"] == "Hello"
    done = [(1, 1, 'data: {"type":"x.delta","delta":"ab"}'), (1, 2, 'data: {"type":"x.done","text":"abc"}')]
    assert events.fold_responses(spark.createDataFrame(done, "s int, n int, line string"), "s", "n", "line").first()["text"] == "abc"


def test_debounce_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:30", 2), ("a", "2024-01-01 01:00:00", 3)], "k string, at string, v int").withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("at", "1 minute")
    query = events.debounce(stream, "k", "at", "2 minutes", "v").writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["n"], r["v"]) for r in spark.table("debounced").collect()] == [(2, 2)]


def test_index_grows_by_what_is_new(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = tables.build_documents(spark.createDataFrame([(1, "Some text here. And more."), (2, "  ")], "doc_id long, text string"))
    assert index_store.ensure_index(spark, docs, path).select("doc_id").distinct().count() == 1
    before = spark.read.parquet(path).count()
    more = tables.build_documents(spark.createDataFrame([(1, "Some text here. And more."), (3, "Other text.")], "doc_id long, text string"))
    index_store.ensure_index(spark, more, path)
    assert spark.read.parquet(path).filter("doc_id = 1").count() == before
    assert T.SQL_FUNCTIONS["tokenize"] is T.tokens


def test_versions_of_a_document_are_indexed_apart(spark):
    from lectern.sources.tables import build_documents, build_index

    raw = spark.createDataFrame([(1, "First text of it. Alpha."), (1, "Second text of it. Beta."), (1, "Second text of it. Beta."), (None, "No id at all.")], "doc_id long, text string")
    rows = build_index(build_documents(raw)).filter("kind = 'parent'").collect()
    assert sorted(r["text"] for r in rows) == ["First text of it. Alpha.", "Second text of it. Beta."] and len({r["content_hash"] for r in rows}) == 2


def test_sections_in_a_row_are_those_of_lines(spark):
    import random

    rnd = random.Random(17)
    pieces = ["Introduction", "2.1 The Method", "RESULTS AND MORE", "some text that is long enough to be prose, and ends.", "", "  ", "short", "References", "IV. Discussion of It", "A line\r"]
    rows = [(i, "\n".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))) for i in range(120)] + [(200, None), (201, ""), (202, "Introduction\nResults")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "name", "text"]
    plain = chunking.sections(chunking.document_lines(docs)).orderBy("doc_id", "sec").select(*columns).collect()
    assert chunking.text_sections(docs).orderBy("doc_id", "sec").select(*columns).collect() == plain and len(plain) > 150
    line = "Abstract of this fine and useful paper here."  # ends like a sentence, so it is no heading
    body = line + "\n" + "It tells a lot of things. " * 12 + "\n1 Some numbered line that is no heading, as it is far too long for one and ends here; or so it is.\n" + "More of it. " * 10
    found = [(r["sec"], r["name"]) for r in chunking.text_sections(spark.createDataFrame([(1, "x\n" + body)], "doc_id long, text string")).orderBy("sec").collect()]
    assert found == [(-1, "Abstract"), (0, "Body")]
