"""Texts made to cost much: long repeats, tags that never end, hot keys."""

import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import components, fingerprints, htmlcut, mixing, pii

SPANS = {
    "x [at] a" + ".b" * 60_000: 1,
    "x at a" + " dot b" * 40_000: 0,
    "x 001" + " 12" * 60_000: 1,
    "1.2.3.4 " * 5_000: 5_000,
    "a." * 60_000 + "@": 0,
    "+1" + "(" * 100_000: 0,
    "a:" * 60_000: 0,
    "1-" * 60_000: 0,
}


def test_personal_data_in_hostile_texts(spark):
    docs = spark.createDataFrame(list(enumerate(SPANS)), "doc_id long, text string")
    found = {r["doc_id"]: r["n"] for r in pii.detect(docs, "text", ["doc_id"]).select("doc_id", F.size(F.filter("spans", lambda s: s["base"])).alias("n")).collect()}
    assert found[3] == 5_000 and all(found[i] == 0 for i in found if i != 3)


def test_contexts_are_those_of_the_text(spark):
    text = "ab a@b.cc x@y.de,u@v.fr;" + "z" * 50 + " q@r.es."
    rows = spark.range(1).select(F.explode(pii.find(F.lit(text), pii.BASE["email"], "email")).alias("s")).select("s.*").collect()
    assert len(rows) == 4
    for r in rows:
        assert r["value"] == text[r["start"] : r["end"]] and r["before"] == text[max(0, r["start"] - pii.CONTEXT_CHARS) : r["start"]] and r["after"] == text[r["end"] : r["end"] + 1]


@pytest.mark.parametrize("page", ["<" + "a" * 500_000, "if a <b then " * 40_000, '<a b=">" ' * 50_000, "<!-- " * 100_000, "<p>x" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<ul><li>x" * 30_000])
def test_pages_take_linear_time(page):
    start = time.perf_counter()
    htmlcut.main_text(page, htmlcut.PRIOR)
    assert time.perf_counter() - start < 20


def test_forms_around_a_page():
    article = "<h1>A title</h1><p>One long sentence of the article, which says what it has to say.</p>"
    text = "A title One long sentence of the article, which says what it has to say."
    main = lambda page: htmlcut.main_text(page, htmlcut.PRIOR)
    assert main(f"<body><form id=f><nav>Menu</nav>{article}<input><label>Name</label></form></body>") == text
    assert main(f"<body><form><article>{article}</article>Send us mail</form></body>") == text
    assert main(f"<body>{article}<form>Subscribe to it now, all of you.</form></body>") == text
    assert main(f'<div title="1 > 0" a">{article}</div>') == text


def test_long_sentences_are_compared_by_words(spark):
    words = [f"w{i}" for i in range(600)]
    near = lambda a, b: spark.range(1).select(fingerprints.likeness(*[fingerprints.signs(fingerprints.fingerprint(F.lit(t))) for t in (a, b)])).first()[0]
    assert abs(near(" ".join(words), " ".join(words[:300] + [f"x{i}" for i in range(300)])) - 1 / 3) < 0.15
    assert near("字" * 2000, "字" * 1000) > 0.3 and near("z" * 1500, "z" * 1500) == 1.0


def test_small_sources_come_near_their_targets(spark):
    docs = spark.createDataFrame([(i, "big", 900) for i in range(60)] + [(100, "few", 30), (101, "some", 300), (102, None, 45), (103, "one", 1), (104, "zero", 0)], "doc_id long, source string, size long")
    packed, held = mixing.mix(docs, ["doc_id"])
    target = {r["source_index"]: (r["target"], r["source_size"]) for r in packed.collect()}
    taken = {r["source_index"]: r["n"] for r in held.groupBy("source_index").agg(F.sum("words").alias("n")).collect()}
    assert all(abs(taken.get(i, 0) - t) <= max(1, 0.02 * n) for i, (t, n) in target.items())


def test_shards_draw_by_the_target_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 500)
    docs = spark.createDataFrame([("a", 300_000), ("b", 200_000), ("c", 400_000)], "source string, size long")
    sources = mixing.targets(docs)
    share = {r["source_index"]: r["target"] for r in sources.collect()}
    rows = mixing.counts(sources).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["slots"]
    assert len(size) > 5 and sum(size.values()) == mixing.draw(sources).count()
    # within four standard deviations of a multinomial draw
    for r in rows:
        p = share[r["source_index"]] / sum(share.values())
        assert abs(r["slots"] - size[r["shard"]] * p) < 4 * (size[r["shard"]] * p * (1 - p)) ** 0.5
    assert sorted(rows) == sorted(mixing.counts(sources.repartition(3)).collect())


def test_components_of_hubs(spark):
    links = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(2999, 6000)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert len(found) == 3000 + 1 + 41 and {found[i] for i in [*range(3000), 6000]} == {0} and {found[5000 + i] for i in range(41)} == {5000}


def test_hash_of_a_block_is_a_long():
    assert zlib.crc32(b"x") << 31 | 2**31 - 1 < 2**63
