from collections import Counter

import pytest

import corpus_pipeline
from lectern.llm import langid, sharding
from test_neardup import plain_kept
from test_simhash_decontam import plain_hits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sentences of two languages, copies, near copies, a benchmark passage, texts without letters, a null text."""
    import random

    rnd = random.Random(11)
    words = {"en": "the of and to in that with for this from which have been were".split(), "de": "der die und das nicht mit auf für ist ein eine werden auch nach".split()}
    make = lambda lang, n: " ".join(rnd.choice(words[lang]) + str(rnd.randint(0, 9)) * (rnd.random() < 0.4) for _ in range(n))
    rows = [(i, make(lang := ("en", "de")[i % 2], rnd.randint(30, 200)), lang, ("a", "b", None)[i % 3], 1) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2], "b", 1) for i in range(20)] + [(300, rows[3][1] + "\n", "de", "a", 1)]
    passage = make("en", 30)
    rows += [(400, make("en", 40) + " " + passage + " " + make("en", 40), "en", "a", 1), (401, None, "en", "a", 1), (402, "12 34 .", "en", "a", 1), (150, rows[0][1] + " x", "en", "a", 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "nowhere to be found in any of these texts at all ever")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, passage


def test_stages_against_brute_force(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, path)
    rejected = {r["doc_id"] for r in langid.identify(docs, "text", langid.fit_on(docs)).filter("rejected").collect()}
    kept = {r["doc_id"]: r["text"] for r in known.collect()}
    assert set(kept) == {r[0] for r in rows} - rejected and {401, 402} <= rejected and len(rejected) <= 5
    one = {r["doc_id"] for r in stages["simhash_near_dedup"](spark, known, path).collect()}
    # the stage's contract is a five-word similarity of 0.8, all pairs compared
    assert one == plain_kept(kept) and 150 not in one
    clean = stages["benchmark_decontamination"](spark, known.filter(known.doc_id.isin(*one)), path)
    items = [("1", passage), ("2", "nowhere to be found in any of these texts at all ever")]
    left = {r["doc_id"] for r in clean.collect()}
    assert left == {i for i in one if not plain_hits(kept[i], items)[1]} and 400 not in left


def test_run(spark, folder):
    path, rows, _ = folder
    found = corpus_pipeline.run(spark, path)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    out = found.collect()
    texts = {r[0]: (r[1] or "").split() for r in rows}
    taken = Counter()
    for r in out:
        assert r["n_chars"] == len(r["text"]) and r["shard"] in sharding.SHARDS and set(r["text"].split()) <= set(texts[r["doc_id"]])
        taken[r["doc_id"]] += len(r["text"].split())
    assert taken and all(n <= 2 * len(texts[i]) for i, n in taken.items())
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=str)
